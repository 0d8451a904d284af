"""Text to vectors through a pluggable model, loaded once a worker."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions.text import non_blank


class Embedder(Protocol):
    name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Deterministic stand-in: signed hashed bag of words, unit length."""

    name = "hashed-words"

    def __init__(self, dim: int = 384):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        words = [re.findall(r"\w+", t.lower()) for t in texts]
        known = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        h = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
        ids = np.fromiter((known[w] for ws in words for w in ws), np.int64, sum(map(len, words)))
        row = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
        place, sign = ((h >> np.uint64(1)) % np.uint64(self.dim)).astype(np.int64), np.where(h & np.uint64(1), 1.0, -1.0)
        out = np.bincount(row * self.dim + place[ids], sign[ids], len(texts) * self.dim).reshape(len(texts), self.dim).astype(np.float32)
        norm = np.linalg.norm(out, axis=1)
        return out / np.where(norm > 0, norm, 1)[:, None]


def embed(text: Column, model: Callable[[], Embedder] = HashingEmbedder) -> Column:
    """Vector of each text; null for null and blank texts and where the model fails on a batch's text."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        loaded = None
        for s in parts:
            loaded = loaded or model()
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            good = [i for i, t in enumerate(s) if t is not None and t.strip()]
            try:
                vectors = list(loaded.encode([s.iloc[i] for i in good])) if good else []
            except Exception:
                vectors = []
                for i in good:
                    try:
                        vectors.append(loaded.encode([s.iloc[i]])[0])
                    except Exception:
                        vectors.append(None)
            for i, v in zip(good, vectors):
                out.iloc[i] = None if v is None else np.asarray(v, np.float32)
            yield out

    return run(text)


def reembed(chunks: DataFrame, text: str, target: str, model: Callable[[], Embedder] = HashingEmbedder) -> DataFrame:
    """chunks with the target vector anew for non-blank texts; other rows keep what they had. Only rows to embed reach Python."""
    rest = [c for c in chunks.columns if c != target]
    old = F.col(target) if target in chunks.columns else F.lit(None).cast("array<float>")
    due = non_blank(text)
    done = chunks.filter(due).select(*rest, embed(F.col(text), model).alias(target))
    return done.unionByName(chunks.filter(~due).select(*rest, old.alias(target)))
