"""Cutting documents into chunks: fixed windows, sentence-aware packing, overlaps."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_PARAGRAPH = re.compile(r"\n{2,}")


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    """Array of windows of `size` characters, each starting size - overlap after the last; the final one ends the text.

    Null and '' give an empty array. The overlap must be smaller than the size.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than size")
    step = size - overlap
    n = F.length(text)
    count = F.when(n <= 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    windows = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(text, k * step + 1, size))
    return F.when(count > 0, windows).otherwise(F.array().cast("array<string>"))


def explode_chunks(docs: DataFrame, chunks: Column, keep: list[str], first: int = 0) -> DataFrame:
    """keep + (chunk_index, chunk_text), numbered from `first`; documents without chunks drop out."""
    return docs.select(*keep, F.posexplode(chunks).alias("chunk_index", "chunk_text")).withColumn("chunk_index", F.col("chunk_index") + first)


#: What joins a paragraph, a sentence and a slice of a sentence to what is held before it.
_GLUE = ("\n\n", " ", " ")


def _between(gap: re.Pattern, text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """The spans of text[lo:hi] that the gaps leave, without white space at their ends and without empty ones."""
    ends = [lo]
    for m in gap.finditer(text, lo, hi):
        ends += m.span()
    spans = zip(ends[::2], [*ends[1::2], hi])
    return [(a, b) for a, b in (_trimmed(text, a, b) for a, b in spans) if a < b]


def _trimmed(text: str, lo: int, hi: int) -> tuple[int, int]:
    body = text[lo:hi]
    return lo + len(body) - len(body.lstrip()), lo + len(body.rstrip())


def _plan(text: str, target: int, least: int) -> list[list[tuple[str, int, int]]]:
    """For each chunk the spans it is made of, with what stands before each.

    A fold over a stack of spans that are not placed yet, each a paragraph (grain 0), a sentence (1) or what is left of a
    sentence (2). Only lengths are looked at: a span is taken, begins the next chunk, or is put back as finer spans.
    """
    todo = [(0, lo, hi) for lo, hi in reversed(_between(_PARAGRAPH, text, 0, len(text)))]
    plan: list[list[tuple[str, int, int]]] = [[]]
    held = 0
    while todo:
        grain, lo, hi = todo.pop()
        joint = _GLUE[grain] if held else ""
        if grain == 2:
            cut = min(hi, lo + max(1, target - held - len(joint)))
            if cut < hi:
                todo.append((2, cut, hi))
            lo, cut = (lo, _trimmed(text, lo, cut)[1]) if held else _trimmed(text, lo, cut)
            if lo < cut:
                plan[-1].append((joint, lo, cut))
                held += len(joint) + cut - lo
            if held >= least:
                plan.append([])
                held = 0
        elif held + hi - lo < target:
            plan[-1].append((joint, lo, hi))
            held += len(joint) + hi - lo
        elif held >= least:
            plan.append([("", lo, hi)])
            held = hi - lo
        elif grain == 1:
            todo.append((2, lo, hi))
        else:
            todo += [(1, a, b) for a, b in reversed(_between(_SENTENCE, text, lo, hi))]
    return plan


def pack(text: str | None, target: int = 1000, least: int = 600) -> list[str]:
    """Paragraphs gathered to about `target` characters; those that do not fit are opened into sentences, and sentences
    without a full enough buffer before them are wrapped hard. A paragraph or sentence that follows a buffer of at
    least `least` characters starts a new one whatever its own length. Blank texts give none."""
    text = re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", text or ""))
    return ["".join(joint + text[lo:hi] for joint, lo, hi in spans) for spans in _plan(text, target, least) if spans]


def packed_chunks(text: Column, target: int = 1000, least: int = 600) -> Column:
    """Array of packed chunks before overlaps; one Arrow call a batch of documents."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: pack(t, target, least))

    return run(text)


def with_overlap(chunks: DataFrame, key: str, overlap: int, index: str = "chunk_index", text: str = "chunk_text") -> DataFrame:
    """Each chunk after a document's first is led by the last `overlap` characters of the original chunk before it and a
    line end, then stripped. Overlaps do not add up, as they come from the original chunks."""
    from clausewright.functions.text import py_strip

    before = F.lag(text).over(Window.partitionBy(key).orderBy(index))
    tail = F.substring(before, -overlap, overlap) if overlap else F.lit("")
    return chunks.withColumn(text, F.when(before.isNull(), F.col(text)).otherwise(py_strip(F.concat(tail, F.lit("\n"), F.col(text)))))
