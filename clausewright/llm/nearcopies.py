"""Records that share most of their word sequences (problem 1).

Every distinct text is fingerprinted: its word n-grams are hashed into a 64-bit space, the space is cut into 64
segments, and the fingerprint's bits are counted per segment. The Manhattan distance of two count vectors never
exceeds the symmetric difference of the two n-gram sets, so pairs farther apart than the threshold permits are
dropped without a look at the texts. The total count is the grid's coordinate: only rows whose cells (wide enough
that similar sizes lie in one or two neighbours) and band keys agree are joined. The remaining pairs are verified
on the texts themselves.

Counts alone cannot tell a pair of similarity 0.6 from chance (see README), so the grid lies within the buckets of
min-hash bands.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.operators.graph import connected_components
from clausewright.runtime import materialize

WORD = re.compile(r"[a-z0-9]+")
SEGMENTS = 64
_BATCH = 1000
#: Rows of a key that one task compares with each other at most; longer ones are cut into blocks.
HOT = 2048
KEY_BUCKETS = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def ngram_hashes(words: list[list[str]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each word list: (index of the list, hash), sorted."""
    seen: dict[str, int] = {}
    for ws in words:
        for w in ws:
            if w not in seen:
                seen[w] = xxhash.xxh3_64_intdigest(w)
    flat = np.fromiter((seen[w] for ws in words for w in ws), np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    doc = np.repeat(np.arange(len(words)), sizes)
    if len(flat) < n:
        return doc[:0], flat[:0]
    m = len(flat) - n + 1
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + flat[i : i + m])
    inside = doc[:m] == doc[n - 1 :]
    doc, h = doc[:m][inside], h[inside]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def _signer(n: int, min_words: int, bands: int, rows: int):
    rng = np.random.default_rng(20240229)
    mul = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(at, _BATCH)
                words = [WORD.findall((t or "").lower()) for t in batch.column("text").to_pylist()]
                keep = [i for i, w in enumerate(words) if len(w) >= max(min_words, n)]
                if not keep:
                    continue
                doc, h = ngram_hashes([words[i] for i in keep], n)
                start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                size = np.diff(np.r_[start, len(doc)])
                keys = np.empty((len(keep), bands), np.uint64)
                for b in range(bands):
                    key = np.full(len(keep), b, np.uint64)
                    for r in range(b * rows, b * rows + rows):
                        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(h * mul[r] + add[r], start))
                    keys[:, b] = key
                seg = doc * SEGMENTS + (h >> np.uint64(64 - 6)).astype(np.int64)
                pops = np.bincount(seg, minlength=len(keep) * SEGMENTS).clip(max=255).astype(np.uint8)
                yield pa.record_batch(
                    [
                        batch.column("id").take(pa.array(keep)),
                        pa.array(size.astype(np.int32)),
                        pa.array([pops[k * SEGMENTS : (k + 1) * SEGMENTS].tobytes() for k in range(len(keep))], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, len(keep) * bands + 1, bands, dtype=np.int32), pa.array(keys.reshape(-1).view(np.int64))),
                        batch.column("text").take(pa.array(keep)),
                    ],
                    names=["id", "n", "pops", "bands", "text"],
                )

    return sign


def _lower_bound(reach: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, SEGMENTS).astype(np.int16) for c in ("pops_a", "pops_b"))
            sizes = b.column("n_a").to_numpy() + b.column("n_b").to_numpy()
            near = np.abs(x - y).sum(axis=1) <= np.floor(reach * sizes + 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(near))

    return keep


def _verifier(n: int, threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number: dict[tuple, int] = {}  # of each n-gram in the batch
            sides = []
            for c in ("text_a", "text_b"):
                texts = b.column(c).dictionary_encode()  # a text in many pairs is read once
                words = [WORD.findall(t.lower()) for t in texts.dictionary.to_pylist()]
                grams = [frozenset([number.setdefault(g, len(number)) for g in zip(*(w[i:] for i in range(n)))]) for w in words]
                sides.append((grams, texts.indices.to_numpy()))
            (x, i), (y, j) = sides
            both = np.fromiter((len(x[p] & y[q]) for p, q in zip(i.tolist(), j.tolist())), np.int64, b.num_rows)
            size = [np.array([len(g) for g in grams], np.int64)[at] if len(grams) else at for grams, at in sides]
            sim = both / np.maximum(1, size[0] + size[1] - both)
            yield pa.record_batch([b.column("a"), b.column("b"), pa.array(sim)], names=["a", "b", "similarity"]).filter(pa.array(sim >= threshold - 1e-12))

    return verify


def _hot_keys(posts: DataFrame) -> DataFrame:
    """(key, blocks) of the keys with more than HOT rows. Only keys in buckets of keys that stand out by half of that are counted one
    by one, so next to nothing is shuffled for the many keys of a few rows."""
    bucket = F.pmod("key", F.lit(KEY_BUCKETS))
    buckets = materialize(posts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("m")))
    mean = (buckets.agg(F.sum("m")).first()[0] or 0) / KEY_BUCKETS
    full = buckets.filter(F.col("m") > mean + HOT / 2).select("bucket")
    counted = posts.withColumn("bucket", bucket).join(full, "bucket", "left_semi").groupBy("key").agg(F.count("*").alias("m"))
    return materialize(counted.filter(F.col("m") > HOT).select("key", F.ceil(F.col("m") / HOT).cast("int").alias("blocks")))


def _candidates(posts: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: ids that share a key and are of similar size; a pair comes once a key.

    The rows of a hot key are cut into blocks of about HOT, and every two blocks meet under a key of their own, so that a key of a
    third of all rows is spread over the tasks and loses no pair.
    """
    similar = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(threshold) - 1e-6
    side = lambda df, i, *more: df.select("key", F.col("id").alias(i), F.col("n").alias(f"n_{i}"), *more)
    hot = _hot_keys(posts)
    some = not hot.isEmpty()
    rest = posts.join(hot, "key", "left_anti") if some else posts
    pairs = side(rest, "a").join(side(rest, "b"), "key").filter((F.col("a") < F.col("b")) & similar).select("a", "b")
    if not some:
        return pairs
    cut = posts.join(hot, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = side(cut, "a", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = side(cut, "b", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"))
    met = left.join(right, ["key", "i", "j"]).filter(similar & ((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))))
    return pairs.union(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def near_copies(
    docs: DataFrame, id_col: str, text_col: str, *, threshold: float = 0.8, ngram: int = 5, min_words: int = 20, bands: int = 48, rows: int = 4
) -> tuple[DataFrame, DataFrame]:
    """(links, members) over the distinct texts of docs.

    links(a, b, similarity): every pair of representatives, a < b, whose sets of word n-grams have a Jaccard
    similarity of at least threshold. members(id, rep): every id with at least min_words words and the smallest id
    that holds the very same text. With 48 bands of 4 rows a pair at similarity 0.6 is missed with probability 0.0013, at
    0.65 with 0.0001. Null ids and texts, and texts with fewer words, take part in neither. An id
    delivered again counts once; under one id with several texts each text counts. Extra columns are not looked at.
    """
    rows_ = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    rows_ = rows_.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(7), "text"))
    texts = rows_.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("text").alias("text"))
    signed = materialize(
        texts.select("id", "text").mapInArrow(_signer(ngram, min_words, bands, rows), "id bigint, n int, pops binary, bands array<bigint>, text string")
    )
    # Grid over the fingerprints' total bit counts: a cell spans three times the largest ratio of similar sizes, so a
    # row is posted to its own cell and, from the top third, to the next one.
    step = -math.log(threshold)
    cell = (F.log(F.col("n").cast("double")) / (3 * step)) if step > 1e-6 else F.col("n").cast("double")
    own, reach = F.floor(cell).cast("int"), F.floor(cell + (1 / 3 + 1e-6 if step > 1e-6 else 0)).cast("int")
    posts = signed.select("id", "n", F.explode("bands").alias("band"), F.sequence(own, reach).alias("cells"))
    posts = posts.select("id", "n", F.explode(F.transform("cells", lambda c: F.xxhash64("band", c))).alias("key"))
    pairs = _candidates(posts, threshold).distinct()
    size = signed.select("id", "n", "pops")
    bounded = pairs
    for c in "ab":
        bounded = bounded.join(size.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("pops").alias(f"pops_{c}")), c)
    near = bounded.mapInArrow(_lower_bound((1 - threshold) / (1 + threshold)), "a bigint, b bigint")
    near = materialize(near)
    for c in "ab":
        near = near.join(signed.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")), c)
    links = near.mapInArrow(_verifier(ngram, threshold), "a bigint, b bigint, similarity double").distinct()
    reps = signed.select(F.col("id").alias("rep"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"))
    members = rows_.select("k1", "k2", "id").distinct().join(reps, ["k1", "k2"]).select("id", "rep")
    return links, members


def linked_ids(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b) of ids, a < b: representatives' links, each further member with the other side's representative and
    with its own. Linear in members and links; copies are not expanded into all their pairs."""
    more = materialize(members.filter("id <> rep"))
    pairs = materialize(links.select("a", "b"))
    of_a = pairs.join(more, pairs.a == more.rep).select(F.col("id").alias("a"), "b")
    of_b = pairs.join(more, pairs.b == more.rep).select("a", F.col("id").alias("b"))
    every = pairs.union(of_a).union(of_b).union(more.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def copy_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class_id, group_id, n_links): one row per id; group_id is the smallest id connected by links."""
    links = materialize(links)
    parts = connected_components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    return (
        members.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .join(degree, "rep", "left")
        .select("id", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
