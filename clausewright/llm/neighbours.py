"""The k most similar vectors of every vector (problem 4): a permutation index.

A vector is represented by the order of its eight nearest pivots. It is in the inverted files of all pairs among them; the
files of the pairs with the same smaller pivot travel together as a unit, so a vector is sent at most seven times. Within a
file the footrule distance of the orders ranks the others, and all within a radius, however many, are reranked by cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewright.runtime import materialize, spread

PERM = 8
#: Footrule distance (two orders that share no pivot have PERM * (PERM + 1)) up to which others are reranked.
RADIUS = 62
#: Rows of a unit at most; a longer one is cut into blocks of half of it, each pair of blocks a unit of its own.
UNIT = 65_536
#: Similarities held at once.
CELLS = 4_000_000
#: No two pivots are as similar as this: a group of copies with small edits has a pivot or two, shares its files and is
#: compared whole, however many of the rows it holds.
APART = 0.9


def _usable(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            top = np.abs(v).max(axis=1)
            ok = np.isfinite(top) & (top > 0)
            v = v[ok] / top[ok, None]
            v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
            yield pa.record_batch([b.column("id").filter(pa.array(ok)), pa.array([r.tobytes() for r in v], pa.binary())], names=["id", "vec"])

    return run


def unit_vectors(rows: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, vec) of the usable rows: dim finite numbers, not all zero; vec is a unit vector of float32."""
    kept = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(F.col("id").isNotNull() & (F.size("vec") == dim))
    return spread(kept, "id").mapInArrow(_usable(dim), "id bigint, vec binary")


def _apart(v: np.ndarray, count: int) -> np.ndarray:
    """The first rows of v, at most count, that are less similar than APART to all taken before."""
    taken = np.empty((count, v.shape[1]), np.float32)
    n = 0
    for row in v:
        if n < count and not (taken[:n] @ row >= APART).any():
            taken[n] = row
            n += 1
    return taken[:n]


def _poster(pivots: np.ndarray, blocks: dict[int, int] | None = None):
    """Posts of each vector under its nearest pivots but the last in number. blocks: of the pivots whose unit is cut, into how
    many; without it only the keys come, to be counted."""
    n = len(pivots)
    depth = min(PERM, n)

    def units(pivot: int, ids: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """Keys of the units and the rows that go there."""
        if (count := blocks.get(pivot, 1)) == 1:
            yield pivot << 32, np.arange(len(ids))
            return
        mixed = ids.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        own = ((mixed >> np.uint64(32)) % np.uint64(count)).astype(np.int64)
        for i in range(count):
            for j in range(i + 1, count):
                yield pivot << 32 | i << 16 | j, np.flatnonzero((own == i) | (own == j))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                v = np.frombuffer(b"".join(b.column("vec").to_pylist()), np.float32).reshape(b.num_rows, -1)
                dots = v @ pivots.T
                near = np.argpartition(-dots, depth - 1, axis=1)[:, :depth] if depth < n else np.tile(np.arange(n), (len(v), 1))
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(dots, near, 1), axis=1, kind="stable"), 1)
                under = np.sort(near, axis=1)[:, : max(1, depth - 1)]
                if blocks is None:
                    yield pa.record_batch([pa.array(under.ravel().astype(np.int32))], names=["pivot"])
                    continue
                perms = pa.array([r.tobytes() for r in near.astype(">u2")], pa.binary())
                rows, keys = np.repeat(np.arange(len(v)), under.shape[1]), under.ravel().astype(np.int64) << 32
                if blocks:
                    parts = [(k, of[x]) for p in np.unique(under) for of in [np.flatnonzero((under == p).any(axis=1))] for k, x in units(int(p), b.column("id").take(pa.array(of)))]
                    rows, keys = np.concatenate([r for _, r in parts]), np.concatenate([np.full(len(r), k, np.int64) for k, r in parts])
                for s in range(0, len(rows), 20_000):
                    r = pa.array(rows[s : s + 20_000])
                    yield pa.record_batch([pa.array(keys[s : s + 20_000]), perms.take(r), b.column("id").take(r), b.column("vec").take(r)], names=["key", "perm", "id", "vec"])

    return post


def _weights(perm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight of each pivot of these orders in each of them, the orders in these pivots): the nearest pivot weighs as much as the order
    is long, the last one 1, others 0."""
    depth = perm.shape[1]
    pivots, local = np.unique(perm, return_inverse=True)
    local = local.reshape(perm.shape)
    weight = np.zeros((len(pivots), len(perm)), np.uint8)
    np.put_along_axis(weight.T, local, np.arange(depth, 0, -1, dtype=np.uint8)[None, :], 1)
    return weight, local


def _footrule(weight: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Footrule distance of each of the orders to all of those weighed; a pivot that an order lacks stands behind its end."""
    depth = orders.shape[1]
    shared = np.zeros((len(orders), weight.shape[1]), np.uint8)
    for i in range(depth):
        shared += np.minimum(weight[orders[:, i]], np.uint8(depth - i))
    return depth * (depth + 1) - 2 * shared.astype(np.int16)


def _top_of(v: np.ndarray, perm: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other row, similarity): the k best others of each row within RADIUS, of those from least on."""
    n, out = len(v), []
    step = max(1, CELLS // n)
    weight, orders = _weights(perm)
    for at in range(0, n, step):
        sims = v[at : at + step] @ v.T
        sims[_footrule(weight, orders[at : at + step]) > RADIUS] = -2
        rows = np.arange(len(sims))
        sims[rows, rows + at] = -2
        if n > k:
            top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            sims = np.take_along_axis(sims, top, 1)
        else:
            top = np.broadcast_to(np.arange(n), sims.shape)
        q, c = np.nonzero(sims >= max(least, -1.5))
        out.append((q + at, top[q, c], sims[q, c]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _best(pivot: int, ids: np.ndarray, v: np.ndarray, perm: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, other, similarity) of a unit: the k best of each row over the files of the pairs of pivot with a larger one.
    Where these files together ask for more comparisons than the unit has pairs, the unit is ranked as one file."""
    rows, place = np.nonzero(perm > pivot)
    order = np.argsort(perm[rows, place], kind="stable")
    second, rows = perm[rows, place][order], rows[order]
    cuts = np.flatnonzero(np.diff(second, prepend=-1, append=-1))
    if not len(rows) or (np.diff(cuts).astype(float) ** 2).sum() >= float(len(ids)) ** 2:
        q, c, sims = _top_of(v, perm, k, least)
    else:
        parts = [(f[q], f[c], sims) for s, e in zip(cuts[:-1], cuts[1:]) if e - s > 1 for f in [rows[s:e]] for q, c, sims in [_top_of(v[f], perm[f], k, least)]]
        if not parts:
            return ids[:0], ids[:0], v[:0, 0]
        q, c, sims = (np.concatenate(x) for x in zip(*parts))
        _, first = np.unique(q * len(ids) + c, return_index=True)
        q, c, sims = q[first], c[first], sims[first]
        order = np.lexsort((ids[c], -sims, q))
        q, c, sims = q[order], c[order], sims[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        q, c, sims = q[rank < k], c[rank < k], sims[rank < k]
    return ids[q], ids[c], sims


def _searcher(dim: int, k: int, least: float):
    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Whole units, in order of key; one is held at a time."""
        held, now = [], None
        for b in batches:
            if not b.num_rows:
                continue
            key, perm = b.column("key").to_numpy(), b.column("perm").to_pylist()
            part = (
                b.column("id").to_numpy(),
                np.frombuffer(b"".join(b.column("vec").to_pylist()), np.float32).reshape(-1, dim),
                np.frombuffer(b"".join(perm), ">u2").reshape(len(perm), -1).astype(np.uint16),
            )
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if held and key[s] != now:
                    yield now >> 32, *(np.concatenate(x) for x in zip(*held))
                    held = []
                now = int(key[s])
                held.append(tuple(x[s:e].copy() for x in part))
        if held:
            yield now >> 32, *(np.concatenate(x) for x in zip(*held))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for pivot, ids, v, perm in units(batches):
            if len(ids) < 2:
                continue
            out.append(_best(pivot, ids, v, perm.astype(np.int64), k, least))
            size += len(out[-1][0])
            if size > 20_000:
                yield pa.record_batch([np.concatenate(x) for x in zip(*out)], names=["id", "other", "similarity"])
                out, size = [], 0
        if size:
            yield pa.record_batch([np.concatenate(x) for x in zip(*out)], names=["id", "other", "similarity"])

    return search


def similar_vectors(rows: DataFrame, id_col: str, vec_col: str, *, dim: int, k: int = 5, min_similarity: float = -1.0, max_pivots: int = 2048) -> DataFrame:
    """(id, other, similarity): up to k most similar other ids of each usable vector, by cosine, approximately.

    Pivots are a sample of at most max_pivots distinct vectors (about the square root of their number, by hash of
    the id, less similar than APART): the only thing fitted on a sample. Every vector is indexed. A pivot's unit of more
    than UNIT rows is cut into blocks of which every two meet, so one that holds a third of all rows spreads over tasks
    and loses no pair; the time for such a group grows with the square of its rows.
    Equal vectors are indexed once; their ids are each other's neighbours with similarity 1, smallest ids first.
    Neighbours below min_similarity are left out. Null ids, null vectors, other lengths, null, infinite or NaN
    elements and zero vectors take no part; an id delivered again counts once.
    """
    unit = unit_vectors(rows, id_col, vec_col, dim).withColumns({"v1": F.xxhash64("vec"), "v2": F.xxhash64(F.lit(7), "vec")})
    unit = materialize(unit.groupBy("v1", "v2", "id").agg(F.first("vec").alias("vec")))
    classes = unit.groupBy("v1", "v2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    copies = materialize(unit.select("v1", "v2", "id").join(classes.filter("n > 1"), ["v1", "v2"]).select("rep", "id"))
    singles = unit.join(copies.filter("id <> rep").select("id"), "id", "left_anti").select("id", "vec")
    n = singles.count()
    count = int(min(max_pivots, n, max(64, 2 ** round(math.log2(max(1.0, math.sqrt(n)))))))
    sample = singles.orderBy(F.xxhash64("id"), "id").limit(4 * count).collect()
    pivots = _apart(np.frombuffer(b"".join(r.vec for r in sample), np.float32).reshape(-1, dim), count)
    out = "id bigint, other bigint, similarity float"
    if not len(pivots):
        return singles.mapInArrow(lambda batches: iter(()), out)
    counts = singles.mapInArrow(_poster(pivots), "pivot int").groupBy("pivot").count().filter(F.col("count") > UNIT).collect()
    blocks = {r.pivot: math.ceil(r["count"] / (UNIT // 2)) for r in counts}
    posts = singles.mapInArrow(_poster(pivots, blocks), "key bigint, perm binary, id bigint, vec binary")
    near = posts.repartition("key").sortWithinPartitions("key").mapInArrow(_searcher(dim, k, min_similarity), out)
    near = _top(near.repartition("id").groupBy("id", "other").agg(F.max("similarity").alias("similarity")), k)
    return _with_copies(near, copies, k)


def _top(near: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def _with_copies(near: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Neighbours of representatives carried over to their copies; copies holds all ids of classes of two or more.

    Of a class at most its k + 1 smallest ids are offered as neighbours, more cannot be needed, so a class of a
    third of all rows adds k rows a member.
    """
    w = Window.partitionBy("rep").orderBy("id")
    offered = materialize(copies.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).select("rep", "id"))
    if offered.isEmpty():
        return near
    others = near.join(offered.select(F.col("rep").alias("other"), F.col("id").alias("copy")), "other", "left")
    others = _top(others.select("id", F.coalesce("copy", "other").alias("other"), "similarity"), k)
    twins = offered.select(F.col("rep").alias("id"), F.col("id").alias("other"), F.lit(1.0).cast("float").alias("similarity"))
    hubs = copies.select("rep").distinct()
    alone = others.join(hubs, others.id == hubs.rep, "left_anti")
    for_reps = others.join(hubs, others.id == hubs.rep, "left_semi").union(twins)
    carried = copies.join(for_reps.withColumnRenamed("id", "rep"), "rep").select("id", "other", "similarity").filter("id <> other")
    return alone.union(_top(carried, k))
