"""Exact top-k by cosine: a stated block of query vectors against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors sent to a task at most, rows of the corpus in a block, scores held at once.
BLOCK_BYTES = 8_000_000
BLOCK_ROWS = 65_536
CELLS = 2_000_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where a norm is 0 or a side is null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows at unit length; NaN where a row has no length or is not finite."""
    with np.errstate(all="ignore"):
        v = v / np.linalg.norm(v, axis=1)[:, None]
    v[~np.isfinite(v).all(axis=1)] = np.nan
    return v


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _keep_best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties by id, an id once a score."""
    order = np.lexsort((ids, -score, q))
    q, score, ids = q[order], score[order], ids[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])
    q, score, ids = q[new], score[new], ids[new]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[kept], score[kept], ids[kept]


def _compare(qid: np.ndarray, qv: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the query, score, id): of each query the k best of these rows."""
    if len(set(ids.tolist())) < len(ids):  # deliveries of one id with one vector are one row
        _, first = np.unique(np.rec.fromarrays([ids, [r.tobytes() for r in v]]), return_index=True)
        ids, v = ids[first], v[first]
    found = []
    step = max(1, CELLS // max(1, len(ids)))
    for at in range(0, len(qid), step):
        with np.errstate(all="ignore"):
            s = np.round(qv[at : at + step] @ v.T, 6)
        s[~np.isfinite(s)] = -9
        if exclude_self:
            s[qid[at : at + step, None] == ids[None, :]] = -9
        least = np.partition(s, -k, axis=1)[:, [-k]] if s.shape[1] > k else np.full((len(s), 1), -8.0)
        q, c = np.nonzero((s >= least) & (s > -8))
        found.append(_keep_best(q + at, s[q, c], ids[c], k))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))


def _scan(qid: np.ndarray, qv: np.ndarray, group: str | None, groups: pa.Array | None, dim: int, k: int, exclude_self: bool):
    """All rows of a task against one set of queries; a batch's rows meet the queries of their own group only."""
    of_query = np.zeros(len(qid), np.int64)
    names = None
    if group:
        names = groups.unique()
        of_query = pc.index_in(groups, names).to_numpy(zero_copy_only=False).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                v, ids = _unit(_matrix(b.column("v"), dim)), b.column("id").to_numpy()
                own = pc.fill_null(pc.index_in(b.column(group), names), -1).to_numpy(zero_copy_only=False) if group else np.zeros(len(ids), np.int64)
                for g in np.unique(own[own >= 0]):
                    mine, rows = np.flatnonzero(of_query == g), own == g
                    q, s, i = _compare(qid[mine], qv[mine], ids[rows], v[rows], k, exclude_self)
                    best = _keep_best(*(np.concatenate(x) for x in zip(best, (mine[q], s, i))), k)
        yield pa.record_batch([qid[best[0]], best[2], best[1]], names=["query_id", "id", "score"])

    return run


def top_k(
    corpus: DataFrame, queries: DataFrame, *, id_col: str, vec_col: str, query_id: str, query_vec: str, dim: int, k: int = 4, group: str | None = None, exclude_self: bool = False,
    block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, id, score, rank): the k rows of highest cosine for each query, ties by id; rank from 1.

    Only vectors of `dim` finite numbers with a norm take part. With `group`, a column of both sides, queries see their own
    group only, and a null group sees nothing. Queries that fit into block_bytes are sent to the tasks, which scan the corpus
    where it lies; more of them are cut into blocks of that size, and the rows into blocks of block_rows, which meet in the
    cluster, so that neither side is ever on the driver and a hot group spreads over tasks. Either way a task keeps k rows a
    query. Scores are rounded to six decimals before ranking. Sides that are dear to compute should be materialized: a side is read
    twice where the queries are many.
    """
    by = [group] if group else []
    q = queries.select(F.col(query_id).cast("bigint").alias("q"), F.col(query_vec).alias("v"), *by).filter(F.col("q").isNotNull() & (F.size("v") == dim))
    c = corpus.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v"), *by).filter(F.col("id").isNotNull() & (F.size("v") == dim))
    q, c = (side.filter(F.col(group).isNotNull()) if group else side for side in (q, c))
    out = "query_id bigint, id bigint, score double"
    fit = max(1, block_bytes // (8 * dim))
    few = q.limit(fit + 1).toArrow()
    if few.num_rows <= fit:
        scan = _scan(few.column("q").to_numpy(), _unit(_matrix(few.column("v"), dim)), group, few.column(group).combine_chunks() if group else None, dim, k, exclude_self)
        near = c.mapInArrow(scan, out)
    else:
        near = _blocks(q, c, group, fit, block_rows).applyInArrow(_cell(dim, k, exclude_self), out)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    # deliveries of one id that met different tasks share a rank
    ranked = near.withColumn("rank", F.dense_rank().over(w)).filter(F.col("rank") <= k)
    return ranked.groupBy("query_id", "id", "score", "rank").agg(F.lit(1).alias("_")).drop("_")


def _blocks(q: DataFrame, c: DataFrame, group: str | None, fit: int, block_rows: int):
    """Both sides cut into blocks within their group and each block posted to all blocks of the other side."""
    key = F.col(group) if group else F.lit(0)
    q, c = q.withColumn("_g", key), c.withColumn("_g", key)
    n_q = q.groupBy("_g").agg(F.ceil(F.count("*") / fit).cast("int").alias("_nq"))
    n_c = c.groupBy("_g").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_nc"))
    n = n_q.join(n_c, "_g")  # a row a group
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    q = q.join(n, "_g").select("_g", "q", "v", F.pmod(F.xxhash64("q"), F.col("_nq")).cast("int").alias("_q"), every("_nc").alias("_c"))
    c = c.join(n, "_g").select("_g", "id", "v", F.pmod(F.xxhash64("id"), F.col("_nc")).cast("int").alias("_c"), every("_nq").alias("_q"))
    return q.groupBy("_g", "_q", "_c").cogroup(c.groupBy("_g", "_q", "_c"))


def _cell(dim: int, k: int, exclude_self: bool):
    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        qid = q.column("q").to_numpy()
        found = _compare(qid, _unit(_matrix(q.column("v"), dim)), c.column("id").to_numpy(), _unit(_matrix(c.column("v"), dim)), k, exclude_self)
        return pa.table({"query_id": pa.array(qid[found[0]], pa.int64()), "id": pa.array(found[2], pa.int64()), "score": pa.array(found[1], pa.float64())})

    return run


def search_hits(ranked: DataFrame, chunks: DataFrame, id_col: str) -> DataFrame:
    """Ranked ids with the projected chunk fields."""
    fields = ["bylaw_id", "bylaw_title", "bylaw_number", "url", "city", "chunk_text"]
    hits = ranked.join(chunks.select(F.col(id_col).alias("id"), F.struct(*fields).alias("c")), "id")
    return hits.groupBy("query_id", "rank", "score", "id").agg(F.min("c").alias("c")).select("query_id", "rank", "score", "id", "c.*")
