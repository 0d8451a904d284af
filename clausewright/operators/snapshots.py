"""What changed between consecutive full snapshots of a table of pages (problem 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.runtime import materialize

BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
BUCKET_BITS = 40


def canonical_url(url: Column) -> Column:
    """Lower case, https, without www., query, fragment and closing slash; null for a blank."""
    u = F.lower(F.trim(url))
    u = F.regexp_replace(u, r"[?#].*$", "")
    u = F.regexp_replace(u, r"^(?:https?:)?//", "")
    u = F.regexp_replace(F.regexp_replace(u, r"^www\.", ""), r"/+$", "")
    return F.when(u != "", F.concat(F.lit("https://"), u))


def latest_pages(rows: DataFrame) -> DataFrame:
    """(snapshot_no, url, hash) with one row per page and snapshot: the latest fetched, as an instant.

    Unreadable instants come before all others; among equal instants a row with a hash wins, then the larger
    hash. Rows without a url or a snapshot number are left out. A blank hash is null.
    """
    h = F.lower(F.trim("content_sha256"))
    return (
        rows.select("snapshot_no", canonical_url(F.col("url")).alias("url"), F.try_to_timestamp("fetched_at").alias("at"), F.when(h != "", h).alias("hash"))
        .filter("snapshot_no is not null and url is not null")
        .groupBy("snapshot_no", "url")
        .agg(F.max(F.struct("at", "hash")).alias("last"))
        .select("snapshot_no", "url", "last.hash")
    )


def assign_ordinals(keys: DataFrame, key: str, known: DataFrame | None = None, per_bucket: int = 1_000_000) -> DataFrame:
    """(key, ordinal): a persistent number for every distinct non-null key.

    Keys in `known` keep their ordinals; new ones are numbered behind them. Numbers are dense within a hash
    bucket, and the number of buckets follows the number of keys, so no task numbers more than about per_bucket.
    """
    new = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    top = None
    if known is not None:
        known = known.select(key, "ordinal")
        new = new.join(known, key, "left_anti")
        top = known.groupBy(F.shiftright("ordinal", BUCKET_BITS).alias("bucket")).agg((F.max("ordinal") % (1 << BUCKET_BITS) + 1).alias("base"))
    new = materialize(new)
    buckets = max(16, new.count() // per_bucket)
    new = new.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    new = new.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy(key)) - 1)
    if known is None:
        return new.select(key, (F.col("bucket") * (1 << BUCKET_BITS) + F.col("k")).alias("ordinal"))
    new = new.join(top, "bucket", "left")
    numbered = new.select(key, (F.col("bucket") * (1 << BUCKET_BITS) + F.coalesce("base", F.lit(0)) + F.col("k")).alias("ordinal"))
    return known.union(numbered)


def stored_ordinals(keys: DataFrame, key: str, path: str) -> DataFrame:
    """(key, ordinal) of all keys ever given with this path: the table there gains rows for the keys it lacks, none is changed."""
    spark = keys.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = spark.read.parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None
    numbered = assign_ordinals(keys, key, known)
    if known is not None:
        numbered = numbered.join(known.select(key), key, "left_anti")
    numbered.write.mode("append").parquet(path)
    return spark.read.parquet(path)


class Bitmap:
    """A set of positions within a block: sorted numbers while it is sparse, packed bits otherwise."""

    def __init__(self, places: np.ndarray):
        self.sparse = len(places) * 16 <= BLOCK
        self.data = places.astype(np.uint16) if self.sparse else np.packbits(np.bincount(places, minlength=BLOCK).astype(bool))

    def places(self) -> np.ndarray:
        return self.data.astype(np.int64) if self.sparse else np.flatnonzero(np.unpackbits(self.data))

    def has(self, places: np.ndarray) -> np.ndarray:
        if self.sparse:
            at = np.minimum(np.searchsorted(self.data, places), max(0, len(self.data) - 1))
            return self.data[at] == places if len(self.data) else np.zeros(len(places), bool)
        return (self.data[places >> 3] >> (7 - (places & 7)) & 1).astype(bool)

    def and_not(self, other: "Bitmap") -> np.ndarray:
        if not (self.sparse or other.sparse):
            return np.flatnonzero(np.unpackbits(self.data & ~other.data))
        mine = self.places()
        return mine[~other.has(mine)]

    def both(self, other: "Bitmap") -> np.ndarray:
        if not (self.sparse or other.sparse):
            return np.flatnonzero(np.unpackbits(self.data & other.data))
        few, many = (self, other) if self.sparse else (other, self)
        mine = few.places()
        return mine[many.has(mine)]


def _diff(numbers: list[int]):
    """numbers: the snapshots there are, in order."""
    codes = np.array(["added", "removed", "changed"], object)

    def block(t: pa.Table) -> pa.Table:
        snap, pos, hashes = t.column("snapshot_no").to_numpy(), t.column("pos").to_numpy(), np.array(t.column("hash").to_pylist(), object)
        order = np.lexsort((pos, snap))
        snap, pos, hashes = snap[order], pos[order], hashes[order]
        last = np.full(BLOCK, None, object)  # the last hash of each ordinal
        before = None
        out: list[tuple[np.ndarray, int, int]] = []
        for n in numbers:
            lo, hi = np.searchsorted(snap, [n, n + 1])
            now, new = Bitmap(pos[lo:hi]), last.copy()
            told = ~np.equal(hashes[lo:hi], None)
            new[pos[lo:hi][told]] = hashes[lo:hi][told]
            if before is not None:
                stay = now.both(before)
                moved = stay[(new[stay] != last[stay]) & ~np.equal(last[stay], None)]
                out += [(hit, n, code) for code, hit in enumerate((now.and_not(before), before.and_not(now), moved)) if len(hit)]
            before, last = now, new
        base = int(t.column("block")[0].as_py()) << BLOCK_BITS
        sizes = [len(p) for p, _, _ in out]
        where = np.concatenate([p for p, _, _ in out]) if out else np.zeros(0, np.int64)
        return pa.table(
            {
                "snapshot_no": pa.array(np.repeat([n for _, n, _ in out], sizes).astype(np.int32), pa.int32()),
                "ordinal": pa.array(where + base, pa.int64()),
                "change": pa.array(codes[np.repeat([c for _, _, c in out], sizes).astype(int)].tolist(), pa.string()),
            }
        )

    return block


def snapshot_changes(rows: DataFrame, ordinals_path: str | None = None) -> DataFrame:
    """(snapshot_no, url, change) for every snapshot after the first against the one before it that is there.

    Pages become ordinals, which persist in the table at ordinals_path if that is given. Per block of 4,096 ordinals each
    snapshot is a compressed bitmap (blocks without a page are not stored), AND-NOT of neighbouring bitmaps gives `added` and
    `removed`, and the blocks' hash vectors give `changed`. A page without a hash keeps the last one it had; a page that
    never had one is not `changed` by its first. A page that is back after an absence is `added`. Snapshots may be numbered with
    gaps. A task holds two snapshots of a block at once beside the block's rows, however the pages are skewed. No rows
    give no changes.
    """
    pages = materialize(latest_pages(rows))
    numbers = sorted(r[0] for r in pages.select("snapshot_no").distinct().collect())  # a number a snapshot
    ordinals = materialize(assign_ordinals(pages, "url")) if ordinals_path is None else stored_ordinals(pages, "url", ordinals_path)
    placed = pages.join(ordinals, "url").select(
        "snapshot_no", "hash", F.shiftright("ordinal", BLOCK_BITS).alias("block"), (F.col("ordinal") % BLOCK).cast("int").alias("pos")
    )
    found = placed.groupBy("block").applyInArrow(_diff(numbers), "snapshot_no int, ordinal bigint, change string")
    return found.join(ordinals, "ordinal").select("snapshot_no", "url", "change")
