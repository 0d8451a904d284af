"""The chunk store: snapshots written whole, read back, never overwritten while read."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions.text import default_if_empty, slug_filename

KEY = ["bylaw_id", "chunk_index", "content_sha256"]


def latest_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in the order given. Null keys equal each other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str] | None = None, order: list[Column] | None = None, purge_stale: str | None = None) -> DataFrame:
    """The next snapshot: rows of new replace those of old with the same key; other rows of old stay.

    The default key holds the content's hash, so an edited text adds a row and the old one stays. Of several new rows of a key
    the first in `order` counts. purge_stale names a column (say bylaw_id) of whose values in new all old rows go.
    """
    keys = keys or KEY
    new = latest_by(new, keys, order or [F.lit(1)])
    if purge_stale:
        kept = old.join(new.select(purge_stale).distinct(), purge_stale, "left_anti")
    else:
        match = [old[k].eqNullSafe(new[k]) for k in keys]
        cond = match[0]
        for m in match[1:]:
            cond = cond & m
        kept = old.join(new, cond, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insertion without a key: a second run adds its rows again."""
    return old.unionByName(new, allowMissingColumns=True)


def update_column(rows: DataFrame, key: str, new: DataFrame, column: str) -> DataFrame:
    """rows with the column from new where new has the key and a value; other rows keep theirs. Of several new values of a key the largest counts."""
    fresh = new.filter(F.col(column).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(column).alias("_v"))
    return rows.join(fresh, rows[key] == fresh["_k"], "left").withColumn(column, F.coalesce("_v", column)).drop("_k", "_v")


def duplicate_keys(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keys held by more than one row: what a unique index would refuse."""
    return rows.groupBy(*(keys or KEY)).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def files_by_slug(rows: DataFrame, title: str, pos: str) -> DataFrame:
    """rows that remain as files named by the title's slug: of one slug the last by position. A null or empty title is `untitled_bylaw`."""
    named = rows.withColumn("slug", slug_filename(default_if_empty(title, "untitled_bylaw")))
    return latest_by(named, ["slug"], [F.desc(pos)])


def detect_changes(old: DataFrame, new: DataFrame, key: str | list[str] = "url", hash_col: str = "hash") -> DataFrame:
    """(key, state, changed) over both: new (no earlier hash), changed, unchanged, missing (no page now)."""
    keys = [key] if isinstance(key, str) else key
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    o = old.filter(known).groupBy(*keys).agg(F.max(hash_col).alias("before"))
    n = new.filter(known).groupBy(*keys).agg(F.max(hash_col).alias("now"), F.lit(True).alias("here"))
    state = F.when(F.col("here").isNull(), "missing").when(F.col("before").isNull(), "new").when(F.col("before").eqNullSafe(F.col("now")), "unchanged").otherwise("changed")
    return o.join(n, keys, "full").select(*keys, state.alias("state"), (state != "unchanged").alias("changed"))


def detect_all_changes(rows: DataFrame, snapshot: str = "snapshot_no", key: str = "url", hash_col: str = "hash") -> DataFrame:
    """(snapshot, key, state, changed): detect_changes of every snapshot but the first against the one before it that is there. Rows without a number take no part."""
    w = Window.orderBy(snapshot)  # a row a snapshot
    numbers = rows.select(snapshot).filter(F.col(snapshot).isNotNull()).distinct().select(snapshot, F.lead(snapshot).over(w).alias("_next"), F.lag(snapshot).over(w).alias("_last"))
    s = rows.select(snapshot, key, hash_col).join(numbers, snapshot)
    old = s.filter("_next is not null").select(F.col("_next").alias(snapshot), key, hash_col)
    return detect_changes(old, s.filter("_last is not null"), [snapshot, key], hash_col)


def _paths(spark, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    at, new, old = (hadoop(path.rstrip("/") + end) for end in ("", ".next", ".last"))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at, new, old


def recover(spark, path: str) -> None:
    """After a swap that broke off: the snapshot before it is put back where none stands at path."""
    fs, at, _, old = _paths(spark, path)
    if not fs.exists(at) and fs.exists(old):
        fs.rename(old, at)


def swap(df: DataFrame, path: str) -> DataFrame:
    """df as the new snapshot at path, which df itself may read.

    It is written beside the old one in full; two renames then put it in the old one's place. A failure leaves the old
    snapshot at path or beside it, from where `recover`, which every swap begins with, brings it back.
    """
    spark = df.sparkSession
    recover(spark, path)
    fs, at, new, old = _paths(spark, path)
    df.write.mode("overwrite").parquet(new.toString())
    fs.delete(old, True)
    if fs.exists(at) and not fs.rename(at, old) or not fs.rename(new, at):
        raise OSError(f"the new snapshot stays in {new.toString()}")
    fs.delete(old, True)
    return spark.read.schema(df.schema).parquet(path)


def write_files(rows: DataFrame, path: str, name: Column, body: Column) -> None:
    """A file of each row at path, which is replaced if it is there; rows without a name or body give none. Names must be distinct.

    Executors write through the file system of path, each file under another name first.
    """
    records = rows.select(name.alias("name"), body.alias("body")).filter("name is not null and body is not null")
    folder = path.removeprefix("file://").removeprefix("file:")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        where.create_dir(root, recursive=True)
        for b in parts:
            for to, text in zip(b["name"], b["body"]):
                aside = f"{root}/.{uuid.uuid4().hex}"
                with where.open_output_stream(aside) as f:
                    f.write(text.encode())
                where.move(aside, f"{root}/{to}")
            yield b[["name"]]

    records.mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()


def write_json_files(rows: DataFrame, path: str, slug: str = "slug") -> None:
    """One file <slug>.json with the record, all its fields, for each slug; rows without a slug are left out. Slugs must be distinct (files_by_slug)."""
    record = F.to_json(F.struct(*[c for c in rows.columns if c != slug]), {"ignoreNullFields": "false", "pretty": "true"})
    write_files(rows, path, F.concat(F.col(slug), F.lit(".json")), record)


def append_jsonl(rows: DataFrame, path: str) -> None:
    """One object a line, non-ASCII kept."""
    rows.write.mode("append").option("ignoreNullFields", False).json(path)


def csv_sheet(path: str) -> Callable[[DataFrame], None]:
    """A sheet kept as CSV files."""
    return lambda rows: rows.write.mode("append").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def append_log_rows(rows: DataFrame, sheet: Callable[[DataFrame], None]) -> str | None:
    """Appends the log rows (timestamp, query, response, other_logs; '' for what is null or missing) by a pluggable sheet writer. Its
    error does not stop the caller: it is returned as text, null if all went well."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in ("timestamp", "query", "response", "other_logs")]
    try:
        sheet(rows.select(*fields))
    except Exception as e:
        return str(e)
    return None


def notify(subject: str, body: str, send, fallback: str) -> bool:
    """Sends by a pluggable sender; without one, or where it fails, the message goes to a local text file. Runs on the driver."""
    try:
        if send is not None:
            send(subject, body)
            return True
    except Exception:
        pass
    with open(fallback, "a", encoding="utf-8") as f:
        f.write(f"{subject}\n{body}\n---\n")
    return False
