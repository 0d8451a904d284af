"""Reading tables, spreading small inputs and cutting lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only where all runs in one process (local mode: tests, one machine) a temporary folder stands in for a missing setting;
    on a cluster, whose machines do not share such a folder, that is an error.
    """
    path = spark.conf.get(CHECKPOINT_DIR, None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="clausewright-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set(CHECKPOINT_DIR, path)
    return path


#: Folders written for steps between, oldest first.
_written: list[str] = []


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the shared folder. It goes with release, or when the application ends; without a JVM at hand it stays."""
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    try:
        p, fs = _filesystem(spark, path)
        fs.deleteOnExit(p)
    except AttributeError:
        return path
    _written.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back.

    Cuts the lineage (lost executors cost no recomputation of earlier steps) and gives the planner the
    real size, by which it decides on broadcasts.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._folder = path
    return back


def discard(df: DataFrame) -> None:
    """Deletes the folder of a materialized table that nothing reads any more."""
    path = getattr(df, "_folder", None)
    if path in _written:
        _written.remove(path)
        p, fs = _filesystem(df.sparkSession, path)
        fs.delete(p, True)


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes what materialize has written, from the folder numbered `since` on (`written` gives the next number). Results that
    read these folders must have been used or stored before."""
    while len(_written) > since:
        p, fs = _filesystem(spark, _written.pop())
        fs.delete(p, True)


def written() -> int:
    return len(_written)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, plans that are run hand at most `rows` rows at once to Python; for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A scan in at least as many partitions as there are cores; one that has them stays as it is. Not for plans with
    shuffles, which asking for their partitions would run."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *[F.col(k) for k in keys]) if keys else df.repartition(cores)
