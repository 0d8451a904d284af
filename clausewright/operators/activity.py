"""Looking at the query log: repeats within seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeats_within(log: DataFrame, keys: list[str], at: str, seconds: int) -> DataFrame:
    """Rows whose keys have an earlier row less than `seconds` before.

    Times are cut into buckets of that length and each bucket reduced to its first and last time, so that a hot key
    costs a row a bucket. Null keys and times have no repeats.
    """
    ms = F.unix_millis(F.col(at))
    width = seconds * 1000
    rows = log.withColumns({"_t": ms, "_b": F.floor(ms / width)})
    ends = rows.groupBy(*keys, "_b").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    own = ends.select(*keys, "_b", "_first")
    before = ends.select(*keys, (F.col("_b") + 1).alias("_b"), F.col("_last").alias("_before"))
    rows = rows.join(own, [*keys, "_b"]).join(before, [*keys, "_b"], "left")
    return rows.filter((F.col("_t") > F.col("_first")) | (F.col("_t") - F.col("_before") < width)).select(*log.columns)
