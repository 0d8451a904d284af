"""The texts of scraped by-laws and of stored chunks as one table of items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.runtime import load


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_kind, item_id, text, title, number, city, bylaw_id) of `bylaws` and `bylaw_chunks`, null ids and texts left out."""
    laws = load(spark, sf_dir, "bylaws").select(
        F.lit("bylaw").alias("item_kind"), F.col("scrape_id").alias("item_id"), "text", "title", F.col("bylaw_number").alias("number"), "city", "bylaw_id"
    )
    chunks = load(spark, sf_dir, "bylaw_chunks").select(
        F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), F.col("chunk_text").alias("text"), F.col("bylaw_title").alias("title"), F.col("bylaw_number").alias("number"), "city", "bylaw_id"
    )
    return laws.union(chunks).filter("item_id is not null and text is not null")
