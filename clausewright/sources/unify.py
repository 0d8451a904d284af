"""One chunk schema over collections that name their fields differently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names under which collections hold a field, the preferred one first.
NAMES = {
    "bylaw_id": ("bylaw_id", "original_bylaw_id"),
    "title": ("bylaw_title", "title"),
    "url": ("url", "pdf_url"),
    "bylaw_number": ("bylaw_number",),
    "chunk_text": ("chunk_text",),
    "fetched_at": ("fetched_at",),
    "ingested_at": ("ingested_at",),
    "content_sha256": ("content_sha256",),
    "embedding_model": ("embedding_model",),
}
#: Fixed value: the collection whose vectors stand under the second of these names.
RENAMED_VECTORS = "bylaw_chunks"
VECTORS = ("chunk_embedding", "chunk_embedding_cpu")


def _any(rows: DataFrame, names: tuple[str, ...], kind: str) -> Column:
    have = [F.col(n) for n in names if n in rows.columns]
    return F.coalesce(*have) if have else F.lit(None).cast(kind)


def vector_column(collection: str) -> str:
    return VECTORS[1] if collection == RENAMED_VECTORS else VECTORS[0]


def unify(rows: DataFrame, collection: str) -> DataFrame:
    """rows in the one schema: 0-based chunk_index (from a 1-based chunk_sequence where that is what there is), the vector
    under `embedding`. Fields a collection lacks are null."""
    vector = vector_column(collection)
    vector = vector if vector in rows.columns else VECTORS[0]
    seq = (F.col("chunk_sequence") - 1) if "chunk_sequence" in rows.columns else F.lit(None).cast("int")
    index = F.coalesce("chunk_index", seq) if "chunk_index" in rows.columns else seq
    return rows.select(
        F.lit(collection).alias("collection"), _any(rows, ("city",), "string").alias("city"), *(_any(rows, n, "string").alias(c) for c, n in NAMES.items()),
        index.cast("int").alias("chunk_index"), _any(rows, (vector,), "array<float>").alias("embedding"), _any(rows, ("embedding_dim",), "int").alias("embedding_dim"),
    )


def legacy(chunks: DataFrame) -> DataFrame:
    """The unified schema under the names of a 1-based collection."""
    return chunks.select(F.col("bylaw_id").alias("original_bylaw_id"), "title", F.col("url").alias("pdf_url"), (F.col("chunk_index") + 1).alias("chunk_sequence"), "chunk_text", F.col("embedding").alias(VECTORS[1]))
