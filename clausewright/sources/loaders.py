"""Reading pages, files, PDFs, requests and logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright import schema
from clausewright.functions.text import file_stem, py_strip


# Fixed value: the city of a request that names none.
UNKNOWN_CITY = "Unknown City"


def _path() -> Column:
    """The file's path; the metadata hold it URL-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, html), one row a file; a folder that is missing or unreadable gives none."""
    try:
        return spark.read.text(path, wholetext=True).select(_path().alias("path"), F.col("value").alias("html"))
    except Exception:
        return spark.createDataFrame([], "path string, html string")


def _files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(path, content) of all files below root whose suffix matches without case."""
    pattern = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
        .select(_path().alias("path"), F.col("value").alias("content"))
    )


def text_documents(spark: SparkSession, root: str) -> DataFrame:
    """Base documents of the .txt files below root: title is the file's stem, url, number and date are null."""
    none = F.lit(None).cast("string")
    return _files(spark, root, "txt").select(file_stem("path").alias("title"), none.alias("url"), F.col("content").alias("text"), none.alias("bylaw_number"), none.alias("fetched_at"))


def json_fields(content: Column, stem: Column, url_field: str = "url") -> Column:
    """A base document from JSON text: a null or empty title becomes the stem, a missing text ''."""
    j = F.from_json(content, "title string, url string, pdf_url string, text string, bylaw_number string, fetched_at string")
    return F.struct(
        F.coalesce(F.nullif(j["title"], F.lit("")), stem).alias("title"), j[url_field].alias("url"), F.coalesce(j["text"], F.lit("")).alias("text"), j["bylaw_number"].alias("bylaw_number"), j["fetched_at"].alias("fetched_at")
    )


def json_documents(spark: SparkSession, root: str, url_field: str = "url") -> DataFrame:
    """Base documents of the .json files below root, one object a file."""
    return _files(spark, root, "json").select(json_fields(F.col("content"), file_stem("path"), url_field).alias("d")).select("d.*")


def fetched(urls: DataFrame, url: str, fetch: Callable[[str], tuple[int, bytes]]) -> DataFrame:
    """(url, http_status, content, error) by a pluggable fetcher that returns status and body.

    Only the fetcher knows the network; errors and statuses of 400 and over become rows with null content. Each distinct
    url is fetched once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for u in b["url"]:
                try:
                    status, body = fetch(u)
                    rows.append((u, status, body if status < 400 else None, None if status < 400 else f"status {status}"))
                except Exception as e:
                    rows.append((u, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["url", "http_status", "content", "error"]).astype({"http_status": "Int32"})

    return urls.select(F.col(url).alias("url")).filter("url is not null").distinct().mapInPandas(run, "url string, http_status int, content binary, error string")


PDF_POLICIES = ("skip_page", "plain", "line_per_page")


def pdf_text(content: Column, pages: Callable[[bytes], Iterator[str | None]], policy: str = "skip_page") -> Column:
    """The text of PDF bytes by a pluggable page reader.

    skip_page: pages joined with nothing between, unreadable pages left out, null if blank. plain: null pages count as
    empty, any error gives ''. line_per_page: a line end after each page, stripped; an error keeps what was read.
    """
    if policy not in PDF_POLICIES:
        raise ValueError(f"policy is one of {PDF_POLICIES}")

    def one(data: bytes | None) -> str | None:
        got: list[str] = []
        try:
            reader = iter(pages(data))
            while True:
                try:
                    page = next(reader)
                except StopIteration:
                    break
                except Exception:
                    if policy == "skip_page":
                        continue
                    raise
                got.append(page or "")
        except Exception:
            if policy == "plain":
                return ""
        if policy == "line_per_page":
            return "".join(p + "\n" for p in got).strip()
        text = "".join(got)
        return (text if text.strip() else None) if policy == "skip_page" else text

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(content)


def decode_requests(bodies: DataFrame, body: str) -> DataFrame:
    """bodies with query (stripped, '' if missing), city, conversation_context ([] if missing), timestamp and is_json from JSON."""
    j = F.from_json(F.col(body), schema.REQUEST)
    return bodies.withColumn("_j", j).select(
        *[c for c in bodies.columns if c != body], py_strip(F.coalesce("_j.query", F.lit(""))).alias("query"), F.coalesce("_j.city", F.lit(UNKNOWN_CITY)).alias("city"),
        F.coalesce("_j.conversation_context", F.array().cast(f"array<{schema.MESSAGE}>")).alias("conversation_context"), F.col("_j.timestamp").alias("timestamp"),
        F.coalesce(F.get_json_object(body, "$").startswith("{"), F.lit(False)).alias("is_json"),
    )


def decode_responses(bodies: DataFrame, body: str, default: str = "No answer.") -> DataFrame:
    """bodies with ai_response (a default for null) and the sources that are objects."""
    j = F.from_json(F.col(body), schema.RESPONSE)
    return bodies.withColumn("_j", j).select(
        *[c for c in bodies.columns if c != body], F.coalesce("_j.ai_response", F.lit(default)).alias("ai_response"), F.filter("_j.retrieved_sources", lambda s: s.isNotNull()).alias("retrieved_sources")
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """JSONL log lines of both shapes; broken lines become rows of nulls."""
    return spark.read.schema(schema.LOG).option("mode", "PERMISSIVE").json(path)

