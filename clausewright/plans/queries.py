"""The named queries over the reference's own operators, and the general problems'."""

from __future__ import annotations

from dataclasses import fields

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewright import config
from clausewright.functions import text as T
from clausewright.operators import activity, answer, chunking, embedding, html, search, snapshots
from clausewright.plans.sql import SQL  # noqa: F401
from clausewright.runtime import load, materialize, new_folder, spread
from clausewright.sources import loaders, store, unify
from clausewright.streaming import log as stream

BASE = "https://bylaws.example"
TODAY = "2024-06-01"


# --- search ---------------------------------------------------------------------------------------------------------


def _nearest(spark: SparkSession, d: str, which: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    ranked = search.top_k(spread(e), e.filter(which), id_col="vec_id", vec_col="embedding", query_id="vec_id", query_vec="embedding", dim=64, k=4, exclude_self=True)
    return ranked.join(e.select(F.col("vec_id").alias("id"), "label"), "id").select("query_id", F.col("id").alias("vec_id"), "label", "score", "rank")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, "vec_id = 0")


def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, "vec_id % 50 = 0")


def vector_topk_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every vector as a query against those of its label, the many queries in blocks that meet blocks of the rows."""
    e = load(spark, d, "embeddings")
    ranked = search.top_k(e, e, id_col="vec_id", vec_col="embedding", query_id="vec_id", query_vec="embedding", dim=64, k=4, group="label", exclude_self=True, block_bytes=64 * 512, block_rows=100)
    return ranked.select("query_id", F.col("id").alias("vec_id"), "score", "rank")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk whose id is divisible by 50 as query against all chunks of its city."""
    c = load(spark, d, "bylaw_chunks")
    v = c.select("chunk_id", "chunk_embedding", F.lower(F.trim("city")).alias("place")).filter("place <> ''")
    ranked = search.top_k(spread(v), v.filter("chunk_id % 50 = 0").dropDuplicates(["chunk_id"]), id_col="chunk_id", vec_col="chunk_embedding", query_id="chunk_id", query_vec="chunk_embedding", dim=64, k=4, group="place", exclude_self=True)
    return search.search_hits(ranked, c, "chunk_id")


def vector_topk_by_collection(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("query_id", "rank", "score", F.col("id").alias("chunk_id"), "bylaw_id", "bylaw_title", "bylaw_number", "url")


def cosine_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every vector's cosine with the mean direction of its label's first vector."""
    e = load(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    return e.join(first, "label").select("vec_id", F.round(search.cosine(F.col("embedding"), F.col("anchor")), 6).alias("score"))


# --- requests -------------------------------------------------------------------------------------------------------


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The log, each id once: deliveries of an id differ in received_at only."""
    log = load(spark, d, "query_log")
    return store.latest_by(log.filter("log_id is not null"), ["log_id"], [F.desc("received_at")])


def city_routing(spark: SparkSession, d: str) -> DataFrame:
    return answer.route_city(_log(spark, d), load(spark, d, "city_registry")).select("log_id", "city", "collection")


def request_validation(spark: SparkSession, d: str) -> DataFrame:
    return answer.validate(answer.route_city(_log(spark, d), load(spark, d, "city_registry"))).select("log_id", "error")


def request_decode(spark: SparkSession, d: str) -> DataFrame:
    """Request bodies as they come in; an answered question brings the turn before it along."""
    turn = lambda me, c: F.struct(F.lit(me).alias("fromMe"), F.col(c).alias("text"), F.col("logged_at").alias("timestamp"))
    turns = F.when(F.col("ai_response").isNotNull(), F.array(turn(True, "query"), turn(False, "ai_response")))
    bodies = _log(spark, d).select("log_id", F.to_json(F.struct("query", "city", turns.alias("conversation_context"), F.col("logged_at").alias("timestamp"))).alias("body"))
    got = loaders.decode_requests(bodies, "body")
    return got.select("log_id", "query", "city", F.size("conversation_context").alias("n_messages"), answer.history_text(F.col("conversation_context")).alias("history"), "timestamp")


def response_decode(spark: SparkSession, d: str) -> DataFrame:
    bodies = _log(spark, d).select("log_id", F.to_json(F.struct("ai_response", "retrieved_sources")).alias("body"))
    return loaders.decode_responses(bodies, "body").select("log_id", "ai_response", F.coalesce(F.size("retrieved_sources"), F.lit(0)).alias("n_sources"))


def city_requests(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select("log_id", answer.city_request_body(F.col("city"), F.col("ai_error"), F.col("message")).alias("body"))


def feedback(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select("log_id", answer.feedback_body(F.col("message"), F.col("ai_error")).alias("body"))


def input_caps(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select("log_id", T.cap("query", 50).alias("query_50"), T.cap("ai_response", 500).alias("response_500"), T.cap("ai_response", 200).alias("response_200"))


# --- text -----------------------------------------------------------------------------------------------------------


def slug_filename(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "bylaws").select("title", T.slug_filename("title").alias("slug")).distinct()


def slug_id(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "bylaws").select("title", T.slug_id("title").alias("slug")).distinct()


def bylaw_id(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "chapter_index").select("bylaw_id", T.stable_bylaw_id("city", "bylaw_number", "title").alias("stable_id"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "bylaws").select("scrape_id", T.content_hash("text").alias("text_hash")).distinct()


def nonblank_filter(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "bylaw_chunks").filter(T.non_blank("chunk_text")).select("chunk_id").distinct()


def whitespace_normalize(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "bylaws").select("scrape_id", T.normalize_whitespace("text").alias("text")).distinct()


def newline_collapse(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "bylaws").select("scrape_id", T.collapse_newlines(T.normalize_whitespace("text")).alias("text")).distinct()


def paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "documents").select("doc_id", F.posexplode(T.split_paragraphs("text")).alias("pos", "paragraph"))
    return p


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.posexplode(T.split_sentences("text")).alias("pos", "sentence"))


def year_number(spark: SparkSession, d: str) -> DataFrame:
    around = F.concat(F.col("title"), F.lit(" ("), F.substring("bylaw_number", 1, 4), F.lit(") - "), F.substring("bylaw_number", 6, 10))
    return load(spark, d, "chapter_index").select("bylaw_id", T.bylaw_year(around).alias("year"), T.bylaw_number(around).alias("number"))


def lenient_dates(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "bylaws").select("scrape_id", T.date_or_raw("last_passed").alias("passed"), T.date_or_raw("last_amended").alias("amended")).distinct()


def url_join(spark: SparkSession, d: str) -> DataFrame:
    links = load(spark, d, "chapter_index").select("bylaw_id", F.explode(F.array("pdf_url", F.concat(F.lit("/files/"), T.slug_id("title"), F.lit(".pdf")), F.concat(F.lit("files/"), T.slug_id("title")))).alias("href"))
    return links.select("bylaw_id", "href", T.url_join("href", BASE + "/index/list.htm").alias("url")).distinct()


# --- chunks ---------------------------------------------------------------------------------------------------------


def _fixed(spark: SparkSession, d: str, overlap: int, first: int = 0) -> DataFrame:
    return chunking.explode_chunks(load(spark, d, "documents"), chunking.fixed_chunks(F.col("text"), 1000, overlap), ["doc_id", "source"], first)


def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _fixed(spark, d, 100).select("doc_id", "chunk_index", "chunk_text")


def chunk_sequence(spark: SparkSession, d: str) -> DataFrame:
    c = _fixed(spark, d, 100, 1)
    return c.select("doc_id", F.col("chunk_index").alias("chunk_sequence"), T.content_hash("chunk_text").alias("content_sha256"))


def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    return chunking.with_overlap(_fixed(spark, d, 0), "doc_id", 150).select("doc_id", "chunk_index", "chunk_text")


def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return _fixed(spark, d, 100).groupBy("source").agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"))


def packed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.with_overlap(_packed(spark, d), "scrape_id", 150)


def _packed(spark: SparkSession, d: str) -> DataFrame:
    laws = store.latest_by(load(spark, d, "bylaws").filter("scrape_id is not null"), ["scrape_id"], [F.desc("fetched_at")])
    return chunking.explode_chunks(laws.select("scrape_id", "text"), chunking.packed_chunks(F.col("text")), ["scrape_id"])


def packed_cover(spark: SparkSession, d: str) -> DataFrame:
    """What the packed chunks of a by-law hold together, without white space: the text, nothing lost and nothing twice."""
    chunks = _packed(spark, d).groupBy("scrape_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))).alias("c"))  # the chunks of one text
    body = F.regexp_replace(F.array_join(F.transform("c", lambda x: x["chunk_text"]), ""), rf"{T.SPACE}+", "")
    last = F.element_at("c", -1)["chunk_index"]
    return chunks.select("scrape_id", F.md5(body).alias("text_md5"), (last + 1 == F.size("c")).alias("numbered"), F.exists("c", lambda x: T.py_strip(x["chunk_text"]) == "").alias("has_blank"))


# --- pages ----------------------------------------------------------------------------------------------------------


def _listing(css: Column | str, rows: list) -> Column:
    """A table of rows (id, title, link) with unclosed cells."""
    css = F.lit(css) if isinstance(css, str) else css
    cells = [F.concat(F.lit('<tr><td class="s2"><a href="'), F.coalesce(link, F.lit("")), F.lit('"> '), key, F.lit("</a></td></td><td>"), F.coalesce(title, F.lit("")), F.lit("<td>amended <a href='x.pdf'>x</a></tr>")) for key, title, link in rows]
    return F.concat(F.lit('<table class="'), css, F.lit('"><tr><th>Chapter<th>Title</tr>'), *cells, F.lit("</table>"))


def chapter_table(spark: SparkSession, d: str) -> DataFrame:
    """The chapter index from listing pages with unclosed cells, one page an entry."""
    c = load(spark, d, "chapter_index")
    page = F.concat(F.lit("<html><body>"), _listing("wide bylawDefault", [(F.col("bylaw_id"), F.col("title"), F.col("pdf_url"))]), F.lit("</body></html>"))
    pages = c.select(F.col("bylaw_id").alias("page"), page.alias("html"))
    return html.chapter_index(html.html_rows(spread(pages), "html"), ["page"], BASE).select("bylaw_id", "title", "pdf_url")


def chapter_tables(spark: SparkSession, d: str) -> DataFrame:
    """Pages of several tables, of which the first is no listing; where the number is unknown none is, and the page gives nothing."""
    c, col = load(spark, d, "chapter_index"), F.col
    entry = lambda mark: (F.concat("bylaw_id", F.lit(mark)), col("title"), col("pdf_url"))
    css = F.when(col("bylaw_number").isNull(), "plain").otherwise("bylawDefault wide")
    page = F.concat(F.lit("<html><body>"), _listing("other", [entry(" X")]), _listing(css, [entry(""), entry(" B")]), F.lit("<p>between</p>"), _listing(css, [entry(" C")]), F.lit("</body></html>"))
    found = html.html_rows(spread(c.select(col("bylaw_id").alias("page"), page.alias("html"))), "html")
    return html.chapter_index(found, ["page"], BASE).select("page", "bylaw_id", "title", "pdf_url", "pos")


def _linked(spark: SparkSession, d: str, scoped: bool = False) -> DataFrame:
    slug = F.regexp_replace("bylaw_id", ".*::", "")
    body = [
        '<a href="mailto:clerk@city.example">m</a><a href="tel:1">t</a><div id="printAreaContent"><a href="/', slug, '-bylaw.aspx">a</a> <b><a href="', slug, '-bylaw.aspx">b</a></b><a href="https://x.example/',
        slug, '-bylaw.aspx">c</a><a href="/', slug, '-BYLAW.ASPX">d</a><a href="/wp-content/uploads/', slug, '.PDF">e</a><a href="/', slug, '-bylaw.aspx">again</a></div>',
    ]
    pages = load(spark, d, "chapter_index").select("bylaw_id", F.concat(*(F.lit(x) if isinstance(x, str) else x for x in body)).alias("html"))
    return html.html_links(spread(pages), "html", scoped)


def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links to by-law pages, absolute, each once a page at its first place."""
    found = _linked(spark, d).filter(html.is_page_link(F.col("href"))).select("bylaw_id", "pos", T.page_link("href", BASE).alias("url"))
    return html.first_seen(found, "url", "pos", ["bylaw_id"])


def scoped_links(spark: SparkSession, d: str) -> DataFrame:
    """Links within the page's main part only, with the text around them."""
    return _linked(spark, d, True).select("bylaw_id", "pos", "text", "around")


def first_pdf(spark: SparkSession, d: str) -> DataFrame:
    """The first upload PDF of each page under the three ways of making it absolute."""
    pdf = _linked(spark, d).filter(html.is_upload_link(F.col("href"))).groupBy("bylaw_id").agg(F.min_by("href", "pos").alias("href"))
    return pdf.select("bylaw_id", T.pdf_link("href", BASE).alias("pdf_url"), T.plain_link("href", BASE).alias("plain_url"))


def page_meta(spark: SparkSession, d: str) -> DataFrame:
    p = lambda label, c: F.coalesce(F.concat(F.lit(f'<p class="x IntroParagraph">{label} '), F.col(c), F.lit("</p>")), F.lit(""))
    page = F.concat(F.lit("<h1> <b>By-law</b> page</h1>"), p("Bylaw number:", "bylaw_number"), p("Last passed by council:", "last_passed"))
    meta = html.html_meta(load(spark, d, "bylaws").select("scrape_id", page.alias("html")), "html")
    meta = meta.withColumns({"n": F.size("meta.intro")})
    number = F.when(F.col("n") > 0, F.try_element_at(F.filter(F.transform("meta.intro", T.labelled_number), lambda x: x.isNotNull()), F.lit(-1)))
    passed = F.when(F.col("n") > 0, F.try_element_at(F.filter(F.transform("meta.intro", T.labelled_passed), lambda x: x.isNotNull()), F.lit(-1)))
    return meta.select("scrape_id", F.col("meta.h1").alias("h1"), number.alias("number"), T.py_strip(passed).alias("passed_raw")).distinct()


def html_text(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: html.escape(F.coalesce(c, F.lit("")))
    page = F.concat(F.lit("<nav>menu</nav><main><h1>"), text("bylaw_title"), F.lit("</h1><script>x()</script><p>"), F.regexp_replace(text("chunk_text"), "\n", "</p><p>"), F.lit("</p></main>"))
    return html.html_text(spread(load(spark, d, "bylaw_chunks").select("chunk_id", page.alias("html"))), "html").distinct()


def links_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Chapters distinct by title, the first in the index kept."""
    c = load(spark, d, "chapter_index").withColumn("at", F.struct("pos", "bylaw_id"))
    return html.first_seen(c, "title", "at").select("title", "bylaw_id")


# --- store ----------------------------------------------------------------------------------------------------------


def json_loader(spark: SparkSession, d: str) -> DataFrame:
    laws = load(spark, d, "bylaws").select("scrape_id", F.to_json(F.struct("title", "url", "text", "bylaw_number", "fetched_at")).alias("body"))
    return laws.select("scrape_id", loaders.json_fields(F.col("body"), F.concat(F.lit("file"), "scrape_id")).alias("j")).select("scrape_id", "j.*").distinct()


def exists_scan(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "bylaw_chunks").filter("chunk_text is not null").agg(F.count("*").alias("n"))


def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "bylaw_chunks").groupBy(F.lower(F.trim("city")).alias("place"))
    return c.agg(F.count("*").alias("n_rows"), F.countDistinct("bylaw_id").alias("n_bylaws"), F.countDistinct("chunk_id").alias("n_chunks"))


def missing_embedding(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "bylaw_chunks").filter("chunk_embedding is null").select("chunk_id").distinct()


def chunk_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The store holds the first delivery of every chunk; the later ones are upserted into it, the latest ingested of a key last."""
    c = load(spark, d, "bylaw_chunks").select("chunk_id", *store.KEY, "ingested_at")
    latest = [F.desc_nulls_last(F.try_to_timestamp("ingested_at")), F.desc_nulls_last("ingested_at"), F.asc("chunk_id")]
    numbered = c.withColumn("n", F.row_number().over(Window.partitionBy(*store.KEY).orderBy(*latest))).withColumn("of", F.count("*").over(Window.partitionBy(*store.KEY)))
    filled = materialize(numbered.filter("n = of").drop("n", "of"))
    return store.upsert(filled, numbered.filter("n < of").drop("n", "of"), order=latest)


def unified_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = unify.unify(load(spark, d, "bylaw_chunks"), "bylaw_chunks")
    return c.select("collection", "bylaw_id", "title", "url", "chunk_index", F.size("embedding").alias("dim")).distinct()


def legacy_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = unify.legacy(unify.unify(load(spark, d, "bylaw_chunks"), "bylaw_chunks"))
    back = unify.unify(c, "bylaw_chunks")
    return back.select("bylaw_id", "title", "url", "chunk_index", F.md5("chunk_text").alias("text_md5")).distinct()


def sample_head(spark: SparkSession, d: str) -> DataFrame:
    """The first three chapters of the index."""
    return load(spark, d, "chapter_index").select("bylaw_id", "pos").orderBy("pos", "bylaw_id").limit(3)


def snapshot_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The last snapshot upserted into the ones before it, by url and content."""
    s = load(spark, d, "bylaw_snapshots").select("url", "content_sha256", "snapshot_no")
    last = s.agg(F.max("snapshot_no").alias("n"))
    s = s.join(F.broadcast(last), s.snapshot_no == last.n, "left")  # one row
    old = s.filter("n is null").groupBy("url", "content_sha256").agg(F.max("snapshot_no").alias("snapshot_no"))
    return store.upsert(old, s.filter("n is not null").drop("n"), ["url", "content_sha256"], [F.desc("snapshot_no")])


def bulk_append(spark: SparkSession, d: str) -> DataFrame:
    """Rows by key after the same insertion twice."""
    c = load(spark, d, "bylaws").select("scrape_id")
    return store.append(c, c).groupBy("scrape_id").agg(F.count("*").alias("n"))


def update_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without a vector get one, here that of the embeddings table with their number modulo 500, and its model's name."""
    c = load(spark, d, "bylaw_chunks").select("chunk_id", "embedding_model", F.col("chunk_embedding").cast("array<float>").alias("v"))
    due = c.filter("v is null").select("chunk_id", (F.col("chunk_id") % 500).alias("vec_id")).distinct()
    new = due.join(load(spark, d, "embeddings"), "vec_id").select("chunk_id", F.col("embedding").cast("array<float>").alias("v"), F.lit("table").alias("embedding_model"))
    done = store.update_column(store.update_column(c, "chunk_id", new, "v"), "chunk_id", new, "embedding_model")
    place = lambda i: F.try_element_at("v", F.lit(i)).cast("double")
    return done.select("chunk_id", "embedding_model", F.size("v").alias("dim"), place(1).alias("first"), place(-1).alias("last")).distinct()


def key_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return store.duplicate_keys(load(spark, d, "bylaw_chunks"))


def slug_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return store.files_by_slug(load(spark, d, "bylaws"), "title", "scrape_id").select("slug", "scrape_id")


def change_detection(spark: SparkSession, d: str) -> DataFrame:
    """Every snapshot against the one before."""
    return store.detect_all_changes(load(spark, d, "bylaw_snapshots"), "snapshot_no", "url", "content_sha256")


def json_files(spark: SparkSession, d: str) -> DataFrame:
    """By-laws as files named by the title's slug, the last of a slug, read back from their folder."""
    laws = store.files_by_slug(load(spark, d, "bylaws"), "title", "scrape_id").select("slug", "title", "url", "text", "bylaw_number", "fetched_at")
    path = new_folder(spark)
    store.write_json_files(laws, path)
    return loaders.json_documents(spark, path)


def text_files(spark: SparkSession, d: str) -> DataFrame:
    """By-law texts as .TXT files in a folder below the root, found by the scan, titled by their stem."""
    laws = load(spark, d, "bylaws").filter("scrape_id is not null and text is not null").groupBy("scrape_id").agg(F.min("text").alias("text"))
    path = new_folder(spark)
    store.write_files(laws, f"{path}/in", F.concat(F.lit("law "), "scrape_id", F.lit(".v1.TXT")), F.col("text"))
    return loaders.text_documents(spark, path)


def page_files(spark: SparkSession, d: str) -> DataFrame:
    """Local pages: name and heading of each file; a folder that is missing gives none."""
    pages = load(spark, d, "chapter_index").select("pos", F.concat(F.lit("<html><h1>"), html.escape(F.coalesce("title", F.lit(""))), F.lit("</h1></html>")).alias("html"))
    path = new_folder(spark)
    store.write_files(pages, path, F.concat("pos", F.lit(".html")), F.col("html"))
    both = loaders.html_files(spark, path).union(loaders.html_files(spark, path + "-none"))
    return html.html_meta(both.select(T.file_stem("path").alias("name"), "html"), "html").select("name", F.coalesce("meta.h1", F.lit("")).alias("h1"))


def page_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Pages by a fetcher that is down for some urls and refuses others, by their length."""

    def fetch(url: str) -> tuple[int, bytes]:
        if len(url) % 7 == 0:
            raise OSError("down")
        return (404, b"") if len(url) % 5 == 0 else (200, url.encode())

    got = loaders.fetched(spread(load(spark, d, "bylaw_snapshots").select("url")), "url", fetch)
    return got.select("url", "http_status", F.decode("content", "utf-8").alias("content"), "error")


def pdf_policies(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs as pages of a PDF, short ones unreadable, long ones broken, under the three policies."""

    class Pages:
        def __init__(self, data: bytes):
            self.left = data.decode().split("\n\n")

        def __iter__(self):
            return self

        def __next__(self) -> str | None:
            if not self.left:
                raise StopIteration
            page = self.left.pop(0)
            if len(page) > 600:
                raise ValueError("broken page")
            return page if len(page) >= 20 else None

    docs = load(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", *(loaders.pdf_text(F.encode("text", "utf-8"), Pages, p).alias(p) for p in loaders.PDF_POLICIES))


def sheet_rows(spark: SparkSession, d: str) -> DataFrame:
    """Log rows appended to a sheet and read back; the second sheet is down, which is told and stops nothing."""

    def down(rows: DataFrame) -> None:
        raise OSError("no connection")

    path = new_folder(spark)
    rows = _log(spark, d).select(F.col("logged_at").alias("timestamp"), "query", F.regexp_replace("ai_response", "\r", "").alias("response"))
    told = [store.append_log_rows(rows, sheet) for sheet in (store.csv_sheet(path), down)]
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\u0001").option("emptyValue", "").csv(path)
    return back.groupBy("timestamp", "query", "response", "other_logs").agg(F.count("*").alias("n")).withColumn("error", F.lit(told[1]))


# --- answers --------------------------------------------------------------------------------------------------------


def context_concat(spark: SparkSession, d: str) -> DataFrame:
    return answer.context_text(_hits(spark, d))


def source_list(spark: SparkSession, d: str) -> DataFrame:
    s = answer.source_list(_hits(spark, d))
    return s.select("query_id", F.posexplode("sources").alias("pos", "s")).select("query_id", "pos", "s.title", "s.bylaw_id", "s.pdf_url")


def sources_dedup_top5(spark: SparkSession, d: str) -> DataFrame:
    s = _log(spark, d).select("log_id", F.posexplode(answer.distinct_sources(F.col("retrieved_sources"))).alias("pos", "s"))
    return s.select("log_id", "pos", answer.source_label(F.col("s.title"), F.col("s.bylaw_id")).alias("label"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    m = lambda me, c: F.struct(F.lit(me).alias("fromMe"), F.col(c).alias("text"), F.col("logged_at").alias("timestamp"))
    return _log(spark, d).withColumn("messages", F.array(m(True, "query"), m(False, "ai_response"), m(True, "city"), m(False, "message")))


def history_text(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("log_id", answer.history_text(F.col("messages")).alias("history"))


def history_first3(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("messages")
    return _messages(spark, d).select("log_id", answer.history_text(answer.sent_messages(m)).alias("first3"), answer.history_text(answer.sent_messages(m, mode="last")).alias("last3"))


def prompt_text(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    p = answer.prompt_text(c("query"), c("message"), c("city"), c("ai_error"), F.lit(TODAY).cast("date"))
    return _log(spark, d).select("log_id", p.alias("prompt"))


def response_status(spark: SparkSession, d: str) -> DataFrame:
    r = answer.response(F.size("retrieved_sources"), F.col("ai_response"), F.col("ai_error"), F.col("retrieved_sources"), F.col("city"), F.col("logged_at"))
    return _log(spark, d).select("log_id", r.alias("r")).select("log_id", "r.status", "r.message", "r.ai_response", "r.ai_error", F.size("r.retrieved_sources").alias("n_sources"))


def rag_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut, embedded, and every question of the evaluation set answered from them."""
    chunks = spread(load(spark, d, "documents").select("doc_id", "text", "source"), "doc_id")
    chunks = chunking.explode_chunks(chunks, chunking.fixed_chunks(F.col("text"), 1000, 100), ["doc_id", "source"])
    chunks = chunks.select((F.col("doc_id") * 100_000 + F.col("chunk_index")).alias("chunk_id"), F.col("doc_id").cast("string").alias("bylaw_id"), F.col("source").alias("bylaw_title"), F.lit(None).cast("string").alias("url"), "chunk_text")
    ask = load(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit("Harrowdale").alias("city"), F.lit(None).cast("array<struct<fromMe:boolean,text:string,timestamp:string>>").alias("conversation_context"), F.lit(TODAY).alias("timestamp"))
    asked = embedding.reembed(ask, "query", "v")
    ranked = search.top_k(embedding.reembed(chunks, "chunk_text", "v"), asked, id_col="chunk_id", vec_col="v", query_id="query_id", query_vec="v", dim=384)
    ranked = materialize(ranked)
    hits = chunks.join(ranked, ranked.id == chunks.chunk_id)
    return answer.answer(ask, hits, F.lit(TODAY).cast("date")).select("query_id", answer.response_json(F.col("response")).alias("response"))


def _served(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The log's questions asked again, as request bodies, one of each batch of no JSON; hits are the sources the log has for them."""
    log = materialize(_log(spark, d))
    body = F.when(F.col("status") == "degraded", F.lit("not json")).otherwise(F.to_json(F.struct("query", "city", F.col("logged_at").alias("timestamp"))))
    requests = loaders.decode_requests(log.select(F.col("log_id").alias("query_id"), body.alias("body")), "body")
    hits = log.select(F.col("log_id").alias("query_id"), F.posexplode("retrieved_sources").alias("rank", "s")).select("query_id", "rank", F.col("s.title").alias("chunk_text"), F.col("s.title").alias("bylaw_title"), "s.bylaw_id", F.col("s.pdf_url").alias("url"))
    return answer.serve(requests, load(spark, d, "city_registry"), lambda valid: hits.join(valid.select("query_id"), "query_id"), F.lit(TODAY).cast("date"))


def serve_replies(spark: SparkSession, d: str) -> DataFrame:
    r, got = _served(spark, d)[0], lambda p: F.get_json_object("body", p)
    return r.select(F.col("query_id").alias("log_id"), "http_status", got("$.status").alias("status"), got("$.error.message").alias("error"), got("$.ai_response").alias("ai_response"), got("$.city").alias("city"))


def serve_log(spark: SparkSession, d: str) -> DataFrame:
    return _served(spark, d)[1].select(F.col("query_id").alias("log_id"), "status", "message", "query", F.size("retrieved_sources").alias("n_sources"))


def history_finished(spark: SparkSession, d: str) -> DataFrame:
    """Turns that are still loading, here those without a text, do not go along."""
    turns = F.transform(F.col("messages"), lambda m: F.struct(m["fromMe"].alias("fromMe"), m["text"].alias("text"), m["text"].isNull().alias("isLoading")))
    return _messages(spark, d).select("log_id", answer.history_text(answer.finished(turns)).alias("history"))


def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    e = embedding.reembed(spread(load(spark, d, "bylaw_chunks").select("chunk_id", "chunk_text")), "chunk_text", "embedding")
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return e.select("chunk_id", F.size("embedding").alias("dim"), F.round(F.sqrt(norm), 3).alias("norm")).distinct()


class _Refusing(embedding.HashingEmbedder):
    """Fails on some texts."""

    def encode(self, texts: list[str]) -> np.ndarray:
        if any("permit" in t for t in texts):
            raise ValueError("not embedded")
        return super().encode(texts)


def failed_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose embedding failed are left out after they were numbered: their ordinals stay free."""
    e = embedding.reembed(spread(_fixed(spark, d, 100)), "chunk_text", "v", lambda: _Refusing(16))
    return e.filter("v is not null").select("doc_id", "chunk_index", F.size("v").alias("dim"))


def reembed_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Vectors anew under another field: blank texts keep what stood there."""
    c = load(spark, d, "bylaw_chunks").select("chunk_id", "chunk_text", F.col("chunk_embedding").cast("array<float>").alias("v"))
    return embedding.reembed(spread(c), "chunk_text", "v", lambda: embedding.HashingEmbedder(16)).select("chunk_id", F.size("v").alias("dim")).distinct()


# --- log ------------------------------------------------------------------------------------------------------------


def log_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The log appended as JSON lines and read back through the schema of both shapes."""
    path = new_folder(spark)
    log = _log(spark, d).withColumn("timestamp", F.col("logged_at"))
    store.append_jsonl(log.select("status", "message", "ai_response", "ai_error", "retrieved_sources", "city", "timestamp", "query"), path)
    return loaders.read_log(spark, path).select("timestamp", "city", "query", "status", "message", "ai_response", "ai_error", F.coalesce(F.size("retrieved_sources"), F.lit(0)).alias("n_sources"))


def log_stream(spark: SparkSession, d: str) -> DataFrame:
    """The log's lines taken up by a file stream in two deliveries, each line once."""
    path = new_folder(spark)
    log = materialize(_log(spark, d).withColumn("timestamp", F.col("logged_at")))
    for part in (0, 1):
        store.append_jsonl(log.filter(F.pmod("log_id", F.lit(2)) == part).select("status", "message", "ai_response", "ai_error", "retrieved_sources", "city", "timestamp", "query"), f"{path}/in")
        stream.run_available(stream.log_stream(spark, f"{path}/in"), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out").groupBy("city", "status").agg(F.count("*").alias("n"), F.count("query").alias("n_queries"))


def settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings from arguments, the environment and their defaults, in this order."""
    c = config.parse(config.IngestConfig, ["--chunk", "500", "--input", "in"], {"CW_CITY": "Vardale", "CW_CHUNK": "9"})
    return spark.createDataFrame([(f.name, str(getattr(c, f.name))) for f in fields(c)], "name string, value string")


def log_cooldown(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d).select("log_id", "city", F.try_to_timestamp("logged_at").alias("at"))
    return activity.repeats_within(log, ["city"], "at", 600).select("log_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(load(spark, d, "bylaw_snapshots"), f"{new_folder(spark)}/ordinals")


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_topk_batch, vector_topk_blocks, vector_topk_by_collection, cosine_scores, city_routing, request_validation, request_decode, response_decode, city_requests, feedback,
        input_caps, slug_filename, slug_id, bylaw_id, content_hash, nonblank_filter, whitespace_normalize, newline_collapse, paragraph_split, sentence_split, year_number,
        lenient_dates, url_join, fixed_chunks, chunk_sequence, chunk_overlap, chunk_counts, packed_chunks, packed_cover, chapter_table, chapter_tables, page_links, scoped_links, first_pdf, page_meta, html_text,
        links_distinct, json_loader, exists_scan, ingest_counters, missing_embedding, unified_chunks, legacy_chunks, sample_head, chunk_upsert, snapshot_upsert, bulk_append, update_embedding, key_uniqueness,
        slug_last_wins, change_detection, json_files, text_files, page_files, page_fetch, pdf_policies, sheet_rows, context_concat, source_list, sources_dedup_top5, history_text, history_first3, prompt_text, response_status, rag_end_to_end, serve_replies, serve_log, history_finished,
        hash_embed, failed_embedding, reembed_fallback, log_roundtrip, log_stream, settings, log_cooldown, p2_found,
    )
}
