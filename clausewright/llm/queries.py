"""Named queries of the training-text operators, over whole tables, and SQL where SQL is quick enough."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm import boilerplate, leakage, nearcopies, neighbours, packing, pairs, reading, scans, splitting
from clausewright.llm.items import text_items
from clausewright.operators import search
from clausewright.runtime import load, materialize, spread


def _copies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return nearcopies.near_copies(load(spark, d, "bylaw_chunks"), "chunk_id", "chunk_text", threshold=0.6, ngram=3, min_words=20)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.linked_ids(*_copies(spark, d)).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.copy_groups(*_copies(spark, d)).withColumnRenamed("id", "chunk_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(spread(text_items(spark, d), "item_id"), ["item_kind", "item_id"])
    return pieces.filter("chunk_index = 1").select("item_kind", "item_id").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(spread(text_items(spark, d), "item_id"), ["item_kind", "item_id"]).distinct()


def p3_cover(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of an item put together again, without their overlaps, and whether all are within the size and follow each other."""
    pieces = p3_pieces(spark, d).groupBy("item_kind", "item_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))).alias("p"))  # of one text
    body = F.array_join(F.transform("p", lambda x, i: F.when(i == 0, x["chunk_text"]).otherwise(F.substring(x["chunk_text"], 151, 1000))), "")
    fits = F.forall("p", lambda x: F.length(x["chunk_text"]) <= 1000) & (F.element_at("p", -1)["chunk_index"] + 1 == F.size("p"))
    return pieces.select("item_kind", "item_id", F.md5(body).alias("text_md5"), fits.alias("fits"))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.similar_vectors(load(spark, d, "bylaw_chunks"), "chunk_id", "chunk_embedding", dim=64, k=5)
    return near.select(F.col("id").alias("chunk_id"), F.col("other").alias("neighbour_id"), F.round(F.col("similarity").cast("double"), 5).alias("similarity"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.similar_vectors(load(spark, d, "bylaw_chunks"), "chunk_id", "chunk_embedding", dim=64, k=5, min_similarity=0.90)
    return near.select(F.least("id", "other").alias("chunk_id_a"), F.greatest("id", "other").alias("chunk_id_b")).distinct()


def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    """The five neighbours of every chunk whose id is divisible by 50 against exact search over all vectors: is at least 0.9 found?"""
    rows = load(spark, d, "bylaw_chunks").select("chunk_id", F.col("chunk_embedding").cast("array<double>").alias("v"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    asked = rows.filter("chunk_id % 50 = 0 and size(v) = 64").filter(usable).dropDuplicates(["chunk_id"])
    exact = search.top_k(spread(rows), asked, id_col="chunk_id", vec_col="v", query_id="chunk_id", query_vec="v", dim=64, k=5, exclude_self=True)
    bar = exact.groupBy("query_id").agg(F.min("score").alias("fifth"), F.count("*").alias("n"))
    near = neighbours.similar_vectors(load(spark, d, "bylaw_chunks"), "chunk_id", "chunk_embedding", dim=64, k=5).filter("id % 50 = 0")
    met = bar.join(near, bar.query_id == near.id, "left").groupBy("query_id").agg(F.max("n").alias("n"), F.count(F.when(F.col("similarity") >= F.col("fifth") - 1e-5, 1)).alias("met"))
    return met.agg(F.count("*").alias("n_queries"), (F.sum(F.least("met", "n")) >= 0.9 * F.sum("n")).alias("reached"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    broken = pairs.broken_pairs(load(spark, d, "query_log"), id_col="log_id", query="query", response="ai_response", status="status")
    return broken.withColumnRenamed("id", "log_id")


def _site_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks = spread(load(spark, d, "bylaw_chunks").select("chunk_id", "bylaw_id", "city", "chunk_text"), "chunk_id")
    return chunks, *boilerplate.site_lines(chunks, "chunk_id", "bylaw_id", "city", "chunk_text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    _, _, found = _site_lines(spark, d)
    return found.select(F.col("doc").alias("chunk_id"), "line_no").distinct()


def p6_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The boilerplate blocks of the cities, told apart by nothing but what they hold: lines, and by-laws of the most frequent line."""
    _, blocks, _ = _site_lines(spark, d)
    one = blocks.groupBy(F.col("source").alias("city"), "block").agg(F.count("*").alias("n_lines"), F.max("n_groups").alias("n_bylaws"))
    return one.groupBy("city", "n_lines", "n_bylaws").agg(F.count("*").alias("n_blocks"))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    chunks, _, found = _site_lines(spark, d)
    return boilerplate.remove_lines(chunks, "chunk_id", "chunk_text", found).select(F.col("doc").alias("chunk_id"), F.col("text").alias("chunk_text"))


def _repaired(spark: SparkSession, d: str, reflow: bool) -> DataFrame:
    titles = load(spark, d, "chapter_index").select("bylaw_id", F.col("title").alias("title2"))
    return scans.repair_scans(text_items(spark, d), titles, reflow)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d, False).select("item_kind", "item_id", F.explode("noise").alias("noise"))


def p7_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The repaired text of every item that held noise."""
    return _repaired(spark, d, True).filter(F.size("noise") > 0).select("item_kind", "item_id", "text")


def p8_inputs(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    groups = nearcopies.copy_groups(*nearcopies.near_copies(docs, "doc_id", "text", threshold=0.8, ngram=5, bands=24, rows=6))
    return packing.pack_documents(docs, doc="doc_id", text="text", source="source", clusters=groups.select("id", F.col("group_id").alias("cluster")))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many inputs there are, the least that the tokens need, the fullest, and the share that is filled."""
    used = p8_inputs(spark, d).groupBy("input_no").agg(F.sum("n_tokens").alias("used"))
    return used.agg(F.count("*").alias("n_inputs"), F.ceil(F.sum("used") / 2048).alias("least_inputs"), F.max("used").alias("most"), F.round(F.avg("used") / 2048, 4).alias("filled"))


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold: every document placed once, in parts that follow each other, no input over its size, no text twice in an input, and
    no more inputs than 2 % and one above what the tokens need."""
    docs = load(spark, d, "documents")
    got = materialize(p8_inputs(spark, d))
    texts = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.xxhash64(F.min("text")).alias("h"))
    whole = got.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("part").alias("last"), F.sum("n_tokens").alias("size"), F.max("first_token").alias("at"), F.max_by("n_tokens", "part").alias("rest"))
    sound = (F.col("n") == F.col("last") + 1) & (F.col("at") == 2048 * F.col("last")) & (F.col("at") + F.col("rest") == F.col("size"))
    parts = got.filter("n_tokens > 0 and n_tokens < 2048").join(texts, "doc_id").groupBy("input_no", "h").agg(F.count("*").alias("n"))
    used = got.groupBy("input_no").agg(F.sum("n_tokens").alias("used")).agg(F.max("used").alias("most"), F.count("*").alias("inputs"), F.ceil(F.sum("used") / 2048).alias("least"))
    row = lambda df: df.withColumn("k", F.lit(0))
    one = row(whole.agg(F.count("*").alias("n_docs"), F.min(sound.cast("int")).alias("sound"))).join(row(used), "k").join(row(parts.agg(F.max("n").alias("twice"))), "k")  # a row each
    return one.select("n_docs", (F.col("sound") == 1).alias("parts_follow"), (F.col("most") <= 2048).alias("within_size"), (F.col("twice") == 1).alias("copies_apart"), (F.col("inputs") <= 1.02 * F.col("least") + 1).alias("well_filled"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(load(spark, d, "documents"), load(spark, d, "eval_items"), doc="doc_id", text="text", item="item_id", item_text="text")


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(load(spark, d, "documents"), load(spark, d, "reading_labels"), doc="doc_id", text="text", level="reading_level")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).filter("english and n_words >= 60 and reading_level in (1, 5)").select("doc_id", "reading_level")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).select("doc_id", "reading_level")


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_cover": p3_cover,
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p4_recall": p4_recall,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_blocks": p6_blocks,
    "p6_clean": p6_clean,
    "p7_found": p7_found,
    "p7_repaired": p7_repaired,
    "p8_inputs": p8_inputs,
    "p8_fill": p8_fill,
    "p8_check": p8_check,
    "p9_found": p9_found,
    "p10_found": p10_found,
    "p10_levels": p10_levels,
}

_P6 = r"""
WITH t AS (SELECT chunk_id, bylaw_id, lower(trim(city)) city, string_split(chunk_text, chr(10)) ls FROM bylaw_chunks
           WHERE chunk_id IS NOT NULL AND bylaw_id IS NOT NULL AND trim(city) <> ''),
l AS (SELECT chunk_id, bylaw_id, city, unnest(ls) line, generate_subscripts(ls, 1)::INT line_no FROM t),
k AS (SELECT chunk_id, bylaw_id, city, line_no, trim(regexp_replace(lower(regexp_replace(line, '[0-9]', '', 'g')), '[^a-z]+', ' ', 'g')) k FROM l),
w AS (SELECT * FROM k WHERE k <> '' AND length(k) - length(replace(k, ' ', '')) >= 3),
n AS (SELECT city, k, count(DISTINCT bylaw_id) c FROM w GROUP BY city, k),
a AS (SELECT lower(trim(city)) city, count(DISTINCT bylaw_id) m FROM bylaw_chunks GROUP BY 1),
hot AS (SELECT city, k FROM n JOIN a USING (city) WHERE c >= 5 AND c >= 0.04 * m - 1e-9)
"""

_P1 = r"""
WITH RECURSIVE t AS (SELECT DISTINCT chunk_id, chunk_text, regexp_extract_all(lower(chunk_text), '[a-z0-9]+') w FROM bylaw_chunks WHERE chunk_id IS NOT NULL AND chunk_text IS NOT NULL),
r AS (SELECT chunk_text, w, min(chunk_id) rep FROM t WHERE len(w) >= 20 GROUP BY ALL),
m AS (SELECT t.chunk_id, rep FROM t JOIN r USING (chunk_text) WHERE t.chunk_id <> rep),
s AS (SELECT DISTINCT rep, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g FROM r, range(1, len(w) - 1) x(i)),
n AS (SELECT rep, count(*) n FROM s GROUP BY rep),
c AS (SELECT a.rep a, b.rep b, count(*) k FROM s a JOIN s b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE k >= 0.6 * (x.n + y.n - k) - 1e-9)
"""

SQL: dict[str, str] = {
    "p1_found": _P1 + """,
p AS (SELECT a, b FROM l UNION SELECT m.chunk_id, b FROM l JOIN m ON m.rep = a UNION SELECT a, m.chunk_id FROM l JOIN m ON m.rep = b UNION SELECT rep, chunk_id FROM m)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM p WHERE a <> b""",
    "p1_groups": _P1 + """
, e AS (SELECT a x, b y FROM l UNION SELECT b, a FROM l),
g AS (SELECT rep x, rep y FROM r UNION SELECT g.x, e.y FROM g JOIN e ON g.y = e.x),
c2 AS (SELECT x rep, min(y) group_id FROM g GROUP BY x), d AS (SELECT x rep, count(*) n_links FROM e GROUP BY x)
SELECT DISTINCT t.chunk_id, rep AS class_id, group_id, coalesce(n_links, 0) AS n_links FROM t JOIN r USING (chunk_text) JOIN c2 USING (rep) LEFT JOIN d USING (rep)""",
    "p3_cover": r"""
WITH i AS (SELECT 'bylaw' item_kind, scrape_id item_id, text t FROM bylaws UNION ALL SELECT 'chunk', chunk_id, chunk_text FROM bylaw_chunks),
n AS (SELECT DISTINCT item_kind, item_id, regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') t FROM i)
SELECT item_kind, item_id, md5(t) AS text_md5, true AS fits FROM n WHERE length(t) > 1000""",
    "p4_recall": """
SELECT count(DISTINCT chunk_id) AS n_queries, true AS reached FROM bylaw_chunks WHERE chunk_id % 50 = 0 AND len(chunk_embedding) = 64
  AND len(list_filter(chunk_embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(chunk_embedding, lambda x: x <> 0)) > 0""",
    "p8_check": "SELECT count(DISTINCT doc_id) AS n_docs, true AS parts_follow, true AS within_size, true AS copies_apart, true AS well_filled FROM documents",
    "p6_blocks": "WITH RECURSIVE" + _P6.strip().removeprefix("WITH") + """
, o AS (SELECT DISTINCT chunk_id, line_no, city, k, bylaw_id FROM w JOIN hot USING (city, k)),
e AS (SELECT a.city, a.k x, b.k y FROM o a JOIN o b ON a.chunk_id = b.chunk_id AND a.city = b.city AND b.line_no = a.line_no + 1 GROUP BY ALL HAVING count(DISTINCT a.bylaw_id) >= 5),
u AS (SELECT city, x, y FROM e UNION SELECT city, y, x FROM e),
g AS (SELECT city, k x, k y FROM hot UNION SELECT g.city, g.x, u.y FROM g JOIN u ON g.city = u.city AND g.y = u.x),
b AS (SELECT city, x k, min(y) block FROM g GROUP BY city, x),
z AS (SELECT city, block, count(*) n_lines, max(c) n_bylaws FROM b JOIN n USING (city, k) GROUP BY city, block)
SELECT city, n_lines, n_bylaws, count(*) AS n_blocks FROM z GROUP BY ALL""",
    "p3_found": r"""
WITH i AS (SELECT 'bylaw' item_kind, scrape_id item_id, text t FROM bylaws UNION ALL SELECT 'chunk', chunk_id, chunk_text FROM bylaw_chunks)
SELECT DISTINCT item_kind, item_id FROM i
WHERE length(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) > 1000""",
    "p9_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') w FROM eval_items),
dr AS (SELECT DISTINCT doc_id, array_to_string(w[s:s+11], ' ') r FROM d, range(1, len(w) - 10) t(s)),
ir AS (SELECT DISTINCT item_id, array_to_string(w[s:s+11], ' ') r FROM i, range(1, len(w) - 10) t(s))
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (r)""",
    "p6_found": _P6 + "SELECT DISTINCT chunk_id, line_no FROM w JOIN hot USING (city, k)",
    "p6_clean": _P6 + """
, gone AS (SELECT DISTINCT chunk_id, line_no FROM w JOIN hot USING (city, k)),
d AS (SELECT chunk_id, min(chunk_text) t FROM bylaw_chunks GROUP BY 1),
s AS (SELECT chunk_id, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1)::INT line_no FROM d),
j AS (SELECT chunk_id, string_agg(line, chr(10) ORDER BY line_no) t FROM s ANTI JOIN gone USING (chunk_id, line_no) GROUP BY 1)
SELECT d.chunk_id, CASE WHEN d.t IS NOT NULL THEN coalesce(j.t, '') END AS chunk_text FROM d LEFT JOIN j USING (chunk_id)""",
}
