"""For each named query the SQL that gives the same rows on the same tables."""

from __future__ import annotations

_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _slug(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"


def _norm(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g')"


_LOG = "SELECT * FROM query_log WHERE log_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY received_at DESC) = 1"

_HITS = """
WITH v AS (
  SELECT DISTINCT chunk_id, lower(trim(city)) place, chunk_embedding::DOUBLE[] v FROM bylaw_chunks
  WHERE chunk_id IS NOT NULL AND trim(city) <> '' AND len(chunk_embedding) = 64 AND len(list_filter(chunk_embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    AND len(list_filter(chunk_embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.chunk_id query_id, c.chunk_id id, round(list_cosine_similarity(q.v, c.v), 6) score FROM v q JOIN v c ON q.place = c.place AND q.chunk_id <> c.chunk_id WHERE q.chunk_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT rank FROM s QUALIFY rank <= 4
), one AS (
  SELECT DISTINCT ON (chunk_id) chunk_id, bylaw_id, bylaw_title, bylaw_number, url, chunk_text FROM bylaw_chunks ORDER BY chunk_id, bylaw_id, bylaw_title, bylaw_number, url
), hits AS (SELECT r.*, one.* EXCLUDE (chunk_id) FROM r JOIN one ON r.id = one.chunk_id)
"""


def _nearest(where: str) -> str:
    return f"""
WITH s AS (
  SELECT q.vec_id query_id, c.vec_id, c.label, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) score
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.{where}
)
SELECT query_id, vec_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 4"""


def _fixed(overlap: int) -> str:
    return f"""
WITH n AS (SELECT doc_id, source, text, CASE WHEN length(text) <= 0 THEN 0 WHEN length(text) <= 1000 THEN 1 ELSE ceil((length(text) - 1000) / {1000 - overlap}.0)::INT + 1 END n FROM documents),
c AS (SELECT doc_id, source, k::INT chunk_index, substring(text, k::INT * {1000 - overlap} + 1, 1000) chunk_text FROM n, range(0, n.n) t(k))
"""


_SOURCES = f"""
WITH l AS ({_LOG}), u AS (SELECT log_id, unnest(retrieved_sources) s, generate_subscripts(retrieved_sources, 1) k FROM l),
f AS (SELECT * FROM u WHERE s.title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY log_id, s.title ORDER BY k) = 1),
p AS (SELECT log_id, s, (row_number() OVER (PARTITION BY log_id ORDER BY k) - 1)::INT pos FROM f QUALIFY pos < 5)
"""


def _say(me: bool, c: str) -> str:
    return f"'{'User' if me else 'AI'}: ' || coalesce({c}, 'None')"


_TURNS = [_say(True, "query"), _say(False, "ai_response"), _say(True, "city"), _say(False, "message")]

_SLUG_FILE = f"""lower(regexp_replace(regexp_replace({_strip("coalesce(nullif(title, ''), 'untitled_bylaw')")}, '{_WS}+', '_', 'g'), '[^A-Za-z0-9_]', '', 'g'))"""

_SERVED = f"""
l AS ({_LOG}), x AS (SELECT l.*, coalesce(len(retrieved_sources), 0)::INT n, CASE WHEN status = 'degraded' THEN 'Request must be JSON' WHEN collection IS NULL THEN 'City Not found'
  WHEN coalesce(length({_strip('query')}), 0) = 0 THEN 'Missing ''query'' in request body' END error FROM l LEFT JOIN city_registry r ON l.city = r.city)
"""

_LINKS = "WITH s AS (SELECT bylaw_id, regexp_replace(bylaw_id, '.*::', '') g FROM chapter_index)"

SQL = {
    "vector_topk": _nearest("vec_id = 0"),
    "vector_topk_batch": _nearest("vec_id % 50 = 0"),
    "vector_topk_blocks": """
WITH s AS (SELECT q.vec_id query_id, c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) score FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 4""",
    "vector_topk_by_collection": _HITS + "SELECT query_id, rank, score, id AS chunk_id, bylaw_id, bylaw_title, bylaw_number, url FROM hits",
    "cosine_scores": """
WITH a AS (SELECT label, arg_min(embedding, vec_id) anchor FROM embeddings GROUP BY label)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], anchor::DOUBLE[]), 6) AS score FROM embeddings JOIN a USING (label)""",
    "city_routing": f"WITH l AS ({_LOG}) SELECT log_id, l.city, collection FROM l LEFT JOIN city_registry r ON l.city = r.city",
    "request_validation": f"""
WITH l AS ({_LOG}) SELECT log_id, CASE WHEN collection IS NULL THEN 'unknown city' WHEN coalesce(length({_strip('query')}), 0) = 0 THEN 'empty query' END AS error
FROM l LEFT JOIN city_registry r ON l.city = r.city""",
    "request_decode": f"""
WITH l AS ({_LOG}) SELECT log_id, {_strip("coalesce(query, '')")} AS query, coalesce(city, 'Unknown City') AS city, CASE WHEN ai_response IS NULL THEN 0 ELSE 2 END::INT AS n_messages,
  CASE WHEN ai_response IS NULL THEN '' ELSE {_say(True, 'query')} || chr(10) || {_say(False, 'ai_response')} END AS history, logged_at AS timestamp FROM l""",
    "response_decode": f"WITH l AS ({_LOG}) SELECT log_id, coalesce(ai_response, 'No answer.') AS ai_response, coalesce(len(retrieved_sources), 0)::INT AS n_sources FROM l",
    "city_requests": f"""
WITH l AS ({_LOG}) SELECT log_id, CASE WHEN city <> '' THEN 'City request:' || chr(10) || chr(10) || 'City: ' || city || chr(10) || 'Email: ' || coalesce(nullif(ai_error, ''), 'N/A')
  || chr(10) || 'Notes: ' || coalesce(nullif(message, ''), 'N/A') END AS body FROM l""",
    "feedback": f"""
WITH l AS ({_LOG}) SELECT log_id, CASE WHEN message <> '' THEN 'Feedback:' || chr(10) || chr(10) || message || chr(10) || chr(10) || 'From: ' || coalesce(nullif(ai_error, ''), 'Anonymous') END AS body FROM l""",
    "input_caps": f"WITH l AS ({_LOG}) SELECT log_id, left(query, 50) AS query_50, left(ai_response, 500) AS response_500, left(ai_response, 200) AS response_200 FROM l",
    "slug_filename": f"SELECT DISTINCT title, lower(regexp_replace(regexp_replace({_strip('title')}, '{_WS}+', '_', 'g'), '[^A-Za-z0-9_]', '', 'g')) AS slug FROM bylaws",
    "slug_id": f"SELECT DISTINCT title, {_slug('title')} AS slug FROM bylaws",
    "bylaw_id": f"""
SELECT bylaw_id, {_slug("coalesce(city, '')")} || '::' || CASE WHEN length({_strip('bylaw_number')}) > 0 THEN {_slug('bylaw_number')} ELSE {_slug("coalesce(title, '')")} END AS stable_id FROM chapter_index""",
    "content_hash": "SELECT DISTINCT scrape_id, sha256(text) AS text_hash FROM bylaws",
    "nonblank_filter": f"SELECT DISTINCT chunk_id FROM bylaw_chunks WHERE length({_strip('chunk_text')}) > 0",
    "whitespace_normalize": f"SELECT DISTINCT scrape_id, {_norm('text')} AS text FROM bylaws",
    "newline_collapse": f"SELECT DISTINCT scrape_id, regexp_replace({_norm('text')}, '\\n{{2,}}', chr(10) || chr(10), 'g') AS text FROM bylaws",
    "paragraph_split": r"""
WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '\n{2,}', chr(1), 'g'), chr(1)) p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (generate_subscripts(p, 1) - 1)::INT AS pos, unnest(p) AS paragraph FROM p""",
    "sentence_split": rf"""
WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1)) p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (generate_subscripts(p, 1) - 1)::INT AS pos, unnest(p) AS sentence FROM p""",
    "year_number": r"""
WITH a AS (SELECT bylaw_id, title || ' (' || substring(bylaw_number, 1, 4) || ') - ' || substring(bylaw_number, 6, 10) t FROM chapter_index)
SELECT bylaw_id, nullif(regexp_extract(t, '\((\d{4})\)\s*-\s*([0-9]+)', 1), '') AS year, nullif(regexp_extract(t, '\((\d{4})\)\s*-\s*([0-9]+)', 2), '') AS number FROM a""",
    "lenient_dates": f"""
SELECT DISTINCT scrape_id, coalesce(strftime(try_strptime(last_passed, '%Y-%m-%d'), '%Y-%m-%d'), {_strip('last_passed')}) AS passed,
  coalesce(strftime(try_strptime(last_amended, '%Y-%m-%d'), '%Y-%m-%d'), {_strip('last_amended')}) AS amended FROM bylaws""",
    "url_join": f"""
WITH h AS (SELECT bylaw_id, pdf_url href, pdf_url url FROM chapter_index
  UNION ALL SELECT bylaw_id, '/files/' || {_slug('title')} || '.pdf', 'https://bylaws.example/files/' || {_slug('title')} || '.pdf' FROM chapter_index
  UNION ALL SELECT bylaw_id, 'files/' || {_slug('title')}, 'https://bylaws.example/index/files/' || {_slug('title')} FROM chapter_index)
SELECT DISTINCT bylaw_id, href, url FROM h""",
    "fixed_chunks": _fixed(100) + "SELECT doc_id, chunk_index, chunk_text FROM c",
    "chunk_sequence": _fixed(100) + "SELECT doc_id, (chunk_index + 1)::INT AS chunk_sequence, sha256(chunk_text) AS content_sha256 FROM c",
    "chunk_overlap": _fixed(0) + f"""
, l AS (SELECT *, lag(chunk_text) OVER (PARTITION BY doc_id ORDER BY chunk_index) b FROM c)
SELECT doc_id, chunk_index, CASE WHEN b IS NULL THEN chunk_text ELSE {_strip("right(b, 150) || chr(10) || chunk_text")} END AS chunk_text FROM l""",
    "chunk_counts": _fixed(100) + "SELECT source, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM c GROUP BY source",
    "chapter_table": f"""
SELECT {_strip('bylaw_id')} AS bylaw_id, {_strip('title')} AS title, {_strip('pdf_url')} AS pdf_url FROM chapter_index
WHERE {_strip('bylaw_id')} <> '' AND {_strip('title')} <> '' AND lower({_strip('pdf_url')}) LIKE '%.pdf' AND NOT contains(lower(title), 'reserved')""",
    "chapter_tables": f"""
WITH e AS (SELECT {_strip('bylaw_id')} b, {_strip('title')} title, {_strip('pdf_url')} pdf_url, bylaw_id page FROM chapter_index
  WHERE bylaw_number IS NOT NULL AND {_strip('title')} <> '' AND lower({_strip('pdf_url')}) LIKE '%.pdf' AND NOT contains(lower(title), 'reserved'))
SELECT page, b || m AS bylaw_id, title, pdf_url, k::INT AS pos FROM e, (VALUES ('', 0), (' B', 1), (' C', 2)) v(m, k)""",
    "scoped_links": _LINKS + """
SELECT bylaw_id, k::INT AS pos, t AS text, CASE WHEN t = 'b' THEN 'b' ELSE 'a b c d e again' END AS around FROM s, (VALUES (0, 'a'), (1, 'b'), (2, 'c'), (3, 'd'), (4, 'e'), (5, 'again')) v(k, t)""",
    "html_text": rf"""
WITH l AS (SELECT chunk_id, list_filter(list_transform([coalesce(bylaw_title, '')] || string_split(coalesce(chunk_text, ''), chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') p FROM bylaw_chunks)
SELECT DISTINCT chunk_id, array_to_string(p, chr(10)) AS text FROM l""",
    "packed_cover": f"""
WITH t AS (SELECT scrape_id, arg_max(text, fetched_at) t FROM bylaws WHERE scrape_id IS NOT NULL GROUP BY 1),
b AS (SELECT scrape_id, regexp_replace(t, '{_WS}+', '', 'g') b FROM t)
SELECT scrape_id, md5(b) AS text_md5, true AS numbered, false AS has_blank FROM b WHERE b <> ''""",
    "hash_embed": f"""
WITH c AS (SELECT DISTINCT chunk_id, chunk_text, length({_strip("coalesce(chunk_text, '')")}) > 0 b FROM bylaw_chunks)
SELECT DISTINCT chunk_id, CASE WHEN b THEN 384 END::INT AS dim, CASE WHEN b THEN CASE WHEN regexp_matches(chunk_text, '[\\w\\p{{L}}]') THEN 1.0 ELSE 0.0 END END::DOUBLE AS norm FROM c""",
    "failed_embedding": _fixed(100) + f"SELECT doc_id, chunk_index, 16::INT AS dim FROM c WHERE length({_strip('chunk_text')}) > 0 AND NOT contains(chunk_text, 'permit')",
    "reembed_fallback": f"""
SELECT DISTINCT chunk_id, CASE WHEN length({_strip("coalesce(chunk_text, '')")}) > 0 THEN 16 ELSE len(chunk_embedding) END::INT AS dim FROM bylaw_chunks""",
    "page_links": _LINKS + """
SELECT bylaw_id, 2::INT AS pos, 'https://bylaws.example/' || g || '-bylaw.aspx' AS url FROM s UNION ALL SELECT bylaw_id, 4, 'https://x.example/' || g || '-bylaw.aspx' FROM s""",
    "first_pdf": _LINKS + """
SELECT bylaw_id, 'https://bylaws.example/wp-content/uploads/' || g || '.PDF' AS pdf_url, 'https://bylaws.example/wp-content/uploads/' || g || '.PDF' AS plain_url FROM s""",
    "page_meta": f"""
SELECT DISTINCT scrape_id, 'By-lawpage' AS h1, nullif(trim(regexp_extract(bylaw_number, '^[A-Za-z0-9\\s-]+')), '') AS number,
  {_strip("nullif(regexp_extract(last_passed, '^[A-Za-z0-9,\\s]+'), '')")} AS passed_raw FROM bylaws""",
    "links_distinct": "SELECT title, bylaw_id FROM chapter_index WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY title ORDER BY pos, bylaw_id) = 1",
    "json_loader": "SELECT DISTINCT scrape_id, coalesce(nullif(title, ''), 'file' || scrape_id) AS title, url, coalesce(text, '') AS text, bylaw_number, fetched_at FROM bylaws",
    "exists_scan": "SELECT count(*) AS n FROM bylaw_chunks WHERE chunk_text IS NOT NULL",
    "ingest_counters": "SELECT lower(trim(city)) AS place, count(*) AS n_rows, count(DISTINCT bylaw_id) AS n_bylaws, count(DISTINCT chunk_id) AS n_chunks FROM bylaw_chunks GROUP BY 1",
    "missing_embedding": "SELECT DISTINCT chunk_id FROM bylaw_chunks WHERE chunk_embedding IS NULL",
    "unified_chunks": "SELECT DISTINCT 'bylaw_chunks' AS collection, bylaw_id, bylaw_title AS title, url, chunk_index, len(chunk_embedding)::INT AS dim FROM bylaw_chunks",
    "legacy_chunks": "SELECT DISTINCT bylaw_id, bylaw_title AS title, url, chunk_index, md5(chunk_text) AS text_md5 FROM bylaw_chunks",
    "sample_head": "SELECT bylaw_id, pos FROM chapter_index ORDER BY pos, bylaw_id LIMIT 3",
    "chunk_upsert": """
SELECT chunk_id, bylaw_id, chunk_index, content_sha256, ingested_at FROM bylaw_chunks
QUALIFY row_number() OVER (PARTITION BY bylaw_id, chunk_index, content_sha256 ORDER BY try_cast(ingested_at AS timestamptz) DESC NULLS LAST, ingested_at DESC NULLS LAST, chunk_id) = 1""",
    "snapshot_upsert": "SELECT url, content_sha256, max(snapshot_no) AS snapshot_no FROM bylaw_snapshots GROUP BY 1, 2",
    "bulk_append": "SELECT scrape_id, 2 * count(*) AS n FROM bylaws GROUP BY 1",
    "update_embedding": """
WITH n AS (SELECT DISTINCT chunk_id, embedding FROM bylaw_chunks JOIN embeddings ON vec_id = chunk_id % 500 WHERE chunk_embedding IS NULL),
m AS (SELECT c.chunk_id, CASE WHEN n.chunk_id IS NULL THEN embedding_model ELSE 'table' END embedding_model, coalesce(n.embedding::FLOAT[], c.chunk_embedding::FLOAT[]) v FROM bylaw_chunks c LEFT JOIN n ON c.chunk_id = n.chunk_id)
SELECT DISTINCT chunk_id, embedding_model, len(v)::INT AS dim, v[1]::DOUBLE AS first, v[-1]::DOUBLE AS last FROM m""",
    "key_uniqueness": "SELECT bylaw_id, chunk_index, content_sha256, count(*) AS n_rows FROM bylaw_chunks GROUP BY ALL HAVING count(*) > 1",
    "slug_last_wins": f"""
WITH s AS (SELECT scrape_id, lower(regexp_replace(regexp_replace({_strip("coalesce(nullif(title, ''), 'untitled_bylaw')")}, '{_WS}+', '_', 'g'), '[^A-Za-z0-9_]', '', 'g')) slug FROM bylaws)
SELECT slug, max(scrape_id) AS scrape_id FROM s GROUP BY slug""",
    "change_detection": """
WITH n AS (SELECT snapshot_no, row_number() OVER (ORDER BY snapshot_no) k FROM (SELECT DISTINCT snapshot_no FROM bylaw_snapshots WHERE snapshot_no IS NOT NULL)),
p AS (SELECT k, snapshot_no, url, max(content_sha256) h FROM bylaw_snapshots JOIN n USING (snapshot_no) WHERE url IS NOT NULL GROUP BY ALL),
o AS (SELECT k + 1 k, url, h FROM p WHERE k < (SELECT max(k) FROM n)), w AS (SELECT k, url, h FROM p WHERE k > 1),
j AS (SELECT coalesce(o.k, w.k) k, coalesce(o.url, w.url) url, CASE WHEN w.url IS NULL THEN 'missing' WHEN o.h IS NULL THEN 'new' WHEN o.h IS NOT DISTINCT FROM w.h THEN 'unchanged' ELSE 'changed' END state
  FROM o FULL JOIN w ON o.url = w.url AND o.k = w.k)
SELECT snapshot_no, url, state, state <> 'unchanged' AS changed FROM j JOIN n USING (k)""",
    "json_files": f"""
WITH s AS (SELECT *, {_SLUG_FILE} slug FROM bylaws QUALIFY row_number() OVER (PARTITION BY slug ORDER BY scrape_id DESC) = 1)
SELECT coalesce(nullif(title, ''), slug) AS title, url, coalesce(text, '') AS text, bylaw_number, fetched_at FROM s""",
    "text_files": """
SELECT 'law ' || scrape_id || '.v1' AS title, NULL::VARCHAR AS url, min(text) AS text, NULL::VARCHAR AS bylaw_number, NULL::VARCHAR AS fetched_at
FROM bylaws WHERE scrape_id IS NOT NULL AND text IS NOT NULL GROUP BY scrape_id""",
    "page_files": f"SELECT pos::VARCHAR AS name, coalesce({_strip('title')}, '') AS h1 FROM chapter_index",
    "page_fetch": """
SELECT DISTINCT url, CASE WHEN length(url) % 7 = 0 THEN NULL WHEN length(url) % 5 = 0 THEN 404 ELSE 200 END::INT AS http_status, CASE WHEN length(url) % 7 <> 0 AND length(url) % 5 <> 0 THEN url END AS content,
  CASE WHEN length(url) % 7 = 0 THEN 'down' WHEN length(url) % 5 = 0 THEN 'status 404' END AS error FROM bylaw_snapshots WHERE url IS NOT NULL""",
    "pdf_policies": f"""
WITH p AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) p FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, list_position(list_transform(p, lambda x: length(x) > 600), true) bad FROM p),
r AS (SELECT doc_id, bad, list_transform(list_filter(p, lambda x: length(x) <= 600), lambda x: CASE WHEN length(x) >= 20 THEN x ELSE '' END) good,
  list_transform(CASE WHEN bad IS NULL THEN p ELSE p[1:bad - 1] END, lambda x: CASE WHEN length(x) >= 20 THEN x ELSE '' END) upto FROM b),
t AS (SELECT doc_id, bad, array_to_string(good, '') g, array_to_string(list_transform(upto, lambda x: x || chr(10)), '') u FROM r)
SELECT doc_id, CASE WHEN {_strip('g')} <> '' THEN g END AS skip_page, CASE WHEN bad IS NULL THEN g ELSE '' END AS plain, {_strip('u')} AS line_per_page FROM t""",
    "sheet_rows": f"""
WITH l AS ({_LOG}) SELECT coalesce(logged_at, '') AS timestamp, coalesce(query, '') AS query, coalesce(replace(ai_response, chr(13), ''), '') AS response, '' AS other_logs, count(*) AS n, 'no connection' AS error
FROM l GROUP BY ALL""",
    "context_concat": _HITS + "SELECT query_id, string_agg(chunk_text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM hits WHERE chunk_text <> '' GROUP BY query_id",
    "source_list": _HITS + "SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1)::INT AS pos, bylaw_title AS title, bylaw_id, url AS pdf_url FROM hits",
    "sources_dedup_top5": _SOURCES + """
, x AS (SELECT log_id, pos, s.title title, coalesce(regexp_replace(s.bylaw_id, 'Chapter ', ''), '') b FROM p)
SELECT log_id, pos, trim(title || ' ' || CASE WHEN b <> '' THEN '(' || b || ')' ELSE '' END) AS label FROM x""",
    "history_text": f"WITH l AS ({_LOG}) SELECT log_id, {' || chr(10) || '.join(_TURNS)} AS history FROM l",
    "history_first3": f"WITH l AS ({_LOG}) SELECT log_id, {' || chr(10) || '.join(_TURNS[:3])} AS first3, {' || chr(10) || '.join(_TURNS[1:])} AS last3 FROM l",
    "prompt_text": f"""
WITH l AS ({_LOG}) SELECT log_id, 'You help residents of ' || coalesce(nullif(city, ''), 'the city') || ' understand municipal by-laws.' || chr(10) || chr(10) || 'Sections found:' || chr(10)
  || coalesce(nullif(message, ''), 'No section of the by-laws fits this question.') || chr(10) || chr(10) || 'Question:' || chr(10) || coalesce(nullif(query, ''), '(no question)') || chr(10) || chr(10)
  || 'Conversation so far, oldest first:' || chr(10) || coalesce(nullif(ai_error, ''), '(none)') || chr(10) || chr(10) || 'Instructions:' || chr(10)
  || '1. Answer in three to six sentences unless the question asks for more; bullet points are welcome where they help.' || chr(10)
  || '2. Name the exact figures, limits and conditions that the sections give.' || chr(10)
  || '3. Where no section settles the question, offer what comes closest to it in them.' || chr(10)
  || '4. Where the question refers to something said before, sum that up from the conversation.' || chr(10)
  || '5. Where nothing given can answer it, say which information there is and that it does not suffice.' || chr(10)
  || '6. Sections may begin or end in mid-word; complete such words so that the answer reads well.' || chr(10)
  || '7. Rather be clear and right than guess.' || chr(10)
  || '8. Of fees with several effective dates use the one in force on June 01, 2024; give past amounts only if they are asked for.' AS prompt FROM l""",
    "serve_replies": f"""
WITH {_SERVED}
SELECT log_id, CASE WHEN error IS NULL THEN 200 ELSE 400 END::INT AS http_status, CASE WHEN error IS NOT NULL THEN 'error' WHEN n = 0 THEN 'degraded' ELSE 'ok' END AS status, error,
  CASE WHEN error IS NOT NULL THEN NULL WHEN n = 0 THEN 'The by-laws cannot be searched at the moment. Please ask again later.'
       ELSE left(coalesce(list_filter(list_transform(retrieved_sources, lambda s: s.title), lambda t: t <> '')[1], 'No section of the by-laws fits this question.'), 512) END AS ai_response,
  CASE WHEN error IS NULL THEN city END AS city FROM x""",
    "serve_log": f"""
WITH {_SERVED}
SELECT log_id, CASE WHEN n = 0 THEN 'degraded' END AS status, CASE WHEN n = 0 THEN 'The chunk store gave no results.' END AS message, CASE WHEN n > 0 THEN {_strip('query')} END AS query, n AS n_sources
FROM x WHERE error IS NULL""",
    "history_finished": f"""
WITH l AS ({_LOG}) SELECT log_id, array_to_string(list_filter([CASE WHEN query IS NOT NULL THEN 'User: ' || query END, CASE WHEN ai_response IS NOT NULL THEN 'AI: ' || ai_response END,
  CASE WHEN city IS NOT NULL THEN 'User: ' || city END, CASE WHEN message IS NOT NULL THEN 'AI: ' || message END], lambda x: x IS NOT NULL), chr(10)) AS history FROM l""",
    "response_status": f"""
WITH l AS ({_LOG}), x AS (SELECT *, coalesce(len(retrieved_sources), 0) = 0 AS none FROM l)
SELECT log_id, CASE WHEN none OR ai_error IS NOT NULL THEN 'degraded' ELSE 'ok' END AS status,
  CASE WHEN none THEN 'The chunk store gave no results.' WHEN ai_error IS NOT NULL THEN 'The language model gave no answer.' END AS message,
  CASE WHEN none THEN 'The by-laws cannot be searched at the moment. Please ask again later.'
       WHEN ai_error IS NOT NULL THEN 'No answer could be written at the moment. These are the sections that fit the question best.' ELSE ai_response END AS ai_response,
  CASE WHEN NOT none THEN ai_error END AS ai_error, CASE WHEN none THEN 0 ELSE len(retrieved_sources) END::INT AS n_sources FROM x""",
    "log_roundtrip": f"""
WITH l AS ({_LOG}) SELECT logged_at AS timestamp, city, query, status, message, ai_response, ai_error, coalesce(len(retrieved_sources), 0)::INT AS n_sources FROM l""",
    "log_stream": f"WITH l AS ({_LOG}) SELECT city, status, count(*) AS n, count(query) AS n_queries FROM l GROUP BY ALL",
    "settings": """
SELECT name, value FROM (VALUES ('db', 'bylaws'), ('collection', 'bylaw_chunks'), ('city', 'Vardale'), ('input', 'in'), ('chunk', '500'), ('overlap', '150'), ('minchunk', '600'), ('batch', '64')) v(name, value)""",
    "log_cooldown": f"""
WITH l AS ({_LOG}), t AS (SELECT log_id, city, epoch_ms(try_cast(logged_at AS timestamp)) t FROM l),
g AS (SELECT log_id, t - max(t) OVER (PARTITION BY city ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) gap FROM t WHERE city IS NOT NULL AND t IS NOT NULL)
SELECT log_id FROM g WHERE gap < 600000""",
    "p2_found": r"""
WITH r AS (
  SELECT snapshot_no, lower(trim(url)) u, try_cast(fetched_at AS timestamptz) t, nullif(lower(trim(content_sha256)), '') h FROM bylaw_snapshots WHERE snapshot_no IS NOT NULL
), c AS (
  SELECT snapshot_no, 'https://' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '[?#].*$', ''), '^(https?:)?//', ''), '^www\.', ''), '/+$', '') url, t, h FROM r
), l AS (
  SELECT snapshot_no, url, h FROM c QUALIFY row_number() OVER (PARTITION BY snapshot_no, url ORDER BY t DESC NULLS LAST, h DESC NULLS LAST) = 1
), f AS (
  SELECT snapshot_no, url, last_value(h IGNORE NULLS) OVER (PARTITION BY url ORDER BY snapshot_no ROWS UNBOUNDED PRECEDING) h FROM l
)
SELECT coalesce(n.snapshot_no, o.snapshot_no + 1)::INT AS snapshot_no, coalesce(n.url, o.url) AS url,
       CASE WHEN o.url IS NULL THEN 'added' WHEN n.url IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM f n FULL JOIN f o ON n.url = o.url AND n.snapshot_no = o.snapshot_no + 1
WHERE coalesce(n.snapshot_no, o.snapshot_no + 1) BETWEEN (SELECT min(snapshot_no) + 1 FROM f) AND (SELECT max(snapshot_no) FROM f)
  AND (o.url IS NULL OR n.url IS NULL OR (o.h IS NOT NULL AND n.h <> o.h))""",
}
