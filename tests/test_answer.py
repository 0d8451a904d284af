from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from clausewright import config
from clausewright.operators import answer, embedding, search
from clausewright.sources import loaders


def test_validation_order(spark):
    reg = spark.createDataFrame([("A", "chunks_a")], "city string, collection string")
    req = spark.createDataFrame([("A", "q"), ("A", "  "), ("Z", ""), (None, None)], "city string, query string")
    got = [(r.city, r.error) for r in answer.validate(answer.route_city(req, reg)).collect()]
    assert sorted(got, key=str) == sorted([("A", None), ("A", "empty query"), ("Z", "unknown city"), (None, "unknown city")], key=str)


def test_sources(spark):
    s = [("T", "Chapter 1", "p"), ("T", "2", "q"), (None, "3", "r"), ("U", None, None), ("V", "Chapter Chapter 9", None), ("W", "", None), ("X", "1", None), ("Y", "1", None)]
    df = spark.createDataFrame([(s,), (None,), ([],)], f"s {answer.SOURCE}")
    got = [[x.bylaw_id for x in r.d] if r.d is not None else None for r in df.select(answer.distinct_sources(F.col("s")).alias("d")).collect()]
    assert got == [["Chapter 1", None, "Chapter Chapter 9", "", "1"], None, []]
    label = lambda t, b: spark.createDataFrame([(t, b)], "t string, b string").select(answer.source_label(F.col("t"), F.col("b")).alias("x")).first().x
    assert label("T", "Chapter 12") == "T (12)" and label(None, None) == "Source" and label("V", "Chapter Chapter 9") == "V (Chapter 9)"


def test_history(spark):
    m = [(True, "a", None), (False, None, None), (None, "", None), (True, "d", None), (True, "e", None)]
    df = spark.createDataFrame([(m,), ([],), (None,)], "m array<struct<fromMe:boolean,text:string,timestamp:string>>")
    got = df.select(answer.history_text(F.col("m")).alias("h"), answer.history_text(answer.sent_messages(F.col("m"))).alias("f"), answer.history_text(answer.sent_messages(F.col("m"), 2, "last")).alias("l")).collect()
    assert got[0].h == "User: a\nAI: None\nAI: \nUser: d\nUser: e" and got[0].f == "User: a\nAI: None\nAI: " and got[0].l == "User: d\nUser: e"
    assert got[1].h == "" and got[2].h == ""


def test_loading_messages_stay_out(spark):
    df = spark.createDataFrame([([(True, "a", None), (False, "b", True), (False, "c", False)],)], "m array<struct<fromMe:boolean,text:string,isLoading:boolean>>")
    assert [x.text for x in df.select(answer.finished(F.col("m")).alias("m")).first().m] == ["a", "c"]


def test_answers(spark):
    req = spark.createDataFrame([(1, "q1", "A", None, "t"), (2, "q2", "A", [(True, "x", None)], "t"), (3, "boom", "A", None, "t")], "query_id long, query string, city string, conversation_context array<struct<fromMe:boolean,text:string,timestamp:string>>, timestamp string")
    hits = spark.createDataFrame([(2, 2, "second", "T2", "b2", "u"), (2, 1, "first", "T1", "b1", "u"), (3, 1, "x", "T", "b", "u"), (2, 3, "", "T3", "b3", "u")], "query_id long, rank int, chunk_text string, bylaw_title string, bylaw_id string, url string")

    def model(prompt, settings):
        if "boom" in prompt:
            raise RuntimeError("busy")
        return answer.extractive(prompt, settings)

    got = {r.query_id: r.response for r in answer.answer(req, hits, F.lit("2024-02-03").cast("date"), model).collect()}
    assert got[1].status == "degraded" and got[1].retrieved_sources == [] and got[1].message == answer.STORE_DOWN
    assert got[2].status == "ok" and got[2].ai_response == "first" and [s.title for s in got[2].retrieved_sources] == ["T1", "T2", "T3"]
    assert got[3].status == "degraded" and got[3].ai_error == "busy" and len(got[3].retrieved_sources) == 1


def test_decode(spark):
    df = spark.createDataFrame([('{"query": "  a ", "conversation_context": [{"fromMe": true, "text": "x"}]}',), ("{}",), ("broken",)], "b string")
    got = loaders.decode_requests(df, "b").collect()
    assert [(r.query, r.city, len(r.conversation_context)) for r in got] == [("a", "Unknown City", 1), ("", "Unknown City", 0), ("", "Unknown City", 0)]
    d = loaders.decode_responses(spark.createDataFrame([('{"retrieved_sources": [{"title": "t"}, null]}',)], "b string"), "b").first()
    assert d.ai_response == "No answer." and len(d.retrieved_sources) == 1


def test_top_k_brute(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8)).round(3)
    v[10] = v[11] = v[12]
    bad = [(900, [0.0] * 8), (901, [1.0] * 7), (902, None), (903, [float("nan")] + [1.0] * 7), (904, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + bad + [(5, [float(x) for x in v[5]])]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("score", F.lit("clash")).repartition(3)
    got = search.top_k(df, df.filter("id % 50 = 0 or id = 10").dropDuplicates(["id"]), id_col="id", vec_col="v", query_id="id", query_vec="v", dim=8, k=4, exclude_self=True).collect()
    u = v / np.linalg.norm(v, axis=1)[:, None]
    for q in {r.query_id for r in got}:
        s = np.round(u @ u[q], 6)
        want = sorted((-s[i], i) for i in range(300) if i != q)[:4]
        assert [(r.id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(i, -x) for x, i in want]
    assert {r.query_id for r in got} == {0, 10, 50, 100, 150, 200, 250}


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a b"), (2, " "), (3, None), (4, "a b")], "i int, t string")
    got = {r.i: r.v for r in embedding.reembed(df, "t", "v", lambda: embedding.HashingEmbedder(16)).collect()}
    assert got[2] is None and got[3] is None and got[1] == got[4] and abs(np.linalg.norm(got[1]) - 1) < 1e-6


def test_config():
    c = config.parse(config.IngestConfig, ["--chunk", "500"], {"CW_CITY": "A"})
    assert (c.chunk, c.overlap, c.city, c.batch) == (500, 150, "A", 64)


def test_top_k_in_blocks(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 8)).round(2)
    v[20] = v[21] = v[22]
    rows = [(i, "a" if i % 3 else "b", [float(x) for x in r]) for i, r in enumerate(v)] + [(2000, None, [1.0] * 8), (7, "a", [float(x) for x in v[7]])]
    df = spark.createDataFrame(rows, "id long, g string, v array<double>").repartition(3)
    ask = df.dropDuplicates(["id"])
    run = lambda **kw: {(r.query_id, r.id, r.score, r["rank"]) for r in search.top_k(df, ask, id_col="id", vec_col="v", query_id="id", query_vec="v", dim=8, k=4, exclude_self=True, **kw).collect()}
    assert run(group="g", block_bytes=64 * 50, block_rows=70) == run(group="g")
    assert run(block_bytes=64 * 50, block_rows=70) == run()
    assert {r[0] for r in run(group="g")} == set(range(400)) and {r[0] for r in run()} == set(range(400)) | {2000}


def test_large_ids_stay_apart(spark):
    df = spark.createDataFrame([(2**60, [1.0, 0.0]), (2**60 + 1, [1.0, 0.0]), (1, [1.0, 0.1])], "id long, v array<double>")
    got = search.top_k(df, df.filter("id = 1"), id_col="id", vec_col="v", query_id="id", query_vec="v", dim=2, k=4, exclude_self=True).collect()
    assert {r.id for r in got} == {2**60, 2**60 + 1}


def test_serve(spark):
    bodies = ['{"query": "q", "city": "A"}', '{"query": " ", "city": "A"}', '{"query": "", "city": "B"}', "no json", '{"query": "none", "city": "A"}']
    req = loaders.decode_requests(spark.createDataFrame(list(enumerate(bodies)), "query_id long, b string"), "b")
    reg = spark.createDataFrame([("A", "chunks_a")], "city string, collection string")
    hits = spark.createDataFrame([(0, 1, "text", "T", "b", "u")], "query_id long, rank int, chunk_text string, bylaw_title string, bylaw_id string, url string")
    asked = []
    replies, log = answer.serve(req, reg, lambda valid: asked.append(sorted(r.query_id for r in valid.collect())) or hits, F.lit("2024-02-03").cast("date"))
    got = {r.query_id: (r.http_status, r.body) for r in replies.collect()}
    assert [got[i][0] for i in range(5)] == [200, 400, 400, 400, 200] and asked == [[0, 4]]
    assert "Missing" in got[1][1] and "City Not found" in got[2][1] and "JSON" in got[3][1] and '"degraded"' in got[4][1]
    assert {(r.query_id, r.status, r.query) for r in log.collect()} == {(0, None, "q"), (4, "degraded", None)}
    empty, nothing = answer.serve(req.limit(0), reg, lambda _: hits, F.lit("2024-02-03").cast("date"))
    assert empty.count() == 0 and nothing.count() == 0
