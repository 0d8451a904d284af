from __future__ import annotations

from pyspark.sql import functions as F

from clausewright.plans import queries
from clausewright.sources import loaders, store
from clausewright.operators import activity, graph, snapshots


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)


def test_upsert(spark):
    s = "bylaw_id string, chunk_index int, content_sha256 string, v int"
    old = spark.createDataFrame([("a", 0, "x", 1), ("a", 1, "y", 1), (None, 0, "n", 1)], s)
    new = spark.createDataFrame([("a", 0, "x", 2), ("a", 1, "z", 2), ("a", 1, "z", 3), (None, 0, "n", 2)], s)
    got = store.upsert(old, new, order=[F.desc("v")])
    assert rows(got, "bylaw_id", "chunk_index", "content_sha256", "v") == sorted([("a", 0, "x", 2), ("a", 1, "y", 1), ("a", 1, "z", 3), (None, 0, "n", 2)], key=str)
    assert rows(store.upsert(got, new, order=[F.desc("v")]), "v") == rows(got, "v")
    assert rows(store.upsert(old, new, order=[F.desc("v")], purge_stale="bylaw_id"), "v") == [(1,), (2,), (2,), (3,)]
    assert store.upsert(old.limit(0), new.limit(0)).count() == 0


def test_update_and_keys(spark):
    base = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "i int, v string")
    new = spark.createDataFrame([(2, "n"), (3, "x"), (1, None)], "i int, v string")
    assert rows(store.update_column(base, "i", new, "v"), "i", "v") == [(1, "a"), (2, "n"), (2, "n")]
    assert rows(store.duplicate_keys(base, ["i"]), "i", "n_rows") == [(2, 2)]


def test_slug_files(spark):
    df = spark.createDataFrame([("A b", 1), ("a  B!", 2), (None, 3), ("", 4)], "title string, pos int")
    assert rows(store.files_by_slug(df, "title", "pos"), "slug", "pos") == [("a_b", 2), ("untitled_bylaw", 4)]


def test_changes(spark):
    o = spark.createDataFrame([("u1", "a"), ("u2", "b"), ("u3", None), ("u4", "d")], "url string, hash string")
    n = spark.createDataFrame([("u1", "a"), ("u2", "c"), ("u3", "x"), ("u5", "e"), (None, "z")], "url string, hash string")
    assert rows(store.detect_changes(o, n), "url", "state") == [("u1", "unchanged"), ("u2", "changed"), ("u3", "new"), ("u4", "missing"), ("u5", "new")]


def test_changes_of_all_snapshots(spark, data):
    s = spark.createDataFrame([(1, "u1", "a"), (1, "u2", "b"), (2, "u1", "a"), (2, "u3", "c"), (4, "u1", "x"), (4, "u2", "b"), (4, None, "z"), (None, "u1", "q")], "snapshot_no int, url string, hash string")
    want = [(2, "u1", "unchanged"), (2, "u2", "missing"), (2, "u3", "new"), (4, "u1", "changed"), (4, "u2", "new"), (4, "u3", "missing")]
    assert rows(store.detect_all_changes(s), "snapshot_no", "url", "state") == want
    assert store.detect_all_changes(s.filter("snapshot_no = 1")).count() == 0 and store.detect_all_changes(s.limit(0)).count() == 0
    got = queries.change_detection(spark, data)
    s = spark.read.parquet(f"{data}/bylaw_snapshots.parquet")
    two = store.detect_changes(s.filter("snapshot_no = 1"), s.filter("snapshot_no = 2"), "url", "content_sha256")
    assert rows(got.filter("snapshot_no = 2"), "url", "state", "changed") == rows(two, "url", "state", "changed")
    assert rows(got.select("snapshot_no").distinct(), "snapshot_no") == [(2,), (3,), (4,), (5,), (6,)]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/One.TXT").write_text("body", encoding="utf-8")
    (tmp_path / "two.json").write_text('{"title": "", "text": null, "pdf_url": "p"}', encoding="utf-8")
    assert rows(loaders.text_documents(spark, str(tmp_path)), "title", "text", "url") == [("One", "body", None)]
    assert rows(loaders.json_documents(spark, str(tmp_path), "pdf_url"), "title", "text", "url") == [("two", "", "p")]
    assert loaders.html_files(spark, str(tmp_path / "none")).count() == 0


def test_swap_reads_what_it_overwrites(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(3).write.parquet(p)
    assert rows(store.swap(spark.read.parquet(p).withColumn("id", F.col("id") + 1), p), "id") == [(1,), (2,), (3,)]


def test_pdf_policies(spark):
    def pages(data):
        for part in data.decode().split("|"):
            yield None if part == "none" else part

    class Broken:
        def __init__(self):
            self.left = ["a", None, "b"]

        def __iter__(self):
            return self

        def __next__(self):
            if not self.left:
                raise StopIteration
            x = self.left.pop(0)
            if x is None:
                raise ValueError
            return x

    df = spark.createDataFrame([(bytearray(b"x|none|y"),)], "c binary")
    get = lambda policy, read=pages: df.select(loaders.pdf_text(F.col("c"), read, policy).alias("t")).first().t
    assert get("skip_page") == "xy" and get("plain") == "xy" and get("line_per_page") == "x\n\ny"
    broken = lambda _: Broken()
    assert get("skip_page", broken) == "ab" and get("plain", broken) == "" and get("line_per_page", broken) == "a"


def test_fetch(spark):
    def fetch(url):
        if url == "boom":
            raise OSError("down")
        return (200, b"ok") if url == "good" else (404, b"")

    got = loaders.fetched(spark.createDataFrame([("good",), ("good",), ("bad",), ("boom",), (None,)], "u string"), "u", fetch)
    assert rows(got, "url", "http_status", "error") == [("bad", 404, "status 404"), ("boom", None, "down"), ("good", 200, None)]


def test_log_and_notify(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"query": "q", "ai_response": "é"}\n{broken\n{"status": "degraded", "message": "m"}\n', encoding="utf-8")
    got = loaders.read_log(spark, str(tmp_path / "log.jsonl"))
    assert rows(got, "query", "ai_response", "status") == sorted([("q", "é", None), (None, None, None), (None, None, "degraded")], key=str)
    out = tmp_path / "mail.txt"
    assert not store.notify("s", "b", None, str(out)) and out.read_text().startswith("s\nb")
    assert store.notify("s", "b", lambda *_: None, str(out))


def test_stream(spark, tmp_path):
    from clausewright.streaming.log import log_stream, run_available

    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    log = spark.createDataFrame([("ok", "a"), (None, "b")], "status string, query string")
    log.write.json(src)
    run_available(log_stream(spark, src), out, ck)
    log.write.mode("append").json(src)
    run_available(log_stream(spark, src), out, ck)
    assert spark.read.parquet(out).count() == 4


def test_repeats(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, "a", 2.5), (3, "a", 5.6), (4, "b", 2.6), (5, None, 1.0)], "i int, k string, s double").withColumn("at", F.col("s").cast("timestamp"))
    assert rows(activity.repeats_within(df, ["k"], "at", 3), "i") == [(2,)]


def test_components(spark):
    e = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (100, 101), (7, 7), (None, 3), (200, 101)] + [(300, 300 + i) for i in range(1, 50)]
    got = dict(rows(graph.connected_components(spark.createDataFrame(e, "src long, dst long")), "node", "component"))
    assert all(got[i] == 1 for i in range(1, 41)) and got[200] == got[101] == 100 and got[349] == 300 and len(got) == 40 + 3 + 50
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


SNAP = "snapshot_no int, city string, url string, bylaw_title string, content_sha256 string, fetched_at string, http_status int"


def test_snapshots_by_hand(spark):
    day = "2024-01-01T00:00:00Z"
    r = lambda s, u, h, t=day: (s, None, u, None, h, t, 200)
    df = spark.createDataFrame(
        [
            r(1, "HTTP://www.A.example/x/?q#f", "AA"), r(1, "a.example/y", "b"), r(1, "a.example/never", " "), r(1, None, "z"),
            r(2, "https://a.example/x", "aa"), r(2, "https://a.example/never", "n"), r(2, "a.example/late", "1", "2024-01-01T10:00:00+09:00"), r(2, "a.example/late", "2", "2024-01-01T02:00:00Z"), r(2, "a.example/late", "2", "bad"),
            r(3, "a.example/x", None), r(3, "a.example/y", "b"), r(3, "a.example/late", "1"), r(3, "a.example/never", "n"),
            r(4, "a.example/x", "cc"), r(4, "a.example/x", "cc"), r(4, "a.example/y", "b"), r(4, "a.example/late", "1"), r(4, "a.example/never", "n"),
        ],
        SNAP,
    )
    got = {(r.snapshot_no, r.url[18:], r.change) for r in snapshots.snapshot_changes(df.withColumn("ordinal", F.lit(1)).withColumn("block", F.lit(1))).collect()}
    assert got == {(2, "y", "removed"), (2, "late", "added"), (3, "y", "added"), (3, "late", "changed"), (4, "x", "changed")}
    assert snapshots.snapshot_changes(df.limit(0)).count() == 0


def test_ordinals_persist(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(100)] + [(None,)], "url string")
    first = snapshots.assign_ordinals(keys.limit(60), "url")
    second = snapshots.assign_ordinals(keys, "url", first)
    a, b = dict(rows(first, "url", "ordinal")), dict(rows(second, "url", "ordinal"))
    assert len(b) == len(set(b.values())) == 100 and all(b[k] == v for k, v in a.items())


def test_unify(spark):
    from clausewright.sources.unify import legacy, unify, vector_column

    old = spark.createDataFrame([("Chapter 1", "T", "p.pdf", 1, "x", [1.0])], "original_bylaw_id string, title string, pdf_url string, chunk_sequence int, chunk_text string, chunk_embedding_cpu array<float>")
    new = spark.createDataFrame([("c::1", "T", "u", 0, "x", [2.0])], "bylaw_id string, bylaw_title string, url string, chunk_index int, chunk_text string, chunk_embedding array<float>")
    both = unify(old, "bylaw_chunks").unionByName(unify(new, "other"))
    assert rows(both, "bylaw_id", "title", "url", "chunk_index", "embedding") == [("Chapter 1", "T", "p.pdf", 0, [1.0]), ("c::1", "T", "u", 0, [2.0])]
    assert rows(legacy(both), "original_bylaw_id", "chunk_sequence") == [("Chapter 1", 1), ("c::1", 1)]
    assert vector_column("bylaw_chunks") != vector_column("other")


def test_stream_counts(spark, tmp_path):
    from clausewright.streaming.log import log_stream, status_counts

    src = str(tmp_path / "src")
    lines = [("2024-01-01T10:05:00", "A", None), ("2024-01-01T10:50:00", "A", "ok"), ("2024-01-01T11:10:00", "A", "degraded"), ("bad", "A", "ok")]
    spark.createDataFrame(lines, "timestamp string, city string, status string").write.json(src)
    q = status_counts(log_stream(spark, src)).writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.hour, r.status): r.n for r in spark.sql("select hour(w.start) as hour, status, max(n) as n from counts group by all").collect()}
    assert got[10, "ok"] == 2 and got[11, "degraded"] == 1


def test_materialized_tables_are_read_back(spark):
    from clausewright.runtime import materialize

    df = materialize(spark.range(5).withColumn("x", F.array(F.col("id"))))
    assert rows(df, "id") == [(i,) for i in range(5)] and "MapInArrow" not in df._jdf.queryExecution().toString()


def test_swap_survives_a_break(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(3).write.parquet(p + ".last")  # a swap that ended between its two renames
    store.recover(spark, p)
    assert rows(store.swap(spark.read.parquet(p).filter("id > 0"), p), "id") == [(1,), (2,)]
    assert sorted(x.name for x in tmp_path.iterdir()) == ["t"]


def test_sheet_errors_are_told(spark, tmp_path):
    df = spark.createDataFrame([("t", "q,\"\n", None)], "timestamp string, query string, response string")

    def down(_):
        raise OSError("down")

    assert store.append_log_rows(df, down) == "down"
    assert store.append_log_rows(df, store.csv_sheet(str(tmp_path / "s"))) is None


def test_bitmaps_sparse_and_dense():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(snapshots.BLOCK, n, replace=False)) for n in (0, 5, 200, 300, 3000, snapshots.BLOCK)]
    assert {snapshots.Bitmap(s).sparse for s in sets} == {True, False}
    for a in sets:
        for b in sets:
            x, y = snapshots.Bitmap(a), snapshots.Bitmap(b)
            assert x.and_not(y).tolist() == np.setdiff1d(a, b).tolist() and x.both(y).tolist() == np.intersect1d(a, b).tolist()


def test_numbers_with_gaps_and_stored_ordinals(spark, tmp_path):
    day = "2024-01-01T00:00:00Z"
    r = lambda s, u, h: (s, None, u, None, h, day, 200)
    df = spark.createDataFrame([r(20240101, "a.example/x", "1"), r(20240101, "a.example/y", "1"), r(20240301, "a.example/x", "2"), r(20250101, "a.example/y", "1")], SNAP)
    path = str(tmp_path / "ordinals")
    first = snapshots.snapshot_changes(df.filter("snapshot_no < 20240201"), path)
    assert first.count() == 0
    kept = dict(rows(spark.read.parquet(path), "url", "ordinal"))
    got = {(x.snapshot_no, x.url[18:], x.change) for x in snapshots.snapshot_changes(df.unionByName(spark.createDataFrame([r(20250101, "a.example/z", "1")], SNAP)), path).collect()}
    assert got == {(20240301, "x", "changed"), (20240301, "y", "removed"), (20250101, "x", "removed"), (20250101, "y", "added"), (20250101, "z", "added")}
    after = rows(spark.read.parquet(path), "url", "ordinal")
    assert len(after) == 3 and set(kept.items()) <= set(after)


def test_no_temporary_folder_on_a_cluster(spark, monkeypatch):
    import pytest

    from clausewright import runtime

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session())
    path = runtime.new_folder(spark)
    at = runtime.written()
    df = runtime.materialize(spark.range(3))
    assert df.count() == 3
    runtime.release(spark, at)
    import os

    assert runtime.written() == at and path not in os.listdir(runtime.shared_dir(spark))


def test_discarded_tables_are_gone(spark):
    import os

    from clausewright import runtime

    df = runtime.materialize(spark.range(3))
    assert df.count() == 3 and os.path.isdir(df._folder.removeprefix("file:"))
    runtime.discard(df)
    runtime.discard(spark.range(1))
    assert not os.path.isdir(df._folder.removeprefix("file:"))
