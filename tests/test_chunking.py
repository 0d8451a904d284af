from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausewright.operators import chunking


def windows(text, size, overlap):
    out, at = [], 0
    while text:
        out.append(text[at : at + size])
        if at + size >= len(text):
            return out
        at += size - overlap
    return out


def test_fixed_edges(spark):
    texts = ["", "x", "y" * 1000, "y" * 1001, "z" * 1900, "z" * 1901, "\U0001f3db" * 1500, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunking.fixed_chunks(F.col("t"), 1000, 100).alias("c"))
    for r in df.collect():
        assert r.c == windows(texts[r.i] or "", 1000, 100)
    with pytest.raises(ValueError):
        chunking.fixed_chunks(F.col("t"), 100, 100)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=10), st.integers(1, 20), st.data())
def test_fixed_covers(spark, texts, size, draw):
    overlap = draw.draw(st.integers(0, size - 1))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunking.fixed_chunks(F.col("t"), size, overlap).alias("c")).collect()
    assert all(r.c == windows(r.t, size, overlap) for r in rows)


def test_packing_by_hand():
    p = lambda n: "a" * n
    assert [len(x) for x in chunking.pack("\n\n".join(map(p, (700, 3000, 10))))] == [700, 3000, 10]
    assert [len(x) for x in chunking.pack(f"{p(500)}\n\n{p(499)}")] == [1001]
    assert [len(x) for x in chunking.pack(p(1500))] == [1000, 500]
    assert chunking.pack(" \r\n\t ") == [] and chunking.pack(None) == []
    assert chunking.pack("a\r\nb\t\tc") == ["a\nb c"]
    long = p(650) + ". " + p(1200)
    assert [len(x) for x in chunking.pack(p(300) + "\n\n" + long)] == [952, 1200]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. !?\n\t", max_size=400), st.integers(5, 60))
def test_packing_loses_nothing(text, target):
    chunks = chunking.pack(text, target, target // 2)
    assert "".join("".join(chunks).split()) == "".join(text.split())
    assert all(c.strip() for c in chunks)


def test_overlap_comes_from_the_original(spark):
    df = spark.createDataFrame([(1, 0, "aaaa"), (1, 1, "bbbb"), (1, 2, "cccc"), (2, 0, "dddd")], "k int, chunk_index int, chunk_text string")
    got = {(r.k, r.chunk_index): r.chunk_text for r in chunking.with_overlap(df, "k", 2).collect()}
    assert got == {(1, 0): "aaaa", (1, 1): "aa\nbbbb", (1, 2): "bb\ncccc", (2, 0): "dddd"}
    assert {r.chunk_text for r in chunking.with_overlap(df, "k", 0).collect()} == {"aaaa", "bbbb", "cccc", "dddd"}
