from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausewright.llm import boilerplate, leakage, nearcopies, neighbours, packing, pairs, queries, reading, scans, splitting
from conftest import same_rows

@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, data, duck, name):
    df = queries.QUERIES[name](spark, data)
    if name in queries.SQL:
        same_rows(df, duck, queries.SQL[name])
    else:
        rows = df.collect()
        assert len(rows) == len(set(map(str, rows)))


# --- 1 near copies ---------------------------------------------------------------------------------------------------


def _near(spark, rows, **kw):
    df = spark.createDataFrame(rows, "chunk long, txt string").withColumns({"id": F.lit(1), "n": F.lit("x"), "text": F.lit(None).cast("string"), "rep": F.lit(0)})
    links, members = nearcopies.near_copies(df, "chunk", "txt", **kw)
    return links, members


def test_near_copies_brute(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(20, 60))) for _ in range(40)]
    for i in range(60):
        words = texts[rng.randrange(40)].split()
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        if rng.random() < 0.3:
            cut = rng.randrange(len(words))
            words = words[cut:] + words[:cut]
        texts.append(" ".join(words))
    rows = list(enumerate(texts)) + [(3, texts[3]), (500, texts[7]), (501, texts[7]), (502, None), (None, texts[1]), (503, "too short"), (504, "")]
    links, members = _near(spark, rows, threshold=0.6, ngram=3)
    got = {(r.a, r.b) for r in nearcopies.linked_ids(links, members).collect()}
    sets = {}
    for i, t in rows:
        w = nearcopies.WORD.findall((t or "").lower())
        if i is not None and len(w) >= 20:
            sets[i] = frozenset(zip(w, w[1:], w[2:]))
    want = {tuple(sorted(p)) for p in combinations(sets, 2) if len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) >= 0.6}
    assert got <= want
    copies = {(500, 501)}  # of a group of three copies 7 is the representative
    missed = want - got - copies - {p for p in want if 500 in p or 501 in p}
    assert len(missed) <= 0.02 * len(want)
    assert {(7, 500), (7, 501)} <= got
    groups = {r.id: r for r in nearcopies.copy_groups(links, members).collect()}
    assert set(groups) == set(sets) and groups[501].class_id == 7 and groups[501].group_id == groups[7].group_id


def test_hot_keys_are_cut_and_lose_no_pair(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = list(base)
        words[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"o{i}_{k}" for k in range(40))) for i in range(60)]
    run = lambda: {(r.a, r.b) for r in _near(spark, rows, threshold=0.8, ngram=3)[0].collect()}
    whole = run()
    monkeypatch.setattr(nearcopies, "HOT", 10)
    monkeypatch.setattr(nearcopies, "KEY_BUCKETS", 1 << 10)
    posts = spark.createDataFrame([(i, 50, i % 3 if i < 90 else 1000 + i) for i in range(200)], "id long, n int, key long")
    assert {(r.key, r.blocks) for r in nearcopies._hot_keys(posts).collect()} == {(0, 3), (1, 3), (2, 3)}
    assert run() == whole and len(whole) > 6000


def test_near_copies_long_and_empty(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    links, _ = _near(spark, [(1, long), (2, long + " end"), (3, "a " * 50)], threshold=0.8, ngram=5)
    assert [(r.a, r.b) for r in links.collect()] == [(1, 2)]
    links, members = _near(spark, [], threshold=0.8, ngram=5)
    assert links.count() == 0 and nearcopies.linked_ids(links, members).count() == 0 and nearcopies.copy_groups(links, members).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), min_size=3, max_size=60), st.lists(st.sampled_from("abcdef"), min_size=3, max_size=60))
def test_counts_bound_the_difference(a, b):
    doc, h = nearcopies.ngram_hashes([a, b], 3)
    x, y = (np.bincount((h[doc == i] >> np.uint64(58)).astype(int), minlength=64) for i in (0, 1))
    assert np.abs(x - y).sum() <= len(set(h[doc == 0].tolist()) ^ set(h[doc == 1].tolist()))


# --- 3 splitting -----------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab. \n!x", max_size=600), st.integers(20, 90))
def test_pieces_round_trip(text, size):
    overlap = size // 4
    pieces = splitting.split_text(text, size, overlap)
    assert all(len(p) <= size for p in pieces)
    assert "".join(p if not i else p[overlap:] for i, p in enumerate(pieces)) == text
    assert all(b[:overlap] == (text[: text.find(text)] + "".join(p if not j else p[overlap:] for j, p in enumerate(pieces[: i + 1])))[-overlap:] for i, b in enumerate(pieces[1:]) if overlap)


def test_pieces_cut_at_boundaries(spark):
    text = ("word " * 100).strip() + ".\n\n" + ("next " * 110).strip()
    assert splitting.split_text(text)[1][150:].startswith("next")
    assert len(splitting.split_text("x" * 100_000)) > 117
    df = spark.createDataFrame([(1, "a" * 1000 + "  \t "), (2, "\U0001f3db" * 1001), (3, None), (4, ""), (2, "\U0001f3db" * 1001), (5, "b\r\n" * 500)], "k long, body string").withColumn("chunk_index", F.lit(9))
    got = splitting.split_oversized(df, ["k"], "body").distinct().collect()
    assert {r.k for r in got} == {2} and sorted(len(r.chunk_text) for r in got) == [500, 651]
    assert splitting.split_oversized(df.limit(0), ["k"], "body").count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df, ["k"], "body", 100, 30)


def test_no_cut_inside_a_word_while_there_is_white_space():
    text = "a" * 200 + " " + "b" * 805
    pieces = splitting.split_text(text)
    assert [len(p) for p in pieces] == [201, 955] and pieces[1][150:] == "b" * 805
    assert [len(p) for p in splitting.split_text("a" * 100 + " " + "b" * 905)] == [503, 653]  # the first would not exceed the overlap


# --- 4 vectors -------------------------------------------------------------------------------------------------------


def test_neighbours_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    v = centres[rng.integers(0, 60, 1500)] + rng.normal(size=(1500, 16)) * 0.25
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    bad = [(9000, [0.0] * 16), (9001, None), (9002, [1.0] * 3), (9003, [float("nan")] * 16), (9004, [None] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + bad + rows[:5], "vid long, v array<double>").withColumns({"id": F.lit(0), "vec": F.lit(0), "other": F.lit(0)})
    got = neighbours.similar_vectors(df, "vid", "v", dim=16, k=5).collect()
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(1500) for j in np.argsort(-s[i])[:5]}
    assert len(want & {(r.id, r.other) for r in got}) >= 0.9 * len(want)
    assert max(abs(r.similarity - s[r.id, r.other]) for r in got) < 1e-5
    counts = {}
    for r in got:
        counts[r.id] = counts.get(r.id, 0) + 1
    assert max(counts.values()) == 5 and all(r.id != r.other for r in got)


def test_equal_vectors_and_hot_file(spark):
    rng = np.random.default_rng(2)
    hot = rng.normal(size=8)
    rows = [(i, [float(x) for x in hot]) for i in range(1000)] + [(2000 + i, [float(x) for x in rng.normal(size=8)]) for i in range(50)]
    got = neighbours.similar_vectors(spark.createDataFrame(rows, "vid long, v array<double>"), "vid", "v", dim=8, k=5, min_similarity=0.99).collect()
    of = {}
    for r in got:
        of.setdefault(r.id, []).append(r.other)
    assert all(sorted(of[i]) == [j for j in range(7) if j != i][:5] for i in range(1000))
    near = [(i, [float(x) for x in hot + rng.normal(size=8) * 1e-3]) for i in range(5000)]  # one inverted file
    got = neighbours.similar_vectors(spark.createDataFrame(near, "vid long, v array<double>"), "vid", "v", dim=8, k=5)
    assert got.groupBy("id").count().filter("count = 5").count() == 5000
    assert neighbours.similar_vectors(spark.createDataFrame([], "vid long, v array<double>"), "vid", "v", dim=8).count() == 0
    assert neighbours.similar_vectors(spark.createDataFrame(rows[:1], "vid long, v array<double>"), "vid", "v", dim=8).count() == 0


def _recall(spark, v, of=None):
    """Share of the true five neighbours of the rows `of` (all without it) that are found."""
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vid long, v array<double>")
    got = {(r.id, r.other) for r in neighbours.similar_vectors(df, "vid", "v", dim=v.shape[1], k=5).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(int(i), int(j)) for i in (range(len(v)) if of is None else of) for j in np.argpartition(-s[i], 5)[:5]}
    return len(want & got) / len(want)


def test_neighbours_recall_without_close_copies(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32))
    v = centres[rng.integers(0, 60, 4000)] + rng.normal(size=(4000, 32)) * 0.8
    assert _recall(spark, v) >= 0.9


def test_hot_file_of_edited_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    hot = rng.normal(size=64)
    v = np.concatenate([rng.normal(size=(1500, 64)), hot / np.linalg.norm(hot) + rng.normal(size=(7000, 64)) * 0.02])
    rng.shuffle(v)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    of = np.flatnonzero(u @ hot / np.linalg.norm(hot) > 0.8)
    assert len(of) == 7000
    assert _recall(spark, v, of) >= 0.9
    monkeypatch.setattr(neighbours, "UNIT", 2000)  # units cut into blocks
    assert _recall(spark, v, of) >= 0.9


# --- 5 pairs ---------------------------------------------------------------------------------------------------------

Q = "How tall can a fence be on Elm Road?"


@pytest.mark.parametrize(
    ("query", "response", "want"),
    [
        (Q, None, "empty"), (Q, " <br/>​ ", "empty"), (Q, "N/A", "empty"), (Q, "{}", "empty"), (Q, "**", "empty"),
        (Q, "You asked: " + Q.upper(), "copies_question"), (Q, f"Q: {Q}\nA: {Q}", "copies_question"), (Q, Q + " It may be two metres tall.", None),
        (Q, "I'm sorry, but I can't help with that request. Please contact a lawyer.", "refusal"), (Q, "I cannot provide legal advice. The fence may be two metres tall.", None),
        (Q, "Sorry to hear about the trouble; the Clerk can send an inspector.", None), ("Puis-je construire la haie ?", "Je ne suis pas en mesure de vous aider à ce sujet.", "refusal"),
        (Q, "Le propriétaire doit entretenir le balcon et présenter un plan dans un délai de 10 jours.", "other_language"), (Q, "Lo siento, no puedo responder a esa pregunta de la ley.", "other_language"),
        (Q, "Der Eigentümer muss die Hecke pflegen und innerhalb von 17 Tagen einen Plan vorlegen.", "other_language"),
        (Q, " ".join([Q] * 12), "copies_question"), (Q, "Q: How tall may a fence be on Elm Road?", "copies_question"), (Q, "How tall can a fence be on Elm Road? Two metres.", None), (Q, "A fence on Elm Road can be two metres tall.", None),
        ("Burn leaves?", "You asked: burn leaves?", "copies_question"), ("Can I burn leaves?", "You can burn leaves.", None),
        (Q, "That request will have to go unanswered.", "refusal"), ("Wie hoch darf ein Zaun an der Elm Road sein?", "Das kann ich leider nicht sagen, tut mir leid.", "refusal"), ("Какой высоты может быть забор?", "Извините, я не могу ответить на этот вопрос.", "refusal"),
        ("栅栏可以有多高?", "The fence may be two metres tall at most.", "other_language"), (Q, "栅栏最高两米。", "other_language"), ("Какой высоты может быть забор?", "Забор может быть высотой до двух метров.", None),
        (Q, "The permit stays val-", "truncated"), (Q, "The fence may be tall (see Section 4", "truncated"), (Q, "The fence is fine. See https://a.example/bylaws/elm", None),
    ],
)
def test_labels(query, response, want):
    if pairs.is_empty(response):
        got = "empty"
    elif pairs.is_copy(query, response):
        got = "copies_question"
    elif pairs.speaks_otherwise(query, response):
        got = "other_language"
    elif pairs.is_refusal(response):
        got = "refusal"
    else:
        got = "truncated" if pairs.tail_keys(response) == [] else None
    assert got == want


def test_truncation_is_learned(spark):
    full = [f"The fee is ${i}.00 and is paid to the Clerk. Please bring the site plan to the office. You have ten days to correct the problem before a penalty applies." for i in range(30)]
    rows = [(i, Q, t, "ok") for i, t in enumerate(full)]
    rows += [(100, Q, full[0][:-1], "OK "), (101, Q, "The fee is $5.00 and is paid to the", None), (102, Q, "Please bring the site pl", "ok"), (103, Q, "Please bring the site plan to the", "degraded"), (104, " ", None, "ok"), (105, None, None, "ok"), (None, Q, None, "ok"), (106, Q, None, "ok"), (106, Q, None, "ok"), (107, Q, "x " * 50_000 + "end.", "ok")]
    df = spark.createDataFrame(rows, "log long, q string, a string, s string").withColumns({"id": F.lit(1), "query": F.lit("z"), "kind": F.lit("z")})
    call = lambda d: {(r.id, r.defect) for r in pairs.broken_pairs(d, id_col="log", query="q", response="a", status="s").collect()}
    assert call(df) == {(101, "truncated"), (102, "truncated"), (106, "empty")}
    assert call(df.limit(0)) == set()


# --- 6 boilerplate ---------------------------------------------------------------------------------------------------


def test_site_lines(spark):
    legal, share = "Retrieved from the {} library on 2020", "Share this page with your friends now"
    rows = []
    for i in range(10):
        rows.append((i, f"b{i}", " Port ", f"own line number {'abcdefghij'[i] * 3} stays\n{legal.format('Port')}-{i}\n{share}\nend of text here {'abcdefghij'[i] * 4}"))
    rows += [(20, "b20", "PORT", f"{share.upper()}!\nx"), (20, "b20", "PORT", f"{share.upper()}!\nx"), (21, "b21", "Else", f"{share}\nkeep"), (22, "b22", None, share), (23, None, "Port", share), (24, "b24", "Port", None), (25, "b25", "Port", ""), (26, "b26", "Port", share)]
    df = spark.createDataFrame(rows, "chunk long, law string, place string, body string").withColumns({"doc": F.lit(1), "grp": F.lit(1), "k1": F.lit(1), "key": F.lit(1)})
    blocks, found = boilerplate.site_lines(df, "chunk", "law", "place", "body")
    got = {(r.doc, r.line_no) for r in found.select("doc", "line_no").distinct().collect()}
    assert got == {(i, n) for i in range(10) for n in (2, 3)} | {(20, 1), (26, 1)}
    blocks = blocks.collect()
    assert len(blocks) == 2 and len({r.block for r in blocks}) == 1
    clean = {r.doc: r.text for r in boilerplate.remove_lines(df, "chunk", "body", found).collect()}
    assert clean[0] == "own line number aaa stays\nend of text here aaaa" and clean[20] == "x" and clean[26] == "" and clean[24] is None and clean[25] == "" and clean[21] == f"{share}\nkeep"
    blocks, found = boilerplate.site_lines(df.limit(0), "chunk", "law", "place", "body")
    assert found.count() == 0 and blocks.count() == 0


# --- 7 scans ---------------------------------------------------------------------------------------------------------

TITLE = "Noise Control (Elm Park) By-law"
BODY = "The officer may require the owner to submit a heritage statement where the semi-detached market stall was lawfully maintained before this part came into force."


def test_scan_repair(spark):
    noisy = "The offi-\ncer may require tbe owner to submit a heritage staternent where the semi-\ndetached market stall\nNOISE CONTROL (ELM PARK) BY-LAW\nPage 3 of 9\nwas lawfu11y main¬\ntained before this part came into force."
    rows = [("chunk", i, BODY, None, None, None, None) for i in range(60)]
    rows += [("chunk", 100, noisy, None, "2001-5", "Port", "b1"), ("chunk", 100, noisy, None, "2001-5", "Port", "b1"), ("bylaw", 1, None, TITLE, None, None, None), ("bylaw", 2, "", TITLE, None, None, None), ("bylaw", None, "x", None, None, None, None), ("bylaw", 3, TITLE + "\n" + BODY, TITLE, None, None, None), ("bylaw", 4, BODY + " " + "long words here " * 20_000, None, None, None, None)]
    df = spark.createDataFrame(rows, "item_kind string, item_id long, text string, title string, number string, city string, bylaw_id string").withColumns({"noise": F.lit(0), "n": F.lit(0), "title2": F.lit("clash")})
    titles = spark.createDataFrame([("b1", TITLE), ("b1", TITLE), (None, "x")], "bylaw_id string, title2 string")
    got = {(r.item_kind, r.item_id): r for r in scans.repair_scans(df, titles).collect()}
    assert got["chunk", 100].text == BODY.replace("The officer", "The officer") and got["chunk", 100].noise == ["hyphen_break", "misread", "page_number", "running_header"]
    assert got["chunk", 5].noise == [] and got["bylaw", 3].noise == [] and got["bylaw", 4].noise == []
    assert got["bylaw", 1].text == "" and got["bylaw", 2].noise == [] and len(got) == 65
    assert scans.repair_scans(df.limit(0), titles).count() == 0


@pytest.mark.parametrize("line", ["12", "- 3 -", "— 31 —", "p. 4", "Page 5", "PAGE 6", "7 | Page", "[8]", "106/138", "Page 2 of 3", "xiv"])
def test_page_marks(line):
    assert scans.is_page_mark(line)


@pytest.mark.parametrize("line", ["", "Reserved.", "metres.", "$5.00", "[Repealed]", "Schedule E3", "in 1998", "—"])
def test_no_page_marks(line):
    assert not scans.is_page_mark(line)


def test_readings_undo_confusions():
    assert "within" in scans.readings("w!thin") and "metres" in scans.readings("rnetres") and "shall" in scans.readings("sliall") and "decision" in scans.readings("deci5i0n")
    assert scans.readings("w2thin") == {} and [scans.CONFUSIONS[i] for i in scans.readings("w!thin")["within"]] == [("!", "i")]


def _texts(spark, rows):
    return spark.createDataFrame([("chunk", i, *r, None, None) for i, r in enumerate(rows)], "item_kind string, item_id long, text string, title string, number string, city string, bylaw_id string")


def test_no_length_hides_noise(spark):
    title = " ".join(f"regulation{i}" for i in range(40))  # a header of more than 200 characters
    body = [("The committee adopts policies and regulations for the administration of antidisestablishmentarianismcommissions in town.", None, None)] * 20
    noisy = [
        ("The first line stands here\n" + " " * 70 + "12\nand the committee goes on.", None, None), ("The first line stands here\n" + title + "\nand the committee goes on.", title, None),
        ("The committee adopts p0|i(ie5 and goes on.", None, None), ("The com-\r\nmittee adopts policies.", None, None), ("of ant1d1sestabl1shmentar1an1smcomm1ss1ons in town", None, None),
    ]
    df = _texts(spark, body + noisy)
    got = {r.item_id: (r.noise, r.text) for r in scans.repair_scans(df, reflow=False).collect()}
    assert got[20][0] == ["page_number"] and got[21][0] == ["running_header"] and got[23][0] == ["hyphen_break"]
    assert got[22] == (["misread"], "The committee adopts policies and goes on.") and got[24][1] == "of antidisestablishmentarianismcommissions in town"
    assert all(got[i][0] == [] for i in range(20))


def test_a_filter_that_lets_all_through_changes_nothing(spark, data):
    items = queries.text_items(spark, data)
    run = lambda bits: set(map(str, scans.repair_scans(items, most_bits=bits).select("item_kind", "item_id", "text", "noise").collect()))
    assert run(1 << 26) == run(1 << 13)


def test_injected_noise_is_repaired(spark, data):
    """Clean texts with known noise put in: nearly all of it is undone, and little else changes."""
    rng = random.Random(11)
    clean = [r.chunk_text for r in spark.read.parquet(f"{data}/bylaw_chunks.parquet").filter("length(chunk_text) between 200 and 1500").select("chunk_text").distinct().orderBy("chunk_text").collect()]
    before = {r.item_id for r in scans.repair_scans(_texts(spark, [(t, None, None) for t in clean]), reflow=False).filter("size(noise) > 0").select("item_id").collect()}
    clean = [t for i, t in enumerate(clean) if i not in before]
    noisy, put, words = list(clean), {}, 0
    for i in range(0, len(clean), 3):
        tokens = clean[i].split(" ")
        spots = [k for k, t in enumerate(tokens) if t.isalpha() and t.islower() and len(t) > 5]
        for k in rng.sample(spots, min(2, len(spots))):
            w = tokens[k]
            wrong = next((w.replace(b, a, 1) for a, b in (("rn", "m"), ("1", "l"), ("5", "s"), ("0", "o"), ("li", "h")) if b in w), w)
            tokens[k] = w[:3] + "-\n" + w[3:] if rng.random() < 0.4 else wrong
            if tokens[k] != w:
                put.setdefault(i, []).append((k, w))
        noisy[i] = " ".join(tokens)
    got = {r.item_id: r.text for r in scans.repair_scans(_texts(spark, [(t, None, None) for t in noisy]), reflow=False).collect()}
    right = sum(got[i].split(" ")[k] == w for i, spots in put.items() for k, w in spots)
    total = sum(map(len, put.values()))
    harmed = sum(a != b for i, t in enumerate(clean) for k, (a, b) in enumerate(zip(t.split(" "), got[i].split(" "))) if k not in {k for k, _ in put.get(i, ())})
    print("repaired", right, "of", total, "harmed", harmed)
    assert total > 50 and right >= 0.9 * total and harmed <= 0.02 * total


def test_doubtful_neighbours_are_decoded_together():
    fixes = {"tbe": [("the", 1.0)], "cat": [("eat", -0.5)], "hat": [("bat", -0.5)]}
    pairs = {("the", "cat"): 40, ("the", "eat"): 0, ("tbe", "cat"): 1, ("cat", "sat"): 30}
    d = scans.Decoder(fixes, pairs, {"the": 100, "tbe": 1, "cat": 50})
    assert d.line("Tbe cat sat") == ("The cat sat", True)
    assert set(d.asked("tbe cat sat")) == {("tbe", "cat"), ("tbe", "eat"), ("the", "cat"), ("the", "eat"), ("cat", "sat"), ("eat", "sat")}


def test_confusions_are_estimated(spark):
    good = "The committee requires a separate statement before the meeting of the members"
    rows = [(good, None, None)] * 2000 + [(good.replace("meeting", "rneeting"), None, None), (good.replace("members", "rnembers"), None, None), (good.replace("statement", "5tatement"), None, None)]
    df = _texts(spark, rows)
    counted = df.mapInArrow(scans._count, "l string, r string, n bigint").groupBy("l", "r").agg(F.sum("n").alias("n"))
    words = counted.filter("l = ''").select(F.col("r").alias("word"), "n")
    known = words.filter("n >= 3").select(F.col("word").alias("cand"), F.col("n").alias("cn"))
    weights = scans.confusion_weights(words.mapInArrow(scans._propose, "word string, n bigint, cand string, edits array<int>").join(known, "cand"), words)
    of = dict(zip(scans.CONFUSIONS, weights))
    assert of["rn", "m"] > of["nn", "m"] and of["5", "s"] > of["$", "s"] and max(weights) < 0
    assert scans.confusion_weights(words.limit(0).mapInArrow(scans._propose, "word string, n bigint, cand string, edits array<int>").join(known, "cand"), words.limit(0)) == [np.log(0.01)] * len(weights)


# --- 8 packing -------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 100), st.sampled_from("abc"), st.one_of(st.none(), st.integers(0, 12))), max_size=80))
def test_bins(items):
    bins = packing.pack([n for n, _, _ in items], [s for _, s, _ in items], [c for _, _, c in items], 100)
    load, held = {}, {}
    for (n, _, c), b in zip(items, bins):
        load[b] = load.get(b, 0) + n
        held.setdefault(b, []).append(c)
    assert len(bins) == len(items) and all(v <= 100 for v in load.values())
    for cs in held.values():
        named = [c for c in cs if c is not None]
        assert len(named) == len(set(named))
    if not any(c is not None for _, _, c in items):
        assert len(load) <= 2 * (sum(load.values()) // 100 + 1)


def test_hot_cluster_is_kept_apart_and_packed_around():
    rng = random.Random(2)
    sizes = [rng.randint(5, 30) for _ in range(9000)]
    cluster = [0 if i % 3 == 0 else None if i % 3 == 1 else i for i in range(9000)]
    bins = packing.pack(sizes, ["s"] * 9000, cluster, 100)
    hot = [b for b, c in zip(bins, cluster) if c == 0]
    assert len(hot) == len(set(hot)) == 3000 and max(bins) + 1 == 3000  # as many as the cluster needs
    assert packing.pack([10] * 6, list("abcdef"), [1] * 6, 100) == [0, 1, 2, 3, 4, 5]


def test_packing_documents(spark):
    rows = [(i, "word " * (i * 7 % 300), f"s{i % 3}") for i in range(400)] + [(1000, "token " * 5000, "s1"), (1001, None, None), (1002, "", "s0"), (None, "x", "s0"), (5, "word " * 35, "s2")]
    rows += [(2000 + i, "the same text again and again " * 40, "hot") for i in range(20)]
    df = spark.createDataFrame(rows, "d long, body string, origin string").withColumns({"doc_id": F.lit(1), "text": F.lit("x"), "source": F.lit(2), "slot": F.lit(3)})
    got = packing.pack_documents(df, doc="d", text="body", source="origin").collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == {r[0] for r in rows if r[0] is not None}
    assert all(len(v) == 1 for k, v in by_doc.items() if k != 1000) and len(by_doc[1000]) == 3
    load = {}
    for r in got:
        load[r.input_no] = load.get(r.input_no, 0) + r.n_tokens
    assert max(load.values()) <= 2048 and sum(load.values()) / 2048 / len(load) > 0.95
    assert len({r.input_no for r in got if r.doc_id >= 2000}) == 20
    near = spark.createDataFrame([(i, 7) for i in range(100, 120)] + [(100, 7), (None, 7), (9999, 7)], "id long, cluster long")
    got = packing.pack_documents(df, doc="d", text="body", source="origin", clusters=near).collect()
    assert len({r.input_no for r in got if 100 <= r.doc_id < 120}) == 20 and len({r.input_no for r in got if r.doc_id >= 2000}) == 20
    assert packing.pack_documents(df.limit(0), doc="d", text="body", source="origin").count() == 0


def test_copies_stay_apart():
    bins = packing.pack([10] * 6, ["a", "b", "c", "d", "e", "f"], [1, 1, 1, 2, 2, 2], 20)
    assert len(set(bins)) == 3 and all(sorted([i // 3 for i in range(6) if bins[i] == b]) == [0, 1] for b in set(bins))


# --- 9 leaks ---------------------------------------------------------------------------------------------------------


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_wand_finds_all(seed):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(rng.choice([6, 40]))]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(3, 30)))) for i in range(50)]
    index = leakage.ItemIndex(items, 4)
    doc = " ".join(rng.choices(vocab, k=60)) + " " + " ".join(items[7][1].split()[:9])
    words = doc.split()
    runs = {tuple(words[i : i + 4]) for i in range(len(words) - 3)}
    want = [i for i, t in items if any(tuple(t.split()[k : k + 4]) in runs for k in range(len(t.split()) - 3))]
    assert index.leaks(doc, 9) == want


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, "x " * 300 + item.upper().replace(" ", ", ")), (2, " ".join(item.split()[:11])), (3, None), (4, ""), (None, item), (1, item), (5, ("filler " * 100_000) + " ".join(item.split()[1:])), (6, "zero " + item)]
    df = spark.createDataFrame(docs, "n long, body string").withColumns({"d": F.lit(1), "x": F.lit("y"), "item_id": F.lit(1)})
    items = spark.createDataFrame([(10, item), (11, "short item"), (12, None), (None, item), (13, item), (13, item)], "i long, t string")
    run = lambda **kw: {(r.doc_id, r.item_id) for r in leakage.leaked_items(df, items, doc="n", text="body", item="i", item_text="t", **kw).collect()}
    want = {(d, i) for d in (1, 5, 6) for i in (10, 13)}
    assert run() == want and run(block_chars=40) == want
    empty = items.limit(0)
    assert leakage.leaked_items(df, empty, doc="n", text="body", item="i", item_text="t").count() == 0


# --- 10 reading levels -----------------------------------------------------------------------------------------------


def test_reading_levels(spark):
    rng = random.Random(3)
    easy = ["The dog is at the gate.", "We like the red ball.", "Do not run on the wet road."]
    middle = ["Residents should apply at the planning counter before starting any work.", "A permit usually costs less for community groups in the town."]
    hard = ["Notwithstanding the foregoing, every encumbrance registered against the hereditaments shall be construed in subordination thereto.", "Any authorization conferred hereunder constitutes a revocable privilege conditional upon the covenants herein."]
    docs, labels = [], []
    for i in range(240):
        level, pool = ((1, easy), (3, middle), (5, hard))[i % 3]
        docs.append((i, " ".join(rng.choice(pool) for _ in range(12)), level))
        if i < 90:
            labels += [(i, level, "r"), (i, level, "s")]
    labels += [(5, None, "x"), (99_999, 3, "x"), (3, 9, "x"), (None, 1, "x")]
    rows = [(i, t) for i, t, _ in docs] + [(500, None), (501, ""), (0, docs[0][1]), (None, "x"), (502, docs[2][1] * 300)]
    df = spark.createDataFrame(rows, "d long, t string").withColumns({"doc_id": F.lit(1), "theta": F.lit(1), "text": F.lit(1)})
    lab = spark.createDataFrame(labels, "d long, l int, rater string")
    got = {r.doc_id: r for r in reading.reading_levels(df, lab, doc="d", text="t", level="l").collect()}
    held = [(i, level) for i, _, level in docs if i >= 90]
    assert sum(got[i].reading_level == level for i, level in held) >= 0.95 * len(held)
    assert got[500].reading_level == 3 and got[501].n_words == 0 and got[502].reading_level == 5 and len(got) == 243
    assert {r.reading_level for r in reading.reading_levels(df.limit(30), lab.limit(0), doc="d", text="t", level="l").collect()} == {3}
    assert reading.reading_levels(df.limit(0), lab, doc="d", text="t", level="l").count() == 0


def test_nothing_else_imports_this_subpackage():
    from pathlib import Path

    root = Path(queries.__file__).resolve().parents[2]
    for f in (root / "clausewright").rglob("*.py"):
        if "llm" not in f.relative_to(root / "clausewright").parts:
            assert not re.search(r"clausewright\.llm|from \.+llm", f.read_text(encoding="utf-8")), f


def test_footrule_is_the_distance_of_truncated_orders():
    rng = np.random.default_rng(8)
    perm = np.array([rng.permutation(12)[:5] for _ in range(30)]) * 7
    d = neighbours._footrule(*neighbours._weights(perm))

    def brute(a, b):
        place = lambda x, p: int(np.flatnonzero(x == p)[0]) if p in x else 5
        return sum(abs(place(a, p) - place(b, p)) for p in set(a) | set(b))

    assert (d == np.array([[brute(a, b) for b in perm] for a in perm])).all()


def test_neighbours_do_not_depend_on_the_partitions(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(rng.normal(size=(600, 16)))]
    df = spark.createDataFrame(rows, "vid long, v array<double>")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append({(r.id, r.other) for r in neighbours.similar_vectors(df.repartition(n), "vid", "v", dim=16, k=5).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and len(got[0]) == 3000


def test_levels_settle_and_do_not_depend_on_the_partitions(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/reading_labels.parquet")
    out = []
    for n in (2, 9):
        told = []
        got = reading.reading_levels(docs.repartition(n), labels, doc="doc_id", text="text", level="reading_level", told=told)
        out.append({r.doc_id: (round(r.theta, 2), r.reading_level) for r in got.collect()})
        assert told[-1]["moved"] < 0.05 and told[-1]["log_likelihood"] > told[0]["log_likelihood"]
    assert sum(out[0][d] == out[1][d] for d in out[0]) >= 0.98 * len(out[0]) and len(out[0]) == len(out[1])


def test_difficulty_of_a_word_is_found():
    rng = np.random.default_rng(5)
    exposure = np.full(len(reading.GRID), 20_000.0)
    t = reading.GRID - reading.CENTRE
    true = np.array([[-6.0, 0.8, -0.3], [-5.0, -0.9, -0.2], [-4.0, 0.0, 0.0]])
    counts = rng.poisson(np.exp(true[:, [0]] + true[:, [1]] * t + true[:, [2]] * t * t) * exposure)
    batch = reading.pa.record_batch([reading.pa.array([0, 1, 2]), *(reading.pa.array(c.astype(float)) for c in counts.T)], names=["bucket", *reading.COUNTS])
    (got,) = reading._fitter(exposure)(iter([batch]))
    assert np.abs(np.stack([got.column(c).to_numpy() for c in "cab"], 1) - true).max() < 0.15


def test_levels_have_increasing_bounds():
    theta = np.array([1.0, 1.1, 2.0, 2.2, 3.0, 4.1, 4.2, 4.9, 5.0])
    cuts = reading._cuts(theta, np.array([1, 1, 2, 2, 3, 4, 4, 5, 5.0]))
    assert cuts == sorted(cuts) and [sum(t > c for c in cuts) + 1 for t in theta] == [1, 1, 2, 2, 3, 4, 4, 5, 5]
    assert reading._cuts(np.zeros(0), np.zeros(0)) == [1.5, 2.5, 3.5, 4.5]
