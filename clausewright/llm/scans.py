"""Repairing text read from scanned pages (problem 7).

Page marks and running headers are taken out, words split over line ends joined, and misread words corrected by a
noisy channel: the probability of the character confusions times the n-gram likelihood of the words in the corpus,
decoded by Viterbi over the candidate words of each line. Confusions, words, split words and the contexts of all
candidates are counted over all texts.

Nothing that grows with the texts is collected or sent to tasks: each text gets its own candidates and counts by
joins. What the joins need is sifted out of the texts by a Bloom filter of bounded size; what it lets through in vain
the joins drop.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm.bloom import BLOOM_BITS, Bloom, bloom, hashes_of_pairs, hashes_of_words, mix, pair_hash, word_hash
from clausewright.runtime import materialize

# What recognition reads, and what stood there.
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("!", "i"), ("!", "l"), ("5", "s"), ("$", "s"), ("6", "b"), ("8", "b"), ("9", "g"),
    ("(", "c"), ("é", "e"), ("è", "e"), ("rn", "m"), ("m", "rn"), ("nn", "m"), ("li", "h"), ("h", "li"), ("ii", "u"), ("ii", "n"), ("vv", "w"),
    ("cl", "d"), ("d", "cl"), ("b", "h"), ("h", "b"), ("c", "e"), ("e", "c"), ("i", "t"), ("t", "i"), ("l", "i"), ("i", "l"), ("l", "t"), ("t", "l"),
    ("f", "t"), ("t", "f"), ("u", "n"), ("n", "u"), ("n", "ri"), ("ri", "n"), ("o", "a"), ("a", "o"), ("tl", "d"), ("fi", "h"), ("y", "v"), ("v", "y"), ("q", "g"), ("g", "q"),
]
#: Characters that no word holds: a word with one is hardly ever meant.
STRANGE = re.compile(r"[0-9|!$(éè]")
SIGNS = "-\u00ad\u00ac\u2010\u2011"
ROMAN = "(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_PAGE_START = re.compile(r"\s*[-–—\[(|pPsS0-9ivxlcIVXLC]")
PAGE = re.compile(rf"(?:[-–—\[(|]*\s*)?(?:(?:page|p|pg|seite)\.?\s*)?(?:\d{{1,5}}|{ROMAN})(?:\s*(?:/|of)\s*\d{{1,5}})?(?:\s*[|]\s*page)?(?:\s*[-–—\])|]*)?", re.I)
HEADER_WORDS = {"by", "law", "bylaw", "municipal", "code", "continued", "cont", "chapter", "page", "p", "no", "number", "of", "city", "town", "the"}
WORD = re.compile(r"[a-z0-9]+")
BREAK = re.compile(rf"([^\W\d_][\w'|!(\-]*)[{SIGNS}][ ]*\n[ ]*([\w|!(][\w'|!(\-]*)")
HYPHEN = re.compile(rf"[{SIGNS}][ ]*\n")
TOKEN = re.compile(r"\S+")
EDGES = ".,;:\"'“”‘’…)]}*?"
#: Probability of a confusion on the whole; how it is shared among them is estimated from the texts.
P_CONFUSION = 0.01
#: So many confusions weigh as much as the assumption that all are equally likely.
SURE = 20
#: Probability that a word with a strange character is meant.
P_STRANGE = 1e-4
#: A word that stands in the texts so often may be what a misreading hides.
LEXICON_MIN = 3
_CORES: dict[str, str] = {}


def core(token: str) -> str:
    """The token in lower case without outer punctuation; '' if it is no word. An opening bracket before a word of its own is punctuation."""
    t = token.lower().rstrip(EDGES).lstrip("\"'“‘[{*#>")
    if t.startswith("(") and (")" in token or len(t) < 3):
        t = t[1:]
    t = t.rstrip("!|") if len(t.rstrip("!|")) > 5 and t.endswith("!") and token.endswith("!") else t
    return t if any(c.isalpha() for c in t) else ""


def plain(word: str) -> bool:
    """A word of letters, or letters with strange characters between them, and not a number or code."""
    letters = sum(c.isalpha() for c in word)
    return len(word) > 2 and letters >= 2 and letters * 2 > len(word) and "-" not in word and "/" not in word


def is_page_mark(line: str) -> bool:
    s = line.strip()
    return bool(PAGE.fullmatch(s)) and any(c.isalnum() for c in s)


def is_header(line: str, titles: list[list[str]], number: str | None, city: list[str]) -> bool:
    """A line of little else than the title, or the number with little else."""
    return _is_header(line, titles, number, HEADER_WORDS.union(city, WORD.findall((number or "").lower())))


def _is_header(line: str, titles: list[list[str]], number: str | None, known: set[str]) -> bool:
    low = line.lower()
    words = WORD.findall(low)
    other = sum(w not in known and not w.isdigit() for w in words)
    for title in titles:
        if len(title) >= 2 and other <= len(title) + len(title) // 5:
            rest = Counter(words)
            missing = sum((Counter(title) - rest).values())
            extra = sum(n for w, n in (rest - Counter(title)).items() if w not in known and not w.isdigit())
            if missing <= len(title) // 5 and extra <= missing:
                return True
    return bool(words) and bool(number) and number.lower() in low and not other


def strip_marks(text: str, titles: list[list[str]], number: str | None, city: list[str]) -> tuple[str, set[str]]:
    """The text with one kind of line end and without page marks and running headers, and which there were. The first line with
    content is no header."""
    text = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    found, kept, begun = set(), [], False
    known = HEADER_WORDS.union(city, WORD.findall((number or "").lower()))
    # a header misses at most a fifth of a title's words, so it holds one of the longest of one more than that
    marks = {w for t in titles for w in sorted(t, key=len)[-(len(t) // 5 + 1) :]} | ({number.lower()} if number else set())
    for line in text.split("\n"):
        if _PAGE_START.match(line) and is_page_mark(line):
            found.add("page_number")
            continue
        if begun:
            low = line.lower()
            if any(m in low for m in marks) and _is_header(line, titles, number, known):
                found.add("running_header")
                continue
        begun = begun or bool(line.strip())
        kept.append(line)
    return "\n".join(kept) if found else text, found


def _core_of(token: str) -> str:
    """core, remembered; the memory is emptied now and then, so that it stays small whatever the texts hold."""
    found = _CORES.get(token)
    if found is None:
        if len(_CORES) > 200_000:
            _CORES.clear()
        found = _CORES[token] = core(token)
    return found


def _broken(text: str) -> bool:
    return HYPHEN.search(text) is not None


def words_of(text: str) -> list[str]:
    """Cores of the tokens, without the parts of words split over line ends."""
    return [c for c in map(_core_of, (BREAK.sub(" ", text) if _broken(text) else text).split()) if c]


def readings(word: str) -> dict[str, list[int]]:
    """Words that may have stood there, with the confusions (by number) that lead to them. Strange characters are all replaced, two of
    them in different places included; of other confusions there are at most two (one beside strange characters). Words with more
    strange characters or of great length are left to `lookalike`."""
    spots = [(m.start(), len(a), b, i) for i, (a, b) in enumerate(CONFUSIONS) for m in re.finditer(f"(?={re.escape(a)})", word)]
    odd = [s for s in spots if STRANGE.search(CONFUSIONS[s[3]][0])]
    soft = [s for s in spots if not STRANGE.search(CONFUSIONS[s[3]][0])]
    places = sorted({s[0] for s in odd})
    if len(places) < len(STRANGE.findall(word)):
        return {}
    bases: list[list] = [[]]
    for p in places:
        bases = [x + [s] for x in bases for s in odd if s[0] == p]
    out: dict[str, list[int]] = {}
    for base in bases:
        for k in range(0 if base else 1, (1 if base else 2) + 1):
            for extra in combinations(soft, k):
                edits = sorted(base + list(extra))
                if any(x[0] + x[1] > y[0] for x, y in zip(edits, edits[1:])):
                    continue
                at, parts = 0, []
                for s, n, b, _ in edits:
                    parts += [word[at:s], b]
                    at = s + n
                w = "".join(parts) + word[at:]
                if w != word and len(edits) < len(out.get(w, edits + [0])):
                    out[w] = [e[3] for e in edits]
    return out


def _titles(*titles: str | None) -> list[list[str]]:
    return [w for w in {tuple(WORD.findall((t or "").lower())): 1 for t in titles} if w]


def _titled(batch: pa.RecordBatch):
    cols = [batch.column(c).to_pylist() for c in ("text", "title", "title2", "number", "city")]
    for text, t1, t2, number, city in zip(*cols):
        yield text or "", _titles(t1, t2), (number or "").strip() or None, WORD.findall((city or "").lower())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words ('', word) and split words (left, right)."""
    tokens: Counter = Counter()
    splits: Counter = Counter()

    def flush() -> pa.RecordBatch:
        words: Counter = Counter()
        for t, n in tokens.items():
            if c := core(t):
                words[c] += n
        rows = [(("", w), n) for w, n in words.items()] + list(splits.items())
        tokens.clear()
        splits.clear()
        return pa.record_batch([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["l", "r", "n"])

    for b in batches:
        for text in b.column("text").to_pylist():
            if _broken(text):
                splits.update((core(m[1]), core(m[2])) for m in BREAK.finditer(text))
                text = BREAK.sub(" ", text)
            tokens.update(text.split())
            if len(tokens) + len(splits) > 300_000:
                yield flush()
    yield flush()


def _hard(word: Column) -> Column:
    """Words that `readings` would have too many ways for, or few letters of."""
    strange = F.length(F.regexp_replace(word, r"[^0-9|!$(éè]", ""))
    return (strange > 3) | (F.length(word) > 40) | ((strange > 0) & (strange * 2 >= F.length(word)))


def lookalike(word: Column) -> Column:
    """The word with each strange character as the letter it looks like, those that look like several as one of these: equal for a word
    and all its readings of strange characters."""
    return F.translate(word, "01|!5$689(éèl", "oiiissbbgceei")


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(w, n, c, e) for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()) if plain(w) for c, e in readings(w).items()]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()))
        yield pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["word", "n", "cand", "edits"])


def _own(n: Column, word: Column) -> Column:
    """Log weight of the word as it stands; a second strange character is as unlikely in a word that is meant as in a misreading."""
    strange = F.length(F.regexp_replace(word, r"[^0-9|!$(éè]", ""))
    return F.log(n) + F.when(strange > 0, math.log(P_STRANGE) + (strange - 1) * math.log(P_CONFUSION)).otherwise(0.0)


def confusion_weights(cands: DataFrame, words: DataFrame) -> list[float]:
    """Log probability of each confusion: P_CONFUSION times how often it leads to the clear best reading of a word, against how often what
    it hides stands in the words and the average of all. A row a confusion is all that is collected."""
    flat = math.log(P_CONFUSION)
    score = F.log("cn") + F.size("edits") * flat - _own(F.col("n"), F.col("word"))
    clear = cands.withColumn("score", score).groupBy("word").agg(F.max_by(F.struct("score", "n", "edits"), "score").alias("b")).filter("b.score >= 2")
    used = {r.e: r.n for r in clear.select("b.n", F.explode("b.edits").alias("e")).groupBy("e").agg(F.sum("n").alias("n")).collect()}
    hidden = sorted({b for _, b in CONFUSIONS})
    chance = words.agg(*(F.sum(F.col("n") * (F.length("word") - F.length(F.replace("word", F.lit(b), F.lit("")))) / len(b)).alias(b) for b in hidden)).first()
    chances = [chance[b] or 0 for _, b in CONFUSIONS]
    base = sum(used.values()) / max(1, sum(chances))
    # as often as the average where nothing is known
    ratio = [(used.get(i, 0) + SURE) / (base * n + SURE) for i, n in enumerate(chances)]
    return [min(math.log(0.2), max(math.log(1e-4), flat + math.log(x))) for x in ratio]


def channel_model(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fixes, joins, words) learned from all items, distributed tables.

    fixes(word, cand, score): the known words that a word may be a misreading of; score is the log odds of the candidate by channel
    and unigram, above -3. joins(l, r): words split over a line end without a hyphen of their own, i.e. more often (or as never)
    written as one word than with a hyphen. words(word, n): their counts.
    """
    counted = materialize(items.mapInArrow(_count, "l string, r string, n bigint").groupBy("l", "r").agg(F.sum("n").alias("n")))
    words = counted.filter("l = ''").select(F.col("r").alias("word"), "n")
    known = words.filter((F.col("n") >= LEXICON_MIN) & ~F.col("word").rlike(STRANGE.pattern)).select(F.col("word").alias("cand"), F.col("n").alias("cn"))
    word = F.col("word")
    cands = words.filter(~_hard(word)).mapInArrow(_propose, "word string, n bigint, cand string, edits array<int>").join(known, "cand")
    cands = materialize(cands)
    weights = confusion_weights(cands, words)
    logp = F.aggregate("edits", F.lit(0.0), lambda s, e: s + F.element_at(F.array(*map(F.lit, weights)), e + 1))
    near = words.filter(_hard(word) & word.rlike(r"\p{L}") & ~word.rlike("[-/]") & (F.length("word") > 3)).withColumn("k", lookalike(word))
    near = near.join(known.withColumn("k", lookalike(F.col("cand"))), "k").filter("word <> cand")
    near = near.select("word", "cand", "n", "cn", (F.levenshtein("word", "cand") * math.log(P_CONFUSION)).alias("logp"))
    scored = cands.select("word", "cand", "n", "cn", logp.alias("logp")).union(near)
    fixes = scored.select("word", "cand", (F.log("cn") + F.col("logp") - _own(F.col("n"), word)).alias("score")).filter("score > -3")
    splits = counted.filter("l <> '' and r <> ''").select("l", "r", F.concat("l", "r").alias("one"), F.concat_ws("-", "l", "r").alias("two"))
    splits = splits.join(words.select(F.col("word").alias("one"), F.col("n").alias("n1")), "one", "left").join(words.select(F.col("word").alias("two"), F.col("n").alias("n2")), "two", "left")
    joins = splits.filter(F.coalesce("n1", F.lit(0)) >= F.coalesce("n2", F.lit(0))).select("l", "r")
    return materialize(fixes), joins, words


FOUND = "item_kind string, item_id bigint, l string, r string"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], names=["item_kind", "item_id", "l", "r"])


def _finder(known: Bloom):
    """Of each text the words ('', word) that pass the filter, and its split words (left, right)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            split = [[m for m in BREAK.finditer(t)] if _broken(t) else [] for t in texts]
            cores = {t: _core_of(t) for t in set().union(*map(str.split, texts))}
            cores |= {m[1] + m[2]: _core_of(m[1] + m[2]) for ms in split for m in ms}
            names = list(set(cores.values()) - {""})
            hit = {w for w, ok in zip(names, known.has(mix(word_hash(names)))) if ok}
            hit = {t: c for t, c in cores.items() if c in hit}
            rows = []
            for kind, item, text, ms in zip(b.column("item_kind").to_pylist(), b.column("item_id").to_pylist(), texts, split):
                words = {hit[t] for t in [*text.split(), *(m[1] + m[2] for m in ms)] if t in hit} if ms or not hit.keys().isdisjoint(text.split()) else ()
                rows += [(kind, item, "", w) for w in words]
                rows += [(kind, item, *k) for k in {(core(m[1]), core(m[2])) for m in ms}]
            yield _found(rows)

    return run


def _pair_counter(asked: Bloom):
    """Partial counts of the neighbouring words that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                parts = [(BREAK.sub(" ", t) if _broken(t) else t).split() for t in whole.column("text").slice(at, 2000).to_pylist()]
                flat = [t for p in parts for t in p]
                names = list(dict.fromkeys(flat))
                cores = list(map(_core_of, names))
                place = {t: i for i, t in enumerate(names)}
                ids = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
                doc = np.repeat(np.arange(len(parts)), list(map(len, parts)))
                some = np.fromiter(map(bool, cores), bool, len(cores))[ids] if len(ids) else np.zeros(0, bool)
                ids, doc = ids[some], doc[some]
                h = word_hash(cores)[ids]
                pairs = np.flatnonzero((doc[1:] == doc[:-1]))
                pairs = pairs[asked.has(pair_hash(h[pairs], h[pairs + 1]))]
                seen = Counter((cores[i], cores[j]) for i, j in zip(ids[pairs].tolist(), ids[pairs + 1].tolist()))
                yield pa.record_batch([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["l", "r", "n"])

    return run


class Decoder:
    """Viterbi over the candidates of each line's words. pairs: counts of neighbouring words; total: of words on the left."""

    def __init__(self, fixes: dict[str, list[tuple[str, float]]], pairs: dict[tuple[str, str], int], total: dict[str, int]):
        self.fixes, self.pairs, self.total = fixes, pairs, total

    def words(self, line: str) -> list[tuple[int, int, str]]:
        return [(m.start(), m.end(), _core_of(m[0])) for m in TOKEN.finditer(line)]

    def asked(self, line: str) -> Iterator[tuple[str, str]]:
        """The neighbouring words whose counts decoding the line needs."""
        ws = [w for _, _, w in self.words(line) if w]
        for left, right in zip(ws, ws[1:]):
            if left in self.fixes or right in self.fixes:
                for x in (left, *(c for c, _ in self.fixes.get(left, ()))):
                    for y in (right, *(c for c, _ in self.fixes.get(right, ()))):
                        yield x, y

    def step(self, left: str, right: str, stands: bool) -> float:
        """stands: both words are those of the line, whose own occurrence does not count."""
        return math.log((max(0, self.pairs.get((left, right), 0) - stands) + 0.5) / (max(0, self.total.get(left, 0) - stands) + 5))

    def line(self, line: str) -> tuple[str, bool]:
        spans = [s for s in self.words(line) if s[2]]
        if not any(w in self.fixes for _, _, w in spans):
            return line, False
        states: dict[str, float] = {"": 0.0}
        back: list[dict[str, str]] = []
        before = ""
        for _, _, w in spans:
            options = [(w, 0.0), *self.fixes.get(w, [])]
            if len(options) == 1 and len(states) == 1:
                left, score = next(iter(states.items()))
                states, prev = {w: score}, {w: left}
            else:
                now, prev = {}, {}
                for o, gain in options:
                    score, left = max((s + self.step(left, o, left == before and o == w), left) for left, s in states.items())
                    if o not in now or score + gain > now[o]:
                        now[o], prev[o] = score + gain, left
                states = now
            back.append(prev)
            before = w
        at = max(states, key=lambda o: states[o])
        path = []
        for prev in reversed(back):
            path.append(at)
            at = prev[at]
        out, done = [], 0
        for (s, e, w), new in zip(spans, reversed(path)):
            if new != w:
                token = line[s:e]
                k = token.lower().find(w)
                if k >= 0:
                    old = token[k : k + len(w)]
                    new = new.upper() if old.isupper() and len(old) > 1 else new.capitalize() if old[:1].isupper() else new
                    out += [line[done : s + k], new]
                    done = s + k + len(w)
        return ("".join(out) + line[done:], True) if out else (line, False)


OUT = "item_kind string, item_id bigint, text string, noise array<string>"


def _emit(b: pa.RecordBatch, done: list[tuple[str, set[str]]]) -> pa.RecordBatch:
    return pa.record_batch([b.column("item_kind"), b.column("item_id"), pa.array([t for t, _ in done], pa.string()), pa.array([sorted(n) for _, n in done], pa.list_(pa.string()))], names=["item_kind", "item_id", "text", "noise"])


def _unmark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _emit(b, [strip_marks(*row) for row in _titled(b)])


def _each(change: Callable[[str], tuple[str, set[str]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for text, noise in zip(b.column("text").to_pylist(), b.column("noise").to_pylist()):
                text, more = change(text)
                done.append((text, more.union(noise)))
            yield _emit(b, done)

    return run


def _join(text: str, joins: set[tuple[str, str]]) -> tuple[str, bool]:
    hit = False

    def one(m: re.Match) -> str:
        nonlocal hit
        if (core(m[1]), core(m[2])) not in joins:
            return m[0]
        hit = True
        return m[1] + m[2]

    return (BREAK.sub(one, text), hit) if joins else (text, False)


def _fixes_of(row: list[dict] | None) -> dict[str, list[tuple[str, float]]]:
    table: dict[str, list[tuple[str, float]]] = {}
    for f in row or ():
        table.setdefault(f["word"], []).append((f["cand"], f["score"]))
    return {w: sorted(c) for w, c in table.items()}


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of words that decoding each text needs the counts of."""
    for b in batches:
        rows = []
        for kind, item, text, joins, fixes in zip(*(b.column(c).to_pylist() for c in ("item_kind", "item_id", "text", "joins", "fixes"))):
            if fixes:
                text, _ = _join(text, {(j["l"], j["r"]) for j in joins or ()})
                decoder = Decoder(_fixes_of(fixes), {}, {})
                rows += [(kind, item, *p) for p in {p for line in text.split("\n") for p in decoder.asked(line)}]
        yield _found(rows)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = []
        for text, noise, joins, fixes, pairs in zip(*(b.column(c).to_pylist() for c in ("text", "noise", "joins", "fixes", "pairs"))):
            noise = set(noise)
            text, joined = _join(text, {(j["l"], j["r"]) for j in joins or ()})
            decoder = Decoder(_fixes_of(fixes), {(p["l"], p["r"]): p["n"] for p in pairs or ()}, {p["l"]: p["total"] for p in pairs or ()})
            lines = [decoder.line(x) for x in text.split("\n")] if fixes else [(text, False)]
            noise |= {"hyphen_break"} if joined else set()
            noise |= {"misread"} if any(f for _, f in lines) else set()
            done.append(("\n".join(x for x, _ in lines), noise))
        yield _emit(b, done)


def _flow(text: str) -> tuple[str, set[str]]:
    """Lines run on into paragraphs; a blank line, a list mark or a short line before a capital begins a new one."""
    lines = text.split("\n")
    width = max(map(len, lines), default=0)
    out: list[str] = []  # pieces; a paragraph's end is a piece of line ends
    for i, raw in enumerate(lines):
        x = raw.strip()
        if not x:
            if out and out[-1] != "\n\n":
                out.append("\n\n")
            continue
        if out and out[-1] != "\n\n":
            if re.match(r"(?:[-*•|]|\(\w{1,4}\)|\d+[.)])\s", x) or "\t" in x or (len(lines[i - 1]) < 0.6 * width and x[:1].isupper()):
                out.append("\n")
            elif out[-1][-1] != "-":
                out.append(" ")
        out.append(x)
    return "".join(out).rstrip("\n"), set()


def repair_scans(items: DataFrame, titles: DataFrame | None = None, reflow: bool = True, most_bits: int = BLOOM_BITS) -> DataFrame:
    """(item_kind, item_id, text, noise): every item's repaired text and the sorted kinds of noise it held. Without reflow
    the repaired text keeps its lines.

    items: item_kind, item_id, text, title, number, city, bylaw_id. titles(bylaw_id, title2), if given, supplies
    titles that an item lacks. Null texts count as empty; rows with a null id are left out; a repeated item is
    repaired once. An empty input gives no rows. Texts, lines and words of any length are treated alike, but for words of over 40
    letters or with more than three strange characters: they are corrected to known words that look like them, without confusions
    of several letters. Only what concerns one text's own words ever meets in a task.
    """
    ids = ["item_kind", "item_id"]
    rows = items.filter("item_id is not null").groupBy(*ids).agg(F.min(F.struct("text", "title", "number", "city", "bylaw_id")).alias("s"))
    rows = rows.select("item_kind", F.col("item_id").cast("bigint").alias("item_id"), "s.*")
    if titles is not None:
        rows = rows.join(titles.groupBy("bylaw_id").agg(F.min("title2").alias("title2")), "bylaw_id", "left")
    else:
        rows = rows.withColumn("title2", F.lit(None).cast("string"))
    rows = materialize(rows.select(*ids, "text", "title", "title2", "number", "city").mapInArrow(_unmark, OUT))
    fixes, joins, words = channel_model(rows.select("text"))
    keys = fixes.select(F.col("word").alias("key")).distinct()
    found = rows.select(*ids, "text").mapInArrow(_finder(bloom(materialize(keys.mapInArrow(hashes_of_words, "h bigint")), most_bits)), FOUND)
    found = materialize(found)
    own = found.filter("l = ''").join(fixes, F.col("r") == F.col("word")).groupBy(*ids).agg(F.collect_list(F.struct("word", "cand", "score")).alias("fixes"))  # of one text
    cut = found.filter("l <> ''").join(joins, ["l", "r"]).groupBy(*ids).agg(F.collect_list(F.struct("l", "r")).alias("joins"))  # of one text
    due = materialize(rows.join(own.join(cut, ids, "full"), ids))
    asked = materialize(due.select(*ids, "text", "joins", "fixes").mapInArrow(_ask, FOUND))
    pairs = materialize(asked.select("l", "r").distinct())
    counts = rows.select("text").mapInArrow(_pair_counter(bloom(materialize(pairs.mapInArrow(hashes_of_pairs, "h bigint")), most_bits)), "l string, r string, n bigint")
    counts = pairs.join(counts.groupBy("l", "r").agg(F.sum("n").alias("n")), ["l", "r"], "left").join(words.select(F.col("word").alias("l"), F.col("n").alias("total")), "l", "left")
    context = asked.join(counts.na.fill(0, ["n", "total"]), ["l", "r"]).groupBy(*ids).agg(F.collect_list(F.struct("l", "r", "n", "total")).alias("pairs"))  # of one text
    clean = due.join(context, ids, "left").select(*ids, "text", "noise", "joins", "fixes", "pairs").mapInArrow(_decode, OUT)
    clean = clean.select(*ids, F.col("text").alias("text_"), F.col("noise").alias("noise_"))
    all_ = rows.join(clean, ids, "left").select(*ids, F.coalesce("text_", "text").alias("text"), F.coalesce("noise_", "noise").alias("noise"))
    return all_.mapInArrow(_each(_flow), OUT) if reflow else all_
