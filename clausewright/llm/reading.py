"""Reading level of documents (problem 10): a Rasch Poisson counts model with a latent difficulty.

A document has a level, and how often a word occurs in it is a Poisson count whose rate depends on the level: log-quadratic
in it, so that a word has a difficulty where it is most at home and falls off with the distance. Levels and word parameters are
estimated in turn by maximum likelihood, anchored at the labelled documents, until the levels stay. A sentence has a level of its
own; a document's is that of the sentences in the middle half of its words, so that the bulk of the text decides.

Words are hashed into a fixed number of buckets, so that the parameters, and all that is sent to the tasks or collected, have a size that
does not depend on the data. The occurrences themselves are never shuffled: a round is one pass over the documents, from which each
task sends its counts by bucket and level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.pairs import LANGUAGES
from clausewright.runtime import arrow_batches, discard, materialize

WORD = re.compile(r"[a-z0-9]+")
SENTENCE = re.compile(r"[.!?;]\s+|\n+")
TOKEN = re.compile(r"[^\W_]+|\x00")
_ASCII = {i: " " for i in range(128) if not chr(i).isalnum() and i}
BUCKETS = 1 << 18
#: Buckets at the end that stand for sentence lengths and mean word lengths; each counts three times a sentence.
LENGTHS, LETTERS, TIMES = 16, 48, 3
WORDS = BUCKETS - LENGTHS - LETTERS
GRID = np.arange(1, 5.01, 0.25)
CENTRE = 3.0
#: Weight of the prior that a word is as frequent at all levels, and the levels' prior spread over a sentence.
RIDGE, STEPS = 1.0, 12
BATCH_DOCS = 1000
_TONGUES = sorted(LANGUAGES)


def _bucket(word: str) -> int:
    """The bucket of a word without its digits, -1 for a number."""
    w = word.strip("0123456789")
    return xxhash.xxh3_64_intdigest(w) % WORDS if w else -1


def _tokens(low: str) -> list[str]:
    """Words of a lower-cased text, with a mark behind each sentence."""
    marked = SENTENCE.sub(" \x00 ", low) + " \x00"
    return marked.translate(_ASCII).split() if marked.isascii() else TOKEN.findall(marked)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as buckets: for each document the buckets of its words, and of its sentences how many words and letters."""
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            lows = [(t or "").lower().replace("\x00", " ") for t in b.column("text").to_pylist()]
            parts = [_tokens(t) for t in lows]
            n_words = [len(p) - p.count("\x00") if t.isascii() else len(WORD.findall(t)) for t, p in zip(lows, parts)]
            flat = [w for p in parts for w in p]
            vocabulary = {w: i for i, w in enumerate(dict.fromkeys(flat))}
            names = list(vocabulary)
            ids = np.fromiter(map(vocabulary.__getitem__, flat), np.int64, len(flat))
            doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            english = np.zeros((len(parts), len(_TONGUES)))
            for k, tongue in enumerate(_TONGUES):
                spoken = np.fromiter((w in LANGUAGES[tongue] for w in names), float, len(names))
                english[:, k] = np.bincount(doc, spoken[ids], len(parts))
            own = _TONGUES.index("en")
            is_english = english[:, own] > np.delete(english, own, 1).max(axis=1)
            bucket = np.fromiter((-2 if w == "\x00" else _bucket(w) for w in names), np.int64, len(names))[ids]
            letters = np.fromiter((len(w.strip("0123456789")) for w in names), np.int64, len(names))[ids]
            sentence = np.cumsum(bucket == -2) - (bucket == -2)
            sentence_doc = doc[bucket == -2]
            is_word = bucket >= 0
            size = np.bincount(sentence[is_word], minlength=len(sentence_doc))
            chars = np.bincount(sentence[is_word], letters[is_word], len(sentence_doc))
            full = size > 0
            mean = chars[full] / size[full]
            lists = lambda values, of: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=len(parts)))].astype(np.int32)), pa.array(values.astype(np.int32)))
            yield pa.record_batch(
                [
                    b.column("doc_id"), b.column("anchor"), pa.array(n_words, pa.int32()), pa.array(is_english),
                    lists(bucket[is_word], doc[is_word]), lists(size[full], sentence_doc[full]), lists(np.minimum(LETTERS - 1, (mean * 2).astype(int)), sentence_doc[full]),
                ],
                names=["doc_id", "anchor", "n_words", "english", "words", "sizes", "letters"],
            )


class Model:
    """log rate of each bucket at a level t from the centre: c + a t + b t^2."""

    def __init__(self, table: np.ndarray):
        self.table = table
        t = GRID - CENTRE
        self.total = np.zeros(len(t))  # the rate of all buckets together, at each level
        for at in range(0, len(table), 1 << 16):
            c, a, b = table[at : at + (1 << 16)].T[:, :, None].astype(np.float64)
            self.total += np.exp(c + a * t + b * t * t).sum(axis=0)

    def sentences(self, words: np.ndarray, size: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The expected level of each sentence, given all its counts, and the log likelihood there."""
        start = np.r_[0, np.cumsum(size)[:-1]]
        sums = np.add.reduceat(self.table[words].astype(np.float64), start, axis=0) if len(words) else np.zeros((0, 3))
        sums += TIMES * (self.table[WORDS + np.minimum(LENGTHS - 1, size // 4)] + self.table[WORDS + LENGTHS + letters])
        t = GRID - CENTRE
        fit = sums[:, [0]] + sums[:, [1]] * t + sums[:, [2]] * t * t - (size + 2 * TIMES)[:, None] * self.total
        best = fit.max(axis=1, keepdims=True)
        weight = np.exp(fit - best)
        return (weight @ GRID) / weight.sum(axis=1), best[:, 0]


def _bulk(level: np.ndarray, size: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Mean level of the sentences within the middle half of each document's words, ordered by level; NaN without words."""
    order = np.lexsort((level, doc))
    doc, size, level = doc[order], size[order].astype(float), level[order]
    total = np.bincount(doc, size, n)
    upto = np.cumsum(size) - np.r_[0, np.cumsum(total)][doc]
    inside = np.maximum(0, np.minimum(upto, 0.75 * total[doc]) - np.maximum(upto - size, 0.25 * total[doc]))
    with np.errstate(all="ignore"):
        return np.bincount(doc, inside * level, n) / np.bincount(doc, inside, n)


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, sizes, letters, document of each sentence) of a batch."""
    words, size, letters = (b.column(c).flatten().to_numpy() for c in ("words", "sizes", "letters"))
    return words, size.astype(np.int64), letters, np.repeat(np.arange(b.num_rows), np.diff(b.column("sizes").offsets.to_numpy()))


def _levels(model: Model | None, b: pa.RecordBatch) -> tuple[np.ndarray, float]:
    words, size, letters, doc = _arrays(b)
    if model is None or not len(words):
        return np.full(b.num_rows, np.nan), 0.0
    level, fit = model.sentences(words, size, letters)
    return _bulk(level, size, doc, b.num_rows), float(fit.sum())


COUNTS = [f"n{i}" for i in range(len(GRID))]
STAT = -1  # key of the row with the number of documents, the sum of the changes of level, and the log likelihood


def _counter(now: np.ndarray | None, before: np.ndarray | None):
    """Counts by bucket and level of one pass. A labelled document counts at its label, another one at its level by the parameters now; without
    any it does not count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, last = (Model(x) if x is not None else None for x in (now, before))
        counts, exposure, stat = np.zeros((BUCKETS, len(GRID)), np.float32), np.zeros(len(GRID)), np.zeros(len(GRID))
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                words, size, letters, doc = _arrays(b)
                theta, fit = _levels(model, b)
                known = ~np.isnan(theta)
                stat[:3] += known.sum(), np.abs(theta - _levels(last, b)[0])[known].sum() if last else 0.0, fit
                anchor = b.column("anchor").to_numpy(zero_copy_only=False)
                theta = np.where(np.isnan(anchor), theta, anchor)
                cell = np.where(np.isnan(theta), -1, np.rint((np.nan_to_num(theta) - GRID[0]) / (GRID[1] - GRID[0]))).astype(np.int64)
                of_sentence = cell[doc]
                used = of_sentence >= 0
                for places, levels, times in (
                    (words, np.repeat(of_sentence, size), 1), (WORDS + np.minimum(LENGTHS - 1, size // 4), of_sentence, TIMES), (WORDS + LENGTHS + letters, of_sentence, TIMES),
                ):
                    ok = levels >= 0
                    np.add.at(counts.reshape(-1), places[ok] * len(GRID) + levels[ok], np.float32(times))
                exposure += np.bincount(of_sentence[used], size[used] + 2 * TIMES, len(GRID))
        rows = np.flatnonzero(counts.any(axis=1))
        keys = np.r_[rows, STAT, STAT - 1]
        values = np.concatenate([counts[rows].astype(np.float64), [stat, exposure]])
        for at in range(0, len(keys), 20_000):
            yield pa.record_batch([pa.array(keys[at : at + 20_000]), *(pa.array(x) for x in values[at : at + 20_000].T)], names=["bucket", *COUNTS])

    return run


def _fitter(exposure: np.ndarray):
    """Poisson regression of each bucket's counts on level and its square, with the prior, by Newton steps."""
    t = GRID - CENTRE
    design = np.stack([np.ones_like(t), t, t * t], 1)
    share = exposure / max(1.0, exposure.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = np.stack([b.column(c).to_numpy() for c in COUNTS], 1)
            seen = n.sum(axis=1)
            x = np.zeros((len(n), 3))
            x[:, 0] = np.log(seen / exposure.sum())
            # the prior: half an occurrence more, spread as the text is
            n = n + 0.5 * share
            prior = np.diag([0.0, RIDGE, RIDGE])
            for _ in range(STEPS):
                rate = np.exp(np.clip(x @ design.T, -40, 3)) * exposure
                slope = (n - rate) @ design - x @ prior
                bend = np.einsum("ng,gi,gj->nij", rate, design, design) + prior + 1e-9 * np.eye(3)
                step = np.linalg.solve(bend, slope[:, :, None])[:, :, 0]
                x += step * np.minimum(1.0, 1.5 / np.maximum(1e-9, np.abs(step).max(axis=1)))[:, None]
            yield pa.record_batch([b.column("bucket"), *(pa.array(c) for c in x.T)], names=["bucket", "c", "a", "b"])

    return run


def fit_words(read: DataFrame, now: np.ndarray | None, before: np.ndarray | None) -> tuple[np.ndarray | None, dict]:
    """One round: the buckets' parameters from the counts at the levels by the parameters now, and what the pass showed. All that
    is collected has at most BUCKETS rows."""
    counts = read.mapInArrow(_counter(now, before), "bucket bigint, " + ", ".join(f"{c} double" for c in COUNTS))
    counts = materialize(counts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in COUNTS)))
    told = {r.bucket: np.array([r[c] for c in COUNTS]) for r in counts.filter("bucket < 0").collect()}
    exposure = told.get(STAT - 1, np.zeros(len(GRID)))
    docs, moved, fit = told.get(STAT, np.zeros(3))[:3]
    seen = {"docs": int(docs), "moved": moved / max(1, docs), "log_likelihood": fit}
    if not exposure.sum():
        return None, seen
    fitted = counts.filter("bucket >= 0").mapInArrow(_fitter(exposure), "bucket bigint, c double, a double, b double").toArrow()
    table = np.zeros((BUCKETS, 3), np.float32)
    table[:, 0] = np.log(0.5 / exposure.sum())  # never seen: rare everywhere
    discard(counts)
    table[fitted.column("bucket").to_numpy()] = np.stack([fitted.column(c).to_numpy() for c in "cab"], 1)
    return table, seen


def _scorer(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(table)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                theta, _ = _levels(model, b)
                yield pa.record_batch([*(b.column(c) for c in ("doc_id", "anchor", "n_words", "english")), pa.array(theta, from_pandas=True)], names=["doc_id", "anchor", "n_words", "english", "theta"])

    return run


def _cuts(theta: np.ndarray, level: np.ndarray) -> list[float]:
    """For each level but the last the bound that parts it from the next with the fewest errors."""
    cuts = []
    for k in range(1, 5):
        order = np.argsort(theta, kind="stable")
        t, low = theta[order], level[order] <= k
        errors = np.r_[low.sum(), low.sum() + np.cumsum(np.where(low, -1, 1))]
        best = np.flatnonzero(errors == errors.min())
        i = int(best[len(best) // 2])
        cuts.append(float(k + 0.5) if not len(t) else float(t[-1] + 1 if i == len(t) else t[0] - 1 if i == 0 else (t[i - 1] + t[i]) / 2))
    return list(np.maximum.accumulate(cuts))


def reading_levels(
    docs: DataFrame, labels: DataFrame, *, doc: str, text: str, level: str, settled: float = 0.02, max_rounds: int = 8, max_labels: int = 20_000, told: list | None = None
) -> DataFrame:
    """(doc_id, n_words, english, theta, reading_level) of every document.

    labels(doc, level): levels 1 to 5; null levels are ignored, several raters' labels count with their median, labels
    of unknown documents are ignored. The first parameters come from the labelled documents, those of every further round from all
    documents, until a round moves the levels by less than `settled` on average (at most max_rounds). Bounds between levels are
    fitted on at most max_labels labelled documents (those of the smallest hash); the model itself is fitted on all. A document
    without words, a null or an empty text gets the middle of the scale, and so does one of none but words that no document
    of known level shares. Without labels every document does. Null ids are left out; an id delivered again counts once, with its
    smallest text. `told`, if given, gets what each round showed.
    """
    rows = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    anchors = labels.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(level).cast("double").alias("l")).filter("l between 1 and 5").groupBy("doc_id").agg(F.median("l").alias("anchor"))
    with arrow_batches(docs.sparkSession, BATCH_DOCS):
        read = materialize(rows.join(anchors, "doc_id", "left").mapInArrow(_read, "doc_id bigint, anchor double, n_words int, english boolean, words array<int>, sizes array<int>, letters array<int>"))
        now, seen = fit_words(read, None, None)
        before = None
        for _ in range(max_rounds if now is not None else 0):
            fresh, seen = fit_words(read, now, before)
            if told is not None:
                told.append(seen)
            stays = before is not None and seen["moved"] < settled
            before, now = now, fresh
            if stays:
                break
        if now is None:
            graded = read.select("doc_id", "anchor", "n_words", "english", F.lit(None).cast("double").alias("theta"))
        else:
            graded = materialize(read.mapInArrow(_scorer(now), "doc_id bigint, anchor double, n_words int, english boolean, theta double"))
    known = graded.filter("anchor is not null and theta is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).select("theta", "anchor").toPandas()
    cuts = _cuts(known.theta.to_numpy(float), known.anchor.to_numpy(float))
    value = F.coalesce("theta", F.lit(CENTRE))
    grade = sum(((value > c).cast("int") for c in cuts), F.lit(1))
    return graded.select("doc_id", "n_words", "english", value.alias("theta"), F.when(F.col("theta").isNull(), F.lit(3)).otherwise(grade).cast("int").alias("reading_level"))
