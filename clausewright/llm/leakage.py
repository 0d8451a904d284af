"""Passages of evaluation items in a corpus (problem 9).

The items form a BM25 index with block maxima. Every passage of every document that can hold a leak is a query against it, walked by
block-max WAND; the threshold of an item is the least score that any of its runs of `run` words can give, so no
leak of that length is missed. What passes is verified word by word.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.runtime import spread

WORD = re.compile(r"[a-z0-9]+")
K1 = 1.2
BLOCK = 16
END = 1 << 62


class ItemIndex:
    """BM25 (without length normalisation, so that a term's score never falls below its score at one occurrence)."""

    def __init__(self, items: list[tuple[int, str]], run: int):
        self.run = run
        words = [(i, WORD.findall((t or "").lower())) for i, t in sorted(items)]
        words = [(i, w) for i, w in words if len(w) >= run]
        self.ids = [i for i, _ in words]
        df = Counter(w for _, ws in words for w in set(ws))
        self.idf = {w: math.log(1 + (len(words) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
        postings = defaultdict(list)
        self.least: list[float] = []
        self.runs: list[set] = []
        for at, (_, ws) in enumerate(words):
            for w, tf in Counter(ws).items():
                postings[w].append((at, self.idf[w] * tf * (K1 + 1) / (tf + K1)))
            windows = {tuple(ws[s : s + run]) for s in range(len(ws) - run + 1)}
            self.runs.append(windows)
            self.least.append(min(sum(self.idf[w] for w in set(x)) for x in windows) - 1e-9)
        #: word -> (items, scores, highest score, highest score of each block)
        self.lists = {}
        for w, p in postings.items():
            scores = [s for _, s in p]
            self.lists[w] = ([i for i, _ in p], scores, max(scores), [max(scores[b : b + BLOCK]) for b in range(0, len(p), BLOCK)])
        self.bar = min(self.least, default=math.inf)
        self.stretch = re.compile(f"x{{{run},}}")

    def above(self, words: set[str]) -> list[int]:
        """Positions of the items that score at least their threshold for a set of query words."""
        lists = [self.lists[w] for w in words if w in self.lists]
        if sum(x[2] for x in lists) < self.bar:
            return []
        cursors = [[x[0][0], 0, x] for x in lists]
        found = []
        while True:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, END
            for c in cursors:
                if c[0] == END:
                    break
                bound += c[2][2]
                if bound >= self.bar:
                    pivot = c[0]
                    break
            if pivot == END:
                return found
            upto = [c for c in cursors if c[0] <= pivot]
            block = 0.0
            for c in upto:
                at = bisect_left(c[2][0], pivot, c[1])
                if at < len(c[2][0]):
                    block += c[2][3][at // BLOCK]
            if block < self.bar:
                # no item up to the nearest end of these blocks, or the next list's item, can reach the bar
                goal = min([c[0] for c in cursors if c[0] > pivot], default=END)
                for c in upto:
                    at = bisect_left(c[2][0], pivot, c[1])
                    if at < len(c[2][0]):
                        goal = min(goal, c[2][0][min(len(c[2][0]), (at // BLOCK + 1) * BLOCK) - 1] + 1)
                self._move(upto, max(goal, pivot + 1))
                continue
            if upto[0][0] == pivot:
                if sum(c[2][1][c[1]] for c in upto) >= self.least[pivot]:
                    found.append(pivot)
                self._move(upto, pivot + 1)
            else:
                self._move([c for c in upto if c[0] < pivot], pivot)

    @staticmethod
    def _move(cursors: list, to: int) -> None:
        for c in cursors:
            c[1] = bisect_left(c[2][0], to, c[1])
            c[0] = c[2][0][c[1]] if c[1] < len(c[2][0]) else END

    def leaks(self, text: str, passage: int) -> list[int]:
        """Ids of the items of which the text holds `run` consecutive words.

        All words of a leak are words of the index, so the passages are cut from the stretches of at least `run` such words.
        """
        words = WORD.findall(text.lower())
        if len(words) < self.run or not self.lists:
            return []
        hits = set()
        step = passage - self.run + 1  # every run lies within one passage
        for stretch in self.stretch.finditer("".join(["x" if w in self.lists else " " for w in words])):
            for s in range(stretch.start(), stretch.end() - self.run + 1, step):
                part = words[s : min(s + passage, stretch.end())]
                cand = [i for i in self.above(set(part)) if i not in hits]
                if cand:
                    runs = {tuple(part[k : k + self.run]) for k in range(len(part) - self.run + 1)}
                    hits.update(i for i in cand if not runs.isdisjoint(self.runs[i]))
        return [self.ids[i] for i in sorted(hits)]


def leaked_items(docs: DataFrame, items: DataFrame, *, doc: str, text: str, item: str, item_text: str, run: int = 12, passage: int = 64, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id): documents holding `run` or more consecutive words of an item, each pair once.

    Items are indexed in blocks of about block_chars characters, as many as the items need; only one block's index
    is shipped with a pass over the documents. Items or documents of fewer than `run` words, null ids and null
    texts have no leaks. One item with several texts is matched by any of them.
    """
    it = items.select(F.col(item).cast("bigint").alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null").distinct()
    chars = it.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = chars // block_chars + 1
    base = spread(docs.select(F.col(doc).cast("bigint").alias("d"), F.col(text).alias("x")).filter("d is not null and x is not null"), "d")
    found = None
    for b in range(blocks):
        index = ItemIndex([tuple(r) for r in it.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()], run)

        def search(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = [(d, i) for d, x in zip(batch.column("d").to_pylist(), batch.column("x").to_pylist()) for i in index.leaks(x, passage)]
                yield pa.record_batch([pa.array([d for d, _ in pairs], pa.int64()), pa.array([i for _, i in pairs], pa.int64())], names=["doc_id", "item_id"])

        part = base.mapInArrow(search, "doc_id bigint, item_id bigint")
        found = part if found is None else found.union(part)
    return found.distinct()
