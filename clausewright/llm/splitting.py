"""Cutting oversized texts at natural boundaries (problem 3)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strongest first; a cut lies behind the match.
BOUNDARIES = [re.compile(p) for p in (r"\n[ ]?\n\s*", r"\n", r"[.!?;:][\"')\]”’]*\s+", r"\s+")]
_ENDS = r"[\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def tidy(text: Column) -> Column:
    """One kind of line end, runs of spaces and tabs as one space, white space at both ends dropped."""
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+", " ")
    return F.regexp_replace(t, rf"^{_ENDS}|{_ENDS}\z", "")


def cut_points(text: str, limit: int, overlap: int = 0) -> list[int]:
    """Where the bodies of at most `limit` characters begin: a body over it is cut at the strongest boundary in the
    middle half of its length, the nearest to its middle among equals. Where that half has none, the nearest white space that
    leaves more than `overlap` on both sides is taken, and the very middle only where there is none either."""
    starts, todo = [0], [(0, len(text))]
    while todo:
        s, e = todo.pop()
        if e - s <= limit:
            continue
        mid, reach = (s + e) // 2, (e - s) // 4
        cut = mid
        for kind in BOUNDARIES:
            ends = [m.end() for m in kind.finditer(text, max(s, mid - reach - 2), min(e, mid + reach)) if abs(m.end() - mid) <= reach]
            if ends:
                cut = min(ends, key=lambda x: (abs(x - mid), x))
                break
        else:
            ends = [m.end() for m in BOUNDARIES[-1].finditer(text, s, e) if s + overlap < m.end() < e - overlap]
            cut = min(ends, key=lambda x: (abs(x - mid), x), default=mid)
        starts.append(cut)
        todo += [(s, cut), (cut, e)]
    return sorted(starts)


def split_text(text: str, size: int = 1000, overlap: int = 150) -> list[str]:
    """Pieces of at most `size` characters; each after the first begins with the `overlap` characters before it. The
    pieces without their overlaps are the text again. A text within the size is one piece, an empty one none."""
    if len(text) <= size:
        return [text] if text else []
    starts = cut_points(text, size - overlap, overlap)
    ends = starts[1:] + [len(text)]
    return [text[max(0, s - (overlap if s else 0)) : e] for s, e in zip(starts, ends)]


def split_oversized(items: DataFrame, keys: list[str], text_col: str = "text", size: int = 1000, overlap: int = 150) -> DataFrame:
    """keys + (chunk_index, chunk_text) for each item whose tidied text is over `size` characters (code points).

    0 <= 4 * overlap <= size is required, so that every body, at least a quarter of what was cut or tested for it, is
    longer than the overlap. Null, blank and short texts give no rows; repeated rows give repeated pieces. Lengths are tested in
    the JVM, only oversized texts go to Python.
    """
    if not 0 <= 4 * overlap <= size:
        raise ValueError("overlap must be between 0 and a quarter of size")
    long = items.select(*keys, tidy(F.col(text_col)).alias("chunk_text")).filter(F.length("chunk_text") > size)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("chunk_text")
            for at in range(0, b.num_rows, 500):
                part = [split_text(t, size, overlap) for t in texts.slice(at, 500).to_pylist()]
                take = pa.array([at + i for i, p in enumerate(part) for _ in p], pa.int64())
                yield pa.record_batch(
                    [*(b.column(k).take(take) for k in keys), pa.array([i for p in part for i in range(len(p))], pa.int32()), pa.array([x for p in part for x in p], pa.string())],
                    names=[*keys, "chunk_index", "chunk_text"],
                )

    kinds = dict(items.dtypes)
    return long.mapInArrow(pieces, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", chunk_index int, chunk_text string")
