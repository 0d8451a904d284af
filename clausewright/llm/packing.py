"""Filling inputs of a fixed number of tokens with documents (problem 8): conflict-constrained best fit."""

from __future__ import annotations

import base64
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.runtime import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public byte-level vocabulary cuts text before its merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer(name: str, vocabulary: bytes):
    """The tokenizer of a vocabulary file's content."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs without the text, with n_tokens (0 for null); other columns stay. The vocabulary file (some hundred kB) is read here and
    broadcast, so executors need no copy; a task builds its tokenizer once."""
    keep = [c for c in docs.columns if c != text]
    with open(vocabulary, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches):
        t = tokenizer(vocabulary, content.value)
        for b in batches:
            sizes = [len(t.encode_ordinary(x)) if x else 0 for x in b.column(text).to_pylist()]
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(sizes, pa.int32())], names=[*keep, "n_tokens"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(count, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens int"]))


class Bins:
    """Open bins ordered by their residual, with bitmaps of the sources and duplicate clusters they hold."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_residual: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        self.filled = 0  # bit r: there is a bin with residual r
        self.residual: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def tightest(self, size: int, source: int, cluster: int) -> int | None:
        """The compatible bin that the item leaves the least room in: from the least residual that holds it the successors are searched."""
        left = self.filled >> size << size
        while left:
            for b in self.by_residual[(left & -left).bit_length() - 1]:
                if not (self.clusters[b] & cluster or self.sources[b] & source):
                    return b
            left &= left - 1
        return None

    def place(self, size: int, source: int, cluster: int, fresh: bool = False) -> int:
        """The bin that takes the item: the tightest without its source and cluster, else without its cluster, else a new one. fresh: a
        new one at once."""
        b = None
        if not fresh:
            b = self.tightest(size, source, cluster)
            if b is None and source:
                b = self.tightest(size, 0, cluster)
        if b is None:
            b = len(self.residual)
            self.residual.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            r = self.residual[b]
            del self.by_residual[r][b]
            if not self.by_residual[r]:
                self.filled &= ~(1 << r)
        r = self.residual[b] = self.residual[b] - size
        self.sources[b] |= source
        self.clusters[b] |= cluster
        self.by_residual[r][b] = None
        self.filled |= 1 << r
        return b


def pack(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each item, numbered from 0: best fit, largest items first.

    Two items of one cluster never share a bin; null clusters clash with nothing. Apart sources are preferred. A cluster needs
    as many bins as it has members: the members of one that needs a quarter of all the bins come first, each in a
    bin of its own, and the rest is packed around them.
    """
    count = Counter(c for c in clusters if c is not None)
    bit_c = {c: 1 << i for i, c in enumerate(sorted(c for c, n in count.items() if n > 1))}
    bit_s = {s: 1 << i for i, s in enumerate(sorted({s for s in sources if s is not None}))}
    needed = max(1, sum(sizes) // capacity)
    hottest, members = max(count.items(), key=lambda x: x[1], default=(None, 0))
    first = hottest if members * 4 >= needed and members > 1 else None
    bins, where = Bins(capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (first is None or clusters[i] != first, -sizes[i], i)):
        where[i] = bins.place(sizes[i], bit_s.get(sources[i], 0), bit_c.get(clusters[i], 0), first is not None and clusters[i] == first)
    return where


def pack_documents(
    docs: DataFrame, *, doc: str, text: str, source: str, capacity: int = 2048, vocabulary: str = VOCABULARY, inputs_per_task: int = 2000, clusters: DataFrame | None = None
) -> DataFrame:
    """(doc_id, part, first_token, n_tokens, input_no): the input of every document; a document longer than an input is
    cut into full parts and a rest, shorter ones are never split.

    clusters(id, cluster), if given, says which documents are near copies of each other; documents it does not name, and all
    without it, are copies where their texts are equal. Copies are kept out of one input whatever room that costs (a cluster of n
    documents needs n inputs), and documents of one source where it costs none. Full parts of long documents fill an input
    each. Documents are dealt by hash of the id into slots of about inputs_per_task inputs (at most about 50,000 parts
    where texts are short), each packed by one task: what is in different slots is in different inputs, so the constraint holds
    over all of them. input_no is slot * 2^20 + number. Null and empty texts have 0 tokens, clash with nothing and still
    get an input. Null ids are left out; an id delivered again counts once, with its smallest text.
    """
    rows = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source")).filter("doc_id is not null")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "source")).alias("s")).select("doc_id", "s.text", "s.source")
    rows = rows.withColumn("cluster", F.xxhash64("text"))
    sized = count_tokens(rows, "text", vocabulary)
    if clusters is not None:
        near = clusters.groupBy(F.col("id").cast("bigint").alias("doc_id")).agg(F.xxhash64(F.min("cluster").cast("string"), F.lit("near")).alias("near"))
        sized = sized.join(near, "doc_id", "left").withColumn("cluster", F.coalesce("near", "cluster")).drop("near")
    sized = materialize(sized.withColumn("cluster", F.when(F.col("n_tokens") > 0, F.col("cluster"))))
    tokens, n = sized.agg(F.sum("n_tokens"), F.count("*")).first()
    slots = max(1, (tokens or 0) // (capacity * inputs_per_task), n // 50_000)
    parts = sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int")))))
    parts = parts.select(
        "doc_id", "source", "cluster", "part", (F.col("part") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * capacity).cast("int").alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id"), F.lit(slots)).alias("slot"),
    )

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("part", "ascending")])
        size = t.column("n_tokens").to_pylist()
        cluster = [None if n == capacity else c for c, n in zip(t.column("cluster").to_pylist(), size)]  # a full part is alone
        bins = pack(size, t.column("source").to_pylist(), cluster, capacity)
        base = t.column("slot")[0].as_py() << 20
        return t.select(["doc_id", "part", "first_token", "n_tokens"]).append_column("input_no", pa.array([base + b for b in bins], pa.int64()))

    return parts.groupBy("slot").applyInArrow(fill, "doc_id bigint, part int, first_token int, n_tokens int, input_no bigint")
