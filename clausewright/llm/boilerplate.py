"""Lines that a source adds to many of its documents (problem 6).

Lines are nodes and consecutive lines edges of a graph per source, weighted by the number of groups that hold
them. Nodes and edges of high support are kept; connected components are the boilerplate blocks, and every
occurrence of their lines is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.operators.graph import connected_components
from clausewright.runtime import materialize


def line_key(line: Column) -> Column:
    """Digits dropped, lower case, every other run than a-z one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, "[0-9]", "")), "[^a-z]+", " "))


def source_lines(docs: DataFrame, doc: str, group: str, source: str, text: str, min_words: int = 4) -> DataFrame:
    """(doc, group, source, line_no, key, k1, k2) of the lines with at least min_words words; k1 and k2 are a 128-bit
    hash of source and key. Sources are compared without case and outer spaces; rows without source, group or
    text have no lines."""
    src = F.lower(F.trim(source))
    rows = docs.select(F.col(doc).alias("doc"), F.col(group).alias("grp"), src.alias("source"), F.split(text, "\n").alias("lines"))
    rows = rows.filter("doc is not null and grp is not null and source <> '' and lines is not null")
    lines = rows.select("doc", "grp", "source", F.posexplode("lines").alias("at", "line"))
    lines = lines.select("doc", "grp", "source", (F.col("at") + 1).alias("line_no"), line_key(F.col("line")).alias("key"))
    lines = lines.filter(F.length("key") - F.length(F.replace("key", F.lit(" "), F.lit(""))) >= min_words - 1)
    return lines.filter("key <> ''").withColumns({"k1": F.xxhash64("source", "key"), "k2": F.xxhash64(F.lit(7), "key", "source")})


def repeated_lines(lines: DataFrame, docs: DataFrame, group: str, source: str, min_groups: int = 5, min_share: float = 0.04) -> DataFrame:
    """(source, k1, k2, n_groups): nodes of high support, in at least min_groups groups and min_share of the source's.

    Distinct (line, group) pairs are formed before the shuffle, so a line that stands in a third of all documents
    arrives as one row a group and task.
    """
    total = docs.select(F.lower(F.trim(source)).alias("source"), F.col(group).alias("grp")).filter("grp is not null and source <> ''")
    total = total.distinct().groupBy("source").agg(F.count("*").alias("n_all"))
    seen = lines.groupBy("k1", "k2", "grp").agg(F.first("source").alias("source"))
    seen = seen.groupBy("k1", "k2").agg(F.count("*").alias("n_groups"), F.first("source").alias("source")).filter(F.col("n_groups") >= min_groups)
    return seen.join(total, "source").filter(F.col("n_groups") >= F.lit(min_share) * F.col("n_all") - 1e-9).select("source", "k1", "k2", "n_groups")


def occurrences(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc, line_no, k1, k2, grp) of every line that is a node."""
    return lines.join(nodes.select("k1", "k2"), ["k1", "k2"], "left_semi").select("doc", "line_no", "k1", "k2", "grp")


def line_edges(seen: DataFrame, min_groups: int = 5) -> DataFrame:
    """(k1, k2, n1, n2, weight): lines that follow each other in a document, by the number of groups that hold both so, of those
    with min_groups or more. seen: occurrences of nodes; of an edge the pairs of one group are one row before the shuffle."""
    w = Window.partitionBy("doc").orderBy("line_no")
    # one delivery of a document: repeated rows hold the same lines
    steps = seen.distinct().withColumns({"n1": F.lead("k1").over(w), "n2": F.lead("k2").over(w), "next_no": F.lead("line_no").over(w)}).filter("next_no = line_no + 1")
    held = steps.groupBy("k1", "k2", "n1", "n2", "grp").agg(F.lit(1).alias("one"))
    return held.groupBy("k1", "k2", "n1", "n2").agg(F.count("*").alias("weight")).filter(F.col("weight") >= min_groups)


def boilerplate_blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, k1, k2, n_groups, block): the nodes with the component of the graph that each belongs to; a node without an edge is a
    block of its own."""
    node = lambda a, b: F.concat_ws(":", a, b)
    parts = connected_components(edges.select(node("k1", "k2").alias("src"), node("n1", "n2").alias("dst")))
    return nodes.withColumn("node", node("k1", "k2")).join(parts, "node", "left").select("source", "k1", "k2", "n_groups", F.coalesce("component", "node").alias("block"))


def remove_lines(docs: DataFrame, doc: str, text: str, found: DataFrame) -> DataFrame:
    """(doc, text) of all docs, without the lines found. Null texts stay null; a text that loses all its lines is ''.
    Of a repeated doc the smallest text remains."""
    gone = found.groupBy("doc").agg(F.collect_set("line_no").alias("gone"))  # at most as many as one text has lines
    rows = docs.groupBy(F.col(doc).alias("doc")).agg(F.min(text).alias("text")).filter("doc is not null")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains("gone", i + 1))
    return rows.join(gone, "doc", "left").select("doc", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))


def site_lines(docs: DataFrame, doc: str, group: str, source: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, found): the boilerplate blocks, a row a line, and every occurrence (doc, line_no, block) of their lines.

    The texts are cut into lines once. Lines of high support are the nodes and those that follow each other with high support
    the edges; components are the blocks, and what matches a line of a block is found. A site line needs no neighbour: alone it is a
    block. An empty input gives none.
    """
    lines = materialize(source_lines(docs, doc, group, source, text).select("doc", "grp", "source", "line_no", "k1", "k2"))
    nodes = materialize(repeated_lines(lines, docs, group, source))
    seen = materialize(occurrences(lines, nodes))
    blocks = materialize(boilerplate_blocks(nodes, line_edges(seen)))
    return blocks, seen.join(blocks.select("k1", "k2", "block"), ["k1", "k2"]).select("doc", "line_no", "block")
