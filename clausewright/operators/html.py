"""Reading HTML: tables, links, text and metadata, in Arrow batches on the standard parser."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Elements without content, and elements whose text is not shown.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "template", "noscript"}
#: What an opening tag closes in the flat reading, up to the nearest table.
IMPLIED = {"tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "li": {"li"}, "option": {"option"}, "p": {"p"}}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None"):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator["Node"]:
        todo = [self]
        while todo:
            node = todo.pop()
            if node is not self:
                yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find(self, *tags: str) -> "Node | None":
        return next((n for n in self.walk() if n.tag in tags), None)

    def strings(self) -> Iterator[str]:
        todo: list = [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                yield node
            elif node.tag not in HIDDEN:
                todo.extend(reversed(node.children))

    def text(self, separator: str | None = None) -> str:
        """All text stripped as a whole, or, with a separator, the stripped non-empty pieces joined."""
        if separator is None:
            return "".join(self.strings()).strip()
        return separator.join(s for s in (x.strip() for x in self.strings()) if s)


class _Builder(HTMLParser):
    def __init__(self, flat: bool):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        self.flat = flat

    def handle_starttag(self, tag, attrs):
        if self.flat and tag in IMPLIED:
            node = self.at
            while node.parent is not None and node.tag not in ("table", "body"):
                if node.tag in IMPLIED[tag]:
                    self.at = node.parent
                node = node.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            if self.flat and node.tag == "table" and tag in ("td", "th", "tr", "p", "li"):
                return
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None, flat: bool = True) -> Node:
    """The document as a tree. flat: a new row, cell, item or paragraph ends the open one, and stray end tags do not leave
    their table. Otherwise tags nest as written and an end tag closes the nearest open one of its name."""
    b = _Builder(flat)
    b.feed(html or "")
    b.close()
    return b.root


def table_rows(root: Node, css_class: str) -> list[dict]:
    """Rows of the tables whose class has the token: number of table and row, cells with text, first link's text and href."""
    out = []
    tables = [n for n in root.walk() if n.tag == "table" and css_class in n.attrs.get("class", "").split()]
    for t, table in enumerate(tables):
        for r, row in enumerate(n for n in table.walk() if n.tag == "tr"):
            cells = []
            for cell in (n for n in row.walk() if n.tag == "td"):
                a = cell.find("a")
                cells.append({"text": cell.text(), "link": a.text() if a else None, "href": a.attrs.get("href") if a else None})
            out.append({"table_no": t, "row_no": r, "cells": cells})
    return out


def container(root: Node) -> Node:
    found = next((n for n in root.walk() if n.attrs.get("id") == "printAreaContent"), None)
    return found or root.find("main") or root.find("body") or root


def links(root: Node, scoped: bool) -> list[dict]:
    """Anchors with an href in document order: href, text, text of the parent."""
    found = [n for n in (container(root) if scoped else root).walk() if n.tag == "a" and "href" in n.attrs]
    return [{"pos": i, "href": a.attrs["href"], "text": a.text(""), "around": a.parent.text(" ") if a.parent else ""} for i, a in enumerate(found)]


def page_text(root: Node) -> str:
    return container(root).text("\n")


def page_meta(root: Node) -> dict:
    """Text of the first h1 and of the introductory paragraphs."""
    h1 = root.find("h1")
    intro = [n.text(" ") for n in root.walk() if n.tag == "p" and "IntroParagraph" in n.attrs.get("class", "").split()]
    return {"h1": h1.text("") if h1 else None, "intro": intro}


CELLS = "array<struct<table_no:int,row_no:int,cells:array<struct<text:string,link:string,href:string>>>>"
LINKS = "array<struct<pos:int,href:string,text:string,around:string>>"
META = "struct<h1:string,intro:array<string>>"


def _read(pages: DataFrame, html: str, name: str, kind: str, read: Callable[[Node], object], flat: bool) -> DataFrame:
    """pages with a column of what `read` finds in each page's HTML instead of the HTML."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    keep = [c for c in pages.columns if c != html]
    kinds = dict(pages.dtypes)
    arrow = to_arrow_type(_parse_datatype_string(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array([read(parse(h, flat)) for h in b.column(html).to_pylist()], arrow)], names=[*keep, name])

    return pages.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{name}` {kind}"]))


def html_rows(pages: DataFrame, html: str, css_class: str = "bylawDefault", flat: bool = True) -> DataFrame:
    read = _read(pages, html, "_rows", CELLS, lambda root: table_rows(root, css_class), flat)
    return read.select(*[c for c in pages.columns if c != html], F.explode("_rows").alias("_r")).select(*[c for c in pages.columns if c != html], "_r.*")


def html_links(pages: DataFrame, html: str, scoped: bool = False) -> DataFrame:
    keep = [c for c in pages.columns if c != html]
    return _read(pages, html, "_links", LINKS, lambda root: links(root, scoped), True).select(*keep, F.explode("_links").alias("_l")).select(*keep, "_l.*")


def html_text(pages: DataFrame, html: str) -> DataFrame:
    return _read(pages, html, "text", "string", page_text, True)


def html_meta(pages: DataFrame, html: str) -> DataFrame:
    return _read(pages, html, "meta", META, page_meta, True)


def chapter_index(rows: DataFrame, keep: list[str], base: str) -> DataFrame:
    """keep + (bylaw_id, title, pdf_url, pos) of table rows with two cells or more, a PDF link and a title that is not reserved.
    keep names the page; positions count within it."""
    if not keep:
        raise ValueError("keep must name the columns that tell pages apart")
    from clausewright.functions.text import py_strip, url_join

    first, second = F.col("cells")[0], F.col("cells")[1]
    r = rows.filter(F.size("cells") >= 2).select(
        *keep, "table_no", "row_no", py_strip(first["link"]).alias("bylaw_id"), py_strip(second["text"]).alias("title"), url_join(py_strip(first["href"]), base).alias("pdf_url")
    )
    r = r.filter("bylaw_id <> '' and title <> ''").filter(F.lower("pdf_url").endswith(".pdf") & ~F.contains(F.lower("title"), F.lit("reserved")))
    w = Window.partitionBy(*keep).orderBy("table_no", "row_no")
    return r.select(*keep, "bylaw_id", "title", "pdf_url", (F.row_number().over(w) - 1).alias("pos"))


def escape(c: Column | str) -> Column:
    """Text as it stands in HTML."""
    return F.replace(F.replace(F.col(c) if isinstance(c, str) else c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def is_page_link(href: Column) -> Column:
    return ~href.startswith("mailto:") & ~href.startswith("tel:") & href.rlike(r"-bylaw\.aspx$")


def is_upload_link(href: Column) -> Column:
    return F.contains(href, F.lit("/wp-content/uploads/")) & F.lower(href).endswith(".pdf")


def first_seen(rows: DataFrame, key: str, pos: str, within: list[str] | None = None) -> DataFrame:
    """The first row of each key by position, nulls left out; one window on the key, so no order of files matters."""
    w = Window.partitionBy(*(within or []), key).orderBy(pos)
    return rows.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
