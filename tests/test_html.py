from __future__ import annotations

from clausewright.operators import html

LISTING = """
<table class="other"><tr><td><a href="no.pdf">No</a></td><td>No</td></tr></table>
<table class="x bylawDefault"><tr><th>Id</th><th>Title</th></tr>
<tr><td><a href=" /a/one.pdf ">Chapter 1</a></td><td>One
 &amp; more</td><td><a href="am.pdf">amended</a></td></tr></td>
<tr><td><a href="two.PDF">Chapter 2</a><td>Two
<tr><td><a href="three.htm">Chapter 3</a></td><td>Three</td></tr>
<tr><td><a>Chapter 4</a></td><td>Four</td></tr>
<tr><td><a href="r.pdf">Chapter 5</a></td><td>reSERved for later</td></tr></table>
<table class="bylawDefault"><tr><td><a href="https://o.example/six.pdf">Chapter 6</a></td><td>Six</td></tr></table>
"""


def test_chapters(spark):
    pages = spark.createDataFrame([("p", LISTING), ("q", None), ("r", "")], "page string, html string")
    got = html.chapter_index(html.html_rows(pages, "html"), ["page"], "https://c.example/d/").orderBy("pos").collect()
    assert [(r.bylaw_id, r.title, r.pdf_url, r.pos) for r in got] == [
        ("Chapter 1", "One\n & more", "https://c.example/a/one.pdf", 0),
        ("Chapter 2", "Two", "https://c.example/d/two.PDF", 1),
        ("Chapter 6", "Six", "https://o.example/six.pdf", 2),
    ]


def test_tag_stack_nests_what_is_not_closed():
    bad = "<table class=bylawDefault><tr><th>h<tr><td>1</td><td>2</td></tr></table>"
    assert [len(r["cells"]) for r in html.table_rows(html.parse(bad), "bylawDefault")] == [0, 2]
    assert [len(r["cells"]) for r in html.table_rows(html.parse(bad, flat=False), "bylawDefault")] == [2, 2]


def test_text_and_meta(spark):
    page = "<body><nav>menu</nav><main><h1> A <i>b</i></h1><script>x</script><p class='IntroParagraph y'>Bylaw number: 12 <b>x</b></p>text</main></body>"
    assert html.page_text(html.parse(page)) == "A\nb\nBylaw number: 12\nx\ntext"
    assert html.page_meta(html.parse(page)) == {"h1": "Ab", "intro": ["Bylaw number: 12 x"]}
    assert html.page_text(html.parse("<main>m</main><div id='printAreaContent'>c</div>")) == "c"
    assert html.page_text(html.parse("just text")) == "just text"


def test_link_filters(spark):
    page = "<p>(2011)-19184 <a href='mailto:a'>m</a><a href='x-bylaw.aspx'>x</a><a href='x-bylaw.ASPX'>y</a><a href='/wp-content/uploads/f.PDF'>f</a><a name=q>n</a></p>"
    df = html.html_links(spark.createDataFrame([(1, page)], "i int, html string"), "html")
    from pyspark.sql import functions as F

    assert [r.href for r in df.filter(html.is_page_link(F.col("href"))).collect()] == ["x-bylaw.aspx"]
    upload = df.filter(html.is_upload_link(F.col("href"))).first()
    assert upload.href.endswith("f.PDF") and upload.around.startswith("(2011)-19184")
