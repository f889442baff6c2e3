import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corvath.functions import text as tx
from corvath.sources import parse


def test_query_terms():
    assert tx.query_terms(" Ranking of a Index ") == ["ranking", "of", "index"]
    assert tx.query_terms("x") == ["x"]
    assert tx.query_terms("a ranking ranking") == ["ranking", "ranking"]
    assert tx.query_terms("ranking ranking", distinct=True) == ["ranking"]


def test_occurrences_don_t_overlap(spark):
    assert spark.range(1).select(tx.occurrences(F.lit("aaaa"), "aa").alias("n")).first().n == 2


@pytest.mark.parametrize("name,mime,parser", [("a.PDF", None, "pdf"), ("a.md", "text/html", "markdown"), ("a.html", None, "html"), ("b.py", None, "code"), ("b", "text/x-code", "code"), ("b.txt", "text/plain", "text"), (None, None, "text"), ("d.docx", None, "docx"), ("x", "text/markdown", "text")])
def test_parser_dispatch(spark, name, mime, parser):
    got = spark.createDataFrame([(name, mime)], "n string, m string").select(parse.parser_of(F.col("n"), F.col("m")).alias("p")).first().p
    assert got == parser


def test_decode(spark):
    df = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"caf\xe9"),), (None,)], "b binary")
    assert [r.t for r in df.select(parse.decode(F.col("b")).alias("t")).collect()] == ["é", "café", None]


def test_text_blocks_and_title(spark):
    df = spark.createDataFrame([("a", "one\r\n\n two \n"), ("b", None), ("c", "")], "id string, t string")
    assert [(r.document_id, r.line_start, r.text) for r in parse.text_blocks(df, "id", "t").orderBy("line_start").collect()] == [("a", 1, "one"), ("a", 3, " two ")]
    assert spark.range(1).select(tx.stem_title(F.lit("/x/team_meeting-notes.txt")).alias("t")).first().t == "Team Meeting Notes"


def test_markdown(spark):
    df = spark.createDataFrame([("a", "intro\n# Architecture\ntext one\n\nmore\n## Part two\n\n## Part three\nlast")], "id string, t string")
    got = [(r.section, r.line_start, r.line_end, r.text) for r in parse.markdown_blocks(df, "id", "t").orderBy("line_start").collect()]
    assert got == [("General", 1, 1, "intro"), ("Architecture", 3, 5, "text one\n\nmore"), ("Part three", 9, 9, "last")]
    assert df.select(parse.markdown_title(F.col("t"), F.lit("x.md")).alias("t")).first().t == "Architecture"


def test_code_windows(spark):
    df = spark.createDataFrame([("a", "m.py", "\n".join(f"l{i}" for i in range(65)) + "\n"), ("b", "n.py", "")], "id string, n string, t string")
    got = [(r.section, r.line_start, r.line_end) for r in parse.code_blocks(df, "id", "t", "n").orderBy("line_start").collect()]
    assert got == [("m.py:1-40", 1, 40), ("m.py:31-65", 31, 65), ("m.py:61-65", 61, 65)]
    assert spark.range(1).select(parse.language_of(F.lit("a/b.RS")).alias("l")).first().l == "rust"
    assert [spark.range(1).select(parse.language_of(F.lit(n)).alias("l")).first().l for n in ("x.ps1", "x.toml", "x")] == ["powershell", "code", "code"]


HTML = "<html><head><title>Search  notes</title><script>alert('p')</script></head><body><h1>Top</h1><p>One <b>two<p>three</p><ul><li>x</ul><a href='/a?b=1#c'>l</a><a href='mailto:x@y.z'>m</a><a href='pic.PNG'>i</a><a href='HTTPS://Other.org/p'>o</a></body></html>"


def test_html(spark):
    title, blocks, _ = parse.parse_html(HTML)
    assert title == "Search  notes" and ("h1", "Top") in blocks and not any("alert" in t for _, t in blocks)
    assert ("p", "One two three x l m i o") in blocks  # an open <p> holds all that follows
    assert ("p", "One two") in parse.parse_html(HTML, implied_end_tags=True)[1]
    assert parse.parse_html("<h1>Only</h1>", "stem")[0] == "Only" and parse.parse_html("", "stem")[0] == "stem"
    df = spark.createDataFrame([("a", "http://x.org/d/", HTML), ("b", "http://x.org/", None)], "id string, url string, html string")
    assert [r.link for r in parse.html_links(df, "id", "url", "html").orderBy("link_no").collect()] == ["http://x.org/a?b=1#c", "HTTPS://Other.org/p"]
    assert parse.html_blocks(df, "id", "html").where("document_id = 'b'").count() == 0


def test_docx(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p><w:pPr>{s}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    xml = f'<w:document {w}><w:body>{p("before")}{p("Scope", "<w:pStyle w:val=%sHeading1%s/>" % (chr(34), chr(34)))}{p("inside")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    df = spark.createDataFrame([("a", bytearray(data.getvalue())), ("b", None)], "id string, content binary")
    got = [(r.section, r.is_table, r.text) for r in parse.docx_blocks(df, "id", "content").orderBy("block_no").collect()]
    assert got == [("Introduction", False, "before"), ("Scope", False, "inside"), ("Scope", True, "a | b")]


def test_search_results(spark):
    html = '<a class="result__a" href="//d.example/l/?uddg=https%3A%2F%2Fa.org%2Fx&amp;rut=1">A <b>t</b></a><a class="result__snippet" href="#">about a</a><a class="result__a" href="https://b.org/">B</a>'
    got = parse.search_results(spark.createDataFrame([(html,)], "h string"), "h").orderBy("position").collect()
    assert [(r.title, r.url, r.domain) for r in got] == [("A t", "https://a.org/x", "a.org"), ("B", "https://b.org/", "b.org")]


def test_page_blocks(spark):
    df = spark.createDataFrame([("a", 2, "one\n\n two \n\n\n\n")], "id string, page int, t string")
    assert [(r.page_number, r.text) for r in parse.page_blocks(df, "id", "page", "t").orderBy("block_no").collect()] == [(2, "one"), (2, "two")]
