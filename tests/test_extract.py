"""HTML by the tokeniser, and extractors over files."""

import pytest
from pyspark.sql import functions as F

from sheaf.functions import html
from sheaf.sources import extract

CASES = [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("it&#8217;s", "it’s"), ("caf&eacute; &#xe9;", "café é"), ('<a title="a>b">x</a>y', "x y"), ("<a title='a\">b'>x</a>", "x"),
    ("a<script>var s='</p>';", "a"), ("a<script>x</script >b<STYLE>p{}</style>c", "a b c"), ("<p>one<br>two<p>three", "one two three"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("a<!-- <p>no</p> -->b<!-- open", "a b"),
    ("<!DOCTYPE html><html><head><title>T</title></head><body>x</body></html>", "x"), ("<nav>a<nav>b</nav>c</nav>d</nav>e", "d e"), ("<header>kept</header>", "kept"), ("<a href=\"open>x", "x"), ("&nbsp;a&nbsp;&nbsp;b &copy;", "a b ©"), ("&lt;p&gt; &amp;lt;", "<p> &lt;"), ("&unknown; &#xZZ; &", "&unknown; &#xZZ; &"),
]


@pytest.mark.parametrize(("source", "text"), CASES)
def test_text_of_html(source, text):
    assert html.text_of(source) == text


def test_titles_and_very_long_pages():
    assert html.title_of("<TITLE lang=x> A &amp;\n B</title><title>no</title>") == "A & B" and html.title_of(None) == html.title_of("<p>") == "" and html.title_of("<title>open") == "open"
    assert html.text_of("<p a='" + "x>" * 300_000 + "'>end") == "end" and len(html.text_of("<b>ab</b> " * 100_000)) == 299_999
    assert html.text_of("<" * 20_000) == "<" * 20_000 and html.text_of("<a <b '" * 200_000) == ("<a <b '" * 200_000).strip()


def test_html_column(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(CASES)], "i int, html string")
    assert {r["i"]: r["t"] for r in df.select("i", html.html_text(F.col("html")).alias("t")).collect()} == {i: t for i, (_, t) in enumerate(CASES)}


class WithUpper(extract.ExtractedFiles):
    extractors = {**extract.EXTRACTORS, ".up": lambda b: b.decode("ascii").upper()}

    @classmethod
    def name(cls):
        return "with_upper"


def test_data_source_over_a_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.html").write_text("<p>Hello &amp; more</p>")
    (tmp_path / "deep" / "b.TXT").write_text("text é", encoding="utf-8")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe broken")
    (tmp_path / "d.up").write_text("loud")
    (tmp_path / "_hidden.txt").write_text("no")
    spark.dataSource.register(extract.ExtractedFiles)
    spark.dataSource.register(WithUpper)
    rows = {r["file_name"]: r for r in spark.read.format("extracted").option("files_per_task", 2).load(str(tmp_path)).collect()}
    assert {n: r["text"] for n, r in rows.items()} == {"a.html": "Hello & more", "b.TXT": "text é", "c.txt": None, "d.up": None}
    assert rows["c.txt"]["error_message"].startswith("UnicodeDecodeError") and rows["d.up"]["error_message"] == "unsupported file type: .up" and rows["b.TXT"]["file_ext"] == ".txt"
    assert {r["file_name"]: r["text"] for r in spark.read.format("with_upper").load(str(tmp_path)).collect()}["d.up"] == "LOUD"
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    assert {r["file_name"]: r["text"] for r in extract.extracted(read).collect()} == {n: r["text"] for n, r in rows.items()}


def test_no_files(spark, tmp_path):
    spark.dataSource.register(extract.ExtractedFiles)
    assert spark.read.format("extracted").load(str(tmp_path)).count() == 0


def test_an_entity_cut_short_stays():
    assert html.text_of("<p>a&amp;&amp</p>b &am &#8217 &ampx; &lt;") == "a&&amp b &am &#8217 &ampx; <" and html.title_of("<title>x &amp</title>") == "x &amp"
