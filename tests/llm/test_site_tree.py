import html
import re

import duckdb

from coldkeep.llm.queries import QUERIES
from coldkeep.llm.site_tree import extract, main_blocks
from tests.conftest import SF


def article(page):
    """The text of the given pages' one article, by its tags."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = (re.sub("<br>", " ", re.sub(r"</?(b|a)\b[^>]*>", "", x)) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_whole_table(spark):
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in QUERIES["op1_site_style_tree"](spark, SF).collect()}
    assert got == {i: (u, article(h), len(article(h))) for i, u, h in rows}


def text(page):
    return "\n".join(b.text for b in main_blocks(page))


def test_furniture_and_references():
    page = """<body><header><h1>Site</h1></header><div id="sidebar">x</div><aside>a</aside><div class="cookie-notice">c</div><main>
    <article class="post"><header><h1>T &amp; x &eacute;&#233;&#xe9;</h1></header><p>One <a href="x>y">two</a>&nbsp; three<br>four<p>Five<form><input>no</form>
    <ul><li>a<li>b <b>c</b></ul><div class="ad-box">z</div><table><tr><td>1<td>2</table><!-- <p>gone --><script>"</p>"</script>
    <section id="comments"><article class="c comment">hi</article></section><p hidden>h</p><div style="display: none">n</div><p>x < y &copy</article></main><footer>f"""
    assert text(page).split("\n") == ["T & x ééé", "One two three four", "Five", "a", "b c", "1", "2", "x < y ©"]


def test_odd_pages():
    assert text(None) == text("") == text("<!-- never closed <p>x") == text("<script>x") == ""
    assert text("plain  text") == "plain text" and text("<p>a</div></p></b>b<") == "a\nb<"
    assert text("<nav><a href=/>m</a><article><p>kept</p></article>") == "kept"
    assert text('<p class="a>b</p><p>c</p>')
    long = "<div>" * 3000 + "deep" + "<p>word</p>" * 20000
    assert text(long).count("word") == 20000


def page(body, style="s"):
    return f'<html><body><div class="{style}"><div class="body">{body}</div></div></body></html>'


def test_site_statistics(spark):
    pages = [(i, f"http://Site.example/{i}", page(
        f'<div class="x1">Same slogan here</div><p>Own text {i} of this page.</p><p>Write to us today!</p><div class="x2">by author {i % 5}</div>')) for i in range(20)]
    copies = [(100 + i, "http://copy.example/a", page("<p>One page, many copies.</p>")) for i in range(30)]
    few = [(200 + i, f"https://few.example:8080/{i}", page(f"<p>Same</p><p>{i}</p>")) for i in range(3)]
    odd = [(300, None, None), (301, "not a url", ""), (302, "http://other.example", page("<p>Same slogan here</p>")), (None, None, page("<p>x</p>"))]
    df = spark.createDataFrame([(*r, "t", 1) for r in pages + copies + few + odd], "page_id long, url string, html string, text string, host int")
    got = {r.page_id: r.text for r in extract(spark, df).collect()}
    for i in range(20):
        assert got[i] == f"Own text {i} of this page.\nby author {i % 5}"
    assert {got[100 + i] for i in range(30)} == {"One page, many copies."}
    assert got[200] == "Same\n0" and got[300] == got[301] == "" and got[302] == "Same slogan here" and got[None] == "x"
    assert extract(spark, df.limit(0)).collect() == []
