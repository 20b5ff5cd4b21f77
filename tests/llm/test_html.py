import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from verdimill.llm.html_extract import _measure, extract, extract_pages, parse

LONG = "The quick brown fox jumps over the lazy dog near the river bank, and then it rests. " * 4
WORDS = " ".join(LONG.split())


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""),
        ("plain text &amp; more", "plain text & more"),
        ("<article><h1>T</h1><p>a  b\n c<p>d</article><footer>x</footer>", "T a b c d"),
        ("<body><nav><a href=x>Menu</a></nav><article><p>A<b>B</b>C<br>D</p></article></body>", "ABC D"),
        ("<article><p><b>one<br><p>two &lt;x&gt; &eacute;&#233;&nbsp;z</article>", "one two <x> éé z"),
        ("<script>var t='</p><article>no</article>';</script><article>yes</article>", "yes"),
        ("<article>a<script>if (a<b) x('</art')</script>b<!-- c --> d<style>p{}</style></article>", "ab d"),
        ("<article>a<!-- never closed <p>b</p></article>", "a"),
        ("<ARTICLE CLASS=post><P>Hi</P></ARTICLE><DIV CLASS='Sidebar'>no</DIV>", "Hi"),
        ("<article><p>x</p><section id='comments'><p>bad</p></section><div class=\"share-box\">s</div></article>", "x"),
        ("<article><header><h1>T</h1></header><p>x</p><footer>f</footer><form>q<input></form></article>", "T x"),
        ('<article><p title="a>b">x</p><p>5 < 6 and <3</p></article>', "x 5 < 6 and <3"),
        ("<nav>only menu</nav><footer>only footer</footer>", ""),
        ("<article></article>", ""),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table></article>", "a b c d e"),
        ("<article><p>x</p></article></body></html>", "x"),
        ("<div class='layout has-sidebar'><h1>T</h1><p>words here</p><div class=sidebar><p>no</p></div></div>", "T words here"),
        ("<main><div id=comments><article><p>reader</p></article></div><p>text</p><div hidden>no</div></main>", "text"),
        ("<article><p>unfinished <a href='x", "unfinished"),
    ],
)
def test_pages(html, want):
    assert extract(html) == want


def test_density_without_semantic_tags():
    menu = "".join(f"<li><a href='/{i}'>Section number {i}</a></li>" for i in range(30))
    html = f"<html><body><div><ul>{menu}</ul></div><div><h1>Title here</h1><div><p>{LONG}</p><p>{LONG}</p><p>Short end.</p></div></div><div><a href=a>About us</a> <a href=b>Contact</a></div></body></html>"
    assert extract(html) == f"Title here {WORDS} {WORDS} Short end."


@pytest.mark.parametrize("names", [("article", "main"), ("div", "div"), ("section", "div")])
def test_tables_of_pages(spark, sf, names):
    """Brute force: what stands between the tags of the article, whatever these are called."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    renamed = pages.withColumn("html", F.regexp_replace("html", r"(</?)article(?=[\s>/])", f"$1{names[0]}")).withColumn("html", F.regexp_replace("html", r"(</?)main(?=[\s>/])", f"$1{names[1]}"))
    for r in extract_pages(renamed).collect():
        a = re.search("<article>(.*?)</article>", html[r.page_id], re.S)[1]
        want = " ".join(unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", a))).split())
        assert (r.text, r.n_chars) == (want, len(want))


def test_the_core_has_the_largest_density_sum():
    """Brute force over all subtrees of a page, with sums written out anew."""
    html = "<div><p>" + LONG + "</p><p>" + LONG + "</p></div><div><ul>" + "<li><a href=x>some link</a></li>" * 20 + "</ul></div>"
    nodes, root = _measure(parse(html))
    for x in nodes:
        kids = [k for k in nodes if k.up is x]
        if kids:
            own = sum(len(k.strip()) for k in x.kids if isinstance(k, str))
            assert x.total == pytest.approx((sum(k.density for k in kids) or x.density) + own)
    assert max(nodes, key=lambda x: x.total).tag == "div"


def test_edge_cases(spark):
    rows = [(1, "u", None, "x"), (None, None, "<p>é😀", "y"), (2, "u", "<article>" + "<div>" * 3000 + "deep", "z"), (2, "u", "<p>" * 50000 + "wide", "z")]
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect())
    assert got == [("1", "", 0), ("2", "deep", 4), ("2", "wide", 4), ("None", "é😀", 2)]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
