"""Main text of pages: given pages against a plain reading, and templates made for the test."""

import html as H
import re

from sheetlens.llm import htmldom, pages
from sheetlens.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string"


def by_regex(page):
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return " ".join(H.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?!b>)[a-z0-9]+[^>]*>", " ", body))).split())


def test_query_on_all_pages(spark):
    src = {r.page_id: r.html for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()}
    out = QUERIES["op8_wrapper_induction"](spark, SF001).collect()
    assert len(out) == len(src)
    assert all(r.text == by_regex(src[r.page_id]) and r.n_chars == len(r.text) for r in out)


def shop(i, extra=""):
    """A host without semantic tags: fixed header and tagline, varying related links."""
    return (f"<html><head><title>x{i}</title></head><body><div id='top'><div>The Daily Stone</div><p>All about stones</p></div>"
            f"<table><tr><td class='menu'><a href='/a'>Home</a> <a>About</a><td><div class='story'><h2>Stone {i} found</h2>"
            f"<p>Word{i} is &lt;here&gt;&nbsp;and<br>there   {'abc ' * (i % 5 + 3)}{i}.<p>Second <i>para</i>graph {i * 7}.{extra}</div>"
            f"<div class='reader-comments'><p>I like {i}</p></div></table><form><p>Name {i}</p></form>"
            f"<div>Printed on recycled electrons</div><script>var a='<p>no</p>';</script></body></html>")


def test_wrapper_without_semantic_tags(spark):
    rows = [(i, f"http://shop.example/{i}", shop(i, "<ul><li>one<li>two</ul>" if i % 3 == 0 else "")) for i in range(12)]
    out = {r.page_id: r.text for r in pages.extract_main(spark.createDataFrame(rows, SCHEMA), group=2).collect()}
    for i in range(12):
        want = (f"Stone {i} found Word{i} is <here> and there {'abc ' * (i % 5 + 3)}{i}. Second paragraph {i * 7}."
                + (" one two" if i % 3 == 0 else ""))
        assert out[i] == want


def test_matching_is_the_largest():
    a, _ = pages.read_outline("r(x(a,b),y,z(c))")
    b, _ = pages.read_outline("r(x(b),z(c,d),y)")
    memo = {}
    assert pages.simple_tree_matching(a, b, memo)[0] == 5
    assert sorted(x.label for x, _ in pages.align(a, b)) == ["b", "c", "r", "x", "z"]
    pages.merge(a, b)
    assert pages.write_outline(a)[0] == "r(x(a,b),y,z(c,d),y)"


def test_edges(spark):
    article = "<body><nav>menu</nav><article><header><h1>Hi</h1></header><p>one</article><footer>f</footer>"
    rows = [(1, None, None), (2, "http://a.b/", ""), (3, "http://a.b/x", article), (3, "http://a.b/x", article),
            (4, "http://u.v", "<p>alone < 3 &amp; <b>bo</b>ld</p><!-- c --><style>p{}</style>"),
            (5, "https://c.d/", "<main><p>a</p><div class='cookie-notice'>ok?</div><aside>s</aside><p>b</main><p>after"),
            (6, "http://e.f", "<div" + " x='" * 2000), (7, "http://e.g", "plain text &eacute;"), (8, "x", "<p>" * 5000 + "deep"), (9, "y", "<div>" * 30_000 + "deeper"),
            (10, "z", "<article><div class='article-header'><h1>T</h1></div><p>x<section id='comments'><p>c</section></article>")]
    rows += [(20 + i, "http://copies.example/", shop(1)) for i in range(8)]
    out = [(r.page_id, r.text) for r in pages.extract_main(spark.createDataFrame(rows, SCHEMA)).collect()]
    got = dict(out)
    assert len(out) == len(rows)
    assert [got[k] for k in (1, 2, 3, 4, 5, 7, 8, 9, 10)] == [
        "", "", "Hi one", "alone < 3 & bold", "a b", "plain text é", "deep", "deeper", "T x"]
    assert all("Second paragraph 7." in got[20 + i] for i in range(8))
    assert pages.extract_main(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, "u", "<p>x", 5, "k", "h")], SCHEMA + ", _p int, key string, host string")
    r = pages.extract_main(odd).first()
    assert (r.text, r._p, r.key, r.host) == ("x", 5, "k", "h")


def test_nested_elements_close():
    root, blocks = htmldom.parse("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><dl><dt>e<dd>f<dt>g</dl><p>h<div>i</p>j</div>")
    assert [t for _, t in blocks] == list("abcdefghij")


def test_deep_elements_close_only_themselves():
    deep = "<div>" * 250 + "deep<div class='advert'>buy<p>now</p></div>still" + "</div>" * 250
    root, blocks = htmldom.parse(f"<div id=page><article><p>a</p>{deep}<p>b</p></article><div>c</div></div><p>d")
    assert [t for _, t in blocks] == ["a", "deep", "still", "b", "c", "d"]
    page = root.children[0]
    assert [n.tag for n in page.children] == ["article", "div"] and page.children[0].children[-1] is blocks[3][0]
    root, blocks = htmldom.parse("<div>" * 300 + "<nav>menu<div>more</div></nav>text")
    assert [t for _, t in blocks] == ["text"]


def test_template_inside_an_article_is_removed(spark):
    page = ("<body><article><h1>News {0}</h1><h2>Summary</h2><p>text {0} here</p><div class='box'><h3>Join us</h3>"
            "<p>Get our letter</p></div><div>body {0}<p>always the same</p></div>{1}</article></body>")
    rows = [(i, f"http://n.example/{i}", page.format(i, "<table><tr><td>copied</table>" if i >= 8 else "")) for i in range(8)]
    rows += [(8 + k, "http://n.example/c", page.format(8, "<table><tr><td>copied</table>")) for k in range(6)]
    out = {r.page_id: r.text for r in pages.extract_main(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(14):
        k = min(i, 8)
        assert out[i] == f"News {k} Summary text {k} here body {k} always the same" + (" copied" if k == 8 else "")


def test_names_made_of_words_of_the_article(spark):
    page = ("<body><div id='site'><article><h1 class='social-title'>T {0}</h1><p>one {0}</p>"
            "<section id='related-work'><h2 id='social-effects'>Effects {0}</h2><p>work {0}</p></section>"
            "<p>sum <math><mi>x</mi><mo>+</mo><mn>{0}</mn><annotation>x+{0}</annotation></math> end</p>"
            "<section id='related'><p>see {0}</p></section><div class='related-links'><p>also {0}</p></div></article></div>")
    rows = [(i, f"http://m.example/{i}", page.format(i)) for i in range(7)] + [(9, "http://alone.example/", page.format(9))]
    for r in pages.extract_main(spark.createDataFrame(rows, SCHEMA)).collect():
        i = r.page_id
        assert r.text == f"T {i} one {i} Effects {i} work {i} sum x+{i} end"
