"""HTML extraction on pages written by hand, not by the generator, and on broken and very deep ones."""

import re
import time

import pytest

from seqlab.llm import html_text

P = ["Rivers carry more than water, and people have known this for a long time.", "In spring the banks give way; the mud travels south, slowly, for weeks.", "Nobody who lives there is surprised by it. They build their houses on stilts, and wait."]

#: Name: (page, its main text).
PAGES = {
    "article with boilerplate": (
        f"""<!doctype html><html><head><title>Rivers | Site</title><style>p {{color: red}}</style></head><body><header><a href=/>Home</a> <a href=/b>Blog</a></header>
        <article><h1>Rivers</h1><p>{P[0]}</p><p>{P[1]}</p><form><input><button>Send</button></form><p>{P[2]}</p></article>
        <section id=comments class="comment-list"><div class=comment><p>Nice text, thanks!</p></div></section><footer>All rights reserved 2020</footer></body></html>""",
        f"Rivers {P[0]} {P[1]} {P[2]}",
    ),
    "main in divs": (
        f"""<html><body><div class="navbar"><ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul></div><div class="cookie-notice">We use cookies. <a href=x>More</a></div>
        <div class="content"><h2>Mud &amp; water</h2><p>{P[0]}<p>{P[1]}<ul><li>First point, in short.<li>Second point, in short.</ul></div>
        <div class="sidebar"><h3>Related</h3><ul><li><a href=1>Other</a></li><li><a href=2>Another</a></li></ul></div></body></html>""",
        f"Mud & water {P[0]} {P[1]} First point, in short. Second point, in short.",
    ),
    "math, noscript and inline tags": (
        f"<body><main><p>{P[0]}</p><p>a <math><mi>x</mi></math> b <noscript>n</noscript> c<sup>2</sup> d&#8217;e</p><script>if (a < b) {{ '</p>' }}</script><p>{P[1]}</p></main></body>",
        f"{P[0]} a x b n c2 d’e {P[1]}",
    ),
}


@pytest.fixture(scope="module")
def trees(spark):
    return html_text.fit(spark, spark.createDataFrame([(1, "u", None)], "page_id long, url string, html string"))


def test_structure_decides_where_names_are_missing(spark):
    """Trained on the given pages: with semantic elements renamed, and without any attribute, at least nine of ten pages keep their text."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    fitted, named = html_text.fit(spark, pages), [r.html for r in pages.select("html").collect()]
    bare = [re.sub(r"<(/?)(?:article|main|nav|header|footer|aside|section)\b[^>]*>", r"<\1div>", p) for p in named]
    want = html_text.extract_texts(named, fitted)
    for changed in (bare, [re.sub(r"<(\w+)\s[^>]*>", r"<\1>", p) for p in bare]):
        same = sum(a == b and a != "" for a, b in zip(html_text.extract_texts(changed, fitted), want))
        assert same >= 0.9 * len(named)
    menu = "<a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a>"
    both = f"{P[0]} {P[1]} {P[2]}"
    assert html_text.extract_texts([f"<div><div>{menu}</div><div><p>{P[0]} {P[1]}</p><p>{P[2]}</p></div></div>", f"<html><body><table><tr><td>{menu}</td><td><p>{P[0]} {P[1]}</p><p>{P[2]}</p></td></tr></table></body></html>"], fitted) == [both, both]


@pytest.mark.parametrize("name", PAGES)
def test_pages_by_hand(trees, name):
    page, want = PAGES[name]
    assert html_text.extract_texts([page], trees) == [want]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p title=it's>hello", "hello"),
        ("<p title=\"it's\">hello</p>", "hello"),
        ("a<br/>b<b>c</b>d", "a bcd"),
        ("x <!-- never closed", "x"),
        ("x <!--> y <!-- z --!> w", "x y w"),
        ("x < y and 1 <2", "x < y and 1 <2"),
        ("</> a </ b> c", "a c"),
        ("a <p title='no end", "a"),
        ("<p a=b/c d='>'>e", "e"),
        ("A<b>B</b>C", "ABC"),
        ("<ul><li>a<ul><li>b</ul>c<li>d</ul>", "a b c d"),
        ("<script>x</scripty></script >y", "y"),
    ],
)
def test_markup(page, want):
    root = html_text.parse(page)
    nodes, _, _ = html_text.features(root)
    assert html_text.text_of(root, [True] * len(nodes)) == want


@pytest.mark.parametrize("page", ["<a title=\"x'" * 60_000, "<p title=it's \"" * 60_000, "<b>x" * 60_000, "<div>" * 60_000 + "y" + "</i></div>" * 60_000, "<b><div>" + "<i>" * 30_000 + "</b>" * 30_000, "< <" * 100_000, "<!-" * 100_000])
def test_long_broken_pages_take_linear_time(trees, page):
    began = time.process_time()
    html_text.extract_texts([page], trees)
    assert time.process_time() - began < 30


def test_order_is_kept_at_any_depth():
    page = "<b>" * 5000 + "A<b>B</b>C" + "</b>" * 5000 + "D"
    root = html_text.parse(page)
    assert html_text.text_of(root, [True] * len(html_text.features(root)[0])) == "ABCD"


def test_edges(spark, trees):
    rows = [(1, "u", None, "x"), (2, None, "", "y"), (None, "u", "<article><p>" + "word, and more. " * 50_000, "z"), (None, "u", "<article><p>" + "word, and more. " * 50_000, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df, trees).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 799_999, 799_999] and html_text.extract(df.limit(0), trees).count() == 0
