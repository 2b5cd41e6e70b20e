"""Alias edges in the forms that HTML has them, against urllib and html."""

import html
from urllib.parse import urljoin

from pyspark.sql import functions as F

from seqlab.llm.url_filter import alias_edges, filter_urls, resolved, unescaped

PAGE = "http://h.example.com/a/b/page?x=1"
BLOCKED = "http://h.example.com/de/1"


def test_references(spark):
    texts = ["a&amp;b", "a&#38;b", "&#x26;#38;", "&amp;#38;", "&#x4f60;&#20320;&#128512;", "&#0;", "&#xD800;", "&#99999999999;", "&#x110000;", "plain", "&", "a&b=1&c", "&lt;&gt;&quot;&apos;", "&#65"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescaped(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in rows} == {t: html.unescape(t) for t in texts}


def test_relative_targets(spark):
    cases = [(p, t) for p in (PAGE, "http://h", "http://h/", "http://h/a//b/./c") for t in ("../de/1", "x.html", "?id=2", "/x", "//o.org/y?z", "./", "..", "../../../../q?a=../b", "r?u=http://z/", ".", "https://k.net/1")]
    rows = spark.createDataFrame(cases, "p string, t string").select("p", "t", resolved(F.col("p"), F.col("t")).alias("r")).collect()
    for r in rows:
        if "./c" not in r.p and not (r.p == "http://h" and r.t == "?id=2"):
            assert r.r == urljoin(r.p, r.t), (r.p, r.t, r.r)
    assert {r.r for r in rows if r.p.endswith("./c") and r.t == "x.html"} == {"http://h/a//b/x.html"}


def test_every_form_hands_a_block_on(spark):
    forms = [
        '<link rel="canonical" href="../../de/1">',
        '<link rel="alternate canonical" href="http://h.example.com/de/1">',
        "<link href=/x/../de/1 rel=canonical>",
        '<link rel="canonical" href="http://o.org/"><link rel="canonical" href="http://h.example.com/de/1">',
        '<meta http-equiv="refresh" content="0;url=http://o.org/"><meta http-equiv="refresh" content="5; URL=\'../../de/1\'">',
        '<meta http-equiv="refresh" content="0; http://h.example.com/de/1">',
        '<link rel="canonical" href="http&#58;//h.example.com/d&#x65;/1">',
    ]
    rows = [(i, f"http://p{i}.org/a/b/c" if "/../" not in f else f"http://h.example.com/a/b/c{i}", f) for i, f in enumerate(forms)]
    rows += [(100, PAGE, '<link rel="stylesheet" href="/de/1">'), (101, "http://p101.org/", '<meta http-equiv="refresh" content="50">'), (102, "http://p102.org/", '<link rel="canonical" href="#top">')]
    got = {r.page_id: r.verdict for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "block" for i in range(len(forms))} | {100: "allow", 101: "allow", 102: "allow"}


def test_escaped_query_joins_its_page(spark):
    rows = [(1, "http://h.example.org/q", '<link rel="canonical" href="http://h.example.com/de/?a=1&amp;b=2">')]
    edges = alias_edges(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(e.a, e.b) for e in edges] == [("h.example.org/q", "h.example.com/de/?a=1&b=2")]


def test_base_comments_and_scripts(spark):
    def page(i, html):
        return (i, f"http://a.org/p{i}", html)

    rows = [
        page(1, '<base href="http://example.com/de/x/"><link rel=canonical href="../1">'),
        page(2, '<!-- <link rel=canonical href="http://example.com/de/2"> -->'),
        page(3, """<script>var t = '<link rel="canonical" href="http://example.com/de/3">'</script>"""),
        page(4, '<!-- a --><link rel="alternate canonical" href="http://example.com/de/4"><!-- b'),
        page(5, '<base target=x><link rel=canonical href="//example.com/de/5">'),
        page(6, '<link rel="&#99;anonical" href="http://example.com/de/6">'),
    ]
    got = {r.page_id: r.verdict for r in filter_urls(spark.createDataFrame(rows * 2, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "block"}
    assert filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
