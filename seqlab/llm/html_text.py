"""HTML extraction: gradient-boosted trees over DOM nodes, and a hierarchical decoding.

A page is read into a tree of elements; each element is described by its kind, attribute tokens, depth, the density of
its subtree, its links and its siblings. Boosted trees (Spark ML), fitted on a bounded sample of pages whose semantic
elements show where the article is and on generated pages with plainly named parts, give every element log odds of
being main text. A second ensemble is fitted on the same pages with attributes and semantic elements taken away, and on
pages of few bare parts, so that density, links, depth and siblings decide where no name does. The decoding then finds the best consistent labelling of the tree: what is outside may hold the
article, the article may hold parts to leave out, and nothing under those comes back.

Markup is read as browsers do: a quote inside a bare attribute value belongs to it, a quoted value ends at the next
such quote, and a tag or comment that never ends takes the rest of the page. Reading, describing and writing out a page
take time in proportion to its length, whatever its nesting.

Edge cases: null or empty html, and pages without main text, give an empty text; broken or unclosed markup is read as
far as it goes; texts of any length are kept whole; repeated rows are extracted row by row; columns beside page_id,
url and html are ignored; without any page the trees are fitted on the generated pages alone.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

#: Fixed values of HTML: elements without content, with raw content, never part of a text, inside a line, those that close
#: an open p, those that a closing tag doesn't look behind, and those that an item doesn't.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe noembed noframes".split())
NEVER = RAW | frozenset("template select button datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote body details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html main menu nav ol p pre section table ul".split())
SCOPE = frozenset("article aside body div footer form header html li main nav ol section table td th ul blockquote button".split())
ITEMS = frozenset("li tr td th dt dd option".split())
HOLDERS = "ul ol table dl select div article body".split()
#: Kinds of elements and attribute tokens that the features count.
GROUPS = {
    "paragraph": "p blockquote pre".split(),
    "heading": "h1 h2 h3 h4 h5 h6".split(),
    "list": "ul ol li dl dt dd menu".split(),
    "link": ["a"],
    "article": "article main".split(),
    "around": "nav header footer aside".split(),
    "form": "form input button select textarea label fieldset".split(),
    "head": "head title meta link".split(),
    "table": "table tr td th tbody thead".split(),
    "frame": "html body div section".split(),
}
GOOD = frozenset("article articlebody body content entry main maincontent post story text".split())
BAD = frozenset(
    "ad ads advert advertisement aside author banner breadcrumb byline comment comments consent cookie cookies copyright disclaimer disqus footer form gdpr header links login masthead menu meta modal nav navbar navigation newsletter notice notification pagination popup promo promotion related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe tags teaser toolbar widget".split()
)
#: Elements whose names say what they hold; half of the training pages go without them and without attributes.
SEMANTIC = frozenset("article main nav header footer aside section".split())
TOKEN = re.compile(r"[a-z]+")
#: A comment, a declaration or a tag; each ends with the page at the latest.
PIECE = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|</(?![A-Za-z])[^>]*+>?"""
    r"""|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SAMPLE_PAGES, GENERATED_PAGES = 300, 240


@dataclass
class Node:
    tag: str
    up: Node | None
    attributes: str = ""
    parts: list = field(default_factory=list)  # strings and nodes in order
    index: int = 0


class _Open:
    """The open elements of a page, with the places of each kind among them, so that no look-up walks the tree."""

    def __init__(self, root: Node):
        self.stack, self.at, self.scopes = [root], {}, []

    def push(self, node: Node) -> None:
        place = len(self.stack)
        self.stack.append(node)
        self.at.setdefault(node.tag, []).append(place)
        if node.tag in SCOPE:
            self.scopes.append(place)

    def last(self, tag: str) -> int:
        """Where the innermost element of this kind is; 0 if there is none."""
        places = self.at.get(tag)
        return places[-1] if places else 0

    def close(self, place: int) -> None:
        """Ends the element at this place and all inside it; at 0, nothing."""
        while place and len(self.stack) > place:
            node = self.stack.pop()
            self.at[node.tag].pop()
            if node.tag in SCOPE:
                self.scopes.pop()


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("#page", None)
    opened, at = _Open(root), 0
    for m in iter(lambda: PIECE.search(page, at), None):
        here = opened.stack[-1]
        if m.start() > at:
            here.parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        inner = opened.scopes[-1] if opened.scopes else 0
        if m[1]:
            place = opened.last(tag)
            if tag in SCOPE or place > inner:
                opened.close(place)
            continue
        if tag in CLOSES_P:
            if opened.last("p") > inner:
                opened.close(opened.last("p"))
        elif tag in ITEMS and opened.last(tag) > max(map(opened.last, HOLDERS)):
            opened.close(opened.last(tag))
        here = opened.stack[-1]
        node = Node(tag, here, m[3])
        here.parts.append(node)
        closed = m[3].rstrip().endswith("/")
        if tag in RAW and not closed:
            end = re.compile(rf"</{tag}(?![^\s/>])[^>]*+>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not closed:
            opened.push(node)
    if at < len(page):
        opened.stack[-1].parts.append(page[at:])
    return root


PARAGRAPH = frozenset(GROUPS["paragraph"])
GROUP_OF = {tag: i for i, tags in enumerate(GROUPS.values()) for tag in tags}


def _tokens(node: Node) -> list[str]:
    return TOKEN.findall(" ".join(a or b or c for a, b, c in ATTRIBUTE.findall(node.attributes)).lower()) if node.attributes else []


def features(root: Node) -> tuple[list[Node], np.ndarray, np.ndarray]:
    """The elements in page order, their features, and how many characters of text each holds itself."""
    groups, nodes, matrix, sums = len(GROUPS), [], [], []
    todo = [(root, 0, 0, 0, (0.0,) * groups, 0.0, 1, 1)]
    while todo:
        node, depth, good, bad, above, place, siblings, alike = todo.pop()
        row = [0.0] * groups
        node.index = len(nodes)
        words = _tokens(node)
        here_good, here_bad = sum(w in GOOD for w in words), sum(w in BAD for w in words)
        kind, here = GROUP_OF.get(node.tag), above
        if kind is not None:
            row[kind] = 1.0
            here = (*above[:kind], 1.0, *above[kind + 1 :])
        children = [x for x in node.parts if x.__class__ is Node]
        tags: dict[str, int] = {}
        for x in children:
            tags[x.tag] = tags.get(x.tag, 0) + 1
        own = stops = 0
        for x in node.parts:
            if x.__class__ is str:
                text = x.strip()
                own += len(text)
                stops += text.count(".") + text.count(",")
        for i in range(len(children) - 1, -1, -1):
            x = children[i]
            todo.append((x, depth + 1, good + here_good, bad + here_bad, here, i / len(children), len(children), tags[x.tag]))
        nodes.append(node)
        sums.append([own, own if node.tag == "a" else 0, 1, stops, own if node.tag in PARAGRAPH else 0, own])
        matrix.append((row, above, depth, here_good, here_bad, min(good, 3), min(bad, 3), place, siblings, alike, len(children), len(words)))
    for i in range(len(nodes) - 1, 0, -1):  # text, link text, elements, full stops and text in paragraphs of each subtree
        x, up = sums[i], sums[nodes[i].up.index]
        if nodes[i].tag == "a":
            x[1] = x[0]
        if nodes[i].tag in PARAGRAPH:
            x[4] = x[0]
        for j in range(5):
            up[j] += x[j]
    whole, prose = max(sums[0][0], 1), max(sums[0][4], 1)
    out = np.array([
        (
            *row, *above, depth, own, text, elements, text / elements, links / text if text else 0.0, stops, stops / text if text else 0.0,
            good, bad, more_good, more_bad, place, siblings, alike, alike / siblings if siblings else 0.0,
            children, words, float(node.tag in RAW), float(node.tag in INLINE), own / text if text else 0.0,
            text / whole, paragraphs / prose, paragraphs / text if text else 0.0, text / max(up[0], 1), up[1] / max(up[0], 1), paragraphs / max(up[4], 1),
        )
        for node, (text, links, elements, stops, paragraphs, own), up, (row, above, depth, good, bad, more_good, more_bad, place, siblings, alike, children, words) in zip(nodes, sums, (sums[x.up.index] if x.up is not None else sums[0] for x in nodes), matrix)
    ])
    return nodes, out, np.array([x[5] for x in sums], float)


def decode(nodes: list[Node], odds: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The best labelling: True for elements whose own text belongs to the article."""
    # states: 0 outside the article, 1 in it, 2 left out of it; 0 may lead to 1, 1 to 2, and 2 only to itself
    gain = weight * odds
    score = np.zeros((len(nodes), 3))
    score[:, 1] = gain
    score[[i for i, x in enumerate(nodes) if x.tag in NEVER], 1] = -np.inf
    best = np.zeros((len(nodes), 3), np.int8)
    for i in range(len(nodes) - 1, -1, -1):
        best[i] = (1 if score[i, 1] > score[i, 0] else 0, 1 if score[i, 1] >= score[i, 2] else 2, 2)
        up = nodes[i].up
        if up is not None:
            score[up.index] += score[i][best[i]]
    state = np.zeros(len(nodes), np.int8)
    for i, node in enumerate(nodes):
        state[i] = best[i][state[node.up.index] if node.up is not None else 0]
    return state == 1


def text_of(root: Node, keep: np.ndarray) -> str:
    """The kept text: each block's white space as one space, blocks joined by one space."""
    out: list[str] = []
    todo: list = [(root, None)]  # parts still to write, the last first, with whether their element is kept
    while todo:
        x, kept = todo.pop()
        if x.__class__ is not Node:
            if kept:
                out.append(html.unescape(x) if "&" in x else x)
            continue
        if x.tag in RAW:
            continue
        block = x.tag not in INLINE
        if block or x.tag == "br":
            out.append(" ")
        if block:
            todo.append((" ", True))
        mine = keep[x.index]
        todo += [(y, mine) for y in reversed(x.parts)]
    return " ".join("".join(out).split())


def weak_labels(nodes: list[Node]) -> list[int]:
    """1 inside article or main, 0 outside or in a part whose element or tokens say that it is none of it; -1 if a page has neither."""
    if not any(x.tag in ("article", "main") for x in nodes):
        return [-1] * len(nodes)
    state: list[int] = []
    for x in nodes:
        inside = state[x.up.index] if x.up is not None else 0
        words = set(_tokens(x))
        if x.tag in ("nav", "header", "footer", "aside", "form", "head") or x.tag in NEVER or words & BAD and not words & GOOD:
            inside = 2
        elif x.tag in ("article", "main") and inside == 0:
            inside = 1
        state.append(inside)
    return [int(s == 1) for s in state]


def generated_pages(n: int, seed: int = 7, bare: bool = False) -> list[str]:
    """Pages made from a small grammar of plainly named parts, or of few bare ones: html, the kind of each part marked by data-part (1 or 0)."""
    rng = random.Random(seed)
    syllables = "ba co di fe gu ha ki lo mu na pe ri so ta vu".split()

    def words(k):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(k))

    def sentence():
        return words(rng.randint(4, 18)).capitalize() + rng.choice(".,.!") + " "

    def prose():
        text = sentence()
        if rng.random() < 0.15:  # a few words of it in an inline element
            before, _, after = text.partition(" ")
            tag = rng.choice(["b", "em", "i", "code", f'a href="/{words(1)}"'])
            text = f"{before} <{tag}>{words(rng.randint(1, 3))}</{tag.split()[0]}> {after}"
        return text

    def paragraphs(k):
        return "".join(f"<p>{''.join(prose() for _ in range(rng.randint(1, 8)))}</p>" for _ in range(k))

    def links(k):
        one = [f'<a href="/{words(1)}">{words(rng.randint(1, 3))}</a>' for _ in range(k)]
        if rng.random() < 0.35:
            return rng.choice([" ", " | ", ""]).join(one)
        return "<ul>" + "".join(f"<li>{x}</li>" for x in one) + "</ul>"

    def boiler():
        name = rng.choice(["sidebar", "menu", "cookie-notice", "ad", "advert banner", "related", "comments", "footer", "share", "newsletter", "login", "header", "promo", "widget"])
        tag = {"footer": "footer", "menu": "nav", "sidebar": "aside", "header": "header", "login": "form"}.get(name, "div")
        plain = tag != "div" and rng.random() < 0.4  # the element alone says what it is
        if not plain and rng.random() < 0.3:
            tag = "div" if tag != "div" else "section"
        attribute = "" if plain else f' {rng.choice(["class", "id"])}="{name}"'
        if name == "comments":
            inner = "".join(f'<div class="comment"><b>{words(1)}</b>{paragraphs(1)}</div>' for _ in range(rng.randint(1, 5)))
        elif rng.random() < 0.5:
            inner = links(rng.randint(1, 8))
        else:
            inner = f"<p>{sentence()}</p>" if rng.random() < 0.5 else sentence()
            if rng.random() < 0.3:
                inner += links(rng.randint(1, 3))
        if name == "login":
            inner += '<input name="q"><button>' + words(1) + "</button>"
        return f'<{tag} data-part="0"{attribute}>{inner}</{tag}>'

    def article():
        tag, name = rng.choice([("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main"'), ("div", ' class="article-body"'), ("section", ' class="story"')])
        body = f"<h1>{words(rng.randint(2, 8))}</h1>"
        for _ in range(rng.randint(1, 5)):
            body += paragraphs(rng.randint(1, 4))
            if rng.random() < 0.25:
                body += boiler()
            if rng.random() < 0.2:
                body += f"<h2>{words(3)}</h2>"
            if rng.random() < 0.15:
                body += "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(3)) + "</ul>"
        return f'<{tag} data-part="1"{name}>{body}</{tag}>'

    def plain():
        """A page of few bare parts: beside or below links in divs or table cells, or paragraphs and lines alone."""
        around, text = f'data-part="0">{links(rng.randint(1, 8))}', f'data-part="1">{paragraphs(rng.randint(1, 4))}'
        lines = "<br>".join(sentence() + sentence() for _ in range(rng.randint(1, 4)))
        return rng.choice([
            f"<div><div {around}</div><div {text}</div></div>", f"<table><tr><td {around}</td><td {text}</td></tr></table>", f"<div {around}</div><div data-part=\"1\">{lines}</div>",
            paragraphs(rng.randint(1, 4)).replace("<p>", '<p data-part="1">'),
        ])

    out = []
    for _ in range(n):
        if bare:
            out.append(rng.choice(["{}", "<body>{}</body>", "<html><body>{}</body></html>"]).format(plain()))
            continue
        parts = [boiler() for _ in range(rng.randint(1, 4))] + [article()] + [boiler() for _ in range(rng.randint(1, 4))]
        out.append(f"<html><head><title>{words(5)}</title><script>x()</script></head><body>{''.join(parts)}</body></html>")
    return out


def _generated_labels(nodes: list[Node]) -> list[int]:
    state: list[int] = []
    for x in nodes:
        mark = re.search(r'data-part="(\d)"', x.attributes)
        state.append(int(mark[1]) if mark else 0 if x.tag in NEVER else state[x.up.index] if x.up is not None else 0)
    return state


class Trees:
    """A fitted ensemble as arrays: feature, threshold, left, right and value of each node of each tree."""

    def __init__(self, model):
        self.weights, self.trees = list(model.treeWeights), []
        for tree in model.trees:
            rows: list[list] = []

            def walk(node):
                at = len(rows)
                rows.append([0, 0.0, at, at, node.prediction()])
                if node.subtreeDepth() > 0:
                    rows[at][0], rows[at][1] = node.split().featureIndex(), node.split().threshold()
                    rows[at][2] = walk(node.leftChild())
                    rows[at][3] = walk(node.rightChild())
                return at

            walk(tree._call_java("rootNode"))
            f, t, left, right, value = zip(*rows)
            self.trees.append((np.array(f), np.array(t), np.array(left), np.array(right), np.array(value), tree.depth))

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for w, (f, t, left, right, value, depth) in zip(self.weights, self.trees):
            at = np.zeros(len(x), int)
            for _ in range(depth):
                at = np.where(x[rows, f[at]] <= t[at], left[at], right[at])
            total += w * value[at]
        return 2 * total


def nameless(nodes: list[Node]) -> None:
    """Takes attributes and semantic elements from a page, so that only its structure is left."""
    for x in nodes:
        x.attributes = ""
        if x.tag in SEMANTIC:
            x.tag = "div"


def training_nodes(spark: SparkSession, pages: DataFrame, sample_pages: int = SAMPLE_PAGES, generated: int = GENERATED_PAGES) -> DataFrame:
    """features, label, named of the elements of about sample_pages different pages of the table, and of generated ones.

    Each page counts twice: as it is, and without names, with the labels of the named one.
    """
    draw = F.xxhash64("html").bitwiseAND(F.lit((1 << 48) - 1))
    different = pages.agg(F.approx_count_distinct(F.xxhash64("html"))).first()[0]
    drawn = pages.where(draw < int(min(1.0, sample_pages / max(1, different)) * (1 << 48))).select("html").distinct().select("html", F.lit(False).alias("made"), F.lit(False).alias("plain"))
    made = spark.createDataFrame([(p, True, False) for p in generated_pages(generated)] + [(p, True, True) for p in generated_pages(generated // 2, bare=True)], "html string, made boolean, plain boolean")

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels, named = [], [], []
            for page, own, plain in zip(*(batch.column(c).to_pylist() for c in ("html", "made", "plain"))):
                root = parse(page or "")
                nodes, matrix, _ = features(root)
                mine = _generated_labels(nodes) if own else weak_labels(nodes)
                keep = [i for i, l in enumerate(mine) if l >= 0]
                nameless(nodes)
                for described, kind in ((features(root)[1], False), *([] if plain else [(matrix, True)])):
                    rows += described[keep].tolist()
                    labels += [float(mine[i]) for i in keep]
                    named += [kind] * len(keep)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.float64()), pa.array(named, pa.bool_())], ["features", "label", "named"])

    return drawn.union(made).mapInArrow(describe, "features array<double>, label double, named boolean")


@dataclass
class Forest:
    """Trees for pages whose names tell where the article is, and trees that know the structure alone."""

    named: Trees
    bare: Trees

    def odds(self, pages: list[tuple[list[Node], np.ndarray]]) -> np.ndarray:
        """Log odds of all elements of pages: by names where an element or attribute names the article, else by both in equal parts."""
        x = np.concatenate([m for _, m in pages])
        by_name = self.named.odds(x)
        told = np.concatenate([np.full(len(nodes), any(n.tag in ("article", "main") or not GOOD.isdisjoint(_tokens(n)) for n in nodes)) for nodes, _ in pages])
        if not told.all():
            by_name[~told] = (by_name[~told] + self.bare.odds(x[~told])) / 2
        return by_name


def fit(spark: SparkSession, pages: DataFrame, **sizes) -> Forest:
    """Trees on the bounded sample, which all tasks of the scan write and a few read again for the fits."""
    nodes = materialize(training_nodes(spark, pages, **sizes), "nodes")

    def trees(named: bool, rounds: int, depth: int) -> Trees:
        rows = nodes.where(F.col("named") == named).select(array_to_vector("features").alias("features"), "label").coalesce(2)
        return Trees(GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, maxBins=32, seed=1).fit(rows))

    return Forest(trees(True, 10, 4), trees(False, 16, 5))


def extract(pages: DataFrame, trees: Forest | None = None) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars."""
    spark = pages.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(trees or fit(spark, pages))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            column = batch.column("html")
            for lo in range(0, len(column), 128):
                texts += extract_texts(column.slice(lo, 128).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = pages.schema
    return pages.select("page_id", "url", "html").mapInArrow(read, f"page_id {kinds['page_id'].dataType.simpleString()}, url {kinds['url'].dataType.simpleString()}, text string, n_chars long")


def extract_texts(pages: list[str | None], trees: Forest) -> list[str]:
    roots = [parse(p or "") for p in pages]
    described = [features(r) for r in roots]
    odds = trees.odds([x[:2] for x in described]) if described else np.empty(0)
    out, at = [], 0
    for root, (nodes, _, own) in zip(roots, described):
        mine = odds[at : at + len(nodes)]
        at += len(nodes)
        out.append(text_of(root, decode(nodes, mine, own + 0.01)))
    return out
