"""Each text operator against a brute-force version, with nulls, empty texts, repeats and clashing names."""

import base64
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from seqlab.llm import bpe, chat, html_text, language
from seqlab.llm.components import connected_components
from seqlab.llm.decontaminate import drop_leaks, find_leaks
from seqlab.llm.license_scan import scan_licenses
from seqlab.llm.neardup import keep_one, near_duplicates
from seqlab.llm.sharding import ShardStore
from seqlab.llm.topk import top_k
from seqlab.llm.url_filter import filter_urls

SCHEMA = "doc_id long, text string, lang string, source string, hash string"


def _docs(spark, texts, start=0):
    return spark.createDataFrame([(i, t, "en", "s", "x") for i, t in enumerate(texts, start)], SCHEMA)


def test_licenses(spark):
    texts = [None, "", "cc by", "x CC-BY y cc by", "General Public License; all rights reserved", "released under the MIT License", "cc bye", "é general public license é"]
    rows = {r.doc_id: r for r in scan_licenses(_docs(spark, texts)).collect()}
    assert [(rows[i].n_base, rows[i].first_word, rows[i].last_word, rows[i].base_labels) for i in range(8)] == [
        (0, None, None, ""), (0, None, None, ""), (1, 0, 0, "cc-by"), (2, 1, 4, "cc-by"), (2, 0, 3, "gpl,reserved"), (0, None, None, ""), (0, None, None, ""), (1, 1, 1, "gpl"),
    ]
    assert rows[5].labels == "mit" and rows[5].score == 1
    assert scan_licenses(_docs(spark, [])).count() == 0


def _components(texts, k):
    sets = [None] * len(texts)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((label[a], label[b]))
                label = [lo if x == hi else x for x in label]
    return [(len(sets[i]), label[i]) for i in range(len(texts))]


def test_near_duplicates(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = [None, "", "one two", "one two", " ".join(base)]
    for _ in range(60):  # copies with a few edits, as hubs and stragglers
        copy = list(base)
        for _ in range(rng.randrange(7)):
            copy[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60))) for _ in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(_docs(spark, texts), k=4).collect()}
    want = _components(texts, 4)
    assert [got[i] for i in range(len(texts))] == want
    kept = keep_one(_docs(spark, texts).union(_docs(spark, texts[4:5], 4)), k=4)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if want[i][1] == i]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(None, 3), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_html(spark):
    pages = html_text.generated_pages(30, seed=1)
    df = spark.createDataFrame([(i, "u", p, 1) for i, p in enumerate([*pages, None, "", "<article><p>a<b>b</b>&amp;c<br>d"])], "page_id long, url string, html string, text int")
    rows = {r.page_id: r for r in html_text.extract(df).collect()}
    right = 0
    for i, p in enumerate(pages):
        root = html_text.parse(p)
        nodes, _, _ = html_text.features(root)
        right += rows[i].text == html_text.text_of(root, np.array(html_text._generated_labels(nodes)) == 1)
    assert right >= 27 and rows[30].text == rows[31].text == "" and rows[31].n_chars == 0


def test_bpe(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(spark, path)
    assert ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = [None, "", "a" * 3000, "the" * 500, *("".join(rng.choice("abcdefgh éàß\n\t你好😀'st123_-") for _ in range(rng.randrange(60))) for _ in range(400))]
    for r in bpe.digest_round_trip(_docs(spark, texts), path, public_tokenizers.PATTERN).collect():
        ids = known.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.encode_checked(_docs(spark, texts), path, public_tokenizers.PATTERN).where("not intact").count() == 0


def test_sharding(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, base_bytes=1 << 10, fan_in=3)
    docs = _docs(spark, [None, "", *("x" * i for i in range(200))])
    store.append(docs, F.col("doc_id") % 4)
    store.append(docs.where("doc_id < 3"))
    with pytest.raises(RuntimeError):
        store.commit(*store._load(2), 2)
    last = store.compact()
    assert last > 2 and store.read(1).count() == 202
    assert store.read().select(docs.columns).exceptAll(docs.union(docs.where("doc_id < 3"))).count() == 0 and store.read().count() == 205


def test_chat(spark):
    rng = random.Random(4)
    rows = []
    for c in range(40):
        for t in range(rng.randrange(1, 6)):
            text = rng.choice(["hi", "<|im_end|>", "<\\|x", "", None, "long text"]) if t else "same start"
            rows.append((c, t, "assistant" if t % 2 else "user", text, 0))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, leaf int")
    groups = defaultdict(list)
    for c, t, r, x, _ in rows:
        groups[c].append((r, x or ""))
    for r in chat.digest_read_back(df).collect():
        said = "".join(f"{a}\n{b}\n" for a, b in groups[r.conv_id])
        learnt = "".join(b for a, b in groups[r.conv_id] if a == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(groups[r.conv_id]), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    stream = chat.pack(chat.conversations(df)).collect()
    assert sum(s.text.count("same start") for s in stream) == 1  # a shared turn is emitted once
    assert all(hi.offset >= lo.offset + lo.length for lo, hi in zip(*[sorted(stream, key=lambda s: (s.offset, s.length))[i:] for i in (0, 1)]))


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(150)] + [(150, None), (151, [1.0, float("nan")]), (152, [0.5] * 6), (153, [0.5] * 6), (154, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(df.where("vec_id % 50 = 0"), df, block=40, query_block=2).collect()}
    vectors = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if v is not None and np.isfinite(v).all()}
    want = {}
    for q in (0, 50, 100):
        scores = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)
        want |= {(q, r): (i, -s) for r, (s, i) in enumerate(scores[:10], 1)}
    assert got == want


def test_language(spark):
    rng = random.Random(3)
    parts = {"aa": "ka lo mi".split(), "bb": "ster ung ein".split()}
    rows = [(i, " ".join("".join(rng.choice(parts[l]) for _ in range(3)) for _ in range(20)), l) for i, l in enumerate(["aa", "bb"] * 60)]
    df = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 !", "aa"), (902, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df, language.train(df)).collect()}
    assert all(got[i].language == l for i, _, l in rows)
    assert all(got[i].language == "und" and got[i].rejected and got[i].confidence == 0 for i in (900, 901, 902))


def test_language_sample_of_copies(spark):
    texts = [(f"ka{i} lo mi", "aa") for i in range(1000)] + [("ka lo lo", "aa")] * 30_000 + [("ung ein", "bb")] * 3
    rows = language._sample(spark.createDataFrame(texts, "text string, lang string"), 400).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("text").alias("distinct")).collect()
    got = {r.lang: (r.n, r.distinct) for r in rows}
    assert got["bb"] == (1, 1) and got["aa"][0] == got["aa"][1] and 320 < got["aa"][0] < 480


def test_language_learns_every_label(spark):
    rng = random.Random(8)
    rows = [(100 * l + i, " ".join("".join(rng.choice([f"{chr(0x4E00 + 3 * l + k)}" for k in range(3)]) for _ in range(4)) for _ in range(8)), f"l{l:03d}") for l in range(210) for i in range(1 + l % 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    assert len(model.languages) == 210
    want = {i: l for i, _, l in rows}
    got = {r.doc_id: (r.language, r.confidence) for r in language.identify(df, model).collect()}
    assert {i: l for i, (l, _) in got.items()} == want
    model.held = False  # blocks loaded in turn give the same
    assert {r.doc_id: (r.language, r.confidence) for r in language.identify(df, model).collect()} == got


def test_language_blocks_do_not_change_results(spark, monkeypatch):
    rng = random.Random(9)
    parts = {"aa": "ka lo mi", "bb": "ster ung ein", "cc": "ka ung po", "dd": "mi ein lo"}
    rows = [(i, " ".join("".join(rng.choice(parts[l].split()) for _ in range(3)) for _ in range(20)), l) for i, l in enumerate(list(parts) * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = {r.doc_id: r for r in language.identify(df, language.train(df)).collect()}
    monkeypatch.setattr(language, "BLOCK", 1)
    apart = {r.doc_id: r for r in language.identify(df, language.train(df)).collect()}
    assert all((a.language, a.rejected) == (b.language, b.rejected) and abs(a.confidence - b.confidence) < 1e-9 for a, b in ((whole[i], apart[i]) for i in whole))


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.identify(df, language.train(df)).first().language == "und"


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short one")], "item_id long, text string")
    docs = _docs(spark, [None, "", "clean words only here", f"Before it {item.upper()}, and after", item.rsplit(" ", 1)[0], "alpha beta gamma delta epsilon rest is other", "a short one b"])
    found = {(r.doc_id, r.item_id, r.first_word) for r in find_leaks(docs, bench).collect()}
    assert found == {(3, 1, 2), (4, 1, 0), (6, 3, 1)}
    assert {r.doc_id for r in drop_leaks(docs, bench, block_items=1).collect()} == {0, 1, 2, 5}


def test_url_filter(spark):
    link = '<link href="http://b.example.com/de/1" rel="canonical">'
    rows = [(1, "http://x.NET/a", None), (2, "http://example.net/en/1", ""), (3, "http://a.org/zz", link), (4, "http://a.org/fr/1", link), (5, None, None), (6, "nothing", ""), (7, "http://x.net", ""), (8, "https://a.org/zz#f", "")]
    got = {r.page_id: (r.rule, r.verdict) for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("net/", "block"), 2: ("example.net/en/", "allow"), 3: (None, "block"), 4: ("org/fr/", "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "block")}
