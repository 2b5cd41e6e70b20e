"""Decontamination against brute force over all windows of all items."""

import random
import re
from collections import Counter

import pytest

from seqlab.llm.decontaminate import drop_leaks, find_leaks


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())


def brute(docs, items, least=0.8):
    """{(doc, item)} with a window as similar as least, and the best similarity."""
    found = {}
    for i, item in items:
        a = _words(item)
        k = min(5, len(a))
        if not a:
            continue
        bag = Counter(tuple(a[j : j + k]) for j in range(len(a) - k + 1))
        for d, text in docs:
            w = _words(text)
            g = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            n = min(sum(bag.values()), len(g))
            for s in range(len(g) - n + 1 if n else 0):
                other = Counter(g[s : s + n])
                both = sum((bag & other).values())
                value = both / (sum(bag.values()) + n - both)
                if value >= least:
                    found[d, i] = max(value, found.get((d, i), 0))
    return found


def _case():
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 7, 20, 20, 45, 90])))) for i in range(60)]
    items += [(60, items[2][1]), (61, None), (62, ""), (63, "x " * 30), (64, "a b c d e f g h i j k")]
    docs = [(0, None), (1, ""), (2, "x " * 200), (3, "nothing of it")]
    for d in range(4, 300):
        words = _words(rng.choice(items)[1]) or ["z"]
        for _ in range(rng.randrange(0, 1 + max(1, len(words) // 20))):  # around the threshold
            at = rng.randrange(len(words))
            words = rng.choice([words[:at] + words[at + 1 :], words[:at] + ["q"] + words[at:], words[:at] + ["q"] + words[at + 1 :]]) or ["z"]
        before, after = ([rng.choice(vocabulary) for _ in range(rng.randrange(30))] for _ in range(2))
        docs.append((d, " ".join(before + words + after)))
    return docs, items


@pytest.mark.parametrize("radius", [0, 7, 24])
def test_all_windows(spark, radius):
    docs, items = _case()
    want = brute(docs, items)
    assert len(want) > 100 and any(v < 0.83 for v in want.values())
    df = spark.createDataFrame([(d, t, 1, "i") for d, t in docs], "doc_id long, text string, first_word int, item_id string")
    got = {}
    for r in find_leaks(df, spark.createDataFrame(items, "item_id long, text string"), radius=radius, block_items=40).collect():
        got[r.doc_id, r.item_id] = max(r.similarity, got.get((r.doc_id, r.item_id), 0))
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    clean = drop_leaks(df, spark.createDataFrame(items, "item_id long, text string"), radius=radius)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want} and clean.columns == df.columns


def test_edges(spark):
    bench = spark.createDataFrame([(None, "one two three four five six seven"), (1, "one two three four five six seven")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "one two three four five six seven")] * 2 + [(1, None), (2, "w " * 100_000 + "one two three four five six seven")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.first_word) for r in find_leaks(docs, bench).collect()), key=repr)
    assert got == sorted([(None, i, 0) for i in (None, 1)] * 2 + [(2, i, 100_000) for i in (None, 1)], key=repr)
    assert find_leaks(docs, bench.limit(0)).collect() == [] and drop_leaks(docs, bench.limit(0)).count() == 4 and find_leaks(docs.limit(0), bench).collect() == []
