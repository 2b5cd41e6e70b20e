"""Near-duplicates against brute force over rows: shared and null ids, repeated rows, hot groups, clashing columns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from seqlab.llm import common, neardup
from seqlab.llm.neardup import keep_one, near_duplicates


def brute(rows, k):
    """Per row (id, text): shingles and number of the component."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = [lo if x == hi else x for x in label]
    return sets, label


def want(rows, k):
    sets, label = brute(rows, k)
    least = {}
    for (i, _), l in zip(rows, label):
        if i is not None:
            least[l] = min(i, least.get(l, i))
    return sorted(((i, len(s), least.get(l) if s else i) for (i, _), s, l in zip(rows, sets, label)), key=repr)


@pytest.fixture
def rows():
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    out = [(None, None), (1, ""), (1, ""), (2, " \t\n"), (3, "one"), (3, "one"), (None, "one"), (4, "One")]
    base = words(40)
    for i in range(12):  # one id for near copies and for other texts of the same length
        copy = list(base)
        copy[rng.randrange(40)] = f"e{i}"
        out += [(5, " ".join(copy)), (5, " ".join(words(40))), (None, " ".join(copy[:-1]))]
    lone = words(30)
    out += [(None, " ".join(lone)), (None, " ".join(lone[:-1])), (None, " ".join(lone)), (7, "é " + " ".join(words(5000)))]
    steps = words(60)  # a chain in which only neighbours are linked
    for i in range(8):
        steps[7 * i] = f"s{i}"
        out.append((100 - i, " ".join(steps)))
    return out


def _table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, component int, cid string, _salt string")


@pytest.mark.parametrize("split", [False, True])
def test_rows_with_shared_and_null_ids(spark, rows, split, monkeypatch):
    if split:  # every key with over two rows is split
        real = common.hot_keys
        monkeypatch.setattr(neardup, "hot_keys", lambda counts, keys, total: real(counts, keys, total, most=1 << 30, least=2))
    df = _table(spark, rows)
    got = near_duplicates(df, k=4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    sets, label = brute(rows, 4)
    kept = keep_one(df, k=4)
    assert kept.columns == df.columns
    texts = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert len([t for _, t in texts if t and t.strip()]) == len({l for s, l in zip(sets, label) if s})
    assert [x for x in texts if not (x[1] or "").strip()] == sorted((r for r, s in zip(rows, sets) if not s), key=repr)
    place = {}
    for r, l in zip(rows, label):
        place.setdefault(r, set()).add(l)
    found = [min(place[x]) for x in texts if (x[1] or "").strip()]
    assert len(found) == len(set(found))


def test_many_look_alikes(spark, monkeypatch):
    """Groups in which some are linked to the original, some to each other only, and many to nothing, over split buckets."""
    real = common.hot_keys
    monkeypatch.setattr(neardup, "hot_keys", lambda counts, keys, total: real(counts, keys, total, most=1 << 30, least=5))
    rng = random.Random(3)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(120):
        copy = list(base)
        for j in rng.sample(range(100), rng.randrange(1, 7)):
            copy[j] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(copy)))
    got = near_duplicates(_table(spark, rows), k=4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want(rows, 4)


def test_no_rows(spark):
    df = _table(spark, []).withColumn("doc_id", F.col("doc_id").cast("long"))
    assert near_duplicates(df).collect() == [] and keep_one(df).collect() == []


def test_recall_of_bands(spark):
    """The share of links at a similarity just over 0.8 that some band catches: 3e-6 are to be missed."""
    import numpy as np

    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(2000):
        n, both = 90, 80  # 80 of 100
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[:both], rng.integers(0, 2**63, n - both, dtype=np.uint64)])
        x, y = (neardup.signature(s, 96).reshape(24, 4) for s in (a, b))
        missed += not (x == y).all(1).any()
    assert missed <= 1
