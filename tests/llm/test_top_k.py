"""Exact top-k against all inner products: components of any size, ties, repeated rows, empty tables."""

import math
import random

from seqlab.llm.topk import sort_key, top_k


def _want(rows, queries, k):
    known = [(i, [math.floor(1024 * x) if abs(x) < 2**52 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in known:
        if q in queries:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in known if i != q)
            out += [(q, r, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_components_of_any_size(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(-3, 40 if i % 3 else 3) for _ in range(4)]) for i in range(60)]
    rows += [(60, [70000.0, -70000.0, 0.0, 1.0]), (61, [1e300, -1e300, 1.0, 0.5]), (62, [2.0**63, 1.0]), (63, [1.0, float("inf")]), (64, [1.0, None]), (65, None), (66, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k(df.where("vec_id % 5 = 0"), df, block=20, query_block=4).collect()))
    assert got == _want(rows, {i for i, _ in rows if i % 5 == 0}, 10)


def test_ties_repeats_and_other_columns(spark):
    rows = [(i % 7, [1.0, 2.0]) for i in range(21)] + [(9, [1.0, 2.0]), (10, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, score long, cb string")
    got = sorted(map(tuple, top_k(df.where("vec_id = 9"), df, k=5, block=4).collect()))
    score = 1024 * 1024 * 5
    assert got == [(9, 1, 0, score), (9, 2, 0, score), (9, 3, 0, score), (9, 4, 1, score), (9, 5, 1, score)]
    assert top_k(df, df.limit(0)).collect() == [] and top_k(df.limit(0), df).collect() == []


def test_sort_key():
    values = [0, 1, -1, 255, 256, -255, -256, 2**63, -(2**63), 2**200, -(2**200), 2**200 + 1]
    assert sorted(values) == sorted(values, key=sort_key)
