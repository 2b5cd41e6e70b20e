"""Features against plain loops: decayed history at any rate, scores mapped to a normal, baskets in a shuffled order."""

import math
import random
import statistics

import __spark_entry__ as entry
import duckdb
import pytest
from pyspark.sql import functions as F

from seqlab.operators import features as E
from seqlab.operators import inference as N


@pytest.mark.parametrize("rate", [0.0, 1e-4, 0.02, 1.0, 60.0])
def test_decayed_history(spark, rate):
    rng = random.Random(1)
    x = [rng.randrange(3) for _ in range(500)]
    got = {r.t: r.p_x for r in E.decayed_history(spark.createDataFrame(list(enumerate(x)), "t long, x int"), "x", 3, rate, chunk=64).collect()}
    for t in range(500):
        w = [sum(math.exp(-rate * (t - 1 - u)) for u in range(t) if x[u] == s) for s in range(3)]
        assert got[t] == pytest.approx([v / sum(w) for v in w] if t else [1 / 3] * 3, abs=1e-12)


def test_scores_mapped_to_a_normal(spark):
    rng = random.Random(2)
    fit = [float(rng.randrange(12)) for _ in range(300)] + [50.0, 60.5]
    new = [*fit[:40], -1.0, 70.0, 3.5, 55.0, None]
    frame = lambda v: spark.createDataFrame(list(enumerate(v)), "i int, x double")
    got = {r.i: r.x for r in E.to_normal(frame(new), frame(fit), ["x"], quantiles=20).collect()}
    s = sorted(fit)
    q = [s[int(p)] + (p - int(p)) * (s[min(int(p) + 1, len(s) - 1)] - s[int(p)]) for p in (k / 20 * (len(s) - 1) for k in range(21))]
    for i, v in enumerate(new):
        if v is None:
            assert got[i] is None
            continue
        same = [k for k in range(21) if abs(q[k] - v) < 1e-9]
        below = [k for k in range(21) if q[k] < v]
        p = (same[0] + same[-1]) / 40 if same else 0.0 if not below else 1.0 if len(below) == 21 else (below[-1] + (v - q[below[-1]]) / (q[below[-1] + 1] - q[below[-1]])) / 20
        assert got[i] == pytest.approx(statistics.NormalDist().inv_cdf(min(max(p, 1e-7), 1 - 1e-7)), abs=1e-6)


def test_baskets_stay_together(spark):
    items = spark.range(90).select((F.col("id") % 30).alias("t"), (F.col("id") % 30 * 3 + F.floor(F.col("id") / 30)).cast("int").alias("item"))
    rows = N.shuffled_steps(items, 40, 2).collect()
    for rep in (1, 2):
        mine = {}
        for r in rows:
            if r.rep == rep:
                mine.setdefault(r.t, set()).add(r.item)
        assert sorted(map(sorted, mine.values())) == [[3 * k, 3 * k + 1, 3 * k + 2] for k in range(30)]
        assert max(mine) < 40 and any(min(v) != 3 * t for t, v in mine.items())


def test_decayed_twins_hold_for_steps_far_from_the_last():
    base = duckdb.connect()
    base.execute("CREATE TABLE orders AS SELECT i AS o_orderkey, i AS o_custkey, 'F' AS o_orderstatus, CAST(hash(i) % 1000 AS DOUBLE) AS o_totalprice, TIMESTAMP '2000-01-01' AS o_orderdate, 'LOW' AS o_orderpriority FROM range(600000) r(i)")
    digits = [x[0] for x in base.execute("SELECT CAST(floor(o_totalprice) AS BIGINT) // 100 FROM orders ORDER BY o_orderkey").fetchall()]

    def shares(t):
        weights = [0.0] * 10
        for s in range(max(0, t - 8000), t):  # e^-40 before that
            weights[digits[s]] += math.exp(-0.005 * (t - s))
        return [x / sum(weights) for x in weights]

    got = base.execute(f"SELECT * FROM ({entry.oracle_sql()['w23_decayed_symbol_freq']}) WHERE t IN (100, 20001, 599999) ORDER BY t").fetchall()
    assert all(abs(a - b) < 2e-6 for row in got for a, b in zip(row[1:], shares(row[0]))) and len(got) == 3
    late = base.execute(f"SELECT t, symbol, p FROM ({entry.oracle_sql()['p3_recency_weighted_scores']}) WHERE t IN (420000, 599999) AND position = 'd1'").fetchall()
    want = {t: shares(t) for t in (420000, 599999)}
    assert len(late) == 20 and all(abs(p - want[t][k]) < 2e-6 for t, k, p in late)
