"""Closed forms and brute-force versions of the probability-set and ledger operators."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlab.operators import ledger as K
from seqlab.operators import predictors
from seqlab.operators import scores as L

P = [[0.1, 0.4, 0.4, 0.0, 0.02, 0.02, 0.02, 0.02, 0.01, 0.01], [0.3, 0.1, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05], [0.1] * 10]


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([(*P, 123)], "a array<double>, b array<double>, c array<double>, actual int")


def test_top_combinations_and_ranks_agree_with_all_products(row):
    every = sorted(range(1000), key=lambda x: (-(P[0][x // 100] * P[1][x // 10 % 10] * P[2][x % 10]), x))
    got = L.top_combinations(row, ["a", "b", "c"], 20).withColumn("rank", L.rank_of(L.joint(["a", "b", "c"]), F.col("actual"))).first()
    assert got.chosen == every[:20] and got.rank == every.index(123) + 1


def test_box_scores_sum_to_one(row):
    boxes = row.select(L.box_scores(L.joint(["a", "b", "c"])).alias("x")).first().x
    assert len(boxes) == 220 and abs(sum(b.p for b in boxes) - 1) < 1e-9


def test_shares_of_nothing_are_uniform(spark):
    assert spark.range(1).select(L.normalised(F.array(F.lit(0.0), F.lit(0.0))).alias("p")).first().p == [0.5, 0.5]


def test_match_levels(spark):
    rows = spark.createDataFrame([(list(x), y) for x, y in product([[123, 400], [999], []], [123, 451])], "chosen array<int>, actual int")
    assert [r[0] for r in rows.select(L.match_levels(F.col("chosen"), F.col("actual"))).collect()] == [3, 1, 0, 0, None, None]


def test_append_is_idempotent_and_patches_keep_the_rest(spark):
    old = spark.createDataFrame([(1, "a")], "id int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "d"), (2, "c")], "id int, v string")
    once = K.append_new(old, new, "id", "v")
    assert sorted(K.append_new(once, new, "id", "v").collect()) == [(1, "a"), (2, "c")]
    assert sorted(K.patch(once, spark.createDataFrame([(2, "z")], "id int, v string"), "id").collect()) == [(1, "a"), (2, "z")]


def test_sets_that_pack_well_are_not_broadcast_over_lags(spark):
    sets = spark.range(20000).select(F.col("id").alias("t"), F.array(*map(F.lit, range(20))).alias("chosen"), (F.col("id") % 10).alias("actual")).repartition(4).localCheckpoint()
    for made in (L.lag_table(sets, sets, [0, 1]), K.near_hits(sets, sets, range(2))):
        assert made.collect() and "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()
    assert [(r.lag, r.n, r.exact) for r in L.lag_table(sets, sets, [0, 1]).orderBy("lag").collect()] == [(0, 20000, 1.0), (1, 19999, 1.0)]


def test_batches_of_ranks_and_choices_agree_with_rows(spark):
    rows = spark.createDataFrame([(*P, 123), (*P, None), (P[0], None, P[2], 5), (P[2], P[2], P[2], 999)], "a array<double>, b array<double>, c array<double>, actual int").coalesce(1)
    got = L.with_rank(L.top_combinations(rows, ["a", "b", "c"], 20), ["a", "b", "c"], "actual").collect()
    want = rows.select(L.rank_of(L.joint(["a", "b", "c"]), F.col("actual")).alias("rank")).collect()
    assert [r.rank for r in got] == [want[0].rank, None, None, 1000] and got[0].own == P[0][1] * P[1][2] * P[2][3]
    assert got[2].chosen is None and got[3].chosen == list(range(20)) and got[0].chosen == got[1].chosen


def test_nearest_holds_distinct_points_against_each_other(spark):
    """Rows and queries that share a point are asked once, and all queries get what a search of all rows gives."""
    rng = np.random.default_rng(4)
    a, b, y = rng.integers(0, 3, 400), rng.integers(0, 2, 400), rng.integers(0, 4, 400)
    df = spark.createDataFrame([(i, int(p), int(q), int(s)) for i, (p, q, s) in enumerate(zip(a, b, y))], "t long, a int, b int, y int")
    got = predictors.nearest(df.where("t < 250"), df.where("t >= 250"), ["a", "b"], "y", 4, k=7, block=10)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    have = {(r.t, r.symbol): r.p for r in got.collect()}
    assert len(have) == 150 * 4
    x = np.column_stack([(v - v[:250].mean()) / v[:250].std() for v in (a, b)])
    for t in range(250, 400):
        d = np.round(np.sqrt(((x[:250] - x[t]) ** 2).sum(1)), 9)
        best = np.lexsort((np.arange(250), d))[:7]
        w = 1 / (d[best] + 1e-6)
        for s in range(4):
            assert abs(have[t, s] - w[y[best] == s].sum() / w.sum()) < 1e-6


def test_box_ranks_of_batches(spark):
    """Ranks made for many rows at a time are those of box_scores(), ties among boxes included."""
    rng = np.random.default_rng(9)
    digits, shares = rng.integers(0, 10, (300, 3)), rng.integers(1, 4, (300, 3, 10)) / 20
    rows = [(i, *map(int, d), *(x.tolist() for x in p)) for i, (d, p) in enumerate(zip(digits, shares))] + [(300, None, 1, 2, *P)]
    df = spark.createDataFrame(rows, "t long, d1 int, d2 int, d3 int, a array<double>, b array<double>, c array<double>")
    boxes = df.where("t < 300").select("t", L.box_of(["d1", "d2", "d3"]).alias("box"), L.box_scores(L.joint(["a", "b", "c"])).alias("x"))
    want = {}
    for r in boxes.collect():
        own = next(x.p for x in r.x if x.box == r.box)
        want[r.t] = (r.box, 1 + sum(x.p > own or (x.p == own and x.box < r.box) for x in r.x))
    assert {r.t: (r.box, r.rank) for r in L.with_box_rank(df, ["a", "b", "c"], ["d1", "d2", "d3"]).collect()} == want | {300: (None, None)}
