"""Closed forms and brute-force versions of tests, dependence, patterns and fitted features."""

import datetime
import math
import random
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from seqlab import catalog_relations
from seqlab.functions import tails
from seqlab.operators import features as E
from seqlab.operators import patterns as P
from seqlab.operators import relations as G
from seqlab.operators import series as S

STEPS = 40
HITS = [(t, i) for t in range(STEPS) for i in (1, 2, 3) if (t * t * i + 3 * t + i) % 7 < 3]


@pytest.fixture(scope="module")
def hits(spark):
    return spark.createDataFrame(HITS, "t long, item int")


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tails_have_their_table_values(spark):
    for x, df, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (16.918978, 9, 0.05)):
        assert abs(_one(spark, tails.chi_square(F.lit(x), df)) - p) < 1e-6
    assert abs(_one(spark, tails.t_two_sided(F.lit(2.228139), F.lit(10))) - 0.05) < 1e-6
    assert abs(_one(spark, tails.f_tail(F.lit(3.708265), F.lit(3.0), F.lit(10.0))) - 0.05) < 1e-6
    assert _one(spark, tails.f_tail(F.lit(1.0), F.lit(0.0), F.lit(5.0))) is None


def test_fisher_sums_the_exact_terms(spark):
    for a, b, c, d in ((3, 1, 1, 3), (0, 4, 2, 9), (10, 0, 0, 10), (5, 7, 9, 20)):
        n, rows, cols = a + b + c + d, a + b, a + c
        want = sum(math.comb(cols, k) * math.comb(n - cols, rows - k) for k in range(a, min(rows, cols) + 1)) / math.comb(n, rows)
        got = _one(spark, tails.fisher_greater(*(F.lit(x).cast("long") for x in (a, b, c, d))))
        assert abs(got - want) < 1e-8


def test_prefix_sums_do_not_depend_on_ranges(spark):
    rows = spark.range(200).select((F.col("id") * 37 % 200).alias("k"))
    got = {r.k: r.s for r in S.prefix_sum(rows, ["k"], "k", "s", partitions=7).collect()}
    assert got == {k: k * (k - 1) // 2 for k in range(200)}


def test_transfer_entropy_against_all_cells(spark, hits):
    on, n = set(HITS), {}
    for a, b, lag in product((1, 2, 3), (1, 2, 3), (1, 2)):
        if a != b:
            c = Counter(((t - lag, a) in on, (t, b) in on, (t + 1, b) in on) for t in range(lag, STEPS - 1))
            m = sum(c.values())
            part = lambda *keep: Counter({k: sum(v for x, v in c.items() if tuple(x[i] for i in keep) == k) for k in {tuple(x[i] for i in keep) for x in c}})
            xy, yz, y = part(0, 1), part(1, 2), part(1)
            n[a, b, lag] = sum(v / m * math.log2(v * y[k[1:2]] / (xy[k[:2]] * yz[k[1:]])) for k, v in c.items())
    got = {(r.a, r.b, r.lag): r.te for r in G.transfer_entropy(hits, STEPS, [1, 2]).collect()}
    assert got.keys() == n.keys() and all(abs(got[k] - n[k]) < 1e-9 for k in n)


def test_granger_finds_the_leader(spark):
    rows = spark.range(300).select(F.col("id").alias("t"), (F.hash("id") % 100).cast("double").alias("x"))
    led = rows.join(rows.select((F.col("t") + 1).alias("t"), (F.col("x") * 2).alias("was")), "t").select("t", "x", (F.col("was") + F.hash("t", F.lit(7)) % 20).alias("y"))
    assert all(r.p < 1e-6 for r in G.granger(led, "x", "y", 2).collect())
    assert all(r.p > 1e-3 for r in G.granger(led, "y", "x", 2).collect())


def test_ols_recovers_a_line_and_errors_stay_small(spark):
    rows = spark.range(200).select(F.col("id").alias("t"), (F.col("id") % 17).cast("double").alias("x")).withColumn("y", 3 + 2 * F.col("x") + (F.hash("t") % 100) / 1000)
    got = {r.x: r for r in G.hac_errors(rows, "y", ["x"], 5).collect()}
    assert abs(got["const"].beta - 3) < 0.05 and abs(got["x"].beta - 2) < 0.01 and got["x"].p < 1e-6


def test_spearman_is_one_for_a_rising_curve(spark):
    rows = spark.range(50).select(F.col("id").alias("a"), (F.col("id") * F.col("id")).alias("b"))
    assert abs(G.spearman(rows, "a", "b").first().r - 1) < 1e-12


def test_quantile_bins_leave_nulls_alone(spark):
    rows = spark.createDataFrame([(float(x),) for x in range(10)] + [(None,)], "v double")
    assert Counter(r.bin for r in G.quantile_bins(rows, "v", 2).collect()) == {0: 5, 1: 5, None: 1}


def test_splits_fall_on_the_steps(spark):
    rows = spark.range(120).select(F.col("id").alias("t"), F.when(F.col("id") < 40, 0.0).when(F.col("id") < 90, 5.0).otherwise(1.0).alias("v"))
    assert sorted(r.at for r in P.binary_segmentation(rows, "v", 2, 5).collect()) == [40, 90]


def test_concordance_against_all_pairs(spark):
    rows = [(i % 5 + 1, int(i % 3 > 0), i * 7 % 4) for i in range(30)]
    pairs = [(a[2] > b[2]) + 0.5 * (a[2] == b[2]) for a in rows for b in rows if a[1] and b[0] > a[0]]
    got = P.concordance(spark.createDataFrame(rows, "d int, e int, r int"), "d", "e", "r").first()
    assert got.pairs == len(pairs) and abs(got.c_index - sum(pairs) / len(pairs)) < 1e-12


def test_decayed_shares_do_not_depend_on_chunks(spark):
    rows = spark.range(200).select(F.col("id").alias("t"), (F.col("id") * 7 % 4).cast("int").alias("v"))
    small, whole = ({r.t: r.p_v for r in E.decayed_frequency(rows, "v", 4, 0.05, 30, chunk=n).collect()} for n in (32, 4096))
    assert all(abs(a - b) < 1e-9 for t in whole for a, b in zip(small[t], whole[t])) and whole[0] == [0.25] * 4


def test_scaling_by_nothing_but_one_value_is_centred(spark):
    rows = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert [[r.v for r in E.scale(rows, rows, ["v"], m).collect()] for m in ("standard", "robust", "minmax")] == [[0.0, 0.0]] * 3


def test_fisher_of_large_tables_neither_overflows_nor_goes_through_all_terms(spark):
    a, b, c, d = 500_000, 7_600_000, 7_600_000, 38_300_000  # far fewer than by chance: the first term is 0, the sum of ratios infinite
    assert _one(spark, tails.fisher_greater(*(F.lit(x).cast("long") for x in (a, b, c, d)))) == 1.0
    assert abs(_one(spark, tails.fisher_greater(*(F.lit(x).cast("long") for x in (1_215_000, 6_885_000, 6_885_000, 39_015_000)))) - 0.5) < 1e-3


def test_lookup_takes_the_least_outcome_before_it_joins(spark, tmp_path):
    """Rows of a day and slot meet one outcome of the next day, not all of its rows."""
    rng = random.Random(8)
    rows = [(k, datetime.date(2020, 1, 1 + rng.choice([0, 1, 1, 3])), float(rng.randrange(3000)), "O", 1, "x") for k in range(200)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate date, o_totalprice double, o_orderstatus string, o_custkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    got = catalog_relations.QUERIES["r8_lookup_result"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    for r in got.collect():
        key, day = ordered[r.t][:2]
        assert r.outcome == min((int(x[2]) % 1000 for x in rows if x[0] % 4 == key % 4 and (x[1] - day).days == 1), default=None)
