"""Queries that once looked at a part of their rows, and queries whose steps were packed, against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seqlab import catalog_predictors, storage
from seqlab.operators import feature_sets, inference, predictors, profiles, relations, scores, spectrum

SMALL = "/root/testdata/sf0.001"


def test_neighbours_are_found_for_every_row_after_the_cut(spark):
    n = spark.read.parquet(f"{SMALL}/orders.parquet").count()
    found = entry.queries()["p6_knn_scores"](spark, SMALL).groupBy("t").count().collect()
    assert sorted(r.t for r in found) == list(range(int(0.7 * n), n))
    assert {r["count"] for r in found} == {10}


def _shuffle_files(spark) -> int:
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toList()
    return sum(held.apply(i).getName().startswith("shuffle_") and held.apply(i).getName().endswith(".data") for i in range(held.size()))


def test_written_tables_leave_no_shuffle_files(spark):
    for keep in (storage.pinned, storage.written):
        before = _shuffle_files(spark)
        kept = keep(spark.range(1000).repartition(5))
        ends = time.time() + 20
        while _shuffle_files(spark) > before and time.time() < ends:  # files are removed beside
            time.sleep(0.2)
        assert _shuffle_files(spark) <= before
        assert kept.count() == 1000


def test_periodograms_in_turns_are_those_of_one_turn(spark):
    hits = spark.createDataFrame([(i, t) for i in range(5) for t in range(0, 300, 3 + i)], "item int, t long")
    one, turns = (sorted(map(tuple, spectrum.periodogram(hits, 300, block=64, **more).collect())) for more in ({}, {"most": 1 << 11}))
    assert len(one) == 15 and one == turns


def test_shares_and_joints_of_runs_of_rows(spark):
    draws = random.Random(1)
    rows = [(t, draws.choice([0, 1, 2, 2, None]), draws.randrange(3)) for t in range(90)]
    df = spark.createDataFrame(rows, "t long, a int, b int")
    made = {r.t: r for r in scores.with_extremes(scores.with_rank(scores.smoothed_marginals(df, ["a", "b"], 3, 7, chunk=16), ["p_a", "p_b"], "b", squares=True), ["p_a", "p_b"]).collect()}
    assert sorted(made) == list(range(90))
    for t, *_ in rows:
        before = rows[max(0, t - 7) : t]
        a, b = ([(sum(r[i] == s for r in before) + 1) / (len(before) + 3) for s in range(3)] for i in (1, 2))
        p, mine, r = [x * y for x in a for y in b], rows[t][2], made[t]
        assert (r.p_a, r.p_b, r.own) == (a, b, p[mine])
        assert r.rank == 1 + sum(x > p[mine] or (x == p[mine] and i < mine) for i, x in enumerate(p))
        assert [r.squares, r.most, r.least, r.total] == pytest.approx([sum(x * x for x in p), max(p) / sum(p), min(p) / sum(p), 1.0])


def test_lags_are_permuted_in_packed_turns(spark):
    draws = random.Random(2)
    rows = [(t, draws.choice([None, *[draws.randrange(1000) for _ in range(9)]]), [draws.randrange(1000) for _ in range(5)] if t % 17 else None) for t in range(400)]
    df = spark.createDataFrame(rows, "t long, actual long, chosen array<int>").repartition(3)
    agree = lambda s, a: None if s is None or a is None else max(sum(f"{x:03d}"[k] == f"{a:03d}"[k] for k in range(3)) for x in s) >= 2

    def mean(values):
        known = [x for x in values if x is not None]
        return sum(known) / len(known)

    def nulls(pairs, head):
        out = []
        for rep in range(1, 7):
            order = sorted(range(len(pairs)), key=lambda i: (int(hashlib.md5(f"42:{rep}:{head}{i}".encode()).hexdigest()[:12], 16), i))
            out.append(mean([agree(p[0], pairs[j][1]) for p, j in zip(pairs, order)]))
        return out

    lags = [0, 3, 1]
    by_lag = {lag: [(rows[t][2], rows[t + lag][1]) for t in range(400 - lag)] for lag in lags}
    pooled = [x for lag in lags for x in by_lag[lag]]
    for more in ({"chunk": 16, "most": 2500}, {}):
        for r in inference.lag_cells(df, lags, 6, **more).collect():
            found, seen = nulls(by_lag[r.lag], f"{r.lag}:"), mean([agree(*x) for x in by_lag[r.lag]])
            assert (r.observed, r.p) == (seen, (1 + sum(x >= seen for x in found)) / 7) and r.null_mean == pytest.approx(sum(found) / 6)
        row, seen, found = inference.pooled_lag_test(df, lags, 6, **more).first(), mean([agree(*x) for x in pooled]), nulls(pooled, "")
        assert (row.n, row.observed, row.p) == (len(pooled), seen, (1 + sum(x >= seen for x in found)) / 7) and row.null_mean == pytest.approx(sum(found) / 6)


def test_transfer_entropy_is_counted_in_runs(spark):
    draws = random.Random(3)
    on = {(t, i) for t in range(70) if not 20 <= t < 45 for i in range(4) if draws.random() < 0.3}
    items, lags = spark.createDataFrame([(t, i) for t, i in sorted(on)], "t long, item int"), [1, 4, 9]
    made = [{(r.a, r.b, r.lag): r.te for r in relations.transfer_entropy(items, 70, lags, chunk=chunk).collect()} for chunk in (10, 16, 1 << 17)]
    for a, b, lag in made[0]:
        c = Counter(((t - lag, a) in on, (t, b) in on, (t + 1, b) in on) for t in range(lag, 69))
        part = lambda k, *keep: sum(v for x, v in c.items() if all(x[i] == k[i] for i in keep))
        want = sum(v / (69 - lag) * math.log2(v * part(k, 1) / (part(k, 0, 1) * part(k, 1, 2))) for k, v in c.items())
        assert [x[a, b, lag] for x in made] == pytest.approx([want] * 3, abs=1e-12)
    assert len(made[0]) == len(made[1]) == len(made[2]) == 4 * 3 * 3


def test_bootstrap_samples_are_cut_from_packed_counts(spark):
    draws = random.Random(4)
    df = spark.createDataFrame([(t, draws.gauss(t // 90, 1), draws.randrange(5)) for t in range(400)], "t long, a double, b int").repartition(3)
    plain = profiles.greedy_cuts(profiles.replicated(df, ["a", "b"], 5), ["a", "b"], 4, 10, chunk=64)
    for chunk in (64, 1 << 15):
        packed = profiles.bootstrap_cuts(df, ["a", "b"], 5, 4, 10, chunk=chunk)
        one, other = ({(r.rep, r.step): r for r in x.collect()} for x in (plain, packed))
        assert len(one) == 30 and one.keys() == other.keys()
        assert all(other[k].at == r.at and other[k].error == pytest.approx(r.error) for k, r in one.items())


def test_sets_of_strategies_are_those_of_the_single_predictors(spark):
    draws = random.Random(5)
    df = spark.createDataFrame([(t, t % 3, *(draws.choice([0, 1, 1, 4, 7, 9]) for _ in range(3))) for t in range(300)], "t long, c int, d1 int, d2 int, d3 int")
    digits = ["d1", "d2", "d3"]
    plain = {}
    for r in catalog_predictors._strategies(df, 210).where("strategy <> 'uniform'").collect():
        plain[r.strategy, r.t, r.position, r.symbol] = r.p
    for chunk in (32, 4096):
        made = predictors.score_sets(df, digits, 10, 210, ["c"], chunk=chunk).collect()
        assert len(made) == 4 * 90 and all(r.c == r.t % 3 for r in made)
        found = {(r.strategy, r.t, c, k): p for r in made for c in digits for k, p in enumerate(r[f"p_{c}"])}
        assert found.keys() == plain.keys() and all(abs(found[k] - p) < 1e-8 for k, p in plain.items())


def test_features_of_runs_are_those_of_rows(spark, monkeypatch):
    from datetime import date, timedelta

    draws = random.Random(6)
    rows = [(t, date(2020, 1, 1) + timedelta(t // 9), t % 4, "m", draws.choice(["a", None]), "x", t % 3, draws.randrange(1000) // 7 * 7) for t in range(260)]
    df = spark.createDataFrame(rows, "t long, day date, slot int, machine string, ball1 string, ball2 string, ball3 int, c int")
    df = df.withColumns({"d1": (F.col("c") / 100).cast("int"), "d2": (F.col("c") / 10 % 10).cast("int"), "d3": F.col("c") % 10}).repartition(3)
    spec = feature_sets.Spec(cap=40, window=20, windows=[5, 30])
    packed = feature_sets.build_features(df, spec=spec).orderBy("t").collect()
    calls = []
    monkeypatch.setattr(feature_sets, "_in_runs", lambda *x: calls.append(x))
    monkeypatch.setattr(feature_sets, "RUNS", {})
    plain = feature_sets.build_features(df, spec=spec, chunk=64).orderBy("t").collect()
    assert not calls and len(packed) == 260 and packed[0].__fields__ == plain[0].__fields__
    for a, b in zip(packed, plain):
        assert [float(x) for x in a] == pytest.approx([float(x) for x in b], abs=1e-9)
