"""Models that have no SQL twin, against single fits and closed forms."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from seqlab.operators import boosting as B
from seqlab.operators import learned as M


def test_discrete_hawkes_equals_single_fits(spark):
    """Item 1 excites 2 a step later, 4 shuns 3, 6 comes always and 7 twice only."""
    rng, came = random.Random(1), []
    for t in range(900):
        last = came[-1] if came else set()
        now = {k for k, p in ((1, 0.3), (2, 0.7 if 1 in last else 0.15), (3, 0.05 if 4 in last else 0.4), (4, 0.3), (5, 0.02), (6, 1.0)) if rng.random() < p}
        came.append(now | ({7} if t in (50, 60) else set()))
    items = spark.createDataFrame([(t, i) for t, xs in enumerate(came) for i in sorted(xs)], "t long, item int")
    got = {r.b: r for r in M.discrete_hawkes(items, 900, 7, strength=0.1).collect()}
    x = np.array([[sum(np.exp(-k) for k in range(1, 11) if j in came[t - k]) for j in range(1, 8)] for t in range(10, 900)])
    for b in (1, 2, 3, 5):
        rows = spark.createDataFrame([(v.tolist(), float(b in came[t + 10])) for t, v in enumerate(x)], "a array<double>, y double").select(array_to_vector("a").alias("x"), "y")
        one = LogisticRegression(featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=1 / (0.1 * len(x)), standardization=False, maxIter=500, tol=1e-12).fit(rows)
        assert got[b].alpha == pytest.approx(one.coefficients.toArray().tolist(), abs=1e-3)
        assert got[b].baseline == pytest.approx(one.intercept, abs=1e-3)
    assert got[2].alpha[0] > 0.5 and got[3].alpha[3] < -0.5
    for b, share in ((6, 1.0), (7, 2 / 890)):
        assert not any(got[b].alpha) and got[b].baseline == pytest.approx(np.log(share / (1 - share + 1e-10)))


def test_hawkes_passes_read_packed_runs(spark, monkeypatch):
    """One row for a run of steps, whatever its length; also where runs or steps are empty."""
    rng, held = np.random.default_rng(28), []
    hits = [(t, i) for t in range(300) if not 100 <= t < 170 for i in (1, 2, 3) if rng.random() < 0.4]
    items = spark.createDataFrame(hits, "t long, item int")
    monkeypatch.setattr(M, "pinned", lambda made: held.append(made.localCheckpoint()) or held[-1])
    short, whole = ([(r.baseline, *r.alpha) for r in M.discrete_hawkes(items, 300, 3, strength=10.0, chunk=k).orderBy("b").collect()] for k in (32, 512))
    assert [h.count() for h in held] == [10, 1]
    assert np.allclose(short, whole, atol=1e-6) and np.abs(np.array(whole)[:, 1:]).max() > 0


def test_auc_of_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(g, f, float(round(rng.normal() + 0.5 * y, 1)), int(y)) for g in range(3) for f in range(2) for y in (rng.random(60) < (0.4 if g else 0.05)).astype(int)]
    got = {(r.g, r.f): r for r in M.auc(spark.createDataFrame(rows, "g int, f int, s double, y int"), ["g", "f"], "s", "y").collect()}
    for key, r in got.items():
        p, q = ([s for a, b, s, y in rows if (a, b) == key and y == v] for v in (1, 0))
        pairs = [(a > b) + 0.5 * (a == b) for a in p for b in q]
        assert (r.positives, r.negatives) == (len(p), len(q))
        assert r.auc == pytest.approx(sum(pairs) / len(pairs) if len(p) >= 10 else 0.5)
    assert any(r.positives < 10 for r in got.values()) and len(got) == 6


def test_calibration_of_all_classes(spark):
    rng = np.random.default_rng(7)
    p = rng.dirichlet([1, 1, 1], 600)
    y = [rng.choice(3, p=q**3 / (q**3).sum()) for q in p]
    df = spark.createDataFrame([(q.tolist(), int(v)) for q, v in zip(p, y)], "p array<double>, y int")
    done = M.calibrate_all(df, df, "p", "y", 3).collect()
    loss = lambda name: -np.mean([np.log(max(r[name][r.y], 1e-6)) for r in done])
    assert all(abs(sum(r.calibrated) - 1) < 1e-9 for r in done) and loss("calibrated") < loss("p") - 0.02


def test_components_of_noise_and_of_one_factor(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6))
    x[:, :3] += 2 * rng.normal(size=(400, 1))
    df = M.vectors(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "t long, " + ", ".join(f"c{k} double" for k in range(6))), [f"c{k}" for k in range(6)], "t", ["t"])
    rows = M.components(df, 3, 6).orderBy("component").collect()
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1][:3]
    assert np.allclose([r.eigenvalue for r in rows], values) and [r.above for r in rows] == [True, False, False]
    assert rows[0].edge == pytest.approx((1 + np.sqrt(6 / 400)) ** 2)


def _labelled(spark, symbols, n=900):
    """t, y, x: of the features one is constant, one has two values, one 30 and one 80 (more than there are bins)."""
    rng = np.random.default_rng(33)
    x = np.stack([np.full(n, 2.0), rng.integers(0, 2, n), rng.integers(0, 30, n) / 10, rng.integers(0, 80, n) / 10], axis=1)
    y = (x[:, 3] / 8 * symbols).astype(int)
    y = np.where(rng.random(n) < 0.2, (y + x[:, 1].astype(int)) % symbols, y)
    y = np.where(x[:, 2] > 2.4, symbols - 1, y)
    made = spark.createDataFrame([(i, float(k), v.tolist()) for i, (k, v) in enumerate(zip(y, x))], "t long, y double, a array<double>")
    return made.select("t", "y", array_to_vector("a").alias("x"))


def test_boosted_trees_equal_spark_ml(spark):
    """Against a GBTClassifier for each symbol, also of a symbol that no row has and with fewer symbols than asked for."""
    df = _labelled(spark, 4).withColumn("y", F.when(F.col("y") == 1, 0.0).otherwise(F.col("y")))
    train, rows = df.where("t < 700"), df.where("t >= 700")
    got = {r.t: r.p for r in M.symbol_scores(train, rows, "boosted", 4, 5).collect()}
    single = OneVsRest(classifier=GBTClassifier(maxIter=5, maxDepth=3, seed=42), featuresCol="x", labelCol="y")
    fitted = Pipeline(stages=[StandardScaler(inputCol="x0", outputCol="x", withMean=True), single]).fit(train.withColumnRenamed("x", "x0"))
    want = {r.t: 1 / (1 + np.exp(-2 * r.rawPrediction.toArray())) for r in fitted.transform(rows.withColumnRenamed("x", "x0")).collect()}
    assert len(got) == len(want) == 200
    for t, q in want.items():
        assert len(q) == 4 and got[t] == pytest.approx([*(q / q.sum()), 0.0], abs=1e-6)


def test_boosted_passes_are_shared_by_all_symbols(spark, monkeypatch):
    """As many Spark jobs for 8 symbols as for 2; passes read blocks of packed bins; results don't hang on how rows are dealt out."""
    jobs, held, got = [], [], []
    monkeypatch.setattr(B, "pinned", lambda made: held.append(made.localCheckpoint()) or held[-1])
    for symbols, parts in ((2, 3), (8, 3), (8, 1)):
        df = _labelled(spark, symbols).repartition(parts, "t").localCheckpoint()
        spark.sparkContext.setJobGroup(f"boosted{len(jobs)}", "")
        got.append({r.t: r.p for r in M.symbol_scores(df, df, "boosted", 4, symbols).collect()})
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boosted{len(jobs)}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] < 60 and [h.count() for h in held] == [3, 3, 1]
    assert all(abs(a - b) < 1e-9 for t, p in got[1].items() for a, b in zip(p, got[2][t]))


def test_boosted_cuts_count_all_rows(spark):
    """All values where they fit into the bins, else nearly equal parts; a dense feature is cut by cells of all rows."""
    n = 20000
    rows = spark.range(n).select(F.array((F.col("id") % 3 - 1).cast("double"), F.lit(0.0), (F.col("id") - n / 2) / (n / 4), F.when(F.col("id") == 7, 1.0).otherwise(-1.0)).alias("x"))
    cuts, size = B.cut_points(rows, 4)
    assert size == n and cuts[0].tolist() == [-0.5, 0.5] and len(cuts[1]) == 0 and cuts[3].tolist() == [0.0]
    assert np.abs(cuts[2] - (np.arange(1, 32) / 8 - 2)).max() < 0.01 and len(cuts[2]) == 31
    few = spark.range(n).select(F.array(F.when(F.col("id") < 40, F.col("id") / 100 + 0.105).otherwise(F.col("id") % 20)).alias("x"))
    assert B.cut_points(few, 1)[0][0][1:].tolist() == [k + 0.5 for k in range(1, 19)]  # the 40 rare values don't make the others share bins


def test_chances_are_aligned_once(spark):
    """What gives the chances is computed once a row, not once a symbol: counters would move on in between."""
    count = lambda: F.monotonically_increasing_id().cast("double")
    rows = spark.range(1, 4, numPartitions=1).select(M.aligned(F.array(count(), count()), 3).alias("p")).collect()
    assert [r.p for r in rows] == [[pytest.approx(1 / 3)] * 3, [0.5, 0.5, 0.0], [0.5, 0.5, 0.0]]


def test_boosting_refuses_what_it_cannot_fit(spark):
    for x, y in (([1.0, None], 0.0), ([1.0, 2.0], None), ([1.0, 2.0], 0.5), ([1.0, float("inf")], 0.0)):
        rows = spark.createDataFrame([(x, y), ([0.0, 1.0], 1.0)], "x array<double>, y double")
        with pytest.raises(Exception, match="not finite|no symbol"):
            B.boosted_margins(rows, rows, 2)
