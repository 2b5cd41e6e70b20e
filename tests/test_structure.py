"""Operators without a SQL twin against closed forms and brute force, and edge cases of those with one."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqlab.functions import tails
from seqlab.operators import contexts, feature_sets, learned, patterns, predictors, profiles, scalars, series, spectrum, survival


def test_neighbours_and_earlier_by_ranges(spark):
    rng = random.Random(1)
    rows = sorted({(rng.choice(["a", "a", "a", "b", None]), t) for t in rng.sample(range(500), 200)}, key=lambda r: r[1])
    df = spark.createDataFrame([(k, t, 1000 - t) for k, t in rows], "k string, t long, v long")
    for chunk in (16, 1 << 16):
        got = {(r.k, r.t): (r.was, r.next) for r in series.neighbours(df.where("k is not null"), ["k"], chunk=chunk).collect()}
        uses = {(r.k, r.t): (r.uses, r.first_v) for r in series.earlier(df, ["k"], first="v", chunk=chunk).collect()}
        for key in ("a", "b", None):
            ts = [t for k, t in rows if k == key]
            for i, t in enumerate(ts):
                assert uses[key, t] == (i, 1000 - t)
                if key:
                    assert got[key, t] == (ts[i - 1] if i else None, ts[i + 1] if i + 1 < len(ts) else None)
    assert series.neighbours(df.limit(0), ["k"]).collect() == [] and series.earlier(df.limit(0), ["k"]).collect() == []


def test_unknown_feature_sets_are_an_error(spark):
    with pytest.raises(ValueError, match="nothing"):
        feature_sets.build_features(spark.range(3).withColumnRenamed("id", "t"), ["basic", "nothing"])
    assert list(feature_sets.SETS) == ["basic", "recency", "gaps", "position", "temporal", "momentum", "draw_time", "equipment"]


def test_features_do_not_read_their_own_outcome(spark):
    from datetime import date, timedelta

    def table(last):
        rows = [(t, date(2020, 1, 1) + timedelta(t // 2), t % 4, "m", None, "x", t % 3, t * 37 % 1000) for t in range(60)] + [(60, date(2020, 2, 1), 0, "m", "b", "x", 1, last)]
        df = spark.createDataFrame(rows, "t long, day date, slot int, machine string, ball1 string, ball2 string, ball3 int, c int")
        return df.withColumns({"d1": (F.col("c") / 100).cast("int"), "d2": (F.col("c") / 10 % 10).cast("int"), "d3": F.col("c") % 10})

    a, b = (feature_sets.build_features(table(x)).where("t = 60").first() for x in (999, 0))
    assert a == b and len(a) == 245


def test_cox_against_newton_on_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    time = np.ceil(rng.exponential(1 / np.exp(0.8 * x[:, 0] - 0.4 * x[:, 1])) * 5).astype(int)
    event = (rng.random(200) < 0.8).astype(int)
    df = spark.createDataFrame([(int(t), int(e), float(a), float(b)) for t, e, (a, b) in zip(time, event, x)], "duration long, event int, a double, b double")
    got = survival.cox(df, ["a", "b"])
    z, beta = (x - x.mean(0)) / x.std(0), np.zeros(2)
    for _ in range(30):
        g, h = -0.01 * beta, 0.01 * np.eye(2)
        for i in np.flatnonzero(event):
            risk = time >= time[i]
            w = np.exp(z[risk] @ beta)
            mean = (w[:, None] * z[risk]).sum(0) / w.sum()
            g = g + z[i] - mean
            h = h + (w[:, None, None] * z[risk][:, :, None] * z[risk][:, None, :]).sum(0) / w.sum() - np.outer(mean, mean)
        beta = beta + np.linalg.solve(h, g)
    assert np.allclose([got["a"], got["b"]], beta, atol=1e-5) and got["a"] > 0.4 > 0 > got["b"]
    risk = survival.hazard_risk(df, ["a", "b"], got).select("risk").toPandas()["risk"].to_numpy()
    assert np.allclose(sorted(risk), sorted(np.exp(z @ beta)), rtol=1e-3)


def _greedy(x, w, splits, least):
    """Greedy cuts of rows x (n, columns) with weights w, as places in the rows, and the error after each."""
    error = lambda lo, hi: (w[lo:hi, None] * (x[lo:hi] - np.average(x[lo:hi], axis=0, weights=w[lo:hi])) ** 2).sum()
    cuts, out = [0, len(x)], [(None, error(0, len(x)))]
    for _ in range(splits):
        best = (0.0, None)
        for lo, hi in zip(cuts, cuts[1:]):
            for c in range(lo + 1, hi):
                if w[lo:c].sum() >= least and w[c:hi].sum() >= least:
                    best = max(best, (round(error(lo, hi) - error(lo, c) - error(c, hi), 6), -c), key=lambda b: (b[0], b[1] if b[1] is not None else 0))
        if best[1] is None:
            break
        cuts = sorted([*cuts, -best[1]])
        out.append((-best[1], out[-1][1] - best[0]))
    return out


def test_greedy_cuts_of_all_replicates(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 1, (40, 2)) for m in ([0, 0], [4, 0], [4, 3], [1, 3])])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "t long, a double, b double")
    series = profiles.replicated(df, ["a", "b"], 3)
    rows = series.toPandas()
    cuts = profiles.greedy_cuts(series, ["a", "b"], 5, 10, chunk=32)
    found = cuts.orderBy("rep", "step").toPandas()
    for rep, mine in rows.sort_values("t").groupby("rep"):
        want = _greedy(mine[["a", "b"]].to_numpy(), mine["w"].to_numpy(float), 5, 10)
        got = found[found["rep"] == rep]
        t = mine["t"].to_numpy()
        assert [None if c is None else t[c] for c, _ in want] == [None if np.isnan(c) else int(c) for c in got["at"]]
        assert np.allclose([e for _, e in want], got["error"], atol=1e-4)
    table = profiles.bic_of_cuts(cuts.where("rep = 0"), len(x), 2).orderBy("splits").collect()
    bic = [len(x) * np.log(r.error / len(x) + 1e-10) + (r.splits + 1) * 2 * np.log(len(x)) for r in table]
    assert np.allclose(bic, [r.bic for r in table]) and [r.splits for r in table if r.best] == [int(np.argmin(bic))] == [3]
    assert sorted(map(int, table[3].cuts.split(","))) == sorted(found[(found["rep"] == 0) & (found["step"].between(1, 3))]["at"].astype(int)) and table[0].cuts == ""
    stable = {r.at: r.found for r in profiles.cut_stability(cuts, 3, 5).collect()}
    used = found[found["step"].between(1, 3)]
    for at, share in stable.items():
        assert share == np.mean([(abs(used[used["rep"] == k]["at"] - at) <= 5).any() for k in (1, 2, 3)])
    assert len(stable) == 3


def test_constant_series_has_no_cut(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(50)], "t long, x double")
    assert [r.step for r in profiles.greedy_cuts(profiles.replicated(df, ["x"], 0), ["x"], 4, 5).collect()] == [0]


def test_concordance_of_blocks(spark):
    """Pairs counted by blocks equal all pairs, with ties in times and risks and one time that a third of all rows have."""
    rng = np.random.default_rng(8)
    time, risk = rng.integers(1, 40, 900), rng.normal(size=900).round(1)
    time[:300], risk[300:420] = 7, 0.5
    risk[420:] = rng.normal(size=480)
    event = (rng.random(900) < 0.6).astype(int)
    later = time[None, :] > time[:, None]
    pairs = (later * event[:, None]).sum()
    good = (later * event[:, None] * (np.where(risk[:, None] > risk[None, :], 1.0, 0.0) + 0.5 * (risk[:, None] == risk[None, :]))).sum()
    df = spark.createDataFrame([(int(a), int(e), float(r)) for a, e, r in zip(time, event, risk)], "time int, event int, risk double")
    for blocks in (1, 7, 64):
        (row,) = patterns.concordance(df, "time", "event", "risk", blocks=blocks).collect()
        assert row.pairs == pairs and abs(row.c_index - good / pairs) < 1e-12
    assert patterns.concordance(df.where("event = 0"), "time", "event", "risk").first().c_index is None


def test_motifs_are_disjoint(spark):
    rng = random.Random(4)
    x = [rng.random() for _ in range(120)]
    x[20:27] = x[80:87]
    m = 7
    df = spark.createDataFrame(list(enumerate(x)), "t long, x double")
    profile = {r.t: (r.distance, r.nearest) for r in profiles.matrix_profile(df, "x", m, block=25).collect()}
    runs = np.array([x[i : i + m] for i in range(len(x) - m + 1)])
    z = (runs - runs.mean(1, keepdims=True)) / runs.std(1, keepdims=True)
    for i in range(len(z)):
        d = np.sqrt(((z - z[i]) ** 2).sum(1))
        d[max(0, i - 3) : i + 4] = np.inf
        assert abs(profile[i][0] - d.min()) < 1e-6
    pinned = spark.createDataFrame([(t, d, n) for t, (d, n) in profile.items()], "t long, distance double, nearest long")
    found = profiles.motifs(pinned, m, 4)
    assert {found[0][1], found[0][3]} == {20, 80} and all(abs(a[1] - b[1]) >= m for a, b in combinations(found, 2))
    worst = profiles.motifs(pinned, m, 3, most=True)
    assert worst[0][2] == max(d for d, _ in profile.values())


def test_logistic_regressions(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3))
    y = (rng.random(600) < 1 / (1 + np.exp(-1.5 * x[:, 0]))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(v), int(rng.random() < 0.5)) for (a, b, c), v in zip(x, y)], "a double, b double, c double, y int, noise int")
    rows = {r.target: r for r in learned.logit_lr(df, ["y", "noise"], ["a", "b"], ["c"]).collect()}
    assert rows["y"].p < 1e-6 < 0.001 < rows["noise"].p and rows["y"].r2 > 0.1 and rows["y"].lr > 50
    kept = {(r.target, r.column): r.kept for r in learned.l1_select(df, ["y", "noise"], ["a", "b", "c"], strength=0.1).collect()}
    assert kept["y", "a"] and not any(v for k, v in kept.items() if k != ("y", "a"))


def test_logistic_regressions_read_groups(spark, monkeypatch):
    """Rows of few days are fitted as groups, and give what a fit of the rows gives."""
    rng = np.random.default_rng(20)
    days = rng.normal(size=(12, 2))
    rows = [(float(a), float(b), int(rng.random() < 1 / (1 + np.exp(-a)))) for a, b in days[rng.integers(0, 12, 9000)]]
    df, held = spark.createDataFrame(rows, "a double, b double, y int"), []
    monkeypatch.setattr(learned, "pinned", lambda made: held.append(made.localCheckpoint()) or held[-1])
    got = learned.logit_lr(df, ["y"], ["a"], ["b"]).first()
    assert held[0].count() == 12

    def deviance(columns):
        x, y, w = np.array([[1, *(r[k] for k in columns)] for r in rows]), np.array([r[2] for r in rows]), np.zeros(1 + len(columns))
        for _ in range(30):
            p = 1 / (1 + np.exp(-x @ w))
            w += np.linalg.solve((x.T * (p * (1 - p))) @ x, x.T @ (y - p))
        p = 1 / (1 + np.exp(-x @ w))
        return -2 * np.sum(np.where(y == 1, np.log(p), np.log(1 - p)))

    full, small, none = deviance([0, 1]), deviance([1]), deviance([])
    assert np.allclose([got.lr, got.aic, got.r2], [small - full, full + 6, 1 - full / none], rtol=1e-7)


def test_periodogram_finds_a_period(spark):
    items = spark.createDataFrame([(t, 1) for t in range(0, 240, 12)] + [(t, 2) for t in (3, 50, 51, 200)], "t long, item int")
    top = {r.item: r for r in spectrum.periodogram(items, 240).where("place = 1").collect()}
    assert top[1].period == 12 and top[1].k == 20
    want = np.abs(np.fft.rfft(np.isin(np.arange(240), [3, 50, 51, 200]) - 4 / 240))[1:120]
    assert abs(top[2].power - want.max()) < 1e-5


def test_models_learn_what_there_is(spark):
    """Each kind of classifier and the isotonic fit on a label that a feature gives away."""
    rows = [(t, t % 3, float(t % 3 == 0), float(t % 3 == 1), float(t % 7)) for t in range(300)]
    df = learned.vectors(spark.createDataFrame(rows, "t long, label int, a double, b double, c double"), ["a", "b", "c"], "label", ["t"])
    train, rest = df.where("t < 200"), df.where("t >= 200")
    for kind in ("forest", "boosted", "logistic", "perceptron"):
        scored = learned.symbol_scores(train, rest, kind, 3, 3).collect()
        assert sum(max(range(3), key=lambda k: r.p[k]) == r.y for r in scored) >= 95 and all(abs(sum(r.p) - 1) < 1e-6 for r in scored)
    assert 0 in learned.select_by_importance(train, 3) and 2 not in learned.select_by_importance(train, 3)
    scores = spark.createDataFrame([(float(i) / 100, float(i >= 50)) for i in range(100)], "s double, y double")
    calibrated = {round(r.s, 2): r.calibrated for r in learned.calibrate_isotonic(scores, scores, "s", "y").collect()}
    assert calibrated[0.1] == 0 and calibrated[0.9] == 1


def test_tails(spark):
    rows = spark.createDataFrame([(k, 20, 0.3) for k in range(21)], "k int, n int, p double")
    got = {r.k: r.b for r in rows.select("k", tails.binomial_two_sided(F.col("k"), F.col("n"), F.col("p")).alias("b")).collect()}
    pmf = [math.comb(20, k) * 0.3**k * 0.7 ** (20 - k) for k in range(21)]
    assert all(abs(got[k] - min(1, 2 * min(sum(pmf[: k + 1]), sum(pmf[k:])))) < 1e-9 for k in range(21))
    ks = spark.range(1).select(*(tails.kolmogorov(F.lit(d), F.lit(10_000.0)).alias(f"d{i}") for i, d in enumerate((0.0, 0.0136, 0.0163)))).first()
    assert ks.d0 == 1 and abs(ks.d1 - 0.049) < 0.002 and abs(ks.d2 - 0.01) < 0.001


def test_nearest_with_ties(spark):
    rng = random.Random(9)
    rows = [(t, rng.randrange(4), rng.randrange(4), rng.randrange(3)) for t in range(150)]
    df = spark.createDataFrame(rows, "t long, a int, b int, y int")
    got = {(r.t, r.symbol): r.p for r in predictors.nearest(df.where("t < 120"), df.where("t >= 120"), ["a", "b"], "y", 3, k=7, block=10).collect()}
    train = np.array(rows[:120], float)
    mean, spread = train[:, 1:3].mean(0), train[:, 1:3].std(0)
    for t, a, b, _ in rows[120:]:
        d = np.round(np.sqrt((((train[:, 1:3] - [a, b]) / spread) ** 2).sum(1)), 9)
        best = np.lexsort((train[:, 0], d))[:7]
        w = 1 / (d[best] + 1e-6)
        assert all(abs(got[t, s] - w[train[best, 3] == s].sum() / w.sum()) < 1e-6 for s in range(3))
    assert mean.shape == (2,)


def test_scalar_edges(spark):
    from datetime import datetime

    df = spark.createDataFrame([(datetime(2024, 1, 6, 22, 12), [1], 7, "a"), (datetime(2024, 1, 7, 3, 0), [], None, None)], "ts timestamp_ntz, xs array<int>, c int, k string")
    rows = df.select(scalars.next_slot(F.col("ts"), ["22:12", "10:00"]).alias("slot"), *(v.alias(n) for n, v in scalars.basket_shape(F.col("xs"), 5).items() if n in ("size", "total", "sd", "range"))).collect()
    assert [r.slot for r in rows] == [datetime(2024, 1, 8, 10, 0)] * 2 and [(r.size, r.total, r.sd, r.range) for r in rows] == [(1, 1, None, 0), (0, 0, None, None)]
    vocabulary = scalars.build_vocabulary(df, ["k"])
    assert [r.token_k for r in scalars.tokenize(df, vocabulary, ["k"], []).collect()] == [3, 2]
    with pytest.raises(Exception, match="no symbol"):
        scalars.tokenize(df, vocabulary, [], ["c"], symbols=5).collect()


def test_windows_at_the_ends(spark):
    steps = spark.createDataFrame([(t, [1, 3] if t % 2 else []) for t in range(10)], "t long, xs array<int>")
    stats = {r.t: r for r in contexts.rolling_basket_stats(steps, range(1, 4), 4).collect()}
    assert stats[0].chi2 == 0 and stats[0].entropy == 0 and abs(stats[9].entropy - 1) < 1e-9
    assert contexts.previous_context(steps).where("t = 0").first()[1:] == (0, 0, 0, 0)
    parts = {r.split: r.n for r in contexts.split_counts(contexts.split_windows(steps, [5], 1, 2)).collect()}
    assert parts == {0: 2, None: 2, 1: 3}


def test_property_intersection(spark):
    rows = [(t, t % 4, t % 4 // 2, t % 2, float(t % 4 // 2), float(t % 2)) for t in range(200)]
    df = spark.createDataFrame(rows, "t long, c int, high int, odd int, a double, b double")
    made = learned.vectors(df, ["a", "b"], "c", ["t", "c", "high", "odd"])
    scored = learned.property_intersection(made.where("t < 150"), made.where("t >= 150"), ["high", "odd"], [(c // 2, c % 2) for c in range(4)]).collect()
    assert len(scored) == 50 and all(abs(sum(r.p) - 1) < 1e-9 and max(range(4), key=lambda k: r.p[k]) == r.c for r in scored)


def test_rule_scores_are_summed_where_they_are_made(spark):
    """Items are dealt out once, by step; neither what the rules give nor its ranks moves again. Several sizes give what each alone gives."""
    rng = random.Random(6)
    rows = sorted({(rng.randrange(60), rng.randrange(6)) for _ in range(200)})
    items = spark.createDataFrame(rows, "t long, item int")
    rules = spark.createDataFrame([(a, b, 0.1 * (a + 1), 0.5 + 0.2 * b) for a in range(6) for b in range(6) if (a + b) % 3], "a int, b int, confidence double, lift double")
    scores = patterns.rule_scores(items, rules)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    want = {}
    for t, a in rows:
        for b in range(6):
            if (a + b) % 3:
                want[t + 1, b] = want.get((t + 1, b), 0.0) + np.log(0.5 + 0.2 * b) * 0.1 * (a + 1)
    got = {(r.t, r.item): r.score for r in scores.collect()}
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    have = set(rows)
    both = {r.n: r for r in patterns.top_n_backtests(scores, items, [1, 4]).collect()}
    for n in (1, 4):
        best = {t: sorted((-round(v, 9), b) for (u, b), v in want.items() if u == t)[:n] for t in {t for t, _ in want} & {t for t, _ in rows}}
        hits = {t: sum((t, b) in have for _, b in x) for t, x in best.items()}
        one = patterns.top_n_backtest(scores, items, n).first()
        for r in (one, both[n]):
            assert r.steps == len(best) and abs(r.hits - np.mean(list(hits.values()))) < 1e-12
            assert abs(r.precision - sum(hits.values()) / sum(map(len, best.values()))) < 1e-12 and abs(r.recall - sum(hits.values()) / sum(t in best for t, _ in rows)) < 1e-12


def test_greedy_cuts_read_the_series_once(spark):
    """The samples behind the replicates are drawn once, however many cuts are looked for."""
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    rows = [(0, t, 1, float(t // 30 % 2)) for t in range(120)]
    series = spark.createDataFrame(rows, "rep int, t long, w long, x double").mapInPandas(counted, "rep int, t long, w long, x double")
    cuts = profiles.greedy_cuts(series, ["x"], 3, 5, chunk=16).orderBy("step").collect()
    assert read.value == 120 and sorted(r.at for r in cuts if r.step) == [30, 60, 90] and abs(cuts[-1].error) < 1e-9


def test_pattern_family_reads_tokens_once(spark):
    """Against brute force, with gaps, repeated tokens and small runs of steps."""
    rng = np.random.default_rng(21)
    rows = [(mode, int(t), f"{mode}{k}") for mode in ("a", "b") for t in range(200) if t % 17 for k in rng.integers(0, 4, rng.integers(0, 5))]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    tokens = spark.createDataFrame(rows, "mode string, t long, token string").mapInArrow(counted, "mode string, t long, token string")
    got = {r["mode"]: r.tested for r in profiles.pattern_family(tokens, 200, {"a": 20, "b": 30}).collect()}
    assert read.value == len(rows)
    n = Counter((m, x, y) for m, t, x in rows for k, u, y in rows if k == m and u == t + 1)
    want = Counter(m for (m, _, _), times in n.items() if times >= {"a": 20, "b": 30}[m])
    assert got == dict(want) and min(want.values()) > 1
    found = [profiles._counted(8, 199)(pa.table({"mode": [m] * len(part), "_chunk": [c] * len(part), "t": pa.array([t for t, _ in part], pa.int64()), "token": [x for _, x in part]})).to_pylist()
             for m in ("a", "b") for c in range(25) if (part := [(t, x) for k, t, x in rows if k == m and 8 * c <= t <= 8 * c + 8])]
    sums = Counter()
    for r in (r for part in found for r in part):
        sums[r["mode"], r["a"], r["b"]] += r["n"]
    each = Counter((m, x, None) for m, t, x in rows if t < 199) + Counter((m, None, y) for m, t, y in rows if t >= 1)
    assert sums == n + each
