"""Patterns over steps, contrasts between contexts, edges between items, and survival scores, all in long sparse form."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import binomial_two_sided, chi_square, fisher_greater
from ..storage import pinned
from .items import adjust_p_values, cross_step_pairs, pair_counts
from .relations import quantile_bins
from .series import prefix_sum, with_ordinal


def pair_significance(items: DataFrame, steps: int, domain: int) -> DataFrame:
    """z of each pair's count in a step against independent items, exact two-sided p and its Bonferroni value over all pairs.

    Pairs that never met count as zero. Items are a bounded domain: their rates are joined to themselves.
    """
    rates = items.groupBy("item").agg((F.count("*") / steps).alias("rate"))
    left, right = rates.toDF("a", "ra"), rates.toDF("b", "rb")
    grid = left.join(F.broadcast(right), F.col("a") < F.col("b")).join(pair_counts(items), ["a", "b"], "left").na.fill(0, ["n"])
    p = F.col("ra") * F.col("rb")
    z = (F.col("n") - steps * p) / F.sqrt(steps * p * (1 - p))
    tested = grid.select("a", "b", "n", z.alias("z"), binomial_two_sided(F.col("n"), F.lit(steps), p).alias("p"))
    return tested.withColumn("p_bonferroni", F.least(F.col("p") * (domain * (domain - 1) // 2), F.lit(1.0)))


def cross_step_triples(items: DataFrame, least: int) -> DataFrame:
    """a, b, c on three steps in a row, least times or more; only pairs with that support are extended."""
    pairs = cross_step_pairs(items, least).select("a", "b")
    left, mid, right = items.toDF("t", "a"), items.select((F.col("t") - 1).alias("t"), F.col("item").alias("b")), items.select((F.col("t") - 2).alias("t"), F.col("item").alias("c"))
    held = left.join(mid, "t").join(pairs, ["a", "b"], "left_semi").join(right, "t").join(pairs.toDF("b", "c"), ["b", "c"], "left_semi")
    return held.groupBy("a", "b", "c").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def rule_tests(items: DataFrame, steps: int, least: int, ahead: int = 1) -> DataFrame:
    """Rules a now, b ahead steps later: support, confidence, lift, one-sided Fisher p from the two-by-two table."""
    inside = items.where(F.col("t") < steps - ahead).groupBy(F.col("item").alias("a")).agg(F.count("*").alias("na"))
    later = items.where(F.col("t") >= ahead).groupBy(F.col("item").alias("b")).agg(F.count("*").alias("nb"))
    m = F.lit(steps - ahead).cast("long")
    rows = cross_step_pairs(items, least, ahead).join(inside, "a").join(later, "b")
    p = fisher_greater(F.col("n"), F.col("na") - F.col("n"), F.col("nb") - F.col("n"), m - F.col("na") - F.col("nb") + F.col("n"))
    return rows.select("a", "b", "n", (F.col("n") / F.col("na")).alias("confidence"), (F.col("n") * m / (F.col("na") * F.col("nb"))).alias("lift"), p.alias("p"))


def rule_windows(items: DataFrame, steps: int, least: int, offsets: list[int]) -> DataFrame:
    """rule_tests at several offsets, with the offset as a column."""
    out = None
    for w in offsets:
        rows = rule_tests(items, steps, least, w).withColumn("ahead", F.lit(w))
        out = rows if out is None else out.unionByName(rows)
    return out


def by_step(items: DataFrame, rows: int = 100_000) -> DataFrame:
    """items dealt out by t, about so many rows to a part, so that what follows for each step needs no further shuffle and fits its task."""
    return items.repartition(max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-items.count() // rows)), "t")


def rule_scores(items: DataFrame, rules: DataFrame, ahead: int = 1) -> DataFrame:
    """Per (t, item) the summed ln(lift) * confidence of the rules whose first item came ahead steps before.

    The items of a step meet first and the rules come to them, so what the rules give is summed where it is made.
    """
    came = by_step(items.select((F.col("t") + ahead).alias("t"), F.col("item").alias("a")))
    fired = came.join(F.broadcast(rules.select("a", "b", (F.log("lift") * F.col("confidence")).alias("w"))), "a")  # a rule for each pair of items at most
    return fired.groupBy("t", F.col("b").alias("item")).agg(F.sum("w").alias("score"))


def top_n_backtests(scores: DataFrame, items: DataFrame, sizes: list[int], places: int = 9) -> DataFrame:
    """n, steps, hits, precision, recall of top_n_backtest() for each n of sizes; scores and items are read once."""
    place = F.row_number().over(Window.partitionBy("t").orderBy(F.round("score", places).desc(), "item"))
    best = scores.withColumn("_r", place).where(F.col("_r") <= max(sizes)).groupBy("t").agg(F.collect_list(F.struct("_r", "item")).alias("best"))
    held = best.join(by_step(items).groupBy("t").agg(F.count("*").alias("size"), F.collect_list("item").alias("xs")), "t")

    def among(n: int):
        return F.filter("best", lambda b: b["_r"] <= n)

    each = held.select("size", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.size(among(n)).alias("picked"), F.size(F.filter(among(n), lambda b: F.array_contains("xs", b["item"]))).alias("hits")) for n in sizes))).alias("x")).select("size", "x.*")
    return each.groupBy("n").agg(F.count("*").alias("steps"), F.avg("hits").alias("hits"), (F.sum("hits") / F.sum("picked")).alias("precision"), (F.sum("hits") / F.sum("size")).alias("recall"))


def top_n_backtest(scores: DataFrame, items: DataFrame, n: int, places: int = 9) -> DataFrame:
    """The n best scored items of each step against what came: steps, hits per step, precision and recall."""
    found = top_n_backtests(scores, items, [n], places).drop("n")
    return found.agg(F.coalesce(F.max("steps"), F.lit(0).cast("long")).alias("steps"), *(F.max(c).alias(c) for c in ("hits", "precision", "recall")))  # one row, also of nothing


def contrast(items: DataFrame, labels: DataFrame, default: float = 0.001) -> DataFrame:
    """Items and pairs in steps labelled true against those labelled false: supports, growth, chi-square with Yates' correction."""
    both = pinned(labels.where(F.col("label").isNotNull()))
    sizes = both.agg(F.count_if("label").alias("s1"), F.count_if(~F.col("label")).alias("s0"))
    baskets = items.join(both, "t").groupBy("t", "label").agg(F.sort_array(F.collect_set("item")).alias("xs"))
    sets = F.concat(F.transform("xs", lambda a: F.array(a)), F.flatten(F.transform("xs", lambda a: F.transform(F.filter("xs", lambda b: b > a), lambda b: F.array(a, b)))))
    each = baskets.select("label", F.explode(sets).alias("items")).groupBy("items").agg(F.count_if("label").alias("n1"), F.count_if(~F.col("label")).alias("n0")).join(F.broadcast(sizes))
    n1, n0, s1, s0 = (F.col(x).cast("double") for x in ("n1", "n0", "s1", "s0"))
    n = s1 + s0
    gap = F.greatest(F.abs(n1 * (s0 - n0) - n0 * (s1 - n1)) - n / 2, F.lit(0.0))
    chi = F.try_divide(n * gap * gap, s1 * s0 * (n1 + n0) * (n - n1 - n0))
    growth = F.when(n1 > 0, n1 / s1).otherwise(F.lit(0.0)) / F.when(n0 > 0, n0 / s0).otherwise(default)
    return each.select("items", "n1", "n0", growth.alias("growth"), F.coalesce(chi, F.lit(0.0)).alias("chi2"), "s1", "s0")


def with_lift(contrasts: DataFrame) -> DataFrame:
    """contrast() with the share in true steps over that in all (lift), p of chi-square, and its Benjamini-Hochberg value over all patterns."""
    share, whole = F.col("n1") / F.col("s1"), (F.col("n1") + F.col("n0")) / (F.col("s1") + F.col("s0"))
    tested = contrasts.withColumns({"lift": share / whole, "p": chi_square(F.col("chi2"), 1), "_all": F.lit(1)}).drop("s1", "s0")
    return adjust_p_values(tested, "p", "_all").drop("_all", "p_bonferroni")


def centrality(edges: DataFrame, nodes: int) -> DataFrame:
    """Share of the other nodes that each node has an edge (a, b) with."""
    ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return ends.groupBy(F.col("a").alias("item")).agg((F.count("*") / (nodes - 1)).alias("centrality"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Weighted modularity of a labelling (item, label) of undirected edges (a, b, w)."""
    whole = edges.agg(F.sum("w").alias("m"))
    ends = edges.select(F.col("a").alias("item"), "w").unionAll(edges.select(F.col("b").alias("item"), "w"))
    degrees = ends.join(labels, "item").groupBy("label").agg(F.sum("w").alias("d"))
    inner = edges.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").where("la = lb").groupBy(F.col("la").alias("label")).agg(F.sum("w").alias("i"))
    parts = degrees.join(inner, "label", "left").na.fill(0, ["i"]).join(F.broadcast(whole))
    return parts.agg(F.sum(F.col("i") / F.col("m") - (F.col("d") / (2 * F.col("m"))) ** 2).alias("modularity"))


def _dominated(order: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each place the sum of n over later places whose order is smaller; halves are merged level by level."""
    total, at, width = np.zeros(len(order), np.int64), np.arange(len(order)), 1
    while width < len(order):
        node, right = at // (2 * width), (at // width) % 2 == 1
        by = np.lexsort((order, node))
        sums = np.cumsum(np.where(right, n, 0)[by])
        start = np.searchsorted(node[by], node[by])  # sums run on from node to node
        total[by] += np.where(right[by], 0, sums - np.where(start > 0, sums[start - 1], 0))
        width *= 2
    return total


def concordance(df: DataFrame, time: str, event: str, risk: str, blocks: int = 1024) -> DataFrame:
    """Share of comparable pairs (the earlier one an event) in which the earlier has the larger risk, ties one half: pairs, c_index.

    Equal (time, risk) are one cell. Cells are numbered by (time, risk) and by (risk, time); a pair is concordant if the
    later one in the first order is the earlier in the second. Both orders are cut into so many blocks of equal size,
    whatever the ties. Pairs within a block of either order are counted in its task, by merging halves; all others by
    the numbers of cells in each pair of blocks, at most blocks squared numbers, which one task sums up.
    """
    cells = df.groupBy(F.col(time).alias("d"), F.col(risk).alias("r")).agg(F.count("*").alias("n"), F.sum(event).alias("e"))
    first = with_ordinal(cells, ["d", "r"], "p")
    both = pinned(with_ordinal(first, ["r", "d"], "q"))
    size = max(1, -(-both.count() // blocks))
    both = both.withColumns({"a": F.floor(F.col("p") / size).cast("int"), "b": F.floor(F.col("q") / size).cast("int")})

    def inside(first_: str, second: str):
        """Weights of the concordant pairs in a block; for blocks of the second order those of two blocks of the first."""

        def count(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values([first_, "q"] if second == "q" else [first_])
            found = _dominated(rows["q"].to_numpy(), rows["n"].to_numpy())
            return pd.DataFrame({"v": [int((found * rows["e"].to_numpy()).sum())]})

        return count

    by_time = both.groupBy("a").applyInPandas(inside("p", "p"), "v long")
    by_risk = both.groupBy("b").applyInPandas(inside("a", "q"), "v long")
    table = both.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))

    def apart(batches):
        n, e = np.zeros((blocks + 1, blocks + 1), np.int64), np.zeros((blocks + 1, blocks + 1), np.int64)
        for x in batches:
            a, b = x.column("a").to_numpy(), x.column("b").to_numpy()
            n[a, b], e[a, b] = x.column("n").to_numpy(), x.column("e").to_numpy()
        later = n[::-1].cumsum(0)[::-1]  # of this block of times and all later ones
        below = later.cumsum(1) - later  # and of lower blocks of risks
        yield pa.RecordBatch.from_arrays([pa.array([int((e[:-1] * below[1:]).sum())])], ["v"])

    over = table.coalesce(1).mapInArrow(apart, "v long")
    # comparable pairs, and those of equal risk, from running counts along either order
    along = prefix_sum(both.select("d", "r", "e", "n"), ["d", "r"], "n", "before")
    ends = along.groupBy("d").agg(F.max(F.col("before") + F.col("n")).alias("upto"), F.sum("e").alias("e"))
    whole = both.agg(F.sum("n").alias("all"))
    pairs = ends.join(F.broadcast(whole)).agg(F.sum(F.col("e") * (F.col("all") - F.col("upto"))).alias("pairs"))
    equal = prefix_sum(both.select("d", "r", "e", "n"), ["r", "d"], "n", "before")
    last = equal.groupBy("r").agg(F.max(F.col("before") + F.col("n")).alias("last"), F.sum("e").alias("e"), F.sum(F.col("e") * (F.col("before") + F.col("n"))).alias("seen"))
    ties = last.agg(F.sum(F.col("e") * F.col("last") - F.col("seen")).alias("ties"))
    good = by_time.union(by_risk).union(over).agg(F.sum("v").alias("good"))
    joined = pairs.join(F.broadcast(ties)).join(F.broadcast(good))  # one row each
    return joined.select("pairs", F.try_divide(F.col("good") + F.col("ties") / 2, F.col("pairs")).alias("c_index"))


def brier_at(spells: DataFrame, rate: str, horizons: list[int]) -> DataFrame:
    """Mean (S(h) - 1[duration > h])^2 of exponential survival at each horizon, over spells whose state at h is known."""
    rows = spells.select("duration", "event", rate, F.explode(F.array(*map(F.lit, horizons))).alias("h")).where("event = 1 or duration > h")
    return rows.groupBy("h").agg(F.count("*").alias("n"), F.avg((F.exp(-F.col(rate) * F.col("h")) - (F.col("duration") > F.col("h")).cast("int")) ** 2).alias("brier"))


def calibration(df: DataFrame, score: str, label: str, bins: int) -> DataFrame:
    """Rows in equal widths of a score from 0 to 1: n, mean score, rate of the label."""
    return df.groupBy(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("score"), F.avg(label).alias("rate"))


def calibration_by_quantiles(df: DataFrame, score: str, label: str, bins: int) -> DataFrame:
    """As calibration(), in quantiles of the score; equal edges are one."""
    return quantile_bins(df, score, bins).groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("score"), F.avg(label).alias("rate"))


def log_odds(p: Column, floor: float = 1e-10) -> Column:
    held = F.greatest(F.least(p, F.lit(1 - floor)), F.lit(floor))
    return F.log(held / (1 - held))


def process_scores(df: DataFrame, model: str, base: str, label: str, clip: float = 1e-6) -> DataFrame:
    """Bernoulli log-likelihood and Brier of two probabilities, and the likelihood ratio between them."""

    def ll(p):
        held = F.greatest(F.least(F.col(p), F.lit(1 - clip)), F.lit(clip))
        return F.avg(F.when(F.col(label) == 1, F.log(held)).otherwise(F.log(1 - held)))

    one = df.agg(F.count("*").alias("n"), ll(model).alias("ll_model"), ll(base).alias("ll_base"), F.avg((F.col(model) - F.col(label)) ** 2).alias("brier_model"), F.avg((F.col(base) - F.col(label)) ** 2).alias("brier_base"))
    return one.withColumn("lr", 2 * F.col("n") * (F.col("ll_model") - F.col("ll_base")))


def segment_costs(df: DataFrame, x: str, cuts: list[int], least: int, t: str = "t") -> DataFrame:
    """Per segment between cuts the split with the largest fall of squared error: start, stop, at, gain.

    Prefix sums by ranges give each candidate's cost; only one row per segment comes back.
    """
    spans = F.array(*(F.lit(c).cast("long") for c in cuts))
    rows = prefix_sum(df.select(F.col(t).alias("at"), F.col(x).cast("double").alias("v")), ["at"], "v", "before")
    rows = rows.withColumn("k", F.size(F.filter(spans, lambda c: c <= F.col("at"))) - 1)
    whole = rows.groupBy("k").agg(F.min("at").alias("start"), (F.max("at") + 1).alias("stop"), F.sum("v").alias("total"), F.min_by("before", "at").alias("base"))
    at, n = rows.join(F.broadcast(whole), "k"), F.col("stop") - F.col("start")
    left, s = F.col("at") - F.col("start"), F.col("before") - F.col("base")
    rest = F.col("total") - s
    gain = s * s / left + rest * rest / (n - left) - F.col("total") * F.col("total") / n
    able = at.where((left >= least) & (n - left >= least)).withColumn("gain", F.round(gain, 6))
    return able.groupBy("start", "stop").agg(F.max(F.struct("gain", (-F.col("at")).alias("at"))).alias("x")).select("start", "stop", (-F.col("x.at")).alias("at"), F.col("x.gain").alias("gain"))


def binary_segmentation(df: DataFrame, x: str, splits: int, least: int) -> DataFrame:
    """Greedy splits of a series by squared error, one pass each (splits are few): step, at, gain."""
    rows, cuts, found = pinned(df.select("t", x)), [0], []
    for step in range(splits):
        best = segment_costs(rows, x, sorted(cuts), least).orderBy(F.desc("gain"), "at").first()  # one row per segment
        if best is None or best.gain <= 0:
            break
        cuts.append(best.at)
        found.append((step + 1, best.at, best.gain))
    return df.sparkSession.createDataFrame(found, "step int, at long, gain double")


def jaccard_pairs(items: DataFrame) -> DataFrame:
    """Jaccard similarity of the steps of each two items that meet in one: a, b, jaccard. Pairs are made inside a basket."""
    sizes = items.groupBy("item").agg(F.count("*").alias("n"))
    both = pair_counts(items)
    return both.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").select("a", "b", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"))
