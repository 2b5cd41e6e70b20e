"""Items of baskets in long form (t, item): frequencies, gaps, runs, co-occurrence, transfer and spells, all sparse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import neighbours


def item_frequency(items: DataFrame, steps: int, domain: int) -> DataFrame:
    """Per item its count, z against equal chances and its part of chi-square. steps and domain are known sizes."""
    total = items.agg(F.count("*").alias("all"))
    each = items.groupBy("item").agg(F.count("*").alias("n")).join(F.broadcast(total))
    expected = F.col("all") / domain
    return each.select("item", "n", ((F.col("n") - expected) / F.sqrt(expected * (1 - expected / steps))).alias("z"), ((F.col("n") - expected) ** 2 / expected).alias("chi2_part"))


def item_gaps(items: DataFrame) -> DataFrame:
    """Per item its completed gaps (count, mean, longest) and the last step it came in."""
    gaps = neighbours(items, ["item"]).withColumn("gap", F.col("t") - F.col("was"))
    return gaps.groupBy("item").agg(F.count("gap").alias("gaps"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("longest"), F.max("t").alias("last_t"))


def runs_test(items: DataFrame, steps: int) -> DataFrame:
    """Wald-Wolfowitz runs of presence and absence per item, from the islands of its hits: runs, z (0 if degenerate)."""
    marked = neighbours(items, ["item"]).withColumn("opens", (F.coalesce("was", F.lit(-9)) < F.col("t") - 1).cast("int"))
    each = marked.groupBy("item").agg(F.count("*").alias("n1"), F.sum("opens").alias("islands"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    runs = 2 * F.col("islands") + 1 - (F.col("lo") == 0).cast("int") - (F.col("hi") == steps - 1).cast("int")
    n1, n2 = F.col("n1").cast("double"), (F.lit(steps) - F.col("n1")).cast("double")
    mean = 2 * n1 * n2 / steps + 1
    spread = (mean - 1) * (mean - 2) / (steps - 1)
    return each.select("item", runs.alias("runs"), F.when(spread > 0, (runs - mean) / F.sqrt(spread)).otherwise(0.0).alias("z"))


def autocorrelation(items: DataFrame, steps: int) -> DataFrame:
    """Lag-1 autocorrelation of presence per item, from counts of hits and of hits that follow a hit."""
    each = neighbours(items, ["item"]).withColumn("again", (F.col("was") == F.col("t") - 1).cast("int")).groupBy("item").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("again"), F.lit(0)).alias("n11"), F.max((F.col("t") == 0).cast("int")).alias("first"), F.max((F.col("t") == steps - 1).cast("int")).alias("last")
    )
    p = F.col("n") / steps
    top = F.col("n11") - p * (F.col("n") - F.col("first")) - p * (F.col("n") - F.col("last")) + (steps - 1) * p * p
    return each.select("item", F.try_divide(top, F.col("n") * (1 - p)).alias("r"))


def pair_counts(items: DataFrame) -> DataFrame:
    """How many steps hold both items of each pair a < b. The pairs of a basket are made from its sorted array, in its row."""
    baskets = items.groupBy("t").agg(F.sort_array(F.collect_set("item")).alias("xs"))
    pairs = F.flatten(F.transform("xs", lambda a: F.transform(F.filter("xs", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return baskets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def cross_step_pairs(items: DataFrame, least: int, ahead: int = 1) -> DataFrame:
    """Item a in a step and b ahead steps later, where it happened least times or more."""
    left, right = items.select("t", F.col("item").alias("a")), items.select((F.col("t") - ahead).alias("t"), F.col("item").alias("b"))
    return left.join(right, "t").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def excitation_ratio(items: DataFrame, steps: int, lag: int) -> DataFrame:
    """P(b | a, lag steps before) over P(b | no a) for all ordered pairs a <> b; 1 where it is undefined."""
    inside = items.where(F.col("t") < steps - lag).groupBy(F.col("item").alias("a")).agg(F.count("*").alias("n_a"))
    later = items.where(F.col("t") >= lag).groupBy(F.col("item").alias("b")).agg(F.count("*").alias("n_b"))
    both = cross_step_pairs(items, 1, lag)
    grid = inside.join(F.broadcast(later), F.col("a") != F.col("b")).join(both, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    with_a = F.try_divide(F.col("n"), F.col("n_a"))
    without = F.try_divide(F.col("n_b") - F.col("n"), F.lit(steps - lag) - F.col("n_a"))
    return grid.select("a", "b", F.coalesce(F.try_divide(with_a, without), F.lit(1.0)).alias("ratio"))


def base_rates(items: DataFrame, steps: int) -> DataFrame:
    return items.groupBy("item").agg((F.count("*") / steps).alias("rate"))


def decayed_presence(items: DataFrame, beta: float = 1.0, lookback: int = 10) -> DataFrame:
    """Per (t, item) the sum of exp(-beta k) over its hits k = 1 .. lookback steps before; rows without any are left out."""
    ks = F.explode(F.sequence(F.lit(1), F.lit(lookback))).alias("k")
    return items.select("t", "item", ks).groupBy((F.col("t") + F.col("k")).alias("t"), "item").agg(F.sum(F.exp(-beta * F.col("k"))).alias("presence"))


def spells(items: DataFrame, steps: int) -> DataFrame:
    """Waiting times: from each hit to the next (event 1) or to the end of the series (event 0)."""
    nxt = F.col("next")
    rows = neighbours(items, ["item"]).select("item", F.col("t").alias("start"), (F.coalesce(nxt, F.lit(steps)) - F.col("t")).alias("duration"), nxt.isNotNull().cast("int").alias("event"))
    return rows.where("duration > 0")


def exponential_hazard(waits: DataFrame) -> DataFrame:
    """Events per exposed step of each item, and the chance of an event within one step."""
    rate = F.sum("event") / F.sum("duration")
    return waits.groupBy("item").agg(rate.alias("rate"), (1 - F.exp(-rate)).alias("p1"))


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mutual information (nats) of two discrete columns, from their contingency table."""
    cells = df.groupBy(x, y).agg(F.count("*").alias("n"))
    rows, columns, total = cells.groupBy(x).agg(F.sum("n").alias("nx")), cells.groupBy(y).agg(F.sum("n").alias("ny")), cells.agg(F.sum("n").alias("m"))
    joint = cells.join(rows, x).join(columns, y).join(F.broadcast(total))
    return joint.agg(F.sum(F.col("n") / F.col("m") * F.log(F.col("n") * F.col("m") / (F.col("nx") * F.col("ny")))).alias("mi"))


def adjust_p_values(df: DataFrame, p: str, family: str, m: int | None = None) -> DataFrame:
    """Benjamini-Hochberg and Bonferroni adjusted values within each family; null p counts as 1 and not among the tests."""
    clean = df.withColumn("_p", F.when(F.isnan(p), None).otherwise(F.col(p)))
    w = Window.partitionBy(family)
    ranked = clean.withColumn("_m", F.count("_p").over(w)).withColumn("_r", F.rank().over(w.orderBy(F.col("_p").asc_nulls_last())))
    raw = F.when(F.col("_p").isNotNull(), F.col("_p") * F.col("_m") / F.col("_r"))
    step_up = F.min(raw).over(w.orderBy(F.col("_r").desc()).rangeBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("p_bh", F.coalesce(F.least(step_up, F.lit(1.0)), F.lit(1.0))).withColumn("p_bonferroni", F.coalesce(F.least(F.col("_p") * F.col("_m"), F.lit(1.0)), F.lit(1.0))).drop("_p", "_m", "_r")


def baskets(items: DataFrame) -> DataFrame:
    """The sorted items of each step as one array: t, xs."""
    return items.groupBy("t").agg(F.sort_array(F.collect_set("item")).alias("xs"))


def ks_exponential(df: DataFrame, key: str, value: str, mean: float) -> DataFrame:
    """Per key the largest distance of the shares up to a value from an exponential's, on both sides of each step: n, d."""
    cells = df.groupBy(key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    upto, m = F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), F.sum("n").over(w)
    f = 1 - F.exp(-F.col(value) / mean)
    return cells.select(key, m.alias("n"), F.greatest(F.abs(upto / m - f), F.abs((upto - F.col("n")) / m - f)).alias("d")).groupBy(key).agg(F.max("n").alias("n"), F.max("d").alias("d"))


def ks_two_sample(left: DataFrame, right: DataFrame, value: str, n: str, m: str) -> DataFrame:
    """Largest distance between two cumulative histograms over the same bounded set of values: n, m, d."""
    both = left.join(right, value, "full").na.fill(0, [n, m])
    upto, whole = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    far = F.abs(F.sum(n).over(upto) / F.sum(n).over(whole) - F.sum(m).over(upto) / F.sum(m).over(whole))
    return both.select(F.sum(n).over(whole).alias("n"), F.sum(m).over(whole).alias("m"), far.alias("d")).agg(F.max("n").alias("n"), F.max("m").alias("m"), F.max("d").alias("d"))
