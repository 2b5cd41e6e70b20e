"""Tests of randomness: one row for each tested key, with statistic and p, and their summary.

Reference distributions are exact where they are closed, else baskets drawn by a hash that both engines can compute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tails
from .items import item_frequency, ks_two_sample


def _chi(counts: DataFrame, family: list[str], expected: Column, df: int) -> DataFrame:
    """counts (family, ..., n) with part, and the family's chi2 and p."""
    parts = counts.withColumn("part", (F.col("n") - expected) ** 2 / expected)
    sums = parts.groupBy(*family).agg(F.sum("part").alias("chi2")) if family else parts.agg(F.sum("part").alias("chi2"))
    out = parts.join(F.broadcast(sums), family) if family else parts.join(F.broadcast(sums))  # one row for each family
    return out.withColumn("p", tails.chi_square(F.col("chi2"), df))


def frequency_test(items: DataFrame, steps: int, domain: int, outlier: float = 2.5) -> DataFrame:
    """Per item its count, z, p and whether it is an outlier, and chi-square and p of all items against equal chances."""
    each = item_frequency(items, steps, domain)
    whole = each.agg(F.sum("chi2_part").alias("chi2"))
    return each.join(F.broadcast(whole)).select(
        "item", "n", "z", tails.normal_two_sided(F.col("z")).alias("p"), (F.abs("z") > outlier).alias("outlier"), "chi2_part", "chi2", tails.chi_square(F.col("chi2"), domain - 1).alias("chi2_p")
    )


def position_bias(df: DataFrame, columns: list[str], symbols: int) -> DataFrame:
    """Per position chi-square of its symbols against equal chances, p, and the mean symbol."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("pos"), F.col(c).alias("symbol")) for c in columns))).alias("x")
    counts = df.select(each).groupBy("x.pos", "x.symbol").agg(F.count("*").alias("n"))
    m = F.sum("n")
    chi = F.sum(F.col("n") * F.col("n")) * symbols / m - m
    out = counts.groupBy("pos").agg(m.alias("n"), chi.alias("chi2"), (F.sum(F.col("symbol") * F.col("n")) / m).alias("mean"))
    return out.withColumn("p", tails.chi_square(F.col("chi2"), symbols - 1))


def with_ks_p(rows: DataFrame, n: Column, tests: int = 1) -> DataFrame:
    """rows with d, and p and its Bonferroni value for effective size n."""
    return rows.withColumn("p", tails.kolmogorov(F.col("d"), n)).withColumn("p_bonferroni", F.least(F.col("p") * tests, F.lit(1.0)))


def binomial_counts(df: DataFrame, kinds: dict[str, Column], trials: int) -> DataFrame:
    """Per kind and count of successes out of trials at one half: n, expected, part, and the kind's chi2 and p."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.cast("int").alias("k")) for k, v in kinds.items()))).alias("x")
    counts = df.select(each).groupBy("x.kind", "x.k").agg(F.count("*").alias("n"))
    choose = [1]
    for i in range(trials):
        choose.append(choose[-1] * (trials - i) // (i + 1))
    shares = F.element_at(F.array(*(F.lit(c / 2**trials) for c in choose)), F.col("k") + 1)
    whole = counts.groupBy("kind").agg(F.sum("n").alias("_m"))
    counts = counts.join(F.broadcast(whole), "kind").withColumn("expected", shares * F.col("_m")).drop("_m")
    return _chi(counts, ["kind"], F.col("expected"), trials)


def last_digit(items: DataFrame, domain: DataFrame) -> DataFrame:
    """Counts of each last digit against the share of the domain (item) that ends in it: n, expected, part, chi2, p."""
    size = domain.count()  # a bounded list of items
    shares = domain.groupBy((F.col("item") % 10).alias("digit")).agg((F.count("*") / size).alias("_share"))
    counts = items.groupBy((F.col("item") % 10).alias("digit")).agg(F.count("*").alias("n"))
    both = shares.join(counts, "digit", "left").na.fill(0, ["n"]).join(F.broadcast(items.agg(F.count("*").alias("_m"))))
    return _chi(both.withColumn("expected", F.col("_share") * F.col("_m")).drop("_share", "_m"), [], F.col("expected"), 9)


def drawn_baskets(baskets: DataFrame, domain: int, seed: int = 7) -> DataFrame:
    """t, xs: for each basket (t, xs) one of its size out of items 1 .. domain, without replacement, by a hash of t and item."""
    every = F.transform(F.sequence(F.lit(1), F.lit(domain)), lambda x: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("t").cast("string"), x.cast("string"))).alias("h"), x.alias("item")))
    return baskets.select("t", F.array_sort(F.transform(F.slice(F.array_sort(every), 1, F.size("xs")), lambda x: x["item"])).alias("xs"))


def adjacent_pairs(xs: Column) -> Column:
    """How many items of a basket are followed by the next number."""
    return F.size(F.filter(xs, lambda x: F.array_contains(xs, x + 1)))


def spread(xs: Column) -> Column:
    return F.array_max(xs) - F.array_min(xs)


def mean_spacing(xs: Column) -> Column:
    return F.round(F.try_divide(spread(xs), F.size(xs) - 1), 6)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.round(F.try_divide(both, F.size(a) + F.size(b) - both), 6)


def against_drawn(real: DataFrame, drawn: DataFrame, value: Column, name: str) -> DataFrame:
    """Two-sample KS of a value of baskets against the same of drawn ones: test, n, m, d, p."""
    left = real.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    right = drawn.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("m"))
    out = ks_two_sample(left, right, "v", "n", "m")
    return out.select(F.lit(name).alias("test"), "n", "m", "d", tails.kolmogorov(F.col("d"), F.col("n") * F.col("m") / (F.col("n") + F.col("m"))).alias("p"))


def paired(baskets: DataFrame) -> DataFrame:
    """Each basket with that of the next step: t, xs, ys."""
    return baskets.join(baskets.select((F.col("t") - 1).alias("t"), F.col("xs").alias("ys")), "t")


def repeat_counts(baskets: DataFrame, domain: int) -> DataFrame:
    """How often so many items come again in the next step, against the hypergeometric of the two sizes: shared, n, expected.

    Sizes are few, so the expectation is summed over pairs of sizes, not of baskets.
    """
    both = paired(baskets).select(F.size("xs").alias("a"), F.size("ys").alias("b"), F.size(F.array_intersect("xs", "ys")).alias("shared"))
    seen = both.groupBy("shared").agg(F.count("*").alias("n"))
    sizes = both.groupBy("a", "b").agg(F.count("*").alias("m")).select("a", "b", "m", F.explode(F.sequence(F.greatest(F.lit(0), F.col("a") + F.col("b") - domain), F.least("a", "b"))).alias("shared"))
    chance = tails.hypergeometric(F.col("shared"), F.col("b"), F.col("a"), F.lit(domain))
    expected = sizes.groupBy("shared").agg(F.sum(F.col("m") * chance).alias("expected"))
    return expected.join(seen, "shared", "left").na.fill(0, ["n"]).select("shared", "n", "expected")


def trend_p(rows: DataFrame) -> DataFrame:
    """rows with n and r, and p of the slope by the normal tail (n is large)."""
    return rows.withColumn("p", tails.normal_two_sided(F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))))


def findings(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Tests (test, key, stat, p) with p below alpha, in bands of severity: strong below 0.001, clear below 0.01, else weak."""
    band = F.when(F.col("p") < 0.001, "strong").when(F.col("p") < 0.01, "clear").otherwise("weak")
    return tests.where(F.col("p") < alpha).select("test", "key", "stat", "p", band.alias("severity"))


def summary(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per test: how many keys, how many below alpha, and how many of those chance alone would give."""
    return tests.groupBy("test").agg(F.count("*").alias("n"), F.count_if(F.col("p") < alpha).alias("found"), (F.count("*") * alpha).alias("by_chance"), F.min("p").alias("least"))


