"""Features that are fitted on some rows and applied to others, and features of keys on a grid of steps."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import normal_quantile
from ..storage import pinned
from .series import earlier, neighbours, over_chunks


def interactions(head: list[str], tail: list[str], ratios: bool = False, bound: float = 1e6) -> dict[str, Column]:
    """Products (and ratios) of each head with each tail column; what is no number is 0, and all is held within bound."""

    def clean(c):
        return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(F.greatest(F.least(c, F.lit(bound)), F.lit(-bound)))

    out = {f"{a}_x_{b}": clean((F.col(a) * F.col(b)).cast("double")) for a in head for b in tail}
    if ratios:
        out |= {f"{a}_over_{b}": clean(F.col(a) / (F.col(b) + 1e-6)) for a in head for b in tail}
    return out


def polynomial_by_variance(df: DataFrame, columns: list[str], degree: int, k: int) -> list[str]:
    """The k terms up to degree with the largest population variance, as expressions; one pass over the rows."""
    terms = [" * ".join(f"cast({c} as double)" for c in x) for n in range(2, degree + 1) for x in combinations_with_replacement(columns, n)]
    row = df.agg(*(F.var_pop(F.expr(t)).alias(f"v{i}") for i, t in enumerate(terms))).first()  # one row of a bounded number of terms
    order = sorted(range(len(terms)), key=lambda i: (-(row[i] or 0.0), i))
    return [terms[i] for i in order[:k]]


def scale(df: DataFrame, fit: DataFrame, columns: list[str], method: str = "standard") -> DataFrame:
    """Columns centred and scaled by the moments or quantiles of fit: standard, robust or minmax; a spread of 0 counts as 1."""

    def parts(c):
        if method == "standard":
            return F.avg(c), F.stddev_pop(c)
        if method == "robust":
            return F.expr(f"percentile({c}, 0.5)"), F.expr(f"percentile({c}, 0.75) - percentile({c}, 0.25)")
        return F.min(c), F.max(c) - F.min(c)

    made = fit.agg(*(p.cast("double").alias(f"_{n}_{c}") for c in columns for n, p in zip(("at", "by"), parts(c))))
    by = {c: F.when(F.col(f"_by_{c}") > 0, F.col(f"_by_{c}")).otherwise(1.0) for c in columns}
    return df.join(F.broadcast(made)).withColumns({c: (F.col(c) - F.col(f"_at_{c}")) / by[c] for c in columns}).drop(*made.columns)


def to_normal(df: DataFrame, fit: DataFrame, columns: list[str], quantiles: int = 100, clip: float = 1e-7) -> DataFrame:
    """Columns mapped to a standard normal by the quantiles of fit: the share of a value between quantiles 0 .. quantiles, within clip of 0 and 1.

    Between two quantiles shares are linear; a value that several quantiles have takes the middle of their shares. Null
    stays null. The table is one row of quantiles + 1 numbers for each column.
    """
    at = [k / quantiles for k in range(quantiles + 1)]
    table = fit.agg(*(F.percentile(F.col(c).cast("double"), F.lit(at)).alias(f"_q_{c}") for c in columns))

    def places(c):
        q, x = F.col(f"_q_{c}"), F.col(c).cast("double")
        return {f"_b_{c}": F.size(F.filter(q, lambda v: v < x)), f"_u_{c}": F.size(F.filter(q, lambda v: v <= x))}

    def share(c):
        q, x, below, upto = F.col(f"_q_{c}"), F.col(c).cast("double"), F.col(f"_b_{c}"), F.col(f"_u_{c}")
        low, high = F.get(q, below - 1), F.get(q, below)
        between = (below - 1 + (x - low) / (high - low)) / quantiles
        return F.when(x.isNull(), None).when(upto > below, (below + upto - 1) / (2.0 * quantiles)).when(below == 0, 0.0).when(below > quantiles, 1.0).otherwise(between)

    rows = df.join(F.broadcast(table)).withColumns({k: v for c in columns for k, v in places(c).items()})
    rows = rows.withColumns({f"_p_{c}": F.greatest(F.lit(clip), F.least(share(c), F.lit(1 - clip))) for c in columns})
    made = rows.withColumns({c: F.when(F.col(c).isNotNull(), normal_quantile(F.col(f"_p_{c}"))) for c in columns})
    return made.drop(*table.columns, *(f"_{k}_{c}" for k in "bup" for c in columns))


def seasonal_detrend(df: DataFrame, fit: DataFrame, day: str, columns: list[str], reach: int = 7) -> DataFrame:
    """Columns minus the mean of fit on the day of the year, smoothed over reach days on both sides around the year.

    A day of the year that fit lacks takes the mean of all its days.
    """
    days = fit.groupBy(F.dayofyear(day).alias("_doy")).agg(*(F.avg(c).alias(c) for c in columns))
    near = days.select("*", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_s")).withColumn("_doy", F.pmod(F.col("_doy") + F.col("_s") - 1, F.lit(366)) + 1)
    smooth = near.groupBy("_doy").agg(*(F.avg(c).alias(f"_b_{c}") for c in columns))
    whole = days.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns))
    out = df.withColumn("_doy", F.dayofyear(day)).join(F.broadcast(smooth), "_doy", "left").join(F.broadcast(whole))
    return out.withColumns({c: F.col(c) - F.coalesce(f"_b_{c}", f"_m_{c}") for c in columns}).drop("_doy", *(f"_{k}_{c}" for k in "bm" for c in columns))


def linear_detrend(df: DataFrame, columns: list[str], t: str = "t", critical: float = 1.96) -> DataFrame:
    """Columns minus their trend over t where its t value is beyond critical, centred on their mean; else as they are."""
    stats = []
    for c in columns:
        r2, n = F.regr_r2(c, t), F.regr_count(c, t)
        stats += [F.regr_slope(c, t).alias(f"_s_{c}"), F.sqrt(F.try_divide(r2 * (n - 2), 1 - r2)).alias(f"_t_{c}"), F.regr_avgx(c, t).alias(f"_x_{c}")]
    fit = df.agg(*stats)
    return df.join(F.broadcast(fit)).withColumns({c: F.when(F.col(f"_t_{c}") > critical, F.col(c) - F.col(f"_s_{c}") * (F.col(t) - F.col(f"_x_{c}"))).otherwise(F.col(c)) for c in columns}).drop(*fit.columns)


def decayed_frequency(df: DataFrame, column: str, symbols: int, rate: float, reach: int, chunk: int = 4096) -> DataFrame:
    """Shares of each symbol before this row, weighted by exp(-rate * age) over reach rows: p_<column> (uniform in the first row).

    Weights grow with the place inside a chunk, so sums over a chunk need no second pass and stay finite.
    """
    size = max(chunk, reach)
    weight = F.exp(rate * (F.col("t") % size - F.when(F.floor(F.col("t") / size) < F.col("_chunk"), F.lit(size)).otherwise(F.lit(0))))

    def make(w):
        before = w.rowsBetween(-reach, -1)
        sums = [F.coalesce(F.sum(F.when(F.col(column) == s, weight).otherwise(0.0)).over(before), F.lit(0.0)) for s in range(symbols)]
        total = F.sum(weight).over(before)
        return {f"p_{column}": F.array(*(F.coalesce(x / total, F.lit(1.0 / symbols)) for x in sums))}

    return over_chunks(df, make, reach, size)


def decayed_history(df: DataFrame, column: str, symbols: int, rate: float, chunk: int = 4096) -> DataFrame:
    """As decayed_frequency(), over all rows before this one.

    Each chunk sums its rows, weighted as seen from its end; a later chunk takes the sums of those before it, each scaled
    down by its distance. These are running sums over blocks of chunks, in which a weight falls by e^40: a block reads
    itself and the one before, and what is older would not change a double. So no task holds more than two blocks of
    chunk sums, and weights neither overflow nor vanish inside a block.
    """
    size = max(1, min(chunk, int(40 / rate))) if rate > 0 else chunk
    fall = rate * size
    rows = df.withColumn("_chunk", F.floor(F.col("t") / size))
    place = F.col("t") - F.col("_chunk") * size
    own = [F.when(F.col(column) == s, F.exp(rate * (place - size))).otherwise(0.0) for s in range(symbols)]
    ends = rows.groupBy("_chunk").agg(*(F.sum(x).alias(f"_{i}") for i, x in enumerate(own)))
    carried = carried_sums(ends, symbols, fall)
    inside = Window.partitionBy("_chunk").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    here = [F.coalesce(F.sum(x).over(inside), F.lit(0.0)) for x in own]
    # weights of this chunk are seen from its end, the past from its beginning
    both = F.array(*(h + F.element_at("_past", i + 1) * F.exp(F.lit(-fall)) for i, h in enumerate(here)))
    total = F.aggregate("_both", F.lit(0.0), lambda a, x: a + x)
    held = rows.join(carried, "_chunk").withColumn("_both", both).withColumn("_total", total)
    shares = F.when(F.col("_total") > 0, F.transform("_both", lambda x: x / F.col("_total"))).otherwise(F.array(*[F.lit(1.0 / symbols)] * symbols))
    return held.withColumn(f"p_{column}", shares).drop("_chunk", "_past", "_both", "_total")


def carried_sums(ends: DataFrame, n: int, fall: float) -> DataFrame:
    """_chunk, _past: the n sums _0, _1, ... of all chunks before, as seen from a chunk's begin, each falling by e^-fall a chunk."""
    block = max(1, math.ceil(40 / fall)) if fall > 0 else 1 << 40
    mine = F.floor(F.col("_chunk") / block)
    copies = ends.withColumn("_own", mine).withColumn("_block", F.explode(F.array(mine, mine + 1)))
    off = F.col("_chunk") - F.col("_block") * block  # in chunks, from the begin of the block
    before = Window.partitionBy("_block").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    past = [F.coalesce(F.sum(F.col(f"_{i}") * F.exp(fall * off)).over(before), F.lit(0.0)) * F.exp(-fall * (off - 1)) for i in range(n)]
    return copies.select("_chunk", "_own", "_block", F.array(*past).alias("_past")).where("_own = _block").select("_chunk", "_past")


def rolling_gap_stats(items: DataFrame, sizes: list[int]) -> DataFrame:
    """At each hit, statistics of the item's last n completed gaps, this one included: mean, spread, least and most.

    Hits of an item are numbered, and runs of numbers are windows of their own, so no item is one task.
    """
    near = neighbours(items, ["item"]).where("was is not null").select("item", "t", (F.col("t") - F.col("was")).alias("gap"))
    gaps = earlier(pinned(near), ["item"]).withColumnRenamed("uses", "hit")

    def make(w):
        made = {}
        for n in sizes:
            last = w.rowsBetween(-n + 1, 0)
            made |= {f"mean_{n}": F.avg("gap").over(last), f"sd_{n}": F.stddev_pop("gap").over(last), f"least_{n}": F.min("gap").over(last), f"most_{n}": F.max("gap").over(last)}
        return made

    return over_chunks(gaps, make, max(sizes), t="hit", keys=("item",)).drop("hit", "gap")


def recent_uses(items: DataFrame, sizes: list[int]) -> DataFrame:
    """At each hit, in how many of the n steps before it the item came: f_<n>."""
    return over_chunks(items.select("item", "t"), lambda w: {f"f_{n}": F.count("*").over(w.rangeBetween(-n, -1)) for n in sizes}, max(sizes), chunk=1 << 16, keys=("item",))


def partner_presence(items: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Per (t, item) how many of the item's k most frequent partners (a, b, n) came in the step before; only where there are any."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    top = both.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).where(F.col("_r") <= k)
    before = items.select((F.col("t") + 1).alias("t"), F.col("item").alias("b"))
    return before.join(top.select(F.col("a").alias("item"), "b"), "b").groupBy("t", "item").agg(F.count("*").alias("partners"))


def run_state(items: DataFrame) -> DataFrame:
    """Islands of consecutive steps in which an item came: item, start, length and the absence before it.

    The k-th start of an item belongs to its k-th end; both are numbered by ranges.
    """
    near = pinned(neighbours(items, ["item"]))
    starts = earlier(near.where("was is null or was < t - 1"), ["item"]).select("item", "uses", F.col("t").alias("start"), (F.col("t") - F.col("was") - 1).alias("absence"))
    ends = earlier(near.where("next is null or next > t + 1"), ["item"]).select("item", "uses", F.col("t").alias("end"))
    return starts.join(ends, ["item", "uses"]).select("item", "start", (F.col("end") - F.col("start") + 1).alias("length"), "absence")
