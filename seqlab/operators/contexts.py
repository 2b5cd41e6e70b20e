"""Windows of steps: basket statistics over the last steps, what came before, split and live windows, events of a step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import pinned
from .features import recent_uses
from .items import baskets
from .series import over_chunks


def every_step(spark, items: DataFrame, steps: int) -> DataFrame:
    """t, xs of all steps; a step without items has an empty basket."""
    return spark.range(steps).select(F.col("id").alias("t")).join(baskets(items), "t", "left").withColumn("xs", F.coalesce("xs", F.array().cast("array<int>")))


def rolling_basket_stats(steps: DataFrame, domain: range, n: int) -> DataFrame:
    """Over the last n steps, this one included, of (t, xs): chi-square, entropy in bits and variance of the items' counts."""

    def make(w):
        upto = w.rowsBetween(-n + 1, 0)
        counts = F.array(*(F.sum(F.array_contains("xs", k).cast("int")).over(upto) for k in domain))
        return {"_counts": counts}

    rows = over_chunks(steps, make, n - 1)
    total = F.aggregate("_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumn("_m", total / len(domain)).withColumn("_sq", F.aggregate("_counts", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m"))))
    share = F.transform("_counts", lambda x: F.try_divide(x, F.col("_m") * len(domain)))
    bits = F.aggregate(share, F.lit(0.0), lambda a, p: a + F.when(p > 0, -p * F.log2(p)).otherwise(0.0))
    return rows.select("t", F.coalesce(F.try_divide("_sq", "_m"), F.lit(0.0)).alias("chi2"), bits.alias("entropy"), (F.col("_sq") / len(domain)).alias("variance"))


def previous_context(steps: DataFrame) -> DataFrame:
    """Of the step before in (t, xs): total, range, odd count, and whether its range was the largest so far; zeros in the first step.

    The largest so far is carried over chunks.
    """
    made = steps.select("t", F.aggregate("xs", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.coalesce(F.array_max("xs") - F.array_min("xs"), F.lit(0)).alias("range"), F.size(F.filter("xs", lambda x: x % 2 == 1)).alias("odd"))
    rows = pinned(made.withColumn("_chunk", F.floor(F.col("t") / 4096)))
    ends = rows.groupBy("_chunk").agg(F.max("range").alias("_top"))
    carried = ends.select("_chunk", F.max("_top").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # one row a chunk
    top = F.greatest(F.max("range").over(Window.partitionBy("_chunk").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.col("_before"))
    marked = rows.join(carried, "_chunk").withColumn("record", (F.col("range") > F.coalesce(top, F.lit(-1))).cast("int")).drop("_chunk", "_before")
    return over_chunks(marked, lambda w: {f"prev_{c}": F.coalesce(F.lag(c, 1).over(w), F.lit(0)) for c in ("total", "range", "odd", "record")}, 1).select("t", "prev_total", "prev_range", "prev_odd", "prev_record")


def step_events(items: DataFrame, steps: DataFrame, domain: int, n: int = 20) -> DataFrame:
    """Event tokens of each step: hot_<i> and cold_<i> items (1.5 times, or half, the uses that n steps would give by chance), the quarter of the total, wide or narrow range, odd_heavy or even_heavy.

    Items are compared by their uses before the step; quarters and medians are those of all steps.
    """
    mean = items.agg(F.count("*").alias("_all")).join(steps.agg(F.count("*").alias("_steps")))
    used = recent_uses(items, [n]).join(F.broadcast(mean)).withColumn("_expected", n * F.col("_all") / F.col("_steps") / domain)
    hot = used.select("t", F.when(F.col(f"f_{n}") >= 1.5 * F.col("_expected"), F.concat(F.lit("hot_"), "item")).when(F.col(f"f_{n}") <= 0.5 * F.col("_expected"), F.concat(F.lit("cold_"), "item")).alias("event"))
    total, spread, odd = F.aggregate("xs", F.lit(0).cast("long"), lambda a, x: a + x), F.array_max("xs") - F.array_min("xs"), F.size(F.filter("xs", lambda x: x % 2 == 1))
    each = steps.where(F.size("xs") > 0).select("t", total.alias("total"), spread.alias("spread"), (odd / F.size("xs")).alias("odd"))
    cuts = each.agg(F.expr("percentile(total, array(0.25, 0.5, 0.75))").alias("q"), F.expr("percentile(spread, 0.5)").alias("middle"))
    quarter = 1 + F.size(F.filter("q", lambda x: F.col("total") > x))
    tokens = F.array(F.concat(F.lit("sum_q"), quarter.cast("string")), F.when(F.col("spread") > F.col("middle"), "wide").otherwise("narrow"), F.when(F.col("odd") > 0.5, "odd_heavy").when(F.col("odd") < 0.5, "even_heavy"))
    return hot.where("event is not null").unionByName(each.join(F.broadcast(cuts)).select("t", F.explode(tokens).alias("event")).where("event is not null"))


def split_windows(rows: DataFrame, cuts: list[int], width: int, ahead: int) -> DataFrame:
    """t, split of the rows that have width rows before and ahead rows after them in the table; split is null where those after cross a cut.

    Rows without a split are to be dropped; split_counts() says how many.
    """
    n = rows.agg(F.max("t").alias("_last"))

    def split(t: Column) -> Column:
        out = F.lit(0)
        for c in cuts:
            out = out + (t >= c).cast("int")
        return out

    inside = rows.select("t").join(F.broadcast(n)).where((F.col("t") >= width) & (F.col("t") + ahead <= F.col("_last")))
    return inside.select("t", F.when(split(F.col("t")) == split(F.col("t") + ahead), split(F.col("t"))).alias("split"))


def split_counts(windows: DataFrame) -> DataFrame:
    """Per split the rows kept, and those dropped at a cut under a null split."""
    return windows.groupBy("split").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))


def live_windows(history: DataFrame, live: DataFrame, columns: list[str], width: int) -> DataFrame:
    """t, context of each live row: the width rows before it, from the end of history and from live itself.

    Only the last width rows of history are read on.
    """
    first = live.agg(F.min("t").alias("_first"))
    tail = history.join(F.broadcast(first)).where((F.col("t") >= F.col("_first") - width) & (F.col("t") < F.col("_first"))).select("t", *columns, F.lit(False).alias("_live"))
    both = tail.unionByName(live.select("t", *columns, F.lit(True).alias("_live")))
    made = over_chunks(both, lambda w: {"context": F.collect_list(F.struct(*columns)).over(w.rowsBetween(-width, -1))}, width)
    return made.where(F.col("_live") & (F.size("context") == width)).select("t", "context")
