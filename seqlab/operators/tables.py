"""Rows of tables: filters, keys, look-ups, sets, orders and aggregates over any columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profile(df: DataFrame, column: str) -> DataFrame:
    """One row: n, first and last of a column."""
    return df.agg(F.count("*").alias("n"), F.min(column).alias("first"), F.max(column).alias("last"))


def between(df: DataFrame, column: str, low: Column, high: Column) -> DataFrame:
    """Rows with low <= column < high, as comparisons that reach the scan."""
    return df.where((F.col(column) >= low) & (F.col(column) < high))


def missing_days(df: DataFrame, day: str) -> DataFrame:
    """Days between the first and the last of a date column that no row has."""
    days = df.select(day).distinct()
    calendar = days.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias(day))
    return calendar.join(days, day, "left_anti")


def complete_groups(df: DataFrame, keys: list[str], member: str, n: int) -> DataFrame:
    """Rows of the groups in which a column has n different values."""
    whole = df.groupBy(*keys).agg(F.count_distinct(member).alias("_n")).where(F.col("_n") == n).select(*keys)
    return df.join(whole, keys, "left_semi")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the row that is last by the columns order, of which ties are equal: keys and order."""
    return df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_x")).select(*keys, "_x.*")


def keep_first(df: DataFrame, keys: list[str], t: str, columns: list[str]) -> DataFrame:
    """Per key the columns of the row with the smallest t, and t."""
    return df.groupBy(*keys).agg(*(F.min_by(c, t).alias(c) for c in columns), F.min(t).alias(t))


def first_flagged(flags: list[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first flag that holds, else the default."""
    out = F
    for flag, value in flags:
        out = out.when(flag, value)
    return out.otherwise(default)


def match_counts(left: DataFrame, right: DataFrame, key: str, other: str, name: str = "n") -> DataFrame:
    """Per key of left how many rows of right have it, 0 included. Right is counted before it moves."""
    counts = right.groupBy(F.col(other).alias(key)).agg(F.count("*").alias(name))
    return left.groupBy(key).agg(F.count("*").alias("_rows")).join(counts, key, "left").select(key, (F.coalesce(name, F.lit(0)) * F.col("_rows")).alias(name))


def later(df: DataFrame, column: str, steps: int, name: str = "later", t: str = "t") -> DataFrame:
    """t, the column, and its value so many steps on, where there is one."""
    return df.select(t, column).join(df.select((F.col(t) - steps).alias(t), F.col(column).alias(name)), t)


def only_new(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys known lacks."""
    return df.join(known.select(*keys), keys, "left_anti")


def stacked(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows of tables of the same columns, with the source each is from."""
    parts = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def common_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Different rows that both have."""
    return a.intersect(b)


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of a total order; a report, so n is small."""
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "r") -> DataFrame:
    """The first k rows of each group and their place. Each task keeps k rows of a group before they move."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group n, mean, sd (of a sample), lo and hi of a column."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def distinct_counts(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row: how many different values each column has, by the names given."""
    return df.agg(*(F.count_distinct(c).alias(n) for n, c in columns.items()))


def value_counts(df: DataFrame, columns: list[str], mark: str = "|") -> DataFrame:
    """key, n: how often each combination of columns occurs, joined by a mark."""
    return df.groupBy(F.concat_ws(mark, *columns).alias("key")).agg(F.count("*").alias("n"))


def group_ordinals(df: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Adds first_t of a row's group and seen, how many rows of the group come before it; groups are small (a day's)."""
    group = Window.partitionBy(*keys)
    return df.withColumns({"first_t": F.min(t).over(group), "seen": F.row_number().over(group.orderBy(t)) - 1})


def time_split(t: Column, n: int, shares: dict[str, float], rest: str) -> Column:
    """The name of the part of n steps that t is in: the shares end where given, the rest follows."""
    out = F
    for name, end in shares.items():
        out = out.when(t < end * n, name)
    return out.otherwise(rest)


def percentiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Per group the exact percentiles of a column, interpolated."""
    return df.groupBy(*keys).agg(*(F.percentile(value, F.lit(p)).alias(n) for n, p in at.items()))


def seeded_subset(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows drawn by the hash of seed and key; the same whatever the partitions."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a place on a circle."""
    angle = 2 * math.pi * x / period
    return F.sin(angle), F.cos(angle)


def box_key(digits: list[str]) -> Column:
    """Digits in ascending order as one text, the same for all their orders."""
    return F.concat_ws("", F.array_sort(F.array(*digits)).cast("array<string>"))


def orbit(digits: list[str]) -> Column:
    """How many different orders three digits have: 6, 3 or 1."""
    k = F.size(F.array_distinct(F.array(*digits)))
    return F.when(k == 3, 6).when(k == 2, 3).otherwise(1)
