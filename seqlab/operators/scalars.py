"""Column functions of a row: digit codes, shapes of baskets, calendars, guarded arithmetic, sets, fingerprints and slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of the token table below those of real values.
PAD, MASK, UNKNOWN, FIRST = 0, 1, 2, 3


def digits_of(code: Column, n: int) -> list[Column]:
    """The n decimal digits of a code, the first one leading."""
    return [(F.floor(code / 10 ** (n - 1 - i)) % 10).cast("int") for i in range(n)]


def code_of(digits: list[Column]) -> Column:
    out = digits[0].cast("long")
    for d in digits[1:]:
        out = out * 10 + d
    return out


def label_of(code: Column, n: int) -> Column:
    """The code with leading zeros."""
    return F.lpad(code.cast("string"), n, "0")


def basket_shape(xs: Column, high: int) -> dict[str, Column]:
    """Of a sorted array of different numbers: size, total, mean, sample spread, range, odd and high counts and shares, adjacent pairs, largest spacing, last digits."""
    n, total = F.size(xs), F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    mean = total / n
    squares = F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    spacings = F.zip_with(F.slice(xs, 2, F.greatest(n - 1, F.lit(0))), F.slice(xs, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)
    odd, many = F.size(F.filter(xs, lambda x: x % 2 == 1)), F.size(F.filter(xs, lambda x: x >= high))
    return {
        "size": n, "total": total, "mean": mean, "sd": F.when(n > 1, F.sqrt(squares / (n - 1))), "range": F.array_max(xs) - F.array_min(xs), "odd": odd, "odd_share": odd / n, "high": many,
        "high_share": many / n, "adjacent": F.size(F.filter(spacings, lambda x: x == 1)), "widest": F.array_max(spacings), "last_digits": F.size(F.array_distinct(F.transform(xs, lambda x: x % 10))),
    }


def calendar(day: Column, first: Column) -> dict[str, Column]:
    """Day of the week (Monday 0) and its name, month, year, day of the year, days since first."""
    return {"dow": F.weekday(day), "name": F.dayname(day), "month": F.month(day), "year": F.year(day), "doy": F.dayofyear(day), "since": F.datediff(day, first)}


def celsius(fahrenheit: Column) -> Column:
    return (fahrenheit - 32) * 5 / 9


def above_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds above_<column>: whether a value is over its column's median; null for null."""
    made = df.agg(*(F.expr(f"percentile({c}, 0.5)").alias(f"_m_{c}") for c in columns))
    return df.join(F.broadcast(made)).withColumns({f"above_{c}": F.col(c) > F.col(f"_m_{c}") for c in columns}).drop(*made.columns)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def safe_log(x: Column, floor: float = 1e-15) -> Column:
    return F.log(F.greatest(x, F.lit(floor)))


def finite(x: Column, bound: float = 1e6) -> Column:
    """x with what is no number as 0, held within bound."""
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(clip(x, -bound, bound))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, floor: float = 1e-10) -> Column:
    held = clip(p, floor, 1 - floor)
    return F.log(held / (1 - held))


def softmax(xs: Column) -> Column:
    """Shares of exp, taken from the largest, so that nothing overflows."""
    powers = F.transform(xs, lambda x: F.exp(x - F.array_max(xs)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def decay(age: Column, rate: float) -> Column:
    return F.exp(-rate * age)


def overlap(a: Column, b: Column) -> dict[str, Column]:
    """Sizes of intersection and union of two arrays, their Jaccard similarity (null if both are empty), and whether a holds all of b."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return {"both": both, "either": either, "jaccard": F.try_divide(both, either), "holds": F.size(F.array_except(b, a)) == 0}


def fingerprint(names: Column, ordered: bool = False) -> Column:
    """One string for a list of names: in their order, or sorted if it does not matter."""
    return F.concat_ws("+", names if ordered else F.array_sort(names))


def next_slot(now: Column, slots: list[str], rest_days: tuple[int, ...] = (6,)) -> Column:
    """The first time of day in slots (HH:mm) after now on a day that is none of the rest days (Monday 0)."""
    day = F.to_date(now)
    minutes = [int(x[:2]) * 60 + int(x[3:]) for x in sorted(slots)]
    at = now.cast("timestamp_ntz")
    times = [(F.date_add(day, k), F.date_add(day, k).cast("timestamp_ntz") + F.expr(f"INTERVAL {m} MINUTES")) for k in range(len(rest_days) + 2) for m in minutes]
    return F.coalesce(*(F.when((t > at) & ~F.weekday(d).isin(*rest_days), t) for d, t in times))


def calendar_slots(spark, first: str, last: str, slots: list[str], rest_days: tuple[int, ...] = (6,)) -> DataFrame:
    """day, slot of every slot from first to last day, without rest days."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    return days.where(~F.weekday("day").isin(*rest_days)).select("day", F.explode(F.array(*map(F.lit, slots))).alias("slot"))


def build_vocabulary(df: DataFrame, columns: list[str]) -> DataFrame:
    """kind, value, id of the distinct values of some columns, numbered in their order within a kind; vocabularies are small."""
    from pyspark.sql import Window

    each = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")
    known = df.select(each).select("x.*").where("value is not null").distinct()
    return known.withColumn("id", F.row_number().over(Window.partitionBy("kind").orderBy("value")) + (FIRST - 1))


def tokenize(df: DataFrame, vocabulary: DataFrame, columns: list[str], digits: list[str], symbols: int = 10) -> DataFrame:
    """Adds token_<column>: an id of the vocabulary (unknown for null and new values), or for digits their value and an offset.

    A digit outside 0 .. symbols - 1 is an error.
    """
    out = df
    for c in columns:
        ids = vocabulary.where(F.col("kind") == c).select(F.col("value").alias(f"_v_{c}"), F.col("id").alias(f"token_{c}"))
        out = out.join(F.broadcast(ids), F.col(c).cast("string") == F.col(f"_v_{c}"), "left").withColumn(f"token_{c}", F.coalesce(f"token_{c}", F.lit(UNKNOWN))).drop(f"_v_{c}")
    for c in digits:
        wrong = F.raise_error(F.concat(F.lit(f"{c} is no symbol: "), F.col(c).cast("string"))).cast("int")
        out = out.withColumn(f"token_{c}", F.when(F.col(c).isNull(), UNKNOWN).when(F.col(c).between(0, symbols - 1), F.col(c) + FIRST).otherwise(wrong))
    return out
