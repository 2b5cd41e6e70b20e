"""Ordered series: ordinals without a single-partition sort, and causal windows over chunks with a halo."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import pinned


def prefix_sum(df: DataFrame, order: list[str], amount: str, name: str, partitions: int | None = None) -> DataFrame:
    """Adds the sum of amount over the rows before each row in a total order.

    Rows are dealt out by ranges, summed per range, and summed up inside each; only the sums meet in one place.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = pinned(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))  # ranges are sampled: both branches need the same
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(F.sum(amount).alias("_n"))
    offsets = sums.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_offset") + inside).drop("_range", "_offset")


def with_ordinal(df: DataFrame, order: list[str], name: str = "t", partitions: int | None = None) -> DataFrame:
    """Adds the 0-based place of each row in a total order."""
    return prefix_sum(df.withColumn("_one", F.lit(1)), order, "_one", name, partitions).withColumn(name, F.col(name).cast("long")).drop("_one")


def with_halo(df: DataFrame, halo: int, chunk: int, t: str = "t") -> DataFrame:
    """Rows with _own, the run of chunk steps they are in, and _chunk, the runs that read them: their own, and the next if they are among its halo."""
    own = F.floor(F.col(t) / chunk)
    copies = F.when(F.col(t) % chunk >= chunk - halo, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_own", own).withColumn("_chunk", F.explode(copies))


def over_runs(df: DataFrame, make: Callable[[pa.Table, int], pa.Table], kind: StructType | str, halo: int, chunk: int, t: str = "t") -> DataFrame:
    """make(rows, lo) of each run of chunk steps as one table: its rows in the order of t from place lo on, after those of the halo steps before it."""
    chunk = max(chunk, halo, 1)
    columns = df.columns

    def run(held: pa.Table) -> pa.Table:
        held = held.sort_by(t)
        lo = pc.sum(pc.less(held.column("_own"), held.column("_chunk"))).as_py() or 0
        return make(held.select(columns), lo)

    rows = with_halo(df, halo, chunk, t)
    return rows.groupBy("_chunk").applyInArrow(run, kind)


def over_chunks(df: DataFrame, make: Callable[[object], dict[str, Column]], halo: int, chunk: int = 4096, t: str = "t", keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds make(window) computed over runs of chunk steps, each seeing the halo steps before it; rows are ordered by t.

    Columns that look back at most halo steps come out as over the whole series, or as over that of each key. A halo
    beyond chunk raises the chunk.
    """
    chunk = max(chunk, halo)
    spread = with_halo(df, halo, chunk, t)
    window = Window.partitionBy(*keys, "_chunk").orderBy(t)
    return spread.select("*", *(c.alias(n) for n, c in make(window).items())).where("_own = _chunk").drop("_own", "_chunk")


def _ranged(df: DataFrame, keys: list[str], t: str, chunk: int):
    """df with _part, the range of t a row is in, and the window of its key inside that range."""
    part = F.floor(F.col(t) / chunk)
    return df.withColumn("_part", part), Window.partitionBy(*keys, "_part").orderBy(t), Window.partitionBy(*keys).orderBy("_part")


def neighbours(df: DataFrame, keys: list[str], t: str = "t", chunk: int = 1 << 16) -> DataFrame:
    """Adds was and next: the t of the row before and after of the same key (null where there is none).

    A key's rows are dealt out by ranges of t, and only the ends of the ranges meet, so a key that has most rows is not
    one task. df is read twice, so it should be cheap to read.
    """
    rows, inside, along = _ranged(df, keys, t, chunk)
    ends = rows.groupBy(*keys, "_part").agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    carried = ends.select(*keys, "_part", F.lag("_hi").over(along).alias("_was"), F.lead("_lo").over(along).alias("_next"))
    near = rows.withColumns({"was": F.lag(t).over(inside), "next": F.lead(t).over(inside)})
    joined = near.join(carried, [*keys, "_part"], "left")
    return joined.withColumns({"was": F.coalesce("was", "_was"), "next": F.coalesce("next", "_next")}).drop("_part", "_was", "_next")


def earlier(df: DataFrame, keys: list[str], t: str = "t", first: str | None = None, chunk: int = 1 << 16, base: DataFrame | None = None) -> DataFrame:
    """Adds uses, how many rows of the same key come before, and first_<first>, the least value of that column in the key so far.

    Null keys count as a key; ranges as in neighbours(). base: the same rows as df in a table that is cheaper to read,
    for the sums of the ranges.
    """
    rows, inside, along = _ranged(df, keys, t, chunk)
    firsts = [F.min(first).alias("_first")] if first else []
    sums = (rows if base is None else _ranged(base, keys, t, chunk)[0]).groupBy(*keys, "_part").agg(F.count("*").alias("_n"), *firsts)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    least = [F.min("_first").over(before).alias("_first")] if first else []
    carried = sums.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), *least)
    here = rows.withColumn("_here", F.row_number().over(inside) - 1)
    if first:
        here = here.withColumn("_lo", F.min(first).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = here.join(carried, same).withColumn("uses", (F.col("_n") + F.col("_here")).cast("long"))
    if first:
        out = out.withColumn(f"first_{first}", F.least("_first", "_lo")).drop("_first", "_lo")
    return out.drop("_part", "_p", "_n", "_here", *(f"_k_{k}" for k in keys))


def running(df: DataFrame, keys: list[str], sums: dict[str, Column], lasts: dict[str, Column], t: str = "t", chunk: int = 1 << 16) -> DataFrame:
    """Adds, over this row and all earlier ones of the same key (not null): sums, and the last values that aren't null; ranges as in neighbours()."""
    rows, inside, along = _ranged(df, keys, t, chunk)
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    here = rows.select("*", *(F.sum(c).over(upto).alias(f"_{n}") for n, c in sums.items()), *(F.last(c, ignorenulls=True).over(upto).alias(f"_{n}") for n, c in lasts.items()))
    ends = rows.groupBy(*keys, "_part").agg(*(F.sum(c).alias(n) for n, c in sums.items()), *(F.max_by(c, F.when(c.isNotNull(), F.col(t))).alias(n) for n, c in lasts.items()))
    carried = ends.select(*keys, "_part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_0{n}") for n in sums), *(F.last(n, ignorenulls=True).over(before).alias(f"_0{n}") for n in lasts))
    made = {n: F.coalesce(f"_{n}", F.lit(0)) + F.col(f"_0{n}") for n in sums} | {n: F.coalesce(f"_{n}", f"_0{n}") for n in lasts}
    return here.join(carried, [*keys, "_part"]).withColumns(made).drop("_part", *(f"{m}{n}" for n in (*sums, *lasts) for m in ("_", "_0")))


def last_n(value: Column, window, n: int) -> Column:
    """Sum of value over the n rows before this one, as a difference of two running sums."""
    upto = F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return upto - F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -n - 1)), F.lit(0))


def seen(n: int, t: str = "t") -> Column:
    """How many of the n rows before this one exist."""
    return F.least(F.col(t), F.lit(n))


def rolling_frequency(df: DataFrame, columns: list[str], symbols: range, n: int, chunk: int = 4096) -> DataFrame:
    """Per column and symbol its share of the last n rows (0 in the first row): <column>_<symbol>."""
    return over_chunks(
        df,
        lambda w: {f"{c}_{s}": F.coalesce(F.try_divide(last_n((F.col(c) == s).cast("int"), w, n), seen(n)), F.lit(0.0)) for c in columns for s in symbols},
        n + 1, chunk,
    )


def rolling_uniformity(df: DataFrame, columns: list[str], symbols: range, n: int, least: int = 5, chunk: int = 4096) -> DataFrame:
    """Chi-square against equal shares, and entropy in bits, of the last n rows; 0 with fewer than least rows."""
    size = len(symbols)

    def make(w):
        out = {}
        for c in columns:
            counts = [last_n((F.col(c) == s).cast("int"), w, n) for s in symbols]
            m, enough = seen(n), F.col("t") >= least
            chi = sum((F.try_divide((k - m / size) * (k - m / size), m / size) for k in counts[1:]), F.try_divide((counts[0] - m / size) * (counts[0] - m / size), m / size))
            shares = [F.try_divide(k, m) for k in counts]
            bits = sum((F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in shares), F.lit(0.0))
            out[f"{c}_chi2"] = F.when(enough, chi).otherwise(0.0)
            out[f"{c}_entropy"] = F.when(enough, bits).otherwise(0.0)
        return out

    return over_chunks(df, make, n + 1, chunk)


def rolling_correlation(df: DataFrame, pairs: list[tuple[str, str]], n: int, chunk: int = 4096) -> DataFrame:
    """Pearson correlation of column pairs over the last n rows; 0 where it is undefined."""

    def make(w):
        out = {}
        for a, b in pairs:
            x, y, m = F.col(a).cast("double"), F.col(b).cast("double"), seen(n)
            sx, sy, sxy, sxx, syy = (last_n(v, w, n) for v in (x, y, x * y, x * x, y * y))
            root = F.sqrt(F.greatest((m * sxx - sx * sx) * (m * syy - sy * sy), F.lit(0.0)))
            out[f"corr_{a}_{b}"] = F.when(m >= 2, F.coalesce(F.try_divide(m * sxy - sx * sy, root), F.lit(0.0))).otherwise(0.0)
        return out

    return over_chunks(df, make, n + 1, chunk)


def symbol_gap(df: DataFrame, hits: dict[str, Column], cap: int = 1000) -> DataFrame:
    """Per named condition the steps since it last held before this row, at most cap (and the rows so far, if never)."""
    return over_chunks(
        df,
        lambda w: {
            name: F.least(F.coalesce(F.col("t") - F.last(F.when(hit, F.col("t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("t")), F.lit(cap)) for name, hit in hits.items()
        },
        cap, max(cap, 4096),
    )


def symbol_gap_uncapped(df: DataFrame, hits: dict[str, Column], chunk: int = 4096) -> DataFrame:
    """As symbol_gap(), without a cap: the last hit before each chunk is carried into it. Chunks are few."""
    rows = df.withColumn("_chunk", F.floor(F.col("t") / chunk))
    last = rows.groupBy("_chunk").agg(*(F.max(F.when(hit, F.col("t"))).alias(f"_{n}") for n, hit in hits.items()))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_chunk", *(F.max(f"_{n}").over(before).alias(f"_{n}") for n in hits))
    inside = Window.partitionBy("_chunk").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.join(carried, "_chunk").select(*df.columns, *(F.coalesce(F.max(F.when(hit, F.col("t"))).over(inside), F.col(f"_{n}")).alias(n) for n, hit in hits.items()))
    return near.withColumns({n: F.coalesce(F.col("t") - F.col(n), F.col("t")) for n in hits})


def key_gap(df: DataFrame, key: str, cap: int = 1000) -> DataFrame:
    """Steps since the same key, cap if never; a label-side statistic, as it reads this row's key."""
    near = neighbours(df, [key])
    return near.withColumn("gap", F.least(F.coalesce(F.col("t") - F.col("was"), F.lit(cap)), F.lit(cap))).drop("was", "next")


def key_usage(df: DataFrame, key: str, day: str) -> DataFrame:
    """Earlier uses of this row's key, and days since its first use; 0 for a null key."""
    held = earlier(df, [key], first=day)
    unset = F.col(key).isNull()
    age = F.datediff(F.col(day), F.col(f"first_{day}"))
    return held.withColumns({"uses": F.when(unset, 0).otherwise(F.col("uses")).cast("int"), "age": F.when(unset, 0).otherwise(age)}).drop(f"first_{day}")


def step_overlap(df: DataFrame, symbols: str) -> DataFrame:
    """How many different symbols of the array column the row before shares with the one before that (causal)."""
    return over_chunks(df, lambda w: {"overlap": F.coalesce(F.size(F.array_intersect(F.lag(symbols, 1).over(w), F.lag(symbols, 2).over(w))), F.lit(0))}, 3)


def previous_shape(df: DataFrame, digits: list[str]) -> DataFrame:
    """Sum, distinct digits, odd and high counts of the row before; 0 in the first row."""

    def make(w):
        before = [F.lag(d, 1).over(w) for d in digits]
        zero = F.lit(0)
        return {
            "prev_sum": F.coalesce(sum(before[1:], before[0]), zero),
            "prev_distinct": F.when(before[0].isNull(), 0).otherwise(F.size(F.array_distinct(F.array(*before)))),
            "prev_odd": F.coalesce(sum((b % 2 for b in before[1:]), before[0] % 2), zero),
            "prev_high": F.coalesce(sum(((b >= 5).cast("int") for b in before[1:]), (before[0] >= 5).cast("int")), zero),
        }

    return over_chunks(df, make, 2)


def context_windows(df: DataFrame, columns: list[str], width: int, mask: int = 1) -> DataFrame:
    """t, context, target: the width rows before each row that has so many and then the row itself masked, and its own values as labels."""
    rows = over_chunks(df, lambda w: {"context": F.collect_list(F.struct(*columns)).over(w.rowsBetween(-width, -1))}, width, max(width, 4096))
    hidden = F.array(F.struct(*(F.lit(mask).cast(df.schema[c].dataType).alias(c) for c in columns)))
    return rows.where(F.size("context") == width).select("t", F.concat("context", hidden).alias("context"), F.struct(*columns).alias("target"))


def lag_targets(df: DataFrame, column: str, ahead: int) -> DataFrame:
    """The values 0 to ahead steps on, for rows that have them all: y0, y1, ..."""
    out = df.select("t", F.col(column).alias("y0"))
    for k in range(1, ahead + 1):
        out = out.join(df.select((F.col("t") - k).alias("t"), F.col(column).alias(f"y{k}")), "t")
    return out


def hopping_chi2(df: DataFrame, symbol: str, size: int, step: int, symbols: int) -> DataFrame:
    """Chi-square against equal shares of windows of size rows every step rows (the last full one left out)."""
    n = df.agg(F.max("t").alias("last"))
    first = F.greatest(F.lit(0), F.floor((F.col("t") - size) / step) + 1)
    starts = F.sequence(first, F.floor(F.col("t") / step))
    counts = df.select(symbol, F.explode(starts).alias("k")).withColumn("start", F.col("k") * step).groupBy("start", symbol).agg(F.count("*").alias("n"))
    each = counts.groupBy("start").agg((F.sum(F.col("n") * F.col("n")) * symbols / size - size).alias("chi2"))
    return each.join(F.broadcast(n), F.col("start") < F.col("last") + 1 - size).select("start", "chi2")
