"""Predictors of symbols that need counts alone, in one form: t, position, symbol, p for every scored row, summing to 1 by position."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..storage import pinned
from .features import carried_sums, decayed_history
from .scores import normalised
from .series import over_chunks, over_runs, symbol_gap_uncapped, with_halo


def _long(rows: DataFrame, sets: dict[str, Column]) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("position"), p.alias("p")) for c, p in sets.items()))).alias("x")
    return rows.select("t", each).select("t", "x.position", F.posexplode("x.p").alias("symbol", "p"))


def uniform(rows: DataFrame, columns: list[str], symbols: int) -> DataFrame:
    return _long(rows, {c: F.array_repeat(F.lit(1.0 / symbols), symbols) for c in columns})


def given_key(train: DataFrame, rows: DataFrame, keys: dict[str, str], symbols: int, alpha: float = 1.0) -> DataFrame:
    """Smoothed shares of each column's symbols in train given a key column, for rows by their own key.

    A key that train lacks has equal shares, so every row gets all symbols. Keys are few: the table is broadcast after
    their distinct values, times symbols.
    """
    out = []
    for column, key in keys.items():
        counts = train.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(*(F.count_if(F.col(column) == s).alias(f"n{s}") for s in range(symbols)))
        total = reduce(lambda a, b: a + b, (F.col(f"n{s}") for s in range(symbols)))
        shares = counts.select("_key", F.array(*((F.col(f"n{s}") + alpha) / (total + alpha * symbols) for s in range(symbols))).alias("_p"))
        held = rows.join(shares, F.col(key) == F.col("_key"), "left")
        out.append(_long(held, {column: F.coalesce("_p", F.array_repeat(F.lit(1.0 / symbols), symbols))}))
    return reduce(DataFrame.unionByName, out)


def with_previous(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds was_<column>, and the bin of the row before by the range of its sum and whether it repeats a symbol."""

    def make(w):
        was = {f"was_{c}": F.lag(c, 1).over(w) for c in columns}
        total = reduce(lambda a, b: a + b, was.values())
        third = F.when(total < 10, 0).when(total < 18, 1).otherwise(2)
        repeat = (F.size(F.array_distinct(F.array(*was.values()))) < len(columns)).cast("int")
        return was | {"was_bin": F.when(total.isNotNull(), third * 2 + repeat)}

    return over_chunks(rows, make, 1)


def recency(rows: DataFrame, columns: list[str], symbols: int, rate: float = 0.005) -> DataFrame:
    """Shares of all rows before, weighted by exp(-rate * age)."""
    made = reduce(lambda x, c: decayed_history(x, c, symbols, rate), columns, rows)
    return _long(made, {c: F.col(f"p_{c}") for c in columns})


def overdue(rows: DataFrame, columns: list[str], symbols: int, scale: float = 10.0) -> DataFrame:
    """Softmax of the steps since each symbol came."""
    gaps = symbol_gap_uncapped(rows, {f"_{c}_{s}": F.col(c) == s for c in columns for s in range(symbols)})
    most = {c: F.greatest(*(F.col(f"_{c}_{s}") for s in range(symbols))) for c in columns}
    return _long(gaps, {c: normalised(F.array(*(F.exp((F.col(f"_{c}_{s}") - most[c]) / scale) for s in range(symbols)))) for c in columns})


def score_sets(rows: DataFrame, columns: list[str], symbols: int, cut: int, kept: list[str] = (), rate: float = 0.005, scale: float = 10.0, places: int = 9, chunk: int = 4096) -> DataFrame:
    """strategy, t, the kept columns and p_<column>, to places, of the rows from cut on: markov and conditional as given_key() has them of the rows before cut, by the row before, recency and overdue.

    Rows (t from 0 without gaps) are dealt out twice by runs of steps. The first time each gives what it adds to the history: weights and
    last steps of all symbols, and counts given the row before; what came before a run is carried along the runs, and counts
    are added up to some hundred numbers. The second time a task makes all sets of a run at once.
    """
    size = max(1, min(chunk, int(40 / rate)))
    m, fall = len(columns) * symbols, rate * size
    keys = symbols + 6

    def parts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """t, symbols (-1 if unknown) and bins of rows: six, -1 if a symbol is unknown."""
        came = np.stack([table.column(c).fill_null(-1).to_numpy() for c in columns], 1).astype(np.int64) if len(table) else np.zeros((0, len(columns)), np.int64)
        total, up = came.sum(1), np.sort(came, 1)
        kind = np.where(total < 10, 0, np.where(total < 18, 1, 2)) * 2 + (up[:, 1:] == up[:, :-1]).any(1)
        return table.column("t").to_numpy(), came, np.where((came < 0).any(1), -1, kind)

    def hits(came: np.ndarray) -> np.ndarray:
        return (came[:, :, None] == np.arange(symbols)).reshape(len(came), -1)

    def added(table: pa.Table, lo: int) -> pa.Table:
        t, came, kind = parts(table)
        if lo == len(t):
            return pa.table([pa.array([], x) for x in kinds], names=names)
        first = int(t[lo]) // size
        on = hits(came[lo:])
        weight = (np.exp(rate * (t[lo:] - first * size - size))[:, None] * on).cumsum(0)[-1]
        last = np.where(on, t[lo:, None], -1).max(0)
        n = np.zeros((len(columns), keys, symbols), np.int64)
        here = np.arange(max(lo, 1), len(t))
        here = here[t[here] < cut]
        for k in range(len(columns)):
            for key, base in ((came[here - 1, k], 0), (kind[here - 1], symbols)):
                good = (key >= 0) & (came[here, k] >= 0)
                np.add.at(n[k], (key[good] + base, came[here, k][good]), 1)
        return pa.table([pa.array([x], kind) for x, kind in zip((first, weight.tolist(), last.tolist(), n.ravel().tolist()), kinds)], names=names)

    kinds, names = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64())], ["_chunk", "weight", "last", "n"]
    read = rows.select("t", *columns, *(c for c in kept if c not in columns))
    ends = pinned(over_runs(read.select("t", *columns), added, "_chunk long, weight array<double>, last array<long>, n array<long>", 1, size))  # a row a run
    counts = ends.agg(*(F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(len(columns) * keys * symbols))).first()  # some hundred numbers
    n = np.array([x or 0 for x in counts], float).reshape(len(columns), keys, symbols)
    shares = (n + 1) / (n.sum(2, keepdims=True) + symbols)
    past = carried_sums(ends.select("_chunk", *(F.col("weight")[i].alias(f"_{i}") for i in range(m))), m, fall)
    upto = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    last = ends.select("_chunk", F.array(*(F.coalesce(F.max(F.col("last")[i]).over(upto), F.lit(-1)) for i in range(m))).alias("_last"))
    carried = past.join(last, "_chunk")

    def sets(table: pa.Table, before: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        t, came, kind = parts(table)
        if not len(before) or not len(t):
            return out_kind.empty_table()
        number = before.column("_chunk")[0].as_py()
        lo = int(np.searchsorted(t, number * size))
        on = hits(came[lo:])
        past, was = np.array(before.column("_past")[0].as_py()), np.array(before.column("_last")[0].as_py())
        scored = np.flatnonzero(t[lo:] >= cut)
        own = (np.exp(rate * (t[lo:] - number * size - size))[:, None] * on).cumsum(0)
        weight = np.concatenate([np.zeros((1, m)), own[:-1]]) + past * np.exp(-fall)
        hit = np.maximum.accumulate(np.where(on, t[lo:, None], -1), axis=0)
        hit = np.maximum(np.concatenate([np.full((1, m), -1), hit[:-1]]), was)
        gap = np.where(hit >= 0, t[lo:, None] - hit, t[lo:, None])
        spread = lambda x: x[scored].reshape(len(scored), len(columns), symbols)
        weight, gap = spread(weight), spread(gap)
        total = weight.sum(2, keepdims=True)
        recent = np.divide(weight, total, out=np.full_like(weight, 1 / symbols), where=total > 0)
        late = np.exp((gap - gap.max(2, keepdims=True)) / scale)
        near = lo + scored - 1  # the row before, if there is one

        def given(key: np.ndarray, k: int, base: int) -> np.ndarray:
            known = (near >= 0) & (key >= 0)
            return np.where(known[:, None], shares[k][np.where(known, key, 0) + base], 1 / symbols)

        def stacked(make) -> np.ndarray:
            return np.stack([make(k) for k in range(len(columns))], 1)

        found = {
            "markov": stacked(lambda k: given(came[near, k], k, 0)), "conditional": stacked(lambda k: given(kind[near], k, symbols)),
            "recency": recent, "overdue": late / late.sum(2, keepdims=True),
        }
        mine, lists = table.slice(lo).take(pa.array(scored)), pa.array(np.arange(len(scored) + 1, dtype=np.int32) * symbols)
        out = []
        for name, p in found.items():
            p = np.floor(p * 10.0**places + 0.5) / 10.0**places
            each = [pa.ListArray.from_arrays(lists, pa.array(np.ascontiguousarray(p[:, k]).ravel())) for k in range(len(columns))]
            out.append(pa.table([pa.array([name] * len(scored), pa.string()), mine.column("t"), *(mine.column(c) for c in kept), *each], schema=out_kind))
        return pa.concat_tables(out)

    kind = StructType([StructField("strategy", StringType()), *(read.schema[c] for c in ("t", *kept)), *(StructField(f"p_{c}", ArrayType(DoubleType())) for c in columns)])
    out_kind = to_arrow_schema(kind)
    dealt = with_halo(read.where(F.col("t") >= cut // size * size - 1), 1, size).drop("_own")
    return dealt.groupBy("_chunk").cogroup(carried.groupBy("_chunk")).applyInArrow(lambda a, b: sets(a, b), kind)


def nearest(train: DataFrame, queries: DataFrame, features: list[str], column: str, symbols: int, k: int = 20, block: int = 1000) -> DataFrame:
    """t, symbol, p of queries: shares of the symbols of the k nearest rows of train, weighted by inverse distance.

    Of train rows at the same point only the first k can be among the nearest, as ties go to the smaller t; and queries at
    the same point share their answer. So distinct points are held against each other: those of the queries, of which there
    may be any number, go to all of train's in blocks of a bounded size, and each task keeps its k best of each.
    """
    spark = train.sparkSession
    moments = train.agg(*(f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()  # two numbers a feature
    scaled = [((F.col(c) - moments[f"m_{c}"]) / (moments[f"s_{c}"] or 1.0)).cast("double").alias(c) for c in features]
    first = F.row_number().over(Window.partitionBy(*features).orderBy("t"))
    rows = pinned(train.select("t", F.col(column).alias("_y"), *features).withColumn("_r", first).where(F.col("_r") <= k).select("t", "_y", *scaled))
    points = pinned(queries.select(*features).distinct().withColumn("_id", F.monotonically_increasing_id()))
    asked = points.select("_id", *scaled)
    blocks = -(-max(1, asked.count()) // block)
    out = []
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == b).toPandas()  # a bounded block
        shared = spark.sparkContext.broadcast((part["_id"].to_numpy(), part[features].to_numpy(float)))

        def near(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, points = shared.value
            best = [np.empty((0, 3))] * len(ids)
            for frame in frames:
                mine, t, y = frame[features].to_numpy(float), frame["t"].to_numpy(), frame["_y"].to_numpy()
                for i, q in enumerate(points):
                    d = np.round(np.sqrt(((mine - q) ** 2).sum(1)), 9)
                    cut = np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1] if len(d) else 0.0
                    at = np.flatnonzero(d <= cut)
                    both = np.vstack([best[i], np.column_stack([d[at], t[at], y[at]])])
                    best[i] = both[np.lexsort((both[:, 1], both[:, 0]))][:k]
            yield pd.DataFrame([(int(q), float(d), int(t), int(y)) for q, rows_ in zip(ids, best) for d, t, y in rows_], columns=["_id", "d", "other", "y"])

        out.append(rows.mapInPandas(near, "_id long, d double, other long, y int"))
    found = reduce(DataFrame.unionByName, out).withColumn("_r", F.row_number().over(Window.partitionBy("_id").orderBy("d", "other"))).where(F.col("_r") <= k)
    weight = 1 / (F.col("d") + 1e-6)
    sums = found.groupBy("_id").agg(F.sum(weight).alias("_all"), F.array(*(F.sum(F.when(F.col("y") == s, weight).otherwise(0.0)) for s in range(symbols))).alias("_p"))
    shares = points.join(sums, "_id").select(*features, F.transform("_p", lambda x: x / F.col("_all")).alias("_p"))
    return queries.select("t", *features).join(shares, features).select("t", F.posexplode("_p").alias("symbol", "p"))


def quantiles_to_shares(quantiles: Column, symbols: int, floor: float = 1e-6) -> Column:
    """Shares of symbols from equal quantiles of a forecast: each rounds (half to even) to a symbol and adds its part."""
    n = F.size(quantiles)
    near = F.transform(quantiles, lambda q: F.greatest(F.least(F.rint(q), F.lit(float(symbols - 1))), F.lit(0.0)))
    raw = F.transform(F.sequence(F.lit(0), F.lit(symbols - 1)), lambda k: F.size(F.filter(near, lambda x: x == k)) / n + floor)
    return normalised(raw)


def evaluate(scores: DataFrame, outcomes: DataFrame, by: list[str], places: int = 9) -> DataFrame:
    """Per group of by: rows, mean log loss, mean rank of the outcome (ties to the smaller symbol) and share at rank 1.

    scores: by, t, position, symbol, p; outcomes: t, position, actual. A row's symbols are gathered in the row's group.
    """
    keys = [*dict.fromkeys([*by, "t", "position"])]
    p = F.round("p", places)
    held = scores.join(outcomes, ["t", "position"]).select(*keys, "symbol", p.alias("p"), "actual")
    own = F.max(F.when(F.col("symbol") == F.col("actual"), F.col("p")))
    each = held.groupBy(*keys).agg(own.alias("own"), F.any_value("actual").alias("actual"), F.collect_list(F.struct("p", "symbol")).alias("all"))
    better = F.size(F.filter("all", lambda x: (x["p"] > F.col("own")) | ((x["p"] == F.col("own")) & (x["symbol"] < F.col("actual")))))
    ranked = each.withColumn("rank", better + 1)
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.avg(-F.log(F.greatest("own", F.lit(1e-15)))).alias("log_loss"), F.avg("rank").alias("rank"), F.avg((F.col("rank") == 1).cast("int")).alias("top1"))
