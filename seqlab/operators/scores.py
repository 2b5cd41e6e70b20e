"""Probability sets in rows: marginals as arrays of a position's symbols, joints as arrays built inside the row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .series import over_runs


def smoothed_marginals(df: DataFrame, columns: list[str], symbols: int, n: int, chunk: int = 1 << 14) -> DataFrame:
    """Adds p_<column>: the add-one share of each symbol 0 .. symbols - 1 in the last n rows. Shares of a run of rows are made together."""

    def make(rows: pa.Table, lo: int) -> pa.Table:
        return _with_lists(rows.slice(lo), {f"p_{c}": p for c, p in zip(columns, shares_before(rows, lo, columns, symbols, n))})

    kind = StructType([*df.schema.fields, *(StructField(f"p_{c}", ArrayType(DoubleType())) for c in columns)])
    return over_runs(df, make, kind, n, chunk)


def shares_before(rows: pa.Table, lo: int, columns: list[str], symbols: int, n: int) -> list[np.ndarray]:
    """Of the rows from lo on of a run, a table (row, symbol) for each column: the add-one shares of the n rows before; t counts from 0."""
    at = np.arange(lo, len(rows))
    have = np.minimum(rows.column("t").to_numpy()[lo:], n)[:, None]
    out = []
    for c in columns:
        came = rows.column(c).fill_null(-1).to_numpy()
        upto = np.zeros((len(came) + 1, symbols), np.int64)
        np.cumsum(came[:, None] == np.arange(symbols), axis=0, out=upto[1:])
        out.append((upto[at] - upto[np.maximum(at - n, 0)] + 1) / (have + symbols))
    return out


def _with_lists(rows: pa.Table, made: dict[str, np.ndarray]) -> pa.Table:
    """Rows with tables (row, place) as columns of lists."""
    for name, x in made.items():
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
        rows = rows.append_column(name, pa.ListArray.from_arrays(offsets, pa.array(x.ravel())))
    return rows


def once(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body reads it inside a lambda."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def joint(marginals: list[str]) -> Column:
    """The product of independent marginals; the index of a combination reads its symbols as digits."""

    def below(rest, made):
        if len(rest) == 1:
            return F.transform(rest[0], lambda p: made * p) if made is not None else F.col(rest[0])
        return F.flatten(F.transform(rest[0], lambda p: below(rest[1:], p if made is None else made * p)))

    return below(marginals, None)


def normalised(p: Column) -> Column:
    """Shares of their sum; uniform if it is 0."""
    def shares(whole):
        return once(F.aggregate(whole, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(whole, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0) / F.size(whole))))

    return once(p, shares)


def weighted_mean(parts: list[str], weights: list[float]) -> Column:
    def scaled(p, share):
        return F.transform(p, lambda x: x * share)

    every = [scaled(p, w / sum(weights)) for p, w in zip(parts, weights, strict=True)]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), every)


def geometric_blend(a: str, b: str, weight_a: float, weight_b: float, floor: float = 1e-20) -> Column:
    mean = F.zip_with(a, b, lambda x, y: F.exp((weight_a * F.log(x + floor) + weight_b * F.log(y + floor)) / (weight_a + weight_b)))
    return normalised(mean)


def product_ensemble(parts: list[str]) -> Column:
    return normalised(reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x * y), map(F.col, parts)))


def rank_of(p: Column, actual: Column) -> Column:
    """1-based place of index actual by falling p, ties by index."""

    def before(whole):
        return once(F.element_at(whole, actual.cast("int") + 1), lambda own: F.size(F.filter(whole, lambda x, i: (x > own) | ((x == own) & (i < actual)))))

    return (1 + once(p, before)).cast("long")


def top_indices(p: Column, k: int) -> Column:
    """The k indexes with the largest p in order, ties by index."""
    order = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("p"), i.alias("i"))))
    return F.transform(F.slice(order, 1, k), lambda x: x["i"])


def top_combinations(df: DataFrame, marginals: list[str], k: int, name: str = "chosen") -> DataFrame:
    """Adds the k likeliest combinations in order, ties by index.

    A combination whose symbols stand at places r1, r2, ... of their marginals has at least r1 * r2 * ... - 1 others
    before it, so only those with a product of at most k are looked at, for a batch of rows at a time. Null where a marginal is.
    """
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have, tables = _tables(batch, marginals)
            found = [np.zeros((0, k), np.int32)]
            for lo in range(0, len(have), 1024) if len(have) else ():
                parts = [x[lo : lo + 1024] for x in tables]
                places = [[]]
                for x in parts:
                    places = [[*before, r] for before in places for r in range(1, x.shape[1] + 1) if prod(before) * r <= k]
                p, index = None, None
                for x, at in zip(parts, np.array(places).T - 1):
                    order = np.argsort(-x, axis=1, kind="stable")
                    value, symbol = np.take_along_axis(x, order, 1)[:, at], order[:, at]
                    p, index = (value, symbol) if p is None else (p * value, index * 10 + symbol)
                order = np.argsort(index, axis=1)
                p, index = np.take_along_axis(p, order, 1), np.take_along_axis(index, order, 1)
                found.append(np.take_along_axis(index, np.argsort(-p, axis=1, kind="stable")[:, :k], 1).astype(np.int32))
            best = [x for x in found if len(x)]
            lengths = np.concatenate([np.zeros(1, np.int32), *(np.full(len(x), x.shape[1], np.int32) for x in best)])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(np.concatenate([x.ravel() for x in best]) if best else np.zeros(0, np.int32)))
            yield _with(batch, have, {name: lists})

    return df.mapInArrow(choose, StructType([*df.schema.fields, StructField(name, ArrayType(IntegerType()))]))


def _tables(batch: pa.RecordBatch, columns: list[str], *others: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows of a batch that have all of the columns, and these columns, lists of one size, as tables of those rows."""
    have = np.flatnonzero(np.all([batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in (*columns, *others)], axis=0))
    lists = [batch.column(c).take(pa.array(have)).flatten().to_numpy(zero_copy_only=False) for c in columns]
    return have, [x.reshape(len(have), -1) if len(have) else x.reshape(0, 0) for x in lists]


def _with(batch: pa.RecordBatch, have: np.ndarray, made: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns made for the rows it has; null in the others."""
    place = np.zeros(len(batch), np.int64)
    place[have] = np.arange(len(have))
    missing = np.ones(len(batch), bool)
    missing[have] = False
    at = pa.array(place, mask=missing)
    return pa.RecordBatch.from_arrays([*batch.columns, *(x.take(at) for x in made.values())], [*batch.schema.names, *made])


def _joints(tables: list[np.ndarray], block: int = 256) -> Iterator[tuple[slice, np.ndarray]]:
    """The joints (row, combination) of marginals, for some rows at a time."""
    for lo in range(0, len(tables[0]), block):
        p = tables[0][lo : lo + block]
        for x in tables[1:]:
            p = (p[:, :, None] * x[lo : lo + block, None, :]).reshape(len(p), -1)
        yield slice(lo, lo + len(p)), p


def with_rank(df: DataFrame, marginals: list[str], actual: str, squares: bool = False) -> DataFrame:
    """Adds rank and own: the place of combination actual in the joint of the marginals, as rank_of() gives it, and its chance; with squares the sum of all squared chances.

    The joint is made for some rows at a time and never leaves the task; null where actual or a marginal is null.
    """

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have, tables = _tables(batch, marginals, actual)
            index = batch.column(actual).take(pa.array(have)).to_numpy(zero_copy_only=False).astype(np.int64)
            rank, own, square = np.zeros(len(have), np.int64), np.zeros(len(have)), np.zeros(len(have))
            for part, p in _joints(tables):
                at = index[part, None]
                mine = np.take_along_axis(p, at, 1)
                rank[part] = 1 + (p > mine).sum(1) + ((p == mine) & (np.arange(p.shape[1]) < at)).sum(1)
                own[part] = mine[:, 0]
                if squares:
                    square[part] = np.einsum("ij,ij->i", p, p)
            yield _with(batch, have, {"rank": pa.array(rank), "own": pa.array(own)} | ({"squares": pa.array(square)} if squares else {}))

    more = [StructField("squares", DoubleType())] if squares else []
    return df.mapInArrow(ranks, StructType([*df.schema.fields, StructField("rank", LongType()), StructField("own", DoubleType()), *more]))


def with_extremes(df: DataFrame, marginals: list[str]) -> DataFrame:
    """Adds most, least and total: the largest, the smallest and the sum of the normalised joint of the marginals, made as in with_rank()."""

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have, tables = _tables(batch, marginals)
            found = np.zeros((3, len(have)))
            for part, p in _joints(tables):
                total = p.sum(1, keepdims=True)
                p = np.divide(p, total, out=np.full_like(p, 1 / p.shape[1]), where=total > 0)
                found[:, part] = p.max(1), p.min(1), p.sum(1)
            yield _with(batch, have, {n: pa.array(x) for n, x in zip(("most", "least", "total"), found)})

    return df.mapInArrow(extremes, StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in ("most", "least", "total"))]))


def box_scores(p: Column, digits: int = 3) -> Column:
    """Summed p of each unordered combination, as structs (box, p); a box is named by its smallest member."""
    boxes: dict[tuple, list[int]] = {}
    for c in range(10**digits):
        boxes.setdefault(tuple(sorted(f"{c:0{digits}d}")), []).append(c)
    members = F.array(*(F.array(*map(F.lit, m)) for m in sorted(boxes.values())))
    return once(p, lambda whole: F.transform(members, lambda m: F.struct(m[0].alias("box"), F.round(F.aggregate(m, F.lit(0.0), lambda a, c: a + F.get(whole, c)), 12).alias("p"))))


def with_box_rank(df: DataFrame, marginals: list[str], digits: list[str]) -> DataFrame:
    """Adds box, that of the digits, and rank: its place by falling chance of all boxes, to 12 digits as box_scores() gives it, ties to the smaller box.

    As in with_rank() the joint is made for some rows at a time; null where a digit or a marginal is null.
    """
    boxes: dict[tuple, list[int]] = {}
    for c in range(10 ** len(digits)):
        boxes.setdefault(tuple(sorted(f"{c:0{len(digits)}d}")), []).append(c)
    members = sorted(boxes.values())
    names, longest = np.array([m[0] for m in members]), max(map(len, members))
    padded = np.array([m + [10 ** len(digits)] * (longest - len(m)) for m in members])  # the place after the last one holds no chance

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have, tables = _tables(batch, marginals, *digits)
            drawn = np.sort(np.stack([batch.column(d).take(pa.array(have)).to_numpy(zero_copy_only=False) for d in digits], 1).astype(np.int64), 1)
            box = drawn @ 10 ** np.arange(len(digits))[::-1]
            rank = np.zeros(len(have), np.int64)
            for lo in range(0, len(have), 256):
                p = tables[0][lo : lo + 256]
                for x in tables[1:]:
                    p = (p[:, :, None] * x[lo : lo + 256, None, :]).reshape(len(p), -1)
                p, total = np.append(p, np.zeros((len(p), 1)), 1), 0.0
                for m in padded.T:
                    total = total + p[:, m]
                total, own = np.round(total, 12), box[lo : lo + 256, None]
                mine = np.take_along_axis(total, np.searchsorted(names, own), 1)
                rank[lo : lo + 256] = 1 + (total > mine).sum(1) + ((total == mine) & (names < own)).sum(1)
            yield _with(batch, have, {"box": pa.array(box.astype(np.int32)), "rank": pa.array(rank)})

    return df.mapInArrow(ranks, StructType([*df.schema.fields, StructField("box", IntegerType()), StructField("rank", LongType())]))


def box_of(digits: list[str]) -> Column:
    """The smallest number that has these digits."""
    return F.aggregate(F.array_sort(F.array(*digits)), F.lit(0), lambda a, d: a * 10 + d)


def match_levels(chosen: Column, actual: Column) -> Column:
    """Most positions in which a member of the set agrees with the three-digit outcome; null for a null outcome or an empty set."""

    def agree(x):
        return sum(((F.floor(x / s) % 10 == F.floor(actual / s) % 10).cast("int") for s in (10, 1)), (F.floor(x / 100) == F.floor(actual / 100)).cast("int"))

    return F.array_max(F.transform(chosen, agree))


def covered(chosen: Column, actual: Column) -> list[Column]:
    """For each of the three positions 1 if some member of the set agrees there, else 0."""

    def agrees(place: int) -> Column:
        return F.exists(chosen, lambda x: F.floor(x / place) % 10 == F.floor(actual / place) % 10).cast("int")

    return [agrees(place) for place in (100, 10, 1)]


def optimal_ev(ranked: DataFrame, rank: str = "rank", payout: float = 500.0, most: int = 20) -> DataFrame:
    """Per k = 1 .. most the hit rate of the k best and its value k bets on; best marks the largest, the smallest k of equals."""
    sums = ranked.agg(F.count(rank).alias("n"), *(F.count_if(F.col(rank) <= k).alias(f"h{k}") for k in range(1, most + 1)))
    rows = sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.col(f"h{k}") / F.col("n")).alias("hit"), (F.col(f"h{k}") / F.col("n") * payout - k).alias("ev")) for k in range(1, most + 1)))).alias("x"))
    best = sums.select(F.array_max(F.array(*(F.struct(F.round(F.col(f"h{k}") / F.col("n") * payout - k, 9).alias("ev"), F.lit(-k).alias("k")) for k in range(1, most + 1))))["k"].alias("best"))
    return rows.join(F.broadcast(best)).select("x.k", "x.hit", "x.ev", (F.col("x.k") == -F.col("best")).alias("best"))


def at_lags(predictions: DataFrame, outcomes: DataFrame, lags: list[int] | tuple[int, ...] | range) -> DataFrame:
    """Each set (t, chosen) with every outcome (t, actual) lag steps later: t, chosen, lag, actual.

    The outcomes are repeated for the lags, not the sets. Neither side may be broadcast: sets that hardly change from step
    to step pack so well that their size in a shuffle says nothing of what they take in memory.
    """
    spread = outcomes.select(F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), (F.col("t") - k).alias("t"), "actual") for k in lags))).alias("x")).select("x.*")
    return predictions.select("t", "chosen").hint("merge").join(spread, "t").select("t", "chosen", "lag", "actual")


def lag_table(predictions: DataFrame, outcomes: DataFrame, lags: list[int]) -> DataFrame:
    """Sets (t, chosen) against the outcome (t, actual) lag steps later: lag, n, hit rate, mean best match, share of two or more, share that covers each position."""
    best = match_levels(F.col("chosen"), F.col("actual"))
    cover = [c.alias(f"cover{i}") for i, c in enumerate(covered(F.col("chosen"), F.col("actual")), 1)]
    held = at_lags(predictions, outcomes, lags).select("lag", best.alias("best"), *cover)
    return held.groupBy("lag").agg(F.count("best").alias("n"), F.avg((F.col("best") == 3).cast("int")).alias("exact"), F.avg("best").alias("best"), F.avg((F.col("best") >= 2).cast("int")).alias("two"), *(F.avg(f"cover{i}").alias(f"cover{i}") for i in (1, 2, 3)))
