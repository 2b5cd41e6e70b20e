"""Boosted trees of all symbols at once: each pass over packed bins gives the sums of a level of every symbol's tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..storage import pinned

_UNIT = 2.0**26  # residuals are summed as whole numbers of this part, so that no sum hangs on the order of rows


def _matrix(held: pa.RecordBatch, width: int) -> np.ndarray:
    """x of some rows, a line a feature."""
    x = held.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width) + 0.0
    if len(x) != len(held) or not np.isfinite(x).all():
        raise ValueError("a feature is null or not finite")
    return np.ascontiguousarray(x.T)


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """How many cuts of its feature are below each value."""
    return np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x, strict=True)]).astype(np.uint8)


def _nodes(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row after so many levels of a tree, from 0 at the left. Nodes are numbered by levels; one that isn't split sends all to the left."""
    at = np.zeros(bins.shape[1], np.uint8)
    for level in range(levels):
        first = 2**level - 1
        right = bins[feature[first]] > cut[first]
        for k in range(1, 2**level):
            right = np.where(at == k, bins[feature[first + k]] > cut[first + k], right)
        at = 2 * at + right
    return at


def _margin(bins: np.ndarray, trees: list, symbol: int, depth: int) -> np.ndarray:
    """The weighted sum of the trees of a symbol for each row."""
    return sum((weight * value[symbol][_nodes(bins, feature[symbol], cut[symbol], depth)] for weight, feature, cut, value in trees), np.zeros(bins.shape[1]))


def cut_points(rows: DataFrame, width: int, bins: int = 32) -> tuple[list[np.ndarray], int]:
    """Per feature of the standardised x (an array) the ascending cuts between its bins, and the number of rows.

    With at most so many values a feature is cut between all of them, else where the rows so far come nearest to equal
    parts; values of under one in 10,000 rows, if they are less than a bin together, don't count for that and join their neighbours. All rows are counted, by values that agree in their leading 20 bits (sign, exponent and a part in 256), of which
    there are few; so a bin may be off by one such cell where values are that dense.
    """

    def count(batches):
        for held in batches:
            x = np.sort(_matrix(held, width), axis=1)
            cell = x.view(np.int64) >> 44
            first = np.ones(x.shape, bool)
            first[:, 1:] = cell[:, 1:] != cell[:, :-1]
            lo = np.flatnonzero(first)
            hi = np.append(lo[1:], x.size) if len(lo) else lo
            flat = x.ravel()
            yield pa.RecordBatch.from_arrays([pa.array((lo // max(1, len(held))).astype(np.int32)), pa.array(cell.ravel()[lo]), pa.array(flat[lo]), pa.array(flat[hi - 1]), pa.array(hi - lo)], ["place", "cell", "lo", "hi", "n"])

    cells = rows.select("x").mapInArrow(count, "place int, cell long, lo double, hi double, n long").groupBy("place", "cell")
    found = cells.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).toArrow()
    place, lo, hi, n = (found.column(c).to_numpy() for c in ("place", "lo", "hi", "n"))
    cuts, size = [], int(n[place == 0].sum())
    most = min(bins, size)
    for f in range(width):
        own = np.flatnonzero(place == f)
        own = own[np.argsort(lo[own])]
        common = own[n[own] * 10_000 >= size]
        if len(own) > most and n[own].sum() - n[common].sum() < size / most:
            own = common
        between = (hi[own][:-1] + lo[own][1:]) / 2
        if len(between) >= most:
            upto, chosen, target = np.cumsum(n[own]), [], size / most
            for i in range(len(between)):
                if abs(upto[i] - target) < abs(upto[i + 1] - target):
                    chosen.append(i)
                    target += size / most
            between = between[chosen]
        cuts.append(between)
    return cuts, size


def _packed(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray], least: int = 8192) -> Iterator[pa.RecordBatch]:
    """Bins (a byte each) and labels of at least so many rows, but for the last ones of a task, as one row."""

    def row(parts):
        bins, y = (np.concatenate([p[i] for p in parts], axis=-1) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array([bins.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary()), pa.array([int(y.max())], pa.int32())], ["bins", "y", "top"])

    parts = []
    for held in batches:
        if len(held):
            y = held.column("y").to_numpy(zero_copy_only=False)
            if not ((y >= 0) & (y == np.floor(y))).all():
                raise ValueError("a label is null or no symbol")
            parts.append((_binned(_matrix(held, len(cuts)), cuts), y.astype(np.int32)))
        if sum(len(y) for _, y in parts) >= least:
            yield row(parts)
            parts = []
    if parts:
        yield row(parts)


def boosted_margins(train: DataFrame, rows: DataFrame, width: int, rounds: int = 5, depth: int = 3, step: float = 0.1, bins: int = 32) -> DataFrame:
    """rows without x, with raw: for each symbol the margin of boosted trees for it against the rest, fitted on train.

    train and rows have x, an array of standardised features, train also y, symbols from 0. The models are those of
    Spark's GBTClassifier for each symbol: regression trees on -1 and 1, then on the slopes of the logistic loss, all but
    the first weighted by step. Rows are binned and packed once (a byte a value); a pass finds the margins so far from the
    trees and sums the residuals by symbol, node, feature and bin, so rounds * depth passes fit all symbols. The sums, of
    which alone the driver sees the total, are symbols * 2**(depth - 1) * width * bins: symbols and features are few, bins at most 255.
    """
    cuts, size = cut_points(train, width, bins)
    if not size:
        raise ValueError("there are no rows to fit")
    blocks = pinned(train.select("x", "y").mapInArrow(lambda batches: _packed(batches, cuts), "bins binary, y binary, top int"))
    symbols = blocks.agg(F.max("top")).first()[0] + 1
    cells, trees = width * bins, []

    def sums(tree: tuple, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and residuals of the nodes of a level: symbol, node, feature, bin."""
        shape = symbols, 2**level * cells
        done = list(trees)

        def part(batches):
            number, total = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
            for held in batches:
                for packed, labels in zip(held.column("bins"), held.column("y"), strict=True):
                    y = np.frombuffer(labels.as_buffer(), np.int32)
                    x = np.frombuffer(packed.as_buffer(), np.uint8).reshape(width, len(y))
                    places = x + np.arange(0, cells, bins)[:, None]
                    for s in range(symbols):
                        sign = np.where(y == s, 1.0, -1.0)
                        rest = 4 * sign / (1 + np.exp(2 * sign * _margin(x, done, s, depth))) if done else sign
                        at = (places + _nodes(x, tree[0][s], tree[1][s], level).astype(np.int64) * cells).ravel()
                        number[s] += np.bincount(at, minlength=shape[1])
                        total[s] += np.bincount(at, np.tile(np.rint(rest * _UNIT), width), shape[1]).astype(np.int64)
            some = np.flatnonzero(number)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(number.ravel()[some]), pa.array(total.ravel()[some])], ["i", "n", "v"])

        found = blocks.select("bins", "y").mapInArrow(part, "i int, n long, v long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow()
        out = np.zeros((2, symbols * shape[1]))
        out[:, found.column("i").to_numpy()] = found.column("n").to_numpy(), found.column("v").to_numpy()
        return tuple(out.reshape(2, symbols, 2**level, width, bins))

    for r in range(rounds):
        feature, cut = np.zeros((symbols, 2**depth - 1), np.int64), np.full((symbols, 2**depth - 1), bins, np.uint8)
        value = np.zeros((symbols, 2**depth))
        for level in range(depth):
            number, total = sums((feature, cut), level)
            n, v = number.cumsum(-1), total.cumsum(-1)  # up to each bin
            every, whole = n[..., :1, -1:], v[..., :1, -1:]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = v * v / n + (whole - v) ** 2 / (every - n) - whole * whole / every
            gain = np.where((n > 0) & (n < every), gain, 0).reshape(symbols, 2**level, cells)
            best = gain.argmax(-1)  # the first feature and cut of equal ones
            for s, k in np.ndindex(*best.shape):
                f, b = divmod(int(best[s, k]), bins)
                split, node, leaf = gain[s, k, best[s, k]] > 0, 2**level - 1 + k, k << (depth - level)
                if split:
                    feature[s, node], cut[s, node] = f, b
                if level == depth - 1 and every[s, k, 0, 0]:
                    n0, v0, n1, v1 = n[s, k, f, b], v[s, k, f, b], every[s, k, 0, 0], whole[s, k, 0, 0]
                    value[s, leaf : leaf + 2] = [v0 / n0, (v1 - v0) / (n1 - n0)] if split else v1 / n1
        trees.append((step if r else 1.0, feature, cut, value / _UNIT))

    kept = [f for f in rows.schema.fields if f.name != "x"]

    def score(batches):
        for held in batches:
            x = _binned(_matrix(held, width), cuts)
            raw = np.stack([_margin(x, trees, s, depth) for s in range(symbols)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, raw.size + 1, symbols, dtype=np.int32)), pa.array(raw.ravel()))
            yield pa.RecordBatch.from_arrays([*(held.column(f.name) for f in kept), lists], [*(f.name for f in kept), "raw"])

    return rows.mapInArrow(score, StructType([*kept, StructField("raw", ArrayType(DoubleType()))]))
