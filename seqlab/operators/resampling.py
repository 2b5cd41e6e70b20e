"""Nulls that both engines can draw: order and signs come from md5 of seed, replicate and row."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import with_ordinal

_NONE = -(1 << 63)  # a null symbol


def draw(seed: int, *parts: str) -> Column:
    """A 48-bit number from the hash of seed and columns."""
    key = F.concat_ws(":", F.lit(str(seed)), *(F.col(p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long")


@cache
def _rounds() -> list[tuple[int, int, int, int]]:
    """Of the 64 rounds of MD5: kind, word, shift, constant."""
    words = (lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16)
    shifts = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
    return [(i // 16, words[i // 16](i), shifts[i // 16][i % 4], int(abs(math.sin(i + 1)) * (1 << 32))) for i in range(64)]


def draws_of(seed: int, replicates: int | list[str], t: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """draw(seed, rep, t) of replicates 1 and up (rows) and many t at once: MD5 of messages under 56 bytes, side by side.

    replicates may be a list of what stands between seed and t, as "3" or "3:lag".
    """
    between = replicates if isinstance(replicates, list) else [str(rep) for rep in range(1, replicates + 1)]
    out = np.empty((len(between), len(t)), np.int64)
    for lo in range(0, len(t), block):
        text, known = t[lo : lo + block].astype("S20"), {}
        size = np.char.str_len(text).astype(np.uint32)
        start = [np.full(len(text), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        for row, name in enumerate(between):
            head = f"{seed}:{name}:".encode()
            if len(head) not in known:  # the words of the messages, without their heads
                raw = np.zeros((len(text), 64), np.uint8)
                raw[:, len(head) : len(head) + 20] = text.view(np.uint8).reshape(-1, 20)
                raw[np.arange(len(text)), len(head) + size] = 128
                m = list(np.ascontiguousarray(raw.view("<u4").T))
                m[14] = (size + np.uint32(len(head))) * np.uint32(8)
                known[len(head)] = [x if x.any() else None for x in m]
            fixed = np.frombuffer(head.ljust(64, b"\0"), "<u4")
            m = [x if not k else k if x is None else x | k for x, k in zip(known[len(head)], fixed)]
            a, b, c, d = start
            for kind, word, shift, constant in _rounds():
                f = d ^ (b & (c ^ d)) if kind == 0 else c ^ (d & (b ^ c)) if kind == 1 else b ^ c ^ d if kind == 2 else c ^ (b | ~d)
                f += a
                f += np.uint32(constant)
                if m[word] is not None:
                    f += m[word]
                high = f << np.uint32(shift)
                f >>= np.uint32(32 - shift)
                f |= high
                f += b
                a, d, c, b = d, c, b, f
            first, second = ((x + y).byteswap().astype(np.int64) for x, y in zip((a, b), start))
            out[row, lo : lo + block] = first << 16 | second >> 16
    return out


def sign_flip(diffs: DataFrame, value: str, row: str, replicates: int, seed: int = 42) -> DataFrame:
    """Paired sign-flip test of a mean: observed, n, p = (1 + flips at least as far) / (replicates + 1).

    Each row yields its replicates in the row, and these are summed before they move.
    """
    reps = diffs.select(value, row, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    flipped = F.when(draw(seed, "rep", row) % 2 == 0, F.col(value)).otherwise(-F.col(value))
    sums = reps.groupBy("rep").agg(F.round(F.avg(flipped), 9).alias("mean"))
    seen = diffs.agg(F.round(F.avg(value), 9).alias("observed"), F.count(value).alias("n"))
    far = sums.join(F.broadcast(seen)).groupBy("observed", "n").agg(F.sum((F.abs("mean") >= F.abs("observed")).cast("int")).alias("far"))
    return far.select("observed", "n", ((1 + F.col("far")) / (replicates + 1)).alias("p"))


def permutation_match(pairs: DataFrame, prediction: str, outcome: str, t: str, replicates: int, seed: int = 42, chunk: int = 4096) -> DataFrame:
    """Share of rows whose prediction equals the outcome, against outcomes permuted over the rows; both are integers or null.

    One row: observed, null_mean, null_p95, p (one-sided, with the plus one). t is a total order. Rows are numbered once by t and packed
    by runs. Outcomes move once, packed by ranges of their draws, of about 10 chunk rows of each replicate; the places of a range are
    close to each other in all replicates, so its predictions come to it once for all of them. Only counts of ranges meet in one place.
    """
    base = with_ordinal(pairs.select(t, prediction, outcome), [t], "slot")
    run, ranges = 4 * chunk, max(1, -(-base.count() // (10 * chunk)))
    coded = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(_NONE))
    packed = base.select(F.floor(F.col("slot") / run).alias("run"), "slot", F.col(t).cast("long").alias("t"), coded(prediction).alias("guess"), coded(outcome).alias("came"))
    width = (1 << 48) / ranges

    def dealt(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = draws_of(seed, replicates, times)
        return found, (found / width).astype(np.int64)

    def counted(held: pa.Table) -> pa.Table:
        places = dealt(held.column("t").to_numpy())[1]
        n = np.stack([np.bincount(x, minlength=ranges) for x in places])
        rep, place = np.nonzero(n)
        return pa.table({"rep": pa.array(rep + 1, pa.int32()), "range": place, "n": n[rep, place]})

    def blocks(held: pa.Table) -> pa.Table:
        held = held.sort_by("slot")
        times, came, number = held.column("t").to_numpy(), held.column("came").to_numpy(), held.column("run")[0].as_py()
        draws, place = (x.ravel() for x in dealt(times))
        order = np.argsort(place, kind="stable")  # in a range by replicate, then by t
        place, draws, outcomes, reps = place[order], draws[order], came[order % len(times)], order // len(times)
        cuts = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
        cut = lambda values: [values[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]
        sizes = [np.bincount(reps[i:j], minlength=replicates).tobytes() for i, j in zip(cuts, cuts[1:])]
        return pa.table([pa.array(place[cuts[:-1]]), pa.array([number] * (len(cuts) - 1), pa.int64()), pa.array(sizes, pa.binary()), pa.array(cut(draws), pa.binary()), pa.array(cut(outcomes), pa.binary())], names=["range", "run", "sizes", "draws", "came"])

    def matched(moved: pa.Table, near: pa.Table) -> pa.Table:
        moved, near = moved.sort_by("run"), near.sort_by("run")
        read = lambda column: [np.frombuffer(x.as_py(), np.int64) for x in column]
        ends = [np.concatenate([[0], np.cumsum(x)]) for x in read(moved.column("sizes"))]
        draws, came, guesses = read(moved.column("draws")), read(moved.column("came")), np.concatenate(read(near.column("guesses")))
        first, offsets = near.column("run")[0].as_py() * run, {x["rep"]: x["offset"] for held in near.column("offsets").to_pylist() for x in held or []}
        out = []
        for rep in range(replicates):
            found = np.concatenate([x[e[rep] : e[rep + 1]] for x, e in zip(draws, ends)])
            if not len(found):
                continue
            order = np.argsort(found)
            if (np.diff(found[order]) == 0).any():
                order = np.argsort(found, kind="stable")  # of equal draws the smaller t
            held = np.concatenate([x[e[rep] : e[rep + 1]] for x, e in zip(came, ends)])[order]
            guess = guesses[offsets[rep + 1] - first :][: len(held)]
            known = (guess != _NONE) & (held != _NONE)
            out.append((rep + 1, int((known & (guess == held)).sum()), int(known.sum())))
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64()))], names=["rep", "hits", "n"])

    def guesses(held: pa.Table) -> pa.Table:
        held = held.sort_by("slot")
        return pa.table([held.column("run")[:1], pa.array([held.column("guess").to_numpy().tobytes()], pa.binary())], names=["run", "guesses"])

    runs = packed.groupBy("run")
    sizes = runs.applyInArrow(counted, "rep int, range long, n long").groupBy("rep", "range").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("rep").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    spans = offset.groupBy("range").agg(F.collect_list(F.struct("rep", "offset")).alias("offsets"), F.min("offset").alias("lo"), F.max(F.col("offset") + F.col("n") - 1).alias("hi"))
    wanted = spans.select("range", "offsets", F.explode(F.sequence(F.floor(F.col("lo") / run), F.floor(F.col("hi") / run))).alias("run"))
    nth = F.row_number().over(Window.partitionBy("range").orderBy("run"))  # the first run of a range brings its offsets
    near = wanted.withColumn("offsets", F.when(nth == 1, F.col("offsets"))).join(runs.applyInArrow(guesses, "run long, guesses binary"), "run")
    moved = runs.applyInArrow(blocks, "range long, run long, sizes binary, draws binary, came binary")
    hits = moved.groupBy("range").cogroup(near.groupBy("range")).applyInArrow(matched, "rep int, hits long, n long")
    each = hits.groupBy("rep").agg(F.try_divide(F.sum("hits"), F.sum("n")).alias("stat"))
    seen = pairs.agg(F.avg((F.col(prediction) == F.col(outcome)).cast("double")).alias("observed"))
    joined = each.join(F.broadcast(seen)).groupBy("observed").agg(F.avg("stat").alias("null_mean"), F.expr("percentile(stat, 0.95)").alias("null_p95"), F.sum((F.col("stat") >= F.col("observed")).cast("int")).alias("far"))
    return joined.select("observed", "null_mean", "null_p95", ((1 + F.col("far")) / (replicates + 1)).alias("p"))
