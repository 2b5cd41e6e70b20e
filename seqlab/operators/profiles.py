"""Segments, matrix profiles and communities: structure of a series or of a graph of items."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..storage import pinned, written
from .resampling import draw, draws_of
from .series import over_chunks, over_runs


def replicated(df: DataFrame, columns: list[str], replicates: int, seed: int = 42) -> DataFrame:
    """rep, t, w and the columns as doubles: the series itself as replicate 0, and sorted bootstrap samples of its rows, each t with how often it was drawn."""
    rows = pinned(df.select("t", *(F.col(c).cast("double").alias(c) for c in columns)))
    n = rows.count()
    picks = rows.select("t", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")).select("rep", (draw(seed, "rep", "t") % n).alias("t")) if replicates else None
    own = rows.select(F.lit(0).alias("rep"), "t", F.lit(1).cast("long").alias("w"), *columns)
    return own if picks is None else picks.groupBy("rep", "t").agg(F.count("*").alias("w")).join(rows, "t").select(*own.columns).unionByName(own)


def greedy_cuts(series: DataFrame, columns: list[str], splits: int, least: int, chunk: int = 4096) -> DataFrame:
    """rep, step, at, error of greedy binary segmentations of all replicates (rep, t, w, columns) at once; step 0 has no cut.

    A step cuts, in each replicate, the segment whose best cut lowers the squared error of all columns most; a segment has
    at least least rows, and equal gains (to 6 digits) go to the smaller t. The series is read once: sums before every row
    are packed by ranges of t, a row for each. As the sums of a segment are differences of those at its ends, a step only
    looks at the ranges of the two segments that the one before has made, and gives one row each.
    """
    width, kind = len(columns) + 1, series.schema["rep"].dataType.simpleString()
    values = F.struct(F.col("t").cast("long").alias("t"), *(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(["w", *columns])))
    grouped = series.groupBy("rep", F.floor(F.col("t") / chunk).alias("_part")).agg(F.collect_list(values).alias("rows"))

    def pack(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows in batch.column("rows"):
                t, *held = (f.to_numpy(zero_copy_only=False) for f in rows.values.flatten())
                order = np.argsort(t, kind="stable")
                w, *v = (x[order] for x in held)
                x = np.stack([w, *(w * c for c in v)])
                upto = np.cumsum(x, 1)
                before = np.concatenate([np.zeros((width, 1)), upto[:, :-1]], 1)
                out.append((int(t.min()), int(t.max()), t[order].astype(np.int64).tobytes() + before.tobytes(), upto[:, -1].tolist(), float(sum((w * c * c).sum() for c in v))))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.float64()), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("_part"), *(pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 5, kinds))], ["rep", "_part", "lo_t", "hi_t", "data", "total", "squares"])

    packed = pinned(grouped.mapInArrow(pack, f"rep {kind}, _part long, lo_t long, hi_t long, data binary, total array<double>, squares double"))
    earlier = Window.partitionBy("rep").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = packed.select("rep", "_part", F.array(*(F.coalesce(F.sum(F.col("total")[i]).over(earlier), F.lit(0.0)) for i in range(width))).alias("base"))
    upto = pinned(packed.drop("total", "squares").join(carried, ["rep", "_part"]))
    whole = packed.groupBy("rep").agg(F.array(*(F.sum(F.col("total")[i]) for i in range(width))).alias("hi_x"), F.sum("squares").alias("squares"), (F.max("hi_t") + 1).alias("hi"))
    def score(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rep, data, base, segments in zip(batch.column("rep").to_pylist(), batch.column("data"), batch.column("base").to_pylist(), batch.column("segments").to_pylist()):
                raw = data.as_buffer()
                n = raw.size // (8 * (width + 1))
                t, x = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, float, n * width, 8 * n).reshape(width, n) + np.array(base)[:, None]
                for s in segments:
                    found = _best_in(t, x, s, least)
                    out += [{"rep": rep} | found] if found else []
            yield pa.RecordBatch.from_pylist(out, pa.schema([batch.schema.field("rep"), *((c, pa.int64()) for c in ("lo", "hi")), *((c, pa.list_(pa.float64())) for c in ("lo_x", "hi_x")), ("at", pa.int64()), ("at_x", pa.list_(pa.float64())), ("gain", pa.float64())]))

    def best(segments: DataFrame) -> DataFrame:
        """The best cut of each segment (rep, lo, hi, lo_x, hi_x): at, at_x, gain; segments without one are left out."""
        mine = segments.groupBy("rep").agg(F.collect_list(F.struct("lo", "hi", "lo_x", "hi_x")).alias("segments"))  # two segments a replicate
        held = upto.join(F.broadcast(mine), "rep").where(F.exists("segments", lambda s: (s["lo"] < F.col("hi_t")) & (s["hi"] > F.col("lo_t"))))
        found = held.select("rep", "data", "base", "segments").mapInArrow(score, f"rep {kind}, lo long, hi long, lo_x array<double>, hi_x array<double>, at long, at_x array<double>, gain double")
        top = found.groupBy("rep", "lo", "hi").agg(F.max_by(F.struct("lo_x", "hi_x", "at", "at_x", "gain"), F.struct("gain", -F.col("at"))).alias("b"))
        return top.select("rep", "lo", "hi", "b.*")

    return _stepwise(whole, best, splits, width)


def _spread(x: Column, columns: int) -> Column:
    """Of the sums x of a segment (rows, then columns): how much its mean explains."""
    return F.aggregate(F.slice(x, 2, columns), F.lit(0.0), lambda a, s: a + s * s) / x[0]


def _explained(x: np.ndarray) -> np.ndarray:
    return (x[1:] * x[1:]).sum(0) / x[0]


def _best_in(t: np.ndarray, x: np.ndarray, s: dict, least: int) -> dict | None:
    """The best cut of a segment among steps t with the sums x before them."""
    lo_x, hi_x = np.array(s["lo_x"])[:, None], np.array(s["hi_x"])[:, None]
    able = np.flatnonzero((t > s["lo"]) & (t < s["hi"]) & (x[0] - lo_x[0] >= least) & (hi_x[0] - x[0] >= least))
    if not len(able):
        return None
    here = x[:, able]
    gain = np.round(_explained(here - lo_x) + _explained(hi_x - here) - _explained(hi_x - lo_x), 6)
    best = int(gain.argmax())  # the first of equals
    return s | {"at": int(t[able[best]]), "at_x": here[:, best].tolist(), "gain": float(gain[best])}


def _stepwise(whole: DataFrame, best: Callable[[DataFrame], DataFrame], splits: int, width: int) -> DataFrame:
    """The cuts of greedy_cuts() from the sums of all replicates (rep, hi, hi_x, squares) and what finds the best cut of segments."""
    zero = F.array(*[F.lit(0.0)] * width)
    first = pinned(whole.select("rep", F.lit(0).cast("long").alias("lo"), "hi", zero.alias("lo_x"), "hi_x", (F.col("squares") - _spread(F.col("hi_x"), width - 1)).alias("error")))
    found = first.select("rep", F.lit(0).alias("step"), F.lit(None).cast("long").alias("at"), "error")
    errors, open_ = first.select("rep", "error"), pinned(best(first.drop("error")))
    for step in range(1, splits + 1):
        taken = pinned(open_.groupBy("rep").agg(F.max_by(F.struct("lo", "hi", "lo_x", "hi_x", "at", "at_x", "gain"), F.struct("gain", -F.col("at"))).alias("b")).select("rep", "b.*").where("gain > 0"))
        if taken.isEmpty():
            break
        errors = pinned(taken.join(errors, "rep").select("rep", "at", (F.col("error") - F.col("gain")).alias("error")))
        found, errors = found.unionByName(errors.select("rep", F.lit(step).alias("step"), "at", "error")), errors.select("rep", "error")
        halves = F.array(F.struct("lo", F.col("at").alias("hi"), "lo_x", F.col("at_x").alias("hi_x")), F.struct(F.col("at").alias("lo"), "hi", F.col("at_x").alias("lo_x"), "hi_x"))
        new = best(taken.select("rep", F.inline(halves))) if step < splits else None
        rest = open_.join(taken.select("rep", "lo", "hi"), ["rep", "lo", "hi"], "left_anti")
        open_ = pinned(rest.unionByName(new)) if new is not None else rest
    return pinned(found)


def bootstrap_cuts(df: DataFrame, columns: list[str], replicates: int, splits: int, least: int, seed: int = 42, chunk: int = 1 << 15) -> DataFrame:
    """greedy_cuts() of replicated(): the cuts of the series and of its bootstrap samples, without a row for each draw. t counts from 0 without gaps.

    Rows are packed by ranges of t. Draws move as two bytes each, and are kept as how often each row of a range came in
    each replicate, a byte a row; the values of a range are kept once for all replicates. A step makes the sums that it needs
    from these in the task.
    """
    width = len(columns) + 1
    chunk = min(chunk, 1 << 16)

    def pack(rows: pa.Table, lo: int) -> pa.Table:
        rows = rows.slice(lo)
        values = np.stack([rows.column(c).to_numpy().astype(float) for c in columns]) if len(rows) else np.zeros((len(columns), 0))
        t = rows.column("t").to_numpy()
        kept = [[int(t[0]) // chunk], [len(t)], [values.tobytes()]] if len(t) else [[], [], []]
        return pa.table([pa.array(x, k) for x, k in zip(kept, (pa.int64(), pa.int64(), pa.binary()))], names=["part", "size", "data"])

    series = written(over_runs(df.select("t", *(F.col(c).cast("double").alias(c) for c in columns)), pack, "part long, size long, data binary", 0, chunk))
    n = series.agg(F.sum("size")).first()[0] or 0

    def picked(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, size in zip(batch.column("part").to_pylist(), batch.column("size").to_pylist()):
                t = draws_of(seed, replicates, part * chunk + np.arange(size)) % n
                rep = np.repeat(np.arange(replicates), size)
                to = (t // chunk).ravel()
                order = np.argsort(to, kind="stable")  # in a range by replicate
                to, t, rep = to[order], (t.ravel()[order] % chunk).astype(np.uint16), rep[order]
                cuts = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
                sizes = [np.bincount(rep[i:j], minlength=replicates).tobytes() for i, j in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(to[cuts[:-1]]), pa.array(sizes, pa.binary()), pa.array([t[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())], ["part", "sizes", "picks"])

    def counted(held: pa.Table) -> pa.Table:
        """How often each row of a range came: a row a replicate, of which the first is the series itself."""
        n_here = chunk
        times = np.zeros((replicates, n_here), np.uint32)
        for sizes, picks in zip(held.column("sizes").combine_chunks(), held.column("picks").combine_chunks()):
            ends, picks = np.concatenate([[0], np.cumsum(np.frombuffer(sizes.as_buffer(), np.int64))]), np.frombuffer(picks.as_buffer(), np.uint16)
            for rep in range(replicates):
                times[rep] += np.bincount(picks[ends[rep] : ends[rep + 1]], minlength=n_here).astype(np.uint32)
        times = times.astype(np.uint8 if times.max(initial=0) < 256 else np.uint32)
        return pa.table([held.column("part")[:1], pa.array([times.itemsize]), pa.array([times.tobytes()], pa.binary())], names=["part", "bytes", "times"])

    drawn = series.select("part", "size").mapInArrow(picked, "part long, sizes binary, picks binary") if replicates else None
    times = drawn.groupBy("part").applyInArrow(counted, "part long, bytes long, times binary") if replicates else None
    both = series if times is None else written(series.hint("merge").join(times, "part", "left"))

    def sums(row: dict, reps) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """rep, t, what each row adds to the sums, and its squared values times how often it came, of the rows that a replicate has."""
        values, t = np.frombuffer(row["data"], float).reshape(len(columns), -1), row["part"] * chunk + np.arange(row["size"])
        times = np.frombuffer(row["times"], np.uint8 if row["bytes"] == 1 else np.uint32).reshape(replicates, -1) if row.get("times") is not None else None
        for rep in reps:
            if rep and times is None:
                continue
            w = times[rep - 1, : len(t)] if rep else np.ones(len(t), np.uint8)
            have = np.flatnonzero(w)
            if len(have):
                w, v = w[have].astype(float), values[:, have]
                yield rep, t[have], np.stack([w, *(w * c for c in v)]), sum((w * c * c).sum() for c in v)

    def totals(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = [(rep, row["part"], int(t[0]), int(t[-1]), x.cumsum(1)[:, -1].tolist(), float(squares)) for rep, t, x, squares in sums(row, range(replicates + 1))]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made) if made else [[]] * 6, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64()))], ["rep", "part", "lo_t", "hi_t", "total", "squares"])

    ends = written(both.mapInArrow(totals, "rep int, part long, lo_t long, hi_t long, total array<double>, squares double"))  # a row for each range and replicate
    earlier = Window.partitionBy("rep").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = written(ends.select("rep", "part", "lo_t", "hi_t", F.array(*(F.coalesce(F.sum(F.col("total")[i]).over(earlier), F.lit(0.0)) for i in range(width))).alias("base")))
    whole = ends.groupBy("rep").agg(F.array(*(F.sum(F.col("total")[i]) for i in range(width))).alias("hi_x"), F.sum("squares").alias("squares"), (F.max("hi_t") + 1).alias("hi"))

    def score(batches) -> Iterator[pa.RecordBatch]:
        kinds = [pa.field("rep", pa.int32()), *((c, pa.int64()) for c in ("lo", "hi")), *((c, pa.list_(pa.float64())) for c in ("lo_x", "hi_x")), ("at", pa.int64()), ("at_x", pa.list_(pa.float64())), ("gain", pa.float64())]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                asked = {x["rep"]: x for x in row["asked"]}
                for rep, t, x, _ in sums(row, sorted(asked)):
                    upto = np.cumsum(x, 1)
                    before = np.concatenate([np.zeros((width, 1)), upto[:, :-1]], 1) + np.array(asked[rep]["base"])[:, None]
                    found = (_best_in(t, before, s, least) for s in asked[rep]["segments"])
                    out += [{"rep": rep} | x for x in found if x]
            yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    def best(segments: DataFrame) -> DataFrame:
        mine = segments.groupBy("rep").agg(F.collect_list(F.struct("lo", "hi", "lo_x", "hi_x")).alias("segments"))  # two segments a replicate
        held = base.join(F.broadcast(mine), "rep").withColumn("segments", F.filter("segments", lambda s: (s["lo"] < F.col("hi_t")) & (s["hi"] > F.col("lo_t")))).where(F.size("segments") > 0)
        asked = held.groupBy("part").agg(F.collect_list(F.struct("rep", "base", "segments")).alias("asked"))
        found = both.hint("merge").join(asked, "part").mapInArrow(score, "rep int, lo long, hi long, lo_x array<double>, hi_x array<double>, at long, at_x array<double>, gain double")
        top = found.groupBy("rep", "lo", "hi").agg(F.max_by(F.struct("lo_x", "hi_x", "at", "at_x", "gain"), F.struct("gain", -F.col("at"))).alias("b"))
        return top.select("rep", "lo", "hi", "b.*")

    return _stepwise(whole, best, splits, width)


def bic_of_cuts(cuts: DataFrame, n: int, columns: int) -> DataFrame:
    """Of the cuts of one replicate (step, at, error): splits, cuts (ascending), error, bic, best (the smallest bic, to 6 digits, with the fewest cuts).

    bic is n ln(error / n) plus ln n for every mean: one for each column of each segment.
    """
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # a row for each cut
    every = Window.partitionBy()
    bic = n * F.ln(F.greatest(F.col("error"), F.lit(0.0)) / n + 1e-10) + (F.col("step") + 1) * columns * math.log(n)
    made = cuts.select(F.col("step").alias("splits"), F.array_join(F.sort_array(F.collect_list("at").over(upto)), ",").alias("cuts"), "error", F.round(bic, 6).alias("bic"))
    return made.withColumn("best", F.col("splits") == F.min_by("splits", F.struct("bic", "splits")).over(every))


def cut_stability(cuts: DataFrame, wanted: int, tolerance: int) -> DataFrame:
    """at, found: of the first wanted cuts of replicate 0, in what share of the other replicates one of as many cuts is within tolerance."""
    used = cuts.where(F.col("step").between(1, wanted))
    real = used.where("rep = 0").select(F.col("at").alias("real"))
    replicates = cuts.where("rep > 0").select("rep").distinct().count()
    near = used.where("rep > 0").join(F.broadcast(real), F.abs(F.col("at") - F.col("real")) <= tolerance).groupBy("real").agg(F.count_distinct("rep").alias("n"))
    return real.join(near, "real", "left").select(F.col("real").alias("at"), (F.coalesce("n", F.lit(0)) / F.lit(max(1, replicates))).alias("found"))


def first_split_stability(df: DataFrame, x: str, replicates: int, least: int, tolerance: int, seed: int = 42) -> DataFrame:
    """at, found: the best single split of the series, and the share of sorted bootstrap samples of its rows whose best split is within tolerance."""
    return cut_stability(bootstrap_cuts(df, [x], replicates, 1, least, seed), 1, tolerance)


def segment_profile(df: DataFrame, x: str, cuts: list[int], symbols: int, k: int = 5) -> DataFrame:
    """Per segment between cuts: rows, chi-square of its symbols against equal shares, p, entropy in bits, its most and least frequent symbols."""
    segment = reduce(lambda a, c: a + (F.col("t") >= c).cast("int"), cuts, F.lit(0))
    counts = df.groupBy(segment.alias("segment"), F.col(x).alias("symbol")).agg(F.count("*").alias("n"))
    every = counts.select("segment").distinct().select("segment", F.explode(F.sequence(F.lit(0), F.lit(symbols - 1))).alias("symbol")).join(counts, ["segment", "symbol"], "left").na.fill(0, ["n"])
    m = F.sum("n")
    made = every.groupBy("segment").agg(m.alias("n"), (F.sum(F.col("n") * F.col("n")) * symbols / m - m).alias("chi2"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "symbol"))).alias("_hot"), F.sort_array(F.collect_list(F.struct("n", "symbol"))).alias("_cold"))
    shares = F.transform("_cold", lambda y: y["n"] / F.col("n"))
    bits = F.aggregate(shares, F.lit(0.0), lambda a, p: a + F.when(p > 0, -p * F.log2(p)).otherwise(0.0))
    names = [F.concat_ws(",", F.transform(F.slice(c, 1, k), lambda y: y["symbol"].cast("string"))).alias(n) for c, n in (("_hot", "hot"), ("_cold", "cold"))]
    return made.select("segment", "n", "chi2", tails.chi_square(F.col("chi2"), symbols - 1).alias("p"), bits.alias("entropy"), *names)


def matrix_profile(df: DataFrame, x: str, m: int, block: int = 2048) -> DataFrame:
    """t, distance, nearest of each run of m values: the z-normalised distance to its nearest other run, at least m / 2 (rounded up) steps off.

    Runs are held in blocks of starts; each pair of blocks is one task of bounded size. It is quadratic in the series,
    as the question is; ties go to the earlier run.
    """
    runs = over_chunks(df.select("t", F.col(x).cast("double").alias("v")), lambda w: {"run": F.collect_list("v").over(w.rowsBetween(-m + 1, 0))}, m - 1).where(F.size("run") == m).select((F.col("t") - m + 1).alias("t"), "run")
    runs = pinned(runs.withColumn("_block", F.floor(F.col("t") / block).cast("int")))
    blocks = runs.select("_block").distinct()
    n = blocks.agg(F.collect_list("_block").alias("_all"))  # a number for each block
    left = runs.join(F.broadcast(n)).withColumn("_other", F.explode("_all")).drop("_all")
    right = runs.join(F.broadcast(n)).select(F.col("t").alias("u"), F.col("run").alias("other"), F.explode("_all").alias("_mine"), F.col("_block").alias("_own"))
    off = -(-m // 2)

    def normal(runs: pd.Series) -> np.ndarray:
        a = np.vstack(runs.to_numpy()).astype(float)
        spread = a.std(1, keepdims=True)
        return (a - a.mean(1, keepdims=True)) / np.where(spread > 0, spread, np.inf)

    def near(key: tuple, mine: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(other):
            return pd.DataFrame({"t": [], "distance": [], "nearest": []}).astype({"t": "int64", "distance": "float64", "nearest": "int64"})
        other = other.sort_values("u")
        a, b, ts, us = normal(mine["run"]), normal(other["other"]), mine["t"].to_numpy(), other["u"].to_numpy()
        out_d, out_n = np.full(len(a), np.inf), np.full(len(a), -1)
        for lo in range(0, len(a), 256):
            q = a[lo : lo + 256]
            d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * q @ b.T, 0)).round(9)
            d[np.abs(ts[lo : lo + 256, None] - us[None]) < off] = np.inf
            best = d.argmin(1)
            out_d[lo : lo + 256], out_n[lo : lo + 256] = d[np.arange(len(q)), best], us[best]
        good = np.isfinite(out_d)
        return pd.DataFrame({"t": ts[good], "distance": out_d[good], "nearest": out_n[good]})

    parts = left.groupBy("_block", "_other").cogroup(right.groupBy("_mine", "_own")).applyInPandas(near, "t long, distance double, nearest long")
    return parts.groupBy("t").agg(F.min(F.struct("distance", "nearest")).alias("x")).select("t", "x.*")


def motifs(profile: DataFrame, m: int, k: int, most: bool = False) -> list[tuple[int, int, float, int]]:
    """(place, t, distance, nearest) of the k smallest distances of a profile (largest, with most), no two closer than m steps.

    Greedy over the best rows: k times 4m of them hold the answer, as each pick rules out fewer than 2m starts, and two
    more around its nearest.
    """
    order = F.desc("distance") if most else F.asc("distance")
    rows = profile.orderBy(order, "t").limit(k * 4 * m).collect()  # bounded by k and m
    out: list[tuple[int, int, float, int]] = []
    for r in rows:
        if len(out) < k and all(abs(r.t - t) >= m and (most or abs(r.t - n) >= m) for _, t, _, n in out):
            out.append((len(out) + 1, r.t, r.distance, r.nearest))
    return out


def label_communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """item, label after so many rounds in which every node takes the label of the largest summed weight around it (a, b, w), its own among them at weight 0; ties go to the smaller label."""
    both = pinned(edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    labels = both.select(F.col("a").alias("item")).distinct().withColumn("label", F.col("item"))
    for _ in range(rounds):
        votes = both.join(labels.toDF("b", "label"), "b").groupBy(F.col("a").alias("item"), "label").agg(F.sum("w").alias("w"))
        labels = pinned(votes.groupBy("item").agg(F.max_by("label", F.struct(F.round("w", 6), -F.col("label"))).alias("label")))
    return labels


def representations(items: DataFrame, events: DataFrame, width: int = 10, steps: DataFrame | None = None) -> DataFrame:
    """mode, t, token: baskets as raw items, as decades, and as event tokens, so that one miner serves all, keyed by mode.

    steps: the baskets of items as (t, xs), if they are at hand; decades are then made in their rows, without a shuffle.
    """
    raw = items.select(F.lit("raw").alias("mode"), "t", F.col("item").cast("string").alias("token"))
    decade = lambda item: F.floor((item - 1) / width).cast("string")
    if steps is None:
        decades = items.select(F.lit("decade").alias("mode"), "t", decade(F.col("item")).alias("token")).distinct()
    else:
        decades = steps.select(F.lit("decade").alias("mode"), "t", F.explode(F.array_distinct(F.transform("xs", decade))).alias("token"))
    return raw.unionByName(decades).unionByName(events.select(F.lit("event").alias("mode"), "t", F.col("event").alias("token")))


def _counted(chunk: int, last: int):
    """Of the tokens of a mode and run of steps: how often a comes in one of its steps and b in the next (own steps only), and how often each comes as a (b null) and as b (a null)."""

    def count(held: pa.Table) -> pa.Table:
        codes = held.column("token").combine_chunks().dictionary_encode()
        t, code, size = held.column("t").to_numpy(), codes.indices.to_numpy(), len(codes.dictionary)
        order = np.argsort(t, kind="stable")
        t, code = t[order], code[order].astype(np.int64)
        own = t // chunk == held.column("_chunk")[0].as_py()
        first = np.searchsorted(t, t + 1)
        n = np.where(own, np.searchsorted(t, t + 1, "right") - first, 0)
        place = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        code_own = code[own]
        now, later = code_own[t[own] < last], code_own[t[own] >= 1]
        key, times = np.unique(np.concatenate([np.repeat(code, n) * (size + 1) + code[place], now * (size + 1) + size, size * (size + 1) + later]), return_counts=True)
        name = lambda k: codes.dictionary.take(pa.array(k, mask=k == size))
        mode = pa.repeat(held.column("mode")[0], len(key))
        return pa.table([mode, name(key // (size + 1)), name(key % (size + 1)), pa.array(times)], names=["mode", "a", "b", "n"])

    return count


def pattern_family(tokens: DataFrame, steps: int, support: dict[str, int], alpha: float = 0.05, chunk: int = 1 << 14) -> DataFrame:
    """Per mode: pairs (a now, b a step later) with the mode's support, tested by Fisher and corrected over all modes at once: tested, significant.

    Tokens are read and dealt out once, by mode and runs of chunk steps, each with the step after it; the pairs of a run are counted before they move.
    """
    own = F.floor(F.col("t") / chunk)
    copies = F.when(F.col("t") % chunk == 0, F.array(own, own - 1)).otherwise(F.array(own))
    spread = tokens.select("mode", "t", "token", F.explode(copies).alias("_chunk"))
    found = spread.groupBy("mode", "_chunk").applyInArrow(_counted(chunk, steps - 1), "mode string, a string, b string, n long")
    counts = pinned(found.groupBy("mode", "a", "b").agg(F.sum("n").alias("n")))  # of patterns, not steps
    least = F.create_map(*(F.lit(x) for kv in support.items() for x in kv))
    pairs = counts.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("n") >= F.element_at(least, F.col("mode"))))
    inside, later = counts.where("b is null").select("mode", "a", F.col("n").alias("na")), counts.where("a is null").select("mode", "b", F.col("n").alias("nb"))
    rows, m = pairs.join(inside, ["mode", "a"]).join(later, ["mode", "b"]), F.lit(steps - 1).cast("long")
    p = tails.fisher_greater(F.col("n"), F.col("na") - F.col("n"), F.col("nb") - F.col("n"), m - F.col("na") - F.col("nb") + F.col("n"))
    tested = pinned(rows.select("mode", "a", "b", p.alias("p")))
    ranked = tested.withColumn("_r", F.rank().over(Window.orderBy("p"))).withColumn("_m", F.lit(tested.count()))  # one row a pattern, not a step
    step_up = F.min(F.col("p") * F.col("_m") / F.col("_r")).over(Window.orderBy(F.desc("_r")).rangeBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("_q", step_up).groupBy("mode").agg(F.count("*").alias("tested"), F.count_if(F.col("_q") < alpha).alias("significant"))


def context_label(rule: str, steps: int, t: Column | None = None, day: Column | None = None, covariate: Column | None = None, middle: Column | None = None, recent: int = 500) -> Column:
    """True, false or null of a step by a rule: recent (the last so many steps against as many before; halves of a short series), season (April to September), or a covariate above its median."""
    if rule == "recent":
        n = min(recent, steps // 2)
        return F.when(t >= steps - n, True).when(t >= steps - 2 * n, False)
    if rule == "season":
        return F.month(day).between(4, 9)
    return covariate > middle
