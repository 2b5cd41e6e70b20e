"""Tests by permutation of lags and dependence, and summaries of probability sets over lags.

Rows that are permuted are numbered once; each replicate deals its rows out by ranges of their draws, so no replicate is
sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import pinned, written
from .resampling import draw, draws_of
from .series import over_runs, with_ordinal


def permuted(rows: DataFrame, moved: list[str], replicates: int, seed: int = 42, by: list[str] | None = None, chunk: int = 4096) -> DataFrame:
    """rows (i from 0 within each group of by) with the moved columns of another row of the group, for each replicate rep.

    The k-th row in the order of a replicate's hashes gives its moved columns to row k. rows may be wide, and pack well,
    so they are never broadcast.
    """
    by = by or []
    n = max(1, -(-rows.count() // chunk))
    reps = rows.select(*by, "i", *moved, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")).withColumn("_draw", draw(seed, "rep", *by, "i"))
    reps = reps.withColumn("_range", F.floor(F.col("_draw") / F.lit((1 << 48) / n)))
    before = Window.partitionBy(*by, "rep").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = reps.groupBy(*by, "rep", "_range").agg(F.count("*").alias("_n")).select(*by, "rep", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy(*by, "rep", "_range").orderBy("_draw", "i")) - 1
    given = reps.withColumn("_place", place).join(offsets.hint("merge"), [*by, "rep", "_range"]).select(*by, "rep", (F.col("_place") + F.col("_offset")).alias("i"), *moved)
    return given.join(rows.drop(*moved).hint("merge"), [*by, "i"])


def _against(observed: DataFrame, stats: DataFrame, replicates: int, by: list[str]) -> DataFrame:
    """Per group the observed statistic, the null's mean and 95th percentile, and the one-sided p with the plus one."""
    held = stats.join(observed, by) if by else stats.join(F.broadcast(observed))
    return held.groupBy(*by, "observed").agg(F.avg("stat").alias("null_mean"), F.expr("percentile(stat, 0.95)").alias("null_p95"), ((1 + F.count_if(F.col("stat") >= F.col("observed"))) / (replicates + 1)).alias("p"))


@dataclass(frozen=True)
class _Lag:
    """The pairs of one lag among those that are permuted: set t = i - start + lo meets outcome t + lag, for size values of i from start on."""

    group: int
    lag: int
    start: int
    size: int
    lo: int


def _lags(lags: Sequence[int], steps: int, pooled: bool) -> list[_Lag]:
    out: list[_Lag] = []
    for lag in lags:
        size = max(0, steps - abs(lag))
        out.append(_Lag(0 if pooled else len(out), lag, sum(x.size for x in out) if pooled else 0, size, max(0, -lag)))
    return out


def _digits(x: np.ndarray) -> list[np.ndarray]:
    return [(x // 100).astype(np.int16), (x // 10 % 10).astype(np.int8), (x % 10).astype(np.int8)]


def _agreed(sets: list[np.ndarray], came: np.ndarray, least: int) -> tuple[int, int]:
    """How many outcomes (-1: unknown) agree with a member of their set (row, member; -1: no set) in least positions, and how many are known."""
    known = (came >= 0) & (sets[0][:, 0] >= 0)
    alike = sum(((x == y[:, None]).view(np.int8) for x, y in zip(sets[1:], _digits(came)[1:])), (sets[0] == _digits(came)[0][:, None]).view(np.int8))
    return int(((alike >= least).any(1) & known).sum()), int(known.sum())


def _set_runs(chosen: DataFrame, lags: Sequence[int], least: int, run: int) -> DataFrame:
    """run, size, sets, came, hits, known: sets (t, chosen) and outcomes (t, actual) of runs of steps, packed, and for each lag how many pairs of a run agree and are known."""

    def pack(rows: pa.Table, lo: int) -> pa.Table:
        lists = rows.column("chosen").combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        width = max(1, int(sizes.max(initial=0)))
        place = np.arange(width)[None, :]
        flat = np.append(lists.flatten().to_numpy(zero_copy_only=False), -1).astype(np.int16)
        first = (np.cumsum(sizes) - sizes)[:, None]
        sets = np.where(sizes[:, None] > 0, flat[np.minimum(first + np.minimum(place, np.maximum(sizes[:, None] - 1, 0)), len(flat) - 1)], -1).astype(np.int16)
        came = rows.column("actual").fill_null(-1).to_numpy().astype(np.int16)
        digits, hits, known = _digits(sets), [], []
        for lag in lags:  # the later one of a pair is a row of its own run
            here = np.arange(max(lo, abs(lag)), len(rows))
            n = _agreed([x[here - max(lag, 0)] for x in digits], came[here + min(lag, 0)], least)
            hits.append(n[0])
            known.append(n[1])
        if lo == len(rows):
            return pa.table([pa.array([], x) for x in (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))], names=names)
        t = rows.column("t")[lo].as_py()
        return pa.table([pa.array([t // run]), pa.array([len(rows) - lo]), pa.array([sets[lo:].tobytes()], pa.binary()), pa.array([came[lo:].tobytes()], pa.binary()), pa.array([hits], pa.list_(pa.int64())), pa.array([known], pa.list_(pa.int64()))], names=names)

    names = ["run", "size", "sets", "came", "hits", "known"]
    return over_runs(chosen.select("t", "actual", "chosen"), pack, "run long, size long, sets binary, came binary, hits array<long>, known array<long>", max(map(abs, lags)), run)


def _permuted_agreement(chosen: DataFrame, lags: Sequence[int], replicates: int, least: int, pooled: bool, seed: int, chunk: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Of sets and outcomes (t from 0 without gaps, chosen, actual) the observed share of pairs that agree (lag, n, observed) and the shares of the replicates (lag, rep, stat); lag is 0 if lags are pooled.

    Sets and outcomes are packed by runs of steps and written once. Outcomes move as blocks of numbers, by ranges of their
    draws, of about 10 chunk pairs of each lag and replicate; the places of a range are close to each other in all of them, so its
    sets come to it once. Replicates are done in turns of at most about most pairs, each of which leaves no shuffle files to the next.
    """
    run = 1 << 15 if chunk >= 4096 else 4 * chunk
    packed = written(_set_runs(chosen, lags, least, run))
    steps = packed.agg(F.sum("size")).first()[0] or 0
    parts = [x for x in _lags(lags, steps, pooled) if x.size]
    groups = list(dict.fromkeys(x.group for x in parts))
    pairs = sum(x.size for x in parts)
    ranges = max(1, -(-pairs // (len(groups) or 1) // (10 * chunk)))
    width = (1 << 48) / ranges
    name = {x.group: 0 if pooled else x.lag for x in parts}

    def dealt(t: np.ndarray, x: _Lag, reps: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of outcomes t those that have a pair, and its draws and ranges by replicate."""
        i = t - x.lag - x.lo
        mine = np.flatnonzero((i >= 0) & (i < x.size))
        found = draws_of(seed, [str(rep) if pooled else f"{rep}:{x.lag}" for rep in reps], i[mine] + x.start)
        return mine, found, (found / width).astype(np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(groups), replicates, ranges), np.int64)
        for batch in batches:
            for number, size in zip(batch.column("run").to_pylist(), batch.column("size").to_pylist()):
                for x in parts:
                    for rep, place in enumerate(dealt(number * run + np.arange(size), x, range(1, replicates + 1))[2]):
                        n[groups.index(x.group), rep] += np.bincount(place, minlength=ranges)
        group, rep, place = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(groups, np.int32)[group]), pa.array((rep + 1).astype(np.int32)), pa.array(place), pa.array(n[group, rep, place])], ["group", "rep", "range", "n"])

    def turn(reps: range) -> DataFrame:
        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, size, came in zip(batch.column("run").to_pylist(), batch.column("size").to_pylist(), batch.column("came")):
                    came, t = np.frombuffer(came.as_buffer(), np.int16), number * run + np.arange(size)
                    place, draws, outcomes, sort = [], [], [], []
                    for k, x in enumerate(parts):
                        mine, found, where = dealt(t, x, reps)
                        place.append(where.ravel())
                        draws.append(found.ravel())
                        outcomes.append(np.tile(came[mine], len(reps)))
                        sort.append(np.repeat(np.arange(len(reps)) + k * len(reps), len(mine)))
                    place, draws, outcomes, sort = map(np.concatenate, (place, draws, outcomes, sort))
                    order = np.argsort(place, kind="stable")  # in a range by lag, replicate and t
                    place, draws, outcomes, sort = place[order], draws[order], outcomes[order], sort[order]
                    cuts = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
                    cut = lambda values: pa.array([values[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())
                    sizes = pa.array([np.bincount(sort[i:j], minlength=len(parts) * len(reps)).tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(place[cuts[:-1]]), pa.array([number] * (len(cuts) - 1), pa.int64()), sizes, cut(draws), cut(outcomes)], ["range", "run", "sizes", "draws", "came"])

        def matched(moved: pa.Table, near: pa.Table) -> pa.Table:
            moved, near = moved.sort_by("run"), near.sort_by("run")
            read = lambda column, kind: [np.frombuffer(x.as_buffer(), kind) for x in column.combine_chunks()]
            ends = [np.concatenate([[0], np.cumsum(x)]) for x in read(moved.column("sizes"), np.int64)]
            draws, came = read(moved.column("draws"), np.int64), read(moved.column("came"), np.int16)
            held = [x.reshape(n, -1) for x, n in zip(read(near.column("sets"), np.int16), near.column("size").to_pylist())]
            wide = max(x.shape[1] for x in held)
            digits = _digits(np.concatenate([np.pad(x, ((0, 0), (0, wide - x.shape[1])), "edge") for x in held]))
            runs, first = near.column("run").to_numpy(), np.cumsum([0, *map(len, held)])
            offsets = {(x["group"], x["rep"]): x["offset"] for some in near.column("offsets").to_pylist() for x in some or []}
            out = []
            for group in groups:
                mine = [k for k, x in enumerate(parts) if x.group == group]
                for r, rep in enumerate(reps):
                    at = [k * len(reps) + r for k in mine]
                    found = np.concatenate([x[e[k] : e[k + 1]] for k in at for x, e in zip(draws, ends)])
                    if not len(found):
                        continue
                    order = np.argsort(found)
                    if (np.diff(found[order]) == 0).any():
                        order = np.argsort(found, kind="stable")  # of equal draws the smaller i
                    outcome = np.concatenate([x[e[k] : e[k + 1]] for k in at for x, e in zip(came, ends)])[order]
                    lo, hits, known = offsets[group, rep], 0, 0
                    for x in (parts[k] for k in mine):
                        a, b = max(lo, x.start), min(lo + len(found), x.start + x.size)
                        if a < b:
                            t = np.arange(a, b) - x.start + x.lo
                            place = first[np.searchsorted(runs, t // run)] + t % run
                            n = _agreed([y[place] for y in digits], outcome[a - lo : b - lo], least)
                            hits, known = hits + n[0], known + n[1]
                    out.append((group, rep, hits, known))
            return pa.table([pa.array(x, kind) for x, kind in zip(zip(*out) if out else [[]] * 4, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["group", "rep", "hits", "known"])

        mine = offset.where(F.col("rep").between(reps[0], reps[-1]))
        every = F.array(*(F.struct(*(F.lit(v).cast("long").alias(n) for n, v in (("group", x.group), ("start", x.start), ("size", x.size), ("lo", x.lo)))) for x in parts))
        spans = mine.groupBy("range", "group").agg(F.min("offset").alias("a"), F.max(F.col("offset") + F.col("n")).alias("b")).select("*", F.explode(every).alias("x")).where("group = x.group")
        inside = spans.select("range", F.greatest("a", "x.start").alias("a"), F.least("b", F.col("x.start") + F.col("x.size")).alias("b"), (F.col("x.lo") - F.col("x.start")).alias("off")).where("a < b")
        runs = inside.select("range", F.explode(F.sequence(F.floor((F.col("a") + F.col("off")) / run), F.floor((F.col("b") - 1 + F.col("off")) / run))).alias("run")).distinct()
        nth = F.row_number().over(Window.partitionBy("range").orderBy("run"))  # the first run of a range brings its offsets
        wanted = runs.withColumn("_nth", nth).join(mine.groupBy("range").agg(F.collect_list(F.struct("group", "rep", "offset")).alias("offsets")), "range").withColumn("offsets", F.when(F.col("_nth") == 1, F.col("offsets"))).drop("_nth")
        near = wanted.join(packed.select("run", "size", "sets").hint("merge"), "run")
        moved = packed.select("run", "size", "came").mapInArrow(blocks, "range long, run long, sizes binary, draws binary, came binary")
        hits = moved.groupBy("range").cogroup(near.groupBy("range")).applyInArrow(matched, "group int, rep int, hits long, known long")
        return hits.groupBy("group", "rep").agg(F.try_divide(F.sum("hits"), F.sum("known")).alias("stat"))

    sizes = packed.select("run", "size").mapInArrow(counted, "group int, rep int, range long, n long").groupBy("group", "rep", "range").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("group", "rep").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offset = pinned(sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))))  # of ranges, lags and replicates
    each = max(1, most // max(1, pairs))
    turns = [range(lo, min(lo + each, replicates + 1)) for lo in range(1, replicates + 1, each)]
    stats = reduce(DataFrame.unionByName, [pinned(turn(x)) for x in turns]) if parts else None
    held = packed.select(F.posexplode(F.arrays_zip("hits", "known")).alias("at", "x")).select(F.lit(0).alias("lag") if pooled else F.element_at(F.array(*map(F.lit, lags)), F.col("at") + 1).alias("lag"), "x.*")
    observed = held.groupBy("lag").agg(F.try_divide(F.sum("hits"), F.sum("known")).alias("observed"), F.lit(pairs).cast("long").alias("n"))
    if stats is None:
        return observed, observed.select("lag", F.lit(1).alias("rep"), "observed").toDF("lag", "rep", "stat").limit(0)
    lag = F.element_at(F.create_map(*(F.lit(v) for kv in name.items() for v in kv)), F.col("group")).alias("lag")
    return observed, stats.select(lag, "rep", "stat")


def pooled_lag_test(chosen: DataFrame, lags: tuple[int, ...], replicates: int, least: int = 2, chunk: int = 4096, most: int = 1 << 26) -> DataFrame:
    """Share of (prediction, outcome lag steps on) that agree in least positions, over all lags at once, against permuted outcomes."""
    seen, stats = _permuted_agreement(chosen, lags, replicates, least, True, 42, chunk, most)
    return _against(seen.select("lag", "observed"), stats, replicates, ["lag"]).join(F.broadcast(seen.select("n"))).select("n", "observed", "null_mean", "p")


def lag_cells(chosen: DataFrame, lags: list[int], replicates: int, least: int = 2, chunk: int = 4096, most: int = 1 << 26) -> DataFrame:
    """lag, observed, null_mean, null_p95, p: as pooled_lag_test() for each lag apart."""
    seen, stats = _permuted_agreement(chosen, lags, replicates, least, False, 42, chunk, most)
    return _against(seen.drop("n"), stats, replicates, ["lag"])


def cell_count(cells: DataFrame, alpha: float) -> DataFrame:
    """How many cells there are, how many below alpha, and how many of these chance would give."""
    return cells.agg(F.count("*").alias("cells"), F.count_if(F.col("p") < alpha).alias("found"), (F.count("*") * alpha).alias("expected"))


def shuffled_information(df: DataFrame, x: str, y: str, replicates: int) -> DataFrame:
    """Mutual information (nats) of two discrete columns against y shuffled over the rows of (t, x, y)."""
    rows = pinned(with_ordinal(df, ["t"], "i").select("i", x, y))
    both = permuted(rows, [y], replicates).select("rep", x, y).unionByName(rows.select(F.lit(0).alias("rep"), x, y))
    cells = pinned(both.groupBy("rep", x, y).agg(F.count("*").alias("n")))
    left, right, total = (cells.groupBy("rep", *k).agg(F.sum("n").alias(name)) for k, name in (([x], "nx"), ([y], "ny"), ([], "m")))
    joint = cells.join(left, ["rep", x]).join(right, ["rep", y]).join(total, "rep")
    each = joint.groupBy("rep").agg(F.round(F.sum(F.col("n") / F.col("m") * F.log(F.col("n") * F.col("m") / (F.col("nx") * F.col("ny")))), 9).alias("stat"))
    return _against(each.where("rep = 0").select(F.col("stat").alias("observed")), each.where("rep > 0"), replicates, [])


def shuffled_steps(items: DataFrame, steps: int, replicates: int, seed: int = 42) -> DataFrame:
    """rep, t, item: the baskets of items in a random order of the steps, for each replicate; a basket stays together."""
    order = permuted(items.sparkSession.range(steps).select(F.col("id").alias("i"), F.col("id").alias("_from")), ["_from"], replicates, seed)
    return order.select("rep", F.col("i").alias("_to"), F.col("_from").alias("t")).join(items, "t").select("rep", F.col("_to").alias("t"), "item")


def exceedance(real: DataFrame, value: str, null: DataFrame, null_value: str) -> DataFrame:
    """How many real values are above the null's 95th percentile, and the mean, spread and most of the null."""
    cut = null.agg(F.expr(f"percentile({null_value}, 0.95)").alias("null_p95"), F.avg(null_value).alias("mean"), F.stddev_samp(null_value).alias("sd"), F.max(null_value).alias("most"))
    return real.join(F.broadcast(cut)).groupBy("null_p95", "mean", "sd", "most").agg(F.count("*").alias("n"), F.count_if(F.col(value) > F.col("null_p95")).alias("above"))


def digit_summary(rows: DataFrame, sets: dict[str, str], k: int) -> DataFrame:
    """t, position, best: the k likeliest symbols of each position with their chances in thousandths."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("position"), F.col(p).alias("p")) for c, p in sets.items()))).alias("x")
    order = F.array_sort(F.transform(F.col("x.p"), lambda v, i: F.struct((-F.round(v, 9)).alias("less"), i.alias("symbol"))))
    text = F.transform(F.slice(order, 1, k), lambda v: F.concat(v["symbol"].cast("string"), F.lit(":"), F.round(-v["less"] * 1000).cast("long").cast("string")))
    return rows.select("t", each).select("t", "x.position", F.concat_ws(" ", text).alias("best"))


def lag_logloss(rows: DataFrame, sets: dict[str, str], outcomes: DataFrame, ahead: int) -> DataFrame:
    """lag, position, n, log_loss of the sets of t against the outcome lag steps on, and the lag's weight exp(-lag)."""
    spread = rows.select("t", *sets.values(), F.explode(F.sequence(F.lit(0), F.lit(ahead))).alias("lag")).withColumn("_at", F.col("t") + F.col("lag"))
    held = spread.join(outcomes.select(F.col("t").alias("_at"), *sets), "_at")
    own = F.explode(F.array(*(F.struct(F.lit(c).alias("position"), F.element_at(p, F.col(c) + 1).alias("own")) for c, p in sets.items()))).alias("x")
    return held.select("lag", own).groupBy("lag", "x.position").agg(F.count("*").alias("n"), F.avg(-F.log("x.own")).alias("log_loss")).withColumn("weight", F.exp(-F.col("lag")))


def straight_ev(ranked: DataFrame, by: str, payout: float, most: int) -> DataFrame:
    """Per configuration the number of tickets with the largest expected value (ties to fewer): k, n, hit, ev, per_unit, top1."""
    hits = ranked.groupBy(by).agg(F.count("*").alias("n"), F.avg((F.col("rank") == 1).cast("int")).alias("top1"), F.array(*(F.avg((F.col("rank") <= k).cast("int")) for k in range(1, most + 1))).alias("hits"))
    each = hits.select(by, "n", "top1", F.posexplode("hits").alias("k", "hit")).withColumn("k", F.col("k") + 1).withColumn("ev", F.col("hit") * payout - F.col("k"))
    best = each.groupBy(by).agg(F.max_by(F.struct("k", "n", "hit", "ev", "top1"), F.struct(F.round("ev", 9), -F.col("k"))).alias("x"))
    return best.select(by, "x.k", "x.n", "x.hit", "x.ev", (F.col("x.ev") / F.col("x.k")).alias("per_unit"), "x.top1")
