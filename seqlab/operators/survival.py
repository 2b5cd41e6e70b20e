"""Survival panels and models of waiting times, and processes scored over blocks of steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..storage import pinned
from .items import pair_counts
from .series import neighbours


def _pairs(baskets: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Step and item of each element of baskets (t, xs), in the order of steps."""
    xs = baskets.field("xs")
    t = np.repeat(baskets.field("t").to_numpy(zero_copy_only=False), pc.list_value_length(xs).to_numpy(zero_copy_only=False))
    order = np.argsort(t, kind="stable")
    return t[order], xs.flatten().to_numpy(zero_copy_only=False)[order]


def _rolling(gaps: np.ndarray, n: int) -> list[np.ndarray]:
    """Mean, spread, least and most of the last n values up to each one."""
    padded = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), gaps]), n) if len(gaps) else np.zeros((0, 1))
    return [f(padded, axis=1) for f in (np.nanmean, np.nanstd, np.nanmin, np.nanmax)] if len(gaps) else [np.zeros(0)] * 4


def survival_panel(items: DataFrame, steps: DataFrame, domain: DataFrame, first: int, last: int, gaps: tuple[int, ...] = (5, 10, 20), uses: tuple[int, ...] = (20, 50, 100), partners: int = 5, piece: int = 1 << 14) -> DataFrame:
    """One row for each item of domain and step first .. last - 1, from what was known before the step, and event, whether the item came in it.

    since: steps since the last hit (t + 1 before any). gap_<mean, sd, least, most>_<n>: over the last n completed gaps, 0
    without any. uses_<n>: hits in the n steps before t. run, direction: how many steps before t the item has come (1) or
    stayed out (-1) without a break. runs_ratio: runs of absence over runs of presence so far, each at least 1. partners:
    how many of the items it came with most often came in the step before. prev_total, prev_range, prev_odd, was_max: of
    that step's basket.

    Baskets are dealt out once, by ranges of piece steps. What a range has to know of the ones before it is an item's last
    max(uses) hits and its islands so far; it is carried over the ends of the ranges, one row each. So rows of the panel
    are made where a range's baskets are and never move. items are the hits (t, item) from step 0, steps all baskets
    (t, xs); domain is a list of items that fits a broadcast.
    """
    spark, held, t = steps.sparkSession, max(*uses, max(gaps) + 1), F.col("t")
    from_, upto = first // piece, (last - 1) // piece
    kind, inner = domain.schema["item"].dataType, steps.schema["xs"].dataType.elementType
    own = F.floor(t / piece)
    copies = F.when(t % piece == piece - 1, F.array(own, own + 1)).otherwise(F.array(own))  # the last basket is the one before the next range's first step
    dealt = steps.where((t >= 0) & (t < last)).select(F.explode(copies).alias("chunk"), F.struct(t.cast("long").alias("t"), "xs").alias("b"))
    packed = pinned(dealt.groupBy("chunk").agg(F.collect_list("b").alias("baskets")))

    def ends(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, baskets in zip(batch.column("chunk").to_pylist(), batch.column("baskets")):
                at, item = _pairs(baskets.values)
                at, item = at[at >= chunk * piece], item[at >= chunk * piece]
                found = []
                for k in np.unique(item):
                    h = np.unique(at[item == k])
                    opens = h[np.concatenate([[True], h[1:] > h[:-1] + 1])]
                    found.append((chunk, int(k), int(h[0]), len(opens), int(opens[-1]), h[-held:].tolist()))
                yield pa.RecordBatch.from_pylist([dict(zip(end_schema.names, r)) for r in found], end_schema)

    end_schema = pa.schema([("chunk", pa.int64()), ("item", pa.int64()), ("lo", pa.int64()), ("opens", pa.int64()), ("start", pa.int64()), ("recent", pa.list_(pa.int64()))])

    def carry(mine: pd.DataFrame) -> pd.DataFrame:
        """What was known of an item before each range."""
        have = {r.chunk: r for r in mine.itertuples()}
        recent, islands, start, begun, out = [], 0, -1, -1, []
        for chunk in range(upto + 1):
            if chunk >= from_:
                out.append((chunk, mine["item"].iloc[0], recent, islands, start, begun))
            if chunk in have:
                r = have[chunk]
                goes_on = bool(recent) and recent[-1] == r.lo - 1
                start = start if goes_on and r.opens == 1 else r.start
                islands, begun = islands + r.opens - goes_on, r.lo if begun < 0 else begun
                recent = [*recent, *r.recent][-held:]
        return pd.DataFrame(out, columns=["chunk", "item", "recent", "islands", "start", "begun"])

    found = packed.mapInArrow(ends, "chunk long, item long, lo long, opens long, start long, recent array<long>")
    carried = found.groupBy("item").applyInPandas(carry, "chunk long, item long, recent array<long>, islands long, start long, begun long")  # a row for each range
    state = carried.groupBy("chunk").agg(F.collect_list(F.struct("item", "recent", "islands", "start", "begun")).alias("state"))
    pairs = pair_counts(items)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    top = both.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).where(F.col("_r") <= partners).groupBy(F.col("a").alias("item")).agg(F.collect_set("b").alias("top"))
    every = domain.select("item").join(top, "item", "left").agg(F.collect_list(F.struct(F.col("item").cast("long").alias("item"), F.coalesce("top", F.array().cast(top.schema["top"].dataType)).alias("top"))).alias("domain"))
    ranges = spark.range(from_, upto + 1).select(F.col("id").alias("chunk")).join(packed, "chunk", "left").join(state, "chunk", "left")
    stats = [f"gap_{k}_{n}" for n in gaps for k in ("mean", "sd", "least", "most")]
    big, small = inner.simpleString(), "int"
    types = {"item": kind.simpleString(), "t": "bigint", "event": small, "since": "bigint"} | {c: "double" for c in stats} | {f"uses_{n}": small for n in uses} | {"run": "bigint", "direction": small, "runs_ratio": "double"}
    types |= {"partners": small, "prev_total": "bigint", "prev_range": big, "prev_odd": small, "was_max": small}
    arrow = to_arrow_schema(StructType.fromDDL(", ".join(f"{c} {k}" for c, k in types.items())))

    def panel(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                chunk, baskets, state, every = (batch.column(c)[row] for c in ("chunk", "baskets", "state", "domain"))
                lo, hi = max(first, chunk.as_py() * piece), min(last, (chunk.as_py() + 1) * piece)
                ts, size = np.arange(lo, hi), hi - lo
                at, item = _pairs(baskets.values) if baskets.is_valid else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                before = (at >= lo - 1) & (at < hi - 1)
                slot, was = at[before] + 1 - lo, item[before].astype(np.int64)
                total, odd, most, least, full = np.zeros(size, np.int64), np.bincount(slot[was % 2 == 1], minlength=size), np.full(size, -(1 << 62)), np.full(size, 1 << 62), np.bincount(slot, minlength=size) > 0
                np.add.at(total, slot, was)
                np.maximum.at(most, slot, was)
                np.minimum.at(least, slot, was)
                seen = {s["item"]: s for s in state.as_py() or []}
                for e in every.as_py():
                    k = e["item"]
                    s = seen.get(k, {"recent": [], "islands": 0, "start": -1, "begun": -1})
                    here = np.unique(at[(item == k) & (at >= chunk.as_py() * piece)])
                    r, h = len(s["recent"]), np.concatenate([np.array(s["recent"], np.int64), here])
                    upto_t = np.searchsorted(h, ts)
                    known, j = upto_t > 0, np.maximum(upto_t - 1, 0)
                    opens = h != np.concatenate([[-9], h[:-1]]) + 1
                    # of each hit; of the carried ones only the last is asked for
                    islands = np.concatenate([np.full(r, s["islands"]), s["islands"] + np.cumsum(opens[r:])])
                    start = np.concatenate([np.full(r, s["start"]), np.maximum.accumulate(np.where(opens[r:], h[r:], s["start"]))])
                    hit = np.where(known, h[j], -1) if len(h) else np.full(size, -1)
                    present = known & (hit == ts - 1)
                    islands, start = (np.where(known, x[j], 0) if len(h) else np.zeros(size, np.int64) for x in (islands, start))
                    at_once = (s["begun"] if r else h[0] if len(h) else -1) == 0
                    out = {"item": np.full(size, k), "t": ts, "event": np.isin(ts, here), "since": np.where(known, ts - hit, ts + 1)}
                    for n in gaps:
                        for name, x in zip(("mean", "sd", "least", "most"), _rolling(np.diff(h).astype(float), n)):
                            out[f"gap_{name}_{n}"] = np.concatenate([[0.0], x])[j]
                    out |= {f"uses_{n}": upto_t - np.searchsorted(h, ts - n) for n in uses}
                    out |= {"run": np.where(present, hit - start + 1, ts - 1 - hit), "direction": np.where(ts == 0, 0, np.where(present, 1, -1))}
                    out["runs_ratio"] = np.where(islands == 0, 1.0, np.maximum(islands - present + (not at_once), 1) / np.maximum(islands, 1))
                    together = np.unique(np.stack([slot, was])[:, np.isin(was, e["top"])], axis=1)[0]
                    out |= {"partners": np.bincount(together, minlength=size), "prev_total": total, "prev_range": np.where(full, most - least, 0), "prev_odd": odd, "was_max": full & (most == k)}
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name].astype(f.type.to_pandas_dtype())) for f in arrow], schema=arrow)

    tasks = ranges.join(F.broadcast(every)).repartition(min(upto + 1 - from_, 1 << 11), "chunk")  # each makes piece rows for every item
    return tasks.mapInArrow(panel, ", ".join(f"{c} {k}" for c, k in types.items()))


def cox(spells: DataFrame, columns: list[str], l2: float = 0.01, rounds: int = 12, tolerance: float = 1e-8) -> dict[str, float]:
    """Proportional-hazard coefficients of standardised columns (Breslow ties, ridge penalty) of (duration, event, columns).

    Newton steps; each is one aggregate by distinct duration, whose rows (not the spells) come to the driver: distinct
    durations are at most as many as steps between two events.
    """
    moments = spells.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    z = [((F.col(c) - moments[f"m_{c}"]) / (moments[f"s_{c}"] or 1.0)).cast("double").alias(c) for c in columns]
    rows, k = pinned(spells.select("duration", "event", *z)), len(columns)
    beta = np.zeros(k)
    for _ in range(rounds):
        score = F.exp(sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, columns)), F.lit(0.0)))
        sums = [F.sum(score)] + [F.sum(score * F.col(c)) for c in columns] + [F.sum(score * F.col(a) * F.col(b)) for a in columns for b in columns]
        events = [F.sum("event")] + [F.sum(F.col("event") * F.col(c)) for c in columns]
        cells = rows.groupBy("duration").agg(*(x.alias(f"s{i}") for i, x in enumerate(sums)), *(x.alias(f"e{i}") for i, x in enumerate(events))).orderBy("duration").toPandas()
        risk = cells[[f"s{i}" for i in range(len(sums))]].to_numpy(float)[::-1].cumsum(0)[::-1]  # all that last so long or longer
        d, dx = cells["e0"].to_numpy(float), cells[[f"e{i + 1}" for i in range(k)]].to_numpy(float)
        mean = risk[:, 1 : k + 1] / risk[:, :1]
        second = risk[:, k + 1 :].reshape(-1, k, k) / risk[:, :1, None] - mean[:, :, None] * mean[:, None, :]
        gradient = (dx - d[:, None] * mean).sum(0) - l2 * beta
        step = np.linalg.solve((d[:, None, None] * second).sum(0) + l2 * np.eye(k), gradient)
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    return dict(zip(columns, beta.tolist()))


def hazard_risk(spells: DataFrame, columns: list[str], beta: dict[str, float]) -> DataFrame:
    """spells with risk, exp of the coefficients times the standardised columns."""
    moments = spells.agg(*(f(c).cast("double").alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    total = sum((F.lit(beta[c]) * (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns), F.lit(0.0))
    return spells.join(F.broadcast(moments)).withColumn("risk", F.exp(total)).drop(*moments.columns)


def top_excitation(alpha: DataFrame, k: int) -> DataFrame:
    """Of (a, b, alpha): the k strongest positive and negative pairs of different items, and every item's own, with their kind and place."""
    kind = F.when(F.col("a") == F.col("b"), "self").when(F.col("alpha") > 0, "up").when(F.col("alpha") < 0, "down")
    rows = alpha.withColumn("kind", kind).where("kind is not null")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.abs(F.round("alpha", 9)).desc(), "a", "b"))
    return rows.withColumn("place", place).where((F.col("place") <= k) | (F.col("kind") == "self")).select("kind", "place", "a", "b", "alpha")


def rescaled_gaps(probabilities: DataFrame, items: DataFrame, chunk: int = 4096) -> DataFrame:
    """item, t, gap: what the chances (item, t, p) sum up to between an item's event and its next one.

    Sums run inside ranges of t, and the ranges' totals are carried.
    """
    rows = pinned(probabilities.withColumn("_part", F.floor(F.col("t") / chunk)))
    sums = rows.groupBy("item", "_part").agg(F.sum("p").alias("_n"))
    before = sums.select("item", "_part", F.coalesce(F.sum("_n").over(Window.partitionBy("item").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    inside = F.sum("p").over(Window.partitionBy("item", "_part").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    along = rows.withColumn("_in", inside).join(before, ["item", "_part"]).select("item", "t", (F.col("_before") + F.col("_in")).alias("upto"))
    near = neighbours(pinned(items.select("item", "t")), ["item"]).where("was is not null").select("item", "t", "was")
    held = near.join(along, ["item", "t"]).join(along.select("item", F.col("t").alias("was"), F.col("upto").alias("_was")), ["item", "was"])
    return held.select("item", "t", (F.col("upto") - F.col("_was")).alias("gap"))


def expanding_backtest(items: DataFrame, steps: int, start: int, interval: int) -> DataFrame:
    """block, n, hits, log_loss: in each block of interval steps from start on, every item's rate of all steps before the block against what came.

    All blocks are scored in one pass, from counts before each block.
    """
    blocks = -(-(steps - start) // interval)
    hits = items.groupBy("item", F.greatest(F.floor((F.col("t") - start) / interval), F.lit(-1)).alias("block")).agg(F.count("*").alias("hits"))
    grid = hits.select("item").distinct().select("item", F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    each = grid.join(hits, ["item", "block"], "left").na.fill(0, ["hits"])
    before = F.sum("hits").over(Window.partitionBy("item").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    size = F.least(F.lit(interval), steps - start - F.col("block") * interval)
    rows = each.withColumns({"before": before, "size": size}).where("block >= 0")
    p = (F.col("before") + 1) / (F.col("block") * interval + start + 2)
    loss = -(F.col("hits") * F.log(p) + (F.col("size") - F.col("hits")) * F.log(1 - p))
    return rows.groupBy("block").agg(F.sum("size").alias("n"), F.sum("hits").alias("hits"), (F.sum(loss) / F.sum("size")).alias("log_loss"))
