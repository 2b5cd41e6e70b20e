"""Named sets of causal features of digit draws, and their registry.

A set is a function from a Spec and a window (rows of a chunk and the halo before it, in the order of t) to named columns,
so all windows of all chosen sets share one shuffle and one sort. What looks farther back than a halo (the uses of a
machine) is joined by ranges before. Sets of own columns are added with @feature_set.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..storage import pinned
from .series import earlier, last_n, over_chunks, over_runs, seen


@dataclass
class Spec:
    """Which columns of a draw table the sets read."""

    digits: list[str] = field(default_factory=lambda: ["d1", "d2", "d3"])
    combo: str = "c"
    day: str = "day"
    slot: str = "slot"
    slots: int = 4
    keys: list[str] = field(default_factory=lambda: ["machine", "ball1", "ball2", "ball3"])
    windows: list[int] = field(default_factory=lambda: [10, 25, 50, 100])
    window: int = 50
    cap: int = 1000
    symbols: int = 10


SETS: dict[str, Callable[[Spec, object], dict[str, Column]]] = {}


def feature_set(name: str):
    def add(make):
        SETS[name] = make
        return make

    return add


def _total(columns: list[Column]) -> Column:
    return sum(columns[1:], columns[0])


def shape(digits: list[Column]) -> dict[str, Column]:
    """Of some digits: themselves, sum, repeats, all alike, three in a row in any order, odd, even, high and low counts."""
    kinds, up = F.size(F.array_distinct(F.array(*digits))), F.array_sort(F.array(*digits))
    steps = [up[i + 1] - up[i] == 1 for i in range(len(digits) - 1)]
    odd, high = _total([d % 2 for d in digits]), _total([(d >= 5).cast("int") for d in digits])
    straight = steps[0]
    for s in steps[1:]:
        straight = straight & s
    n = len(digits)
    return {
        **{f"digit_{i + 1}": d for i, d in enumerate(digits)},
        "sum": _total(digits), "repeating": (kinds < n).cast("int"), "triple": (kinds == 1).cast("int"), "sequential": straight.cast("int"),
        "odd": odd, "even": n - odd, "high": high, "low": n - high,
    }


@feature_set("basic")
def basic(spec: Spec, w) -> dict[str, Column]:
    """The shape of the draw before; zeros in the first row."""
    return {f"prev_{k}": F.when(F.col("t") == 0, 0).otherwise(v) for k, v in shape([F.lag(d, 1).over(w) for d in spec.digits]).items()}


def _share(column: str, symbol: int, n: int, w) -> Column:
    return F.coalesce(F.try_divide(last_n((F.col(column) == symbol).cast("int"), w, n), seen(n)), F.lit(0.0))


@feature_set("recency")
def recency(spec: Spec, w) -> dict[str, Column]:
    """Shares of each symbol and position in several windows, and the gap of the last combination before its last draw."""
    out = {f"f{n}_{c}_{s}": _share(c, s, n, w) for n in spec.windows for c in spec.digits for s in range(spec.symbols)}
    return out | {"combo_gap": F.coalesce(F.lag("_combo_gap", 1).over(w), F.lit(spec.cap))}


@feature_set("gaps")
def gaps(spec: Spec, w) -> dict[str, Column]:
    """Steps since each symbol came anywhere, and in each position, at most cap."""

    def gap(hit):
        last = F.last(F.when(hit, F.col("t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        return F.least(F.coalesce(F.col("t") - last, F.col("t")), F.lit(spec.cap))

    anywhere = {}
    for s in range(spec.symbols):
        hit = F.lit(False)
        for c in spec.digits:
            hit = hit | (F.col(c) == s)
        anywhere[f"gap_{s}"] = gap(hit)
    return anywhere | {f"{c}_gap_{s}": gap(F.col(c) == s) for c in spec.digits for s in range(spec.symbols)}


@feature_set("position")
def position(spec: Spec, w) -> dict[str, Column]:
    """Shares in one window, and the correlation of each two positions in it (0 where it is undefined)."""
    out, n = {f"p_{c}_{s}": _share(c, s, spec.window, w) for c in spec.digits for s in range(spec.symbols)}, spec.window
    m = seen(n)
    for i, a in enumerate(spec.digits):
        for b in spec.digits[i + 1 :]:
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            sx, sy, sxy, sxx, syy = (last_n(v, w, n) for v in (x, y, x * y, x * x, y * y))
            root = F.sqrt(F.greatest((m * sxx - sx * sx) * (m * syy - sy * sy), F.lit(0.0)))
            out[f"corr_{a}_{b}"] = F.when(m >= 2, F.coalesce(F.try_divide(m * sxy - sx * sy, root), F.lit(0.0))).otherwise(0.0)
    return out


@feature_set("temporal")
def temporal(spec: Spec, w) -> dict[str, Column]:
    """Day of the week (Monday 0), month, and the year between the table's first and last."""
    out = {f"dow_{k}": (F.weekday(spec.day) == k).cast("int") for k in range(7)} | {f"month_{k}": (F.month(spec.day) == k).cast("int") for k in range(1, 13)}
    return out | {"year_share": (F.year(spec.day) - F.col("_year_lo")) / F.greatest(F.col("_year_hi") - F.col("_year_lo"), F.lit(1))}


@feature_set("momentum")
def momentum(spec: Spec, w) -> dict[str, Column]:
    """Chi-square and entropy of each position in one window (0 with under five rows), and symbols shared by the two draws before."""
    out, m = {}, seen(spec.window)
    for c in spec.digits:
        counts = [last_n((F.col(c) == s).cast("int"), w, spec.window) for s in range(spec.symbols)]
        chi = _total([F.try_divide((k - m / spec.symbols) * (k - m / spec.symbols), m / spec.symbols) for k in counts])
        bits = _total([F.when(k > 0, -(k / m) * F.log2(k / m)).otherwise(0.0) for k in counts])
        out |= {f"{c}_chi2": F.when(F.col("t") >= 5, chi).otherwise(0.0), f"{c}_entropy": F.when(F.col("t") >= 5, bits).otherwise(0.0)}
    one, two = (F.array(*(F.lag(d, k).over(w) for d in spec.digits)) for k in (1, 2))
    return out | {"overlap": F.when(F.col("t") < 2, 0).otherwise(F.size(F.array_intersect(one, two)))}


@feature_set("draw_time")
def draw_time(spec: Spec, w) -> dict[str, Column]:
    return {f"slot_{k}": (F.col(spec.slot) == k).cast("int") for k in range(spec.slots)}


@feature_set("equipment")
def equipment(spec: Spec, w) -> dict[str, Column]:
    """Earlier uses of each piece of equipment and days since its first; 0 if it is not known."""
    return {x: F.col(f"_{x}") for k in spec.keys for x in (f"{k}_uses", f"{k}_age")}


@dataclass
class Run:
    """A run of rows in the order of t, of which those from lo on are its own: t, digits (row, position) and combinations."""

    t: np.ndarray
    digits: np.ndarray
    combo: np.ndarray
    lo: int

    def back(self, values: np.ndarray, steps: int) -> np.ndarray:
        """Of own rows the values so many rows before; the first row's where there is none."""
        return values[np.maximum(np.arange(self.lo, len(self.t)) - steps, 0)]

    def sums(self, values: np.ndarray, n: int) -> np.ndarray:
        """Of own rows the sums of values over the n rows before."""
        upto, at = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)]), np.arange(self.lo, len(self.t))
        return upto[at] - upto[np.maximum(at - n, 0)]

    def gap(self, hit: np.ndarray, cap: int) -> np.ndarray:
        """Of own rows the steps since hit last held before, or t, at most cap."""
        own = self.t[self.lo :]
        last = np.append(-1, np.maximum.accumulate(np.where(hit, self.t, -1))[:-1])[self.lo :] if len(own) else own
        return np.minimum(np.where(last >= 0, own - last, own), cap)


#: What sets that look back give for a whole run of rows without null digits at once, as SETS gives it for a row.
RUNS: dict[str, Callable[[Spec, Run], dict[str, np.ndarray]]] = {}


def _of_run(name: str):
    def add(make):
        RUNS[name] = make
        return make

    return add


@_of_run("basic")
def _basic_run(spec: Spec, run: Run) -> dict[str, np.ndarray]:
    d = run.back(run.digits, 1)
    up, n = np.sort(d, 1), d.shape[1]
    same = up[:, 1:] == up[:, :-1]
    odd, high = (d % 2).sum(1), (d >= 5).sum(1)
    made = {f"digit_{i + 1}": d[:, i] for i in range(n)} | {"sum": d.sum(1), "repeating": same.any(1), "triple": same.all(1), "sequential": (up[:, 1:] - up[:, :-1] == 1).all(1), "odd": odd, "even": n - odd, "high": high, "low": n - high}
    return {f"prev_{k}": np.where(run.t[run.lo :] == 0, 0, v).astype(np.int64) for k, v in made.items()}


def _shares(spec: Spec, run: Run, n: int, name: str) -> dict[str, np.ndarray]:
    seen_ = np.minimum(run.t[run.lo :], n)[:, None]
    out = {}
    for i, c in enumerate(spec.digits):
        came = run.sums((run.digits[:, i, None] == np.arange(spec.symbols)).astype(np.int64), n)
        share = np.divide(came, seen_, out=np.zeros(came.shape), where=seen_ > 0)
        out |= {f"{name}_{c}_{s}": share[:, s] for s in range(spec.symbols)}
    return out


@_of_run("recency")
def _recency_run(spec: Spec, run: Run) -> dict[str, np.ndarray]:
    out = {}
    for n in spec.windows:
        out |= _shares(spec, run, n, f"f{n}")
    order = np.lexsort((run.t, run.combo))
    same = np.append(False, run.combo[order][1:] == run.combo[order][:-1])
    own = np.full(len(run.t), spec.cap)
    own[order[same]] = np.minimum(run.t[order[same]] - run.t[order[np.flatnonzero(same) - 1]], spec.cap)
    return out | {"combo_gap": np.where(run.t[run.lo :] == 0, spec.cap, run.back(own, 1)).astype(np.int64)}


@_of_run("gaps")
def _gaps_run(spec: Spec, run: Run) -> dict[str, np.ndarray]:
    hits = {f"gap_{s}": (run.digits == s).any(1) for s in range(spec.symbols)} | {f"{c}_gap_{s}": run.digits[:, i] == s for i, c in enumerate(spec.digits) for s in range(spec.symbols)}
    return {k: run.gap(hit, spec.cap).astype(np.int64) for k, hit in hits.items()}


@_of_run("position")
def _position_run(spec: Spec, run: Run) -> dict[str, np.ndarray]:
    n = spec.window
    m, d = np.minimum(run.t[run.lo :], n), run.digits.astype(float)
    out = _shares(spec, run, n, "p")
    for i, a in enumerate(spec.digits):
        for j, b in enumerate(spec.digits[i + 1 :], i + 1):
            x, y = d[:, i], d[:, j]
            sx, sy, sxy, sxx, syy = (run.sums(v, n) for v in (x, y, x * y, x * x, y * y))
            root = np.sqrt(np.maximum((m * sxx - sx * sx) * (m * syy - sy * sy), 0.0))
            out[f"corr_{a}_{b}"] = np.divide(m * sxy - sx * sy, root, out=np.zeros(len(m)), where=(m >= 2) & (root > 0))
    return out


@_of_run("momentum")
def _momentum_run(spec: Spec, run: Run) -> dict[str, np.ndarray]:
    own, out = run.t[run.lo :], {}
    m, enough = np.maximum(np.minimum(own, spec.window), 1), own >= 5
    for i, c in enumerate(spec.digits):
        counts = run.sums((run.digits[:, i, None] == np.arange(spec.symbols)).astype(np.int64), spec.window)
        mean, share = m / spec.symbols, counts / m[:, None]
        chi = sum((k - mean) * (k - mean) / mean for k in counts.T)
        bits = sum(np.where(p > 0, -p * np.log2(np.where(p > 0, p, 1)), 0.0) for p in share.T)
        out |= {f"{c}_chi2": np.where(enough, chi, 0.0), f"{c}_entropy": np.where(enough, bits, 0.0)}
    one, two = run.back(run.digits, 1), run.back(run.digits, 2)
    again = [(one[:, i, None] == one[:, :i]).any(1) for i in range(one.shape[1])]
    shared = sum((one[:, i, None] == two).any(1) & ~again[i] for i in range(one.shape[1]))
    return out | {"overlap": np.where(own < 2, 0, shared).astype(np.int64)}


def _rounded(features: dict[str, Column], places: int | None) -> dict[str, Column]:
    """Features rounded to places, if there are any; whole numbers stay whole."""
    return features if places is None else {k: F.round(v, places) for k, v in features.items()}


_OWN = ("temporal", "draw_time", "equipment")  # these read their own row only


def _in_runs(rows: DataFrame, sets: list[str], spec: Spec, halo: int, chunk: int, places: int | None) -> DataFrame:
    """The sets of RUNS made for runs of rows, and those that read their own row beside them; rounded to places, if there are any."""
    back = [x for x in sets if x in RUNS]

    def features(run: Run) -> dict[str, np.ndarray]:
        out = {}
        for x in back:
            out |= RUNS[x](spec, run)
        if places is None:
            return out
        return {k: np.copysign(np.floor(np.abs(v) * 10.0**places + 0.5) / 10.0**places, v) if v.dtype == float else v for k, v in out.items()}

    def make(held: pa.Table, lo: int) -> pa.Table:
        digits = np.stack([held.column(c).to_numpy() for c in spec.digits], 1).astype(np.int64).reshape(len(held), -1)
        combo = held.column(spec.combo).cast(pa.int64()).fill_null(-(1 << 62)).to_numpy() if "recency" in back else np.zeros(len(held), np.int64)
        made = features(Run(held.column("t").to_numpy(), digits, combo, lo))
        table = held.slice(lo)
        return pa.Table.from_arrays([*table.columns, *map(pa.array, made.values())], names=[*table.column_names, *made])

    zero = np.zeros(1, np.int64)
    names = features(Run(zero, np.zeros((1, len(spec.digits)), np.int64), zero, 0))
    kind = StructType([*rows.schema.fields, *(StructField(k, DoubleType() if v.dtype == float else LongType()) for k, v in names.items())])
    made = over_runs(rows, make, kind, halo, chunk) if back else rows
    wanted = {}
    for x in sets:
        wanted |= {k: F.col(k) for k in RUNS[x](spec, Run(zero, np.zeros((1, len(spec.digits)), np.int64), zero, 0))} if x in RUNS else _rounded(SETS[x](spec, None), places)
    return made.select("t", *(c.alias(k) for k, c in wanted.items()))


def build_features(df: DataFrame, sets: list[str] | None = None, spec: Spec | None = None, chunk: int = 4096, places: int | None = None) -> DataFrame:
    """t and the features of the named sets (all, if none are named), causal: no feature of a row reads its outcome.

    places: to how many digits features are rounded, if at all. An unknown set is an error.
    """
    spec, sets = spec or Spec(), list(sets or SETS)
    unknown = [x for x in sets if x not in SETS]
    if unknown:
        raise ValueError(f"unknown feature sets {unknown}; there are {list(SETS)}")
    rows = df = pinned(df)  # read once for every key
    if "equipment" in sets:
        for k in spec.keys:
            rows = earlier(rows, [k], first=spec.day, base=df)
            age = F.datediff(F.col(spec.day), F.col(f"first_{spec.day}"))
            unset = F.col(k).isNull()
            rows = rows.withColumns({f"_{k}_uses": F.when(unset, 0).otherwise(F.col("uses")), f"_{k}_age": F.when(unset, 0).otherwise(age)}).drop("uses", f"first_{spec.day}")
    packed = all(x in RUNS or x in _OWN for x in sets) and df.where(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in spec.digits))).isEmpty()
    if "recency" in sets and not packed:
        rows = _combo_gaps(rows, spec)
    if "temporal" in sets:
        rows = rows.join(F.broadcast(df.agg(F.min(F.year(spec.day)).alias("_year_lo"), F.max(F.year(spec.day)).alias("_year_hi"))))
    halo = max(2, *([spec.cap] if "gaps" in sets else [0]), *([max(spec.windows) + 1] if "recency" in sets else [0]), spec.window + 1)
    if packed:
        read = {"t", *spec.digits, spec.combo, *([spec.day, "_year_lo", "_year_hi"] if "temporal" in sets else []), *([spec.slot] if "draw_time" in sets else []), *(f"_{k}_{x}" for k in spec.keys for x in ("uses", "age"))}
        return _in_runs(rows.select(*(c for c in rows.columns if c in read)), sets, spec, max(halo, spec.cap + 1 if "recency" in sets else 0), max(chunk, 1 << 14), places)
    names: list[str] = []

    def make(w):
        out = {}
        for x in sets:
            out |= _rounded(SETS[x](spec, w), places)
        names.extend(n for n in out if n not in names)
        return out

    return over_chunks(rows, make, halo, max(chunk, halo)).select("t", *names)


def _combo_gaps(rows: DataFrame, spec: Spec) -> DataFrame:
    """Adds _combo_gap: steps since this row's combination came, at most cap. Only draws of that many steps before count."""
    made = over_chunks(rows, lambda w: {"_was": F.lag("t", 1).over(w)}, spec.cap, 1 << 16, keys=(spec.combo,))
    return made.withColumn("_combo_gap", F.least(F.coalesce(F.col("t") - F.col("_was"), F.lit(spec.cap)), F.lit(spec.cap))).drop("_was")
