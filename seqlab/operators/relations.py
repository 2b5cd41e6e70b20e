"""Dependence between columns: moments of all pairs in one pass, ranks, lags, effect sizes, transfer entropy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import f_tail, normal_two_sided, t_two_sided
from ..storage import pinned
from .series import over_runs, prefix_sum


def pearson(df: DataFrame, xs: list[str], ys: list[str]) -> DataFrame:
    """r, n and t of every x with every y over rows where both are present: one pass, one row per pair.

    corr keeps its moments per partition and merges them, so no pair has a scan of its own.
    """
    pairs = [(x, y) for x in xs for y in ys]
    both = {p: F.col(p[0]).isNotNull() & F.col(p[1]).isNotNull() for p in pairs}
    one = df.agg(*(F.corr(F.when(both[p], F.col(p[0])), F.when(both[p], F.col(p[1]))).alias(f"r{i}") for i, p in enumerate(pairs)), *(F.count_if(both[p]).alias(f"n{i}") for i, p in enumerate(pairs)))
    rows = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")) for i, (x, y) in enumerate(pairs)))).alias("_")
    r, n = F.col("r"), F.col("n")
    return one.select(rows).select("_.*").withColumn("t", F.when(r * r < 1, r * F.sqrt((n - 2) / (1 - r * r))))


def with_p(tests: DataFrame) -> DataFrame:
    """Adds the two-sided Student p of t with n - 2 degrees."""
    return tests.withColumn("p", t_two_sided(F.col("t"), F.col("n") - 2))


def mid_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the mean place (from 1) of each row's value: places come from the histogram of values, not from a sort of all rows."""
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_m"))
    placed = prefix_sum(values, [column], "_m", "_before").select(F.col(column).alias("_v"), (F.col("_before") + (F.col("_m") + 1) / 2).alias(name))
    return df.join(placed, F.col(column) == F.col("_v"), "left").drop("_v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    whole = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return pearson(mid_ranks(mid_ranks(whole, x, "_rx"), y, "_ry"), ["_rx"], ["_ry"]).withColumns({"x": F.lit(x), "y": F.lit(y)})


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """H of the ranks of value over groups, corrected for ties; one row: n, groups, h."""
    cells = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    values = cells.groupBy(value).agg(F.sum("n").alias("_m"))
    ranks = prefix_sum(values, [value], "_m", "_before").withColumn("rank", F.col("_before") + (F.col("_m") + 1) / 2)
    ties = values.agg(F.sum(F.pow("_m", F.lit(3)) - F.col("_m")).alias("ties"))
    groups = cells.join(ranks, value).groupBy(group).agg(F.sum(F.col("n") * F.col("rank")).alias("total"), F.sum("n").alias("n"))
    one = groups.agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum(F.col("total") * F.col("total") / F.col("n")).alias("s")).join(F.broadcast(ties))
    n = F.col("n").cast("double")
    return one.select("n", "groups", ((12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))).alias("h"))


def point_biserial(items: DataFrame, covariates: DataFrame, xs: list[str]) -> DataFrame:
    """Correlation of each item's presence with each covariate of the step, from sums over hits and moments over all steps."""
    long = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.col(x).cast("double").alias("v")) for x in xs))).alias("_")
    rows = covariates.select("t", long).select("t", "_.*").where("v is not null")
    whole = rows.groupBy("x").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    hits = items.join(rows, "t").groupBy("item", "x").agg(F.count("*").alias("n1"), F.avg("v").alias("mean1"))
    p = F.col("n1") / F.col("n")
    r = F.try_divide((F.col("mean1") - F.col("mean")) * F.sqrt(F.try_divide(p, 1 - p)), F.col("sd"))
    return hits.join(F.broadcast(whole), "x").select("item", "x", "n", r.alias("r"))


def cross_correlation(df: DataFrame, x: str, y: str, lags: range, t: str = "t") -> DataFrame:
    """Mean product of the z-scores of x at t and y at t + lag over the steps that have both; lag, n, r."""
    whole = df.agg(F.avg(x).alias("mx"), F.stddev_pop(x).alias("sx"), F.avg(y).alias("my"), F.stddev_pop(y).alias("sy"))
    z = df.join(F.broadcast(whole)).select(t, ((F.col(x) - F.col("mx")) / (F.col("sx") + 1e-10)).alias("zx"), ((F.col(y) - F.col("my")) / (F.col("sy") + 1e-10)).alias("zy"))
    left = z.select(t, "zx", F.explode(F.array(*map(F.lit, lags))).alias("lag")).withColumn("_at", F.col(t) + F.col("lag"))
    held = left.join(z.select(F.col(t).alias("_at"), "zy"), "_at")
    return held.groupBy("lag").agg(F.count("*").alias("n"), F.avg(F.col("zx") * F.col("zy")).alias("r"))


def effect_sizes(df: DataFrame, splits: dict[str, Column], values: list[str]) -> DataFrame:
    """Cohen's d of each value between the two sides of each split, with a label of its size."""
    sides = F.explode(F.array(*(F.struct(F.lit(k).alias("split"), c.alias("high")) for k, c in splits.items()))).alias("s")
    cells = F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.col(v).cast("double").alias("v")) for v in values))).alias("x")
    held = df.select("*", sides).select("s.*", cells).select("split", "high", "x.*").where("high is not null and v is not null")
    side = {True: F.when(F.col("high"), F.col("v")), False: F.when(~F.col("high"), F.col("v"))}
    each = held.groupBy("split", "value").agg(*(f(side[s]).alias(f"{n}{int(s)}") for s in side for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    d = F.try_divide(F.col("m1") - F.col("m0"), pooled)
    label = F.when(F.abs("d") < 0.2, "negligible").when(F.abs("d") < 0.5, "small").when(F.abs("d") < 0.8, "medium").otherwise("large")
    return each.select("split", "value", "n1", "n0", d.alias("d")).withColumn("size", label)


def conditional_rates(items: DataFrame, steps: DataFrame, high: str) -> DataFrame:
    """Each item's rate in steps where high holds and where not, and their distance."""
    sides = steps.where(F.col(high).isNotNull())
    sizes = sides.agg(F.count_if(high).alias("s1"), F.count_if(~F.col(high)).alias("s0"))
    each = items.join(sides.select("t", high), "t").groupBy("item").agg(F.count_if(high).alias("n1"), F.count_if(~F.col(high)).alias("n0"))
    rates = each.join(F.broadcast(sizes)).select("item", F.try_divide(F.col("n1"), F.col("s1")).alias("rate_high"), F.try_divide(F.col("n0"), F.col("s0")).alias("rate_low"))
    return rates.withColumn("distance", F.abs(F.col("rate_high") - F.col("rate_low")))


def ranked(df: DataFrame, value: str, key: str) -> DataFrame:
    """Adds place: 1 for the largest value (to 9 digits), ties by key. For tables of one row an item."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.round(value, 9).desc_nulls_last(), key)))


def transfer_entropy(items: DataFrame, steps: int, lags: list[int], chunk: int = 1 << 17) -> DataFrame:
    """Bits that the source's presence lag steps before the last step adds on the target's next one, beyond the target's last.

    All ordered pairs of items at all lags. Steps t with t >= lag and t + 1 < steps count. Hits are dealt out once, by runs
    of chunk steps; a task counts in how many of its steps items came together, as products of its table of presence, a
    bounded part of which is made at a time, and gives a row for each pair and lag that it has. The eight cells follow by
    inclusion and exclusion.
    """
    names, far = ("xy", "xz", "xyz", "x", "y", "z", "yz"), max(lags)
    run = max(chunk, far + 1)

    def count(rows: pa.Table, lo: int) -> pa.Table:
        """Steps t whose next one is in the run."""
        t, item = rows.column("t").to_numpy(), rows.column("item").to_numpy()
        kinds, code = np.unique(item, return_inverse=True)
        n = {lag: {k: np.zeros((len(kinds),) * (2 if k in names[:3] else 1), np.int64) for k in names} for lag in lags}
        wide = max(far + 1, min(1 << 13, (1 << 24) // max(1, len(kinds))))
        number = int(t[lo]) // run if lo < len(t) else int(t[-1]) // run + 1
        last = min((number + 1) * run, steps)
        for begin in range(max(number * run, 1), last, wide):  # next steps begin .. end - 1
            end = min(begin + wide, last)
            a, b = np.searchsorted(t, [begin - 1 - far, end])
            came = np.zeros((len(kinds), end - begin + 1 + far), np.float32)
            came[code[a:b], t[a:b] - (begin - 1 - far)] = 1
            z, y = came[:, far + 1 :], came[:, far:-1]
            both = y * z
            for lag in lags:
                skip = max(0, lag + 1 - begin)  # t >= lag
                if skip >= end - begin:
                    continue
                x = came[:, far - lag : came.shape[1] - 1 - lag][:, skip:]
                for k, other in zip(names, (y, z, both)):
                    n[lag][k] += (x @ other[:, skip:].T).astype(np.int64)
                for k, one in zip(names[3:], (x, y[:, skip:], z[:, skip:], both[:, skip:])):
                    n[lag][k] += one.sum(1).astype(np.int64)
        out = []
        for lag in lags:
            for k in names[:3]:
                i, j = np.nonzero(n[lag][k])
                out.append((k, lag, kinds[i], kinds[j], n[lag][k][i, j]))
            for k in names[3:]:
                i = np.flatnonzero(n[lag][k])
                out.append((k, lag, kinds[i], kinds[i], n[lag][k][i]))
        size = [len(x[4]) for x in out]
        made = [np.repeat(np.array([x[0] for x in out]), size).tolist(), np.repeat([x[1] for x in out], size), *(np.concatenate([x[k] for x in out]) for k in (2, 3, 4))]
        return pa.table([pa.array(x, kind) for x, kind in zip(made, (pa.string(), pa.int32(), *[rows.schema.field("item").type] * 2, pa.int64()))], names=["kind", "lag", "a", "b", "n"])

    kind = items.schema["item"].dataType.simpleString()
    # the step after a run's last belongs to the next run, whose halo holds the rest
    found = over_runs(items.select("t", "item").where(F.col("t") < steps), count, f"kind string, lag int, a {kind}, b {kind}, n long", far + 1, run)
    counts = pinned(found.groupBy("kind", "lag", "a", "b").agg(F.sum("n").alias("n")))  # of items and lags

    def of(name, *keys):
        return counts.where(F.col("kind") == name).select(*keys, "lag", F.col("n").alias(name))

    targets = of("y", "b").join(of("z", "b"), ["b", "lag"], "full").join(of("yz", "b"), ["b", "lag"], "left")
    grid = of("x", "a").join(targets, "lag").where("a <> b")
    for name in ("xy", "xz", "xyz"):
        grid = grid.join(of(name, "a", "b"), ["a", "b", "lag"], "left")
    g = grid.na.fill(0).withColumn("m", F.lit(steps - 1) - F.col("lag"))
    c = {k: F.col(k) for k in ("x", "y", "z", "xy", "xz", "yz", "xyz", "m")}

    def cell(x, y, z):  # inclusion and exclusion over the conditions that do not hold
        def count(keys):
            return c["".join(keys)] if keys else c["m"]

        want, free = [k for k, v in (("x", x), ("y", y), ("z", z)) if v], [k for k, v in (("x", x), ("y", y), ("z", z)) if not v]
        total = F.lit(0)
        for mask in range(1 << len(free)):
            extra = [k for i, k in enumerate(free) if mask >> i & 1]
            total = total + (-1) ** len(extra) * count(sorted(want + extra))
        return total

    cells = {(x, y, z): f"_c{x}{y}{z}" for x in (0, 1) for y in (0, 1) for z in (0, 1)}
    g = g.withColumns({name: cell(*k).cast("double") for k, name in cells.items()})

    def term(x, y, z):
        n, xy = F.col(cells[x, y, z]), F.col(cells[x, y, 0]) + F.col(cells[x, y, 1])
        yz, yy = F.col(cells[0, y, z]) + F.col(cells[1, y, z]), sum((F.col(cells[i, y, j]) for i, j in ((0, 1), (1, 0), (1, 1))), F.col(cells[0, y, 0]))
        return F.when(n > 0, n / F.col("m") * F.log2(n * yy / (xy * yz))).otherwise(0.0)

    return g.select("a", "b", "lag", sum((term(*k) for k in cells), F.lit(0.0)).alias("te"))


def gram(df: DataFrame, y: str, xs: list[str], keys: list[str] = ()) -> DataFrame:
    """Sums of all products of (1, xs, y), as one flat array per key, with n: all that least squares needs."""
    cols = [F.lit(1.0), *(F.col(x).cast("double") for x in xs), F.col(y).cast("double")]
    whole = df.dropna(subset=[y, *xs])
    return whole.groupBy(*keys).agg(F.array(*(F.sum(a * b) for a in cols for b in cols)).alias("gram"), F.count("*").alias("n"))


def _solve(xs: int):
    """A task that turns Gram arrays into coefficients, residual sums and R squared."""
    import numpy as np
    import pandas as pd

    def solved(batches):
        for batch in batches:
            rows = []
            for flat, n in zip(batch["gram"], batch["n"]):
                g = np.array(flat, dtype=float).reshape(xs + 2, xs + 2)
                a, b, yy = g[:-1, :-1], g[:-1, -1], g[-1, -1]
                inverse = np.linalg.pinv(a)
                beta = inverse @ b
                left, total = max(yy - beta @ b, 0.0), yy - g[0, -1] ** 2 / n
                scale = left / max(n - xs - 1, 1)
                rows.append((beta.tolist(), np.sqrt(np.maximum(np.diag(inverse) * scale, 0)).tolist(), left, 1 - left / total if total > 0 else 0.0))
            yield pd.concat([batch.drop(columns="gram").reset_index(drop=True), pd.DataFrame(rows, columns=["beta", "se", "ssr", "r2"])], axis=1)

    return solved


def ols(df: DataFrame, y: str, xs: list[str], keys: list[str] = ()) -> DataFrame:
    """Least squares with an intercept per key, from one aggregate: n, beta, se (both intercept first), ssr, r2."""
    sums = gram(df, y, xs, keys)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema if f.name != "gram"), "beta array<double>, se array<double>, ssr double, r2 double"])
    return sums.mapInPandas(_solve(len(xs)), schema)


def hac_errors(df: DataFrame, y: str, xs: list[str], lags: int, t: str = "t") -> DataFrame:
    """Newey-West: coefficients of one regression over a series, with errors that allow for lags: x, beta, se, z, p."""
    import numpy as np

    fit = ols(df, y, xs).first()  # one row of len(xs) + 1 numbers
    names = ["const", *xs]
    cols = [F.lit(1.0), *(F.col(x).cast("double") for x in xs)]
    left = F.col(y).cast("double") - sum((b * c for b, c in zip(fit.beta[1:], cols[1:])), F.lit(fit.beta[0]))
    scores = df.dropna(subset=[y, *xs]).select(F.col(t).alias("_t"), *((left * c).alias(f"_s{i}") for i, c in enumerate(cols)))
    shifted = scores.select(F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"), "*").select("lag", (F.col("_t") + F.col("lag")).alias("_t"), *(F.col(f"_s{i}").alias(f"_b{i}") for i in range(len(cols))))
    products = shifted.join(scores, "_t").groupBy("lag").agg(F.array(*(F.sum(F.col(f"_s{i}") * F.col(f"_b{j}")) for i in range(len(cols)) for j in range(len(cols)))).alias("g"))
    meat = np.zeros((len(cols), len(cols)))
    for row in products.collect():  # one row per lag
        g = np.array(row.g).reshape(len(cols), len(cols))
        meat += g if row.lag == 0 else (1 - row.lag / (lags + 1)) * (g + g.T)
    bread = np.linalg.pinv(np.array(gram(df, y, xs).first().gram).reshape(len(cols) + 1, -1)[:-1, :-1])
    errors = np.sqrt(np.diag(bread @ meat @ bread))
    rows = df.sparkSession.createDataFrame([(n, float(b), float(e)) for n, b, e in zip(names, fit.beta, errors)], "x string, beta double, se double")
    return rows.withColumn("z", F.try_divide("beta", "se")).withColumn("p", normal_two_sided(F.col("z")))


def granger(df: DataFrame, x: str, y: str, most: int, t: str = "t") -> DataFrame:
    """F tests of whether the lags of x help to tell y beyond its own lags; one row per number of lags: lag, n, f, p."""
    base = df.select(F.col(t).alias("_t"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    wide = base
    for k in range(1, most + 1):
        wide = wide.join(base.select((F.col("_t") + k).alias("_t"), F.col("_x").alias(f"_x{k}"), F.col("_y").alias(f"_y{k}")), "_t", "left")
    out = None
    for k in range(1, most + 1):
        own, other = [f"_y{i}" for i in range(1, k + 1)], [f"_x{i}" for i in range(1, k + 1)]
        whole = wide.dropna(subset=[*own, *other])
        short, full = ols(whole, "_y", own).select(F.col("ssr").alias("ssr0")), ols(whole, "_y", own + other).select("n", "ssr")
        f = F.try_divide((F.col("ssr0") - F.col("ssr")) / k, F.col("ssr") / (F.col("n") - 2 * k - 1))
        row = full.join(F.broadcast(short)).select(F.lit(k).alias("lag"), "n", f.alias("f"), f_tail(f, F.lit(float(k)), (F.col("n") - 2 * k - 1).cast("double")).alias("p"))
        out = row if out is None else out.unionByName(row)
    return out


def quantile_bins(df: DataFrame, column: str, q: int, name: str = "bin") -> DataFrame:
    """Adds the 0-based quantile bin of column by exact edges; equal edges are one, a null has none."""
    edges = df.agg(F.array_distinct(F.expr(f"percentile({column}, array({', '.join(str(i / q) for i in range(1, q))}))")).alias("_edges"))
    return df.join(F.broadcast(edges)).withColumn(name, F.when(F.col(column).isNotNull(), F.size(F.filter("_edges", lambda e: e < F.col(column))))).drop("_edges")


def summary(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Of tests with p, p_bh and p_bonferroni: how many are below alpha in each, and how many chance would give."""
    return tests.agg(F.count("p").alias("tests"), *(F.count_if(F.col(c) < alpha).alias(n) for c, n in (("p", "raw"), ("p_bh", "fdr"), ("p_bonferroni", "bonferroni"))), (F.count("p") * alpha).alias("expected"))
