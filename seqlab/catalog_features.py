"""Queries of fitted features, grids of keys, resampling and simple predictors with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .bindings import COVARIATES, DRAWS, ITEMS, decayed_sql, draws, items, joined, rows, steps
from .catalog_relations import _r
from .catalog_scores import BASE, DIGITS, marginals
from .functions import tails
from .operators import features as E
from .operators import items as I
from .operators import resampling as N
from .operators import scores as L
from .operators import series as S

QUERIES: dict = {}
SQL: dict[str, str] = {}
_D, _I, _W = "WITH " + DRAWS, "WITH " + ITEMS, "WITH " + COVARIATES


def _register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# scalar functions of a row
_register("c7_bins", lambda s, d: rows(s, d).select(F.when(F.col("d1") + F.col("d2") + F.col("d3") < 10, 0).when(F.col("d1") + F.col("d2") + F.col("d3") < 18, 1).otherwise(2).alias("third"), ((F.col("d1") == F.col("d2")) | (F.col("d2") == F.col("d3")) | (F.col("d1") == F.col("d3"))).alias("repeat")).groupBy("third", "repeat").agg(F.count("*").alias("n")),
          _D + " SELECT CASE WHEN d1 + d2 + d3 < 10 THEN 0 WHEN d1 + d2 + d3 < 18 THEN 1 ELSE 2 END AS third, d1 = d2 OR d2 = d3 OR d1 = d3 AS repeat, count(*) AS n FROM draws GROUP BY 1, 2")
_register("w17_gap_roll_stats", lambda s, d: _r(E.rolling_gap_stats(items(s, d), [5, 10]), "mean_5", "sd_5", "mean_10", "sd_10"),
          _I + ", g AS (SELECT item, t, t - lag(t) OVER (PARTITION BY item ORDER BY t) AS gap FROM items) SELECT item, t, " + ", ".join(f"round(avg(gap) OVER w{n}, 6) AS mean_{n}, round(stddev_pop(gap) OVER w{n}, 6) AS sd_{n}, min(gap) OVER w{n} AS least_{n}, max(gap) OVER w{n} AS most_{n}" for n in (5, 10)) + " FROM g WHERE gap IS NOT NULL WINDOW " + ", ".join(f"w{n} AS (PARTITION BY item ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 10)))
_register("w18_item_freq", lambda s, d: E.recent_uses(items(s, d), [20, 50, 100]), _I + " SELECT item, t, " + ", ".join(f"count(*) OVER (PARTITION BY item ORDER BY t RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING) AS f_{n}" for n in (20, 50, 100)) + " FROM items")
_register("w19_run_state", lambda s, d: E.run_state(items(s, d)), _I + ", x AS (SELECT item, t, t - row_number() OVER (PARTITION BY item ORDER BY t) AS g, t - lag(t) OVER (PARTITION BY item ORDER BY t) - 1 AS gap FROM items) SELECT item, min(t) AS start, count(*) AS length, arg_min(gap, t) AS absence FROM (SELECT item, t, g, gap FROM x) GROUP BY item, g")
SQL["w19_run_state"] = SQL["w19_run_state"].replace("arg_min(gap, t)", "list(gap ORDER BY t)[1]")


def _w20(s, d):
    rows = items(s, d)
    return E.partner_presence(rows, I.pair_counts(rows), 5)


_register("w20_partner_presence", _w20, _I + """, p AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM items x JOIN items y ON x.t = y.t AND x.item <> y.item GROUP BY 1, 2), k AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM p) WHERE r <= 5)
SELECT i.t + 1 AS t, k.a AS item, count(*) AS partners FROM items i JOIN k ON k.b = i.item GROUP BY 1, 2""")
_register("w23_decayed_symbol_freq", lambda s, d: E.decayed_history(draws(s, d), "d1", 10, 0.005).select("t", *(F.round(F.col("p_d1")[k], 6).alias(f"p{k}") for k in range(10))),
          _D + ", " + decayed_sql("d1", "n") + " SELECT t, " + ", ".join(f"round(coalesce(max(w) FILTER (k = {k}) / nullif(sum(w), 0), 0.1), 6) AS p{k}" for k in range(10)) + " FROM n GROUP BY t")
_register("w30_expanding_mean", lambda s, d: S.prefix_sum(draws(s, d), ["t"], "c", "before").select("t", F.round(F.try_divide("before", "t"), 6).alias("mean")), _D + " SELECT t, round(avg(c) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS mean FROM draws")

# fitted features
_PRODUCTS = {"d1_x_d3": "d1 * d3", "d2_x_d3": "d2 * d3", "d1_over_d3": "d1 / (d3 + 1e-6)", "d2_over_d3": "d2 / (d3 + 1e-6)"}
_register("e1_interactions", lambda s, d: draws(s, d).select("t", *(F.round(c, 6).alias(n) for n, c in E.interactions(["d1", "d2"], ["d3"], ratios=True).items())), _D + " SELECT t, " + ", ".join(f"round(CAST(greatest(least({x}, 1e6), -1e6) AS DOUBLE), 6) AS {n}" for n, x in _PRODUCTS.items()) + " FROM draws")
_TERMS = ["d1*d1", "d1*d2", "d1*d3", "d2*d2", "d2*d3", "d3*d3"]


def _e2(s, d):
    rows = draws(s, d)
    best = E.polynomial_by_variance(rows, DIGITS, 2, 3)
    return rows.select("t", *(F.expr(x).alias(f"v{i}") for i, x in enumerate(best)))


_register("e2_poly_topk_variance", _e2, _D + ", x AS (" + " UNION ALL ".join(f"SELECT t, {i} AS i, CAST({x} AS DOUBLE) AS v FROM draws" for i, x in enumerate(_TERMS)) + "), r AS (SELECT i, row_number() OVER (ORDER BY var_pop(v) DESC, i) AS r FROM x GROUP BY i) SELECT t, max(v) FILTER (r = 1) AS v0, max(v) FILTER (r = 2) AS v1, max(v) FILTER (r = 3) AS v2 FROM x JOIN r USING (i) GROUP BY t")


def _scaled(method):
    def query(s, d):
        rows = joined(s, d).where("quantity is not null").select("t", "c", "quantity")
        return _r(E.scale(rows, rows.where("t % 10 < 7"), ["c", "quantity"], method), "c", "quantity")

    return query


_PARTS = {"standard": ("avg({0})", "stddev_pop({0})"), "robust": ("quantile_cont({0}, 0.5)", "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)"), "minmax": ("min({0})", "max({0}) - min({0})")}
for _m, (_a, _b) in _PARTS.items():
    _register(f"e4_scale_{_m}", _scaled(_m), _W + f", f AS (SELECT {_a.format('c')} AS a, {_b.format('c')} AS b, {_a.format('quantity')} AS e, {_b.format('quantity')} AS g FROM w WHERE quantity IS NOT NULL AND t % 10 < 7) SELECT t, round((c - a) / b, 6) AS c, round((quantity - e) / g, 6) AS quantity FROM w, f WHERE quantity IS NOT NULL")
def _normal_sql(p):
    def along(coefficients, x):
        return reduce(lambda a, c: f"({a} * {x} + {c!r}::DOUBLE)", coefficients[1:], f"{coefficients[0]!r}::DOUBLE")

    def end(tail):
        return f"{along(tails.NORMAL_ENDS[0], f'sqrt(-2 * ln({tail}))')} / {along(tails.NORMAL_ENDS[1], f'sqrt(-2 * ln({tail}))')}"

    q = f"(({p}) - 0.5)"
    middle = f"{q} * {along(tails.NORMAL_MIDDLE[0], f'({q} * {q})')} / {along(tails.NORMAL_MIDDLE[1], f'({q} * {q})')}"
    return f"CASE WHEN {p} < 0.02425 THEN {end(p)} WHEN {p} > 1 - 0.02425 THEN -({end(f'(1 - {p})')}) ELSE {middle} END"


def _share_sql(c, q):
    below, upto = f"len(list_filter({q}, lambda v: v < {c}))", f"len(list_filter({q}, lambda v: v <= {c}))"
    return f"greatest(CAST(1e-7 AS DOUBLE), least(1 - CAST(1e-7 AS DOUBLE), CASE WHEN {upto} > {below} THEN ({below} + {upto} - 1) / CAST(200 AS DOUBLE) WHEN {below} = 0 THEN 0 WHEN {below} > 100 THEN 1 ELSE ({below} - 1 + ({c} - {q}[{below}]) / ({q}[{below} + 1] - {q}[{below}])) / 100 END))"


def _e4_normal(s, d):
    rows = joined(s, d).where("quantity is not null").select("t", "c", "quantity")
    return _r(E.to_normal(rows, rows.where("t % 10 < 7"), ["c", "quantity"]), "c", "quantity")


_register("e4_scale_normal", _e4_normal, _W + ", f AS (SELECT quantile_cont(CAST(c AS DOUBLE), list_transform(range(101), lambda k: k / 100)) AS qc, quantile_cont(quantity, list_transform(range(101), lambda k: k / 100)) AS qq FROM w WHERE quantity IS NOT NULL AND t % 10 < 7), "
          f"x AS (SELECT t, {_share_sql('c', 'qc')} AS pc, {_share_sql('quantity', 'qq')} AS pq FROM w, f WHERE quantity IS NOT NULL) SELECT t, round({_normal_sql('pc')}, 6) AS c, round({_normal_sql('pq')}, 6) AS quantity FROM x")
_register("e6_seasonal_detrend", lambda s, d: _r(E.seasonal_detrend(draws(s, d).select("t", "day", "c"), draws(s, d), "day", ["c"]).select("t", "c"), "c"),
          _D + ", y AS (SELECT dayofyear(day) AS doy, avg(c) AS m FROM draws GROUP BY 1), z AS (SELECT (doy + k - 1 + 366) % 366 + 1 AS doy, avg(m) AS m FROM y, range(-7, 8) q(k) GROUP BY 1) SELECT t, round(c - coalesce(m, (SELECT avg(m) FROM y)), 6) AS c FROM draws LEFT JOIN z ON z.doy = dayofyear(day)")
_register("e7_linear_detrend", lambda s, d: _r(E.linear_detrend(draws(s, d).select("t", (F.col("c") + F.col("t") * 0.1).alias("up"), "d1"), ["up", "d1"]), "up", "d1"),
          _D + ", x AS (SELECT t, c + t * CAST(0.1 AS DOUBLE) AS up, CAST(d1 AS DOUBLE) AS d1 FROM draws), f AS (SELECT " + ", ".join(f"regr_slope({c}, t) AS s{i}, sqrt(regr_r2({c}, t) * (count(*) - 2) / (1 - regr_r2({c}, t))) AS t{i}" for i, c in enumerate(("up", "d1"))) + ", avg(t) AS m FROM x) SELECT t, " + ", ".join(f"round(CASE WHEN t{i} > 1.96 THEN {c} - s{i} * (t - m) ELSE {c} END, 6) AS {c}" for i, c in enumerate(("up", "d1"))) + " FROM x, f")

# resampling
_HASH = "('0x' || substr(md5('{seed}:' || {parts}), 1, 12))::BIGINT"


def _n6(s, d):
    n, rows = steps(s, d), draws(s, d).select("t", "c")
    picks = rows.select("t", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("rep")).select("rep", (N.draw(42, "rep", "t") % n).alias("t"))
    return picks.join(rows, "t").groupBy("rep").agg(F.round(F.avg("c"), 6).alias("mean"))


_register("n6_bootstrap", _n6, _D + ", p AS (SELECT rep, " + _HASH.format(seed=42, parts="rep || ':' || t") + " % (SELECT count(*) FROM orders) AS t FROM draws, range(1, 21) q(rep)) SELECT CAST(rep AS INTEGER) AS rep, round(avg(c), 6) AS mean FROM p JOIN draws USING (t) GROUP BY rep")
_register("n8_null_draws", lambda s, d: draws(s, d).select("t", F.slice(F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(25)), lambda x: F.struct(F.md5(F.concat_ws(":", F.lit("7"), F.col("t").cast("string"), x.cast("string"))).alias("h"), x.alias("item")))), 1, 6).alias("xs")).select("t", F.explode("xs").alias("x")).select("t", "x.item"),
          _D + " SELECT t, CAST(k AS INTEGER) AS item FROM (SELECT t, k, row_number() OVER (PARTITION BY t ORDER BY md5('7:' || t || ':' || k)) AS r FROM draws, range(1, 26) q(k)) WHERE r <= 6")
_register("n9_chance_baselines", lambda s, d: I.baskets(items(s, d)).agg(F.min(F.size("xs")).alias("least"), F.expr("percentile(size(xs), 0.5)").alias("median"), F.round(F.avg(F.size("xs")), 6).alias("mean"), F.max(F.size("xs")).alias("most"), F.round(F.avg(F.size("xs") / 25), 6).alias("chance")),
          _I + ", z AS (SELECT t, CAST(count(*) AS INTEGER) AS n FROM items GROUP BY t) SELECT min(n) AS least, CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median, round(avg(n), 6) AS mean, max(n) AS most, round(avg(n / 25), 6) AS chance FROM z")

# predictors that need no model, and sets made of them
_register("p1_uniform_scores", lambda s, d: draws(s, d).select("t", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("symbol"), F.lit(0.1).alias("p")), _D + " SELECT t, CAST(k AS INTEGER) AS symbol, CAST(0.1 AS DOUBLE) AS p FROM draws, range(10) q(k)")
_GAPS = [(p, v) for p in DIGITS for v in range(10)]


def _p5(s, d):
    gaps = S.symbol_gap_uncapped(draws(s, d), {f"{p}_{v}": F.col(p) == v for p, v in _GAPS})
    most = {p: F.greatest(*(F.col(f"{p}_{v}") for v in range(10))) for p in DIGITS}
    sets = F.explode(F.array(*(F.struct(F.lit(p).alias("position"), L.normalised(F.array(*(F.exp((F.col(f"{p}_{v}") - most[p]) / 10.0) for v in range(10)))).alias("p")) for p in DIGITS))).alias("x")
    return gaps.select("t", sets).select("t", "x.position", F.posexplode("x.p").alias("symbol", "p")).withColumn("p", F.round("p", 6))


_register("p5_overdue_scores", _p5, _D + ", g AS (SELECT t, " + ", ".join(f"coalesce(t - max(CASE WHEN {p} = {v} THEN t END) OVER w, t) AS {p}_{v}" for p, v in _GAPS) + " FROM draws WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), x AS (" + " UNION ALL ".join(f"SELECT t, '{p}' AS position, [" + ", ".join(f"{p}_{v}" for v in range(10)) + "] AS g FROM g" for p in DIGITS)
          + "), e AS (SELECT t, position, list_transform(g, lambda y: exp((y - list_max(g)) / 10.0)) AS e FROM x) SELECT t, position, CAST(k AS INTEGER) AS symbol, round(e[k + 1] / list_sum(e), 6) AS p FROM e, range(10) q(k)")


_register("p15_delta_distribution", lambda s, d: draws(s, d).select("t", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.when(k == F.col("d1"), 0.91).otherwise(0.01))).alias("symbol", "p")), _D + " SELECT t, CAST(k AS INTEGER) AS symbol, CAST(CASE WHEN k = d1 THEN 0.91 ELSE 0.01 END AS DOUBLE) AS p FROM draws, range(10) q(k)")
_register("l20_cumulative_topk", lambda s, d: marginals(s, d).select("t", *(F.round(F.aggregate(F.slice(F.sort_array("p_d1", asc=False), 1, k), F.lit(0.0), lambda a, x: a + x), 6).alias(f"top{k}") for k in (1, 3, 5))),
          BASE + " SELECT t, " + ", ".join(f"round(list_sum(list_reverse_sort(p_d1)[1:{k}]), 6) AS top{k}" for k in (1, 3, 5)) + " FROM m")


def _l6(s, d):
    a = marginals(s, d).select("t", L.top_indices(F.col("p_d1"), 5).alias("a"))
    return a.join(marginals(s, d, 25).select("t", L.top_indices(F.col("p_d1"), 5).alias("b")), "t")


_L6 = BASE + ", " + "m25 AS (SELECT t, " + "list_transform(range(10), lambda s: (len(list_filter(l, lambda y: y = s)) + 1) / (len(l) + 10)) AS q FROM (SELECT t, coalesce(list(d1) OVER (ORDER BY t ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING), []) AS l FROM draws)), g AS (SELECT t, k, row_number() OVER (PARTITION BY t ORDER BY p_d1[k + 1] DESC, k) AS ra, row_number() OVER (PARTITION BY t ORDER BY q[k + 1] DESC, k) AS rb, d1 FROM m JOIN m25 USING (t), range(10) z(k))"
_register("l6_consensus_set", lambda s, d: _l6(s, d).select("t", F.concat_ws(",", F.array_sort(F.array_intersect("a", "b")).cast("array<string>")).alias("agreed")), _L6 + " SELECT t, coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (ra <= 5 AND rb <= 5), '') AS agreed FROM g GROUP BY t")


def _l7(s, d):
    rows = _l6(s, d).join(draws(s, d).select("t", "d1"), "t").withColumn("x", F.array_intersect("a", "b")).where(F.size("x") > 0)
    hit = F.array_contains("x", F.col("d1")).cast("int")
    return _r(rows.agg(F.count("*").alias("played"), F.avg(hit).alias("hit"), F.avg(F.size("x")).alias("tickets"), F.avg(hit * 10 - F.size("x")).alias("net")), "hit", "tickets", "net")


_register("l7_intersection_eval", _l7, _L6 + ", x AS (SELECT t, count(*) AS n, max(CAST(k = d1 AS INTEGER)) AS hit FROM g WHERE ra <= 5 AND rb <= 5 GROUP BY t) SELECT count(*) AS played, round(avg(hit), 6) AS hit, round(avg(n), 6) AS tickets, round(avg(hit * 10 - n), 6) AS net FROM x")
