"""Every registered query with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from . import catalog_features, catalog_io, catalog_models, catalog_patterns, catalog_predictors, catalog_relations, catalog_scalars, catalog_scores, catalog_structure, catalog_tests
from .bindings import DRAWS, ITEMS, draws, items, rows, steps, table
from .operators import feature_sets as B
from .operators import items as I
from .operators import resampling as N
from .operators import series as S
from .operators import tables as T

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
DIGITS = ["d1", "d2", "d3"]


def _register(name: str, query: Callable, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def _rounded(df, *names: str):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _with(base: str, body: str) -> str:
    return f"WITH {base}\n{body}"


# scans, joins, sets, aggregates
_register("s6_profile", lambda s, d: T.profile(table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")), "day"),
          "SELECT count(*) AS n, CAST(min(o_orderdate) AS DATE) AS first, CAST(max(o_orderdate) AS DATE) AS last FROM orders")
_register("s9_with_ordinal", lambda s, d: draws(s, d).select("t", "o_orderkey", "c"), _with(DRAWS, "SELECT t, o_orderkey, c FROM draws"))


def _s10(s, d):
    return T.missing_days(table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")), "day")


_register("s10_missing_days", _s10, """WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT CAST(day AS DATE) AS day FROM (SELECT unnest(generate_series((SELECT min(day) FROM x), (SELECT max(day) FROM x), INTERVAL 1 DAY)) AS day) EXCEPT SELECT day FROM x""")
_register("r1_range_filter", lambda s, d: T.between(table(s, d, "orders"), "o_orderdate", F.expr("timestamp_ntz'1995-01-01'"), F.expr("timestamp_ntz'1996-01-01'")).select("o_orderkey", "o_totalprice"),
          "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")


def _r2(s, d):
    each = table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderkey") % 4).alias("slot"), "o_orderkey")
    return T.complete_groups(each, ["day"], "slot", 4)


_register("r2_complete_groups", _r2, """WITH x AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey % 4 AS slot, o_orderkey FROM orders)
SELECT * FROM x WHERE day IN (SELECT day FROM x GROUP BY day HAVING count(DISTINCT slot) = 4)""")
_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_register("r3_latest_per_key", lambda s, d: T.latest(table(s, d, "lineitem"), ["l_orderkey"], _ORDER),
          f"SELECT l_orderkey, {', '.join(_ORDER)} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(x + ' DESC' for x in _ORDER)}) AS r FROM lineitem) WHERE r = 1")
_register("r4_pick_flagged", lambda s, d: table(s, d, "lineitem").groupBy(T.first_flagged([(F.col("l_returnflag") == "R", F.col("l_suppkey")), (F.col("l_linestatus") == "O", F.col("l_partkey"))], F.col("l_suppkey")).alias("picked")).agg(F.count("*").alias("n")),
          "SELECT CASE WHEN l_returnflag = 'R' THEN l_suppkey WHEN l_linestatus = 'O' THEN l_partkey ELSE l_suppkey END AS picked, count(*) AS n FROM lineitem GROUP BY 1")
_register("r5_left_equi_join", lambda s, d: T.match_counts(table(s, d, "customer"), table(s, d, "orders"), "c_custkey", "o_custkey"),
          "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
_register("r9_lag_self_join", lambda s, d: T.later(draws(s, d), "c", 3),
          _with(DRAWS, "SELECT a.t, a.c, b.c AS later FROM draws a JOIN draws b ON a.t = b.t - 3"))
_register("r11_anti_join_new", lambda s, d: T.only_new(table(s, d, "customer").select("c_custkey"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]),
          "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_register("r12_union_sources", lambda s, d: T.stacked({"c": table(s, d, "customer").select(F.col("c_nationkey").alias("nation")), "s": table(s, d, "supplier").select(F.col("s_nationkey").alias("nation"))}).groupBy("nation").agg(F.count("*").alias("n")),
          "SELECT nation, count(*) AS n FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY nation")
_register("r13_dedupe_keep_first", lambda s, d: T.keep_first(draws(s, d), ["day", "slot"], "t", ["c"]), _with(DRAWS, "SELECT day, slot, arg_min(c, t) AS c, min(t) AS t FROM draws GROUP BY day, slot"))
_register("r15_intersect_sets", lambda s, d: T.common_keys(table(s, d, "customer").select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))), "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_register("r17_sort_limit", lambda s, d: T.top(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 20), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
_register("r18_top_k_per_group", lambda s, d: T.top_per_group(table(s, d, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5).select("o_orderpriority", "r", "o_orderkey"),
          "SELECT o_orderpriority, CAST(r AS INTEGER) AS r, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 5")
_register("r19_hash_aggregate", lambda s, d: _rounded(T.describe(rows(s, d).withColumns({"y": F.year("day"), "m": F.month("day")}), ["y", "m"], "c"), "mean", "sd"),
          _with(DRAWS, "SELECT CAST(year(day) AS INTEGER) AS y, CAST(month(day) AS INTEGER) AS m, count(*) AS n, round(avg(c), 6) AS mean, round(stddev_samp(c), 6) AS sd, min(c) AS lo, max(c) AS hi FROM draws GROUP BY 1, 2"))
_register("r20_distinct_count", lambda s, d: T.distinct_counts(table(s, d, "lineitem"), {"parts": "l_partkey", "supps": "l_suppkey"}), "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem")
_register("r21_value_counts", lambda s, d: T.value_counts(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"]), "SELECT l_returnflag || '|' || l_linestatus AS key, count(*) AS n FROM lineitem GROUP BY 1")
_register("r22_group_transform", lambda s, d: T.group_ordinals(draws(s, d), ["day"]).select("t", "slot", "first_t", "seen"),
          _with(DRAWS, "SELECT t, slot, min(t) OVER (PARTITION BY day) AS first_t, CAST(row_number() OVER (PARTITION BY day ORDER BY t) - 1 AS INTEGER) AS seen FROM draws"))
_register("r23_split_by_time", lambda s, d: draws(s, d).groupBy(T.time_split(F.col("t"), steps(s, d), {"train": 0.7, "val": 0.85}, "test").alias("split")).agg(F.count("*").alias("n"), F.min("day").alias("lo"), F.max("day").alias("hi")),
          _with(DRAWS, "SELECT CASE WHEN t < 0.7 * (SELECT count(*) FROM orders) THEN 'train' WHEN t < 0.85 * (SELECT count(*) FROM orders) THEN 'val' ELSE 'test' END AS split, count(*) AS n, min(day) AS lo, max(day) AS hi FROM draws GROUP BY 1"))
_register("r25_percentile_stats", lambda s, d: _rounded(T.percentiles(table(s, d, "orders"), ["o_orderpriority"], "o_totalprice", {"p50": 0.5, "p95": 0.95}), "p50", "p95"),
          "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.95), 6) AS p95 FROM orders GROUP BY 1")
_register("r26_seeded_subset", lambda s, d: T.seeded_subset(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 100, 7), "SELECT o_orderkey FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 100")

# scalar functions
_register("c5_cyclic_encoding", lambda s, d: draws(s, d).select("t", *(F.round(x, 6).alias(n) for x, n in zip(T.cyclic(F.dayofyear("day"), 365.25), ("sin_doy", "cos_doy")))),
          _with(DRAWS, "SELECT t, round(sin(2 * 3.141592653589793 * dayofyear(day) / 365.25), 6) AS sin_doy, round(cos(2 * 3.141592653589793 * dayofyear(day) / 365.25), 6) AS cos_doy FROM draws"))
_register("c10_box_key", lambda s, d: rows(s, d).select(T.box_key(DIGITS).alias("box"), T.orbit(DIGITS).alias("k")).groupBy("box").agg(F.count("*").alias("n"), F.max("k").alias("orbit"), F.max(F.when(F.col("k") == 6, 80).when(F.col("k") == 3, 160).otherwise(0)).alias("payout")),
          _with(DRAWS, "SELECT array_to_string(list_sort([d1, d2, d3]), '') AS box, count(*) AS n, max(CASE len(list_distinct([d1, d2, d3])) WHEN 3 THEN 6 WHEN 2 THEN 3 ELSE 1 END) AS orbit, max(CASE len(list_distinct([d1, d2, d3])) WHEN 3 THEN 80 WHEN 2 THEN 160 ELSE 0 END) AS payout FROM draws GROUP BY 1"))

# causal windows
def _built(*sets):
    """The columns of these sets, rounded."""

    def query(s, d):
        out = B.build_features(draws(s, d), list(sets) or None, places=6)
        return out.select("t", *(F.col(c).cast("double").alias(c) for c in out.columns if c != "t"))

    return query


def _wide(exprs: dict[str, str]) -> str:
    return ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in exprs.items())


_SHAPE = {"digit_1": "a", "digit_2": "b", "digit_3": "c", "sum": "a + b + c", "repeating": "CAST(len(list_distinct([a, b, c])) < 3 AS INTEGER)", "triple": "CAST(a = b AND b = c AS INTEGER)",
          "sequential": "CAST(list_sort([a, b, c])[2] - list_sort([a, b, c])[1] = 1 AND list_sort([a, b, c])[3] - list_sort([a, b, c])[2] = 1 AS INTEGER)",
          "odd": "a % 2 + b % 2 + c % 2", "even": "3 - (a % 2 + b % 2 + c % 2)", "high": "CAST(a >= 5 AS INTEGER) + CAST(b >= 5 AS INTEGER) + CAST(c >= 5 AS INTEGER)",
          "low": "3 - (CAST(a >= 5 AS INTEGER) + CAST(b >= 5 AS INTEGER) + CAST(c >= 5 AS INTEGER))"}
_PRE = DRAWS + ", prev AS (SELECT t, lag(d1) OVER w AS a, lag(d2) OVER w AS b, lag(d3) OVER w AS c FROM draws WINDOW w AS (ORDER BY t))"
#: SQL of each feature set by name; w<n> are windows of n rows before.
FEATURE_SQL: dict[str, dict[str, str]] = {
    "basic": {f"prev_{k}": f"CASE WHEN t = 0 THEN 0 ELSE {v} END" for k, v in _SHAPE.items()},
    "recency": {f"f{n}_d{p}_{v}": f"coalesce(count(*) FILTER (d{p} = {v}) OVER w{n} / nullif(count(*) OVER w{n}, 0), 0)" for n in (10, 25, 50, 100) for p in (1, 2, 3) for v in range(10)} | {"combo_gap": "coalesce(lag(own_gap) OVER wt, 1000)"},
    "gaps": {f"gap_{v}": f"least(coalesce(t - max(CASE WHEN {v} IN (d1, d2, d3) THEN t END) OVER wa, t), 1000)" for v in range(10)} | {f"d{p}_gap_{v}": f"least(coalesce(t - max(CASE WHEN d{p} = {v} THEN t END) OVER wa, t), 1000)" for p in (1, 2, 3) for v in range(10)},
    "temporal": {f"dow_{k}": f"CAST(isodow(day) = {k + 1} AS INTEGER)" for k in range(7)} | {f"month_{k}": f"CAST(month(day) = {k} AS INTEGER)" for k in range(1, 13)}
    | {"year_share": "(year(day) - min(year(day)) OVER ()) / greatest(max(year(day)) OVER () - min(year(day)) OVER (), 1)"},
    "draw_time": {f"slot_{k}": f"CAST(slot = {k} AS INTEGER)" for k in range(4)},
    "equipment": {n: e for k in ("machine", "ball1", "ball2", "ball3") for n, e in ((f"{k}_uses", f"CASE WHEN {k} IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY {k} ORDER BY t) - 1 END"), (f"{k}_age", f"CASE WHEN {k} IS NULL THEN 0 ELSE day - min(day) OVER (PARTITION BY {k} ORDER BY t) END"))},
}
_WINDOWS = "WINDOW wt AS (ORDER BY t), wa AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), " + ", ".join(f"w{n} AS (ORDER BY t ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (10, 25, 50, 100))


def _feature_sql(*sets: str) -> str:
    exprs: dict[str, str] = {}
    for x in sets:
        exprs |= FEATURE_SQL[x]
    gap = ", g AS (SELECT *, least(coalesce(t - lag(t) OVER (PARTITION BY draws.c ORDER BY t), 1000), 1000) AS own_gap FROM draws)"
    return _with(_PRE + gap, f"SELECT t, {_wide(exprs)} FROM (SELECT g.* EXCLUDE (c), a, b, prev.c AS c FROM g JOIN prev USING (t)) {_WINDOWS}")


_register("w1_previous_shape", _built("basic"), _feature_sql("basic"))
_register("w2_rolling_symbol_freq", _built("recency"), _feature_sql("recency"))
_register("w3_combo_gap", lambda s, d: S.key_gap(draws(s, d), "c").select("t", "gap"), _with(DRAWS, "SELECT t, least(coalesce(t - lag(t) OVER (PARTITION BY c ORDER BY t), 1000), 1000) AS gap FROM draws"))
_ANY = ", ".join(f"least(coalesce(t - max(CASE WHEN {v} IN (d1, d2, d3) THEN t END) OVER w, t), 1000) AS gap_{v}" for v in range(10))
_register("w4_symbol_gap_any", lambda s, d: S.symbol_gap(draws(s, d), {f"gap_{v}": (F.col("d1") == v) | (F.col("d2") == v) | (F.col("d3") == v) for v in range(10)}).select("t", *(f"gap_{v}" for v in range(10))),
          _with(DRAWS, f"SELECT t, {_ANY} FROM draws WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
_POS = ", ".join(f"least(coalesce(t - max(CASE WHEN d{p} = {v} THEN t END) OVER w, t), 1000) AS d{p}_gap_{v}" for p in (1, 2, 3) for v in range(10))
_register("w5_symbol_gap_pos", lambda s, d: S.symbol_gap(draws(s, d), {f"{p}_gap_{v}": F.col(p) == v for p in DIGITS for v in range(10)}).select("t", *(f"{p}_gap_{v}" for p in DIGITS for v in range(10))),
          _with(DRAWS, f"SELECT t, {_POS} FROM draws WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))


def _corr_sql(a, b):
    m, sx, sy, sxy, sxx, syy = "count(*) OVER w", f"sum({a}) OVER w", f"sum({b}) OVER w", f"sum({a} * {b}) OVER w", f"sum({a} * {a}) OVER w", f"sum({b} * {b}) OVER w"
    return f"round(CASE WHEN {m} < 2 THEN 0 ELSE coalesce(({m} * {sxy} - {sx} * {sy}) / nullif(sqrt(({m} * {sxx} - {sx} * {sx}) * ({m} * {syy} - {sy} * {sy})), 0), 0) END, 6) AS corr_{a}_{b}"


_PAIRS = [("d1", "d2"), ("d1", "d3"), ("d2", "d3")]
_CORR = [f"corr_{a}_{b}" for a, b in _PAIRS]
_register("w7_rolling_pair_corr", lambda s, d: _rounded(S.rolling_correlation(draws(s, d), _PAIRS, 50), *_CORR).select("t", *_CORR),
          _with(DRAWS, f"SELECT t, {', '.join(_corr_sql(*p) for p in _PAIRS)} FROM draws WINDOW w AS (ORDER BY t ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)"))


def _uniform_sql(c):
    n = [f"count(*) FILTER ({c} = {v}) OVER w" for v in range(10)]
    m = "count(*) OVER w"
    chi = " + ".join(f"({k} - {m} / 10) * ({k} - {m} / 10) / ({m} / 10)" for k in n)
    bits = " + ".join(f"CASE WHEN {k} > 0 THEN -({k} / {m}) * log2({k} / {m}) ELSE 0 END" for k in n)
    return f"round(CASE WHEN t >= 5 THEN {chi} ELSE 0 END, 6) AS {c}_chi2, round(CASE WHEN t >= 5 THEN {bits} ELSE 0 END, 6) AS {c}_entropy"


_UNI = [f"{c}_{k}" for c in DIGITS for k in ("chi2", "entropy")]
_register("w9_w10_rolling_uniformity", lambda s, d: _rounded(S.rolling_uniformity(draws(s, d), DIGITS, range(10), 50), *_UNI).select("t", *_UNI),
          _with(DRAWS, f"SELECT t, {', '.join(map(_uniform_sql, DIGITS))} FROM draws WINDOW w AS (ORDER BY t ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)"))
_register("w11_step_overlap", lambda s, d: S.step_overlap(draws(s, d).withColumn("ds", F.array(*DIGITS)), "ds").select("t", "overlap"),
          _with(DRAWS, ", x AS (SELECT t, lag([d1, d2, d3], 1) OVER (ORDER BY t) AS a, lag([d1, d2, d3], 2) OVER (ORDER BY t) AS b FROM draws) SELECT t, CAST(coalesce(len(list_distinct(list_intersect(a, b))), 0) AS INTEGER) AS overlap FROM x"))
_register("w8_calendar_onehot", _built("temporal"), _feature_sql("temporal"))
_register("w12_key_usage", _built("equipment"), _feature_sql("equipment"))
FEATURE_SQL["position"] = {f"p_d{p}_{v}": f"coalesce(count(*) FILTER (d{p} = {v}) OVER w50 / nullif(count(*) OVER w50, 0), 0)" for p in (1, 2, 3) for v in range(10)} | {f"corr_{a}_{b}": _corr_sql(a, b).rsplit(" AS ", 1)[0].replace("OVER w", "OVER w50") for a, b in _PAIRS}
FEATURE_SQL["momentum"] = {f"{c}_{k}": e.rsplit(f" AS {c}_entropy", 1)[0] for c in DIGITS for k, e in zip(("chi2", "entropy"), _uniform_sql(c).replace("OVER w", "OVER w50").split(f" AS {c}_chi2, "))} | {
    "overlap": "CASE WHEN t < 2 THEN 0 ELSE len(list_distinct(list_intersect([lag(d1, 1) OVER wt, lag(d2, 1) OVER wt, lag(d3, 1) OVER wt], [lag(d1, 2) OVER wt, lag(d2, 2) OVER wt, lag(d3, 2) OVER wt]))) END"}
build_features = _built()
_register("w13_build_features", build_features, _feature_sql(*B.SETS))
_register("w15_drift_windows", lambda s, d: _rounded(S.hopping_chi2(draws(s, d), "d1", 200, 50, 10), "chi2"),
          _with(DRAWS, """, x AS (SELECT d1, unnest(range(CAST(greatest(0, floor((t - 200) / 50) + 1) AS BIGINT), CAST(t // 50 + 1 AS BIGINT))) * 50 AS start FROM draws), n AS (SELECT start, d1, count(*) AS n FROM x GROUP BY 1, 2)
SELECT start, round(sum(n * n) * 10 / 200 - 200, 6) AS chi2 FROM n WHERE start < (SELECT count(*) - 200 FROM orders) GROUP BY start"""))
_register("w22_decay_presence", lambda s, d: _rounded(I.decayed_presence(items(s, d)), "presence"),
          _with(ITEMS, "SELECT t + k AS t, item, round(sum(exp(-1.0 * k)), 6) AS presence FROM items, range(1, 11) r(k) GROUP BY 1, 2"))
_register("w25_context_windows", lambda s, d: S.context_windows(draws(s, d), DIGITS, 8).select("t", F.concat_ws(",", F.transform("context", lambda x: F.concat(x["d1"].cast("string"), x["d2"].cast("string"), x["d3"].cast("string")))).alias("context"), *(F.col("target")[c].alias(f"y_{c}") for c in DIGITS)),
          _with(DRAWS, ", x AS (SELECT t, d1, d2, d3, string_agg(d1 || '' || d2 || '' || d3, ',') OVER (ORDER BY t ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS context FROM draws) SELECT t, context || ',111' AS context, d1 AS y_d1, d2 AS y_d2, d3 AS y_d3 FROM x WHERE t >= 8"))
_register("w26_lag_targets", lambda s, d: S.lag_targets(draws(s, d), "d1", 3), _with(DRAWS, "SELECT a.t, a.d1 AS y0, b.d1 AS y1, c.d1 AS y2, e.d1 AS y3 FROM draws a JOIN draws b ON b.t = a.t + 1 JOIN draws c ON c.t = a.t + 2 JOIN draws e ON e.t = a.t + 3"))
_register("w29_seasonal_naive", lambda s, d: S.over_chunks(draws(s, d), lambda w: {"naive": F.lag("c", 4).over(w)}, 4).select("t", "c", "naive"), _with(DRAWS, "SELECT t, c, lag(c, 4) OVER (ORDER BY t) AS naive FROM draws"))

# items: tests, dependence, patterns, spells
_register("w16_item_gaps", lambda s, d: _rounded(I.item_gaps(items(s, d)), "mean_gap"),
          _with(ITEMS, ", g AS (SELECT item, t, t - lag(t) OVER (PARTITION BY item ORDER BY t) AS gap FROM items) SELECT item, count(gap) AS gaps, round(avg(gap), 6) AS mean_gap, max(gap) AS longest, max(t) AS last_t FROM g GROUP BY item"))
_DENSE = ", x AS (SELECT i.item, g.t, CAST(h.t IS NOT NULL AS INTEGER) AS x, steps FROM (SELECT DISTINCT item FROM items) i, (SELECT t FROM draws) g, st LEFT JOIN items h ON h.item = i.item AND h.t = g.t)"
_register("f18_adjust_pvalues", lambda s, d: _rounded(I.adjust_p_values(table(s, d, "part").select("p_partkey", F.col("p_brand").alias("family"), ((F.col("p_partkey") * 37 % 1009 + 1) / 1010).alias("p")), "p", "family"), "p", "p_bh", "p_bonferroni"),
          """WITH x AS (SELECT p_partkey, p_brand AS family, (p_partkey * 37 % 1009 + 1) / 1010 AS p FROM part), r AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, rank() OVER (PARTITION BY family ORDER BY p) AS r FROM x)
SELECT p_partkey, family, round(p, 6) AS p, round(least(1, min(p * m / r) OVER (PARTITION BY family ORDER BY r DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_bh, round(least(1, p * m), 6) AS p_bonferroni FROM r""")
_register("g4_mutual_info_binned", lambda s, d: _rounded(I.mutual_information(S.over_chunks(draws(s, d), lambda w: {"was": F.lag("d1", 1).over(w)}, 1).where("was is not null"), "was", "d1"), "mi"),
          _with(DRAWS, ", l AS (SELECT lag(d1) OVER (ORDER BY t) AS a, d1 AS b FROM draws), n AS (SELECT a, b, count(*) AS n FROM l WHERE a IS NOT NULL GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS m FROM n) SELECT round(CAST(sum(n / m * ln(n * m / (na * nb))) AS DOUBLE), 6) AS mi FROM m"))
_register("g7_excitation_ratio", lambda s, d: _rounded(I.excitation_ratio(items(s, d), steps(s, d), 2), "ratio"),
          _with(ITEMS, """, a AS (SELECT item AS a, count(*) AS na FROM items, st WHERE t < steps - 2 GROUP BY 1), b AS (SELECT item AS b, count(*) AS nb FROM items WHERE t >= 2 GROUP BY 1),
j AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM items x JOIN items y ON y.t = x.t + 2 GROUP BY 1, 2)
SELECT a.a, b.b, round(coalesce((coalesce(n, 0) / na) / nullif((nb - coalesce(n, 0)) / nullif(steps - 2 - na, 0), 0), 1), 6) AS ratio FROM a JOIN b ON a.a <> b.b CROSS JOIN st LEFT JOIN j ON j.a = a.a AND j.b = b.b"""))
_register("o1_pair_cooccurrence", lambda s, d: I.pair_counts(items(s, d)), _with(ITEMS, "SELECT x.item AS a, y.item AS b, count(*) AS n FROM items x JOIN items y ON x.t = y.t AND x.item < y.item GROUP BY 1, 2"))
_register("o3_cross_step_pairs", lambda s, d: I.cross_step_pairs(items(s, d), 50), _with(ITEMS, "SELECT x.item AS a, y.item AS b, count(*) AS n FROM items x JOIN items y ON y.t = x.t + 1 GROUP BY 1, 2 HAVING count(*) >= 50"))
_register("o13_base_rates", lambda s, d: _rounded(I.base_rates(items(s, d), steps(s, d)), "rate"), _with(ITEMS, "SELECT item, round(count(*) / any_value(steps), 6) AS rate FROM items, st GROUP BY item"))
_SPELLS = ", w AS (SELECT item, t AS start, coalesce(lead(t) OVER (PARTITION BY item ORDER BY t), steps) - t AS duration, CAST(lead(t) OVER (PARTITION BY item ORDER BY t) IS NOT NULL AS INTEGER) AS event FROM items, st)"
_register("v2_spells", lambda s, d: I.spells(items(s, d), steps(s, d)), _with(ITEMS + _SPELLS, "SELECT * FROM w WHERE duration > 0"))
_register("v3_exponential_hazard", lambda s, d: _rounded(I.exponential_hazard(I.spells(items(s, d), steps(s, d))), "rate", "p1"), _with(ITEMS + _SPELLS, "SELECT item, round(sum(event) / sum(duration), 6) AS rate, round(1 - exp(-sum(event) / sum(duration)), 6) AS p1 FROM w WHERE duration > 0 GROUP BY item"))


# predictors, nulls, ledgers
_register("n2_permutation_null", lambda s, d: _rounded(N.permutation_match(S.over_chunks(draws(s, d), lambda w: {"guess": F.lag("d1", 1).over(w)}, 1).where("t > 0"), "guess", "d1", "t", 100), "observed", "null_mean", "null_p95", "p"),
          _with(DRAWS, """, g AS (SELECT t, lag(d1) OVER (ORDER BY t) AS guess, d1 FROM draws), x AS (SELECT * FROM g WHERE t > 0), r AS (SELECT *, rep FROM x, range(1, 101) q(rep)),
o AS (SELECT rep, t, guess, d1, row_number() OVER (PARTITION BY rep ORDER BY t) AS slot, row_number() OVER (PARTITION BY rep ORDER BY ('0x' || substr(md5('42:' || rep || ':' || t), 1, 12))::BIGINT, t) AS source FROM r),
e AS (SELECT a.rep, avg(CAST(a.guess = b.d1 AS DOUBLE)) AS stat FROM o a JOIN o b ON a.rep = b.rep AND a.slot = b.source GROUP BY 1), s AS (SELECT avg(CAST(guess = d1 AS DOUBLE)) AS observed FROM x)
SELECT round(observed, 6) AS observed, round(avg(stat), 6) AS null_mean, round(quantile_cont(stat, 0.95), 6) AS null_p95, round((1 + count(*) FILTER (stat >= observed)) / 101, 6) AS p FROM e, s GROUP BY observed"""))
_register("n2_permutation_null_all", _QUERIES["n2_permutation_null"], _SQL["n2_permutation_null"])  # its name when the other one read a part
_register("n7_sign_flip", lambda s, d: _rounded(N.sign_flip(draws(s, d).select("t", (F.col("d1") - F.col("d2")).cast("double").alias("x")), "x", "t", 50), "observed", "p"),
          _with(DRAWS, """, f AS (SELECT rep, round(avg(CASE WHEN ('0x' || substr(md5('42:' || rep || ':' || t), 1, 12))::BIGINT % 2 = 0 THEN d1 - d2 ELSE d2 - d1 END), 9) AS m FROM draws, range(1, 51) q(rep) GROUP BY 1), s AS (SELECT round(avg(d1 - d2), 9) AS observed, count(*) AS n FROM draws)
SELECT round(observed, 6) AS observed, n, round((1 + count(*) FILTER (abs(m) >= abs(observed))) / 51, 6) AS p FROM f, s GROUP BY 1, 2, observed"""))
# running stats of ledgers are with the scores
_register("k7_leaderboard", lambda s, d: _rounded(table(s, d, "events").groupBy("user_id").agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("val"), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("live")), "val", "live").orderBy(F.desc_nulls_last("live"), "user_id").limit(20),
          "SELECT user_id, round(avg(value) FILTER (event_id % 2 = 0), 6) AS val, round(avg(value) FILTER (event_id % 2 = 1), 6) AS live FROM events GROUP BY 1 ORDER BY live DESC NULLS LAST, user_id LIMIT 20")
_register("k11_mode_mix", lambda s, d: _rounded(table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("event_id")).alias("repeats")).join(F.broadcast(table(s, d, "events").agg(F.count("*").alias("m")))).select("event_type", (F.col("n") / F.col("m")).alias("share"), "repeats"), "share"),
          "SELECT event_type, round(count(*) / (SELECT count(*) FROM events), 6) AS share, count(*) - count(DISTINCT event_id) AS repeats FROM events GROUP BY 1")


def queries() -> dict[str, Callable]:
    return _QUERIES | catalog_scores.QUERIES | catalog_io.QUERIES | catalog_relations.QUERIES | catalog_patterns.QUERIES | catalog_features.QUERIES | catalog_models.QUERIES | catalog_tests.QUERIES | catalog_structure.QUERIES | catalog_predictors.QUERIES | catalog_scalars.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | catalog_scores.SQL | catalog_io.SQL | catalog_relations.SQL | catalog_patterns.SQL | catalog_features.SQL | catalog_models.SQL | catalog_tests.SQL | catalog_structure.SQL | catalog_predictors.SQL | catalog_scalars.SQL
