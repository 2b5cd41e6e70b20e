"""Queries of predictors, their comparison, lag tests and configurations with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bindings import DRAWS, ITEMS, decayed_sql, draws, items, steps, table
from .catalog_relations import _r
from .catalog_scores import _BEST, BASE, TOP, marginals, numbered, sets
from .operators import configs as K
from .operators import inference as N
from .operators import patterns as Q
from .operators import predictors as P
from .operators import scores as L
from .storage import pinned, written

QUERIES: dict = {}
SQL: dict[str, str] = {}
DIGITS = ["d1", "d2", "d3"]
_D = "WITH " + DRAWS


def _register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _cut(s, d):
    return int(0.7 * steps(s, d))


def _after(s, d, df):
    return df.where(F.col("t") >= _cut(s, d))


def _previous(rows):
    return pinned(P.with_previous(rows, DIGITS))


def _markov(rows, cut):
    return P.given_key(rows.where(F.col("t") < cut), rows.where(F.col("t") >= cut), {c: f"was_{c}" for c in DIGITS}, 10)


def _conditional(rows, cut):
    return P.given_key(rows.where(F.col("t") < cut), rows.where(F.col("t") >= cut), dict.fromkeys(DIGITS, "was_bin"), 10)


_CUT = "CAST(floor(0.7 * (SELECT count(*) FROM orders)) AS BIGINT)"
#: Draws with the row before, and one CTE (t, position, symbol, p) for each strategy.
_PREV = _D + ", q AS (SELECT *, lag(d1) OVER w AS was_d1, lag(d2) OVER w AS was_d2, lag(d3) OVER w AS was_d3 FROM draws WINDOW w AS (ORDER BY t)), z AS (SELECT *, CASE WHEN was_d1 IS NOT NULL THEN (CASE WHEN was_d1 + was_d2 + was_d3 < 10 THEN 0 WHEN was_d1 + was_d2 + was_d3 < 18 THEN 1 ELSE 2 END) * 2 + CAST(len(list_distinct([was_d1, was_d2, was_d3])) < 3 AS INTEGER) END AS was_bin FROM q)"


def _given(column, key):
    return f"SELECT t, '{column}' AS position, CAST(k AS INTEGER) AS symbol, coalesce((n + 1) / (m + 10), 0.1) AS p FROM (SELECT t, {key} AS key FROM z WHERE t >= {_CUT}) a CROSS JOIN range(10) r(k) LEFT JOIN (SELECT {key} AS key, count(*) AS m FROM z WHERE t < {_CUT} AND {key} IS NOT NULL GROUP BY 1) USING (key) LEFT JOIN (SELECT key, s, count(x) AS n FROM (SELECT DISTINCT {key} AS key FROM z WHERE t < {_CUT} AND {key} IS NOT NULL) CROSS JOIN range(10) g(s) LEFT JOIN (SELECT {key} AS xk, {column} AS x FROM z WHERE t < {_CUT}) ON xk = key AND x = s GROUP BY 1, 2) c ON c.key = a.key AND c.s = k"


_MARKOV = ", markov AS (" + " UNION ALL ".join(_given(c, f"was_{c}") for c in DIGITS) + ")"
_COND = ", conditional AS (" + " UNION ALL ".join(_given(c, "was_bin") for c in DIGITS) + ")"
_RECENT = "".join(", " + decayed_sql(c, f"recent_{c}") for c in DIGITS) + ", recency AS (" + " UNION ALL ".join(f"SELECT t, '{c}' AS position, CAST(k AS INTEGER) AS symbol, coalesce(w / nullif(sum(w) OVER (PARTITION BY t), 0), 0.1) AS p FROM recent_{c}" for c in DIGITS) + ")"
_OVERDUE = ", overdue AS (" + " UNION ALL ".join(f"SELECT t, '{c}' AS position, CAST(k AS INTEGER) AS symbol, exp((g - max(g) OVER (PARTITION BY t)) / 10.0) / sum(exp((g - mg) / 10.0)) OVER (PARTITION BY t) AS p FROM (SELECT *, max(g) OVER (PARTITION BY t) AS mg FROM (SELECT t, k, coalesce(t - max(CASE WHEN {c} = k THEN t END) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t) AS g FROM draws, range(10) r(k)))" for c in DIGITS) + ")"
_OUT = "SELECT t, position, symbol, round(p, 6) AS p FROM {0} WHERE t >= " + _CUT
_register("p2_markov_scores", lambda s, d: _r(_markov(_previous(draws(s, d)), _cut(s, d)), "p"), _PREV + _MARKOV + " " + _OUT.format("markov"))
_register("p3_recency_weighted_scores", lambda s, d: _r(_after(s, d, P.recency(draws(s, d), DIGITS, 10)), "p"), _D + _RECENT + " " + _OUT.format("recency"))
_register("p4_conditional_freq", lambda s, d: _r(_conditional(_previous(draws(s, d)), _cut(s, d)), "p"), _PREV + _COND + " " + _OUT.format("conditional"))


def _p6(s, d):
    rows, cut = pinned(P.with_previous(draws(s, d), DIGITS)).where("was_d1 is not null"), _cut(s, d)
    return P.nearest(rows.where(F.col("t") < cut), rows.where(F.col("t") >= cut), [f"was_{c}" for c in DIGITS], "d1", 10)


_register("p6_knn_scores", lambda s, d: _r(_p6(s, d), "p"),
          _PREV + f""", y AS (SELECT * FROM z WHERE was_d1 IS NOT NULL), m AS (SELECT {", ".join(f"avg(was_{c}) AS m_{c}, stddev_pop(was_{c}) AS s_{c}" for c in DIGITS)} FROM y WHERE t < {_CUT}), n AS (SELECT t, d1, {", ".join(f"(was_{c} - m_{c}) / s_{c} AS x_{c}" for c in DIGITS)} FROM y, m),
j AS (SELECT a.t, b.t AS other, b.d1 AS y, round(sqrt({" + ".join(f"(a.x_{c} - b.x_{c}) ** 2" for c in DIGITS)}), 9) AS d FROM n a JOIN n b ON b.t < {_CUT} WHERE a.t >= {_CUT}), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY d, other) AS r FROM j) WHERE r <= 20)
SELECT t, CAST(v AS INTEGER) AS symbol, round(sum(CASE WHEN y = v THEN 1 / (d + 1e-6) ELSE 0 END) / sum(1 / (d + 1e-6)), 6) AS p FROM k, range(10) q(v) GROUP BY t, v""")


def _p14(s, d):
    spread = F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda k: F.col("d1") + k * F.col("d2") / 4.0)
    return draws(s, d).select("t", F.posexplode(P.quantiles_to_shares(spread, 10)).alias("symbol", "p")).withColumn("p", F.round("p", 6))


_register("p14_quantiles_to_distribution", _p14, _D + ", x AS (SELECT t, list_transform(range(-4, 5), lambda k: greatest(least(round_even(d1 + k * d2 / 4.0, 0), 9), 0)) AS q FROM draws), r AS (SELECT t, CAST(v AS INTEGER) AS symbol, len(list_filter(q, lambda y: y = v)) / 9 + 1e-6 AS w FROM x, range(10) g(v)) SELECT t, symbol, round(w / sum(w) OVER (PARTITION BY t), 6) AS p FROM r")


def _strategies(rows, cut):
    """Scores of five strategies for the rows from cut on; rows are numbered once for all of them."""
    near, after = _previous(rows), lambda x: x.where(F.col("t") >= cut)
    named = {"uniform": after(P.uniform(rows, DIGITS, 10)), "markov": _markov(near, cut), "recency": after(P.recency(rows, DIGITS, 10)), "conditional": _conditional(near, cut), "overdue": after(P.overdue(rows, DIGITS, 10))}
    return reduce(DataFrame.unionByName, (x.select("t", "position", "symbol", "p").withColumn("strategy", F.lit(n)) for n, x in named.items()))


def _actuals(rows):
    return rows.select("t", F.explode(F.array(*(F.struct(F.lit(c).alias("position"), F.col(c).alias("actual")) for c in DIGITS))).alias("x")).select("t", "x.*")


def _k15(s, d):
    rows = pinned(draws(s, d).select("t", *DIGITS))
    return _r(P.evaluate(_strategies(rows, _cut(s, d)), _actuals(rows), ["strategy", "position"]), "log_loss", "rank", "top1")


_register("k15_strategy_comparison", _k15,
          _PREV + _MARKOV + _COND + _RECENT + _OVERDUE + f""", every AS (SELECT 'uniform' AS strategy, t, position, CAST(k AS INTEGER) AS symbol, 0.1 AS p FROM draws, (SELECT unnest(['d1', 'd2', 'd3']) AS position), range(10) r(k) UNION ALL SELECT 'markov', * FROM markov UNION ALL SELECT 'conditional', * FROM conditional UNION ALL SELECT 'recency', * FROM recency UNION ALL SELECT 'overdue', * FROM overdue),
h AS (SELECT strategy, t, position, symbol, round(p, 9) AS p, CASE position WHEN 'd1' THEN d1 WHEN 'd2' THEN d2 ELSE d3 END AS actual FROM every JOIN draws USING (t) WHERE t >= {_CUT}), o AS (SELECT *, max(CASE WHEN symbol = actual THEN p END) OVER (PARTITION BY strategy, t, position) AS own FROM h),
r AS (SELECT strategy, t, position, any_value(own) AS own, 1 + count(*) FILTER (p > own OR (p = own AND symbol < actual)) AS rank FROM o GROUP BY 1, 2, 3) SELECT strategy, position, count(*) AS n, round(avg(-ln(greatest(own, 1e-15))), 6) AS log_loss, round(avg(rank), 6) AS rank, round(avg(CAST(rank = 1 AS INTEGER)), 6) AS top1 FROM r GROUP BY 1, 2""")


# probability sets
_register("l2_joint_from_marginals", lambda s, d: L.with_extremes(marginals(s, d), [f"p_{x}" for x in DIGITS]).select("t", F.round("most", 12).alias("most"), F.round("least", 12).alias("least"), F.round("total", 6).alias("total")),
          BASE + " SELECT t, round(list_max(p_d1) * list_max(p_d2) * list_max(p_d3), 12) AS most, round(list_min(p_d1) * list_min(p_d2) * list_min(p_d3), 12) AS least, 1.0 AS total FROM m")
_register("l19_digit_summary", lambda s, d: N.digit_summary(marginals(s, d), {c: f"p_{c}" for c in DIGITS}, 5),
          BASE + ", x AS (" + " UNION ALL ".join(f"SELECT t, '{c}' AS position, k, round(p_{c}[k + 1], 9) AS p FROM m, range(10) q(k)" for c in DIGITS) + "), r AS (SELECT *, row_number() OVER (PARTITION BY t, position ORDER BY p DESC, k) AS r FROM x) SELECT t, position, string_agg(k || ':' || CAST(CAST(round(p * 1000) AS BIGINT) AS VARCHAR), ' ' ORDER BY r) AS best FROM r WHERE r <= 5 GROUP BY 1, 2")
_register("l17_lag_head_logloss", lambda s, d: _r(N.lag_logloss(marginals(s, d), {c: f"p_{c}" for c in DIGITS}, draws(s, d), 5), "log_loss", "weight"),
          BASE + ", x AS (" + " UNION ALL ".join(f"SELECT a.t, CAST(k AS INTEGER) AS lag, '{c}' AS position, a.p_{c}[b.{c} + 1] AS p FROM m a, range(6) q(k), draws b WHERE b.t = a.t + k" for c in DIGITS) + ") SELECT lag, position, count(*) AS n, round(avg(-ln(p)), 6) AS log_loss, round(exp(-lag), 6) AS weight FROM x GROUP BY 1, 2")


def _l15(s, d):
    scored = P.score_sets(written(numbered(s, d)), DIGITS, 10, _cut(s, d), ["c"])
    ranked = L.with_rank(scored, [f"p_{c}" for c in DIGITS], "c")
    return N.straight_ev(ranked, "strategy", 500.0, 20)


_register("l15_straight_ev", lambda s, d: _r(_l15(s, d), "hit", "ev", "per_unit", "top1"),
          _PREV + _MARKOV + _COND + _RECENT + _OVERDUE + f""", every AS (SELECT 'markov' AS strategy, * FROM markov UNION ALL SELECT 'conditional', * FROM conditional UNION ALL SELECT 'recency', * FROM recency UNION ALL SELECT 'overdue', * FROM overdue),
l AS (SELECT strategy, t, list(round(p, 9) ORDER BY symbol) FILTER (position = 'd1') AS a, list(round(p, 9) ORDER BY symbol) FILTER (position = 'd2') AS b, list(round(p, 9) ORDER BY symbol) FILTER (position = 'd3') AS e FROM every WHERE t >= {_CUT} GROUP BY 1, 2),
j AS (SELECT strategy, t, g.x AS c, a[g.x // 100 + 1] * b[g.x // 10 % 10 + 1] * e[g.x % 10 + 1] AS p, draws.c AS actual FROM l JOIN draws USING (t), range(1000) g(x)), o AS (SELECT *, max(CASE WHEN c = actual THEN p END) OVER (PARTITION BY strategy, t) AS own FROM j),
r AS (SELECT strategy, t, 1 + count(*) FILTER (p > own OR (p = own AND c < actual)) AS rank FROM o GROUP BY 1, 2), k AS (SELECT strategy, CAST(y AS INTEGER) AS k, count(*) AS n, avg(CAST(rank <= y AS INTEGER)) AS hit, avg(CAST(rank <= y AS INTEGER)) * 500 - y AS ev, avg(CAST(rank = 1 AS INTEGER)) AS top1 FROM r, range(1, 21) q(y) GROUP BY strategy, y)
SELECT strategy, k, n, round(hit, 6) AS hit, round(ev, 6) AS ev, round(ev / k, 6) AS per_unit, round(top1, 6) AS top1 FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY round(ev, 9) DESC, k) AS r FROM k) WHERE r = 1""")

# inference
_HASH = "('0x' || substr(md5('{seed}:' || {parts}), 1, 12))::BIGINT"
_register("n3_pooled_lag_test", lambda s, d: _r(N.pooled_lag_test(sets(s, d), (1, 2), 20), "observed", "null_mean", "p"),
          TOP + f""", h AS (SELECT a.t, g.lag, b.at, a.chosen, b.actual FROM k a, (SELECT unnest([1, 2]) AS lag) g, (SELECT t AS at, actual FROM k) b WHERE b.at = a.t + g.lag), pn AS (SELECT *, row_number() OVER (ORDER BY lag, t) - 1 AS i FROM h),
x AS (SELECT rep, i, chosen, actual, row_number() OVER (PARTITION BY rep ORDER BY {_HASH.format(seed=42, parts="rep || ':' || i")}, i) - 1 AS source FROM pn, range(1, 21) q(rep)), st0 AS (SELECT avg(CAST({_BEST.format(a='actual')} >= 2 AS INTEGER)) AS observed, count(*) AS n FROM pn),
e AS (SELECT a.rep, avg(CAST({_BEST.format(a='b.actual').replace('chosen', 'a.chosen')} >= 2 AS INTEGER)) AS stat FROM x a JOIN x b ON a.rep = b.rep AND b.source = a.i GROUP BY 1) SELECT any_value(n) AS n, round(observed, 6) AS observed, round(avg(stat), 6) AS null_mean, round((1 + count(*) FILTER (stat >= observed)) / 21, 6) AS p FROM e, st0 GROUP BY observed""")
_register("n5_shuffle_surrogates", lambda s, d: _r(N.shuffled_information(P.with_previous(draws(s, d), DIGITS).where("was_d1 is not null").select("t", "was_d1", "d1"), "was_d1", "d1", 20), "observed", "null_mean", "null_p95", "p"),
          _PREV + f""", y AS (SELECT t, was_d1 AS a, d1 AS b, row_number() OVER (ORDER BY t) - 1 AS i FROM z WHERE was_d1 IS NOT NULL), x AS (SELECT rep, i, a, b, row_number() OVER (PARTITION BY rep ORDER BY {_HASH.format(seed=42, parts="rep || ':' || i")}, i) - 1 AS source FROM y, range(1, 21) q(rep)),
p AS (SELECT u.rep, u.a, v.b FROM x u JOIN x v ON v.rep = u.rep AND v.source = u.i UNION ALL SELECT 0, a, b FROM y), n AS (SELECT rep, a, b, count(*) AS n FROM p GROUP BY 1, 2, 3), m AS (SELECT *, sum(n) OVER (PARTITION BY rep, a) AS na, sum(n) OVER (PARTITION BY rep, b) AS nb, sum(n) OVER (PARTITION BY rep) AS m FROM n), i AS (SELECT rep, round(CAST(sum(n / m * ln(n * m / (na * nb))) AS DOUBLE), 9) AS mi FROM m GROUP BY rep)
SELECT round((SELECT mi FROM i WHERE rep = 0), 6) AS observed, round(avg(mi), 6) AS null_mean, round(quantile_cont(mi, 0.95), 6) AS null_p95, round((1 + count(*) FILTER (mi >= (SELECT mi FROM i WHERE rep = 0))) / 21, 6) AS p FROM i WHERE rep > 0""")


def _lifts(s, d):
    each, n = items(s, d), steps(s, d)
    real = Q.rule_tests(each, n, 5).select(F.col("lift").alias("real"))
    mixed = pinned(N.shuffled_steps(each, n, 3))
    lifts = [Q.rule_tests(mixed.where(F.col("rep") == r).drop("rep"), n, 5).select(F.col("lift").alias("shuffled")) for r in (1, 2, 3)]
    return N.exceedance(real, "real", reduce(DataFrame.unionByName, lifts), "shuffled")


_RULES = "(SELECT n * (m - 1) / (na * nb) AS lift FROM (SELECT x.item AS a, y.item AS b, count(*) AS n FROM {x} x JOIN {x} y ON y.t = x.t + 1 GROUP BY 1, 2 HAVING count(*) >= 5) JOIN (SELECT item AS a, count(*) AS na, any_value(steps) AS m FROM {x}, st WHERE t < steps - 1 GROUP BY 1) USING (a) JOIN (SELECT item AS b, count(*) AS nb FROM {x} WHERE t >= 1 GROUP BY 1) USING (b))"
_register("n10_exceedance", lambda s, d: _r(_lifts(s, d), "null_p95", "mean", "sd", "most"),
          "WITH " + ITEMS + f", mx AS (SELECT rep, t, row_number() OVER (PARTITION BY rep ORDER BY {_HASH.format(seed=42, parts="rep || ':' || t")}, t) - 1 AS at FROM draws, range(1, 4) q(rep)), " + ", ".join(f"m{r} AS (SELECT mx.at AS t, item FROM items JOIN mx ON mx.t = items.t AND rep = {r})" for r in (1, 2, 3)) + f", c AS (SELECT quantile_cont(lift, 0.95) AS p95, avg(lift) AS mean, stddev_samp(lift) AS sd, max(lift) AS most FROM ({' UNION ALL '.join('SELECT lift FROM ' + _RULES.format(x=f'm{r}') for r in (1, 2, 3))})) SELECT round(any_value(p95), 6) AS null_p95, round(any_value(mean), 6) AS mean, round(any_value(sd), 6) AS sd, round(any_value(most), 6) AS most, count(*) AS n, count(*) FILTER (lift > p95) AS above FROM {_RULES.format(x='items')}, c")
_register("n11_significant_cell_count", lambda s, d: _r(N.cell_count(N.lag_cells(sets(s, d), [0, 1, 2, 3, 4, 5], 20), 0.05), "expected"),
          TOP + f""", h AS (SELECT g.lag, a.t, a.chosen, b.actual FROM k a, (SELECT unnest(range(6)) AS lag) g, (SELECT t AS at, actual FROM k) b WHERE b.at = a.t + g.lag), pn AS (SELECT *, row_number() OVER (PARTITION BY lag ORDER BY t) - 1 AS i FROM h),
x AS (SELECT rep, lag, i, chosen, actual, row_number() OVER (PARTITION BY rep, lag ORDER BY {_HASH.format(seed=42, parts="rep || ':' || lag || ':' || i")}, i) - 1 AS source FROM pn, range(1, 21) q(rep)), ob AS (SELECT lag, avg(CAST({_BEST.format(a='actual')} >= 2 AS INTEGER)) AS observed FROM pn GROUP BY lag),
e AS (SELECT a.rep, a.lag, avg(CAST({_BEST.format(a='b.actual').replace('chosen', 'a.chosen')} >= 2 AS INTEGER)) AS stat FROM x a JOIN x b ON a.rep = b.rep AND a.lag = b.lag AND b.source = a.i GROUP BY 1, 2), c AS (SELECT lag, (1 + count(*) FILTER (stat >= observed)) / 21 AS p FROM e JOIN ob USING (lag) GROUP BY lag, observed) SELECT count(*) AS cells, count(*) FILTER (p < 0.05) AS found, round(count(*) * 0.05, 6) AS expected FROM c""")


# configurations of experiments, as nested rows made of the events
def _configs(s, d):
    return pinned(K.as_configs(table(s, d, "events")))


_CFG = """WITH e AS (SELECT user_id, event_id, event_type, value, CAST(props ->> '$.k' AS INTEGER) AS k FROM events), m AS (SELECT user_id, event_id, event_type, k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM e), c AS (SELECT user_id AS id, avg(value) FILTER (event_id % 2 = 0) AS val, avg(value) FILTER (event_id % 2 = 1) AS live FROM e GROUP BY 1),
mods AS (SELECT user_id AS id, r - 1 AS place, event_type AS kind, k AS depth FROM m WHERE r <= 4)
"""
_register("k9_config_pattern_counts", lambda s, d: K.pattern_counts(_configs(s, d), 20),
          _CFG + """, f AS (SELECT id, string_agg(kind, '+' ORDER BY kind) AS pattern FROM mods GROUP BY id), a AS (SELECT id FROM c WHERE live IS NOT NULL ORDER BY round(live, 9) DESC, id LIMIT 20), b AS (SELECT id FROM c WHERE val IS NOT NULL ORDER BY round(val, 9) DESC, id LIMIT 20)
SELECT pattern, count(*) FILTER (f.id IN (SELECT id FROM a)) AS by_live, count(*) FILTER (f.id IN (SELECT id FROM b)) AS by_val, count(*) FILTER (f.id IN (SELECT id FROM a) AND f.id IN (SELECT id FROM b)) AS in_both FROM f WHERE f.id IN (SELECT id FROM a) OR f.id IN (SELECT id FROM b) GROUP BY pattern""")
_register("k14_hyperparam_table", lambda s, d: K.hyperparameters(_configs(s, d), 10),
          _CFG + ", a AS (SELECT id, CAST(row_number() OVER (ORDER BY round(live, 9) DESC, id) AS INTEGER) AS rank FROM c WHERE live IS NOT NULL ORDER BY rank LIMIT 10) SELECT rank, id, CAST(place AS INTEGER) AS place, kind, depth, rank <= 5 AS candidate FROM a JOIN mods USING (id)")
_register("p17_validate_config", lambda s, d: K.violations(_configs(s, d), depths=(5, 95), most_models=3),
          _CFG + ", g AS (SELECT id, count(*) AS n, count(DISTINCT kind) AS kinds, min(depth) AS lo, max(depth) AS hi FROM mods GROUP BY id) SELECT id, 'models' AS field, 'over 3 models' AS problem FROM g WHERE n > 3 UNION ALL SELECT id, 'models', 'repeated kind' FROM g WHERE kinds < n UNION ALL SELECT id, 'depth', 'outside 5 to 95' FROM g WHERE lo < 5 OR hi > 95")
