"""Queries of survival panels, segments, profiles, communities, contexts and families of patterns with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bindings import COVARIATES, DRAWS, ITEMS, draws, items, joined, order_items, rows, steps
from .catalog_patterns import _name
from .catalog_relations import _chi_sql, _r
from .catalog_scalars import _B, _EVENTS, _steps
from .operators import contexts as W
from .operators import features as E
from .operators import items as I
from .operators import learned as M
from .operators import patterns as P
from .operators import profiles as Q
from .operators import relations as G
from .operators import series as S
from .operators import survival as V
from .storage import pinned

QUERIES: dict = {}
SQL: dict[str, str] = {}
DIGITS = ["d1", "d2", "d3"]
_D, _I = "WITH " + DRAWS, "WITH " + ITEMS


def _register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# survival
_GAPS = [f"gap_{k}_{n}" for n in (5, 10, 20) for k in ("mean", "sd")]


def _v1(s, d):
    each, n = items(s, d), steps(s, d)
    return _r(V.survival_panel(each, W.every_step(s, each, n), s.range(1, 26).select(F.col("id").cast("int").alias("item")), 0, n), *_GAPS, "runs_ratio")


_register("v1_survival_panel", _v1, _B + """, g AS (SELECT CAST(k AS INTEGER) AS item, d.t, CAST(i.t IS NOT NULL AS INTEGER) AS event FROM range(1, 26) q(k) CROSS JOIN draws d LEFT JOIN items i ON i.item = k AND i.t = d.t),
w AS (SELECT *, max(CASE WHEN event = 1 THEN t END) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hit, sum(event) OVER (b ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS u20, sum(event) OVER (b ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS u50, sum(event) OVER (b ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS u100,
  CAST(event <> coalesce(lag(event) OVER b, -1) AS INTEGER) AS turns FROM g WINDOW b AS (PARTITION BY item ORDER BY t)),
r AS (SELECT *, sum(turns) OVER b AS island, sum(turns * event) OVER b AS came FROM w WINDOW b AS (PARTITION BY item ORDER BY t ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, row_number() OVER (PARTITION BY item, island ORDER BY t) AS length FROM r),
l AS (SELECT *, coalesce(lag(length) OVER b, 0) AS run, coalesce(lag(2 * event - 1) OVER b, 0) AS direction, lag(island) OVER b AS runs, greatest(1, lag(came) OVER b) AS appear FROM s WINDOW b AS (PARTITION BY item ORDER BY t)),
y AS (SELECT item, t, t - lag(t) OVER (PARTITION BY item ORDER BY t) AS gap FROM items),
q AS (SELECT item, t""" + "".join(f", avg(gap) OVER w{n} AS mean_{n}, stddev_pop(gap) OVER w{n} AS sd_{n}, min(gap) OVER w{n} AS least_{n}, max(gap) OVER w{n} AS most_{n}" for n in (5, 10, 20)) + " FROM y WHERE gap IS NOT NULL WINDOW " + ", ".join(f"w{n} AS (PARTITION BY item ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 10, 20)) + """),
pr AS (SELECT a.item AS a, b.item AS b, count(*) AS n FROM items a JOIN items b ON a.t = b.t AND a.item <> b.item GROUP BY 1, 2), tp AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM pr) WHERE r <= 5), pa AS (SELECT i.t + 1 AS t, tp.a AS item, count(*) AS partners FROM items i JOIN tp ON tp.b = i.item GROUP BY 1, 2),
px AS (SELECT t + 1 AS t, sum(item) AS total, max(item) - min(item) AS range, count(*) FILTER (item % 2 = 1) AS odd, max(item) AS top FROM items GROUP BY t)
SELECT l.item, l.t, event, CASE WHEN hit IS NULL THEN l.t + 1 ELSE l.t - hit END AS since, """ + ", ".join(f"round(coalesce({k}_{n}, 0), 6) AS gap_{k}_{n}" if k in ("mean", "sd") else f"CAST(coalesce({k}_{n}, 0) AS DOUBLE) AS gap_{k}_{n}" for n in (5, 10, 20) for k in ("mean", "sd", "least", "most")) + """, CAST(coalesce(u20, 0) AS INTEGER) AS uses_20, CAST(coalesce(u50, 0) AS INTEGER) AS uses_50, CAST(coalesce(u100, 0) AS INTEGER) AS uses_100,
  run, direction, round(coalesce(greatest(1, runs - appear) / appear, 1), 6) AS runs_ratio, CAST(coalesce(partners, 0) AS INTEGER) AS partners, CAST(coalesce(total, 0) AS BIGINT) AS prev_total, coalesce(range, 0) AS prev_range, CAST(coalesce(odd, 0) AS INTEGER) AS prev_odd, CAST(coalesce(top = l.item, false) AS INTEGER) AS was_max
FROM l ASOF LEFT JOIN q ON q.item = l.item AND q.t < l.t LEFT JOIN pa ON pa.item = l.item AND pa.t = l.t LEFT JOIN px ON px.t = l.t""")


def _covered(s, d):
    """Spells with covariates of their start."""
    waits = I.spells(items(s, d), steps(s, d))
    return waits.join(draws(s, d).select(F.col("t").alias("start"), "d1", "slot"), "start").withColumn("low", (F.col("item") <= 12).cast("int"))


_register("v2_spell_covariates", lambda s, d: _covered(s, d).select("item", "start", "duration", "event", "d1", "slot", "low"),
          _I + ", w AS (SELECT item, t AS start, coalesce(lead(t) OVER (PARTITION BY item ORDER BY t), steps) - t AS duration, CAST(lead(t) OVER (PARTITION BY item ORDER BY t) IS NOT NULL AS INTEGER) AS event FROM items, st) SELECT item, start, duration, event, d1, slot, CAST(item <= 12 AS INTEGER) AS low FROM w JOIN draws ON t = start WHERE duration > 0")


def _v4(s, d):
    found = V.cox(_covered(s, d), ["d1", "slot", "low"])
    return s.createDataFrame([(k, float(round(v, 6))) for k, v in found.items()], "covariate string, beta double")  # three numbers


_register("v4_cox_ph", _v4)


def _v6(s, d):
    waits = I.spells(items(s, d), steps(s, d))
    return _r(P.concordance(waits.join(F.broadcast(_r(I.exponential_hazard(waits), "rate", digits=9)), "item"), "duration", "event", "rate"), "c_index")


_SP = ", w AS (SELECT item, coalesce(lead(t) OVER (PARTITION BY item ORDER BY t), steps) - t AS duration, CAST(lead(t) OVER (PARTITION BY item ORDER BY t) IS NOT NULL AS INTEGER) AS event FROM items, st), sp AS (SELECT * FROM w WHERE duration > 0), rt AS (SELECT item, round(sum(event) / sum(duration), 9) AS rate FROM sp GROUP BY item)"
_register("v6_concordance_index", _v6, _I + _SP + ", h AS (SELECT duration AS d, rate AS r, count(*) AS n, sum(event) AS e FROM sp JOIN rt USING (item) GROUP BY 1, 2) SELECT CAST(sum(a.e * b.n) AS BIGINT) AS pairs, round(sum(a.e * b.n * CASE WHEN a.r > b.r THEN 1 WHEN a.r = b.r THEN 0.5 ELSE 0 END) / sum(a.e * b.n), 6) AS c_index FROM h a JOIN h b ON b.d > a.d AND a.e > 0")


def _v11(s, d):
    ratio = I.excitation_ratio(items(s, d), steps(s, d), 1)
    return _r(V.top_excitation(ratio.select("a", "b", (F.col("ratio") - 1).alias("alpha")), 20), "alpha")


_RATIO = ", na AS (SELECT item AS a, count(*) AS na FROM items, st WHERE t < steps - 1 GROUP BY 1), nb AS (SELECT item AS b, count(*) AS nb FROM items WHERE t >= 1 GROUP BY 1), nj AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM items x JOIN items y ON y.t = x.t + 1 GROUP BY 1, 2), al AS (SELECT na.a, nb.b, coalesce((coalesce(n, 0) / na) / nullif((nb - coalesce(n, 0)) / nullif(steps - 1 - na, 0), 0), 1) - 1 AS alpha FROM na JOIN nb ON na.a <> nb.b CROSS JOIN st LEFT JOIN nj ON nj.a = na.a AND nj.b = nb.b)"
_register("v11_top_excitation_pairs", _v11, _I + _RATIO + " SELECT kind, CAST(place AS INTEGER) AS place, a, b, round(alpha, 6) AS alpha FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY abs(round(alpha, 9)) DESC, a, b) AS place FROM (SELECT *, CASE WHEN alpha > 0 THEN 'up' WHEN alpha < 0 THEN 'down' END AS kind FROM al) WHERE kind IS NOT NULL) WHERE place <= 20")


def _v13(s, d):
    each, n = items(s, d), steps(s, d)
    grid = s.range(n).select(F.col("id").alias("t")).crossJoin(F.broadcast(I.base_rates(each, n)))  # a rate for each of the items
    return _r(V.rescaled_gaps(grid.select("item", "t", (F.col("rate") * (1 + F.col("t") % 2)).alias("p")), each), "gap")


_register("v13_rescaled_gaps", _v13, _I + ", r AS (SELECT item, count(*) / any_value(steps) AS r FROM items, st GROUP BY item), g AS (SELECT item, t, lag(t) OVER (PARTITION BY item ORDER BY t) AS was FROM items) SELECT item, t, round(r * (t - was + (t + 1) // 2 - (was + 1) // 2), 6) AS gap FROM g JOIN r USING (item) WHERE was IS NOT NULL")
_register("v14_expanding_backtest", lambda s, d: _r((lambda n: V.expanding_backtest(items(s, d), n, n // 2, 100))(steps(s, d)), "log_loss"),
          _I + ", k AS (SELECT steps, steps // 2 AS start, CAST(ceil((steps - steps // 2) / 100) AS BIGINT) AS blocks FROM st), b AS (SELECT item, CAST(block AS BIGINT) AS block FROM (SELECT DISTINCT item FROM items), k, range((SELECT blocks FROM k)) q(block)), x AS (SELECT b.item, b.block, k.start, least(100, k.steps - k.start - b.block * 100) AS size, count(i.t) FILTER (i.t < k.start + b.block * 100) AS before, count(i.t) FILTER (i.t >= k.start + b.block * 100 AND i.t < k.start + b.block * 100 + 100) AS hits FROM b CROSS JOIN k LEFT JOIN items i ON i.item = b.item GROUP BY 1, 2, 3, 4) SELECT block, CAST(sum(size) AS BIGINT) AS n, CAST(sum(hits) AS BIGINT) AS hits, round(sum(-(hits * ln((before + 1) / (block * 100 + start + 2)) + (size - hits) * ln(1 - (before + 1) / (block * 100 + start + 2)))) / sum(size), 6) AS log_loss FROM x GROUP BY block")

# segments and profiles
def _wavering(s, d):
    """Chi-square, entropy and variance of the items of the last 50 steps, standardised over the whole series."""
    names = ["chi2", "entropy", "variance"]
    each = pinned(W.rolling_basket_stats(W.every_step(s, items(s, d), steps(s, d)), range(1, 26), 50))
    return E.scale(each, each, names), names


def _cuts(s, d, replicates=0):
    each, names = _wavering(s, d)
    return Q.bootstrap_cuts(each, names, replicates, 10, 30), len(names)


def _q3(s, d):
    cuts, columns = _cuts(s, d)
    return _r(Q.bic_of_cuts(cuts.where("rep = 0"), steps(s, d), columns), "error", "bic")


def _q4_all(s, d):
    """Stability of all cuts that the criterion asks for, over 100 samples."""
    cuts, columns = _cuts(s, d, 100)
    wanted = Q.bic_of_cuts(cuts.where("rep = 0"), steps(s, d), columns).where("best").first().splits
    return _r(Q.cut_stability(cuts, wanted, 25), "found")


_register("q3_bic_select", _q3)
_register("q4_stability_all_cuts", _q4_all)
_HASH = "('0x' || substr(md5('42:' || rep || ':' || t), 1, 12))::BIGINT"
_register("q4_changepoint_stability", lambda s, d: _r(Q.first_split_stability(draws(s, d), "d1", 10, 30, 25), "found"),
          _D + f""", p AS (SELECT rep, {_HASH} % (SELECT count(*) FROM orders) AS t FROM draws, range(1, 11) q(rep)), x AS (SELECT rep, t, count(*) AS w, any_value(d1) AS v FROM p JOIN draws USING (t) GROUP BY 1, 2 UNION ALL SELECT 0, t, 1, d1 FROM draws), c AS (SELECT rep, t, coalesce(sum(w) OVER b, 0) AS l, coalesce(sum(w * v) OVER b, 0) AS s, sum(w) OVER (PARTITION BY rep) AS m, sum(w * v) OVER (PARTITION BY rep) AS a FROM x WINDOW b AS (PARTITION BY rep ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT rep, t, round(s * s / l + (a - s) * (a - s) / (m - l) - a * a / m, 6) AS gain FROM c WHERE l >= 30 AND m - l >= 30), best AS (SELECT rep, t FROM (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY gain DESC, t) AS r FROM g) WHERE r = 1) SELECT z.t AS at, round(avg(CAST(abs(y.t - z.t) <= 25 AS INTEGER)), 6) AS found FROM best y, best z WHERE y.rep > 0 AND z.rep = 0 GROUP BY z.t""")
_register("q5_segment_profile", lambda s, d: _r((lambda n: Q.segment_profile(draws(s, d), "d1", [n // 3, 2 * n // 3], 10))(steps(s, d)), "chi2", "p", "entropy"),
          _D + f""", n AS (SELECT count(*) AS n FROM orders), y AS (SELECT CAST(t >= n // 3 AS INTEGER) + CAST(t >= 2 * n // 3 AS INTEGER) AS segment, d1 FROM draws, n), c AS (SELECT segment, k AS symbol, (SELECT count(*) FROM y WHERE y.segment = g.segment AND y.d1 = k) AS n FROM (SELECT DISTINCT segment FROM y) g, range(10) q(k)),
z AS (SELECT segment, CAST(sum(n) AS BIGINT) AS n, sum(n * n) * 10 / sum(n) - sum(n) AS chi2, list(symbol ORDER BY n DESC, symbol)[1:5] AS hot, list(symbol ORDER BY n, symbol)[1:5] AS cold, list(n) AS ns FROM c GROUP BY segment) SELECT segment, n, round(chi2, 6) AS chi2, round({_chi_sql('chi2', 9)}, 6) AS p, round(CAST(list_sum(list_transform(ns, lambda v: CASE WHEN v > 0 THEN -(v / n) * log2(v / n) ELSE 0 END)) AS DOUBLE), 6) AS entropy, array_to_string(hot, ',') AS hot, array_to_string(cold, ',') AS cold FROM z""")


def _daily(s, d):
    """The mean draw of each day, numbered in the order of days."""
    return S.with_ordinal(rows(s, d).groupBy("day").agg(F.round(F.avg("c"), 6).alias("v")), ["day"])


_DAILY = _D + ", dv AS (SELECT row_number() OVER (ORDER BY day) - 1 AS t, v FROM (SELECT day, round(avg(c), 6) AS v FROM draws GROUP BY day))"


def _runs_sql(m):
    return f"r{m} AS (SELECT t, list(v) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING) AS x FROM dv), z{m} AS (SELECT t, list_transform(x, lambda y: (y - list_avg(x)) / list_stddev_pop(x)) AS x FROM r{m} WHERE len(x) = {m}), p{m} AS (SELECT a.t, min(round(sqrt(greatest({2 * m} - 2 * list_inner_product(a.x, b.x), 0)), 9)) AS distance FROM z{m} a JOIN z{m} b ON abs(a.t - b.t) >= {-(-m // 2)} GROUP BY a.t)"


_register("q6_matrix_profile", lambda s, d: Q.matrix_profile(_daily(s, d), "v", 7).select("t", F.round("distance", 4).alias("distance")), _DAILY + ", " + _runs_sql(7) + " SELECT t, round(distance, 4) AS distance FROM p7")


def _q7(s, d):
    profile = pinned(Q.matrix_profile(_daily(s, d), "v", 7))
    found = [("motif", *x) for x in Q.motifs(profile, 7, 5)] + [("discord", *x) for x in Q.motifs(profile, 7, 5, most=True)]
    return s.createDataFrame(found, "kind string, place int, t long, distance double, nearest long")  # ten rows


_register("q7_motifs_discords", _q7)


_WINDOWS = (5, 10, 15, 20, 30)


def _q8(s, d):
    each = reduce(DataFrame.unionByName, (Q.matrix_profile(_daily(s, d), "v", m).withColumn("m", F.lit(m)) for m in _WINDOWS))
    best = each.agg(F.min_by(F.struct("m", F.round("distance", 4).alias("distance")), F.struct(F.round("distance", 4), "m")).alias("a"), F.max_by(F.struct("m", F.round("distance", 4).alias("distance")), F.struct(F.round("distance", 4), -F.col("m"))).alias("b"))
    return best.select(F.col("a.m").alias("motif_m"), F.col("a.distance").alias("motif"), F.col("b.m").alias("discord_m"), F.col("b.distance").alias("discord"))


_register("q8_best_across_windows", _q8, _DAILY + ", " + ", ".join(map(_runs_sql, _WINDOWS)) + ", e AS (" + " UNION ALL ".join(f"SELECT {m} AS m, round(distance, 4) AS d FROM p{m}" for m in _WINDOWS) + "), lo AS (SELECT m, d FROM e ORDER BY d, m LIMIT 1), hi AS (SELECT m, d FROM e ORDER BY d DESC, m LIMIT 1) SELECT lo.m AS motif_m, lo.d AS motif, hi.m AS discord_m, hi.d AS discord FROM lo, hi")

# communities, contexts and families
_register("o18_label_communities", lambda s, d: Q.label_communities(I.pair_counts(items(s, d)).select("a", "b", F.col("n").cast("double").alias("w")), 3),
          _I + ", e AS (SELECT x.item AS a, y.item AS b, CAST(count(*) AS DOUBLE) AS w FROM items x JOIN items y ON x.t = y.t AND x.item <> y.item GROUP BY 1, 2), l0 AS (SELECT DISTINCT a AS item, a AS label FROM e)" + "".join(f", l{k} AS (SELECT item, label FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY w DESC, label) AS r FROM (SELECT e.a AS item, label, sum(w) AS w FROM e JOIN l{k - 1} l ON l.item = e.b GROUP BY 1, 2)) WHERE r = 1)" for k in (1, 2, 3)) + " SELECT item, label FROM l3")
_register("o20_sequence_representations", lambda s, d: (lambda x: Q.representations(x, W.step_events(x, W.every_step(s, x, steps(s, d)), 25)))(items(s, d)),
          _EVENTS + "SELECT 'raw' AS mode, t, CAST(item AS VARCHAR) AS token FROM items UNION ALL SELECT DISTINCT 'decade', t, CAST((item - 1) // 10 AS VARCHAR) FROM items UNION ALL SELECT 'event', t, event FROM ev WHERE event IS NOT NULL")


def _o21(s, d):
    each, n = items(s, d), steps(s, d)
    every = pinned(W.every_step(s, each, n))
    tokens = Q.representations(each, W.step_events(each, every, 25), steps=every)
    return Q.pattern_family(tokens, n, {"raw": 50, "decade": 100, "event": 25})


_LC = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - ({1}) + 1))"
_register("o21_pattern_family_run", _o21, _EVENTS + f""", tk AS (SELECT 'raw' AS mode, t, CAST(item AS VARCHAR) AS token FROM items UNION ALL SELECT DISTINCT 'decade', t, CAST((item - 1) // 10 AS VARCHAR) FROM items UNION ALL SELECT 'event', t, event FROM ev WHERE event IS NOT NULL),
pj AS (SELECT x.mode, x.token AS a, y.token AS b, count(*) AS n FROM tk x JOIN tk y ON x.mode = y.mode AND y.t = x.t + 1 GROUP BY 1, 2, 3 HAVING count(*) >= CASE any_value(x.mode) WHEN 'raw' THEN 50 WHEN 'decade' THEN 100 ELSE 25 END), pa AS (SELECT mode, token AS a, count(*) AS na FROM tk, st WHERE t < steps - 1 GROUP BY 1, 2), pb AS (SELECT mode, token AS b, count(*) AS nb FROM tk WHERE t >= 1 GROUP BY 1, 2),
pk AS (SELECT mode, a, b, n, na, nb, steps - 1 AS m, unnest(range(n, least(na, nb) + 1)) AS k FROM pj JOIN pa USING (mode, a) JOIN pb USING (mode, b), st), pp AS (SELECT mode, a, b, least(sum(exp({_LC.format('nb', 'k')} + {_LC.format('(m - nb)', '(na - k)')} - {_LC.format('m', 'na')})), 1) AS p FROM pk GROUP BY 1, 2, 3), pr AS (SELECT *, rank() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM pp), pq AS (SELECT *, min(p * m / r) OVER (ORDER BY r DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM pr)
SELECT mode, count(*) AS tested, count(*) FILTER (q < 0.05) AS significant FROM pq GROUP BY mode""")


def _o12(s, d):
    each, n = items(s, d), steps(s, d)
    from .storage import pinned

    wide = pinned(joined(s, d).select("t", "day", "quantity"))
    middle = wide.agg(F.expr("percentile(quantity, 0.5)").alias("middle"))
    marked = wide.join(F.broadcast(middle))
    labels = {"recent": Q.context_label("recent", n, t=F.col("t")), "season": Q.context_label("season", n, day=F.col("day")), "quantity": Q.context_label("covariate", n, covariate=F.col("quantity"), middle=F.col("middle"))}
    made = reduce(DataFrame.unionByName, (P.contrast(each, marked.select("t", label.alias("label"))).withColumn("context", F.lit(k)) for k, label in labels.items()))
    return _r(_name(made.where("n1 + n0 >= 10")), "growth", "chi2").select("context", "items", "n1", "n0", "growth", "chi2")


_CTX = "WITH " + ITEMS + ", " + COVARIATES.replace(DRAWS + ",\n", "") + """, lb AS (SELECT 'recent' AS context, t, CASE WHEN t >= steps - least(500, steps // 2) THEN TRUE WHEN t >= steps - 2 * least(500, steps // 2) THEN FALSE END AS label FROM w, st UNION ALL SELECT 'season', t, month(day) BETWEEN 4 AND 9 FROM w UNION ALL SELECT 'quantity', t, quantity > (SELECT quantile_cont(quantity, 0.5) FROM w) FROM w),
s AS (SELECT context, CAST(count(*) FILTER (label) AS DOUBLE) AS s1, CAST(count(*) FILTER (NOT label) AS DOUBLE) AS s0 FROM lb GROUP BY 1), e AS (SELECT t, CAST(item AS VARCHAR) AS items FROM items UNION ALL SELECT x.t, x.item || ',' || y.item FROM items x JOIN items y ON x.t = y.t AND x.item < y.item),
n AS (SELECT context, items, CAST(count(*) FILTER (label) AS BIGINT) AS n1, CAST(count(*) FILTER (NOT label) AS BIGINT) AS n0 FROM e JOIN lb USING (t) WHERE label IS NOT NULL GROUP BY 1, 2)
SELECT context, items, n1, n0, round((CASE WHEN n1 > 0 THEN n1 / s1 ELSE 0 END) / (CASE WHEN n0 > 0 THEN n0 / s0 ELSE 0.001 END), 6) AS growth, round(coalesce((s1 + s0) * greatest(abs(n1 * (s0 - n0) - n0 * (s1 - n1)) - (s1 + s0) / 2, 0) ** 2 / nullif(s1 * s0 * (n1 + n0) * (s1 + s0 - n1 - n0), 0), 0), 6) AS chi2 FROM n JOIN s USING (context) WHERE n1 + n0 >= 10"""
_register("o12_context_split", _o12, _CTX)


# dependence beyond one column
def _g5(s, d):
    wide = joined(s, d, False).where("quantity is not null").select("d1", "c", "quantity", "price")
    for c in ("quantity", "price", "c"):
        wide = G.quantile_bins(wide, c, 10, f"{c}_bin")
    pairs = [("quantity_bin", "d1"), ("price_bin", "d1"), ("quantity_bin", "c_bin"), ("price_bin", "c_bin")]
    return _r(reduce(DataFrame.unionByName, (I.mutual_information(wide, x, y).select(F.lit(x).alias("x"), F.lit(y).alias("y"), "mi") for x, y in pairs)), "mi")


_EDGE = "CAST(len(list_filter((SELECT list_distinct(quantile_cont({0}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) FROM w WHERE quantity IS NOT NULL), lambda x: x < {0})) AS INTEGER)"
_register("g5_mutual_info_deciles", _g5, "WITH " + COVARIATES + f""", b AS (SELECT d1, {_EDGE.format('quantity')} AS quantity_bin, {_EDGE.format('price')} AS price_bin, {_EDGE.format('c')} AS c_bin FROM w WHERE quantity IS NOT NULL), p AS ({" UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, {x} AS a, {y} AS b FROM b" for x, y in (("quantity_bin", "d1"), ("price_bin", "d1"), ("quantity_bin", "c_bin"), ("price_bin", "c_bin")))}),
n AS (SELECT x, y, a, b, count(*) AS n FROM p GROUP BY 1, 2, 3, 4), m AS (SELECT *, sum(n) OVER (PARTITION BY x, y, a) AS na, sum(n) OVER (PARTITION BY x, y, b) AS nb, sum(n) OVER (PARTITION BY x, y) AS m FROM n) SELECT x, y, round(CAST(sum(n / m * ln(n * m / (na * nb))) AS DOUBLE), 6) AS mi FROM m GROUP BY 1, 2""")


def _presence(s, d):
    """Whether each of three items came in an order, with the covariates of the day."""
    each = order_items(s, d).where("item in (3, 11, 19)").groupBy("o_orderkey").agg(*(F.max((F.col("item") == k).cast("int")).alias(f"has_{k}") for k in (3, 11, 19)))
    return joined(s, d, False).where("quantity is not null").select("o_orderkey", "quantity", "price", F.sin(2 * 3.141592653589793 * F.dayofyear("day") / 365.25).alias("season")).join(each, "o_orderkey", "left").na.fill(0)


_register("g11_logit_lr_test", lambda s, d: M.logit_lr(_presence(s, d), ["has_3", "has_11", "has_19"], ["quantity", "price"], ["season"]))
_register("g12_l1_logit_select", lambda s, d: M.l1_select(_presence(s, d), ["has_3", "has_11", "has_19"], ["quantity", "price", "season"]))
_register("p12_align_classes", lambda s, d: rows(s, d).select("o_orderkey", F.posexplode(M.aligned(F.array((F.col("d1") / 10.0), (F.col("d2") / 10.0), F.lit(0.1)), 5)).alias("symbol", "p")).withColumn("p", F.round("p", 6)),
          _D + " SELECT o_orderkey, CAST(k AS INTEGER) AS symbol, round(coalesce([d1 / 10.0, d2 / 10.0, 0.1][k + 1], 0) / (d1 / 10.0 + d2 / 10.0 + 0.1), 6) AS p FROM draws, range(5) q(k)")
