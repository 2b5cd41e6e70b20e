"""Queries of patterns, contrasts, graphs, event processes and sequence structure with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bindings import DRAWS, ITEMS, draws, items, steps, table
from .catalog_relations import _normal_sql, _r
from .operators import items as I
from .operators import patterns as P

QUERIES: dict = {}
SQL: dict[str, str] = {}
DIGITS = ["d1", "d2", "d3"]


def _register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


_I = "WITH " + ITEMS
_PAIRS = _I + """, r AS (SELECT item, count(*) / any_value(steps) AS r, any_value(steps) AS steps FROM items, st GROUP BY item), n AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM items x JOIN items y ON x.t = y.t AND x.item < y.item GROUP BY 1, 2),
g AS (SELECT a.item AS a, b.item AS b, coalesce(n, 0) AS n, a.steps AS m, a.r * b.r AS p FROM r a JOIN r b ON a.item < b.item LEFT JOIN n ON n.a = a.item AND n.b = b.item),
z AS (SELECT a, b, n, (n - m * p) / sqrt(m * p * (1 - p)) AS z FROM g)
"""
_register("o4_cross_step_triples", lambda s, d: P.cross_step_triples(items(s, d), 10), _I + ", p AS (SELECT x.item AS a, y.item AS b FROM items x JOIN items y ON y.t = x.t + 1 GROUP BY 1, 2 HAVING count(*) >= 10) SELECT x.item AS a, y.item AS b, z.item AS c, count(*) AS n FROM items x JOIN items y ON y.t = x.t + 1 JOIN p ON p.a = x.item AND p.b = y.item JOIN items z ON z.t = x.t + 2 JOIN p q ON q.a = y.item AND q.b = z.item GROUP BY 1, 2, 3 HAVING count(*) >= 10")


def _rules_sql(ahead, least):
    return f"""(SELECT j.a, j.b, n, n / na AS confidence, n * (m - {ahead}) / (na * nb) AS lift, na, nb, m - {ahead} AS m FROM (SELECT x.item AS a, y.item AS b, count(*) AS n FROM items x JOIN items y ON y.t = x.t + {ahead} GROUP BY 1, 2 HAVING count(*) >= {least}) j
JOIN (SELECT item AS a, count(*) AS na, any_value(steps) AS m FROM items, st WHERE t < steps - {ahead} GROUP BY 1) u USING (a) JOIN (SELECT item AS b, count(*) AS nb FROM items WHERE t >= {ahead} GROUP BY 1) v USING (b))"""


def _fisher(rules):
    lc = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - ({1}) + 1)"
    term = f"exp({lc.format('nb', 'k')} + {lc.format('(m - nb)', '(na - k)')} - ({lc.format('m', 'na')}))"
    return f"SELECT a, b, any_value(n) AS n, round(any_value(confidence), 6) AS confidence, round(any_value(lift), 6) AS lift, round(least(sum({term}), 1), 6) AS p FROM (SELECT *, unnest(range(n, least(na, nb) + 1)) AS k FROM {rules}) GROUP BY a, b"


_rule_cols = ("confidence", "lift", "p")
_register("o5_pattern_significance", lambda s, d: _r(P.rule_tests(items(s, d), steps(s, d), 10), *_rule_cols), _I + " " + _fisher(_rules_sql(1, 10)))
_register("o6_pattern_windows", lambda s, d: _r(P.rule_windows(items(s, d), steps(s, d), 10, [1, 2, 3, 4, 5]), *_rule_cols), _I + " " + " UNION ALL ".join(f"SELECT *, {w} AS ahead FROM ({_fisher(_rules_sql(w, 10))})" for w in range(1, 6)))
_SCORE = _I + f", rules AS {_rules_sql(1, 10)}, s AS (SELECT t + 1 AS t, b AS item, sum(ln(lift) * confidence) AS score FROM items JOIN rules ON a = item GROUP BY 1, 2)\n"


def _rule_scores(s, d):
    rows = items(s, d)
    return P.rule_scores(rows, P.rule_tests(rows, steps(s, d), 10))


_register("o7_rule_scores", lambda s, d: _r(_rule_scores(s, d), "score"), _SCORE + "SELECT t, item, round(score, 6) AS score FROM s")
_BACK = """, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY round(score, 9) DESC, item) AS r FROM s) WHERE r <= 6), h AS (SELECT b.t, count(i.item) AS hits, count(*) AS picked FROM b LEFT JOIN items i ON i.t = b.t AND i.item = b.item GROUP BY b.t), z AS (SELECT t, count(*) AS size FROM items GROUP BY t)
SELECT count(*) AS steps, round(avg(hits), 6) AS hits, round(sum(hits) / sum(picked), 6) AS precision, round(sum(hits) / sum(size), 6) AS recall FROM h JOIN z USING (t)"""


def _o8(s, d):
    rows = items(s, d)
    found = P.top_n_backtests(P.rule_scores(rows, P.rule_tests(rows, steps(s, d), 10)), rows, [1, 3, 6])
    base = rows.groupBy("t").agg(F.count("*").alias("size")).agg((F.avg("size") / 25).alias("base"))
    return _r(found.select("steps", "hits", "precision", "recall", "n").join(F.broadcast(base)), "hits", "precision", "recall", "base")


_register("o8_rule_backtest", _o8, _SCORE + ", b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY round(score, 9) DESC, item) AS r FROM s) WHERE r <= 6), h AS (SELECT b.t, q.n, count(i.item) AS hits, count(*) AS picked FROM b JOIN (SELECT unnest([1, 3, 6]) AS n) q ON b.r <= q.n LEFT JOIN items i ON i.t = b.t AND i.item = b.item GROUP BY 1, 2), z AS (SELECT t, count(*) AS size FROM items GROUP BY t) SELECT n, count(*) AS steps, round(avg(hits), 6) AS hits, round(sum(hits) / sum(picked), 6) AS precision, round(sum(hits) / sum(size), 6) AS recall, round((SELECT avg(size) / 25 FROM z), 6) AS base FROM h JOIN z USING (t) GROUP BY n")

_register("v15_topn_backtest", lambda s, d: _r(P.top_n_backtest(I.decayed_presence(items(s, d)).withColumnRenamed("presence", "score"), items(s, d), 6), "hits", "precision", "recall"),
          _I + ", s AS (SELECT t + k AS t, item, sum(exp(-1.0 * k)) AS score FROM items, range(1, 11) r(k) GROUP BY 1, 2)" + _BACK)


def _contrast(s, d):
    n = steps(s, d)
    return P.contrast(items(s, d), draws(s, d).select("t", F.when(F.col("t") >= n - 500, True).when(F.col("t") >= n - 1000, False).alias("label")))


_CONTRAST = _I + """, l AS (SELECT t, t >= steps - 500 AS label FROM draws, st WHERE t >= steps - 1000), s AS (SELECT CAST(count(*) FILTER (label) AS DOUBLE) AS s1, CAST(count(*) FILTER (NOT label) AS DOUBLE) AS s0 FROM l),
e AS (SELECT t, CAST(item AS VARCHAR) AS items FROM items UNION ALL SELECT x.t, x.item || ',' || y.item FROM items x JOIN items y ON x.t = y.t AND x.item < y.item), n AS (SELECT items, CAST(count(*) FILTER (label) AS BIGINT) AS n1, CAST(count(*) FILTER (NOT label) AS BIGINT) AS n0 FROM e JOIN l USING (t) GROUP BY items),
c AS (SELECT items, n1, n0, (CASE WHEN n1 > 0 THEN n1 / s1 ELSE 0 END) / (CASE WHEN n0 > 0 THEN n0 / s0 ELSE 0.001 END) AS growth, coalesce((s1 + s0) * greatest(abs(n1 * (s0 - n0) - n0 * (s1 - n1)) - (s1 + s0) / 2, 0) ** 2 / nullif(s1 * s0 * (n1 + n0) * (s1 + s0 - n1 - n0), 0), 0) AS chi2 FROM n, s)
"""


def _name(df):
    return df.withColumn("items", F.concat_ws(",", F.col("items").cast("array<string>")))


_register("o10_contrast_patterns", lambda s, d: _r(_name(P.with_lift(_contrast(s, d))), "growth", "chi2", "lift", "p", "p_bh"),
          _CONTRAST + f", v AS (SELECT *, (n1 / s1) / ((n1 + n0) / (s1 + s0)) AS lift, {_normal_sql('sqrt(chi2)')} AS p FROM c, s), r AS (SELECT *, rank() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM v) SELECT items, n1, n0, round(growth, 6) AS growth, round(chi2, 6) AS chi2, round(lift, 6) AS lift, round(p, 6) AS p, round(least(1, min(p * m / r) OVER (ORDER BY r DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_bh FROM r")
_register("o11_emerging_patterns", lambda s, d: _r(_name(_contrast(s, d).drop("s1", "s0")).where("(growth >= 1.3 or growth <= 0.7) and chi2 >= 2.705543"), "growth", "chi2").orderBy(F.desc("growth"), "items").limit(50),
          _CONTRAST + "SELECT items, n1, n0, round(growth, 6) AS growth, round(chi2, 6) AS chi2 FROM c WHERE (growth >= 1.3 OR growth <= 0.7) AND chi2 >= 2.705543 ORDER BY 4 DESC, items LIMIT 50")


def _fp(s, d):
    from pyspark.ml.fpm import FPGrowth

    found = FPGrowth(itemsCol="xs", minSupport=0.01).fit(I.baskets(items(s, d))).freqItemsets
    return found.where(F.size("items") == 2).select(F.array_min("items").alias("a"), F.array_max("items").alias("b"), F.col("freq").alias("n"))


_register("o9_frequent_itemsets", _fp, _I + ", n AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM items x JOIN items y ON x.t = y.t AND x.item < y.item GROUP BY 1, 2) SELECT a, b, n FROM n WHERE n >= ceil(0.01 * (SELECT count(DISTINCT t) FROM items))")


def _o14(s, d):
    from pyspark.ml.fpm import PrefixSpan

    ordered = table(s, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("xs"))
    sequences = ordered.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "xs"))), lambda x: x["xs"]).alias("sequence"))
    return PrefixSpan(minSupport=0.5, maxPatternLength=2).findFrequentSequentialPatterns(sequences).select(F.to_json("sequence").alias("pattern"), F.col("freq").alias("n"))


_register("o14_sequence_patterns", _o14)
_register("o15_zscore_graph", lambda s, d: _r(P.centrality(P.pair_significance(items(s, d), steps(s, d), 25).where("abs(z) > 1.5"), 25), "centrality"), _PAIRS + ", e AS (SELECT a, b FROM z WHERE abs(z) > 1.5) SELECT a AS item, round(count(*) / 24, 6) AS centrality FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) GROUP BY a")
_register("o16_quantile_graph", lambda s, d: (lambda e: e.join(F.broadcast(e.agg(F.expr("percentile(n, 0.95)").alias("q")))).where("n >= q").select("a", "b", "n"))(I.cross_step_pairs(items(s, d), 1)),
          _I + ", n AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM items x JOIN items y ON y.t = x.t + 1 GROUP BY 1, 2) SELECT a, b, n FROM n WHERE n >= (SELECT quantile_cont(n, 0.95) FROM n)")


def _o17(s, d):
    rows = items(s, d)
    return _r(P.modularity(I.pair_counts(rows).withColumnRenamed("n", "w"), rows.select("item", F.floor(F.col("item") / 10).alias("label")).distinct()), "modularity")


_register("o17_graph_modularity", _o17, _I + """, e AS (SELECT x.item AS a, y.item AS b, count(*) AS w FROM items x JOIN items y ON x.t = y.t AND x.item < y.item GROUP BY 1, 2), d AS (SELECT item // 10 AS l, sum(w) AS d FROM (SELECT a AS item, w FROM e UNION ALL SELECT b, w FROM e) GROUP BY 1),
i AS (SELECT a // 10 AS l, sum(w) AS i FROM e WHERE a // 10 = b // 10 GROUP BY 1) SELECT round(sum(coalesce(i, 0) / (SELECT sum(w) FROM e) - (d / (2 * (SELECT sum(w) FROM e))) ** 2), 6) AS modularity FROM d LEFT JOIN i USING (l)""")
_register("o19_lag_distribution", lambda s, d: (lambda x, n: _r(x.groupBy("lag").agg(F.count_if(F.col("ratio") > 1.1).alias("up"), F.count_if(F.col("ratio") < 0.9).alias("down"), F.max(F.abs(F.col("ratio") - 1)).alias("strongest")), "strongest"))(
    I.excitation_ratio(items(s, d), steps(s, d), 1).withColumn("lag", F.lit(1)).unionByName(I.excitation_ratio(items(s, d), steps(s, d), 2).withColumn("lag", F.lit(2))), None),
    _I + ", x AS (" + " UNION ALL ".join(f"""SELECT {k} AS lag, coalesce((coalesce(n, 0) / na) / nullif((nb - coalesce(n, 0)) / nullif(steps - {k} - na, 0), 0), 1) AS ratio FROM (SELECT item AS a, count(*) AS na FROM items, st WHERE t < steps - {k} GROUP BY 1) a
JOIN (SELECT item AS b, count(*) AS nb FROM items WHERE t >= {k} GROUP BY 1) b ON a <> b CROSS JOIN st LEFT JOIN (SELECT x.item AS ja, y.item AS jb, count(*) AS n FROM items x JOIN items y ON y.t = x.t + {k} GROUP BY 1, 2) j ON ja = a AND jb = b""" for k in (1, 2)) + ") SELECT lag, count(*) FILTER (ratio > 1.1) AS up, count(*) FILTER (ratio < 0.9) AS down, round(max(abs(ratio - 1)), 6) AS strongest FROM x GROUP BY lag")

# event processes
_SP = ", w AS (SELECT item, coalesce(lead(t) OVER (PARTITION BY item ORDER BY t), steps) - t AS duration, CAST(lead(t) OVER (PARTITION BY item ORDER BY t) IS NOT NULL AS INTEGER) AS event FROM items, st), sp AS (SELECT * FROM w WHERE duration > 0), rt AS (SELECT item, sum(event) / sum(duration) AS rate FROM sp GROUP BY item)\n"


def _rated(s, d):
    rows = I.spells(items(s, d), steps(s, d))
    return rows.join(F.broadcast(I.exponential_hazard(rows)), "item")


_register("v7_brier_at_horizons", lambda s, d: _r(P.brier_at(_rated(s, d), "rate", [1, 3, 5]), "brier"), _I + _SP + "SELECT h, count(*) AS n, round(avg((exp(-rate * h) - CAST(duration > h AS INTEGER)) ** 2), 6) AS brier FROM sp JOIN rt USING (item), (SELECT unnest([1, 3, 5]) AS h) WHERE event = 1 OR duration > h GROUP BY h")
_register("v8_calibration_table", lambda s, d: _r(P.calibration_by_quantiles(_rated(s, d).withColumn("p", F.round("p1", 9)).withColumn("y", (F.col("duration") == 1).cast("int")), "p", "y", 10), "score", "rate"),
          _I + _SP + ", p AS (SELECT duration, round(1 - exp(-rate), 9) AS p FROM sp JOIN rt USING (item)), e AS (SELECT list_distinct(quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM p) SELECT CAST(len(list_filter(edges, lambda x: x < p)) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS score, round(avg(CAST(duration = 1 AS INTEGER)), 6) AS rate FROM p, e GROUP BY 1")
_register("v9_logodds_delta", lambda s, d: (lambda rows, n: _r(I.exponential_hazard(I.spells(rows, n)).join(I.base_rates(rows, n).withColumnRenamed("rate", "base"), "item").select("item", (P.log_odds(F.col("p1")) - P.log_odds(F.col("base"))).alias("delta")), "delta"))(items(s, d), steps(s, d)),
          _I + _SP + ", p AS (SELECT item, 1 - exp(-rate) AS p, count(*) / any_value(steps) AS b FROM items JOIN rt USING (item), st GROUP BY item, rate) SELECT item, round(ln(p / (1 - p)) - ln(b / (1 - b)), 6) AS delta FROM p")


def _v12(s, d):
    rows = _rated(s, d).withColumns({"y": (F.col("duration") == 1).cast("int"), "base": F.lit(0.25)})
    return _r(P.process_scores(rows, "p1", "base", "y"), "ll_model", "ll_base", "brier_model", "brier_base").withColumn("lr", F.round("lr", 3))


_register("v12_process_eval", _v12, _I + _SP + """, p AS (SELECT CAST(duration = 1 AS INTEGER) AS y, 1 - exp(-rate) AS p FROM sp JOIN rt USING (item)), l AS (SELECT count(*) AS n, avg(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS a, avg(CASE WHEN y = 1 THEN ln(0.25) ELSE ln(0.75) END) AS b, avg((p - y) ** 2) AS c, avg((0.25 - y) ** 2) AS d FROM p)
SELECT n, round(a, 6) AS ll_model, round(b, 6) AS ll_base, round(CAST(c AS DOUBLE), 6) AS brier_model, round(CAST(d AS DOUBLE), 6) AS brier_base, round(2 * n * (a - b), 3) AS lr FROM l""")

# sequence structure
_register("q2_segment_split", lambda s, d: P.segment_costs(draws(s, d), "d1", [0], 30), "WITH " + DRAWS + """, x AS (SELECT t, coalesce(sum(d1) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(d1) OVER () AS s, count(*) OVER () AS n FROM draws),
g AS (SELECT t, n, round(b * b / t + (s - b) * (s - b) / (n - t) - s * s / n, 6) AS gain FROM x WHERE t >= 30 AND n - t >= 30) SELECT CAST(0 AS BIGINT) AS start, n AS stop, t AS at, gain FROM g ORDER BY gain DESC, t LIMIT 1""")
_register("q2_binary_segmentation", lambda s, d: P.binary_segmentation(draws(s, d), "d1", 3, 30))
_register("q9_jaccard_pairs", lambda s, d: _r(P.jaccard_pairs(items(s, d)), "jaccard"),
          _I + ", n AS (SELECT item, count(*) AS n FROM items GROUP BY 1), b AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM items x JOIN items y ON x.t = y.t AND x.item < y.item GROUP BY 1, 2) SELECT a, b, round(b.n / (p.n + q.n - b.n), 6) AS jaccard FROM b JOIN n p ON p.item = a JOIN n q ON q.item = b")
