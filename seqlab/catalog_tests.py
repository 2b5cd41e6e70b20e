"""Queries of the randomness tests with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bindings import DRAWS, ITEMS, draws, items, rows, steps
from .catalog_relations import _bits, _chi_sql, _normal_sql, _r
from .operators import items as I
from .operators import patterns as P
from .operators import randomness as T
from .operators import series as S
from .functions import tails

QUERIES: dict = {}
SQL: dict[str, str] = {}
DIGITS = ["d1", "d2", "d3"]
#: Items are the numbers 1 to 25.
DOMAIN = 25
_D, _I = "WITH " + DRAWS, "WITH " + ITEMS


def _register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _even_chi_sql(x, df):
    """The tail of chi-square with even df in SQL."""
    return f"(exp(-{x} / 2) * (" + " + ".join(f"({x} / 2) ** {k} / gamma({k + 1})" for k in range(df // 2)) + "))"


def _ks_sql(d, n):
    """The Kolmogorov tail in SQL."""
    x = f"((sqrt({n}) + 0.12 + 0.11 / sqrt({n})) * {d})"
    series = " + ".join(f"{2.0 if k % 2 else -2.0} * exp({-2.0 * k * k} * {x} * {x})" for k in range(1, 41))
    return f"(CASE WHEN {x} < 0.2 THEN 1.0 ELSE greatest(least({series}, 1.0), 0.0) END)"


_register("f1_item_frequency", lambda s, d: _r(T.frequency_test(items(s, d), steps(s, d), DOMAIN), "z", "p", "chi2_part", "chi2", "chi2_p"),
          _I + f""", a AS (SELECT count(*) / 25 AS e FROM items), x AS (SELECT item, count(*) AS n, (count(*) - any_value(e)) / sqrt(any_value(e) * (1 - any_value(e) / any_value(steps))) AS z, (count(*) - any_value(e)) ** 2 / any_value(e) AS part FROM items, a, st GROUP BY item),
y AS (SELECT *, sum(part) OVER () AS chi2 FROM x) SELECT item, n, round(z, 6) AS z, round({_normal_sql('z')}, 6) AS p, abs(z) > 2.5 AS outlier, round(part, 6) AS chi2_part, round(chi2, 6) AS chi2, round({_even_chi_sql('chi2', 24)}, 6) AS chi2_p FROM y""")
_register("f2_position_bias", lambda s, d: _r(T.position_bias(rows(s, d), DIGITS, 10), "chi2", "mean", "p"),
          _D + f""", x AS (SELECT 'd1' AS pos, d1 AS v FROM draws UNION ALL SELECT 'd2', d2 FROM draws UNION ALL SELECT 'd3', d3 FROM draws), n AS (SELECT pos, v, count(*) AS n FROM x GROUP BY 1, 2),
c AS (SELECT pos, CAST(sum(n) AS BIGINT) AS n, sum(n * n) * 10 / sum(n) - sum(n) AS chi2, sum(v * n) / sum(n) AS mean FROM n GROUP BY pos) SELECT pos, n, round(chi2, 6) AS chi2, round(mean, 6) AS mean, round({_chi_sql('chi2', 9)}, 6) AS p FROM c""")


def _f4(s, d):
    gaps = S.key_gap(items(s, d), "item", cap=2**31).where(f"gap < {2**31}")
    return _r(T.with_ks_p(I.ks_exponential(gaps, "item", "gap", 9.0), F.col("n").cast("double"), DOMAIN), "d", "p", "p_bonferroni")


_F4 = f"""{_I}, g AS (SELECT item, t - lag(t) OVER (PARTITION BY item ORDER BY t) AS gap FROM items), c AS (SELECT item, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2),
k AS (SELECT item, 1 - exp(-gap / 9.0) AS f, sum(n) OVER (PARTITION BY item ORDER BY gap) / sum(n) OVER (PARTITION BY item) AS hi, (sum(n) OVER (PARTITION BY item ORDER BY gap) - n) / sum(n) OVER (PARTITION BY item) AS lo, sum(n) OVER (PARTITION BY item) AS m FROM c),
f4 AS (SELECT item, CAST(any_value(m) AS BIGINT) AS n, CAST(max(greatest(abs(hi - f), abs(lo - f))) AS DOUBLE) AS d FROM k GROUP BY item)"""
_register("f4_gap_distribution", _f4, f"{_F4} SELECT item, n, round(d, 6) AS d, round({_ks_sql('d', 'n')}, 6) AS p, round(least({_ks_sql('d', 'n')} * 25, 1.0), 6) AS p_bonferroni FROM f4")


def _f5(s, d):
    code, total = F.col("id"), F.col("d1") + F.col("d2") + F.col("d3")
    known = s.range(1000).select((F.floor(code / 100) + F.floor(code / 10) % 10 + code % 10).alias("v")).groupBy("v").agg(F.count("*").alias("m"))
    out = I.ks_two_sample(rows(s, d).groupBy(total.cast("long").alias("v")).agg(F.count("*").alias("n")), known, "v", "n", "m")
    return _r(T.with_ks_p(out, F.col("n").cast("double")).drop("p_bonferroni"), "d", "p")  # the reference is exact


_register("f5_sum_distribution", _f5, f"""{_D}, a AS (SELECT v, coalesce(n, 0) AS n, m FROM (SELECT x // 100 + x // 10 % 10 + x % 10 AS v, count(*) AS m FROM range(1000) r(x) GROUP BY 1) LEFT JOIN (SELECT d1 + d2 + d3 AS v, count(*) AS n FROM draws GROUP BY 1) USING (v)),
k AS (SELECT CAST(any_value(tn) AS BIGINT) AS n, CAST(any_value(tm) AS BIGINT) AS m, max(abs(cn / tn - cm / tm)) AS d FROM (SELECT sum(n) OVER (ORDER BY v) AS cn, sum(m) OVER (ORDER BY v) AS cm, sum(n) OVER () AS tn, sum(m) OVER () AS tm FROM a)) SELECT n, m, round(d, 6) AS d, round({_ks_sql('d', 'n')}, 6) AS p FROM k""")


def _kinds():
    return {"odd": sum((F.col(x) % 2 for x in DIGITS[1:]), F.col("d1") % 2), "high": sum(((F.col(x) >= 5).cast("int") for x in DIGITS[1:]), (F.col("d1") >= 5).cast("int"))}


_register("f6_parity_test", lambda s, d: _r(T.binomial_counts(rows(s, d), _kinds(), 3), "expected", "part", "chi2", "p"),
          _D + f""", x AS (SELECT 'odd' AS kind, d1 % 2 + d2 % 2 + d3 % 2 AS k FROM draws UNION ALL SELECT 'high', CAST(d1 >= 5 AS INTEGER) + CAST(d2 >= 5 AS INTEGER) + CAST(d3 >= 5 AS INTEGER) FROM draws), n AS (SELECT kind, k, count(*) AS n FROM x GROUP BY 1, 2),
e AS (SELECT *, [1, 3, 3, 1][k + 1] / 8 * sum(n) OVER (PARTITION BY kind) AS expected FROM n), c AS (SELECT *, sum((n - expected) ** 2 / expected) OVER (PARTITION BY kind) AS chi2 FROM e)
SELECT kind, k, n, round(expected, 6) AS expected, round((n - expected) ** 2 / expected, 6) AS part, round(chi2, 6) AS chi2, round({_chi_sql('chi2', 3)}, 6) AS p FROM c""")


def _drawn(s, d):
    real = I.baskets(items(s, d))
    return real, T.drawn_baskets(real, DOMAIN)


def _against(value, name):
    return lambda s, d: (lambda x: _r(T.against_drawn(*x, value(F.col("xs")), name), "d", "p"))(_drawn(s, d))


#: Real and drawn baskets, and the two-sample KS of a value v of the relation vals (kind, v).
_BOTH = _I + ", real AS (SELECT t, list_sort(list(item)) AS xs FROM items GROUP BY t), sim AS (SELECT t, list_sort(list(k) FILTER (r <= len(xs))) AS xs FROM (SELECT t, xs, CAST(k AS INTEGER) AS k, row_number() OVER (PARTITION BY t ORDER BY md5('7:' || t || ':' || k)) AS r FROM real, range(1, 26) q(k)) GROUP BY t)"
_KS = ", h AS (SELECT v, count(*) FILTER (kind = 0) AS n, count(*) FILTER (kind = 1) AS m FROM vals WHERE v IS NOT NULL GROUP BY v), u AS (SELECT sum(n) OVER (ORDER BY v) / sum(n) OVER () AS a, sum(m) OVER (ORDER BY v) / sum(m) OVER () AS b, sum(n) OVER () AS n, sum(m) OVER () AS m FROM h), k AS (SELECT CAST(any_value(n) AS BIGINT) AS n, CAST(any_value(m) AS BIGINT) AS m, max(abs(a - b)) AS d FROM u)"


def _against_sql(name, expr):
    return f"{_BOTH}, vals AS (SELECT 0 AS kind, {expr} AS v FROM real UNION ALL SELECT 1, {expr} FROM sim){_KS} SELECT '{name}' AS test, n, m, round(d, 6) AS d, round({_ks_sql('d', '(n * m / (n + m))')}, 6) AS p FROM k"


_register("f7_consecutive_pairs", _against(T.adjacent_pairs, "adjacent"), _against_sql("adjacent", "len(list_filter(xs, lambda x: list_contains(xs, x + 1)))"))
_register("f13_range_test", _against(T.spread, "range"), _against_sql("range", "xs[-1] - xs[1]"))
_register("f13_spacing_test", _against(T.mean_spacing, "spacing"), _against_sql("spacing", "round((xs[-1] - xs[1]) / nullif(len(xs) - 1, 0), 6)"))
_register("f10_runs_test", lambda s, d: _r(I.runs_test(items(s, d), steps(s, d)).withColumn("p", tails.normal_two_sided(F.col("z"))), "z", "p"),
          _I + f""", x AS (SELECT i.item, g.t, CAST(h.t IS NOT NULL AS INTEGER) AS x, steps FROM (SELECT DISTINCT item FROM items) i, (SELECT t FROM draws) g, st LEFT JOIN items h ON h.item = i.item AND h.t = g.t),
y AS (SELECT item, x, steps, lag(x) OVER (PARTITION BY item ORDER BY t) AS b FROM x), r AS (SELECT item, any_value(steps) AS n, sum(x) AS n1, 1 + sum(CAST(x <> b AS INTEGER)) AS runs FROM y GROUP BY item),
m AS (SELECT *, 2.0 * n1 * (n - n1) / n + 1 AS mu FROM r), z AS (SELECT item, CAST(runs AS BIGINT) AS runs, CAST((runs - mu) / sqrt((mu - 1) * (mu - 2) / (n - 1)) AS DOUBLE) AS z FROM m) SELECT item, runs, round(z, 6) AS z, round({_normal_sql('z')}, 6) AS p FROM z""")


def _f11(s, d):
    n = steps(s, d)
    z = I.autocorrelation(items(s, d), n).withColumn("z", F.col("r") * n**0.5).withColumn("p", tails.normal_two_sided(F.col("z")))
    return _r(z.withColumn("p_bonferroni", F.least(F.col("p") * DOMAIN, F.lit(1.0))), "r", "z", "p", "p_bonferroni")


_register("f11_autocorrelation", _f11,
          _I + f""", x AS (SELECT i.item, g.t, CAST(h.t IS NOT NULL AS INTEGER) AS x, steps FROM (SELECT DISTINCT item FROM items) i, (SELECT t FROM draws) g, st LEFT JOIN items h ON h.item = i.item AND h.t = g.t),
p AS (SELECT *, avg(x) OVER (PARTITION BY item) AS p FROM x), y AS (SELECT item, p, x, steps, lead(x) OVER (PARTITION BY item ORDER BY t) AS nx FROM p), r AS (SELECT item, sum((x - p) * (nx - p)) / sum((x - p) ** 2) AS r, sum((x - p) * (nx - p)) / sum((x - p) ** 2) * sqrt(any_value(steps)) AS z FROM y GROUP BY item)
SELECT item, round(r, 6) AS r, round(z, 6) AS z, round({_normal_sql('z')}, 6) AS p, round(least({_normal_sql('z')} * 25, 1.0), 6) AS p_bonferroni FROM r""")
_register("f12_last_digit", lambda s, d: _r(T.last_digit(items(s, d), s.range(1, DOMAIN + 1).select(F.col("id").cast("int").alias("item"))), "expected", "part", "chi2", "p"),
          _I + f""", e AS (SELECT k % 10 AS digit, count(*) / 25 AS share FROM range(1, 26) q(k) GROUP BY 1), n AS (SELECT item % 10 AS digit, count(*) AS n FROM items GROUP BY 1), x AS (SELECT digit, coalesce(n, 0) AS n, share * (SELECT count(*) FROM items) AS expected FROM e LEFT JOIN n USING (digit)),
c AS (SELECT *, sum((n - expected) ** 2 / expected) OVER () AS chi2 FROM x) SELECT CAST(digit AS INTEGER) AS digit, n, round(expected, 6) AS expected, round((n - expected) ** 2 / expected, 6) AS part, round(chi2, 6) AS chi2, round({_chi_sql('chi2', 9)}, 6) AS p FROM c""")
_register("f14_entropy_trend", lambda s, d: _r(T.trend_p(draws(s, d).select("t", _bits().alias("h")).agg(F.count("*").alias("n"), F.round(F.regr_slope("h", "t"), 10).alias("slope"), F.round(F.regr_intercept("h", "t"), 6).alias("intercept"), F.corr("h", "t").alias("r"))), "r", "p"),
          _D + f""", x AS (SELECT t, coalesce(list_sum(list_transform([d1, d2, d3], lambda v: CASE WHEN v > 0 THEN -(v / (d1 + d2 + d3)) * log2(v / (d1 + d2 + d3)) ELSE 0 END)), 0) AS h FROM draws), r AS (SELECT count(*) AS n, regr_slope(h, t) AS slope, regr_intercept(h, t) AS intercept, corr(h, t) AS r FROM x)
SELECT n, round(slope, 10) AS slope, round(intercept, 6) AS intercept, round(r, 6) AS r, round({_normal_sql('(r * sqrt((n - 2) / (1 - r * r)))')}, 6) AS p FROM r""")
_LC = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - ({1}) + 1))"
_register("f15_repeat_count", lambda s, d: _r(T.repeat_counts(I.baskets(items(s, d)), DOMAIN), "expected", digits=4),
          _I + f""", b AS (SELECT t, list(item) AS xs FROM items GROUP BY t), n AS (SELECT len(list_intersect(x.xs, y.xs)) AS shared, len(x.xs) AS a, len(y.xs) AS b FROM b x JOIN b y ON y.t = x.t + 1), z AS (SELECT a, b, count(*) AS m FROM n GROUP BY 1, 2),
k AS (SELECT a, b, m, unnest(range(greatest(0, a + b - 25), least(a, b) + 1)) AS shared FROM z), e AS (SELECT shared, sum(m * exp({_LC.format('a', 'shared')} + {_LC.format('(25 - a)', '(b - shared)')} - {_LC.format('25', 'b')})) AS expected FROM k GROUP BY 1)
SELECT CAST(shared AS INTEGER) AS shared, coalesce(n, 0) AS n, round(expected, 4) AS expected FROM e LEFT JOIN (SELECT shared, count(*) AS n FROM n GROUP BY 1) USING (shared)""")


def _f16(s, d):
    real, drawn = _drawn(s, d)
    return _r(T.against_drawn(T.paired(real), T.paired(drawn), T.jaccard(F.col("xs"), F.col("ys")), "jaccard"), "d", "p")


_PAIR = "(SELECT len(list_intersect(x.xs, y.xs)) AS k, len(x.xs) + len(y.xs) AS s FROM {0} x JOIN {0} y ON y.t = x.t + 1)"
_register("f16_jaccard_consecutive", _f16, f"{_BOTH}, vals AS (SELECT 0 AS kind, round(k / (s - k), 6) AS v FROM {_PAIR.format('real')} UNION ALL SELECT 1, round(k / (s - k), 6) FROM {_PAIR.format('sim')}){_KS} SELECT 'jaccard' AS test, n, m, round(d, 6) AS d, round({_ks_sql('d', '(n * m / (n + m))')}, 6) AS p FROM k")


def _tests(s, d):
    """Frequencies, gaps and positions as one table of tests."""
    each, n = items(s, d), steps(s, d)
    rounded = F.round("p", 6).alias("p")
    a = T.frequency_test(each, n, DOMAIN).select(F.lit("frequency").alias("test"), F.col("item").cast("string").alias("key"), F.round("z", 6).alias("stat"), rounded)
    b = T.position_bias(rows(s, d), DIGITS, 10).select(F.lit("position").alias("test"), F.col("pos").alias("key"), F.round("chi2", 6).alias("stat"), rounded)
    gaps = S.key_gap(each, "item", cap=2**31).where(f"gap < {2**31}")
    c = T.with_ks_p(I.ks_exponential(gaps, "item", "gap", 9.0), F.col("n").cast("double")).select(F.lit("gap").alias("test"), F.col("item").cast("string").alias("key"), F.round("d", 6).alias("stat"), rounded)
    return a.unionByName(b).unionByName(c)


_TESTS = f"""{_F4}, a AS (SELECT count(*) / 25 AS e FROM items), z AS (SELECT item, (count(*) - any_value(e)) / sqrt(any_value(e) * (1 - any_value(e) / any_value(steps))) AS z FROM items, a, st GROUP BY item),
pv AS (SELECT 'd1' AS pos, d1 AS v FROM draws UNION ALL SELECT 'd2', d2 FROM draws UNION ALL SELECT 'd3', d3 FROM draws), pn AS (SELECT pos, v, count(*) AS n FROM pv GROUP BY 1, 2), pc AS (SELECT pos, sum(n * n) * 10 / sum(n) - sum(n) AS chi2 FROM pn GROUP BY pos),
tests AS (SELECT 'frequency' AS test, CAST(item AS VARCHAR) AS key, round(z, 6) AS stat, round({_normal_sql('z')}, 6) AS p FROM z UNION ALL SELECT 'position', pos, round(chi2, 6), round({_chi_sql('chi2', 9)}, 6) FROM pc UNION ALL SELECT 'gap', CAST(item AS VARCHAR), round(d, 6), round({_ks_sql('d', 'n')}, 6) FROM f4)"""
_register("f19_findings", lambda s, d: T.findings(_tests(s, d)), _TESTS + " SELECT test, key, stat, p, CASE WHEN p < 0.001 THEN 'strong' WHEN p < 0.01 THEN 'clear' ELSE 'weak' END AS severity FROM tests WHERE p < 0.05")
_register("f19_summary", lambda s, d: _r(T.summary(_tests(s, d)), "by_chance"), _TESTS + " SELECT test, count(*) AS n, count(*) FILTER (p < 0.05) AS found, round(count(*) * 0.05, 6) AS by_chance, min(p) AS least FROM tests GROUP BY test")
_register("o2_pair_significance", lambda s, d: _r(P.pair_significance(items(s, d), steps(s, d), DOMAIN), "z", "p", "p_bonferroni"),
          _I + f""", r AS (SELECT item, count(*) / any_value(steps) AS r, any_value(steps) AS steps FROM items, st GROUP BY item), n AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM items x JOIN items y ON x.t = y.t AND x.item < y.item GROUP BY 1, 2),
g AS (SELECT a.item AS a, b.item AS b, coalesce(n, 0) AS n, a.steps AS m, a.r * b.r AS p FROM r a JOIN r b ON a.item < b.item LEFT JOIN n ON n.a = a.item AND n.b = b.item),
k AS (SELECT a, b, n, m, p, unnest(range(0, m + 1)) AS k FROM g), q AS (SELECT a, b, any_value(n) AS n, any_value((n - m * p) / sqrt(m * p * (1 - p))) AS z, sum(CASE WHEN k <= n THEN f ELSE 0 END) AS lo, sum(CASE WHEN k >= n THEN f ELSE 0 END) AS hi FROM (SELECT *, exp({_LC.format('m', 'k')} + k * ln(p) + (m - k) * ln(1 - p)) AS f FROM k) GROUP BY a, b)
SELECT a, b, n, round(z, 6) AS z, round(least(1, 2 * least(lo, hi)), 6) AS p, round(least(1, 300 * least(1, 2 * least(lo, hi))), 6) AS p_bonferroni FROM q""")
