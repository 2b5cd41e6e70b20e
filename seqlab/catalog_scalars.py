"""Queries of row functions, tokens and windows of steps with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bindings import COVARIATES, DRAWS, ITEMS, draws, items, joined, rows, steps, table
from .catalog_relations import _r
from .operators import contexts as W
from .operators import features as E
from .operators import items as I
from .operators import scalars as C

QUERIES: dict = {}
SQL: dict[str, str] = {}
DIGITS = ["d1", "d2", "d3"]
_D, _I, _W = "WITH " + DRAWS, "WITH " + ITEMS, "WITH " + COVARIATES


def _register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


_register("c1_digit_codec", lambda s, d: rows(s, d).select("o_orderkey", C.label_of(F.col("c"), 3).alias("label"), *(x.alias(f"x{i}") for i, x in enumerate(C.digits_of(F.col("c"), 3), 1)), C.code_of([F.col(x) for x in DIGITS]).alias("code")),
          _D + " SELECT o_orderkey, lpad(CAST(c AS VARCHAR), 3, '0') AS label, CAST(c // 100 AS INTEGER) AS x1, CAST(c // 10 % 10 AS INTEGER) AS x2, CAST(c % 10 AS INTEGER) AS x3, CAST(d1 AS BIGINT) * 100 + d2 * 10 + d3 AS code FROM draws")


def _c2(s, d):
    from .operators.feature_sets import shape

    made = shape([F.col(x) for x in DIGITS])
    keys = ["sum", "repeating", "triple", "sequential", "odd", "even", "high", "low"]
    return rows(s, d).select(*(made[k].alias(k) for k in keys)).groupBy(*keys).agg(F.count("*").alias("n"))


_register("c2_digit_shape", _c2, _D + """, u AS (SELECT *, list_sort([d1, d2, d3]) AS u FROM draws) SELECT d1 + d2 + d3 AS sum, CAST(len(list_distinct(u)) < 3 AS INTEGER) AS repeating, CAST(d1 = d2 AND d2 = d3 AS INTEGER) AS triple, CAST(u[2] - u[1] = 1 AND u[3] - u[2] = 1 AS INTEGER) AS sequential,
d1 % 2 + d2 % 2 + d3 % 2 AS odd, 3 - (d1 % 2 + d2 % 2 + d3 % 2) AS even, CAST(d1 >= 5 AS INTEGER) + CAST(d2 >= 5 AS INTEGER) + CAST(d3 >= 5 AS INTEGER) AS high, 3 - (CAST(d1 >= 5 AS INTEGER) + CAST(d2 >= 5 AS INTEGER) + CAST(d3 >= 5 AS INTEGER)) AS low, count(*) AS n FROM u GROUP BY ALL""")
_register("c3_basket_shape", lambda s, d: _r(I.baskets(items(s, d)).select("t", *(v.alias(k) for k, v in C.basket_shape(F.col("xs"), 13).items())), "mean", "sd", "odd_share", "high_share"),
          _I + """, g AS (SELECT t, item, item - lag(item) OVER (PARTITION BY t ORDER BY item) AS gap FROM items) SELECT t, CAST(count(*) AS INTEGER) AS size, CAST(sum(item) AS BIGINT) AS total, round(avg(item), 6) AS mean, round(stddev_samp(item), 6) AS sd, max(item) - min(item) AS range, CAST(count(*) FILTER (item % 2 = 1) AS INTEGER) AS odd,
round(avg(item % 2), 6) AS odd_share, CAST(count(*) FILTER (item >= 13) AS INTEGER) AS high, round(avg(CAST(item >= 13 AS INTEGER)), 6) AS high_share, CAST(count(*) FILTER (gap = 1) AS INTEGER) AS adjacent, max(gap) AS widest, CAST(count(DISTINCT item % 10) AS INTEGER) AS last_digits FROM g GROUP BY t""")
_register("c4_calendar", lambda s, d: (lambda x: x.join(F.broadcast(x.agg(F.min("day").alias("first")))).select("o_orderkey", *(v.alias(k) for k, v in C.calendar(F.col("day"), F.col("first")).items())))(rows(s, d)),
          _D + " SELECT o_orderkey, CAST(isodow(day) - 1 AS INTEGER) AS dow, substr(dayname(day), 1, 3) AS name, CAST(month(day) AS INTEGER) AS month, CAST(year(day) AS INTEGER) AS year, CAST(dayofyear(day) AS INTEGER) AS doy, CAST(day - (SELECT min(day) FROM draws) AS INTEGER) AS since FROM draws")
_register("c6_covariate_flags", lambda s, d: _r(C.above_median(joined(s, d, False), ["quantity", "price"]).select("o_orderkey", C.celsius(F.col("quantity")).alias("celsius"), (F.col("quantity") > 25).alias("warm"), "above_quantity", "above_price"), "celsius"),
          _W + ", m AS (SELECT quantile_cont(quantity, 0.5) AS q, quantile_cont(price, 0.5) AS p FROM w) SELECT o_orderkey, round((quantity - 32) * 5 / 9, 6) AS celsius, quantity > 25 AS warm, quantity > q AS above_quantity, price > p AS above_price FROM w, m")


def _c8(s, d):
    x = F.col("c") / 100.0 - 5
    made = {
        "sigmoid": C.sigmoid(x), "logit": C.logit(F.col("c") / 999.0), "log": C.safe_log(F.col("c").cast("double")), "clipped": C.clip(x, -2.0, 2.0), "finite": C.finite(F.try_divide(F.col("d1"), F.col("d3")) * 1e7),
        "decayed": C.decay(F.col("d1"), 0.5), "first": C.softmax(F.array(*(F.col(v).cast("double") for v in DIGITS)))[0],
    }
    return rows(s, d).select("o_orderkey", *(F.round(v, 6).alias(k) for k, v in made.items()))


_register("c8_safe_maths", _c8,
          _D + """ SELECT o_orderkey, round(1 / (1 + exp(-(c / 100.0 - 5))), 6) AS sigmoid, round(ln(greatest(least(c / 999.0, 1 - 1e-10), 1e-10) / (1 - greatest(least(c / 999.0, 1 - 1e-10), 1e-10))), 6) AS logit, round(ln(greatest(CAST(c AS DOUBLE), 1e-15)), 6) AS log, round(greatest(least(c / 100.0 - 5, 2.0), -2.0), 6) AS clipped,
CASE WHEN d3 = 0 THEN 0.0 ELSE round(greatest(least(d1 / d3 * 1e7, 1e6), -1e6), 6) END AS finite, round(exp(-0.5 * d1), 6) AS decayed, round(exp(CAST(d1 AS DOUBLE)) / (exp(CAST(d1 AS DOUBLE)) + exp(CAST(d2 AS DOUBLE)) + exp(CAST(d3 AS DOUBLE))), 6) AS first FROM draws""")


def _c9(s, d):
    base = I.baskets(items(s, d))
    both = base.join(base.select((F.col("t") - 1).alias("t"), F.col("xs").alias("ys")), "t")
    return _r(both.select("t", *(v.alias(k) for k, v in C.overlap(F.col("xs"), F.col("ys")).items()), F.array_position("xs", F.col("ys")[0]).alias("place")), "jaccard")


_register("c9_set_ops", _c9, _I + ", b AS (SELECT t, list_sort(list(item)) AS xs FROM items GROUP BY t), p AS (SELECT x.t, x.xs, y.xs AS ys, len(list_intersect(x.xs, y.xs)) AS k FROM b x JOIN b y ON y.t = x.t + 1) SELECT t, CAST(k AS INTEGER) AS both, CAST(len(xs) + len(ys) - k AS INTEGER) AS either, round(k / (len(xs) + len(ys) - k), 6) AS jaccard, k = len(ys) AS holds, CAST(coalesce(list_position(xs, ys[1]), 0) AS BIGINT) AS place FROM p")


def _c11(s, d):
    each = table(s, d, "events").select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    made = each.groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"), F.max("k").alias("most"), F.min_by("event_type", "event_id").alias("first"), F.max_by("event_type", "event_id").alias("last"))
    return made.select("user_id", C.fingerprint(F.col("kinds")).alias("kinds"), C.fingerprint(F.array("first", "last"), ordered=True).alias("ends"), "most")


_register("c11_fingerprints", _c11, "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), '+') AS kinds, arg_min(event_type, event_id) || '+' || arg_max(event_type, event_id) AS ends, max(CAST(props ->> '$.k' AS INTEGER)) AS most FROM events GROUP BY user_id")
_SLOTS = ["10:00", "12:27", "18:00", "22:12"]
_register("c12_next_slot", lambda s, d: table(s, d, "events").select("event_id", C.next_slot(F.col("ts"), _SLOTS).alias("slot")),
          "SELECT event_id, min(x) AS slot FROM (SELECT event_id, ts, date_trunc('day', ts) + to_minutes(CAST(1440 * k + m AS BIGINT)) AS x FROM events, range(3) q(k), (SELECT unnest([600, 747, 1080, 1332]) AS m)) WHERE x > ts AND isodow(x) <> 7 GROUP BY event_id")


def _u5(s, d):
    x = table(s, d, "orders").agg(F.min("o_orderdate").cast("date").cast("string").alias("lo"), F.max("o_orderdate").cast("date").cast("string").alias("hi")).first()  # two dates
    slots = C.calendar_slots(s, x.lo, x.hi, ["0", "1", "2", "3"])
    have = rows(s, d).groupBy("day", F.col("slot").cast("string").alias("slot")).agg(F.count("*").alias("n"))
    return slots.join(have, ["day", "slot"], "left").na.fill(0, ["n"])


_register("u5_calendar_slots", _u5, _D + ", g AS (SELECT CAST(x AS DATE) AS day FROM (SELECT unnest(generate_series((SELECT min(day) FROM draws), (SELECT max(day) FROM draws), INTERVAL 1 DAY)) AS x) WHERE isodow(x) <> 7), n AS (SELECT day, slot, count(*) AS n FROM draws GROUP BY 1, 2) SELECT g.day, CAST(k AS VARCHAR) AS slot, coalesce(n, 0) AS n FROM g CROSS JOIN range(4) q(k) LEFT JOIN n ON n.day = g.day AND n.slot = k")
_TOKENS = ["machine", "ball2"]


def _tokens(s, d):
    each = draws(s, d)
    cut = int(0.001 * steps(s, d)) + 5  # a vocabulary of the first rows only, so that some values are new
    return C.tokenize(each, C.build_vocabulary(each.where(F.col("t") < cut), _TOKENS), _TOKENS, DIGITS)


_VOCAB = _D + ", v AS (SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY value) + 2 AS id FROM (SELECT DISTINCT 'machine' AS kind, machine AS value FROM draws WHERE t < (SELECT count(*) // 1000 + 5 FROM orders) UNION SELECT DISTINCT 'ball2', CAST(ball2 AS VARCHAR) FROM draws WHERE t < (SELECT count(*) // 1000 + 5 FROM orders) AND ball2 IS NOT NULL))"
_register("c13_token_encode", lambda s, d: _tokens(s, d).select("t", *(f"token_{c}" for c in (*_TOKENS, *DIGITS))),
          _VOCAB + " SELECT t, CAST(coalesce(a.id, 2) AS INTEGER) AS token_machine, CAST(coalesce(b.id, 2) AS INTEGER) AS token_ball2, d1 + 3 AS token_d1, d2 + 3 AS token_d2, d3 + 3 AS token_d3 FROM draws LEFT JOIN v a ON a.kind = 'machine' AND a.value = machine LEFT JOIN v b ON b.kind = 'ball2' AND b.value = CAST(ball2 AS VARCHAR)")
_register("e9_tokenize", lambda s, d: C.build_vocabulary(rows(s, d), ["machine", "ball1", "ball2", "ball3"]),
          _D + ", x AS (" + " UNION ".join(f"SELECT '{c}' AS kind, CAST({c} AS VARCHAR) AS value FROM draws WHERE {c} IS NOT NULL" for c in ("machine", "ball1", "ball2", "ball3")) + ") SELECT kind, value, CAST(row_number() OVER (PARTITION BY kind ORDER BY value) + 2 AS INTEGER) AS id FROM x")
_register("e5_standardise_moments", lambda s, d: _r((lambda x: E.scale(x.select("o_orderkey", *(F.col(c).cast("double").alias(c) for c in ("c", "d1"))), x, ["c", "d1"]))(rows(s, d)), "c", "d1"),
          _D + ", m AS (SELECT avg(c) AS a, stddev_pop(c) AS b, avg(d1) AS e, stddev_pop(d1) AS f FROM draws) SELECT o_orderkey, round((c - a) / b, 6) AS c, round((d1 - e) / f, 6) AS d1 FROM draws, m")

# reports
_register("s10_coverage_by_slot", lambda s, d: _r(rows(s, d).groupBy("slot").agg(F.count("*").alias("n"), F.countDistinct("day").alias("days"), F.avg(F.col("ball2").isNotNull().cast("int")).alias("ball2_filled"), F.countDistinct("machine").alias("machines"), F.min("day").alias("lo"), F.max("day").alias("hi")), "ball2_filled"),
          _D + " SELECT slot, count(*) AS n, count(DISTINCT day) AS days, round(avg(CAST(ball2 IS NOT NULL AS INTEGER)), 6) AS ball2_filled, count(DISTINCT machine) AS machines, min(day) AS lo, max(day) AS hi FROM draws GROUP BY slot")
_register("r14_unknown_labels", lambda s, d: rows(s, d).where("c < 0 or c > 999 or machine is null or machine not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')").groupBy("machine").agg(F.count("*").alias("n")),
          _D + " SELECT machine, count(*) AS n FROM draws WHERE c < 0 OR c > 999 OR machine IS NULL OR machine NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') GROUP BY 1")

# windows of steps
_B = _I + ", b AS (SELECT t, list_sort(list(item)) AS xs FROM items GROUP BY t), e AS (SELECT t, coalesce(xs, []) AS xs FROM (SELECT t FROM draws) LEFT JOIN b USING (t))"


def _steps(s, d):
    return W.every_step(s, items(s, d), steps(s, d))


_COUNTS = "[" + ", ".join(f"sum(CAST(list_contains(xs, {k}) AS INTEGER)) OVER w" for k in range(1, 26)) + "]"
_register("w14_rolling_basket_stats", lambda s, d: _r(W.rolling_basket_stats(_steps(s, d), range(1, 26), 50), "chi2", "entropy", "variance"),
          _B + f", k AS (SELECT t, {_COUNTS} AS n FROM e WINDOW w AS (ORDER BY t ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)), m AS (SELECT t, n, list_sum(n) / 25 AS m FROM k), q AS (SELECT t, n, m, list_sum(list_transform(n, lambda x: (x - m) * (x - m))) AS sq FROM m) SELECT t, round(coalesce(sq / nullif(m, 0), 0), 6) AS chi2, round(CAST(coalesce(list_sum(list_transform(n, lambda x: CASE WHEN x > 0 THEN -(x / (m * 25)) * log2(x / (m * 25)) ELSE 0 END)), 0) AS DOUBLE), 6) AS entropy, round(sq / 25, 6) AS variance FROM q")
_register("w21_prev_step_context", lambda s, d: W.previous_context(_steps(s, d)),
          _B + ", x AS (SELECT t, CAST(coalesce(list_sum(xs), 0) AS BIGINT) AS total, coalesce(xs[-1] - xs[1], 0) AS range, CAST(len(list_filter(xs, lambda y: y % 2 = 1)) AS INTEGER) AS odd FROM e), r AS (SELECT *, CAST(range > coalesce(max(range) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS INTEGER) AS record FROM x) SELECT t, coalesce(lag(total) OVER w, 0) AS prev_total, coalesce(lag(range) OVER w, 0) AS prev_range, coalesce(lag(odd) OVER w, 0) AS prev_odd, coalesce(lag(record) OVER w, 0) AS prev_record FROM r WINDOW w AS (ORDER BY t)")
_EVENTS = _B + """, u AS (SELECT t, item, count(*) OVER (PARTITION BY item ORDER BY t RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING) AS f, 20 * (SELECT count(*) FROM items) / (SELECT count(*) FROM orders) / 25 AS expected FROM items),
s AS (SELECT t, list_sum(xs) AS total, xs[-1] - xs[1] AS spread, len(list_filter(xs, lambda y: y % 2 = 1)) / len(xs) AS odd FROM b), c AS (SELECT quantile_cont(total, [0.25, 0.5, 0.75]) AS q, quantile_cont(spread, 0.5) AS middle FROM s),
ev AS (SELECT t, CASE WHEN f >= 1.5 * expected THEN 'hot_' || item WHEN f <= 0.5 * expected THEN 'cold_' || item END AS event FROM u UNION ALL SELECT t, 'sum_q' || (1 + len(list_filter(q, lambda x: total > x))) FROM s, c UNION ALL SELECT t, CASE WHEN spread > middle THEN 'wide' ELSE 'narrow' END FROM s, c UNION ALL SELECT t, CASE WHEN odd > 0.5 THEN 'odd_heavy' WHEN odd < 0.5 THEN 'even_heavy' END FROM s)
"""
_register("w24_step_events", lambda s, d: (lambda x: W.step_events(x, W.every_step(s, x, steps(s, d)), 25))(items(s, d)), _EVENTS + "SELECT t, event FROM ev WHERE event IS NOT NULL")


def _cuts(s, d):
    n = steps(s, d)
    return [int(0.7 * n), int(0.85 * n)]


_CUT = "CAST(t + {k} >= floor(0.7 * n) AS INTEGER) + CAST(t + {k} >= floor(0.85 * n) AS INTEGER)"
_register("w27_split_windows", lambda s, d: W.split_counts(W.split_windows(draws(s, d), _cuts(s, d), 64, 5)),
          _D + f", x AS (SELECT t, (SELECT count(*) FROM orders) AS n FROM draws), y AS (SELECT t, CASE WHEN {_CUT.format(k=0)} = {_CUT.format(k=5)} THEN {_CUT.format(k=0)} END AS split FROM x WHERE t >= 64 AND t + 5 < n) SELECT split, count(*) AS n, min(t) AS lo, max(t) AS hi FROM y GROUP BY split")


def _w28(s, d):
    each, cut = draws(s, d), _cuts(s, d)[1]
    made = W.live_windows(each.where(F.col("t") < cut), each.where(F.col("t") >= cut), ["c"], 8)
    return made.select("t", F.concat_ws(",", F.transform("context", lambda x: x["c"].cast("string"))).alias("context"))


_register("w28_live_windows", _w28, _D + ", x AS (SELECT t, string_agg(CAST(c AS VARCHAR), ',') OVER (ORDER BY t ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS context FROM draws) SELECT t, context FROM x WHERE t >= (SELECT floor(0.85 * count(*)) FROM orders) AND t >= 8")
