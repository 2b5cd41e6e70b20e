"""Queries of probability sets and ledgers with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bindings import DRAWS, draws, rows, table
from .operators import ledger as K
from .operators import scores as L
from .operators.series import with_ordinal
from .storage import pinned

QUERIES: dict = {}
SQL: dict[str, str] = {}
DIGITS = ["d1", "d2", "d3"]
LAGS = [0, 1, 2, 3, 4, 5]


def _register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def numbered(s, d):
    """Draws by their place, with no more than their digits: t, c, d1, d2, d3."""
    return with_ordinal(rows(s, d).select("day", "o_orderkey", "c", *DIGITS), ["day", "o_orderkey"]).select("t", "c", *DIGITS)


def marginals(s, d, n=100):
    """Draws with the add-one digit shares of their last n rows: p_d1, p_d2, p_d3."""
    return L.smoothed_marginals(numbered(s, d), DIGITS, 10, n)


def ranked(s, d):
    """Draws with the rank and chance of what came."""
    return L.with_rank(marginals(s, d), [f"p_{x}" for x in DIGITS], "c").select("t", "rank", "own")


def sets(s, d):
    """Per draw the 20 likeliest combinations."""
    return L.top_combinations(marginals(s, d), [f"p_{x}" for x in DIGITS], 20).select("t", F.col("c").alias("actual"), "chosen")


def chosen(s, d):
    """The ledger: sets() in one copy."""
    return pinned(sets(s, d))


def _marg(n, name="m"):
    lists = ", ".join(f"coalesce(list({x}) OVER w, []) AS l_{x}" for x in DIGITS)
    shares = ", ".join(f"list_transform(range(10), lambda s: (len(list_filter(l_{x}, lambda y: y = s)) + 1) / (len(l_{x}) + 10)) AS p_{x}" for x in DIGITS)
    return f"{name} AS (SELECT t, c, d1, d2, d3, {shares} FROM (SELECT *, {lists} FROM draws WINDOW w AS (ORDER BY t ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)))"


BASE = "WITH " + DRAWS + ",\n" + _marg(100)
JOINT = BASE + """,
j AS (SELECT t, c AS actual, g.x AS c, p_d1[g.x // 100 + 1] * p_d2[g.x // 10 % 10 + 1] * p_d3[g.x % 10 + 1] AS p FROM m, (SELECT unnest(range(1000)) AS x) g),
o AS (SELECT t, p AS own FROM j WHERE c = actual),
r AS (SELECT j.t, any_value(own) AS own, CAST(1 + count(*) FILTER (p > own OR (p = own AND c < actual)) AS BIGINT) AS rank, sum(p * p) AS squares FROM j JOIN o USING (t) GROUP BY j.t)
"""
TOP = JOINT.rstrip() + """,
k AS (SELECT t, any_value(actual) AS actual, list(c ORDER BY place) AS chosen FROM (SELECT t, actual, c, row_number() OVER (PARTITION BY t ORDER BY p DESC, c) AS place FROM j) WHERE place <= 20 GROUP BY t)
"""
_BEST = "list_max(list_transform(chosen, lambda x: CAST(x // 100 = {a} // 100 AS INTEGER) + CAST(x // 10 % 10 = {a} // 10 % 10 AS INTEGER) + CAST(x % 10 = {a} % 10 AS INTEGER)))"


def _long(p):
    return lambda s, d: p(s, d).select("t", F.posexplode("p").alias("symbol", "p")).select("t", "symbol", F.round("p", 9).alias("p"))


def _two(s, d):
    a = marginals(s, d).select("t", F.col("p_d1").alias("a"))
    return a.join(marginals(s, d, 25).select("t", F.col("p_d1").alias("b")), "t")


_TWO = BASE + ",\n" + _marg(25, "m25") + ",\nab AS (SELECT m.t, g.x AS symbol, m.p_d1[g.x + 1] AS a, m25.p_d1[g.x + 1] AS b FROM m JOIN m25 USING (t), (SELECT unnest(range(10)) AS x) g)\n"
_register("l1_weighted_mean", _long(lambda s, d: _two(s, d).select("t", L.weighted_mean(["a", "b"], [2.0, 1.0]).alias("p"))), _TWO + "SELECT t, CAST(symbol AS INTEGER) AS symbol, round(a * (2.0::DOUBLE / 3.0) + b * (1.0::DOUBLE / 3.0), 9) AS p FROM ab")
_register("l3_geometric_blend", _long(lambda s, d: _two(s, d).select("t", L.geometric_blend("a", "b", 2.0, 1.0).alias("p"))),
          _TWO + "SELECT t, CAST(symbol AS INTEGER) AS symbol, round(g / sum(g) OVER (PARTITION BY t), 9) AS p FROM (SELECT *, exp((2 * ln(a + 1e-20) + ln(b + 1e-20)) / 3) AS g FROM ab)")
_register("l4_product_ensemble", _long(lambda s, d: _two(s, d).select("t", L.product_ensemble(["a", "b"]).alias("p"))), _TWO + "SELECT t, CAST(symbol AS INTEGER) AS symbol, round(a * b / sum(a * b) OVER (PARTITION BY t), 9) AS p FROM ab")
_register("l5_topk_combos", lambda s, d: chosen(s, d).select("t", F.concat_ws(",", F.transform("chosen", lambda x: x.cast("string"))).alias("combos")), TOP + "SELECT t, array_to_string(chosen, ',') AS combos FROM k")
_register("l8_rank_of_actual", lambda s, d: ranked(s, d).select("t", "rank", F.round("own", 12).alias("own")), JOINT + "SELECT t, rank, round(own, 12) AS own FROM r")


def _l9(s, d):
    held = L.with_rank(marginals(s, d), [f"p_{x}" for x in DIGITS], "c", squares=True)
    rows = held.select("rank", "own", ((F.col("squares") - 2 * F.col("own") + 1) / 1000).alias("brier"))
    hits = {f"hit{k}": F.avg((F.col("rank") <= k).cast("int")) for k in (1, 5, 20, 100)}
    means = {"mean_rank": F.avg("rank"), "log_likelihood": F.avg(F.log(F.greatest("own", F.lit(1e-15)))), "brier": F.avg("brier"), **hits}
    return rows.agg(F.count("*").alias("n"), *(F.round(v, 6).alias(k) for k, v in means.items()), F.round(500.5 / F.avg("rank"), 6).alias("lift"))


_register("l9_l12_set_metrics", _l9, JOINT + """SELECT count(*) AS n, round(avg(rank), 6) AS mean_rank, round(avg(ln(greatest(own, 1e-15))), 6) AS log_likelihood, round(avg((squares - 2 * own + 1) / 1000), 6) AS brier,
round(avg(CAST(rank <= 1 AS INTEGER)), 6) AS hit1, round(avg(CAST(rank <= 5 AS INTEGER)), 6) AS hit5, round(avg(CAST(rank <= 20 AS INTEGER)), 6) AS hit20, round(avg(CAST(rank <= 100 AS INTEGER)), 6) AS hit100, round(500.5 / avg(rank), 6) AS lift FROM r""")
_register("l10_optimal_ev", lambda s, d: L.optimal_ev(ranked(s, d)).select("k", F.round("hit", 9).alias("hit"), F.round("ev", 6).alias("ev"), "best"), JOINT + """,
e AS (SELECT CAST(g.k AS INTEGER) AS k, avg(CAST(rank <= g.k AS INTEGER)) AS hit, avg(CAST(rank <= g.k AS INTEGER)) * 500 - g.k AS ev FROM r, (SELECT unnest(range(1, 21)) AS k) g GROUP BY g.k)
SELECT k, round(hit, 9) AS hit, round(ev, 6) AS ev, row_number() OVER (ORDER BY round(ev, 9) DESC, k) = 1 AS best FROM e""")


def _l11(s, d):
    return L.with_box_rank(marginals(s, d).select("t", *DIGITS, *(f"p_{x}" for x in DIGITS)), [f"p_{x}" for x in DIGITS], DIGITS).select("t", "box", "rank")


_BOX = "CAST(list_aggregate(list_transform(list_sort([{c} // 100, {c} // 10 % 10, {c} % 10]), lambda x, i: x * [100, 10, 1][i]), 'sum') AS INTEGER)"
_register("l11_box_rank", _l11, JOINT + f""",
b AS (SELECT t, {_BOX.format(c='c')} AS box, {_BOX.format(c='any_value(actual)')} AS own_box, round(sum(p), 12) AS p FROM j GROUP BY t, 2)
SELECT t, own_box AS box, rank FROM (SELECT t, box, own_box, row_number() OVER (PARTITION BY t ORDER BY p DESC, box) AS rank FROM b) WHERE box = own_box""")


def _per_position(s, d):
    each = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("position"), F.col(x).alias("d"), F.col(f"p_{x}").alias("p")) for i, x in enumerate(DIGITS)))).alias("x")
    return marginals(s, d).select("t", each).select("t", "x.*").withColumn("rank", L.rank_of(F.col("p"), F.col("d")))


_POS = BASE + """,
x AS (SELECT t, 1 AS position, d1 AS d, p_d1 AS p FROM m UNION ALL SELECT t, 2, d2, p_d2 FROM m UNION ALL SELECT t, 3, d3, p_d3 FROM m),
y AS (SELECT t, position, p[d + 1] AS own, 1 + len(list_filter(list_zip(p, range(10)), lambda q: q[1] > p[d + 1] OR (q[1] = p[d + 1] AND q[2] < d))) AS rank FROM x)
"""
_register("l13_digit_metrics", lambda s, d: _per_position(s, d).groupBy("position").agg(*(F.round(F.avg((F.col("rank") <= k).cast("int")), 6).alias(f"top{k}") for k in (1, 3, 5)), F.round(F.avg("rank"), 6).alias("mean_rank")),
          _POS + "SELECT position, round(avg(CAST(rank <= 1 AS INTEGER)), 6) AS top1, round(avg(CAST(rank <= 3 AS INTEGER)), 6) AS top3, round(avg(CAST(rank <= 5 AS INTEGER)), 6) AS top5, round(avg(rank), 6) AS mean_rank FROM y GROUP BY 1")
_register("l16_position_logloss", lambda s, d: _per_position(s, d).groupBy("position").agg(F.round(F.avg(-F.log(F.element_at("p", F.col("d") + 1))), 6).alias("log_loss"), F.round(F.avg((F.col("rank") == 1).cast("int")), 6).alias("top1")), _POS + "SELECT position, round(avg(-ln(own)), 6) AS log_loss, round(avg(CAST(rank = 1 AS INTEGER)), 6) AS top1 FROM y GROUP BY 1")


def _l14(s, d):
    rows = marginals(s, d)
    out = []
    for name, a, b in (("front", "d1", "d2"), ("back", "d2", "d3")):
        ranked = pinned(rows.withColumn("p", L.joint([f"p_{a}", f"p_{b}"])).select(L.rank_of(F.col("p"), F.col(a) * 10 + F.col(b)).alias("rank")))
        mean = ranked.agg(F.round(F.avg("rank"), 6).alias("mean_rank"))
        out.append(L.optimal_ev(ranked, payout=50.0).select(F.lit(name).alias("pair"), "k", F.round("hit", 9).alias("hit"), F.round("ev", 6).alias("ev"), "best").join(F.broadcast(mean)))
    return out[0].unionByName(out[1])


_register("l14_pair_ev", _l14, BASE + """,
j AS (SELECT t, 'front' AS pair, d1 * 10 + d2 AS actual, g.x AS c, p_d1[g.x // 10 + 1] * p_d2[g.x % 10 + 1] AS p FROM m, (SELECT unnest(range(100)) AS x) g UNION ALL SELECT t, 'back', d2 * 10 + d3, g.x, p_d2[g.x // 10 + 1] * p_d3[g.x % 10 + 1] FROM m, (SELECT unnest(range(100)) AS x) g),
r AS (SELECT j.pair, j.t, 1 + count(*) FILTER (j.p > o.p OR (j.p = o.p AND j.c < o.c)) AS rank FROM j JOIN j o ON o.t = j.t AND o.pair = j.pair AND o.c = o.actual GROUP BY 1, 2),
e AS (SELECT pair, CAST(g.k AS INTEGER) AS k, avg(CAST(rank <= g.k AS INTEGER)) AS hit, avg(CAST(rank <= g.k AS INTEGER)) * 50 - g.k AS ev, avg(rank) AS mean_rank FROM r, (SELECT unnest(range(1, 21)) AS k) g GROUP BY pair, g.k)
SELECT pair, k, round(hit, 9) AS hit, round(ev, 6) AS ev, row_number() OVER (PARTITION BY pair ORDER BY round(ev, 9) DESC, k) = 1 AS best, round(mean_rank, 6) AS mean_rank FROM e""")


def _l11_ev(s, d):
    rows = _l11(s, d).withColumn("kinds", F.size(F.array_distinct(F.array(*(F.floor(F.col("box") / x) % 10 for x in (100, 10, 1))))))  # a box has its draw's digits
    pay = F.when(F.col("kinds") == 3, 80).when(F.col("kinds") == 2, 160).otherwise(0)
    each = rows.agg(F.avg("rank").alias("mean_rank"), *(F.avg(F.when(F.col("rank") <= k, pay).otherwise(0)).alias(f"w{k}") for k in range(1, 21)))
    spread = each.select("mean_rank", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"w{k}").alias("won")) for k in range(1, 21)))).alias("x"))
    return spread.select("x.k", F.round("x.won", 6).alias("won"), F.round(F.col("x.won") - F.col("x.k"), 6).alias("ev"), F.round("mean_rank", 6).alias("mean_rank"))


_register("l11_box_ev", _l11_ev, SQL["l11_box_rank"].replace("\nSELECT t, own_box", ", y AS (SELECT t, own_box", 1) + "), z AS (SELECT rank, CASE len(list_distinct([d1, d2, d3])) WHEN 3 THEN 80 WHEN 2 THEN 160 ELSE 0 END AS pay FROM y JOIN draws USING (t)) SELECT CAST(k AS INTEGER) AS k, round(avg(CASE WHEN rank <= k THEN pay ELSE 0 END), 6) AS won, round(avg(CASE WHEN rank <= k THEN pay ELSE 0 END) - k, 6) AS ev, round(avg(rank), 6) AS mean_rank FROM z, range(1, 21) q(k) GROUP BY k")
_COVER = ", ".join(f"CAST(list_contains(list_transform(chosen, lambda x: x // {s} % 10), {{a}} // {s} % 10) AS INTEGER) AS cover{i}" for i, s in enumerate((100, 10, 1), 1))
_register("l18_match_levels", lambda s, d: chosen(s, d).select("t", L.match_levels(F.col("chosen"), F.col("actual")).alias("best"), *(c.alias(f"cover{i}") for i, c in enumerate(L.covered(F.col("chosen"), F.col("actual")), 1))), TOP + f"SELECT t, {_BEST.format(a='actual')} AS best, {_COVER.format(a='actual')} FROM k")
_register("n1_lag_table", lambda s, d: (lambda x: L.lag_table(x, x, LAGS).select("lag", "n", *(F.round(c, 6).alias(c) for c in ("exact", "best", "two", "cover1", "cover2", "cover3"))))(chosen(s, d)),
          TOP + f""", h AS (SELECT CAST(g.lag AS INTEGER) AS lag, {_BEST.format(a='b.actual')} AS best, {_COVER.format(a='b.actual')} FROM k a, (SELECT unnest(range(6)) AS lag) g, (SELECT t AS at, actual FROM k) b WHERE b.at = a.t + g.lag)
SELECT lag, count(*) AS n, round(avg(CAST(best = 3 AS INTEGER)), 6) AS exact, round(avg(best), 6) AS best, round(avg(CAST(best >= 2 AS INTEGER)), 6) AS two, round(avg(cover1), 6) AS cover1, round(avg(cover2), 6) AS cover2, round(avg(cover3), 6) AS cover3 FROM h GROUP BY lag""")
_register("n4_negative_lag_control", lambda s, d: (lambda x: L.lag_table(x, x, [-1, -2]).select("lag", "n", F.round("exact", 6).alias("exact"), F.round("best", 6).alias("best")))(chosen(s, d)),
          TOP + f""", h AS (SELECT CAST(-g.lag AS INTEGER) AS lag, {_BEST.format(a='b.actual')} AS best FROM k a, (SELECT unnest([1, 2]) AS lag) g, (SELECT t AS at, actual FROM k) b WHERE b.at = a.t - g.lag)
SELECT lag, count(*) AS n, round(avg(CAST(best = 3 AS INTEGER)), 6) AS exact, round(avg(best), 6) AS best FROM h GROUP BY lag""")
# ledgers
_register("k2_score_ledger", lambda s, d: (lambda x: K.score(x.select((F.col("t") + 1).alias("t"), "chosen"), x).select("t", "actual", "hit", "place"))(chosen(s, d)),
          TOP + "SELECT a.t + 1 AS t, b.actual, list_contains(a.chosen, b.actual) AS hit, CAST(nullif(list_position(a.chosen, b.actual), 0) AS BIGINT) AS place FROM k a LEFT JOIN (SELECT t, actual FROM k) b ON b.t = a.t + 1")
_SAME = "(CAST(x // 100 = actual // 100 AS INTEGER) + CAST(x // 10 % 10 = actual // 10 % 10 AS INTEGER) + CAST(x % 10 = actual % 10 AS INTEGER))"
_register("k6_near_hits", lambda s, d: (lambda x: K.near_hits(x, x, range(-5, 6)))(chosen(s, d)),
          TOP + f""", h AS (SELECT a.t, CAST(g.lag AS INTEGER) AS lag, b.actual, a.chosen, {_BEST.format(a='b.actual')} AS best FROM k a, (SELECT unnest(range(-5, 6)) AS lag) g, (SELECT t AS at, actual FROM k) b WHERE b.at = a.t + g.lag), c AS (SELECT *, list_filter(chosen, lambda x: {_SAME} = best)[1] AS combo FROM h WHERE best >= 2)
SELECT t, lag, actual, best, combo, concat_ws(',', CASE WHEN combo // 100 = actual // 100 THEN '1' END, CASE WHEN combo // 10 % 10 = actual // 10 % 10 THEN '2' END, CASE WHEN combo % 10 = actual % 10 THEN '3' END) AS places, best = 3 AS exact FROM c""")
_register("k4_running_stats", lambda s, d: (lambda x: K.running_stats(K.score(x.select((F.col("t") + 1).alias("t"), "chosen"), x).withColumn("model", F.col("t") % 3), "model").select("model", "n", "scored", "hits", F.round("rate", 6).alias("rate"), F.round("place", 6).alias("place")))(chosen(s, d)),
          TOP + ", z AS (SELECT a.t + 1 AS t, list_contains(a.chosen, b.actual) AS hit, nullif(list_position(a.chosen, b.actual), 0) AS place FROM k a LEFT JOIN (SELECT t, actual FROM k) b ON b.t = a.t + 1) SELECT t % 3 AS model, count(*) AS n, count(hit) AS scored, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / nullif(count(hit), 0), 6) AS rate, round(avg(place), 6) AS place FROM z GROUP BY 1")


def experiments(s, d):
    """Users as experiments: mean value of their even and odd events."""
    even = F.col("event_id") % 2 == 0
    return table(s, d, "events").groupBy("user_id", "event_type").agg(F.avg(F.when(even, F.col("value"))).alias("val"), F.avg(F.when(~even, F.col("value"))).alias("live"), F.min("event_id").alias("first"))


_EXP = "WITH x AS (SELECT user_id, event_type, avg(value) FILTER (event_id % 2 = 0) AS val, avg(value) FILTER (event_id % 2 = 1) AS live, min(event_id) AS first FROM events GROUP BY 1, 2)\n"


def _k1(s, d):
    events = table(s, d, "events").select("user_id", "event_id", "event_type")
    old, new = events.where("event_type = 'error'"), events.where("event_type <> 'error'")
    first = old.groupBy("user_id").agg(F.min("event_id").alias("event_id")).withColumn("event_type", F.lit("error"))
    return K.append_new(first, new, "user_id", "event_id")


_register("k1_append_predictions", _k1, """WITH l AS (SELECT user_id, min(event_id) AS event_id, 'error' AS event_type FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT * FROM l UNION ALL SELECT user_id, min(event_id), arg_min(event_type, event_id) FROM events WHERE event_type <> 'error' AND user_id NOT IN (SELECT user_id FROM l WHERE user_id IS NOT NULL) GROUP BY 1""")


def _k3(s, d):
    hits = table(s, d, "events").select(F.col("user_id").alias("id"), (F.col("event_id") % 6).alias("lag"), F.col("value").alias("best"), F.col("event_id").alias("version"))
    return K.upsert_lag_hits(hits.where("version % 2 = 0"), hits.where("version % 2 = 1")).select("id", F.explode("lag_hits").alias("x"), "scored_through").select("id", "x.lag", "x.best", "scored_through")


_register("k3_upsert_lag_hits", _k3, "SELECT id, lag, best, max(lag) OVER (PARTITION BY id) AS scored_through FROM (SELECT user_id AS id, event_id % 6 AS lag, arg_max(value, event_id) AS best FROM events GROUP BY 1, 2)")
_register("k5_recent_results", lambda s, d: table(s, d, "events").where("value is not null").orderBy(F.desc("event_id")).limit(10).select("event_id", "user_id", "value"), "SELECT event_id, user_id, value FROM events WHERE value IS NOT NULL ORDER BY event_id DESC LIMIT 10")
_register("k8_overfit_summary", lambda s, d: (lambda x: x.select("n", *(F.round(c, 6).alias(c) for c in x.columns if c != "n")))(K.overfit_summary(experiments(s, d))),
          _EXP + "SELECT count(*) AS n, round(avg(val), 6) AS val, round(avg(live), 6) AS live, round(min(val - live), 6) AS least, round(max(val - live), 6) AS most, round(avg(CAST(val > live AS INTEGER)), 6) AS positive, round(corr(val, live), 6) AS r FROM x WHERE val IS NOT NULL AND live IS NOT NULL")
_register("k10_val_vs_test", lambda s, d: experiments(s, d).select("user_id", "event_type", F.round(F.col("live") - F.col("val"), 6).alias("delta")).where("delta is not null"), _EXP + "SELECT user_id, event_type, round(live - val, 6) AS delta FROM x WHERE live IS NOT NULL AND val IS NOT NULL")
_register("k12_diverse_topn", lambda s, d: K.diverse_top(experiments(s, d).where("live is not null").select("user_id", "event_type", F.round("live", 6).alias("live")), "event_type", "live", "user_id", 3),
          _EXP + "SELECT user_id, event_type, live FROM (SELECT user_id, event_type, round(live, 6) AS live, row_number() OVER (PARTITION BY event_type ORDER BY round(live, 6) DESC, user_id) AS r FROM x WHERE live IS NOT NULL) WHERE r = 1 ORDER BY live DESC, user_id LIMIT 3")
_register("k13_patch_results", lambda s, d: (lambda e: K.patch(e.select("event_id", "event_type", "value"), e.where("event_type = 'error'").select("event_id", (-F.col("value")).alias("value")), "event_id"))(table(s, d, "events")),
          "SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN coalesce(-value, value) ELSE value END AS value FROM events")
