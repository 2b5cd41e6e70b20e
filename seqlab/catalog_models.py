"""Queries of learned models. What a fit gives is not SQL's; tests hold these against closed forms and chance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .bindings import ITEMS, draws, items, steps, table
from .catalog_relations import _r
from .operators import items as I
from .operators import learned as M
from .operators import scores as L
from .operators import series as S
from .operators import spectrum as X
from .operators import survival as V
from .plans import runs as R
from .storage import pinned

QUERIES: dict = {}
SQL: dict[str, str] = {}
DIGITS = ["d1", "d2", "d3"]
FEATURES = [f"d1_{v}" for v in range(10)] + ["prev_sum", "prev_distinct", "prev_odd", "prev_high"]


def _register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def featured(s, d):
    """Causal features of draws as vectors (t, x, y), fitted rows (the first 70 of 100) and the others."""
    rows = S.previous_shape(S.rolling_frequency(draws(s, d), ["d1"], range(10), 50), DIGITS)
    out, cut = pinned(M.vectors(rows, FEATURES, "d1", ["t"])), int(0.7 * steps(s, d))
    return out.where(F.col("t") < cut), out.where(F.col("t") >= cut)


def _scores(kind):
    def query(s, d):
        train, rows = featured(s, d)
        return M.symbol_scores(train, rows, kind, len(FEATURES), 10).select("t", F.posexplode("p").alias("symbol", "p"))

    return query


_register("p7_naive_bayes", _scores("bayes"))
_register("p9_tree_scores", _scores("forest"))
_register("p10_boosted_scores", _scores("boosted"))
_register("p11_logistic_scores", _scores("logistic"))
_register("p11_mlp_scores", _scores("perceptron"))


def _p16(s, d):
    train, rows = featured(s, d)
    kept = M.select_by_importance(train, len(FEATURES))
    train, rows = M.slice_vectors(train, kept), M.slice_vectors(rows, kept)
    parts = [M.symbol_scores(train, rows, kind, len(kept), 10) for kind in ("forest", "logistic")]
    return M.mean_scores(parts, [2.0, 1.0], "t").select("t", F.posexplode("p").alias("symbol", "p"))


_register("p16_run_config", _p16)


_SETS = {"shares": FEATURES[:10], "shape": FEATURES[10:]}


def _experiments(s, d):
    """Each user's events as a configuration in JSON: sets, stages by their numbers and models by their types."""
    k, kinds = F.get_json_object("props", "$.k").cast("int"), F.array(*map(F.lit, ("forest", "logistic", "bayes")))
    first = table(s, d, "events").withColumn("_r", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("_r <= 3")
    pick = lambda options, by=k: F.element_at(options, F.pmod(by, F.lit(3)).cast("int") + 1)
    stages = F.array(F.lit("select"), F.lit("poly"), F.lit("scale"))
    params = F.when(pick(stages) == "poly", F.create_map(F.lit("degree"), F.lit(2.0), F.lit("top_k"), (k + 1).cast("double"))).when(pick(stages) == "select", F.create_map(F.lit("threshold"), 0.5 + k / 40.0))
    rows = first.select("user_id", "_r", F.struct(pick(stages).alias("stage"), F.lit("robust").alias("method"), params.alias("params")).alias("stage"), F.struct(pick(kinds, F.crc32("event_type")).alias("type"), ((k + 1) / 10.0).alias("weight")).alias("model"))
    lists = rows.groupBy("user_id").agg(*(F.array_sort(F.collect_list(F.struct("_r", c)), lambda a, b: a["_r"] - b["_r"]).alias(c) for c in ("stage", "model")))
    config = F.struct(F.col("user_id").cast("string").alias("id"), F.array(F.lit("shares"), F.lit("shape")).alias("feature_sets"), F.col("stage.stage").alias("pipeline"), F.col("model.model").alias("models"))
    return R.read_configs(lists.select(F.to_json(config).alias("config")))


_RULES = R.Rules(tuple(_SETS))


def _p16_configs(s, d):
    """The first valid configuration of the users', run on the features of draws."""
    configs = pinned(_experiments(s, d))
    able = configs.join(R.problems(configs, _RULES).select("id").distinct(), "id", "left_anti").orderBy(F.col("id").cast("long")).first()
    rows, cut = pinned(S.previous_shape(S.rolling_frequency(draws(s, d), ["d1"], range(10), 50), DIGITS).select("t", "d1", *FEATURES)), int(0.7 * steps(s, d))
    return R.run_config(able, rows.where(F.col("t") < cut), rows.where(F.col("t") >= cut), _SETS, "d1", 10).select("t", F.posexplode("p").alias("symbol", "p"))


_register("p16_configured_run", _p16_configs)
_register("p17_all_rules", lambda s, d: R.problems(_experiments(s, d), _RULES))


PROPERTIES = {"large": "d1 + d2 + d3 >= 14", "repeat": "d1 = d2 or d2 = d3 or d1 = d3", "odd": "d1 % 2 + d2 % 2 + d3 % 2 >= 2", "high": "int(d1 >= 5) + int(d2 >= 5) + int(d3 >= 5) >= 2", "first_odd": "d1 % 2 = 1", "last_high": "d3 >= 5"}


def _p8(s, d):
    rows = S.previous_shape(S.rolling_frequency(draws(s, d), ["d1"], range(10), 50), DIGITS).withColumns({k: F.expr(e).cast("int") for k, e in PROPERTIES.items()})
    out, cut = pinned(M.vectors(rows, FEATURES, "d1", ["t", "c", *PROPERTIES])), int(0.7 * steps(s, d))
    table = [(int(a + b + c >= 14), int(len({a, b, c}) < 3), int(a % 2 + b % 2 + c % 2 >= 2), int((a >= 5) + (b >= 5) + (c >= 5) >= 2), a % 2, int(c >= 5)) for a in range(10) for b in range(10) for c in range(10)]
    scored = M.property_intersection(out.where(F.col("t") < cut), out.where(F.col("t") >= cut), list(PROPERTIES), table)
    return scored.select("t", L.rank_of(F.col("p"), F.col("c")).alias("rank"), F.element_at("p", F.col("c").cast("int") + 1).alias("own"))


_register("p8_property_intersection", _p8)


def _e3(s, d):
    train, _ = featured(s, d)
    kept = M.select_by_importance(train, len(FEATURES))
    return M.slice_vectors(train, kept).select("t", F.array_join(F.array(*(F.lit(FEATURES[i]) for i in kept)), ",").alias("kept"))


_register("e3_select_by_importance", _e3)


def _e8(s, d):
    train, rows = featured(s, d)
    scored = M.symbol_scores(train, rows, "logistic", len(FEATURES), 10).select("t", F.col("p")[0].alias("score"), (F.col("y") == 0).cast("double").alias("label"))
    return M.calibrate_isotonic(scored.where("t % 2 = 0"), scored.where("t % 2 = 1"), "score", "label").select("t", "score", "calibrated")


_register("e8_calibrate_isotonic", _e8)


def _e8_all(s, d):
    train, rows = featured(s, d)
    scored = pinned(M.symbol_scores(train, rows, "logistic", len(FEATURES), 10).select("t", "p", "y"))
    done = M.calibrate_all(scored.where("t % 2 = 0"), scored.where("t % 2 = 1"), "p", "y", 10)
    return done.select("t", F.posexplode("calibrated").alias("symbol", "p")).withColumn("p", F.round("p", 9))


_register("e8_calibrate_all", _e8_all)
_register("p13_forest_auc", lambda s, d: M.forest_auc(featured(s, d)[0], len(FEATURES), 10).withColumn("auc", F.round("auc", 9)))


def _p13(s, d):
    train, _ = featured(s, d)
    return s.createDataFrame([(M.forest_cv(train),)], "r2 double")  # one number


_register("p13_forest_cv", _p13)


def _f17(s, d):
    rows = draws(s, d).select("t", F.explode(F.array(*DIGITS)).alias("v")).groupBy("t").agg(*(F.count_if(F.col("v") == k).alias(f"n{k}") for k in range(10)))
    return M.components(M.vectors(rows, [f"n{k}" for k in range(10)], "t", ["t"]), 5, 10)


_register("f17_pca", _f17)
_register("v5_aft_survival", lambda s, d: M.survival_quantiles(I.spells(items(s, d), steps(s, d)).withColumn("odd", F.col("item") % 2), ["item", "odd"]).select("item", "start", "duration", "event", "expected"))


def _v10(s, d):
    return M.discrete_hawkes(items(s, d), steps(s, d), 25, strength=0.1)


_register("v10_hawkes_discrete", lambda s, d: _v10(s, d).select("b", F.round("baseline", 6).alias("baseline"), F.posexplode("alpha").alias("a", "alpha")).select("b", "baseline", (F.col("a") + 1).alias("a"), F.round("alpha", 6).alias("alpha")))
_register("v11_hawkes_pairs", lambda s, d: V.top_excitation(_v10(s, d).select("b", F.posexplode("alpha").alias("a", "alpha")).select((F.col("a") + 1).alias("a"), "b", F.round("alpha", 6).alias("alpha")), 20))
_Q1 = "WITH " + ITEMS + """, p AS (SELECT item, k, round(sqrt(sum(cos(2 * 3.141592653589793 * ((k * t) % steps) / steps)) ** 2 + sum(sin(2 * 3.141592653589793 * ((k * t) % steps) / steps)) ** 2), 6) AS power FROM items, st, range(1, (SELECT (steps + 1) // 2 FROM st)) q(k) GROUP BY item, k),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY power DESC, k) AS place FROM p), y AS (SELECT r.*, CAST(round(steps / k) AS INTEGER) AS period, steps FROM r, st WHERE place <= 3) SELECT item, CAST(place AS INTEGER) AS place, CAST(k AS INTEGER) AS k, CASE WHEN period > 2 AND period < steps / 2 THEN period END AS period, round(power, 4) AS power FROM y"""
_register("q1_periodogram", lambda s, d: _r(X.periodogram(items(s, d), steps(s, d)), "power", digits=4), _Q1)
_register("q1_shared_periods", lambda s, d: X.shared_periods(X.periodogram(items(s, d), steps(s, d))), "SELECT period, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT period, item FROM (" + _Q1 + ") WHERE period IS NOT NULL) GROUP BY period")

