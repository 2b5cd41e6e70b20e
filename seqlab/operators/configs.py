"""Configurations of experiments as nested rows: (id, val, live, models array<struct<kind, depth>>), their rules and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scalars import fingerprint


def as_configs(events: DataFrame, models: int = 4) -> DataFrame:
    """Users as experiments: mean value of their even and odd events, and their first events as models.

    Only a user's first events are gathered, so rows stay small.
    """
    even = F.col("event_id") % 2 == 0
    means = events.groupBy(F.col("user_id").alias("id")).agg(F.avg(F.when(even, F.col("value"))).alias("val"), F.avg(F.when(~even, F.col("value"))).alias("live"))
    first = events.withColumn("_r", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where(F.col("_r") <= models)
    model = F.struct("_r", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("depth"))
    lists = first.groupBy(F.col("user_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(model)), lambda m: F.struct(m["kind"].alias("kind"), m["depth"].alias("depth"))).alias("models"))
    return means.join(lists, "id")


def _best(configs: DataFrame, score: str, n: int) -> DataFrame:
    return configs.where(F.col(score).isNotNull()).orderBy(F.round(score, 9).desc(), "id").limit(n)


def pattern_counts(configs: DataFrame, n: int) -> DataFrame:
    """How often each set of model kinds is among the n best by live, by val, and by both."""
    marked = configs.select("id", fingerprint(F.transform("models", lambda m: m["kind"])).alias("pattern"))
    live, val = (F.broadcast(_best(configs, c, n).select("id", F.lit(1).alias(f"_{c}"))) for c in ("live", "val"))
    held = marked.join(live, "id", "left").join(val, "id", "left").where("_live is not null or _val is not null")
    return held.groupBy("pattern").agg(F.count("_live").alias("by_live"), F.count("_val").alias("by_val"), F.count_if(F.col("_live").isNotNull() & F.col("_val").isNotNull()).alias("in_both"))


def hyperparameters(configs: DataFrame, n: int, candidates: int = 5) -> DataFrame:
    """The models of the n best by live, one a row; the first few experiments are candidates for an ensemble."""
    best = _best(configs, "live", n).withColumn("rank", F.row_number().over(Window.orderBy(F.round("live", 9).desc(), "id")))  # n rows
    each = best.select("rank", "id", F.posexplode("models").alias("place", "model"))
    return each.select("rank", "id", "place", "model.kind", "model.depth", (F.col("rank") <= candidates).alias("candidate"))


def violations(configs: DataFrame, depths: tuple[int, int], most_models: int) -> DataFrame:
    """id, field, problem: one row for each rule that a configuration breaks."""
    lo, hi = depths
    kinds = F.transform("models", lambda m: m["kind"])

    def found(wrong, field, problem):
        return F.when(wrong, F.struct(F.lit(field).alias("field"), F.lit(problem).alias("problem")))

    rules = F.array(
        found(F.size("models") > most_models, "models", f"over {most_models} models"),
        found(F.size(F.array_distinct(kinds)) < F.size(kinds), "models", "repeated kind"),
        found(F.exists("models", lambda m: (m["depth"] < lo) | (m["depth"] > hi)), "depth", f"outside {lo} to {hi}"),
    )
    return configs.select("id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("x")).select("id", "x.*")
