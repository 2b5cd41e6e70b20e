"""Ledgers of predictions and experiments: idempotent inserts, scoring, patches and reports, all as joins by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scores import at_lags, match_levels


def append_new(ledger: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The ledger and those rows of new whose key it lacks; of rows that share a new key the first by order."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    fresh = new.join(ledger.select(key), key, "left_anti").withColumn("_first", first).where("_first = 1").drop("_first")
    return ledger.unionByName(fresh)


def score(ledger: DataFrame, outcomes: DataFrame, key: str = "t") -> DataFrame:
    """Fills actual, hit and place in the chosen list (null if absent); rows without an outcome stay pending (null)."""
    held = ledger.hint("merge").join(outcomes.select(key, "actual").hint("merge"), key, "left")  # lists pack well: their packed size says little
    place = F.nullif(F.array_position("chosen", F.col("actual").cast("int")), F.lit(0).cast("long"))
    return held.withColumn("hit", F.array_contains("chosen", F.col("actual").cast("int"))).withColumn("place", place)


def patch(ledger: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The ledger with the non-null values of updates (one row a key) put over its own."""
    fresh = updates.select(key, *(F.col(c).alias(f"_{c}") for c in updates.columns if c != key))
    joined = ledger.join(fresh, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in updates.columns and c != key else F.col(c) for c in ledger.columns))


def upsert_lag_hits(hits: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (id, lag, best, version) of both, the latest version of each (id, lag), gathered per id in the order of lag."""
    latest = hits.unionByName(new).groupBy("id", "lag").agg(F.max_by("best", "version").alias("best"))
    rows = F.sort_array(F.collect_list(F.struct("lag", "best")))  # at most one row for each lag asked for
    return latest.groupBy("id").agg(rows.alias("lag_hits"), F.max("lag").alias("scored_through"))


def near_hits(ledger: DataFrame, outcomes: DataFrame, lags: range, least: int = 2) -> DataFrame:
    """Every (t, lag) whose outcome lag steps on agrees with a chosen member in least positions or more.

    best is how many, combo the first chosen member with so many, places the positions it agrees in.
    """
    held = at_lags(ledger, outcomes, lags).withColumn("best", match_levels(F.col("chosen"), F.col("actual"))).where(F.col("best") >= least)
    combo = F.filter("chosen", lambda x: match_levels(F.array(x), F.col("actual")) == F.col("best"))[0]
    places = F.concat_ws(",", *(F.when(F.floor(F.col("combo") / s) % 10 == F.floor(F.col("actual") / s) % 10, F.lit(str(i))) for i, s in enumerate((100, 10, 1), 1)))
    return held.withColumn("combo", combo).select("t", "lag", "actual", "best", "combo", places.alias("places"), (F.col("best") == 3).alias("exact"))


def running_stats(scored: DataFrame, by: str) -> DataFrame:
    """Of a scored ledger per model: rows, those scored, hits, hit rate, mean place when hit."""
    hits = F.count_if("hit")
    return scored.groupBy(by).agg(F.count("*").alias("n"), F.count("hit").alias("scored"), hits.alias("hits"), F.try_divide(hits, F.count("hit")).alias("rate"), F.avg("place").alias("place"))


def overfit_summary(experiments: DataFrame) -> DataFrame:
    """Of (val, live): count, means, the gap's extremes, how often it is positive, and their correlation (null if undefined)."""
    rows = experiments.where("val is not null and live is not null").withColumn("gap", F.col("val") - F.col("live"))
    n = F.count("*")
    sx, sy, sxy, sxx, syy = (F.sum(x) for x in ("val", "live", F.col("val") * F.col("live"), F.col("val") * F.col("val"), F.col("live") * F.col("live")))
    r = F.try_divide(n * sxy - sx * sy, F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)))
    return rows.agg(n.alias("n"), F.avg("val").alias("val"), F.avg("live").alias("live"), F.min("gap").alias("least"), F.max("gap").alias("most"), F.avg((F.col("gap") > 0).cast("int")).alias("positive"), r.alias("r"))


def diverse_top(df: DataFrame, fingerprint: str, score_: str, key: str, n: int) -> DataFrame:
    """The n best rows with different fingerprints: of each the best, ties to the smaller key."""
    place = F.row_number().over(Window.partitionBy(fingerprint).orderBy(F.desc(score_), key))
    return df.withColumn("_place", place).where("_place = 1").drop("_place").orderBy(F.desc(score_), key).limit(n)
