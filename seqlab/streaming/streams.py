"""Streams of events: windowed counts, sessions, running tallies and rows without repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files_a_batch: int = 4) -> DataFrame:
    """New Parquet files of a folder, some in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def tumbling_counts(events: DataFrame, key: str, size: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def running_stats(events: DataFrame, key: str, value: str) -> DataFrame:
    """Tallies of each key over all that has come."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))


def sessions(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def without_repeats(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicates([*keys, "ts"])


def new_rows(events: DataFrame, keys: list[str], since: str, late: str) -> DataFrame:
    """Rows from a time on, each key once, however often files bring it again within the watermark's delay."""
    return events.where(F.col("ts") >= F.lit(since).cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def hopping_counts(events: DataFrame, key: str, size: str, slide: str, late: str) -> DataFrame:
    """Counts of each key in windows of size every slide: start, key, n."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def drift(counts: DataFrame, key: str, symbols: int) -> DataFrame:
    """Of windowed counts (start, key, n): rows and chi-square against equal shares of the symbols in each window."""
    m = F.sum("n")
    return counts.groupBy("start").agg(m.alias("n"), (F.sum(F.col("n") * F.col("n")) * symbols / m - m).alias("chi2"))


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "update", sink: Callable | None = None) -> None:
    """Runs the stream over all that is there and appends every batch with its number to Parquet; restarts go on from the checkpoint."""

    def put(batch: DataFrame, number: int) -> None:  # a batch that runs again overwrites itself
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(sink or put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Of the batches that drain has written, the last row of each key."""
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in {*keys, "batch"}]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("x")).select(*keys, "x.*")


def last_batch(spark: SparkSession, out: str) -> DataFrame:
    """The rows of the newest batch that drain has written: all there is, in complete mode."""
    rows = spark.read.parquet(out)
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch", "left_semi").drop("batch")


def matched(predictions: DataFrame, outcomes: DataFrame, key: str, within: str, late: str, how: str = "inner") -> DataFrame:
    """Two streams with ts: each prediction (id) with the outcomes (id) of its key that come within so long after it.

    With how="left" a prediction without one comes out as well, once the watermark has passed its time.
    """
    left = predictions.withWatermark("ts", late).select(F.col(key).alias("key"), "id", F.col("ts").alias("made"))
    right = outcomes.withWatermark("ts", late).select(F.col(key).alias("_key"), F.col("id").alias("outcome"), F.col("ts").alias("came"))
    on = (F.col("key") == F.col("_key")) & (F.col("came") > F.col("made")) & (F.col("came") <= F.col("made") + F.expr(f"interval {within}"))
    return left.join(right, on, how).select("key", "id", "outcome", "made")


def last_seen(events: DataFrame, key: str) -> DataFrame:
    """Own state of each key: how often it came and when last; a changed key comes out once in each batch."""
    import pandas as pd

    def step(keys, frames, state):
        n, last = state.get if state.exists else (0, None)
        for frame in frames:
            n, newest = n + len(frame), frame["ts"].max()
            last = newest if last is None or newest > last else last
        state.update((n, last))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "last": [last]})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, "ts").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, last timestamp", "n long, last timestamp", "update", "NoTimeout")


def score_then_learn(spark: SparkSession, base: str, frozen: DataFrame, symbol: str, symbols: int) -> Callable:
    """A sink that scores each batch by add-one shares before it learns from it.

    The frozen side keeps the counts it got (symbol, n); the replica adds the counts of all earlier batches. Every
    batch writes its counts and scores under its number, so a batch that runs again changes nothing.
    """
    pinned = f"{base}/counts/batch=-1"
    frozen.select(F.col(symbol).cast("string").alias("symbol"), F.col("n").cast("long").alias("n")).write.mode("overwrite").parquet(pinned)

    def shares(counts: DataFrame, name: str) -> DataFrame:
        sums = counts.groupBy("symbol").agg(F.sum("n").alias("n"))
        return sums.join(F.broadcast(sums.agg(F.sum("n").alias("m")))).select("symbol", ((F.col("n") + 1) / (F.col("m") + symbols)).alias(name))

    def put(batch: DataFrame, number: int) -> None:
        own = batch.groupBy(F.col(symbol).cast("string").alias("symbol")).agg(F.count("*").alias("n"))
        own.write.mode("overwrite").parquet(f"{base}/counts/batch={number}")
        seen = spark.read.parquet(f"{base}/counts")
        fixed, moving = shares(seen.where("batch = -1"), "f"), shares(seen.where(F.col("batch") < number), "r")
        rows = seen.where(F.col("batch") == number).join(fixed, "symbol", "left").join(moving, "symbol", "left")
        none = {x: seen.where(F.col("batch") < (0 if x == "f" else number)).agg((1 / (F.coalesce(F.sum("n"), F.lit(0)) + symbols)).alias(f"{x}0")) for x in "fr"}
        scored = rows.join(F.broadcast(none["f"])).join(F.broadcast(none["r"]))
        loss = {x: F.sum(-F.col("n") * F.log(F.coalesce(x, f"{x}0"))) / F.sum("n") for x in "fr"}
        scored.agg(F.sum("n").alias("n"), loss["f"].alias("frozen"), loss["r"].alias("replica")).write.mode("overwrite").parquet(f"{base}/scores/batch={number}")

    return put


def _earlier(spark: SparkSession, folder: str, number: int) -> DataFrame | None:
    """What batches before this one have written to a folder of batch=<number> folders; None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
    if not any(n.startswith("batch=") and int(n[6:]) < number for n in names):
        return None
    return spark.read.parquet(folder).where(F.col("batch") < number)


def divert_late(spark: SparkSession, base: str, keys: list[str], late: str) -> Callable:
    """A sink that keeps rows (ts, keys) once, and late rows apart: base/kept and base/late, and base/marks with the newest ts and counts of each batch.

    A row is late if its ts is before the newest ts of all earlier batches by more than late. Rows that are in time are
    kept unless a row of the same keys is kept already; only kept rows that a row in time could repeat are read for
    that, so late bounds the work (a repeat that is further from its first than late counts as another row). Every
    batch writes under its number, so one that runs again changes nothing.
    """

    def put(batch: DataFrame, number: int) -> None:
        marks = _earlier(spark, f"{base}/marks", number)
        newest = marks.agg(F.max("newest").alias("newest")) if marks is not None else spark.createDataFrame([(None,)], "newest timestamp")  # one row
        rows = batch.join(F.broadcast(newest.select((F.col("newest") - F.expr(f"interval {late}")).alias("_low"))))
        behind = F.coalesce(F.col("ts") < F.col("_low"), F.lit(False))
        rows.where(behind).drop("_low").write.mode("overwrite").parquet(f"{base}/late/batch={number}")
        fresh = rows.where(~behind).dropDuplicates(keys)
        kept = _earlier(spark, f"{base}/kept", number)
        if kept is not None:
            recent = kept.join(F.broadcast(newest)).where(F.col("ts") >= F.col("newest") - 2 * F.expr(f"interval {late}"))
            fresh = fresh.join(recent.select(*keys), keys, "left_anti")
        fresh.drop("_low").write.mode("overwrite").parquet(f"{base}/kept/batch={number}")
        sums = [spark.read.parquet(f"{base}/{name}/batch={number}").agg(F.count("*").alias(name)) for name in ("kept", "late")]
        batch.agg(F.max("ts").alias("newest")).join(sums[0]).join(sums[1]).write.mode("overwrite").parquet(f"{base}/marks/batch={number}")

    return put


def replay_pool(spark: SparkSession, base: str, id_: str, newest: int = 64, earlier: int = 64) -> Callable:
    """A sink that holds what a learner replays: the newest rows (by ts and id), and of all rows before these the ones with the smallest hashes.

    base/pool/batch=<number> is the pool after a batch, with is_newest. A uniform sample by smallest hashes can be
    merged: a row that is out of it once never comes back, so the pool before and the batch tell the pool after. A batch
    that runs again starts from the pool before it.
    """

    def put(batch: DataFrame, number: int) -> None:
        before = _earlier(spark, f"{base}/pool", number)
        rows = batch
        if before is not None:
            last = before.agg(F.max("batch").alias("batch"))  # one row
            rows = before.join(F.broadcast(last), "batch", "left_semi").drop("batch", "is_newest").unionByName(batch)
        top = rows.orderBy(F.desc("ts"), F.desc(id_)).limit(newest)
        rest = rows.join(F.broadcast(top.select(id_)), id_, "left_anti").orderBy(F.md5(F.col(id_).cast("string")), id_).limit(earlier)  # both bounded by the pool's size
        pool = top.withColumn("is_newest", F.lit(True)).unionByName(rest.withColumn("is_newest", F.lit(False)))
        pool.coalesce(1).write.mode("overwrite").parquet(f"{base}/pool/batch={number}")

    return put
