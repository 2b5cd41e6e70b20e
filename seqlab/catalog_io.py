"""Queries of file sources and streams over copies that Spark writes of the given tables, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .bindings import table
from .sources import files
from .storage import shared_folder
from .streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _new(s, name: str) -> str:
    return f"{shared_folder(s)}/seqlab-{name}-{uuid.uuid4().hex}"


def _register(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def _s1(s, d):
    path, day = _new(s, "csv"), F.col("o_orderdate")
    table(s, d, "orders").select("o_orderkey", F.month(day), F.dayofmonth(day), F.year(day), F.concat(F.lit(" "), "o_orderstatus")).write.csv(path)
    rows = files.read_positional_csv(s, path, ["id", "month", "day", "year", "status"])
    made = F.to_date(F.concat_ws("-", "year", F.lpad("month", 2, "0"), F.lpad("day", 2, "0")))
    return rows.select(F.col("id").cast("long").alias("id"), made.cast("string").alias("day"), "status")


_register("s1_positional_csv", _s1, "SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderstatus AS status FROM orders")


def _s3(s, d):
    path = _new(s, "lines")
    line = F.when(F.col("o_orderkey") % 7 == 0, F.lit("bad,line")).otherwise(F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus", F.lit("x")))
    table(s, d, "orders").select(line.alias("value")).write.text(path)
    return files.read_tolerant_lines(s, path, 4).select(F.expr("try_cast(parts[0] as bigint)").alias("id"), F.expr("try_cast(parts[1] as bigint)").alias("customer")).where("id is not null")


_register("s3_tolerant_lines", _s3, "SELECT o_orderkey AS id, o_custkey AS customer FROM orders WHERE o_orderkey % 7 <> 0")


def _s4(s, d):
    path = _new(s, "jsonl")
    whole = F.to_json(F.struct("event_id", "event_type"))
    table(s, d, "events").select(F.when(F.col("event_id") % 5 == 0, F.substring(whole, 1, 12)).otherwise(whole).alias("value")).write.text(path)
    return files.read_json_lines(s, path, "event_id long, event_type string")


_register("s4_jsonl", _s4, "SELECT event_id, event_type FROM events WHERE event_id % 5 <> 0")


def _s8(s, d):
    path = _new(s, "groups")
    split = F.when(F.col("o_orderkey") % 10 < 7, "train").when(F.col("o_orderkey") % 10 < 9, "val").otherwise("test")
    files.write_groups(table(s, d, "orders").withColumn("split", split), path, "split")
    return files.read_groups(s, path, "split", "val", ["o_orderkey", "o_cust"])


_register("s7_s8_feature_cache", _s8, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 10 BETWEEN 7 AND 8")


def _streamed(make, keys, mode="update"):
    def query(s, d):
        base, rows = _new(s, "stream"), table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
        rows.repartitionByRange(8, "ts").write.parquet(f"{base}/in")
        stream = streams.event_stream(s, f"{base}/in", rows.schema)
        streams.drain(make(stream), f"{base}/out", f"{base}/checkpoint", mode)
        out = streams.latest(s, f"{base}/out", keys)
        return out.select(*(F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in out.dtypes))

    return query


LATE = "90 days"  # files come in any order, and nothing may be too late
_register("x3_stream_tumbling_counts", _streamed(lambda e: streams.tumbling_counts(e, "event_type", "1 day", LATE), ["start", "event_type"]),
          "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
_register("x5_stream_running_stats", _streamed(lambda e: streams.running_stats(e, "user_id", "value"), ["user_id"]), "SELECT user_id, count(*) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
_register("x8_stream_dedupe", _streamed(lambda e: streams.without_repeats(e.unionByName(e).select("event_id", "ts", "user_id"), ["event_id"], LATE), ["event_id"], "append"), "SELECT DISTINCT event_id, ts, user_id FROM events")


_register("x1_stream_draws", _streamed(lambda e: streams.new_rows(e.unionByName(e).select("event_id", "ts", "user_id"), ["event_id"], "2024-01-03", LATE), ["event_id"], "append"), "SELECT event_id, ts, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-03'")
_hops = _streamed(lambda e: streams.hopping_counts(e, "event_type", "1 day", "6 hours", LATE), ["start", "event_type"])
_register("x3_stream_hopping_drift", lambda s, d: streams.drift(_hops(s, d), "event_type", 5).withColumn("chi2", F.round("chi2", 6)),
          "WITH h AS (SELECT date_trunc('day', ts) + to_hours(CAST(6 * (hour(ts) // 6 - k) AS BIGINT)) AS start, event_type FROM events, range(4) q(k)), n AS (SELECT start, event_type, count(*) AS n FROM h GROUP BY 1, 2) SELECT start, CAST(sum(n) AS BIGINT) AS n, round(sum(n * n) * 5 / sum(n) - sum(n), 6) AS chi2 FROM n GROUP BY start")


def _events(s, d, name):
    """A folder of events and a stream of it."""
    base, rows = _new(s, name), table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    rows.repartitionByRange(8, "ts").write.parquet(f"{base}/in")
    return base, lambda: streams.event_stream(s, f"{base}/in", rows.schema)


def _x2(s, d):
    base, stream = _events(s, d, "matched")
    pairs = streams.matched(stream().where("event_type = 'view'"), stream().where("event_type = 'click'"), "user_id", "6 hours", LATE)
    streams.drain(pairs, f"{base}/out", f"{base}/checkpoint", "append")
    return s.read.parquet(f"{base}/out").select("key", "id", "outcome")


_register("x2_stream_score", _x2, "SELECT a.user_id AS key, a.event_id AS id, b.event_id AS outcome FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR")


def _x2_pending(s, d):
    """Every view with its clicks within 6 hours, and those that got none once the watermark has passed them: two rows far ahead move it."""
    base, rows = _new(s, "pending"), table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    ahead = rows.agg((F.max("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts")).select(F.lit(-1).cast(rows.schema["id"].dataType).alias("id"), "ts", F.lit(-1).cast(rows.schema["user_id"].dataType).alias("user_id"), F.explode(F.array(F.lit("view"), F.lit("click"))).alias("event_type"))
    rows.unionByName(ahead).write.parquet(f"{base}/in")
    stream = lambda kind: streams.event_stream(s, f"{base}/in", rows.schema, 10_000).where(F.col("event_type") == kind)
    streams.drain(streams.matched(stream("view"), stream("click"), "user_id", "6 hours", LATE, "left"), f"{base}/out", f"{base}/checkpoint", "append")
    return s.read.parquet(f"{base}/out").where("key <> -1").select("key", "id", "outcome")


_register("x2_stream_pending", _x2_pending, "SELECT a.user_id AS key, a.event_id AS id, b.event_id AS outcome FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'click' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'view'")


def _x4(s, d):
    base, stream = _events(s, d, "seen")
    streams.drain(streams.last_seen(stream(), "user_id"), f"{base}/out", f"{base}/checkpoint")
    return streams.latest(s, f"{base}/out", ["user_id"]).select("user_id", "n", F.col("last").cast("timestamp_ntz").alias("last"))


_register("x4_stream_last_seen", _x4, "SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY 1")


def _both_losses(s, d):
    """n, frozen, replica: mean losses over all batches of a stream of events."""
    base, stream = _events(s, d, "replica")
    frozen = table(s, d, "events").where("event_id % 10 = 0").groupBy("event_type").agg(F.count("*").alias("n"))
    streams.drain(stream(), "", f"{base}/checkpoint", sink=streams.score_then_learn(s, base, frozen, "event_type", 5))
    mean = [F.round(F.sum(F.col("n") * F.col(x)) / F.sum("n"), 6).alias(x) for x in ("frozen", "replica")]
    return s.read.parquet(f"{base}/scores").agg(F.sum("n").alias("n"), *mean)


#: The replica's loss depends on how the stream was cut into batches, which SQL can't say.
_register("x6_frozen_and_replica", _both_losses)
_register("x6_frozen_vs_replica", lambda s, d: _both_losses(s, d).drop("replica"), """WITH f AS (SELECT event_type, count(*) AS n FROM events WHERE event_id % 10 = 0 GROUP BY 1)
SELECT count(*) AS n, round(avg(-ln((coalesce(f.n, 0) + 1) / ((SELECT sum(n) FROM f) + 5))), 6) AS frozen FROM events LEFT JOIN f USING (event_type)""")


def _x8_late(s, d):
    """Events in order, and then some of the old ones again: repeats within two days are dropped, later ones are kept apart."""
    base, rows = _new(s, "late"), table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    sink, stream = streams.divert_late(s, base, ["event_id"], "2 days"), lambda: streams.event_stream(s, f"{base}/in", rows.schema, 10_000)
    for part in (rows, rows.where("event_id % 50 = 0")):
        part.write.mode("append").parquet(f"{base}/in")
        streams.drain(stream(), "", f"{base}/checkpoint", "append", sink)
    both = s.read.parquet(f"{base}/kept").select("event_id", F.lit("kept").alias("kind")).unionByName(s.read.parquet(f"{base}/late").select("event_id", F.lit("late").alias("kind")))
    return both


_register("x8_late_rows", _x8_late, "SELECT event_id, 'kept' AS kind FROM events UNION ALL SELECT event_id, 'late' FROM events WHERE event_id % 50 = 0 AND ts < (SELECT max(ts) FROM events) - INTERVAL 2 DAY")


def _x6_pool(s, d):
    base, stream = _events(s, d, "pool")
    streams.drain(stream(), "", f"{base}/checkpoint", "append", streams.replay_pool(s, base, "id"))
    return streams.last_batch(s, f"{base}/pool").select("id", "event_type", "is_newest")


_register("x6_replay_pool", _x6_pool, "WITH n AS (SELECT event_id AS id, event_type, row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 64 AS is_newest FROM events), e AS (SELECT *, row_number() OVER (PARTITION BY is_newest ORDER BY md5(CAST(id AS VARCHAR)), id) AS r FROM n) SELECT id, event_type, is_newest FROM e WHERE is_newest OR r <= 64")


def _x7(s, d):
    base, stream = _events(s, d, "sessions")
    streams.drain(streams.sessions(stream(), "user_id", "30 minutes", LATE), f"{base}/out", f"{base}/checkpoint", "complete")
    return streams.last_batch(s, f"{base}/out").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


_register("x7_stream_sessions", _x7, "WITH x AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 30 MINUTE, TRUE) AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT user_id, ts, sum(CAST(o AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, k")


def _s2(s, d):
    path = _new(s, "header")
    table(s, d, "orders").select(F.when(F.col("o_orderkey") % 11 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), "o_orderkey", F.col("o_totalprice").cast("long").alias("price")).write.csv(path, header=True)
    return files.read_header_csv(s, path, "date date, o_orderkey long, price long", "date")


_register("s2_header_csv", _s2, "SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS price FROM orders WHERE o_orderkey % 11 > 0")
_register("s5_coerce_nested", lambda s, d: table(s, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.replace("props", F.lit('"'), F.lit("'"))).alias("p")).select("event_id", files.coerce_nested(F.col("p"), "k string")["k"].alias("k")),
          "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
