"""Sinks of streams: late rows apart, repeats once, a pool to replay, and batches that run again."""

import datetime
import hashlib
import random

from seqlab.streaming import streams

SCHEMA = "id long, ts timestamp, value string"
START = datetime.datetime(2024, 1, 1)


def _rows(spark, rows):
    return spark.createDataFrame([(i, START + datetime.timedelta(hours=h), f"v{i}") for i, h in rows], SCHEMA)


def _ids(spark, path):
    return sorted(r.id for r in spark.read.parquet(path).collect())


def test_late_rows_are_kept_apart_and_counted(spark, tmp_path):
    base = str(tmp_path)
    sink = streams.divert_late(spark, base, ["id"], "10 hours")
    first, second, third = [(1, 0), (2, 5), (2, 5), (3, 20)], [(2, 5), (3, 20), (4, 11), (5, 9), (6, 30)], [(7, 19), (8, 21), (6, 30), (1, 0)]
    for number, rows in enumerate((first, second, third, [])):
        sink(_rows(spark, rows), number)
        sink(_rows(spark, rows), number)  # runs again after a loss
    # newest: 20 after the first batch, 30 after the second; before 10 and then before 20 is late
    assert _ids(spark, f"{base}/kept") == [1, 2, 3, 4, 6, 8]
    assert _ids(spark, f"{base}/late") == [1, 2, 5, 7]
    marks = {r.batch: (r.kept, r.late) for r in spark.read.parquet(f"{base}/marks").collect()}
    assert marks == {0: (3, 0), 1: (2, 2), 2: (1, 2), 3: (0, 0)}


def test_late_rows_of_a_stream(spark, tmp_path):
    base = str(tmp_path)
    for rows in ([(k, k) for k in range(40)], [(100, 3), (41, 38), (39, 39)]):
        _rows(spark, rows).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = streams.event_stream(spark, f"{base}/in", SCHEMA, 100)
        streams.drain(stream, "", f"{base}/checkpoint", "append", streams.divert_late(spark, base, ["id"], "1 day"))
    assert _ids(spark, f"{base}/late") == [100] and _ids(spark, f"{base}/kept") == [*range(40), 41]


def test_replay_pool(spark, tmp_path):
    rng, base = random.Random(3), str(tmp_path)
    rows = [(i, rng.randrange(200)) for i in range(120)]
    sink = streams.replay_pool(spark, base, "id", newest=10, earlier=15)
    for number in range(4):
        part = rows[30 * number : 30 * number + 30]
        sink(_rows(spark, part), number)
        sink(_rows(spark, part), number)
        seen = sorted(rows[: 30 * number + 30], key=lambda r: (r[1], r[0]), reverse=True)
        want = {(i, True) for i, _ in seen[:10]} | {(i, False) for i, _ in sorted(seen[10:], key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest())[:15]}
        assert {(r.id, r.is_newest) for r in spark.read.parquet(f"{base}/pool/batch={number}").collect()} == want
