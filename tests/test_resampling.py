"""Permutation nulls and the two sides of a stream's scores against brute force."""

import hashlib
import math
from collections import Counter

import __spark_entry__ as entry
import numpy as np
from pyspark.sql import functions as F

from seqlab.operators.inference import permuted
from seqlab.operators.resampling import draws_of, permutation_match
from seqlab.streaming.streams import score_then_learn


def _brute(rows, replicates, seed=42):
    rows = sorted(rows)
    observed = sum(g == d for _, g, d in rows) / len(rows)
    stats = []
    for rep in range(1, replicates + 1):
        moved = sorted(rows, key=lambda r: (int(hashlib.md5(f"{seed}:{rep}:{r[0]}".encode()).hexdigest()[:12], 16), r[0]))
        stats.append(sum(a[1] == b[2] for a, b in zip(rows, moved)) / len(rows))
    place = 0.95 * (replicates - 1)
    lo, ordered = int(place), sorted(stats)
    p95 = ordered[lo] + (place - lo) * (ordered[min(lo + 1, replicates - 1)] - ordered[lo])
    return observed, sum(stats) / replicates, p95, (1 + sum(x >= observed for x in stats)) / (replicates + 1)


def _close(row, want):
    return all(abs(a - b) < 1e-6 for a, b in zip((row.observed, row.null_mean, row.null_p95, row.p), want))


def test_permutation_in_ranges(spark):
    rows = [(t * 3, t * 7919 % 10, t * 104729 % 7) for t in range(1, 400)]
    df = spark.createDataFrame(rows, "t long, guess int, d int")
    for chunk in (16, 4096):
        assert _close(permutation_match(df, "guess", "d", "t", 20, chunk=chunk).first(), _brute(rows, 20))


def test_permuted_outcomes_move_packed(spark):
    """No row a replicate and outcome; nulls take a place, but are no match."""
    rows = [(t * 5, None if t % 13 == 0 else t * 7919 % 4, None if t % 11 == 0 else t * 104729 % 3) for t in range(700)]
    made = permutation_match(spark.createDataFrame(rows, "t long, guess int, d int"), "guess", "d", "t", 12, chunk=8)
    assert "explode(sequence(1, 12" not in made._jdf.queryExecution().toString()
    row, stats = made.first(), []
    for rep in range(1, 13):
        moved = sorted(rows, key=lambda r: (int(hashlib.md5(f"42:{rep}:{r[0]}".encode()).hexdigest()[:12], 16), r[0]))
        known = [a[1] == b[2] for a, b in zip(rows, moved) if a[1] is not None and b[2] is not None]
        stats.append(sum(known) / len(known))
    assert abs(row.null_mean - sum(stats) / 12) < 1e-9


def test_draws_of_are_md5():
    t = np.array([0, 5, -3, 99, 123456789, 10**17, -(2**63), 2**63 - 1])
    got = draws_of(42, 101, t, block=3)
    for rep in (1, 9, 10, 99, 100, 101):
        assert got[rep - 1].tolist() == [int(hashlib.md5(f"42:{rep}:{x}".encode()).hexdigest()[:12], 16) for x in t]


def test_no_task_has_a_whole_replicate(spark):
    rows = spark.range(1, 5000).select(F.col("id").alias("t"), (F.col("id") % 7).alias("guess"), (F.col("id") % 5).alias("d"))
    plan = permutation_match(rows, "guess", "d", "t", 3, chunk=64)._jdf.queryExecution().optimizedPlan().toString()
    numbered = [line for line in plan.splitlines() if "Window" in line and "row_number" in line]
    assert numbered and all("range#" in line for line in numbered)


def test_permutation_null_reads_every_draw(spark, tmp_path):
    orders = spark.range(300).select(F.col("id").alias("o_orderkey"), F.lit("1995-01-01").cast("date").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"), F.lit("F").alias("o_orderstatus"), F.col("id").alias("o_custkey"), (F.col("id") * F.col("id") * 37 % 1000).cast("double").alias("o_totalprice"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    d1 = [i * i * 37 % 1000 // 100 for i in range(300)]
    row = entry.queries()["n2_permutation_null_all"](spark, str(tmp_path)).first()
    assert _close(row, _brute([(t, d1[t - 1], d1[t]) for t in range(1, 300)], 100))


def test_replica_with_fixed_batches(spark, tmp_path):
    batches = [["a", "a", "b"], ["b", "c", "a", "b"], ["c"]]
    frozen = {"a": 2, "b": 1}
    put = score_then_learn(spark, str(tmp_path), spark.createDataFrame(list(frozen.items()), "kind string, n long"), "kind", 5)
    known = Counter(frozen)
    for number, batch in enumerate(batches):
        put(spark.createDataFrame([(x,) for x in batch], "kind string"), number)
        row = spark.read.parquet(f"{tmp_path}/scores/batch={number}").first()
        loss = [-sum(math.log((c.get(x, 0) + 1) / (sum(c.values()) + 5)) for x in batch) / len(batch) for c in (frozen, known)]
        assert row.n == len(batch) and abs(row.frozen - loss[0]) < 1e-9 and abs(row.replica - loss[1]) < 1e-9
        known.update(batch)


def test_both_losses_are_returned(spark):
    row = entry.queries()["x6_frozen_and_replica"](spark, "/root/testdata/sf0.001").first()
    assert row.n == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count() and row.frozen > 0 and row.replica > 0


def test_permuted_rows_that_pack_well_are_not_broadcast(spark):
    rows = spark.range(20000).select(F.col("id").alias("i"), F.array(*map(F.lit, range(20))).alias("chosen"), (F.col("id") % 10).alias("actual")).repartition(4).localCheckpoint()
    made = permuted(rows, ["actual"], 2)
    held = made.collect()
    assert len(held) == 40000 and Counter(r.actual for r in held) == dict.fromkeys(range(10), 4000)
    assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()
