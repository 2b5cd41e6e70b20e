"""Leak, chunk and closed-form tests of the series and item operators."""

from pathlib import Path

from pyspark.sql import functions as F

import __spark_entry__ as entry
from seqlab.operators import items as I
from seqlab.operators import series as S
from seqlab.sources import files


def _series(spark, n=300):
    return spark.range(n).select(F.col("id").alias("t"), (F.col("id") * 7919 % 10).cast("int").alias("d"))


def test_chunks_do_not_change_results(spark):
    small = S.rolling_frequency(_series(spark), ["d"], range(10), 20, chunk=32)
    whole = S.rolling_frequency(_series(spark), ["d"], range(10), 20, chunk=10_000)
    assert small.exceptAll(whole).count() == 0 and small.count() == 300


def test_the_future_does_not_leak(spark):
    rows = _series(spark)
    changed = rows.withColumn("d", F.when(F.col("t") >= 150, 9 - F.col("d")).otherwise(F.col("d")))
    a, b = (S.rolling_uniformity(x, ["d"], range(10), 20).where("t <= 150").select("t", "d_chi2", "d_entropy") for x in (rows, changed))
    assert a.exceptAll(b).count() == 0


def test_ordinals_are_dense(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    got = S.with_ordinal(rows, ["k"], partitions=7).collect()
    assert all(r.k == r.t for r in got) and len(got) == 1000


def test_adjusted_p_values(spark):
    rows = spark.createDataFrame([("a", 0.01), ("a", 0.04), ("a", 0.03), ("a", None)], "family string, p double")
    got = sorted((r.p or 9, round(r.p_bh, 6), round(r.p_bonferroni, 6)) for r in I.adjust_p_values(rows, "p", "family").collect())
    assert got == [(0.01, 0.03, 0.03), (0.03, 0.04, 0.09), (0.04, 0.04, 0.12), (9, 1.0, 1.0)]


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_needs_no_session():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries().keys() >= e.oracle_sql().keys()"], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_quotes_of_nested_texts(spark):
    texts = ['{"k": "it\'s"}', "{'k': 'x'}", "{'k': \"it's\"}", "{'k': 'say \"no\"'}", '{"k": "plain"}', "{broken", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.k for r in rows.select("i", files.coerce_nested(F.col("t"), "k string")["k"].alias("k")).collect()}
    assert got == {0: "it's", 1: "x", 2: "it's", 3: 'say "no"', 4: "plain", 5: None, 6: None}
