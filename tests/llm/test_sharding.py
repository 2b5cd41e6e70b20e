"""The shard store: changed schemas, clashing names, empty tables and racing writers."""

import threading
from datetime import date

import pytest
from pyspark.sql import functions as F

from seqlab.llm.sharding import ShardStore, VersionTaken


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_schemas_of_runs_are_merged(spark, tmp_path):
    for turn in range(4):  # run names are drawn: whichever comes first, no column may be lost
        store = ShardStore(spark, f"file://{tmp_path}/{turn}", fan_in=2)
        store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
        store.append(spark.createDataFrame([(2, "b", 0.5)], "doc_id long, text string, extra double"))
        store.compact()
        assert _rows(store.read()) == ["Row(doc_id=1, text='a', extra=None)", "Row(doc_id=2, text='b', extra=0.5)"]
        assert store.manifest().count() == 1
    last = store.version()
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("x",)], "doc_id string"))
    assert store.version() == last


def test_clashing_names_nulls_and_types(spark, tmp_path):
    df = spark.createDataFrame([(1, "r", 2, None, date(2020, 1, 2)), (1, "r", 2, None, date(2020, 1, 2)), (None, None, None, None, None)], "arrival long, run string, tier int, text string, day date")
    store = ShardStore(spark, f"file://{tmp_path}/s", fan_in=2)
    store.append(df, F.col("arrival"))
    store.append(df)
    store.compact()
    assert _rows(store.read()) == _rows(df.union(df)) and store.read().columns == df.columns
    named = store.read(1, run="_run", tier="_tier")
    assert named.count() == 3 and named.select("_run").distinct().count() == 2 and named.where("_tier is null").count() == 0
    with pytest.raises(ValueError):
        store.read(run="run")


def test_empty_table(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    with pytest.raises(ValueError):
        store.read()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert store.append(empty, F.col("doc_id") % 8) == 1 and store.compact() == 1
    assert store.read(run="r", tier="t").collect() == [] and store.read().columns == ["doc_id", "text"]
    store.append(spark.createDataFrame([(1, "x" * 100_000)], "doc_id long, text string"))
    assert store.read().first().text == "x" * 100_000


def test_racing_writers(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", fan_in=100)
    store.append(spark.range(1))
    schema, runs = store._load(1)
    took, at = [], threading.Barrier(8)

    def write(i):
        at.wait()
        try:
            store.commit(schema, runs, 2)
            took.append(i)
        except VersionTaken:
            pass

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(took) == 1 and store.version() == 2
    appends = [threading.Thread(target=lambda: ShardStore(spark, store.root).append(spark.range(10))) for _ in range(3)]
    [t.start() for t in appends], [t.join() for t in appends]
    assert store.version() == 5 and store.read().count() == 31


def test_vacuum(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", fan_in=2)
    for _ in range(3):
        store.append(spark.range(5), F.col("id") % 2)
    store.compact()
    before = _rows(store.read())
    assert store.vacuum(older_than_seconds=3600) and store.versions() == [store.version()]
    store.vacuum(older_than_seconds=0)
    assert _rows(store.read()) == before
