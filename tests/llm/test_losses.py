"""Rows that earlier got lost: odd arrival names, corpora without labels, clashing columns, hubs of components."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from seqlab.llm import bpe, common, language
from seqlab.llm.components import connected_components
from seqlab.llm.sharding import ShardStore


def test_arrivals_of_any_name_can_be_read_back(spark, tmp_path):
    names = ["2024-01-01 10:00:00", "eu west", "x y:z/ü", "50%", "a+b", "{c}[d]*?", "", None, "e=f#g&h"]
    rows = [(i, f"t{i}", names[i % len(names)]) for i in range(36)]
    store = ShardStore(spark, str(tmp_path / "store"))
    store.append(spark.createDataFrame(rows, "id long, text string, name string"), F.col("name"))
    want = sorted(map(str, rows))
    assert sorted(str(tuple(r)) for r in store.read().collect()) == want
    assert sum(r.rows for r in store.manifest().collect()) == len(rows)
    store.compact()
    assert sorted(str(tuple(r)) for r in store.read(run="run").drop("run").collect()) == want


def test_nothing_is_unlike_languages_that_were_not_learned(spark):
    docs = spark.createDataFrame([(i, f"words of text {i}", None) for i in range(5)] + [(9, "123", None), (10, None, None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == {0, 1, 2, 3, 4}
    assert {r.language for r in language.identify(docs, language.train(docs)).collect()} == {"und"}


def test_ids_beside_columns_of_their_names(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.createDataFrame([(1, "some text", 7, "x", None, b"y"), (None, "some text", 7, "x", None, b"y"), (1, None, 7, "x", None, b"y")], "doc_id long, text string, n_tokens int, ids string, Intact boolean, bytes binary")
    got = bpe.encode_checked(docs, path, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids", "Intact", "bytes", "ids_", "n_tokens_", "intact_"]
    assert [(r.doc_id, r.n_tokens, r.ids, r.n_tokens_ > 0, r.intact_) for r in got.collect()] == [(1, 7, "x", True, True), (None, 7, "x", True, True), (1, 7, "x", False, True)]
    back = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN, ids="ids_").collect()
    assert [bytes(r.bytes_) for r in back] == [b"some text", b"some text", b""] and [r.ids for r in back] == ["x"] * 3
    assert bpe.encode_checked(docs.limit(0), path, public_tokenizers.PATTERN).collect() == []


def test_hub_is_joined_by_parts(spark, monkeypatch):
    """A star and a chain whose hub has far more rows than the limit for one task."""
    star = spark.range(1, 6001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    chain = spark.range(7000, 7040).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    salts = []
    real = common.dealt
    monkeypatch.setattr("seqlab.llm.components.dealt", lambda rows, hot, keys, by: salts.append((keys, hot.agg(F.max("_salts")).first()[0])) or real(rows, hot, keys, by))
    got = {r.node: r.component for r in connected_components(star.union(chain)).collect()}
    assert got == {i: 0 for i in range(6001)} | {i: 7000 for i in range(7000, 7041)}
    assert (["v"], 6) in salts and any(k == ["component"] and n == 7 for k, n in salts)
