"""corpus_pipeline.run, stage by stage, against brute force; language ID by its accuracy on rows it has not seen."""

import pathlib
import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from seqlab.llm import bpe, language
from seqlab.llm.queries import op8_language_id

from test_leaks import brute as leaks
from test_near_duplicates import brute as groups

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, judged string, component int"


def _documents():
    rng = random.Random(4)
    parts = {"aa": "ka lo mi ne to", "bb": "ster ung ein ach"}

    def prose(lang, n):
        return " ".join("".join(rng.choice(parts[lang].split()) for _ in range(rng.randrange(2, 6))) for _ in range(n))

    bench = [(i, prose("aa", 30)) for i in range(5)]
    texts = [(prose(l, rng.randrange(40, 120)), l) for l in ("aa", "bb") for _ in range(60)]
    copies = [texts[0]] * 4 + [(texts[1][0] + " " + prose("aa", 2), None)]  # exact and near copies
    leaked = [(prose("aa", 20) + " " + t + " " + prose("aa", 20), "aa") for _, t in bench]
    odd = [(None, None), ("", "aa"), ("12 34 !", None), ("жук " * 40, None), ("漢字 " * 30, None)]
    rows = [*texts, *copies, *leaked, *odd]
    return [(i if i % 50 != 49 else None, t, l, "s", len(t or ""), "r", "j", 1) for i, (t, l) in enumerate(rows)], bench, len(texts)


def test_run(spark, tmp_path):
    rows, bench, clean = _documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.identify_language(spark, docs, str(tmp_path))
    have = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == docs.columns
    assert sorted(have, key=repr) == sorted(((r[0], r[1]) for r in rows[:-5]), key=repr)  # all prose stays; no letters and unknown scripts go
    _, label = groups(have, 5)
    first = {}
    for (i, t), l in zip(have, label):
        first[l] = min(first.get(l, (True, 0, "")), (i is None, i or 0, t)) if l in first else (i is None, i or 0, t)
    one = sorted(((None if none else i, t) for none, i, t in first.values()), key=repr)
    assert len(one) == len(have) - 5
    leak = {d for d, _ in leaks(list(enumerate(t for _, t in one)), bench)}
    clean_rows = [x for n, x in enumerate(one) if n not in leak]
    assert len(leak) == 5
    path = public_tokenizers.path(corpus_pipeline.VOCABULARY)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(spark, path), special_tokens={})
    want = sorted(((i, known.encode_ordinary(t)) for i, t in clean_rows), key=repr)
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=repr) == want and all(r.intact and r.n_tokens == len(r.ids) for r in got)


def test_no_rows(spark, tmp_path):
    rows, bench, _ = _documents()
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_language_names_and_ties(spark):
    df = spark.createDataFrame([(1, "ka lo mi", "aa", "x", "y", "z"), (2, "ka lo mi", "bb", "x", "y", "z"), (None, "ka lo mi", None, "x", "y", "z")], "doc_id long, text string, lang string, language string, judged string, lettered string")
    model = language.train(df)
    found = language.identify(df, model)
    assert found.columns == ["doc_id", "text", "lang", "judged", "lettered", "language", "confidence", "rejected"]
    assert {r.language for r in found.collect()} == {"aa"} and language.keep_known(df, model).columns == df.columns  # a tie goes to the first


@pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="the given tables are not here")
def test_language_accuracy_on_held_out_rows(spark):
    labels = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    seen = [(labels[r.doc_id], r.lang_pred) for r in op8_language_id(spark, SF).where("held_out").collect() if labels[r.doc_id] is not None and r.lang_pred != "und"]
    right = sum(a == b for a, b in seen) / len(seen)
    print("held-out accuracy", right, len(seen))
    assert len(seen) > 150 and right >= 0.95
