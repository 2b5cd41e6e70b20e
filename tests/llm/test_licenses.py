"""License scans: the contract's base columns against SQL over the given documents, and verified notices by cases."""

import pathlib
import random
import time

import duckdb
import pytest

from seqlab.llm.license_scan import NOTICES, align, scan_licenses, unbeaten

DATA = "/root/testdata/sf0.001/documents.parquet"
BASE = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
p(phrase, label) AS (VALUES (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')),
f AS (SELECT doc_id, label, i - 1 AS pos FROM w, p, unnest(range(1, len(w) - len(phrase) + 2)) AS x(i) WHERE w[i:i + len(phrase) - 1] = phrase)
SELECT w.doc_id, len(w) AS n_words, count(pos) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (pos IS NOT NULL))), ','), '') AS base_labels
FROM w LEFT JOIN f USING (doc_id) GROUP BY w.doc_id, len(w)
"""


@pytest.mark.skipif(not pathlib.Path(DATA).exists(), reason="the given tables are not here")
def test_base_columns_against_sql(spark):
    got = scan_licenses(spark.read.parquet(DATA)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}'")
    want = con.execute(BASE).fetchall()
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == sorted(want) and any(r.n_base for r in got)


def _labels(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, template string, row int")
    return [r.labels for r in sorted(scan_licenses(df).collect(), key=lambda r: r.doc_id)]


def test_verified_notices(spark):
    whole = [n for n, _ in NOTICES]
    got = _labels(spark, whole)
    assert all(label in found.split(",") for (_, label), found in zip(NOTICES, got))
    cases = [
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
        ("This work is licensed under a Creative Commons Attribution Share Alike 4.0 International License.", "cc-by-sa"),
        ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
        ("This work, as a whole, is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),  # 3 words put in
        ("license international 0 4 attribution commons creative a under licensed is work this", ""),  # out of order
        ("this work is licensed under a creative commons attribution and a great many more words that are no part of it 4 0 international license", ""),
        ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "gpl,lgpl"),  # gpl is the phrase's
        (" ".join([whole[0]] * 3) + " word " * 50_000 + whole[4].upper(), "apache-2.0,mit" if NOTICES[4][1] == "apache-2.0" else "isc,mit" if NOTICES[4][1] == "isc" else "mit"),
    ]
    got = _labels(spark, [t for t, _ in cases])
    assert got[:7] == [w for _, w in cases[:7]] and "mit" in got[7].split(",") and NOTICES[4][1] in got[7].split(",")


def test_repeats_ties_and_nulls(spark):
    df = spark.createDataFrame([(None, "cc by cc by"), (None, "cc by cc by"), (1, "cc"), (1, None)], "doc_id long, text string")
    got = sorted((repr(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.score) for r in scan_licenses(df).collect())
    assert got == sorted([("None", 4, 2, 0, 2, 1.0)] * 2 + [("1", 1, 0, None, None, 0.0), ("1", 0, 0, None, None, 0.0)], key=lambda x: x[:2])


def test_align():
    assert align([(5, 0), (6, 1), (7, 2)], 4, 2, 0.8) == [(5, 8, 4, 1.0)]
    assert align([(5, 0), (7, 1), (8, 2)], 4, 2, 0.8) == [(5, 9, 4, 0.8)]  # one word put in
    assert align([(0, 0), (9, 0)], 2, 2, 1.0) == [(0, 1, 2, 1.0), (9, 10, 2, 1.0)]
    assert align([(0, 2), (1, 1), (2, 0)], 4, 2, 0.8) == []


def test_very_many_places_take_linear_time():
    """A hundred thousand exact places and as many notices, each beaten by an equal one that matches more, or tied."""
    n = 100_000
    began = time.time()
    spans = align([(3 * i, 0) for i in range(n)], 2, 2, 1.0)
    assert len(spans) == n and spans[0] == (0, 1, 2, 1.0)
    many = [(20 * i, 20 * i + 9, 10, 0.9) for i in range(n)] + [(20 * i + 5, 20 * i + 12, 8 if i % 2 else 12, 0.9) for i in range(n)]
    left = unbeaten(many)
    assert left == [i for i in range(n) if i % 2] + [n + i for i in range(n) if not i % 2]
    assert unbeaten([(0, 5, 4, 0.8), (5, 9, 4, 0.8), (10, 12, 3, 0.8)]) == [0, 1, 2]  # ties stay
    assert time.time() - began < 20


def test_overlaps_by_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        spans = [(f, f + rng.randrange(8), rng.randrange(3), rng.randrange(3) / 2) for f in (rng.randrange(40) for _ in range(rng.randrange(15)))]
        want = [i for i, x in enumerate(spans) if not any(y[0] <= x[1] and x[0] <= y[1] and (y[3], y[2]) > (x[3], x[2]) for y in spans)]
        assert unbeaten(spans) == want
