"""License scans by diagonal voting.

Every rolling gram of k words of every text is hashed and looked up among the grams of the templates; the hits are
joined to the template positions, and each hit votes for the diagonal (word in the text minus word in the template)
it lies on. Neighbouring diagonals of one template are merged. A merged span is verified by aligning its words with the
template in order: its score is the template words that match, as words and not only as hashes, over the template's
words and those put in between, and it counts from the coverage on. Where spans of several notices overlap, only those
that no other beats by score, or by length at equal scores, keep their label; so a licence isn't taken for another one
of which it has most words.

Edge cases: a null or empty text has no words and no spans; repeated rows are judged row by row; rows with a null id
keep it; other columns, whatever their names, are neither read nor returned; no rows give no rows. Texts of any length
are read whole. Of two notices of one score and length at one place both labels stay.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM, Lookup, bounded_batches, gram_hash, words_of

#: The phrases whose exact places are counted, with their labels.
PHRASES = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]
#: Notices that may be worn or edited, with their labels.
NOTICES = [
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under the gnu lesser general public license version 3", "lgpl-3.0"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", "agpl"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa"),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution share alike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution non commercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noderivatives 4 0 international license", "cc-by-nd"),
    ("this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", "cc-by-nc-sa"),
    ("this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", "cc-by-nc-nd"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work has been identified as being free of known restrictions under copyright law", "public-domain"),
]


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per template gram: template, label, exact, length, k, tpos, gram, hash. Phrases are exact; notices need 80 %."""
    rows = []
    for t, (text, label, exact) in enumerate([(*p, True) for p in phrases] + [(*n, False) for n in notices]):
        words = text.split()
        k = min(len(words), 2 if exact or len(words) < 9 else 3)
        for i in range(len(words) - k + 1):
            gram = words[i : i + k]
            rows.append((t, label, exact, len(words), k, i, " ".join(gram), int(np.uint64(gram_hash(gram)).astype(np.int64))))
    return spark.createDataFrame(rows, "template int, label string, exact boolean, length int, k int, tpos int, gram string, hash long")


def _hits(keys: dict[int, Lookup]):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int64()), ("gram", pa.string())]))
        for batch in batches:
            counts, hits = [], [[] for _ in range(batch.num_rows)]
            for w in words_of(batch.column("text"), ALNUM):
                counts.append(w.counts)
                for k, known in keys.items():
                    grams, at = w.grams(k)
                    found = known(grams)
                    places = at[found]
                    docs = np.searchsorted(w.first, places, "right") - 1
                    for g, i, d in zip(grams[found].view(np.int64).tolist(), places.tolist(), docs.tolist()):
                        hits[w.lo + d].append({"hash": g, "pos": i - int(w.first[d]), "gram": w.text(i, k)})
            n = np.concatenate(counts).astype(np.int64) if counts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(n), pa.array(hits, kind)], ["row", "doc_id", "n_words", "hits"]
            )

    return scan


def license_spans(docs: DataFrame, grams: DataFrame | None = None, slack: int = 2, coverage: float = 0.8) -> DataFrame:
    """Per row of docs (doc_id, text) and verified span: row, doc_id, n_words, template, label, exact, first_word, last_word, matched, score.

    A row without spans comes once, with nulls from template on. grams: see templates(); it is small and broadcast.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    grams = grams if grams is not None else templates(spark)
    keys = {k: Lookup(np.array(v, np.int64).view(np.uint64)) for k, v in _by_k(grams).items()}
    id_type = docs.schema["doc_id"].dataType.simpleString()
    scanned = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
        _hits(keys), f"row long, doc_id {id_type}, n_words long, hits array<struct<hash:long,pos:long,gram:string>>"
    )
    votes = (
        scanned.repartition("row")
        .select("row", "doc_id", "n_words", F.explode_outer("hits").alias("hit"))
        .select("row", "doc_id", "n_words", F.col("hit.hash").alias("hash"), F.col("hit.pos").alias("pos"), F.col("hit.gram").alias("gram"))
        .join(F.broadcast(grams), ["hash", "gram"], "left")
        .withColumn("diagonal", F.col("pos") - F.col("tpos"))
    )
    keep = ["row", "doc_id", "n_words", "template", "label", "exact", "length", "k"]
    diagonals = votes.groupBy(*keep, "diagonal").agg(F.collect_set(F.struct("pos", "tpos")).alias("at"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.when(F.col("exact"), F.lit(0)).otherwise(F.lit(slack))
    merged = (
        diagonals.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(along) > apart).cast("int"))
        .withColumn("span", F.sum(F.coalesce("new", F.lit(1))).over(along))
        .groupBy(*keep, "span")
        .agg(F.flatten(F.collect_list("at")).alias("at"))
    )
    merged = merged.withColumn("found", _aligned(coverage)("at", "length", "k", "exact"))
    named = F.transform("found", lambda x: F.struct("template", "label", "exact", *(x[c].alias(c) for c in SPAN)))
    rows = merged.groupBy("row", "doc_id", "n_words").agg(F.flatten(F.collect_list(named)).alias("spans"))

    loose = F.filter("spans", lambda x: ~x["exact"])
    rows = rows.withColumn("loose", loose).withColumn("left", _best_of()(F.transform("loose", lambda x: F.struct(*(x[c].alias(c) for c in SPAN)))))
    left = F.concat(F.filter("spans", lambda x: x["exact"]), F.transform("left", lambda i: F.get("loose", i)))
    return rows.select("row", "doc_id", "n_words", F.explode_outer(left).alias("x")).select("row", "doc_id", "n_words", "x.*")


def align(hits: list[tuple[int, int]], length: int, k: int, coverage: float) -> list[tuple[int, int, int, float]]:
    """(first word, last word, matched, score) of disjoint spans in which hits (pos, tpos) of k words follow the template in order.

    The score is matched / (length + inserted). A span that reaches the coverage has at most length / coverage words, so
    hits farther apart than that are never of one span.
    """
    hits, far = sorted(hits), length / coverage
    best: list[tuple[float, int, int, int]] = []  # per hit: score, matched, inserted, first word of the best chain that ends in it
    lo = 0
    for i, (pos, tpos) in enumerate(hits):
        while hits[lo][0] < pos - far:
            lo += 1
        chain = (k / length, k, 0, pos)
        for j in range(lo, i):
            apos, atpos = hits[j]
            step, tstep = pos - apos, tpos - atpos
            if step > 0 and tstep > 0 and not (step < k and step != tstep):
                _, matched, inserted, first = best[j]
                matched, inserted = matched + min(k, step, tstep), inserted + max(0, step - tstep)
                chain = max(chain, (matched / (length + inserted), matched, inserted, first), key=lambda x: (x[0], x[1], x[3]))
        best.append(chain)
    out: list[tuple[int, int, int, float]] = []  # disjoint, in order
    for score, i in sorted(((b[0], i) for i, b in enumerate(best) if b[0] >= coverage), key=lambda x: (-x[0], x[1])):
        first, last = best[i][3], hits[i][0] + k - 1
        place = bisect_left(out, (first,))
        if (place == len(out) or last < out[place][0]) and (not place or out[place - 1][1] < first):
            out.insert(place, (first, last, best[i][1], score))
    return out


def unbeaten(spans: list[tuple[int, int, int, float]]) -> list[int]:
    """The places of spans (first word, last word, matched, score) that no overlapping one beats by score, then by words matched.

    Spans of a template are disjoint and as short as it is, so only the few that begin near a span can overlap it.
    """
    order = sorted(range(len(spans)), key=lambda i: spans[i])
    firsts = [spans[i][0] for i in order]
    longest = max((s[1] - s[0] for s in spans), default=0)
    out = []
    for i, (first, last, matched, score) in enumerate(spans):
        near = order[bisect_left(firsts, first - longest) : bisect_right(firsts, last)]
        if not any(spans[j][1] >= first and (spans[j][3], spans[j][2]) > (score, matched) for j in near):
            out.append(i)
    return out


def _best_of():
    @F.pandas_udf("array<int>")
    def left(spans: pd.Series) -> pd.Series:
        return pd.Series([unbeaten([tuple(x[c] for c in SPAN) for x in row]) if row is not None and len(row) else [] for row in spans])

    return left


#: What a verified span is told by.
SPAN = ["first_word", "last_word", "matched", "score"]


def _aligned(coverage: float):
    @F.pandas_udf("array<struct<first_word:bigint,last_word:bigint,matched:bigint,score:double>>")
    def spans(at: pd.Series, length: pd.Series, k: pd.Series, exact: pd.Series) -> pd.Series:
        out = []
        for hits, n, words, whole in zip(at, length, k, exact):  # no length: a row without hits
            found = [] if pd.isna(n) else align([(x["pos"], x["tpos"]) for x in hits], int(n), int(words), 1.0 if whole else coverage)
            out.append([dict(zip(SPAN, x)) for x in found])
        return pd.Series(out)

    return spans


def _by_k(grams: DataFrame) -> dict[int, list[int]]:
    """The template hashes, a list that does not depend on the data."""
    out: dict[int, list[int]] = {}
    for k, h in grams.select("k", "hash").distinct().collect():
        out.setdefault(k, []).append(h)
    return out


def scan_licenses(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the exact phrases' places; first_word and last_word are the smallest and largest start among them
    (null if none); labels also has those of the notices; score is the best span's (0 if nothing was found).
    """
    exact = F.col("exact")

    def labels(which):
        return F.array_join(F.array_sort(F.collect_set(which)), ",")

    return (
        license_spans(docs, **options)
        .groupBy("row", "doc_id", "n_words")
        .agg(
            F.count(F.when(exact, 1)).alias("n_base"),
            F.min(F.when(exact, F.col("first_word"))).alias("first_word"),
            F.max(F.when(exact, F.col("first_word"))).alias("last_word"),
            labels(F.when(exact, F.col("label"))).alias("base_labels"),
            labels(F.col("label")).alias("labels"),
            F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
