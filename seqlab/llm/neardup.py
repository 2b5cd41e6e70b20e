"""Near-duplicates by circulant MinHash.

A document is the set of its word shingles (hashed to 64 bits). Two permutations serve for the whole signature: the
first spreads the shingles over 2^32 places; coordinate j is the least value that the second gives to these places
after a circular shift by j. Documents with equal sets form a class, and only classes go on. Bands of coordinates
put classes into buckets.

Links are confirmed on full sets, in two rounds. Each bucket's pivot is the class with the smallest share of shingles
that no other class has, as an original has among its edited copies. First each class is held against the pivot that
it shares most bands with, and the confirmed links are joined to components. Then every pair of bucket mates that is
still in two components is held against each other, save those that cannot reach the threshold, by size or because
too many of their shingles occur in no other class. What is in one component already needs no more links, so a group
of n near copies costs about n comparisons, not n squared.

Nodes are numbers of classes, not document ids, so rows that share an id, or have none, keep their own texts' links.
Keys with very many rows (a bucket of look-alikes, a text with very many copies) are split by a salt, and repeated
rows are dropped where they are read.

Edge cases: null, empty and wordless texts have no shingles and link with nothing; fewer words than a shingle are one
shingle, the whole sequence; repeated rows are equal sets and share a component; a row with a null id belongs to the
component of its text; component_id is the smallest id of the component, null if none of its rows has an id; rows of
one id with different texts are judged apart; other columns are not read. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, VISIBLE, Words, bounded_batches, dealt, fmix32, fmix64, hot_keys, materialize, repeated, thinned, words_of
from .components import connected_components

ALPHABETS = {"visible": VISIBLE, "alnum": ALNUM}
#: A text with a word of the alphabet.
WORDY = {"visible": r"[^\x20\x09-\x0D]", "alnum": r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"}
ROW = ["text_hash", "doc_hash"]
CLASS = ["print_a", "print_b", "n_shingles"]


def _hashes() -> list[Column]:
    """What tells rows apart: hashes of text and id."""
    return [F.xxhash64("text").alias("text_hash"), F.xxhash64("doc_id").alias("doc_hash")]


def _prints(s: np.ndarray) -> tuple[int, int]:
    """Two sums of hashes that equal sets share."""
    return int(fmix64(s).sum(dtype=np.uint64).astype(np.int64)), int(fmix64(s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64))


def _sets(w: Words, k: int) -> Iterator[np.ndarray]:
    """Per document the sorted distinct shingles."""
    counts = w.counts
    grams, at = w.grams(k)
    cut = np.searchsorted(at, w.first)
    short = {d: w.grams(int(counts[d])) for d in np.flatnonzero((counts > 0) & (counts < k)).tolist()} if (counts < k).any() else {}
    for d in range(len(counts)):
        if d in short:
            g, places = short[d]
            yield g[np.searchsorted(places, w.first[d])][None]
        else:
            yield np.unique(grams[cut[d] : cut[d + 1]])


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: size coordinates from two permutations of 32-bit places."""
    places = (fmix64(shingles) >> np.uint64(32)).astype(np.uint32)  # the first permutation, and the place
    shifts = np.arange(size, dtype=np.uint32)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(places), 256):
        np.minimum(out, fmix32(places[i : i + 256, None] + shifts).min(0), out=out)
    return out


def _sketches(k: int, bands: int, rows: int, alphabet: str):
    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *ROW, "n_shingles", "print_a", "print_b", "bands"]
        for batch in batches:
            n, a, b, keys = [], [], [], []
            for w in words_of(batch.column("text"), ALPHABETS[alphabet]):
                for s in _sets(w, k):
                    n.append(len(s))
                    if len(s):
                        of_a, of_b = _prints(s)
                        a.append(of_a), b.append(of_b)
                        parts = signature(s, bands * rows).reshape(bands, rows).astype(np.uint64)
                        key = np.arange(bands, dtype=np.uint64)
                        for j in range(rows):
                            key = fmix64(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, j])
                        keys.append(key.view(np.int64))
                    else:
                        a.append(None), b.append(None), keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", *ROW)), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names
            )

    return sketch


def _shingle_arrays(k: int, alphabet: str):
    def arrays(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch.column("text"), ALPHABETS[alphabet]):  # a bounded run of texts at a time
                part, sets = batch.slice(w.lo, w.hi - w.lo), list(_sets(w, k))
                wanted = zip(part.column("print_a").to_pylist(), part.column("print_b").to_pylist())
                right = np.flatnonzero([_prints(s) == x for s, x in zip(sets, wanted)])  # hashes of texts may clash
                kept = pa.array([sets[i].view(np.int64) for i in right], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("cid").take(pa.array(right)), part.column("n_shingles").take(pa.array(right)), kept], ["cid", "n_shingles", "shingles"])

    return arrays


def _reaches(both: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether sets of these sizes with so many common shingles reach the threshold."""
    return both * 100 >= (n_a + n_b - both) * percent


class NearDuplicates:
    """The steps of near-duplicate detection over docs (doc_id, text)."""

    def __init__(self, docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 24, rows: int = 4, alphabet: str = "visible"):
        self.k, self.percent, self.alphabet = k, percent, alphabet
        bounded_batches(docs.sparkSession)
        self.docs = docs.select("doc_id", *_hashes(), "text")
        id_type = docs.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {id_type}, text_hash long, doc_hash long, n_shingles long, print_a long, print_b long, bands array<long>"
        self.sketch = materialize(self.docs.mapInArrow(_sketches(k, bands, rows, alphabet), schema), "sketch")
        self.total = self.sketch.count()
        classes = self.sketch.where("n_shingles > 0").groupBy(*CLASS)
        classes = classes.agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.first(F.struct(*ROW)).alias("row"), F.first("bands").alias("bands"))
        #: A class has a number, how many rows it has, its smallest id, and one of its rows.
        self.classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    def buckets(self) -> DataFrame:
        """cid, n_shingles, key, _salt of each class in each bucket that others share."""
        keyed = self.classes.select("cid", "n_shingles", F.explode("bands").alias("key"))
        mates = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "mates")
        self.hot = hot_keys(mates, ["key"], mates.agg(F.sum("n")).first()[0] or 0)
        return materialize(dealt(keyed, self.hot, ["key"], "cid").join(self._of_key(mates.select("key")), ["key", "_salt"]), "buckets")

    def _of_key(self, facts: DataFrame) -> DataFrame:
        """Facts of buckets, to be joined to their classes on key and _salt."""
        return repeated(facts, self.hot, ["key"])

    def components(self) -> DataFrame:
        """cid, component of each class with a link to another."""
        buckets = self.buckets()
        sets = self._sets_of(buckets.select("cid").distinct())
        buckets = materialize(buckets.join(self._common(sets), "cid"), "buckets")
        alone = 1 - F.col("common") / F.col("n_shingles")
        pivots = buckets.groupBy("key").agg(F.min_by("cid", F.struct(alone, "cid")).alias("pivot"))
        votes = buckets.join(self._of_key(pivots), ["key", "_salt"]).where("cid <> pivot").groupBy("cid", "pivot").agg(F.count("*").alias("votes"))
        first = votes.groupBy("cid").agg(F.min_by("pivot", F.struct(-F.col("votes"), F.col("pivot"))).alias("pivot"))
        held = materialize(self._compared(first.select(F.col("cid").alias("a"), F.col("pivot").alias("b")), sets), "links")
        links = held.where("linked").select("a", "b")
        joined = connected_components(links).select(F.col("node").alias("cid"), "component")
        inside = held.select(F.col("a").alias("cid"), F.col("b").alias("pivot"), F.col("both").alias("inside"))
        more = materialize(self._compared(self._open_pairs(buckets, joined, inside), sets).where("linked").select("a", "b"), "links")
        self.links = links.union(more)
        if more.isEmpty():
            return joined
        return connected_components(self.links).select(F.col("node").alias("cid"), "component")

    def _common(self, sets: DataFrame) -> DataFrame:
        """cid, common: how many of a class's shingles some other class in a bucket has too."""
        single = sets.select("cid", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("cid").alias("cid")).where("n = 1")
        alone = single.groupBy("cid").agg(F.count("*").alias("alone"))
        return sets.select("cid", "n_shingles").join(alone, "cid", "left").select("cid", (F.col("n_shingles") - F.coalesce("alone", F.lit(0))).alias("common"))

    def _sets_of(self, cids: DataFrame) -> DataFrame:
        """cid, n_shingles, shingles of these classes, from the text of one row of each."""
        wanted = self.classes.join(cids, "cid", "left_semi").select("cid", *CLASS, "row.*")
        copied = hot_keys(self.classes.select("row.text_hash", F.col("copies").alias("n")), ["text_hash"], self.total).groupBy("text_hash").agg(F.max("_salts").alias("_salts"))
        once = self.docs.drop("doc_id")
        if not copied.isEmpty():
            held = once.join(F.broadcast(copied), "text_hash", "left")
            once = held.where("_salts is null").drop("_salts").unionByName(held.where("_salts is not null").groupBy(*ROW).agg(F.first("text").alias("text")))
        of_class = [c for c in wanted.columns if c not in ROW]
        texts = once.join(wanted, ROW).groupBy(*ROW).agg(*(F.first(c).alias(c) for c in (*of_class, "text")))
        return materialize(texts.mapInArrow(_shingle_arrays(self.k, self.alphabet), "cid long, n_shingles long, shingles array<long>"), "sets")

    def _compared(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """a, b, both (common shingles of the full sets), linked of these pairs.

        The sets of b, a pivot of very many, are joined by parts of it.
        """
        pairs = materialize(pairs, "pairs")
        counts = materialize(pairs.groupBy("b").agg(F.count("*").alias("n")), "partners")
        hot = hot_keys(counts, ["b"], counts.agg(F.sum("n")).first()[0] or 0)
        of_b = sets.select(F.col("cid").alias("b"), F.col("n_shingles").alias("n_b"), F.col("shingles").alias("set_b"))
        of_a = sets.select(F.col("cid").alias("a"), F.col("n_shingles").alias("n_a"), F.col("shingles").alias("set_a"))
        held = dealt(pairs, hot, ["b"], "a").join(of_a, "a").join(repeated(of_b, hot, ["b"]), ["b", "_salt"]).withColumn("both", F.size(F.array_intersect("set_a", "set_b")).cast("long"))
        return held.select("a", "b", "both", _reaches(F.col("both"), F.col("n_a"), F.col("n_b"), self.percent).alias("linked"))

    def _open_pairs(self, buckets: DataFrame, joined: DataFrame, inside: DataFrame) -> DataFrame:
        """The pairs of bucket mates in two components that may still reach the threshold.

        Two classes have at most as many shingles in common as the lesser of them shares with any class; held against
        one pivot, at most the lesser count inside the pivot and the lesser of what they share outside it.
        """
        placed = buckets.join(joined, "cid", "left").withColumn("component", F.coalesce("component", "cid")).join(inside, "cid", "left")
        placed = placed.join(self.classes.select("cid", "bands"), "cid")
        several = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        common = materialize(placed.join(self._of_key(several), ["key", "_salt"], "left_semi"), "open")
        # within a bucket only those outside the component with the most classes look for links, and those look at all
        sizes = common.groupBy("key", "component").agg(F.count("*").alias("n"))
        largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
        best = common.groupBy("key").agg(F.max("common").alias("most"), F.min("n_shingles").alias("least"))
        facing = common.join(self._of_key(largest.join(best, "key")), ["key", "_salt"])
        own = F.least("common", "most")
        out = facing.where("component <> largest").where(own * 100 >= (F.col("n_shingles") + F.greatest(F.col("least"), own) - own) * self.percent)
        out = materialize(out, "out")
        facts = ["cid", "component", "n_shingles", "common", "pivot", "inside", "bands"]
        left = out.select("key", "_salt", "largest", *(F.col(c).alias(f"{c}_a") for c in facts))
        faced = common.join(self._of_key(out.select("key").distinct()), ["key", "_salt"], "left_semi").drop("_salt")
        right = self._of_key(faced).select("key", "_salt", *(F.col(c).alias(f"{c}_b") for c in facts))
        # two that both look meet once, with the smaller as a; what a pivot was held against is known
        once = (F.col("component_b") == F.col("largest")) | (F.col("cid_a") < F.col("cid_b"))
        known = F.col("pivot_a").eqNullSafe(F.col("cid_b")) | F.col("pivot_b").eqNullSafe(F.col("cid_a"))
        most = F.least("common_a", "common_b")
        split = F.least("inside_a", "inside_b") + F.least(F.col("common_a") - F.col("inside_a"), F.col("common_b") - F.col("inside_b"))
        bound = F.when(F.col("pivot_a") == F.col("pivot_b"), F.least(most, split)).otherwise(most)
        may = _reaches(bound, F.col("n_shingles_a"), F.col("n_shingles_b"), self.percent)
        here = F.try_element_at(F.array_intersect("bands_a", "bands_b"), F.lit(1)) == F.col("key")  # in their first common bucket
        pairs = left.join(right, ["key", "_salt"]).where((F.col("component_a") != F.col("component_b")) & once & ~known & may & here)
        return pairs.select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"))

    def assigned(self) -> DataFrame:
        """doc_id, text_hash, doc_hash, n_shingles, component (a class's number; null without shingles), component_id of each row of docs."""
        joined = self.classes.select("cid", "copies", "rep", *CLASS).join(self.components(), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        joined = materialize(joined, "joined")
        ids = materialize(joined.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")), "ids")
        hot = hot_keys(ids, ["component"], self.total)
        of_class = dealt(joined, hot, ["component"], "cid").join(repeated(ids.drop("n"), hot, ["component"]), ["component", "_salt"])
        of_class = of_class.select(*CLASS, F.col("copies").alias("n"), "component", "component_id")
        copied = hot_keys(joined.select(*CLASS, F.col("copies").alias("n")), CLASS, self.total)
        some, none = self.sketch.drop("bands").where("n_shingles > 0"), self.sketch.where("n_shingles = 0")
        held = dealt(some, copied, CLASS, F.monotonically_increasing_id()).join(repeated(of_class.drop("n"), copied, CLASS), [*CLASS, "_salt"])
        columns = ["doc_id", *ROW, "n_shingles"]
        return held.select(*columns, "component", "component_id").unionByName(none.select(*columns, F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id")))

    def per_document(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept of each row of docs."""
        return self.assigned().select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest id reachable by links), kept (doc_id = component_id)."""
    return NearDuplicates(docs, **options).per_document()


def keep_one(docs: DataFrame, alphabet: str = "visible", **options) -> DataFrame:
    """The rows of docs, with all their columns, that stay when one row of each component is kept.

    It is the one with the smallest id, any of its repeats; with no id in a component, any of its rows. Rows without a
    word are in no component and stay.
    """
    found = NearDuplicates(docs, alphabet=alphabet, **options)
    per_row = found.assigned().where("component is not null").groupBy("component", *ROW).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    kept = materialize(per_row.groupBy("component").agg(F.min_by(F.struct(*ROW, "n"), first).alias("x")).select("x.*"), "kept")
    rows = thinned(docs.select(F.struct("*").alias("row"), *_hashes()), hot_keys(kept, ROW, found.total), ROW)
    one = rows.join(kept, ROW).groupBy(*ROW).agg(F.first("row").alias("row")).select("row.*")
    return one.unionByName(docs.where(~F.coalesce(F.col("text").rlike(WORDY[alphabet]), F.lit(False))))
