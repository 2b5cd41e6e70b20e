"""Importance resampling of documents towards a target, by hashed runs of one and two words.

Every feature of a document (a word, or two words with a space between) falls into one of 10,000 buckets by its CRC-32.
A bucket's gain is the log ratio of its smoothed shares in the target and in the documents, in thousandths, rounded
down. A document's weight is the mean gain of its features, rounded down.

The sums are bit-sliced: the counts of a document's buckets become planes of 10,000 bits (plane i holds bit i of every
count; words of a plane without a bit are left out), the gains become planes in two's complement. A document's sum is
the sum over pairs of planes of 2^(i + j) times the bits that both have, with the sign of the gain plane, in integers.

Documents are drawn without replacement by the largest weight plus a Gumbel number that hashes their id (Gumbel top-k).
The draw is one order over all rows: it is dealt out by ranges, and only the sizes of the ranges meet.

Edge cases: null and empty texts have no features and weight 0, and can't be drawn, as they have too few words; no
documents give no rows; with no target all t are 0; equal scores go to the smaller id, null ids (which hash as an empty
string) last; repeated rows are rows of their own; other columns are ignored. Two passes read the texts, each in
bounded runs of whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.series import with_ordinal
from .common import ALNUM, Words, bounded_batches, materialize, words_of

BUCKETS = 10_000
#: 64-bit words of a plane.
SPAN = -(-BUCKETS // 64)
#: Bytes of a word that are read side by side with other words; the rest of longer words is read alone.
TOGETHER = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _read(words: Words, data: np.ndarray, which: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The CRC-32 register after the bytes of the words which, from the register state; all words advance byte by byte together."""
    start, length = words.start[which], words.end[which] - words.start[which]
    order = np.argsort(-np.minimum(length, TOGETHER), kind="stable")
    start, lengths, crc = start[order], length[order], state[order]
    live = len(order) - np.cumsum(np.bincount(np.minimum(lengths, TOGETHER), minlength=TOGETHER + 1))
    for j in range(TOGETHER):  # live[j] words have more than j bytes, and come first
        n = live[j]
        if not n:
            break
        crc[:n] = _CRC[(crc[:n] ^ data[start[:n] + j]) & 255] ^ (crc[:n] >> 8)
    for i in np.flatnonzero(lengths > TOGETHER):
        rest = data[start[i] + TOGETHER : start[i] + lengths[i]]
        crc[i] = ~np.uint32(zlib.crc32(rest, int(~crc[i])))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Document (from 0) and bucket of each feature of a run of documents."""
    data = words.alphabet.to[words.data]
    owner, n = words.owner(), len(words.hash)
    every = np.arange(n)
    one = _read(words, data, every, np.full(n, 0xFFFFFFFF, np.uint32))
    first = np.flatnonzero(owner[1:] == owner[:-1])
    spaced = _CRC[(one[first] ^ np.uint32(32)) & 255] ^ (one[first] >> 8)
    two = _read(words, data, first + 1, spaced)
    return np.concatenate([owner, owner[first]]), (~np.concatenate([one, two]) % np.uint32(BUCKETS)).astype(np.int64)


class GainPlanes:
    """Signed numbers of all buckets as planes of bits in two's complement."""

    def __init__(self, gains: np.ndarray):
        gains = np.asarray(gains, np.int64)
        bits = max(int(np.abs(gains).max(initial=0)).bit_length() + 1, 2)
        padded = np.zeros((bits, SPAN * 64), np.uint8)
        padded[:, : len(gains)] = (gains[None, :] >> np.arange(bits)[:, None]) & 1
        self.planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")
        self.values = [1 << j for j in range(bits - 1)] + [-(1 << (bits - 1))]

    def sums(self, owner: np.ndarray, bucket: np.ndarray, docs: int) -> np.ndarray:
        """Per document the sum of the gains of its features."""
        total = np.zeros(docs, np.int64)
        cell, times = np.unique(owner * BUCKETS + bucket, return_counts=True)
        doc, bucket = cell // BUCKETS, cell % BUCKETS
        word, bit = doc * SPAN + bucket // 64, np.uint64(1) << (bucket % 64).astype(np.uint64)
        for i in range(int(times.max(initial=0)).bit_length()):
            have = np.flatnonzero((times >> i) & 1)
            first = np.flatnonzero(np.diff(word[have], prepend=-1))
            if not len(first):
                continue
            plane, at = np.bitwise_or.reduceat(bit[have], first), word[have][first]
            of, place = at // SPAN, at % SPAN
            for gain, value in zip(self.planes, self.values):
                common = np.bincount(of, np.bitwise_count(plane & gain[place]), docs)
                total += common.astype(np.int64) * (value << i)
        return total


def bucket_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """How many features of all texts fall into each bucket: bucket, n; summed in the tasks before they move."""
    bounded_batches(docs.sparkSession)

    def count(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for w in words_of(batch.column(0), ALNUM):
                total += np.bincount(features(w)[1], minlength=BUCKETS)
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(total[have], pa.int64())], ["bucket", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Per bucket its gain: floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))), for s of S features of docs and t of T of target."""
    source = materialize(bucket_counts(docs), "source").select("bucket", F.col("n").alias("s"))
    wanted = materialize(bucket_counts(target), "target").select("bucket", F.col("n").alias("t"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    sums = source.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s")).crossJoin(wanted.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("all_t")))  # one row each
    held = every.join(source, "bucket", "left").join(wanted, "bucket", "left").na.fill(0).crossJoin(F.broadcast(sums))
    b = F.lit(float(BUCKETS))
    ratio = (F.col("t") + F.lit(1.0)) * (F.col("all_s") + b) / ((F.col("s") + F.lit(1.0)) * (F.col("all_t") + b))
    return held.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))


def weigh(docs: DataFrame, gained: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features, weight (the mean gain of the features, rounded down; 0 without features) of each row of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    table = np.zeros(BUCKETS, np.int64)
    for row in gained.collect():  # one row per bucket
        table[row["bucket"]] = row["gain"]
    planes = spark.sparkContext.broadcast(GainPlanes(table))

    def weights(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch.column("text"), ALNUM):
                size = w.hi - w.lo
                owner, bucket = features(w)
                n = np.bincount(owner, minlength=size)
                weight = planes.value.sums(owner, bucket, size) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(w.lo, size), pa.array(w.counts, pa.int64()), pa.array(n, pa.int64()), pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(weights, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """A Gumbel number in thousandths, rounded down, from the hash of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def draw(weighed: DataFrame, percent: int, least_words: int = 20, seed: int = 7) -> DataFrame:
    """Adds score and rank: of the N rows with at least least_words words the floor(percent * N / 100) highest scores are ranked from 1."""
    scored = materialize(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    wanted = able.count() * percent // 100
    placed = with_ordinal(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()], "rank")
    drawn = placed.withColumn("rank", F.when(F.col("rank") < wanted, F.col("rank") + 1))
    return drawn.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs (doc_id, text), drawn towards target (text)."""
    return draw(weigh(docs, materialize(gains(docs, target), "gains")), percent, least_words, seed)
