"""Shared helpers: where tables are cut from their lineage, and numpy views of Arrow text."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; an own one only where it is unset and Spark runs in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-seqlab-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/seqlab-{name}-{uuid.uuid4().hex}"


def free_name(name: str, taken: list[str], mark: str = "_") -> str:
    """name, with as many marks after it as it takes to clash with no column."""
    have = {x.lower() for x in taken}
    while name.lower() in have:
        name += mark
    return name


def clear_scratch(spark: SparkSession, older_than_seconds: float = 0) -> int:
    """Removes the tables that operators wrote to the shared folder (results that are still read depend on them). How many."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    before = (time.time() - older_than_seconds) * 1000
    old = [x.getPath() for x in fs.listStatus(path) if x.getPath().getName().startswith("seqlab-") and x.getModificationTime() <= before]
    for x in old:
        fs.delete(x, True)
    return len(old)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: later uses don't recompute, and a lost executor loses nothing."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_keys(counts: DataFrame, keys: list[str], total: int, most: int = 20_000, least: int = 1000) -> DataFrame:
    """keys, _salts of the keys of counts (keys, n) that have too many of all rows for one task, and into how many parts they go.

    A hot key has over total / most rows, so there are fewer than most of them, and the table may be broadcast.
    """
    limit = max(least, -(-total // most))
    return counts.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("_salts"))


def dealt(rows: DataFrame, hot: DataFrame, keys: list[str], by: str | Column) -> DataFrame:
    """rows with _salt: the part of its key that a row belongs to, by the hash of a column; 0 for keys that are not hot."""
    held = rows.join(F.broadcast(hot), keys, "left")
    return held.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")


def repeated(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """rows once for each part of their key, to be joined on keys and _salt to what dealt() gives."""
    held = rows.join(F.broadcast(hot), keys, "left")
    return held.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))).drop("_salts")


def thinned(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """rows, of those with a hot key one of each: repeats are dropped in the task that reads them, before they move."""
    if hot.isEmpty():
        return rows
    rest = [c for c in rows.columns if c not in keys]
    held = rows.join(F.broadcast(hot), keys, "left")
    one = held.where("_salts is not null").groupBy(*keys).agg(F.first(F.struct(*rest)).alias("_row")).select(*keys, "_row.*")
    return held.where("_salts is null").drop("_salts").unionByName(one)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hands texts to Python in batches of at most so many rows, so that a batch of long texts stays small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


#: Odd multipliers and shifts of the usual 64-bit finalizer.
_M1, _M2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def fmix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers."""
    x = x ^ (x >> _S)
    x *= _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


def fmix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


_inverse = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 16), base)
        x[0] = 1
        have = _powers[name] = np.multiply.accumulate(x)
    return have[:n]


class Alphabet:
    """Which bytes make words, and what each is taken as. UTF-8 bytes from 0x80 always belong to words."""

    def __init__(self, inside: np.ndarray, lower: bool = True):
        self.inside = inside
        self.to = np.arange(256, dtype=np.uint8)
        if lower:
            self.to[65:91] += 32
        self.hash = _BYTES[self.to]


_codes = np.arange(256)
#: Letters A-Z, digits and all above ASCII.
ALNUM = Alphabet((_codes >= 128) | ((_codes >= 48) & (_codes <= 57)) | ((_codes >= 65) & (_codes <= 90)) | ((_codes >= 97) & (_codes <= 122)))
#: All but ASCII white space.
VISIBLE = Alphabet(~((_codes == 32) | ((_codes >= 9) & (_codes <= 13))))
#: ASCII letters and all above ASCII.
LETTERS = Alphabet((_codes >= 128) | ((_codes >= 65) & (_codes <= 90)) | ((_codes >= 97) & (_codes <= 122)))


@dataclass
class Words:
    """The words of documents lo..hi of a batch: hash, first and last byte (in data), and where each document's begin."""

    lo: int
    hi: int
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray
    alphabet: Alphabet

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The document (from 0) of each word."""
        return np.repeat(np.arange(self.hi - self.lo), self.counts)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words inside a document, and the word each begins with."""
        if k > 1:
            sums = np.zeros(max(0, len(self.hash) - k + 1), np.uint64)
            for j in range(k):
                sums = sums * _GRAM + self.hash[j : j + len(sums)]
        else:
            sums = self.hash
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.hash))
        at = np.flatnonzero(left[: len(sums)] >= k)
        return fmix64(sums[at] + np.uint64(k)), at

    def text(self, i: int, n: int = 1) -> str:
        """n words from word i, lower-cased, with single spaces."""
        take = self.alphabet.to
        return b" ".join(take[self.data[self.start[j] : self.end[j]]].tobytes() for j in range(i, i + n)).decode("utf-8", "replace")


def gram_hash(words: list[str], alphabet: Alphabet = ALNUM) -> int:
    """The hash that Words.grams gives to these words."""
    (found,) = words_of(pa.array([" ".join(words)]), alphabet)
    return int(found.grams(len(words))[0][0])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins in them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data, offsets


def words_of(column: pa.Array, alphabet: Alphabet, most: int = 1 << 18) -> Iterator[Words]:
    """Splits all rows of a string column into words, in runs of whole rows of about most bytes."""
    data, offsets = text_buffers(column)
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield _split(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo, hi, alphabet)
        lo = hi


def _split(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, alphabet: Alphabet) -> Words:
    n = len(data)
    inside = alphabet.inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    start = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    end = np.flatnonzero(inside & (~after[1:] | edge[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(alphabet.hash[data] * _power("base", _BASE, n), out=sums[1:])
    hashed = fmix64((sums[end] - sums[start]) * _power("inverse", _inverse, n + 1)[start])
    return Words(lo, hi, hashed, start, end, np.searchsorted(start, offsets), data, alphabet)


class Lookup:
    """Membership of 64-bit hashes in a small sorted set, with a bit table before the search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(np.asarray(keys, np.uint64))
        self.bits = max(12, int(len(self.keys) * 16 or 1).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._low(self.keys)] = True

    def _low(self, x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Which of x are keys, as indexes into x."""
        at = np.flatnonzero(self.table[self._low(x)])
        place = np.searchsorted(self.keys, x[at])
        return at[(place < len(self.keys)) & (self.keys[np.minimum(place, len(self.keys) - 1)] == x[at])] if len(self.keys) else at[:0]
