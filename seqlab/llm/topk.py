"""Exact top-k inner products by a bit-sliced index.

Vectors are quantised to integers. A block of candidates is stored as slices: one bitmap per attribute and binary
digit, over the block's rows. For a query, the slices are added up with bitmap arithmetic (carry-save adders), which
gives the slices of all scores; the top k are then picked from the most significant slice downward, and the rows left
at the boundary, all of one score, are resolved exactly by smaller id. The slices of a block are built once and written
as a table; blocks of queries are sent to every block of the index, and the best k of all blocks remain.

Edge cases: a vector that is null, or holds a null, NaN or infinite component, takes no part on either side; shorter
vectors count as padded with zeros; equal vectors and repeated ids are separate rows, but a row never meets rows of
its own id; fewer than k candidates are all returned, and no candidates or queries give no rows. Components of any
finite size are exact, as integers beyond 64 bits take Python's; only a returned score outside the range of a long is
given as the nearest long, ranked by its true value.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


class BitSlices:
    """The slices of a block: sign-offset binary digits of each attribute, and the ids, in ascending order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, rows = ids[order], vectors[order]
        self.low = rows.min(0) if len(ids) else np.zeros(vectors.shape[1], np.int64)
        shifted = rows - self.low
        self.n = len(ids)
        self.words = -(-max(1, self.n) // 64)
        self.slices = []
        for d in range(shifted.shape[1]):
            column = shifted[:, d]
            self.slices.append([self._pack((column >> b) & 1) for b in range(int(column.max()).bit_length() if self.n else 0)])
        self.all = self._pack(np.ones(self.n, np.int64))

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.words * 64, np.uint8)
        padded[: self.n] = bits.astype(np.uint8)
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def unpack(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """The slices of each row's inner product, less a constant."""
        places: list[list[np.ndarray]] = []

        def put(at: int, bitmap: np.ndarray) -> None:
            while len(places) <= at:
                places.append([])
            places[at].append(bitmap)

        base = 0
        for d, q in enumerate(query.tolist()[: len(self.slices)]):  # further attributes are 0 in all rows
            base += q * int(self.low[d])
            if q > 0:
                for b, slice_ in enumerate(self.slices[d]):
                    for i in range(q.bit_length()):
                        if q >> i & 1:
                            put(b + i, slice_)
            elif q < 0:  # q * s = |q| * (complement of s) less a constant
                top = (1 << len(self.slices[d])) - 1
                base += q * top
                for b, slice_ in enumerate(self.slices[d]):
                    flipped = slice_ ^ self.all
                    for i in range((-q).bit_length()):
                        if -q >> i & 1:
                            put(b + i, flipped)
        out, at = [], 0
        while at < len(places):
            column = places[at]
            while len(column) > 2:  # three bitmaps of a place make one, and one of the next place
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                column.insert(0, half ^ c)
                put(at + 1, (a & b) | (half & c))
            if len(column) == 2:
                a, b = column
                put(at + 1, a & b)
                column[:] = [a ^ b]
            out.append(column[0] if column else np.zeros(self.words, np.uint64))
            at += 1
        return out, base

    def top(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows whose id is not own."""
        slices, base = self.scores(query)
        mine = slice(np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right"))
        allowed = self.all
        if mine.stop > mine.start:
            bits = np.zeros(self.n, np.int64)
            bits[mine] = 1
            allowed = self.all & ~self._pack(bits)
        sure, tied = np.zeros(self.words, np.uint64), allowed
        for s in reversed(slices):
            ahead = sure | (tied & s)
            n = int(np.bitwise_count(ahead).sum())
            if n > k:
                tied = tied & s
            else:
                sure, tied = ahead, tied & ~s
                if n == k:
                    break
        rows = self.unpack(sure).tolist()
        rows += self.unpack(tied).tolist()[: max(0, k - len(rows))]  # all of one score, in the order of ids
        found = [(sum(((int(s[r >> 6]) >> (r & 63)) & 1) << i for i, s in enumerate(slices)) + base, int(self.ids[r])) for r in rows]
        return sorted(found, key=lambda x: (-x[0], x[1]))


def usable(vector: Column) -> Column:
    """The components as doubles; null if the vector takes no part."""
    x = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~bad, x)


def quantise(vectors: list, scale: int) -> np.ndarray:
    """floor(scale * x) of each component: 64-bit integers if all are far below 2^63, else Python's; padded with zeros."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    if not out.size or np.abs(out).max() < 2**61 / scale:
        return np.floor(out * scale).astype(np.int64)
    exact = np.frompyfunc(lambda x: int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale), 1, 1)
    return exact(out)


def sort_key(score: int) -> bytes:
    """Bytes in the order of the integers: sign, length and digits."""
    raw = abs(score).to_bytes((score.bit_length() + 7) // 8 or 1, "big")
    raw = len(raw).to_bytes(2, "big") + raw
    return b"\1" + raw if score >= 0 else b"\0" + bytes(255 - x for x in raw)


def build_index(candidates: DataFrame, scale: int, block: int) -> DataFrame:
    """cb, slices of each block of about so many rows of candidates (vec_id, vector), written once."""
    n = -(-max(1, candidates.count()) // block)

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        index = BitSlices(rows["vec_id"].to_numpy(), quantise(rows["vector"].tolist(), scale))
        return pd.DataFrame({"cb": [key[0]], "slices": [pickle.dumps(index)]})

    dealt = candidates.withColumn("cb", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    return materialize(dealt.groupBy("cb").applyInPandas(build, "cb int, slices binary"), "slices")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, scale: int = 1024, block: int = 16_384, query_block: int = 128) -> DataFrame:
    """For each row of queries (vec_id, embedding) the k rows of candidates with the largest inner products of quantised vectors.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; rows of the query's own id are left
    out. block and query_block bound what a task holds at once.
    """

    def ready(df: DataFrame) -> DataFrame:
        return df.select("vec_id", usable(F.col("embedding")).alias("vector")).where("vec_id is not null and vector is not null")

    queries, index = ready(queries), build_index(ready(candidates), scale, block)
    n_q, n_c = -(-max(1, queries.count()) // query_block), index.count()
    stripes = min(n_q, -(-2 * queries.sparkSession.sparkContext.defaultParallelism // max(1, n_c)))  # few blocks are read by several tasks
    blocks = index.select(F.collect_list("cb").alias("cbs"))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"qb": [key[0]], "payload": [pickle.dumps((rows["vec_id"].tolist(), quantise(rows["vector"].tolist(), scale)))]})

    asked = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_q)).cast("int"))
    asked = asked.groupBy("qb").applyInPandas(pack, "qb int, payload binary").crossJoin(F.broadcast(blocks))  # one row of block numbers
    asked = asked.select(F.explode("cbs").alias("cb"), (F.col("qb") % stripes).alias("stripe"), "qb", "payload")
    held = index.select("cb", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(-1).alias("qb"), F.col("slices").alias("payload"))
    met = held.union(asked).repartition(max(1, n_c * stripes), "cb", "stripe").sortWithinPartitions("cb", "stripe", "qb")

    def best(batches):
        found = None
        for batch in batches:
            for qb, payload in zip(batch.column("qb").to_pylist(), batch.column("payload")):
                if qb < 0:
                    found = pickle.loads(payload.as_py())
                    continue
                out: list[tuple] = []
                for q, v in zip(*pickle.loads(payload.as_py())):
                    out += [(q, i, max(-(1 << 63), min((1 << 63) - 1, s)), sort_key(s)) for s, i in found.top(v, q, k)]
                columns = zip(*out) if out else ((),) * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["query_id", "vec_id", "score", "key"])

    parts = met.mapInArrow(best, "query_id long, vec_id long, score long, key binary")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
