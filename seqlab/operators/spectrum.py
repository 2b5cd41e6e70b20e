"""Periodograms of presence: a Fourier transform of any length, split over ranges of steps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import pinned, written


def _chirp(t: np.ndarray, n: int) -> np.ndarray:
    """exp(-i pi t^2 / n), from t^2 modulo 2n."""
    return np.exp(-1j * np.pi * ((t * t) % (2 * n)) / n)


def periodogram(items: DataFrame, steps: int, peaks: int = 3, block: int = 1 << 18, most: int = 1 << 25) -> DataFrame:
    """The strongest frequencies k / steps of each item's presence, over all k from 1 up to half the steps: item, place, k, period, power.

    The transform of any length is a convolution with a chirp (Bluestein), whose length is a power of two, rows times
    columns. A transform of that length is one of all columns, a twist, and one of all rows; a task has some columns or
    rows of one item, about block numbers, and two shuffles of packed blocks lead from one to the other and back. So a
    series of any length is worked on by many tasks. Items are done in turns of at most about most numbers, each of which
    leaves no shuffle files to the next. Ties go to the smaller k; period is rounded, and null unless it is
    between 2 and half the steps.
    """
    spark = items.sparkSession
    bits = max(2, (2 * steps - 1).bit_length())
    rows, size = 1 << (bits // 2), 1 << bits
    columns = size // rows
    wide, high = (min(n, max(1, 1 << (block // m).bit_length() - 1)) if block >= m else 1 for n, m in ((columns, rows), (rows, columns)))

    def twist(k1: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.exp(-2j * np.pi * ((k1[:, None] * c[None, :]) % size) / size)

    def pack(key: str, table: np.ndarray, item: int, part: int, axis: int, step: int) -> pd.DataFrame:
        """table cut along an axis into blocks of step: item, key (the block), part (where it came from), data."""
        cuts = np.split(table, table.shape[axis] // step, axis)
        return pd.DataFrame({"item": item, key: np.arange(len(cuts), dtype=np.int32), "part": part, "data": [np.ascontiguousarray(x).tobytes() for x in cuts]})

    def gather(frame: pd.DataFrame, shape: tuple[int, int], axis: int) -> np.ndarray:
        """A block of shape from the parts it came in along an axis; parts without a hit are missing, and zero."""
        out = np.zeros(shape, np.complex128)
        for part, data in zip(frame["part"], frame["data"]):
            if axis:
                out[:, part * wide : (part + 1) * wide] = np.frombuffer(data, np.complex128).reshape(high, wide)
            else:
                out[part * high : (part + 1) * high] = np.frombuffer(data, np.complex128).reshape(high, wide)
        return out

    def down(item: int, part: int, table: np.ndarray) -> pd.DataFrame:
        """Columns part * wide .. of a series (rows, wide), transformed and cut by rows."""
        c = part * wide + np.arange(wide)
        return pack("kb", np.fft.fft(table, axis=0) * twist(np.arange(rows), c), item, part, 0, high)

    def of_item(key: tuple, hits: pd.DataFrame) -> pd.DataFrame:
        table, t = np.zeros((rows, wide), np.complex128), hits["t"].to_numpy()
        table[t // columns, t % columns - key[1] * wide] = _chirp(t, steps)
        return down(key[0], key[1], table)

    def of_chirp(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in frame["id"].tolist():
                t = np.arange(rows)[:, None] * columns + part * wide + np.arange(wide)[None, :]
                near = np.minimum(t, size - t)  # the chirp goes on around the end
                yield down(-1, part, np.where(near < steps, np.conj(_chirp(np.where(near < steps, near, 0), steps)), 0))

    def across(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        done = np.fft.fft(gather(frame, (high, columns), 1), axis=1)
        return pd.DataFrame({"item": [key[0]], "kb": [key[1]], "data": [done.tobytes()]})

    def back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for item, kb, data, other in zip(frame["item"], frame["kb"], frame["data"], frame["other"]):
                both = (np.frombuffer(data, np.complex128) * np.frombuffer(other, np.complex128)).reshape(high, columns)
                turned = np.fft.ifft(both, axis=1) * np.conj(twist(kb * high + np.arange(high), np.arange(columns)))
                yield pack("nb", turned, item, kb, 1, wide)

    def strongest(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        done = np.fft.ifft(gather(frame, (rows, wide), 0), axis=0)
        k = np.arange(rows)[:, None] * columns + key[1] * wide + np.arange(wide)[None, :]
        mine = (k >= 1) & (k < (steps + 1) // 2)
        k, power = k[mine], np.abs(done[mine]).round(6)
        best = np.lexsort((k, -power))[:peaks]
        return pd.DataFrame({"item": np.full(len(best), key[0], np.int32), "k": k[best], "power": power[best]})

    kind = "item int, kb int, part int, data binary"
    hits = items.select(F.col("item").cast("int").alias("item"), "t").distinct().withColumn("cb", F.floor(F.col("t") % columns / wide).cast("int"))
    chirp = written(spark.range(columns // wide).mapInPandas(of_chirp, kind).groupBy("item", "kb").applyInPandas(across, "item int, kb int, data binary"))
    other = chirp.select("kb", F.col("data").alias("other"))

    def turn(some: DataFrame) -> DataFrame:
        """The strongest of each block of some items."""
        own = some.groupBy("item", "cb").applyInPandas(of_item, kind).groupBy("item", "kb").applyInPandas(across, "item int, kb int, data binary")
        # a row is a block of numbers, so estimates from the number of rows would broadcast the whole chirp
        turned = own.hint("merge").join(other, "kb").select("item", "kb", "data", "other").mapInPandas(back, "item int, nb int, part int, data binary")
        return turned.groupBy("item", "nb").applyInPandas(strongest, "item int, k int, power double")  # peaks rows a block

    every = sorted(r.item for r in hits.select("item").distinct().collect())  # a transform each, so they are few
    each = max(1, most // size)
    turns = [every[lo : lo + each] for lo in range(0, len(every), each)]
    made = [turn(hits.where(F.col("item").isin(some)) if len(turns) > 1 else hits) for some in turns] or [turn(hits)]
    found = reduce(DataFrame.unionByName, (pinned(x) for x in made)) if len(made) > 1 else made[0]
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("power"), "k"))
    period = F.round(steps / F.col("k")).cast("int")
    ranked = found.withColumn("place", place).where(F.col("place") <= peaks)
    return ranked.select("item", "place", "k", F.when((period > 2) & (period < steps / 2), period).alias("period"), "power")


def shared_periods(found: DataFrame) -> DataFrame:
    """Of a periodogram: how many items have each period among their strongest, and which: period, n, items."""
    each = found.where("period is not null").select("period", "item").distinct()
    return each.groupBy("period").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))
