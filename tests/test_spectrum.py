"""Periodograms split into blocks against a transform of the whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlab.operators import spectrum


@pytest.mark.parametrize("steps, block", [(211, 16), (211, 1 << 18), (256, 64), (90, 1), (5, 4)])
def test_any_length_and_any_blocks(spark, steps, block):
    rng = np.random.default_rng(steps)
    series = {1: rng.random(steps) < 0.3, 2: np.arange(steps) % 7 == 3, 5: np.arange(steps) == steps - 1}
    items = spark.createDataFrame([(int(t), i) for i, x in series.items() for t in np.flatnonzero(x)], "t long, item int").union(spark.createDataFrame([(1, 2)], "t long, item int").where(F.lit(False)))
    got = spectrum.periodogram(items, steps, peaks=4, block=block).collect()
    for i, x in series.items():
        power = np.abs(np.fft.rfft(x - x.mean()))[1 : (steps + 1) // 2].round(6)
        want = np.lexsort((np.arange(len(power)), -power))[:4]
        mine = sorted((r.place, r.k, r.power) for r in got if r.item == i)
        assert [p for _, _, p in mine] == pytest.approx(power[want].tolist(), abs=2e-6)
        if i == 1:
            assert [k for _, k, _ in mine] == (want + 1).tolist()
    assert all(r.period is None or 2 < r.period < steps / 2 for r in got)


def test_shared_periods(spark):
    found = spark.createDataFrame([(1, 7), (2, 7), (2, 7), (3, 4), (3, None)], "item int, period int")
    assert sorted(map(tuple, spectrum.shared_periods(found).collect())) == [(4, 1, "3"), (7, 2, "1,2")]


def test_the_chirp_is_not_broadcast(spark):
    hits = spark.range(100).select((F.col("id") % 3).cast("int").alias("item"), F.col("id").alias("t"))
    assert "BroadcastHashJoin" not in spectrum.periodogram(hits, 100)._jdf.queryExecution().sparkPlan().toString()
