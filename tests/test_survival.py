"""The survival panel against a plain reading of its columns, step by step."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from seqlab.operators import contexts as W
from seqlab.operators import survival as V


def plain(baskets, domain, gaps, uses, k):
    together = {a: sorted(((sum(a in x and b in x for x in baskets), -b) for b in domain if b != a), reverse=True)[:k] for a in domain}
    top = {a: {-b for n, b in v if n} for a, v in together.items()}
    rows = {}
    for a in domain:
        seq = [int(a in x) for x in baskets]
        for t in range(len(seq)):
            past = seq[:t]
            hits = [i for i, e in enumerate(past) if e]
            done = [y - x for x, y in zip(hits, hits[1:])]
            row = {"event": seq[t], "since": t - hits[-1] if hits else t + 1}
            for n in gaps:
                last = done[-n:] or [0]
                row |= {f"gap_mean_{n}": statistics.mean(last), f"gap_sd_{n}": statistics.pstdev(last), f"gap_least_{n}": min(last), f"gap_most_{n}": max(last)}
            row |= {f"uses_{n}": sum(past[max(0, t - n) :]) for n in uses}
            runs = [x for i, x in enumerate(past) if not i or x != past[i - 1]]
            length = next((i for i, x in enumerate(reversed(past)) if x != past[-1]), t) if past else 0
            came = max(1, sum(runs))
            row |= {"run": length, "direction": (1 if past[-1] else -1) if past else 0, "runs_ratio": max(1, len(runs) - came) / came if past else 1.0}
            before = baskets[t - 1] if t else set()
            row |= {"partners": len(top[a] & before), "prev_total": sum(before), "prev_range": max(before) - min(before) if before else 0, "prev_odd": sum(x % 2 for x in before), "was_max": int(bool(before) and a == max(before))}
            rows[a, t] = row
    return rows


@pytest.mark.parametrize("piece", [7, 1 << 14])
def test_panel(spark, piece):
    rng = random.Random(2)
    baskets = [{k for k, p in ((1, 0.5), (2, 0.1), (3, 0.9), (4, 0.03), (5, 0.3)) if rng.random() < p} for _ in range(120)]
    baskets[0] |= {1, 3}
    items = spark.createDataFrame([(t, i) for t, x in enumerate(baskets) for i in sorted(x)], "t long, item int")
    domain = spark.range(1, 7).select(F.col("id").cast("int").alias("item"))
    got = V.survival_panel(items, W.every_step(spark, items, 120), domain, 0, 120, gaps=(2, 5), uses=(3, 20), partners=2, piece=piece).collect()
    want = plain(baskets, range(1, 7), (2, 5), (3, 20), 2)
    assert len(got) == len(want) == 6 * 120
    for r in got:
        mine = r.asDict()
        assert {k: v for k, v in mine.items() if k not in ("item", "t")} == pytest.approx(want[r.item, r.t]), (r.item, r.t)
    part = V.survival_panel(items, W.every_step(spark, items, 120), domain, 40, 100, gaps=(2, 5), uses=(3, 20), partners=2, piece=piece)
    assert part.count() == 6 * 60


def test_panel_rows_never_move(spark):
    """Rows are made where a range's baskets are, so nothing of the panel's size is shuffled; a part of it has the whole one's values, also for an item that waits over many ranges."""
    rng = random.Random(3)
    baskets = [{k for k, p in ((1, 0.6), (2, 0.3), (4, 0.02)) if rng.random() < p} for _ in range(90)]
    baskets[3] = {1, 4}
    items = spark.createDataFrame([(t, i) for t, x in enumerate(baskets) for i in sorted(x)], "t long, item int")
    domain = spark.createDataFrame([(k,) for k in (1, 2, 4, 5)], "item int")
    part = V.survival_panel(items, W.every_step(spark, items, 90), domain, 33, 71, gaps=(2, 5), uses=(3, 20), partners=1, piece=4)
    plan = part._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert plan[0].startswith("MapInArrow") and not any("uses_" in line for line in plan[1:])
    want = plain(baskets, (1, 2, 4, 5), (2, 5), (3, 20), 1)
    got = {(r.item, r.t): r.asDict() for r in part.collect()}
    assert sorted(got) == sorted((k, t) for k in (1, 2, 4, 5) for t in range(33, 71))
    for key, r in got.items():
        assert {k: v for k, v in r.items() if k not in ("item", "t")} == pytest.approx(want[key]), key
