"""Importance resampling by brute force: gains, bit-sliced sums, the draw, and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from seqlab.llm.resample import BUCKETS, GainPlanes, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def _features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(f.encode()) % BUCKETS for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute_force(docs, target, percent=25, least_words=20, seed=7):
    held, wanted = [(i, *_features(t)) for i, t in docs], [_features(t)[1] for t in target]
    s, t = Counter(b for _, _, f in held for b in f), Counter(b for f in wanted for b in f)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + BUCKETS) / ((s[b] + 1) * (all_t + BUCKETS)))) for b in range(BUCKETS)]
    rows = []
    for i, n, f in held:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = k
    return sorted(map(tuple, rows), key=str)


def _same(spark, docs, target):
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, score string, n_words int, bucket int")
    got = resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(docs, target)


def test_random_texts(spark):
    rng = random.Random(13)
    words = ["Alpha", "beta", "ÄÖ", "naïve", "日本語", "x1", "of", "THE", "w" * 63, "w" * 64, "v" * 65, "ü" * 200]
    text = lambda n: "".join(w + rng.choice([" ", ", ", "\n", "-"]) for w in rng.choices(words, range(12, 0, -1), k=n))
    docs = [(i, text(rng.randrange(0, 90))) for i in range(80)] + [(100, None), (101, ""), (None, text(30)), (None, text(30)), (7, text(40)), (7, docs_text := text(25)), (7, docs_text), (102, text(20000))]
    _same(spark, docs, [text(50), None, "beta beta"])
    _same(spark, docs, [])


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resample(empty, empty).collect() == []
    _same(spark, [(1, None), (2, "a b")], ["a"])


def test_planes():
    rng = np.random.default_rng(1)
    gains = rng.integers(-20000, 20000, BUCKETS)
    gains[:4] = -32768, 32767, 0, -1
    owner, bucket = np.sort(rng.integers(0, 7, 4000)), np.minimum(rng.integers(0, BUCKETS, 4000) ** 2 // BUCKETS, BUCKETS - 1)
    owner, bucket = np.append(owner, [8] * 3000), np.append(bucket, [0] * 3000)
    want = np.bincount(owner, gains[bucket], 9).astype(int)
    assert GainPlanes(gains).sums(owner, bucket, 9).tolist() == want.tolist()
    assert GainPlanes(np.zeros(BUCKETS, int)).sums(owner[:0], bucket[:0], 2).tolist() == [0, 0]
