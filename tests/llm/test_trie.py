"""The prefix trie against brute force, and list ranking on shuffled lists."""

import hashlib
import random
import zlib
from collections import defaultdict

from seqlab.llm.trie import list_rank, rebuilt_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_force(rows, group=5, longest=9):
    turns = defaultdict(list)
    for c, t, r, x, *_ in rows:
        turns[c].append(((t is not None, t), r or "", x or ""))
    original = {c: [(r, x) for _, r, x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, own in original.items():
        if c is None:
            rebuilt[c] = own
            continue
        h = zlib.crc32(str(c).encode()) % longest
        rest = abs(c) % group * (1 if c >= 0 else -1)
        rebuilt[c] = original.get(c - rest, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    least = {k: min((c for c in v if c is not None), default=None) for k, v in members.items()}
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    own = {k: (len(v) - 1) * len(k[-1][1].encode()) if k else 0 for k, v in members.items()}
    saved, leaves = defaultdict(int), defaultdict(int)
    for k in members:
        for d in range(len(k) + 1):
            saved[k[:d]] += own[k]
            leaves[k[:d]] += not children[k]
    out = []
    for k, v in members.items():
        ids = ",".join(map(str, sorted(c for c in ends[k] if c is not None)))
        out.append((least[k], len(k), least[k[:-1]] if k else None, len(v), len(children[k]), leaves[k], saved[k], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def _same(spark, rows, schema=SCHEMA, **options):
    got = sorted(map(tuple, rebuilt_trie(spark.createDataFrame(rows, schema), **options).collect()), key=str)
    assert got == brute_force(rows)


def test_random_conversations(spark):
    rng = random.Random(12)
    rows = []
    for c in range(-12, 60):
        for t in range(rng.randrange(1, 14)):
            rows.append((c, rng.choice([t, t, t, None]) if rng.random() < 0.1 else t, rng.choice(["user", "assistant", None]), rng.choice(["ä", "b", "", "cc"])))
    _same(spark, rows, small=500)


def test_copies_nulls_and_other_columns(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for c in range(0, 300) for t in range(3)]
    rows += [(7, t, "user", "long" + str(t % 5)) for t in range(3, 150)]
    rows += [(None, 0, "user", "t0"), (None, 1, None, None), (10**12, None, "user", "x"), (10**12, 0, "user", "x"), (10**12, 0, "user", "x")]
    _same(spark, [(*r, 1, "k", 3) for r in rows], SCHEMA + ", conv long, key string, id int", small=300)


def test_a_conversation_over_many_ranges(spark):
    """One conversation has nearly all rows, and each range of rows holds a part of it."""
    _same(spark, [(5, t, "user", str(t % 7)) for t in range(250)] + [(6, t, "user", str(t % 7)) for t in range(20)] + [(4, 0, "user", "0"), (9, 0, "a", "b")], small=400)


def test_no_rows_and_no_turns(spark):
    assert rebuilt_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    short = [(c, 0, "user", "x") for c in (6, 7, 8, 9, 11)]  # no conversation 5 or 10, and heads longer than they are: roots only
    _same(spark, short)


def test_list_rank(spark):
    rng = random.Random(3)
    order = list(range(500))
    rng.shuffle(order)
    arcs = [(a, order[i - 1] if i else -1, order[i + 1] if i + 1 < len(order) else -1) for i, a in enumerate(order)]
    rng.shuffle(arcs)
    got = dict(map(tuple, list_rank(spark.createDataFrame(arcs, "arc long, before long, after long"), small=100).collect()))
    assert got == {a: i for i, a in enumerate(order)}
