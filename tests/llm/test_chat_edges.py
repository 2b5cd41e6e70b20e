"""Chat formatting: hot turns split by salts, empty tables, repeated rows, null ids, long conversations."""

import hashlib
from collections import defaultdict

import pytest

from seqlab.llm import chat, common

SCHEMA = "conv_id long, turn long, role string, text string, leaf string, `from` string"


def _expected(rows):
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append(((t is not None, t), r or "", x or ""))
    out = {}
    for c, turns in groups.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


@pytest.mark.parametrize("split", [False, True])
def test_hot_first_turn(spark, split, monkeypatch):
    if split:
        real = common.hot_keys
        monkeypatch.setattr(chat, "hot_keys", lambda counts, keys, total: real(counts, keys, total, most=1 << 30, least=3))
    rows = [(c, t, "assistant" if t % 2 else "user", "same" if t < c % 4 else f"{c} {t}") for c in range(40) for t in range(c % 5 + 1)]
    rows += [(100 + i, 0, "user", "equal") for i in range(10)] + [(None, 0, "user", "x"), (None, None, None, None), (None, 0, "user", "x"), (7, 0, "assistant", "same")]
    rows += [(200, t, "tool\n\\n" if t % 3 else "assistant", f"<|im_end|>\n{t}" * 3) for t in range(700)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest_read_back(df).collect()}
    assert got == _expected(rows)


def test_no_rows(spark):
    assert chat.digest_read_back(spark.createDataFrame([], SCHEMA)).collect() == []
