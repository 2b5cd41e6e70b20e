"""Configurations: broken ones are told, and stages and models run in their order."""

import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from seqlab.plans import runs


def test_every_rule(spark):
    good = {"id": "a", "feature_sets": ["one"], "pipeline": [{"stage": "select"}, {"stage": "poly", "params": {"degree": 3}}], "models": [{"type": "forest", "weight": 1}]}
    cases = {
        "sets": (good | {"feature_sets": []}, [("feature_sets", "none")]),
        "unknown set": (good | {"feature_sets": ["one", "six", "one"]}, [("feature_sets", "repeated"), ("feature_sets", "unknown set six")]),
        "stages": (good | {"pipeline": [{"stage": s} for s in ("select", "poly", "interact", "scale", "scale", "fold")]}, [("pipeline", "over 4 stages"), ("pipeline[4]", "scale comes twice"), ("pipeline[5]", "unknown stage fold")]),
        "degree": (good | {"pipeline": [{"stage": "poly", "params": {"degree": 3, "top_k": 0, "size": 1}}]}, [("pipeline[0]", "a degree over 2 needs select before it"), ("pipeline[0].size", "unknown parameter"), ("pipeline[0].top_k", "outside 1.0 to 500.0")]),
        "method": (good | {"pipeline": [{"stage": "scale", "method": "log"}]}, [("pipeline[0]", "unknown method log")]),
        "models": (good | {"models": [{"type": "forest", "weight": 99}, {"type": "oracle"}, {"type": "bayes"}, {"type": "bayes", "params": {"x": 1}}]}, [("models", "over 3 models"), ("models[0].weight", "outside 0.1 to 10"), ("models[1]", "unknown type oracle"), ("models[3].x", "unknown parameter")]),
        "no model": (good | {"models": None}, [("models", "none")]),
        "good": (good, []),
        "no pipeline": (good | {"pipeline": None}, []),
    }
    texts = [(json.dumps(c | {"id": name}),) for name, (c, _) in cases.items()] + [("{broken",), (None,)]
    got = runs.problems(runs.read_configs(spark.createDataFrame(texts, "config string")), runs.Rules(("one", "two"))).collect()
    for name, (_, want) in cases.items():
        assert sorted((r.field, r.problem) for r in got if r.id == name) == sorted(want), name
    assert [(r.field, r.problem) for r in got if r.id is None] == [("config", "not readable")] * 2


def test_run_in_order(spark):
    rows = spark.range(400).select(F.col("id").alias("t"), *((F.xxhash64(F.col("id"), F.lit(k)) % 5).cast("double").alias(f"x{k}") for k in range(4)))
    rows = rows.withColumn("y", F.pmod(F.col("x0").cast("int"), F.lit(3)))
    stage = lambda s, m=None, **p: Row(stage=s, method=m, params=p or None)
    model = lambda t, w: Row(type=t, weight=w, params=None)
    sets = {"a": ["x0", "x1"], "b": ["x2", "x3", "x0"]}
    config = Row(feature_sets=["a", "b"], pipeline=[stage("scale", "normal"), stage("select", threshold=0.5), stage("poly", degree=2.0, top_k=2.0), stage("interact", head=1.0, tail=1.0)], models=[model("forest", 3.0), model("logistic", 1.0)])
    train, rest = rows.where("t < 300"), rows.where("t >= 300")
    got = {r.t: r.p for r in runs.run_config(config, train, rest, sets, "y", 3).collect()}
    want = {r.t: r.y for r in rest.collect()}
    assert got.keys() == want.keys() and all(len(p) == 3 and abs(sum(p) - 1) < 1e-9 for p in got.values())
    assert sum(p.index(max(p)) == want[t] for t, p in got.items()) > 90
    single = [runs.run_config(Row(feature_sets=["a"], pipeline=[], models=[model(t, None)]), train, rest, sets, "y", 3).collect() for t in ("forest", "logistic")]
    mixed = {r.t: r.p for r in runs.run_config(Row(feature_sets=["a"], pipeline=None, models=[model("forest", 3.0), model("logistic", 1.0)]), train, rest, sets, "y", 3).collect()}
    first, second = ({r.t: r.p for r in x} for x in single)
    assert all(abs(mixed[t][k] - (3 * first[t][k] + second[t][k]) / 4) < 1e-9 for t in mixed for k in range(3))
