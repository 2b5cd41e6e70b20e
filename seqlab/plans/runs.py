"""Experiments as configuration rows: read from JSON, checked against rules, and run as stages and weighted models."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..operators import features as E
from ..operators import learned as M

STAGE = "struct<stage:string,method:string,params:map<string,double>>"
MODEL = "struct<type:string,weight:double,params:map<string,double>>"
SCHEMA = f"id string, feature_sets array<string>, pipeline array<{STAGE}>, models array<{MODEL}>"


@dataclass(frozen=True)
class Rules:
    """What a configuration may hold: names, and the least and greatest value of each parameter of a stage or model."""

    feature_sets: tuple[str, ...]
    stages: dict[str, dict[str, tuple[float, float]]] = field(default_factory=lambda: {
        "select": {"threshold": (0.5, 3)}, "poly": {"degree": (2, 3), "top_k": (1, 500)}, "interact": {"head": (1, 15), "tail": (1, 15), "ratios": (0, 1)}, "scale": {},
    })
    models: dict[str, dict[str, tuple[float, float]]] = field(default_factory=lambda: {k: {} for k in ("forest", "boosted", "logistic", "perceptron", "bayes")})
    methods: tuple[str, ...] = ("standard", "robust", "minmax", "normal")
    weight: tuple[float, float] = (0.1, 10)
    most_stages: int = 4
    most_models: int = 3


def read_configs(rows: DataFrame, text: str = "config") -> DataFrame:
    """Configurations of a JSON column; what can't be read has a null id and its text in broken."""
    parsed = F.from_json(F.col(text), SCHEMA)
    return rows.select(parsed.alias("_x"), F.col(text).alias("_text")).select("_x.*", F.when(F.col("_x.id").isNull(), F.coalesce("_text", F.lit(""))).alias("broken"))


def problems(configs: DataFrame, rules: Rules) -> DataFrame:
    """id, field, problem: one row for each rule that a configuration of read_configs() breaks. Stages and models are numbered from 0."""

    def found(wrong: Column, where: Column | str, problem: Column | str) -> Column:
        text = [x if isinstance(x, Column) else F.lit(x) for x in (where, problem)]
        return F.when(F.coalesce(wrong, F.lit(False)), F.struct(text[0].alias("field"), text[1].alias("problem")))

    none = F.lit(None).cast("struct<field:string,problem:string>")
    lists = {c: F.coalesce(F.col(c), F.array().cast(t)) for c, t in (("feature_sets", "array<string>"), ("pipeline", f"array<{STAGE}>"), ("models", f"array<{MODEL}>"))}
    limits = {f"{owner}.{p}": v for kind in (rules.stages, rules.models) for owner, ps in kind.items() for p, v in ps.items()}
    table = F.map_from_arrays(F.array(*map(F.lit, limits)), F.array(*(F.array(F.lit(float(a)), F.lit(float(b))) for a, b in limits.values())))

    def bounds(prefix: Column, owner: Column, params: Column) -> Column:
        def one(e):
            held = F.element_at(table, F.concat(owner, F.lit("."), e["key"]))
            at = F.concat(prefix, F.lit("."), e["key"])
            return F.coalesce(found(held.isNull(), at, "unknown parameter"), found((e["value"] < held[0]) | (e["value"] > held[1]), at, F.concat(F.lit("outside "), held[0].cast("string"), F.lit(" to "), held[1].cast("string"))), none)

        return F.transform(F.map_entries(F.coalesce(params, F.create_map().cast("map<string,double>"))), one)

    names = F.transform(lists["pipeline"], lambda x: x["stage"])

    def stage(x, i):
        at = F.concat(F.lit("pipeline["), i.cast("string"), F.lit("]"))
        known = x["stage"].isin(list(rules.stages))
        earlier = F.slice(names, 1, i)
        degree = F.element_at(F.coalesce(x["params"], F.create_map().cast("map<string,double>")), "degree")
        own = F.array(
            found(~known | x["stage"].isNull(), at, F.concat(F.lit("unknown stage "), F.coalesce(x["stage"], F.lit("")))),
            found(known & F.array_contains(earlier, x["stage"]), at, F.concat(x["stage"], F.lit(" comes twice"))),
            found((x["stage"] == "poly") & (degree > 2) & ~F.array_contains(earlier, "select"), at, "a degree over 2 needs select before it"),
            found((x["stage"] == "scale") & ~F.coalesce(x["method"], F.lit(rules.methods[0])).isin(list(rules.methods)), at, F.concat(F.lit("unknown method "), x["method"])),
        )
        return F.concat(own, F.when(known, bounds(at, x["stage"], x["params"])).otherwise(F.array().cast("array<struct<field:string,problem:string>>")))

    def model(x, i):
        at, (lo, hi) = F.concat(F.lit("models["), i.cast("string"), F.lit("]")), rules.weight
        known = x["type"].isin(list(rules.models))
        own = F.array(
            found(~known | x["type"].isNull(), at, F.concat(F.lit("unknown type "), F.coalesce(x["type"], F.lit("")))),
            found((x["weight"] < lo) | (x["weight"] > hi), F.concat(at, F.lit(".weight")), f"outside {lo} to {hi}"),
        )
        return F.concat(own, F.when(known, bounds(at, x["type"], x["params"])).otherwise(F.array().cast("array<struct<field:string,problem:string>>")))

    sets = lists["feature_sets"]
    whole = F.array(
        found(F.size(sets) == 0, "feature_sets", "none"),
        found(F.size(F.array_distinct(sets)) < F.size(sets), "feature_sets", "repeated"),
        found(F.size(lists["pipeline"]) > rules.most_stages, "pipeline", f"over {rules.most_stages} stages"),
        found(F.size(lists["models"]) == 0, "models", "none"),
        found(F.size(lists["models"]) > rules.most_models, "models", f"over {rules.most_models} models"),
    )
    unknown = F.transform(F.array_except(sets, F.array(*map(F.lit, rules.feature_sets))), lambda n: found(F.lit(True), "feature_sets", F.concat(F.lit("unknown set "), F.coalesce(n, F.lit("")))))
    every = F.concat(whole, unknown, F.flatten(F.transform(lists["pipeline"], stage)), F.flatten(F.transform(lists["models"], model)))
    told = F.when(F.col("broken").isNotNull(), F.array(found(F.lit(True), "config", "not readable"))).otherwise(F.filter(every, lambda x: x.isNotNull()))
    return configs.select("id", F.explode(told).alias("x")).select("id", "x.*")


def run_config(config: Row, train: DataFrame, rows: DataFrame, sets: dict[str, list[str]], label: str, symbols: int, key: str = "t") -> DataFrame:
    """rows (key) with p, the weighted mean of the models' chances of each symbol of label, after the stages in their order.

    Stages are fitted on train and applied to both. sets: the columns of each feature set. Columns and models are few.
    """
    columns = list(dict.fromkeys(c for name in config["feature_sets"] for c in sets[name]))
    for i, stage in enumerate(config["pipeline"] or []):
        params = stage["params"] or {}
        made: dict[str, Column] = {}
        if stage["stage"] == "select":
            places = M.select_by_importance(M.vectors(train, columns, label, [key]), len(columns), params.get("threshold", 1.0))
            columns = [columns[k] for k in places]
        elif stage["stage"] == "poly":
            made = {f"poly{i}_{k}": F.expr(t) for k, t in enumerate(E.polynomial_by_variance(train, columns, int(params.get("degree", 2)), int(params.get("top_k", 50))))}
        elif stage["stage"] == "interact":
            made = E.interactions(columns[: int(params.get("head", 5))], columns[-int(params.get("tail", 5)) :], bool(params.get("ratios", 1)))
        else:
            method, fitted = stage["method"] or "standard", train
            scaled = (lambda x: E.to_normal(x, fitted, columns)) if method == "normal" else (lambda x: E.scale(x, fitted, columns, method))  # noqa: B023
            train, rows = scaled(train), scaled(rows)
        if made:
            train, rows, columns = train.withColumns(made), rows.withColumns(made), columns + list(made)
    both = [M.vectors(x, columns, label, [key]) for x in (train, rows)]
    scored = [M.symbol_scores(*both, m["type"], len(columns), symbols) for m in config["models"]]
    return M.mean_scores(scored, [m["weight"] if m["weight"] is not None else 1.0 for m in config["models"]], key).select(key, "p")
