"""Models of Spark ML over feature columns: symbol scores, selection, calibration, cross-validation, survival, periods."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import AFTSurvivalRegression, GeneralizedLinearRegression, IsotonicRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import chi_square
from ..storage import pinned
from .boosting import boosted_margins
from .scores import normalised, once
from .series import prefix_sum


def vectors(df: DataFrame, columns: list[str], label: str, keep: list[str]) -> DataFrame:
    """Feature vector x and label y beside the kept columns; a null feature is 0."""
    filled = df.select(*keep, F.col(label).cast("double").alias("y"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns if c not in keep))
    return VectorAssembler(inputCols=columns, outputCol="x").transform(filled).select(*keep, "x", "y")


def classifier(kind: str, width: int, symbols: int, seed: int = 42):
    """A classifier of y by x: forest, logistic, perceptron or bayes."""
    common = {"featuresCol": "x", "labelCol": "y"}
    return {
        "forest": lambda: RandomForestClassifier(**common, numTrees=20, maxDepth=5, seed=seed),
        "logistic": lambda: LogisticRegression(**common, family="multinomial", maxIter=20, regParam=0.01),
        "perceptron": lambda: MultilayerPerceptronClassifier(**common, layers=[width, 16, symbols], maxIter=20, seed=seed),
        "bayes": lambda: NaiveBayes(**common, modelType="gaussian"),
    }[kind]()


def aligned(p: Column, symbols: int) -> Column:
    """Class probabilities as an array of exactly so many symbols, zeros for classes that no row had, rescaled to 1."""
    return once(p, lambda whole: normalised(F.transform(F.sequence(F.lit(0), F.lit(symbols - 1)), lambda k: F.coalesce(F.get(whole, k), F.lit(0.0)))))


def symbol_scores(train: DataFrame, rows: DataFrame, kind: str, width: int, symbols: int) -> DataFrame:
    """rows with p, the probabilities of each symbol under a model fitted on train.

    Boosted trees (each symbol against the rest) give raw margins, which a logistic function turns into shares.
    """
    scaler = StandardScaler(inputCol="x0", outputCol="x", withMean=True)
    train, rows = train.withColumnRenamed("x", "x0"), rows.withColumnRenamed("x", "x0")
    if kind == "boosted":
        scale = scaler.fit(train)
        fitted, held = (scale.transform(d).withColumn("x", vector_to_array("x")).drop("x0") for d in (train, rows))
        scored, p = boosted_margins(fitted, held, width), F.transform("raw", lambda v: 1 / (1 + F.exp(-2 * v)))
    else:
        scored, p = Pipeline(stages=[scaler, classifier(kind, width, symbols)]).fit(train).transform(rows), vector_to_array("probability")
    return scored.withColumn("p", aligned(p, symbols)).drop("x0", "x", "raw", "rawPrediction", "probability", "prediction")


def mean_scores(scored: list[DataFrame], weights: list[float], key: str) -> DataFrame:
    """The weighted mean of the p of several models, joined on a key."""
    out = scored[0].withColumn("p", F.transform("p", lambda x: x * (weights[0] / sum(weights))))
    for other, w in zip(scored[1:], weights[1:], strict=True):
        held = other.select(key, F.col("p").alias("_q"))
        out = out.join(held, key).withColumn("p", F.zip_with("p", "_q", lambda a, b: a + b * (w / sum(weights)))).drop("_q")
    return out


def select_by_importance(train: DataFrame, width: int, least: float = 1.0, fallback: int = 10, seed: int = 42) -> list[int]:
    """Places in x whose importance in a forest is at least so many times the mean; the best few if there are none."""
    model = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=20, maxDepth=5, seed=seed).fit(train)
    weights = model.featureImportances.toArray()
    chosen = [i for i in range(width) if weights[i] >= least * weights.mean() and weights[i] > 0]
    return chosen or sorted(range(width), key=lambda i: (-weights[i], i))[:fallback]


def slice_vectors(df: DataFrame, places: list[int]) -> DataFrame:
    return VectorSlicer(inputCol="x", outputCol="_x", indices=places).transform(df).drop("x").withColumnRenamed("_x", "x")


def calibrate_isotonic(train: DataFrame, rows: DataFrame, score: str, label: str) -> DataFrame:
    """rows with calibrated: the isotonic fit of label on score in train, which must be out-of-fold rows."""
    model = IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="calibrated").fit(train.select(F.col(score).cast("double"), F.col(label).cast("double")))
    return model.transform(rows)


def calibrate_all(train: DataFrame, rows: DataFrame, p: str, label: str, symbols: int) -> DataFrame:
    """rows with calibrated: the array p of chances, each symbol by its own isotonic fit on train (out-of-fold rows), rescaled to 1; as it was where all are 0."""
    out = rows
    for s in range(symbols):
        fit = IsotonicRegression(featuresCol="_s", labelCol="_l", predictionCol=f"_c{s}").fit(train.select(F.col(p)[s].alias("_s"), (F.col(label) == s).cast("double").alias("_l")))
        out = fit.transform(out.withColumn("_s", F.col(p)[s])).drop("_s")
    made = F.array(*(F.col(f"_c{s}") for s in range(symbols)))
    total = F.aggregate(made, F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("calibrated", F.when(total > 0, F.transform(made, lambda x: x / total)).otherwise(F.col(p))).drop(*(f"_c{s}" for s in range(symbols)))


def auc(df: DataFrame, by: list[str], score: str, label: str, least: int = 10) -> DataFrame:
    """by, positives, negatives, auc of 0/1 labels: the chance that a positive row has the larger score, ties one half; 0.5 with under least of either.

    Rows of a score are one cell. Negatives before each cell come from sums by ranges of all groups and scores at
    once, less those before the group, so a group of any size is worked on by many tasks.
    """
    cells = df.groupBy(*by, F.col(score).alias("_score")).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.sum(1 - F.col(label).cast("long")).alias("_q"))
    upto = prefix_sum(cells, [*by, "_score"], "_q", "_before")
    sums = upto.groupBy(*by).agg(F.sum("_p").alias("positives"), F.sum("_q").alias("negatives"), F.min("_before").alias("_base"), F.sum(F.col("_p") * (F.col("_before") + F.col("_q") / 2)).alias("_u"))
    area = (F.col("_u") - F.col("positives") * F.col("_base")) / (F.col("positives") * F.col("negatives"))
    return sums.select(*by, "positives", "negatives", F.when((F.col("positives") >= least) & (F.col("negatives") >= least), area).otherwise(0.5).alias("auc"))


def forest_auc(df: DataFrame, width: int, symbols: int, folds: int = 5, least: int = 10) -> DataFrame:
    """symbol, auc: the mean over folds (by a hash of t) of the area under the curve of each symbol's chance, under a forest fitted on the other folds."""
    marked = pinned(df.withColumn("fold", F.pmod(F.xxhash64("t"), F.lit(folds)).cast("int")))
    scored = [symbol_scores(marked.where(F.col("fold") != k), marked.where(F.col("fold") == k), "forest", width, symbols) for k in range(folds)]
    each = reduce(DataFrame.unionByName, scored).select("fold", "y", F.posexplode("p").alias("symbol", "p"))
    areas = auc(each.withColumn("came", (F.col("symbol") == F.col("y")).cast("int")), ["symbol", "fold"], "p", "came", least)
    return areas.groupBy("symbol").agg(F.avg("auc").alias("auc"))


def forest_cv(df: DataFrame, folds: int = 5, seed: int = 42) -> float:
    """Mean R squared of a regression forest over folds that a hash of the row's t chooses."""
    forest = RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=20, maxDepth=5, seed=seed)
    marked = df.withColumn("fold", F.pmod(F.xxhash64("t"), F.lit(folds)).cast("int"))
    cv = CrossValidator(estimator=forest, estimatorParamMaps=ParamGridBuilder().build(), evaluator=RegressionEvaluator(labelCol="y", metricName="r2"), numFolds=folds, foldCol="fold", parallelism=2)
    return float(cv.fit(marked).avgMetrics[0])


def explained_variance(df: DataFrame, k: int) -> list[float]:
    """Shares of variance of the first k components of the standardised x."""
    scaled = StandardScaler(inputCol="x", outputCol="z", withMean=True).fit(df).transform(df)
    return PCA(k=k, inputCol="z", outputCol="_").fit(scaled).explainedVariance.toArray().tolist()


def components(df: DataFrame, k: int, width: int) -> DataFrame:
    """component, share, eigenvalue, edge, above: the first k components of the standardised x of width columns, and whether their eigenvalue of the correlations is over the Marchenko-Pastur edge (1 + sqrt(width / rows))^2 that noise stays below."""
    edge = (1 + (width / max(1, df.count())) ** 0.5) ** 2
    rows = [(i + 1, s, s * width, edge, s * width > edge) for i, s in enumerate(map(float, explained_variance(df, k)))]
    return df.sparkSession.createDataFrame(rows, "component int, share double, eigenvalue double, edge double, above boolean")  # k rows


def survival_quantiles(spells: DataFrame, columns: list[str]) -> DataFrame:
    """Accelerated failure time of duration and event on columns: the expected duration of each row."""
    rows = VectorAssembler(inputCols=columns, outputCol="x").transform(spells.withColumns({"duration": F.col("duration").cast("double"), "event": F.col("event").cast("double")}))
    return AFTSurvivalRegression(featuresCol="x", labelCol="duration", censorCol="event").fit(rows).transform(rows).drop("x").withColumnRenamed("prediction", "expected")


def discrete_hawkes(items: DataFrame, steps: int, size: int, beta: float = 1.0, lookback: int = 10, strength: float = 1.0, least: int = 5, passes: int = 50, tolerance: float = 1e-7, chunk: int = 512) -> DataFrame:
    """b, baseline, alpha (one weight for each item 1 .. size): the log odds that item b comes in a step, by the decayed presence of all items before it.

    All items are fitted at once: L1 logistic regressions that share their rows, by accelerated proximal gradients on
    standardised presences, whose one aggregate a pass gives the gradients of all of them. The penalty is the sum of
    absolute weights over strength, baselines are free. A target whose objective grows goes back,
    without its momentum, and without any takes half the step. An item that came or stayed out in fewer than least steps has no weights and its plain log odds. Per
    pass size * (size + 1) numbers come to the driver: items are a bounded list. Passes read the items alone, packed by runs of chunk steps
    with the lookback before them; presences are made of these in the task.
    """
    spark = items.sparkSession
    own, span = F.floor(F.col("t") / chunk), chunk + lookback
    runs = F.sequence(own, F.floor((F.col("t") + lookback) / chunk))  # those that see the item
    place = (F.col("t") - F.col("run") * chunk + lookback) * size + F.col("item") - 1
    packed = items.where(F.col("t") < steps).select("t", "item", F.explode(runs).alias("run")).groupBy("run").agg(F.collect_list(place.cast("int")).alias("at"))
    rows = pinned(spark.range(-(-steps // chunk)).select(F.col("id").alias("run")).join(packed, "run", "left"))
    n = steps - lookback

    def dense(held: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Presences, and what came, of the steps of some runs."""
        at = np.repeat(np.arange(len(held)), np.asarray(pc.fill_null(pc.list_value_length(held.column("at")), 0))) * (span * size) + np.asarray(held.column("at").flatten())
        hits = np.bincount(at, minlength=len(held) * span * size).reshape(len(held), span, size)
        felt = sum(np.exp(-beta * k) * hits[:, lookback - k : span - k] for k in range(1, lookback + 1))
        t = np.asarray(held.column("run"))[:, None] * chunk + np.arange(chunk)
        inside = (t >= lookback) & (t < steps)
        return felt[inside], (hits[:, lookback:] > 0)[inside].astype(float)

    def summed(values) -> np.ndarray:
        """The sum over all rows of values(x, y), by tasks first."""

        def part(batches):
            total = 0.0
            for b in batches:
                for lo in range(0, len(b), 16):
                    total = total + values(*dense(b.slice(lo, 16)))
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["i", "v"])

        found = rows.mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        return found.column("v").to_numpy()[np.argsort(found.column("i").to_numpy())]

    sums = summed(lambda x, y: np.stack([x.sum(0), (x * x).sum(0), y.sum(0)])).reshape(3, size)
    mean, hits = sums[0] / n, sums[2]
    scale = np.sqrt(np.maximum(sums[1] / n - mean * mean, 0))
    scale[scale == 0] = 1.0
    able = np.flatnonzero((hits >= least) & (n - hits >= least))
    share = hits / n
    weights, penalty = np.zeros((size + 1, len(able))), 1 / (strength * n * scale)[:, None]
    weights[0] = np.log(share[able] / (1 - share[able]))
    bend = 1.5 * share[able] * (1 - share[able])  # curvature along each target
    ahead, best, good, slope = weights, weights, weights, np.zeros_like(weights)
    moment, objective = np.ones(len(able)), np.full(len(able), np.inf)
    for _ in range(passes if len(able) else 0):
        at = ahead

        def slopes(x, y):
            z = (x - mean) / scale
            f = at[0] + z @ at[1:]
            mine = y[:, able]
            e = np.exp(-np.abs(f))
            off = np.where(f >= 0, 1, e) / (1 + e) - mine
            return np.vstack([off.sum(0), z.T @ off, (np.maximum(f, 0) + np.log1p(e) - mine * f).sum(0)])

        found = summed(slopes).reshape(size + 2, len(able)) / n
        value = found[-1] + (penalty * np.abs(at[1:])).sum(0)
        worse = value > objective + 1e-12
        bend = np.where(worse & (moment == 1), bend * 2, bend)
        good, slope, objective = np.where(worse, good, at), np.where(worse, slope, found[:-1]), np.where(worse, objective, value)
        moved = good - slope / bend
        moved[1:] = np.sign(moved[1:]) * np.maximum(np.abs(moved[1:]) - penalty / bend, 0)
        following = np.where(worse, 1.0, (1 + np.sqrt(1 + 4 * moment**2)) / 2)
        ahead = moved + np.where(worse, 0.0, (moment - 1) / following) * (moved - best)
        still = ~worse.any() and np.abs(moved - best).max() < tolerance
        best, moment = moved, following
        if still:
            break
    alpha, baseline = np.zeros((size, size)), np.log(np.maximum(share, 1e-10) / (1 - share + 1e-10))
    alpha[able] = (best[1:] / scale[:, None]).T
    baseline[able] = best[0] - (best[1:] * (mean / scale)[:, None]).sum(0)
    return spark.createDataFrame([(b + 1, float(baseline[b]), alpha[b].tolist()) for b in range(size)], "b int, baseline double, alpha array<double>")


def logit_lr(df: DataFrame, targets: list[str], columns: list[str], controls: list[str]) -> DataFrame:
    """Per 0/1 target a logistic regression on columns and controls against one on controls alone: lr, p, aic, r2 (McFadden's).

    Rows that agree in all columns and controls are fitted as one, by their share of ones with their number as weight: the likelihood is that of
    the rows but for a factor (apart), so where columns belong to days, passes read days. Targets are few, each is two fits over the pinned groups.
    """
    every = [*columns, *controls]
    rows, out = pinned(df.groupBy(*every).agg(F.count("*").cast("double").alias("_n"), *(F.avg(F.col(y).cast("double")).alias(f"_y{i}") for i, y in enumerate(targets)))), []
    bits = lambda q: F.when(q > 0, F.col("_n") * q * F.log(q)).otherwise(0.0)
    apart = rows.agg(*(F.sum(bits(F.col(f"_y{i}")) + bits(1 - F.col(f"_y{i}"))).alias(y) for i, y in enumerate(targets))).first()
    for i, y in enumerate(targets):
        fits = []
        for xs in (every, controls):
            vectors_ = VectorAssembler(inputCols=xs, outputCol="x").transform(rows.withColumns({c: F.col(c).cast("double") for c in xs})).select("x", F.col(f"_y{i}").alias("y"), "_n")
            fits.append(GeneralizedLinearRegression(family="binomial", featuresCol="x", labelCol="y", weightCol="_n", maxIter=50, tol=1e-10).fit(vectors_).summary)
        full, small = fits
        of_rows = full.deviance - 2 * apart[y]
        out.append((y, float(small.deviance - full.deviance), float(of_rows + 2 * (len(every) + 1)), float(1 - of_rows / (full.nullDeviance - 2 * apart[y]))))
    made = df.sparkSession.createDataFrame(out, "target string, lr double, aic double, r2 double")  # a row for each target
    return made.select("target", "lr", chi_square(F.col("lr"), len(columns)).alias("p"), "aic", "r2")


def l1_select(df: DataFrame, targets: list[str], columns: list[str], strength: float = 0.001) -> DataFrame:
    """Per column and 0/1 target the coefficient of an L1 logistic regression of standardised columns: target, column, beta, kept."""
    rows, out = pinned(df), []
    for y in targets:
        vectors_ = VectorAssembler(inputCols=columns, outputCol="x").transform(rows.withColumns({c: F.col(c).cast("double") for c in columns}).withColumn("y", F.col(y).cast("double"))).select("x", "y")
        model = LogisticRegression(featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=strength, standardization=True).fit(vectors_)
        out += [(y, c, float(b), bool(b != 0)) for c, b in zip(columns, model.coefficients.toArray())]
    return df.sparkSession.createDataFrame(out, "target string, column string, beta double, kept boolean")


def property_intersection(train: DataFrame, rows: DataFrame, properties: list[str], table: list[tuple[int, ...]]) -> DataFrame:
    """rows with p, the shares of all combinations: the product over properties of the model's chance that a combination has it, or has it not.

    train and rows have x and the 0/1 properties; table has each combination's properties, in the order of combinations.
    One logistic regression for each of the few properties.
    """
    out = rows
    for i, name in enumerate(properties):
        model = LogisticRegression(featuresCol="x", labelCol=name, predictionCol="_y", rawPredictionCol="_raw", probabilityCol="_p").fit(train.withColumn(name, F.col(name).cast("double")))
        out = model.transform(out).withColumn(f"_p{i}", vector_to_array("_p")[1]).drop("_y", "_raw", "_p")
    known = F.array(*(F.lit(sum(bit << i for i, bit in enumerate(row))) for row in table))  # a bit for each property
    chance = lambda mask: reduce(lambda a, b: a * b, (F.when(mask.bitwiseAND(F.lit(1 << i)) > 0, F.col(f"_p{i}")).otherwise(1 - F.col(f"_p{i}")) for i in range(len(properties))))
    return out.withColumn("p", normalised(F.transform(known, chance))).drop(*(f"_p{i}" for i in range(len(properties))))
