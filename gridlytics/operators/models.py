"""Supervised models on ``pyspark.ml``: preparation, balancing, fitting, scoring and evaluation."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT, Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlytics.functions.columns import draw
from gridlytics.sources.staging import staged

# Longest arrears range, arrears growth that still counts as paid, and the debts, in
# millions, above which a training row is an outlier.
MAX_ARREARS_RANGE, ACCEPTED_GROWTH = 480, 28
DEBT_LIMITS = {
    "gas_current": 2.5e6, "gas_overdue": 5e6, "gas_deferred": 20e6,
    "credit_current": 1.2e6, "credit_overdue": 3e6, "credit_deferred": 10e6,
    "other_current": 0.1e6, "other_overdue": 0.5e6, "instalment": 1.5e6,
}
KINDS = {
    "logistic": LogisticRegression, "forest": RandomForestClassifier,
    "boosted": GBTClassifier, "perceptron": MultilayerPerceptronClassifier,
}


def relief_label() -> Column:
    """1 when the arrears stay at 0, or grow by less than 28 days from a positive start."""
    start, end = F.col("arrears_days"), F.col("final_arrears_days")
    held = F.when(start == 0, end == 0).otherwise(end - start < ACCEPTED_GROWTH)
    return F.when(held, 1).otherwise(0)


def relief_features(df: DataFrame, training: bool, limits: Mapping[str, float] = DEBT_LIMITS, drop: Sequence[str] = ()) -> DataFrame:
    """Rows of the relief-plan model: residential, capped arrears range; outliers cut and label added in training."""
    out = df.filter(F.col("category") == 1).drop("category", *drop)
    out = out.withColumn("arrears_range", F.least("arrears_range", F.lit(MAX_ARREARS_RANGE)))
    if training:
        for name, limit in limits.items():
            out = out.filter(F.col(name) <= limit)
        out = out.withColumn("label", relief_label()).drop("contract_id")
    return out.drop("arrears_days", "final_arrears_days")


def prep_pipeline(text: Sequence[str], codes: Sequence[str], numbers: Sequence[str]) -> Pipeline:
    """Index text, one-hot encode, assemble and scale; unseen values keep a place of their own."""
    indexed = [f"{c}_index" for c in text]
    inputs = [*indexed, *codes]
    encoded = [f"{c}_onehot" for c in inputs]
    return Pipeline(stages=[
        StringIndexer(inputCols=list(text), outputCols=indexed, handleInvalid="keep", stringOrderType="frequencyDesc"),
        OneHotEncoder(inputCols=inputs, outputCols=encoded, handleInvalid="keep"),
        VectorAssembler(inputCols=[*numbers, *encoded], outputCol="assembled", handleInvalid="keep"),
        StandardScaler(inputCol="assembled", outputCol="features"),
    ])


def varying_features(prepared: PipelineModel) -> tuple[PipelineModel, list[int]]:
    """The preparation without the columns that do not vary in the rows it was fitted on, and the places of those that are left.

    Scaling writes 0 in such a column for every row, of the hold-out too, so no linear or layered model learns from it and no tree
    splits on it. One-hot codes have a column for every number up to the largest one; most of these stand for no row.
    """
    spread = prepared.stages[-1].std.toArray()
    left = [k for k, deviation in enumerate(spread) if deviation > 0]
    if not left or len(left) == len(spread):
        return prepared, list(range(len(spread)))
    scaler = prepared.stages[-1].copy().setOutputCol("_scaled")
    return PipelineModel([*prepared.stages[:-1], scaler, VectorSlicer(inputCol="_scaled", outputCol="features", indices=left)]), left


#: Rows that one task of a fit should hold; a tree's bins take two kilobytes a row where codes are one-hot.
ROWS_PER_TASK = 150_000


def dealt(df: DataFrame) -> DataFrame:
    """Rows staged for a fit; many are dealt to tasks by their number, as adaptive execution goes by bytes that grow twentyfold in the fit."""
    parts = math.ceil(df.count() / ROWS_PER_TASK)
    return staged(df.repartition(parts) if parts > df.sparkSession.sparkContext.defaultParallelism else df)


def oversample(df: DataFrame, keys: Sequence[str], label: str = "label", ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """Repeat rows of the smaller class until it holds about ``ratio`` times the larger one.

    A row's number of copies is fixed by a hash of its key: the whole part of the factor plus one more with the
    probability of the rest. Reruns of a task give the same copies, and both classes are read in one pass.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    least = F.min(F.struct("n", label))
    both = counts.agg(F.struct(least[label].alias("label"), (F.max("n") * F.lit(float(ratio)) / least["n"]).alias("factor"))).scalar()
    small, factor = both["label"], both["factor"]
    point = draw(keys, seed) % 1_000_000 / 1_000_000
    copies = F.greatest(F.floor(factor) + F.when(point < factor - F.floor(factor), 1).otherwise(0), F.lit(1))
    wanted = F.when(F.col(label) == small, copies).otherwise(F.lit(1)).cast("int")
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), wanted))).drop("_copy")


def fit_classifier(kind: str, df: DataFrame, **params):
    """Fit a logistic regression, forest, boosted trees or perceptron on ``features`` and ``label``."""
    return KINDS[kind](featuresCol="features", labelCol="label", **params).fit(df)


def fit_perceptron(df: DataFrame, layers: Sequence[int], inputs: Sequence[int], **params):
    """Fit a perceptron whose first layer has only the ``inputs`` (places) of ``layers[0]`` that vary.

    It starts from the weights that the whole layer would start from. An input that is always 0 changes no output and its weights have no
    gradient, so both take the same steps; the rows are dense matrices to this model, so its work and memory follow the width.
    """
    narrow = [len(inputs), *layers[1:]]
    kind = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])
    one = df.sparkSession.createDataFrame([(float(k), Vectors.sparse(layers[0], [], [])) for k in range(layers[-1])], kind)
    start = fit_classifier("perceptron", one, layers=list(layers), **params | {"maxIter": 0}).weights.toArray()
    # A layer's weights stand input by input, then its offsets.
    first = start[: layers[0] * layers[1]].reshape(layers[0], layers[1])
    weights = Vectors.dense([*first[list(inputs)].ravel(), *start[layers[0] * layers[1] :]])
    return fit_classifier("perceptron", df, layers=narrow, initialWeights=weights, **params)


def grid_search(
    kind: str, df: DataFrame, grid: Mapping[str, Sequence], prepare: Pipeline, keys: Sequence[str], folds: int = 4, label: str = "label",
    parallelism: int = 4, seed: int = 0,
) -> tuple[dict, float]:
    """The parameters of a grid with the largest mean ROC area over stratified folds, and that area.

    In each fold the preparation is fitted on the other folds, which are then balanced by repeating rows of the smaller class; the
    fold itself is neither prepared from nor repeated. The fits of a fold share its prepared rows.
    """
    from itertools import product

    points = [dict(zip(grid, values)) for values in product(*grid.values())]
    areas = fold_areas(kind, df, points, prepare, keys, folds, label, parallelism, seed)
    best = max(range(len(points)), key=lambda k: areas[k])
    return points[best], areas[best]


def fold_areas(
    kind: str, df: DataFrame, points: Sequence[dict], prepare: Pipeline, keys: Sequence[str], folds: int, label: str, parallelism: int, seed: int
) -> list[float]:
    """The mean ROC area over the folds of each point."""
    from concurrent.futures import ThreadPoolExecutor

    folded, areas = stratified_folds(df, keys, label, folds, seed), [0.0] * len(points)
    # Points that differ in their number of steps alone, fewest first.
    alike: dict[tuple, list[int]] = {}
    for k in sorted(range(len(points)), key=lambda k: points[k].get("maxIter", 0)):
        alike.setdefault(tuple(sorted((name, repr(value)) for name, value in points[k].items() if name != "maxIter")), []).append(k)
    for fold in range(folds):
        inside = folded.filter(F.col("fold") != fold)
        prepared = prepare.fit(inside)
        if hasattr(prepared.stages[-1], "std"):
            prepared = varying_features(prepared)[0]
        train = oversample(prepared.transform(inside), keys, label).select("features", label)
        # A step of a fit sends something from every task, so tasks are as few as their rows allow.
        train = train.coalesce(fit_tasks(train)).cache()
        held = prepared.transform(folded.filter(F.col("fold") == fold)).select("features", label).cache()

        def some_areas(those: list[int]) -> list[tuple[int, float]]:
            out, settled = [], None
            for k in those:
                if settled is None:
                    model = fit_classifier(kind, train, **points[k])
                    area = BinaryClassificationEvaluator(labelCol=label).evaluate(model.transform(held))
                    # A fit that has converged before its last step allowed ends at the same place with more steps.
                    if kind == "logistic" and "maxIter" in points[k] and model.summary.totalIterations < points[k]["maxIter"]:
                        settled = area
                out.append((k, area))
            return out

        with ThreadPoolExecutor(parallelism) as pool:
            for k, area in (one for some in pool.map(some_areas, alike.values()) for one in some):
                areas[k] += area / folds
        train.unpersist()
        held.unpersist()
    return areas


#: Rows of a linear fit's task: sparse rows, one pass over them a step.
ROWS_PER_LINEAR_TASK = 400_000


def fit_tasks(df: DataFrame) -> int:
    """As many tasks as the cores, or as the rows ask for."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / ROWS_PER_LINEAR_TASK))


def halving_rungs(rows: int, points: int, factor: int = 3, least: int = 200) -> list[tuple[int, float]]:
    """(survivors, share of the rows) of each rung: every rung has a third of the points and three times the rows of the one before, the
    last one all rows. No rung has fewer than ``least`` rows, and the first that has all rows is the last."""
    counts = [points]
    while counts[-1] > 1:
        counts.append(-(-counts[-1] // factor))
    rungs = []
    for k, count in enumerate(counts):
        rungs.append((count, min(1.0, max(factor ** -(len(counts) - 1 - k), least / max(rows, 1)))))
        if rungs[-1][1] >= 1.0:
            break
    return rungs


def rung_rows(df: DataFrame, keys: Sequence[str], share: float, label: str = "label", seed: int = 0) -> DataFrame:
    """The rows of a rung, by a hash of their key; a larger share holds all rows of a smaller one."""
    return df.filter(draw([label, *keys], seed + 1) % 1_000_000 < int(round(share * 1_000_000)))


def halving_search(
    kind: str, df: DataFrame, grid: Mapping[str, Sequence], prepare: Pipeline, keys: Sequence[str], folds: int = 4, label: str = "label",
    factor: int = 3, least: int = 200, parallelism: int = 4, seed: int = 0,
) -> tuple[dict, float, list[dict]]:
    """Successive halving: all points of a grid on a small nested sample, the best third on three times the rows, and so on.

    Each rung is a :func:`grid_search` of its survivors; the winner, its mean ROC area on all rows, and what each rung had.
    """
    from itertools import product

    points = [dict(zip(grid, values)) for values in product(*grid.values())]
    history, area = [], 0.0
    for rung, (count, share) in enumerate(halving_rungs(df.count(), len(points), factor, least)):
        points = points[:count]
        rows = df if share >= 1 else rung_rows(df, keys, share, label, seed)
        areas = fold_areas(kind, rows, points, prepare, keys, folds, label, parallelism, seed)
        order = sorted(range(len(points)), key=lambda k: (-areas[k], k))
        history.append({"rung": rung, "share": share, "points": len(points), "best_area": areas[order[0]]})
        points, area = [points[k] for k in order], areas[order[0]]
    return points[0], area, history


def boost_weights(scored: DataFrame, label: str = "label", prediction: str = "prediction", weight: str = "weight") -> tuple[DataFrame, float]:
    """One round of adaptive boosting after a weak learner has predicted: the rows with their new weights, which add up to their
    number, and the learner's say, half the log odds of its weighted share of right rows."""
    wrong = F.col(label) != F.col(prediction)
    sums = scored.agg(F.sum(weight).alias("all"), F.sum(F.when(wrong, F.col(weight)).otherwise(0.0)).alias("wrong"), F.count("*").alias("n")).first()
    error = min(max((sums["wrong"] or 0.0) / (sums["all"] or 1.0), 1e-10), 1 - 1e-10)
    say = 0.5 * math.log((1 - error) / error)
    raised = F.col(weight) * F.when(wrong, math.exp(say)).otherwise(math.exp(-say))
    total = (sums["wrong"] or 0.0) * math.exp(say) + ((sums["all"] or 0.0) - (sums["wrong"] or 0.0)) * math.exp(-say)
    return scored.withColumn(weight, raised * (sums["n"] / (total or 1.0))), say


class AdaptiveBoost:
    """Weighted stumps whose votes are added up. ``transform`` gives the share of the votes for class 1 as ``probability_1``."""

    def __init__(self, stumps: list, says: list[float]):
        self.stumps, self.says = stumps, says

    def transform(self, df: DataFrame) -> DataFrame:
        votes, out = F.lit(0.0), df
        for k, (stump, say) in enumerate(zip(self.stumps, self.says)):
            # A tree's prediction is an expression over the features, so the rounds stay one pass.
            out = stump.transform(out).withColumnRenamed("prediction", f"_vote{k}").drop("rawPrediction", "probability")
            votes = votes + F.col(f"_vote{k}") * say
        total = sum(self.says) or 1.0
        share = votes / total
        out = out.withColumns({"probability_1": share, "prediction": F.when(share > 0.5, 1.0).otherwise(0.0)})
        return out.drop(*[f"_vote{k}" for k in range(len(self.stumps))])


def fit_adaptive(df: DataFrame, rounds: int = 50, depth: int = 1, label: str = "label", seed: int = 0) -> AdaptiveBoost:
    """Adaptive boosting of shallow trees on ``features``: each round fits weighted rows and raises the weights of those it gets wrong.

    Ends early when a learner is no better than chance, or makes no mistake. Weights are carried along a checkpoint every few rounds, so
    that neither the plan nor a recomputation grows with the rounds.
    """
    rows = staged(df.withColumn("weight", F.lit(1.0)))
    stumps, says = [], []
    for k in range(rounds):
        stump = DecisionTreeClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxDepth=depth, seed=seed).fit(rows)
        scored = stump.transform(rows).select(*df.columns, "weight", "prediction")
        raised, say = boost_weights(scored, label)
        if say <= 1e-9:
            break
        stumps.append(stump)
        says.append(say)
        if say > 10:  # no mistakes are left
            break
        rows = raised.drop("prediction")
        if k % 5 == 4:
            rows = staged(rows)
    return AdaptiveBoost(stumps, says)


def stratified_folds(df: DataFrame, keys: Sequence[str], label: str = "label", folds: int = 3, seed: int = 0) -> DataFrame:
    """Fold of each row by a hash seeded with its class, which spreads each class evenly."""
    spread = draw([label, *keys], seed) % folds
    return df.withColumn("fold", spread.cast("int"))


def score(model, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Probability of the positive class per row."""
    return model.transform(df).select(*keys, vector_to_array("probability")[1].alias("probability"))


def train_pipeline(kind: str, df: DataFrame, prepare: Pipeline, keys: Sequence[str], **params) -> PipelineModel:
    """Preparation and classifier as one model that takes raw rows: the preparation is fitted on the rows as they are, the classifier
    on balanced ones."""
    prepared = prepare.fit(df)
    return PipelineModel([*prepared.stages, fit_classifier(kind, oversample(prepared.transform(df), keys), **params)])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def arrears_slice(col: str) -> Column:
    value = F.col(col)
    return F.when(value == 0, "0").when(value.between(1, 90), "1-90").when(value > 90, ">90")


def confusion(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return predictions.groupBy(*by, "label", "prediction").agg(F.count("*").alias("n"))


def evaluate(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class, per slice, in one aggregate."""
    hit, said, true = (F.col("label") == F.col("prediction")), (F.col("prediction") == 1), (F.col("label") == 1)
    sums = predictions.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(hit).alias("_hit"), F.count_if(said & true).alias("_tp"),
        F.count_if(said).alias("_said"), F.count_if(true).alias("positives"),
    )
    precision, recall = F.try_divide(F.col("_tp"), F.col("_said")), F.try_divide(F.col("_tp"), F.col("positives"))
    return sums.select(
        *by, "n", "positives", (F.col("_hit") / F.col("n")).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"),
        F.try_divide(2 * precision * recall, precision + recall).alias("f1"),
    )


def roc_auc(predictions: DataFrame, score_col: str = "probability") -> DataFrame:
    """Area under the ROC curve by the rank formula, ties counting half."""
    from gridlytics.operators.ranks import ranked_values

    ranked = ranked_values(predictions, score_col)
    positives = predictions.filter(F.col("label") == 1).groupBy(F.col(score_col).cast("double").alias("value")).agg(
        F.count("*").alias("p")
    )
    joined = ranked.join(positives, "value", "left").fillna(0, subset=["p"])
    middle = F.col("below") + (F.col("n") + 1) / 2
    sums = joined.agg(
        F.sum(F.col("p") * middle).alias("ranks"), F.sum("p").cast("double").alias("pos"), F.max("total").alias("total")
    )
    negatives = F.col("total") - F.col("pos")
    area = F.try_divide(F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * negatives)
    return sums.select(F.col("pos").cast("long").alias("positives"), negatives.cast("long").alias("negatives"), area.alias("auc"))


def calibration(predictions: DataFrame, bins: int = 20, probability: str = "probability") -> DataFrame:
    """Mean predicted probability and share of positives per equal-width bin."""
    index = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1))
    return predictions.groupBy(index.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(probability).alias("predicted"), F.avg(F.col("label").cast("double")).alias("observed")
    )


def importances(df: DataFrame, model, top: int = 10, features: str = "features") -> DataFrame:
    """Largest feature importances or coefficients with the names kept in the assembled column's metadata."""
    groups = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a["name"] for attrs in groups.values() for a in attrs}
    weights = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    rows = [(names.get(i, f"f{i}"), float(v)) for i, v in enumerate(weights.toArray())]
    rows.sort(key=lambda r: (-abs(r[1]), r[0]))
    return df.sparkSession.createDataFrame(rows[:top], "feature string, weight double")
