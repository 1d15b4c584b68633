"""Fitting eviction models on labelled samples."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.model import Model, from_spark
from ..schema import FEATURES, HOLDOUT
from .replay import holdout_auc, label_guard, samples, split


class DegenerateLabels(ValueError):
    """The table can't be trained on."""


@dataclass
class Fitted:
    model: Model
    auc: float
    positive_rate: float
    rows: int
    dropped: int
    importance: list[tuple[str, float]]

    def summary(self) -> str:
        return json.dumps({
            "rows": self.rows, "positive_rate": round(self.positive_rate, 4), "holdout_auc": round(self.auc, 4), "trees": len(self.model.trees), "dropped_censored": self.dropped,
            "top_features": [n for n, _ in self.importance[:5]], "features": len(FEATURES),
        })


def best_round(losses: list[float], patience: int) -> tuple[int, bool]:
    """The round of the least loss before ``patience`` rounds without a smaller one, and whether there were so many."""
    best = 0
    for k, x in enumerate(losses):
        if x < losses[best]:
            best = k
        elif k - best >= patience:
            return best + 1, True
    return best + 1, False


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    gateway = SparkContext._active_spark_context._gateway
    j, jvm = model._java_obj, gateway.jvm
    kept, weights = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n), gateway.new_array(jvm.double, n)
    for k, (tree, weight) in enumerate(zip(model.trees[:n], model.treeWeights, strict=False)):
        kept[k], weights[k] = tree._java_obj, float(weight)
    out = jvm.org.apache.spark.ml.classification.GBTClassificationModel(j.uid(), kept, weights, j.numFeatures(), j.numClasses())
    return GBTClassificationModel(j.copyValues(out, jvm.org.apache.spark.ml.param.ParamMap.empty()))


def fit(rows: DataFrame, trees: int = 20, depth: int = 5, seed: int = 1, holdout: float = HOLDOUT, patience: int = 0) -> Fitted:
    """Gradient-boosted trees on the kept rows of ``replay.samples``, split by time; the holdout is not used in fitting trees.

    patience: of ``trees`` rounds at most, those up to the holdout's least log loss count, once so many rounds brought no smaller one;
    0: all. Spark's own stop knows no patience, so twice the rounds are fitted until the loss has stopped falling.
    """
    kept = rows.where("kept")
    placed = split(kept.select(*FEATURES, "y", "snapshot_us", "ordinal"), holdout)
    guard = label_guard(placed).first()
    if guard["verdict"] != "ok":
        raise DegenerateLabels(f"{guard['verdict']}: {guard['rows']} rows, positive rate {guard['positive_rate']}")
    data = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(placed).select("x", F.col("y").cast("double").alias("y"), "train")
    gbt = GBTClassifier(featuresCol="x", labelCol="y", maxDepth=depth, stepSize=0.1, minInstancesPerNode=50, subsamplingRate=0.8, validationTol=0.0, seed=seed)
    rounds = min(trees, 3 * patience) if patience else trees
    while True:
        model = gbt.fit(data.where("train"), {gbt.maxIter: rounds})
        if not patience:
            break
        best, stopped = best_round(model.evaluateEachIteration(data.where("NOT train")), patience)
        if stopped or rounds == trees:
            model = first_trees(model, best)
            break
        rounds = min(trees, 2 * rounds)
    scored = model.transform(data.where("NOT train")).select(F.col("y").cast("int").alias("y"), vector_to_array("probability")[1].alias("score"))
    auc = holdout_auc(scored).first()["auc"]
    ranked = sorted(zip(FEATURES, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])
    dropped = rows.where("NOT kept").count()
    return Fitted(from_spark(model), float(auc), float(guard["positive_rate"]), int(guard["rows"]), dropped, ranked)


def train(trace: DataFrame, boundary_us: int, **options) -> Fitted:
    from ..functions.scalars import boundary_seconds

    boundary_seconds(boundary_us)  # refused before anything is read
    return fit(samples(trace, boundary_us), **options)
