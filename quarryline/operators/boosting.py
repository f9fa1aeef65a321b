"""Boosted trees on the smooth stand-ins of the metrics, with row weights and early stopping."""

from __future__ import annotations

import uuid

from pyspark.ml import Estimator
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.metrics import row_smape, surrogate

OBJECTIVES = ("squared", "log_smape", "raw_smape", "log_mape", "raw_mape")


def slopes(objective: str, y: Column, p: Column) -> tuple[Column, Column]:
    """(gradient, curvature) of an objective."""
    return (p - y, F.lit(1.0)) if objective == "squared" else surrogate(objective, y, p)


def loss(objective: str, y: Column, p: Column) -> Column:
    """What early stopping watches: a row's squared error, SMAPE or MAPE, of exponentials where the objective is of logarithms."""
    if objective == "squared":
        return (p - y) * (p - y)
    if objective.startswith("log_"):
        y, p = F.expm1(y), F.greatest(F.expm1(p), F.lit(0.0))
    return row_smape(y, p) if objective.endswith("smape") else F.abs(p - y) / F.greatest(F.abs(y), F.lit(1e-8))


class BoostedTrees(Estimator):
    """Newton boosting: each round fits a tree to -gradient / curvature, weighted by curvature, and adds it at the learning rate.

    Rows whose `validation` column is true aren't learnt from; where there are some, the rounds end once their mean loss hasn't
    fallen for `patience` rounds, and the trees up to the best are kept. weight names a column of row weights of 0 or more.
    Each round's scores are cut in the session's checkpoint folder, so that no plan grows with the rounds. The model is
    Spark's own of boosted trees, whose first tree is the constant that the rounds start from.
    """

    def __init__(self, *, features: str = "_features", label: str = "_label", prediction: str = "_raw", objective: str = "squared", rounds: int = 100, rate: float = 0.1, depth: int = 5, least_rows: int = 1, patience: int = 20, weight: str | None = None, validation: str | None = None, seed: int = 42):
        super().__init__()
        if objective not in OBJECTIVES:
            raise ValueError(f"objective is one of {', '.join(OBJECTIVES)}")
        if rounds < 1 or not 0 < rate <= 1 or patience < 1:
            raise ValueError("rounds and patience are 1 at least, and the rate is above 0 and at most 1")
        self.features, self.label, self.prediction, self.objective, self.rounds, self.rate = features, label, prediction, objective, rounds, rate
        self.depth, self.least_rows, self.patience, self.weight, self.validation, self.seed = depth, least_rows, patience, weight, validation, seed
        self.losses: list[float] = []

    def _tree(self, depth: int, i: int) -> DecisionTreeRegressor:
        return DecisionTreeRegressor(featuresCol=self.features, labelCol="_step", weightCol="_curve", predictionCol="_tree", maxDepth=depth, minInstancesPerNode=self.least_rows, seed=self.seed + i)

    def _fit(self, df: DataFrame) -> GBTRegressionModel:
        held = F.coalesce(F.col(self.validation), F.lit(False)) if self.validation else F.lit(False)
        weight = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        rows = df.select(self.features, F.col(self.label).cast("double").alias("_y"), held.alias("_held"), weight.alias("_w"))
        if not rows.filter(~F.coalesce((F.col("_w") >= 0) & (F.col("_w") < float("inf")), F.lit(False))).isEmpty():
            raise ValueError("weights are finite numbers of 0 or more")
        base = rows.filter("not _held").agg(F.sum(F.col("_y") * F.col("_w")) / F.sum("_w")).first()[0]
        if base is None:
            raise ValueError("there are no rows to learn from")
        now = rows.withColumn("_m", F.lit(float(base))).checkpoint()
        constant = self._tree(0, 0).fit(now.filter("not _held").withColumns({"_step": F.lit(float(base)), "_curve": F.lit(1.0)}))
        trees, best, score = [constant], 0, None
        self.losses = []
        for i in range(1, self.rounds + 1):
            gradient, curve = slopes(self.objective, F.col("_y"), F.col("_m"))
            learn = now.filter("not _held and _w > 0").withColumns({"_step": -gradient / curve, "_curve": curve * F.col("_w")})
            tree = self._tree(self.depth, i).fit(learn)
            trees.append(tree)
            now = tree.transform(now).withColumn("_m", F.col("_m") + self.rate * F.col("_tree")).drop("_tree").checkpoint()
            if not self.validation:
                continue
            mean = now.filter("_held").agg(F.avg(loss(self.objective, F.col("_y"), F.col("_m")))).first()[0]
            if mean is None:
                continue
            self.losses.append(mean)
            if score is None or mean < score:
                best, score = i, mean
            elif i - best >= self.patience:
                break
        kept = trees[: 1 + best] if score is not None else trees
        return _ensemble(df, kept, [1.0] + [self.rate] * (len(kept) - 1), self.features, self.prediction)


def _ensemble(df: DataFrame, trees: list, weights: list[float], features: str, prediction: str) -> GBTRegressionModel:
    sc = df.sparkSession.sparkContext
    jvm, gateway = sc._jvm, sc._gateway
    array = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    shares = gateway.new_array(jvm.double, len(trees))
    for i, (t, w) in enumerate(zip(trees, weights, strict=True)):
        array[i], shares[i] = t._java_obj, float(w)
    model = GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"boosted_{uuid.uuid4().hex[:12]}", array, shares))
    model._resetUid(model._java_obj.uid())
    return model.setFeaturesCol(features).setPredictionCol(prediction)
