"""Cross-validated training, the fold store, inference and tuning."""

from __future__ import annotations

import hashlib
import json
import math
import random
from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.metrics import get_metric
from quarryline.functions.text import combined_text
from quarryline.operators.blend import aggregate_folds, clamp
from quarryline.operators.boosting import BoostedTrees
from quarryline.operators.encode import medians
from quarryline.operators.splits import iter_folds
from quarryline.operators.text_features import RareOneHot, TfIdf, UnitScale
from quarryline.sources.tables import require_columns, require_unique_ids


@dataclass(frozen=True)
class TrainingConfig:
    """What a run is made of; its values and the data's hash are the run's signature."""

    key: str = "id"
    target: str = "price"
    fold: str = "fold"
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    engine: str = "ridge"  # ridge, logistic, gbt, boosted
    objective: str = "squared"  # of boosted: squared, log_smape, raw_smape, log_mape, raw_mape
    weight: str | None = None  # a column of row weights, for all engines
    metric: str = "smape"
    n_splits: int = 5
    temporal: bool = False
    log_target: bool = True
    strength: float = 4.0
    words: bool = True
    chars: bool = True
    most_words: int = 120_000
    most_chars: int = 120_000
    least_documents: int = 2
    floor: float | None = 0.0
    ceiling: float | None = None
    seed: int = 42
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.engine not in ("ridge", "logistic", "gbt", "boosted"):
            raise ValueError("engine is ridge, logistic, gbt or boosted")
        if self.n_splits < 2 or self.strength <= 0:
            raise ValueError("folds are 2 at least, and strength is above 0")
        if not (self.numeric or self.categorical or self.text):
            raise ValueError("no features are named")
        if forbidden := {"objective", "eval_metric", "device", "featuresCol", "labelCol"} & set(self.params):
            raise ValueError(f"parameters that the run sets itself: {sorted(forbidden)}")


def run_signature(train: DataFrame, config: TrainingConfig) -> str:
    """SHA-256 of the settings and of the rows, whatever their order."""
    row = train.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*train.columns)).alias("x"), F.sum(F.xxhash64(*train.columns).cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(json.dumps([asdict(config), str(row["n"]), str(row["x"]), str(row["s"])], sort_keys=True).encode()).hexdigest()


def prepare(df: DataFrame, config: TrainingConfig, fill: dict[str, float]) -> DataFrame:
    """Numbers with medians for missing ones, categories with <MISSING>, texts joined behind their markers."""
    numbers = {c: F.coalesce(F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")), F.lit(fill.get(c, 0.0))) for c in config.numeric}
    categories = {c: F.coalesce(F.col(c).cast("string"), F.lit("<MISSING>")) for c in config.categorical}
    text = {"_text": combined_text(df, list(config.text))} if config.text else {}
    return df.withColumns(numbers | categories | text)


def feature_stages(config: TrainingConfig) -> list:
    """TF-IDF of words and pairs of words and of runs of characters in words, categories one-hot with a rare class, numbers over their
    deviation. For trees, 20,000 terms of a kind at most."""
    stages, inputs = [], []
    limit = 20_000 if config.engine in ("gbt", "boosted") else max(config.most_words, config.most_chars)
    for kind, used, most in (("words", config.words, config.most_words), ("chars", config.chars, config.most_chars)):
        if config.text and used:
            stages.append(TfIdf("_text", f"_{kind}_v", kind, config.least_documents, min(most, limit)))
            inputs.append(f"_{kind}_v")
    for c in config.categorical:
        stages.append(RareOneHot(c, f"_{c}_v", config.least_documents))
        inputs.append(f"_{c}_v")
    if config.numeric:
        stages += [VectorAssembler(inputCols=list(config.numeric), outputCol="_numbers", handleInvalid="error"), UnitScale("_numbers", "_numbers_v")]
        inputs.append("_numbers_v")
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="_features", handleInvalid="error")]


def estimator(config: TrainingConfig, n: int, spread: float, watched: bool = False):
    """The engine's estimator. For the ridge, Spark scales its penalty by the label's deviation, which is taken back here; for the logistic one the
    penalty is per row. boosted takes rounds, rate, depth and patience as parameters; it stops early on watched rows."""
    weights = {"weightCol": "_weight"} if config.weight else {}
    if config.engine == "ridge":
        return LinearRegression(featuresCol="_features", labelCol="_label", predictionCol="_raw", elasticNetParam=0.0, standardization=False, solver="auto", regParam=config.strength * spread / max(n, 1), **weights, **config.params)
    if config.engine == "logistic":
        return LogisticRegression(featuresCol="_features", labelCol="_label", predictionCol="_raw", elasticNetParam=0.0, standardization=False, regParam=config.strength / max(n, 1), **weights, **config.params)
    if config.engine == "boosted":
        return BoostedTrees(objective=config.objective, weight="_weight" if config.weight else None, validation="_watched" if watched else None, seed=config.seed, **config.params)
    return GBTRegressor(featuresCol="_features", labelCol="_label", predictionCol="_raw", seed=config.seed, **weights, **{"maxIter": 20, "maxDepth": 5} | config.params)


def fit_fold(train: DataFrame, config: TrainingConfig, watched: DataFrame | None = None) -> tuple[PipelineModel, dict[str, float]]:
    """The fold's model and medians. Features are fitted on train only; rows of watched serve early stopping alone."""
    fill = medians(train, list(config.numeric)) if config.numeric else {}
    label = F.log1p(F.col(config.target)) if config.log_target and config.engine != "logistic" else F.col(config.target).cast("double")
    named = {"_label": label, "_watched": F.lit(False)} | ({"_weight": F.col(config.weight).cast("double")} if config.weight else {})
    ready = prepare(train, config, fill).withColumns(named)
    if config.engine == "boosted" and watched is not None:
        features = Pipeline(stages=feature_stages(config)).fit(ready)
        both = features.transform(ready).unionByName(features.transform(prepare(watched, config, fill).withColumns(named | {"_watched": F.lit(True)})))
        return PipelineModel([*features.stages, estimator(config, 0, 1.0, True).fit(both)]), fill
    row = ready.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("_label").alias("s")).first()
    return Pipeline(stages=[*feature_stages(config), estimator(config, row["n"], row["s"] or 1.0)]).fit(ready), fill


def predict_fold(model: PipelineModel, fill: dict[str, float], df: DataFrame, config: TrainingConfig, name: str = "prediction") -> DataFrame:
    """df's key and columns with a prediction (and the probabilities of classes)."""
    out = model.transform(prepare(df, config, fill))
    raw = F.expm1("_raw") if config.log_target and config.engine != "logistic" else F.col("_raw")
    value = raw if config.engine == "logistic" else clamp(raw, config.floor, config.ceiling)
    out = out.withColumn(name, value)
    if config.engine == "logistic":
        out = out.withColumn(f"{name}_probabilities", vector_to_array("probability"))
    extra = [f"{name}_probabilities"] if config.engine == "logistic" else []
    return out.select(*df.columns, name, *extra)


@dataclass
class TrainingResult:
    oof: DataFrame
    test: DataFrame | None
    scores: list[float]
    score: float
    models: list[tuple[PipelineModel, dict[str, float]]]
    signature: str


def train_cross_validated(train: DataFrame, config: TrainingConfig, test: DataFrame | None = None) -> TrainingResult:
    """A model per fold, fitted (with its vocabulary and medians) on the other folds only, or on earlier ones if temporal; predictions of every
    validation row, and the folds' aggregate for test."""
    require_columns(train, [config.key, config.target, config.fold, *config.numeric, *config.categorical, *config.text])
    require_unique_ids(train, config.key)
    parts, models, scores = [], [], []
    metric = get_metric(config.metric)
    for _, fit_on, held in iter_folds(train, n_splits=config.n_splits, fold=config.fold, temporal=config.temporal):
        model, fill = fit_fold(fit_on, config, held)
        predicted = predict_fold(model, fill, held, config)
        models.append((model, fill))
        parts.append(predicted)
        scores.append(predicted.agg(metric.build(F.col(config.target), F.col("prediction"))).first()[0])
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    score = oof.agg(metric.build(F.col(config.target), F.col("prediction"))).first()[0]
    out = predict_with_folds(models, test, config) if test is not None else None
    return TrainingResult(oof, out, scores, score, models, run_signature(train, config))


def predict_with_folds(models: list, df: DataFrame, config: TrainingConfig, method: str = "mean") -> DataFrame:
    """df's key with the folds' predictions (prediction_0 ...) and their aggregate; one chain of projections, no joins."""
    out, names = df, []
    for k, (model, fill) in enumerate(models):
        name = f"prediction_{k}"
        out = predict_fold(model, fill, out, config, name)
        names.append(name)
    if config.engine == "logistic":
        mean = F.transform(F.arrays_zip(*(F.col(f"{n}_probabilities") for n in names)), lambda z: sum((z[f"{n}_probabilities"] for n in names), F.lit(0.0)) / len(names))
        return out.select(config.key, mean.alias("probabilities")).withColumn("prediction", (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("double"))
    return out.select(config.key, *names, aggregate_folds(names, method).alias("prediction"))


class FoldStore:
    """Fold models as Spark pipelines beside a JSON record with the run's signature; paths are of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, fold: int, model: PipelineModel, fill: dict[str, float], signature: str, config: TrainingConfig) -> None:
        model.write().save(f"{self.root}/fold_{fold}/model")
        record = json.dumps({"fold": fold, "signature": signature, "fill": fill, "config": asdict(config)})
        self.spark.createDataFrame([(record,)], "value string").coalesce(1).write.text(f"{self.root}/fold_{fold}/record")

    def load(self, fold: int, signature: str | None = None) -> tuple[PipelineModel, dict[str, float], dict]:
        record = json.loads(self.spark.read.text(f"{self.root}/fold_{fold}/record").first()["value"])
        if record["fold"] != fold or (signature and record["signature"] != signature):
            raise ValueError("the stored fold is of another run")
        return PipelineModel.load(f"{self.root}/fold_{fold}/model"), record["fill"], record


def predict_from_store(store: FoldStore, df: DataFrame, config: TrainingConfig, method: str = "mean") -> DataFrame:
    loaded = [store.load(k) for k in range(config.n_splits)]
    if len({r["signature"] for *_, r in loaded}) > 1 or any(r["config"]["engine"] != config.engine for *_, r in loaded):
        raise ValueError("the stored folds are of different runs")
    return predict_with_folds([(m, f) for m, f, _ in loaded], df, config, method)


def tune(train: DataFrame, config: TrainingConfig, space: dict[str, tuple[float, float]], *, trials: int = 10, seed: int = 42) -> list[dict]:
    """Trials of log-uniform draws from space, best first; a trial stops at a fold where it is worse than the median of earlier trials there."""
    rng, done = random.Random(seed), []
    better = min if not get_metric(config.metric).greater_is_better else max
    metric = get_metric(config.metric)
    frames = [(a.cache(), b.cache()) for _, a, b in iter_folds(train, n_splits=config.n_splits, fold=config.fold, temporal=config.temporal)]
    try:
        for t in range(trials):
            drawn = {k: math.exp(rng.uniform(math.log(a), math.log(b))) for k, (a, b) in space.items()}
            own = TrainingConfig(**{**asdict(config), **{k: v for k, v in drawn.items() if k == "strength"}, "params": config.params | {k: v for k, v in drawn.items() if k != "strength"}})
            scores = []
            for k, (a, b) in enumerate(frames):
                model, fill = fit_fold(a, own)
                scores.append(predict_fold(model, fill, b, own).agg(metric.build(F.col(config.target), F.col("prediction"))).first()[0])
                before = sorted(x["scores"][k] for x in done if len(x["scores"]) > k)
                if len(before) >= 3 and better(scores[-1], before[len(before) // 2]) != scores[-1]:
                    break
            done.append({"trial": t, "params": drawn, "scores": scores, "pruned": len(scores) < len(frames), "score": sum(scores) / len(scores)})
    finally:
        for a, b in frames:
            a.unpersist(), b.unpersist()
    finished = [x for x in done if not x["pruned"]]
    return sorted(finished, key=lambda x: x["score"], reverse=better is max) + [x for x in done if x["pruned"]]
