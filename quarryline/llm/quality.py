"""Document quality by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import with_scores
from quarryline.llm.toxicity import held_out, logistic

#: Characters whose share of the text is a feature.
MARKS = "!#$%&*|.,;:?@/\\<>{}[]()=+_-~^\"'`\n\t"
#: Upper bounds of the steps that a share or ratio is compared with.
_STEPS = (0.0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.16, 0.32, 0.64)


def measures(text: str | None) -> list[float]:
    """Ratios between 0 and about 1 that describe a whole text's surface."""
    text = text or ""
    n, words, lines = max(len(text), 1), text.split(), [x for x in text.split("\n") if x.strip()]
    m, k = max(len(words), 1), max(len(lines), 1)
    distinct = set(words)
    out = [text.count(c) / n for c in MARKS]
    out += [
        sum(map(str.isupper, text)) / n,
        sum(map(text.count, "0123456789")) / n,
        len(distinct) / m,
        len(set(lines)) / k,
        min(1.0, n / m / 20),
        min(1.0, math.log1p(len(words)) / 12),
        min(1.0, m / k / 400),
        sum(not w[-1].isalnum() and not w[-2:-1].isalnum() for w in words) / m,
        sum(w.isupper() for w in words) / m,
        sum(map(str.isalpha, words)) / m,
        sum(map(str.istitle, words)) / m,
        sum(len(w) <= 3 for w in words) / m,
        sum(len(w) >= 15 for w in words) / m,
        sum(x[-1:] in ".!?" for x in map(str.rstrip, lines)) / k,
        (sum(map(len, words)) - sum(map(len, distinct))) / n,
        sum(map(str.__eq__, words, words[1:])) / m,
    ]
    return out


N_MEASURES = len(MARKS) + 16
WIDTH = 1 + N_MEASURES * (1 + len(_STEPS))


_UPPER = np.triu_indices(WIDTH)


def features(texts: list[str | None]) -> np.ndarray:
    """Rows of a constant, the measures, and whether each passes each step."""
    x = np.array([measures(t) for t in texts], np.float64).reshape(len(texts), N_MEASURES)
    return np.concatenate([np.ones((len(x), 1)), x, *((x > s).astype(np.float64) for s in _STEPS)], axis=1)


def _moments(positives):
    """Per partition, over all its texts and over its trusted positives: number, sum and sum of squares of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trusted, total = positives.value, np.zeros((2, WIDTH, WIDTH))
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                x = features(part.column("text").to_pylist())
                sure = np.array([d in trusted for d in part.column("doc_id").to_pylist()])
                total[0] += x.T @ x
                total[1] += x[sure].T @ x[sure]
        some = [k for k in (0, 1) if total[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([total[k][_UPPER].tobytes() for k in some], pa.binary())], ["kind", "data"])

    return run


def _add_moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for pdf in batches:
        for kind, data in zip(pdf["kind"], pdf["data"], strict=True):
            total[kind] = total.get(kind, 0) + np.frombuffer(data)
    yield pd.DataFrame({"kind": list(total), "data": [x.tobytes() for x in total.values()]}).astype({"kind": "int32"})


def all_moments(docs: DataFrame, trusted, *, fan_in: int = 32) -> np.ndarray:
    """(2, WIDTH, WIDTH): second moments of all texts, and of those whose ids are trusted, added up by a tree of tasks that
    take fan_in partial sums each, as many levels of it as the partitions need."""
    moments = docs.mapInArrow(_moments(trusted), "kind int, data binary")
    groups = docs.rdd.getNumPartitions()
    while groups > 1:
        groups = -(-groups // fan_in)
        moments = moments.withColumn("part", F.pmod(F.hash("data"), F.lit(groups))).repartition("kind", "part").mapInPandas(_add_moments, "kind int, data binary")
    total = np.zeros((2, WIDTH, WIDTH))
    for row in moments.toLocalIterator():
        total[row["kind"]][_UPPER] += np.frombuffer(bytes(row["data"]))
    return total + np.triu(total, 1).transpose(0, 2, 1)


def estimate_prior(unlabelled: np.ndarray, positive: np.ndarray, *, least_share: float = 0.25, z: float = 2.0) -> float:
    """An upper estimate of the share of positives among the unlabelled, from second moments.

    On any set A, U(A) >= prior * P(A), so the smallest U(A) / P(A) bounds the prior, and reaches it where A holds no
    negatives. The sets are those that one or two of the steps cut out, on either side, whose shares the second moments
    hold; they must hold least_share of the positives, and both shares are taken z standard errors to the safe side.
    """
    n_u, n_p = max(unlabelled[0, 0], 1), max(positive[0, 0], 1)
    steps = np.arange(1 + N_MEASURES, WIDTH)

    def shares(m: np.ndarray, n: float) -> np.ndarray:
        both = m[np.ix_(steps, steps)] / n
        one = np.diag(both)
        return np.stack([both, one[:, None] - both, 1 - one[:, None] - one + both])

    u, p = shares(unlabelled, n_u), shares(positive, n_p)
    high = u + z * np.sqrt(np.maximum(u * (1 - u), 0) / n_u)
    low = p - z * np.sqrt(np.maximum(p * (1 - p), 0) / n_p)
    ratio = np.where((p >= least_share) & (low > 0), high / np.maximum(low, 1e-9), 1.0)
    return float(np.clip(ratio.min(), 0.02, 0.98))


def non_negative_fit(unlabelled: np.ndarray, positive: np.ndarray, prior: float, *, ridge: float = 1e-3, rounds: int = 3000) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk with the squared loss, from second moments (row 0: constant).

    With loss (1 - z)^2 / 4 the risk is prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)); every part is a quadratic form of
    the moments, so it and its gradient are those of all rows. Where the second part is negative its gradient is
    turned around, which takes the weights back to where the estimate is possible.
    """
    n_u, n_p = max(unlabelled[0, 0], 1), max(positive[0, 0], 1)
    su, sp = unlabelled / n_u, positive / n_p
    mean = su[0].copy()
    spread = np.sqrt(np.maximum(np.diag(su) - mean**2, 0))
    mean[0], spread[0] = 0, 1
    live = spread > 1e-6
    shift = np.eye(len(mean))
    shift[:, 0] -= mean
    shift = shift[live] / spread[live][:, None]
    su, sp = shift @ su @ shift.T, shift @ sp @ shift.T
    mu, mp = su[0], sp[0]
    w = np.zeros(len(mu))
    step = 1 / (np.linalg.eigvalsh(su + sp)[-1] + ridge)
    penalty = np.full(len(mu), ridge)
    penalty[0] = 0
    for _ in range(rounds):
        up = prior * (-mp + sp @ w) / 2
        rest = (1 + 2 * mu @ w + w @ su @ w) / 4 - prior * (1 + 2 * mp @ w + w @ sp @ w) / 4
        down = (mu + su @ w) / 2 - prior * (mp + sp @ w) / 2
        w -= step * (up + down + penalty * w if rest >= 0 else -down)
    return shift.T @ w


def scorer(fitted) -> Callable:
    """What with_scores calls in each task."""
    weights, (a, b) = fitted

    def start():
        return lambda texts: (1 / (1 + np.exp(-np.clip(a * (features(texts) @ weights) + b, -500, 500)))).tolist()

    return start


def fit_quality(docs: DataFrame, labels: DataFrame, *, most_positives: int = 20_000, most_judges: int = 5_000, prior: float | None = None):
    """(weights, scale) learnt from all texts of docs as unlabelled, and trusted positives of labels (doc_id, quality).

    Trusted positives are at most most_positives rows labelled 1, by hash: a bound, as their ids are broadcast. The class
    prior is estimated from them and the unlabelled texts (estimate_prior), unless given. All texts enter the unlabelled
    risk, through moments of a fixed size that partitions send. The risk's weights are then put on a scale by a logistic curve over
    at most most_judges rows of each label that weren't trusted positives.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    known = known.withColumn("draw", F.xxhash64("doc_id", F.lit("quality")))
    share = dict(known.groupBy("y").count().collect())

    def ids(y: int, most: int) -> list[int]:
        return [r["doc_id"] for r in known.filter(F.col("y") == y).orderBy("draw", "doc_id").select("doc_id").limit(most).collect()]

    good, bad = ids(1, most_positives + most_judges), ids(0, most_judges)
    n_judges = min(most_judges, len(good) // 4)
    judges = {i: 1 for i in good[:n_judges]} | {i: 0 for i in bad}
    trusted = spark.sparkContext.broadcast(frozenset(good[n_judges:]))
    judged_by = spark.sparkContext.broadcast(judges)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = all_moments(texts, trusted)
    weights = non_negative_fit(total[0], total[1], estimate_prior(total[0], total[1]) if prior is None else prior)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = judged_by.value
        for batch in batches:
            rows = [(t, of[d]) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if d in of]
            g = features([t for t, _ in rows]) @ weights
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.float64()), pa.array([y for _, y in rows], pa.int32())], ["g", "y"])

    seen = texts.mapInArrow(judge, "g double, y int").toPandas()
    if seen["y"].nunique() < 2:
        return weights, (4.0, 0.0)
    y = seen["y"].to_numpy()
    weight = np.where(y == 1, share.get(1, 1) / max(1, (y == 1).sum()), share.get(0, 1) / max(1, (y == 0).sum()))
    a, b = logistic(seen[["g"]].to_numpy(), y, weight)
    return weights, (float(a[0]), b)


def score_quality(docs: DataFrame, fitted) -> DataFrame:
    """Per row of docs: doc_id, score between 0 and 1. A null text is scored as an empty one; every row has a score."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_scores(texts, "score", scorer(fitted)).select("doc_id", "score")


def classify_quality(docs: DataFrame, labels: DataFrame, *, parts: int = 3, part: int = 1, **options) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted (1 if score >= 0.5).

    Labels are learnt only from rows whose crc32 of doc_id as text, modulo parts, isn't part. Labels that are null or
    not 0 or 1 don't count; of repeated labels the lower counts. A null text counts as empty; a null doc_id has no
    label and isn't held out. Without labels of both classes the scale is a fixed one. An empty table gives an empty
    result.
    """
    learnt = labels.filter(~held_out(F.col("doc_id"), parts, part))
    scored = score_quality(docs, fit_quality(docs, learnt, **options))
    return scored.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, *, parts: int = 3, part: int = 1, **options) -> DataFrame:
    """The rows of docs that are scored as good, whole. A score column of docs' own, if it has one, is left alone.

    A null text is scored as an empty one. Null and repeated doc_ids keep their rows, equal texts are judged alike; an
    empty table gives an empty result.
    """
    fitted = fit_quality(docs, labels.filter(~held_out(F.col("doc_id"), parts, part)), **options)
    name = "_quality"
    while name in docs.columns:
        name = f"_{name}"
    return with_scores(docs, name, scorer(fitted)).filter(F.col(name) >= 0.5).drop(name)
