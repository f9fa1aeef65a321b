"""Blending, calibration and clamping of predictions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.metrics import row_smape, smape_gradient
from quarryline.operators.quantiles import quantile_values


def clamp(x: Column, floor: float | None = None, ceiling: float | None = None) -> Column:
    out = x
    if ceiling is not None:
        out = F.least(out, F.lit(float(ceiling)))
    if floor is not None:
        out = F.greatest(out, F.lit(float(floor)))
    return F.when(x.isNotNull() & ~F.isnan(x), out)


def check_weights(weights: list[float]) -> list[float]:
    if not weights or min(weights) < -1e-10 or abs(sum(weights) - 1) > 1e-8 or not all(map(math.isfinite, weights)):
        raise ValueError("weights are finite, not negative, and add up to 1")
    w = np.clip(weights, 0, None)
    return (w / w.sum()).tolist()


def blend(columns: list[str], weights: list[float], method: str = "arithmetic", positive_floor: float | None = None) -> Column:
    """Weighted mean of prediction columns, arithmetic or geometric (which needs positive values or a floor)."""
    weights = check_weights(weights)
    if method == "arithmetic":
        terms = [F.col(c) * w for c, w in zip(columns, weights, strict=True)]
    elif method == "geometric":
        lifted = [F.greatest(F.col(c), F.lit(positive_floor)) if positive_floor else F.when(F.col(c) <= 0, F.raise_error(F.lit("geometric means need positive values")).cast("double")).otherwise(F.col(c)) for c in columns]
        terms = [F.log(x) * w for x, w in zip(lifted, weights, strict=True)]
    else:
        raise ValueError("method is arithmetic or geometric")
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total if method == "arithmetic" else F.exp(total)


def gram_matrix(df: DataFrame, columns: list[str], target: str | None = None) -> DataFrame:
    """(i, j, value): sums of products of columns (and of the target, named y), in one aggregate of k squared sums."""
    names = [*columns, *([target] if target else [])]
    cells = [F.struct(F.lit(a if a != target else "y").alias("i"), F.lit(b if b != target else "y").alias("j"), F.sum(F.col(a) * F.col(b)).alias("value")) for i, a in enumerate(names) for b in names[i:]]
    return df.agg(F.array(*cells).alias("all")).select(F.explode("all").alias("c")).select("c.*")


def simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point with weights of 0 and more that add up to 1."""
    u = np.sort(v)[::-1]
    over = u - (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
    k = int(np.nonzero(over > 0)[0][-1])
    return np.maximum(v - (np.cumsum(u)[k] - 1) / (k + 1), 0)


def least_squares_weights(df: DataFrame, columns: list[str], target: str, rounds: int = 20_000) -> list[float]:
    """Simplex weights of least relative squared error: rows are scaled by their target, small ones by a floor. Spark adds up the
    Gram matrix; the driver solves its k by k problem."""
    floor = (quantile_values(df.filter(F.col(target) != 0), F.abs(F.col(target)), [0.5]) or [1.0])[0]
    scale = F.greatest(F.abs(F.col(target)), F.lit(1e-3 * floor))
    scaled = df.select(*((F.col(c) / scale).alias(c) for c in columns), (F.col(target) / scale).alias("_y"))
    g = {(r["i"], r["j"]): r["value"] for r in gram_matrix(scaled, columns, "_y").collect()}
    at = lambda a, b: g.get((a, b), g.get((b, a), 0.0))
    gram, rhs = np.array([[at(a, b) for b in columns] for a in columns]), np.array([at(a, "y") for a in columns])
    w, momentum, t = np.full(len(columns), 1 / len(columns)), np.full(len(columns), 1 / len(columns)), 1.0
    step = 1 / max(np.linalg.eigvalsh(gram)[-1], 1e-12)
    for _ in range(rounds):
        new = simplex(momentum - step * (gram @ momentum - rhs))
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        momentum, t = new + (t - 1) / t_new * (new - w), t_new
        if np.abs(new - w).max() < 1e-14:
            break
        w = new
    return w.tolist()


@dataclass(frozen=True)
class Weights:
    method: str
    weights: list[float]
    smape: float


def optimize_weights(df: DataFrame, columns: list[str], target: str, *, rounds: int = 25, floor: float | None = None, ceiling: float | None = None) -> Weights:
    """The simplex weights of least SMAPE among uniform, single models, least squares, and descents from each of them.

    All starts take a step together: a round is one aggregate over the rows for every start's score and gradient.
    """
    k = len(columns)
    starts = {"uniform": [1 / k] * k, "least_squares": least_squares_weights(df, columns, target)} | {f"single:{c}": [float(c == d) for d in columns] for c in columns}
    best = dict(starts)
    score: dict[str, float] = {}
    now, step = {n: np.array(w) for n, w in starts.items()}, dict.fromkeys(starts, 0.2)
    y = F.col(target)
    for i in range(rounds):
        aggregates = []
        for n, w in now.items():
            p = clamp(blend(columns, simplex(w).tolist()), floor, ceiling)
            slope = smape_gradient(y, p, floor, ceiling)
            aggregates += [F.avg(row_smape(y, p)).alias(f"{n}|"), *(F.avg(slope * F.col(c)).alias(f"{n}|{c}") for c in columns)]
        row = df.agg(*aggregates).first()
        for n, w in now.items():
            value = row[f"{n}|"]
            if value < score.get(n, math.inf):
                score[n], best[n] = value, simplex(w).tolist()
            else:
                step[n] /= 2
            g = np.array([row[f"{n}|{c}"] for c in columns])
            now[n] = simplex(np.array(best[n]) - step[n] * g / max(np.abs(g).max(), 1e-12) / (1 + i / 10))
    name = min(score, key=lambda n: (score[n], n))
    return Weights(name, best[name], score[name])


def effective_models(weights: list[float]) -> float:
    """exp of the weights' entropy."""
    return math.exp(-sum(w * math.log(w) for w in weights if w > 0))


def multiplier_scores(df: DataFrame, target: str, prediction: str, alphas: list[float], floor: float | None = None, ceiling: float | None = None) -> DataFrame:
    """(alpha, smape) of given multipliers. Each task pairs its rows with them and adds up by multiplier; what is shuffled is a
    sum for each multiplier and task."""
    pairs = df.select(F.col(target).alias("y"), F.col(prediction).alias("p"), F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))
    return pairs.groupBy("alpha").agg(F.avg(row_smape(F.col("y"), clamp(F.col("p") * F.col("alpha"), floor, ceiling))).alias("smape"))


def alpha_grid(df: DataFrame, target: str, prediction: str, *, low: float = 0.5, high: float = 2.0, points: int = 129, floor: float | None = None, ceiling: float | None = None) -> DataFrame:
    """(alpha, smape) over a logarithmic grid."""
    return multiplier_scores(df, target, prediction, [low * (high / low) ** (i / (points - 1)) for i in range(points)], floor, ceiling)


def best_multiplier(df: DataFrame, target: str, prediction: str, *, tolerance: float = 1e-10, **limits) -> float:
    """The multiplier of least SMAPE: the grid's three best points, each refined in its bracket by golden sections; 1 if no better."""
    rows = sorted(alpha_grid(df, target, prediction, **limits).collect())
    alphas, values = [r["alpha"] for r in rows], [r["smape"] for r in rows]
    if not values or values[0] is None:
        return 1.0
    order = sorted(range(len(rows)), key=lambda i: (values[i], abs(alphas[i] - 1)))[:3]

    def score(xs: list[float]) -> list[float]:
        by = {r["alpha"]: r["smape"] for r in multiplier_scores(df, target, prediction, sorted(set(xs)), limits.get("floor"), limits.get("ceiling")).collect()}
        return [by[x] for x in xs]

    found = [(values[i], alphas[i]) for i in order]
    brackets = [(alphas[max(i - 1, 0)], alphas[min(i + 1, len(alphas) - 1)]) for i in order]
    while max(b - a for a, b in brackets) > tolerance:  # each pass divides all brackets by 16
        xs = [a + (b - a) * j / 32 for a, b in brackets for j in range(33)]
        s = score(xs)
        for k in range(len(brackets)):
            part = list(zip(s[33 * k : 33 * k + 33], xs[33 * k : 33 * k + 33], strict=True))
            value, x = min(part)
            found.append((value, x))
            width = (brackets[k][1] - brackets[k][0]) / 32
            brackets[k] = (x - width, x + width)
    one = score([1.0])[0]
    value, alpha = min(found)
    return alpha if value < one else 1.0


def cross_fitted(df: DataFrame, fold: str, fit, apply) -> DataFrame:
    """fit on the other folds' rows, apply to each fold's own; the folds' union."""
    out = None
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
        part = apply(df.filter(F.col(fold) == k), fit(df.filter(F.col(fold) != k)))
        out = part if out is None else out.unionByName(part)
    return out


def aggregate_folds(columns: list[str], method: str = "mean") -> Column:
    """Mean, median or geometric mean (values raised to 1e-12; 0 if all are 0) of the folds' predictions."""
    x = F.array(*(F.col(c).cast("double") for c in columns))
    n = len(columns)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    if method == "mean":
        return total / n
    if method == "median":
        s = F.sort_array(x)
        return (s[(n - 1) // 2] + s[n // 2]) / 2
    if method == "geometric":
        logs = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.log(F.greatest(v, F.lit(1e-12))))
        return F.when(F.forall(x, lambda v: v == 0), 0.0).otherwise(F.exp(logs / n))
    raise ValueError("method is mean, median or geometric")
