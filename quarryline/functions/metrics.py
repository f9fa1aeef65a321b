"""Metrics as aggregate columns, and training surrogates as row columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_smape(y: Column, p: Column) -> Column:
    """2|p - y| / (|y| + |p|), 0 where both are 0."""
    size = F.abs(y) + F.abs(p)
    return F.when(size == 0, F.lit(0.0)).otherwise(2.0 * F.abs(p - y) / size)


def smape(y: Column, p: Column, percentage: bool = False) -> Column:
    return F.avg(row_smape(y, p)) * (100.0 if percentage else 1.0)


def mape(y: Column, p: Column, zero_policy: str = "epsilon", eps: float = 1e-8, percentage: bool = False) -> Column:
    """Mean |y - p| / |y|; targets of 0 are bounded by eps, ignored, or rejected."""
    scale = 100.0 if percentage else 1.0
    error = F.abs(y - p)
    if zero_policy == "epsilon":
        return F.avg(error / F.greatest(F.abs(y), F.lit(eps))) * scale
    share = F.try_divide(error, F.abs(y))
    if zero_policy == "ignore":
        return F.avg(F.when(y != 0, share)) * scale
    if zero_policy == "raise":
        return F.avg(F.when(y == 0, F.raise_error(F.lit("the target holds zeros")).cast("double")).otherwise(share)) * scale
    raise ValueError("zero_policy is epsilon, ignore or raise")


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def accuracy(y: Column, p: Column) -> Column:
    return F.avg((y == p).cast("double"))


def f1_scores(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: f1_micro, f1_macro, f1_weighted over the labels seen in either column, with 0 for 0 / 0.

    The confusion counts are one grouped aggregate; what follows is as small as the labels are few.
    """
    pairs = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    side = F.explode(F.array(F.struct(F.col("y").alias("label"), F.lit(True).alias("true")), F.struct(F.col("p").alias("label"), F.lit(False).alias("true"))))
    sides = pairs.select("n", (F.col("y") == F.col("p")).alias("hit"), side.alias("s")).select("n", "hit", "s.*")
    by_label = sides.groupBy("label").agg(
        F.sum(F.when(F.col("true"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("true"), F.col("n")).otherwise(0)).alias("guesses"),
        F.sum(F.when(F.col("true") & F.col("hit"), F.col("n")).otherwise(0)).alias("hits"),
    )
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hits"), F.col("support") + F.col("guesses")), F.lit(0.0))
    return by_label.withColumn("f1", f1).agg(
        (F.sum("hits") / F.sum("support")).alias("f1_micro"), F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted")
    )


@dataclass(frozen=True)
class Metric:
    name: str
    build: Callable[[Column, Column], Column]
    greater_is_better: bool = False
    needs: str = "regression"


METRICS = {
    m.name: m
    for m in (
        Metric("smape", smape),
        Metric("smape_percent", lambda y, p: smape(y, p, True)),
        Metric("mape", mape),
        Metric("mape_percent", lambda y, p: mape(y, p, percentage=True)),
        Metric("mae", mae),
        Metric("rmse", rmse),
        Metric("accuracy", accuracy, True, "classification"),
    )
}


def get_metric(name: str) -> Metric:
    """The metric of a name, whatever its case."""
    try:
        return METRICS[name.strip().lower()]
    except KeyError:
        raise ValueError(f"no metric {name!r}; there are {', '.join(METRICS)}") from None


def evaluate(df: DataFrame, y: str, p: str, names: list[str]) -> DataFrame:
    """One row with a column per metric, in one pass. Null or non-finite values, and an empty table, are rejected."""
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    metrics = [get_metric(n) for n in names]
    numbers = all(m.needs == "regression" for m in metrics)
    a, b = F.col(y), F.col(p)
    bad = ~(sound(a.cast("double")) & sound(b.cast("double"))) if numbers else a.isNull() | b.isNull()
    wrong = (F.count(F.lit(1)) == 0) | (F.count_if(bad) > 0)
    guard = F.when(wrong, F.raise_error(F.lit("metrics need rows, without null or non-finite values")).cast("double"))
    return df.agg(*(F.coalesce(guard, m.build(a, b)).alias(m.name) for m in metrics))


#: Floors and widths of the surrogates.
SOFT_WIDTH, CURVATURE_FLOOR, SLOPE_FLOOR = 0.05, 1e-3, 1e-4


def surrogate(kind: str, y: Column, p: Column) -> tuple[Column, Column]:
    """(gradient, curvature) of a smooth stand-in: log_smape, raw_smape, log_mape or raw_mape."""
    d = p - y
    soft = F.tanh(d / SOFT_WIDTH)
    floor = lambda c, least: F.greatest(F.lit(least), c)
    if kind == "log_smape":
        t = F.tanh(F.abs(d) / 2.0)
        slope = floor(1.0 - t * t, SLOPE_FLOOR)
        return soft * slope, floor(slope + 0.01, CURVATURE_FLOOR)
    if kind == "raw_smape":
        size, near = floor(F.abs(p) + F.abs(y), SLOPE_FLOOR), F.sqrt(d * d + 1e-4)
        return 2.0 * (d / near) / size, floor(2.0 / (size * near), CURVATURE_FLOOR)
    if kind == "log_mape":
        d = F.least(F.greatest(d, F.lit(-8.0)), F.lit(8.0))
        return F.tanh(d / SOFT_WIDTH) * F.exp(d), floor(F.exp(d) + 0.01, CURVATURE_FLOOR)
    if kind == "raw_mape":
        size = floor(F.abs(y), SLOPE_FLOOR)
        return soft / size, floor(floor(1.0 - soft * soft, SLOPE_FLOOR) / (SOFT_WIDTH * size), CURVATURE_FLOOR)
    raise ValueError("kind is log_smape, raw_smape, log_mape or raw_mape")


def smape_gradient(y: Column, p: Column, floor: float | None = None, ceiling: float | None = None) -> Column:
    """Derivative of row_smape by the prediction; 0 where the prediction is clipped or both are 0."""
    size = F.abs(y) + F.abs(p)
    slope = 2.0 * (F.signum(p - y) * size - F.abs(p - y) * F.signum(p)) / (size * size)
    free = size > 0
    if floor is not None:
        free = free & (p > floor)
    if ceiling is not None:
        free = free & (p < ceiling)
    return F.when(free, slope).otherwise(0.0)
