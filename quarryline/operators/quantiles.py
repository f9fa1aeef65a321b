"""Exact quantiles whose state is spread over the cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def value_counts(df: DataFrame, values: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, x, n): how often each value (as double, no nulls) of each named expression occurs."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), x.cast("double").alias("x")) for c, x in values.items()))).alias("p")
    return df.select(*by, pairs).select(*by, "p.column", "p.x").filter("x is not null").groupBy(*by, "column", "x").agg(F.count(F.lit(1)).alias("n"))


def quantiles_of_counts(counts: DataFrame, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, q): the quantiles of counted values, interpolated between neighbours.

    The aggregate of Spark holds all values of a group in one task. Here values are counted, cut into RANGES ranges of about
    equal numbers of distinct values, and only those ranges are ordered that hold a wanted rank, each in a task of its
    own: no task sees more than a range.
    """
    keys, p = [*by, "column"], [float(x) for x in probabilities]
    cuts = counts.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("x", [i / RANGES for i in range(1, RANGES)], 1000)).alias("cuts"), F.sum("n").alias("total"))
    if not by:
        cuts = F.broadcast(cuts)  # a row per expression
    ranged = counts.join(cuts, keys).withColumn("r", F.size(F.filter("cuts", lambda c: c < F.col("x")))).drop("cuts")
    places = F.transform(F.array(*map(F.lit, p)), lambda x: x * (F.col("total") - 1))
    ranks = F.array_distinct(F.flatten(F.transform(places, lambda h: F.array(F.floor(h), F.ceil(h)))))
    upto = Window.partitionBy(*keys).orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy(*keys, "r", "total").agg(F.sum("n").alias("in_range")).withColumn("before", F.sum("in_range").over(upto) - F.col("in_range"))
    wanted = sums.select(*keys, "r", "before", F.filter(ranks, lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("in_range"))).alias("ranks")).filter(F.size("ranks") > 0)
    inside = Window.partitionBy(*keys, "r").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    held = ranged.join(wanted, [*keys, "r"]).withColumn("last", F.col("before") + F.sum("n").over(inside))
    found = held.select(*keys, "total", "x", F.explode(F.filter("ranks", lambda k: (k >= F.col("last") - F.col("n")) & (k < F.col("last")))).alias("rank"))
    by_rank = found.groupBy(*keys, "total").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))  # two entries a probability at most
    low, high = (lambda h: F.element_at("at", F.floor(h))), (lambda h: F.element_at("at", F.ceil(h)))
    return by_rank.select(*keys, F.transform(places, lambda h: low(h) + (h - F.floor(h)) * (high(h) - low(h))).alias("q"))


def exact_quantiles(df: DataFrame, values: dict[str, Column], probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, q): exact quantiles of named expressions; nulls don't count, a group without values has no row."""
    return quantiles_of_counts(value_counts(df, values, by), probabilities, by)


def quantile_values(df: DataFrame, value: Column, probabilities: Sequence[float]) -> list[float] | None:
    """The quantiles of one expression as numbers; None where it has no values."""
    row = exact_quantiles(df, {"x": value}, probabilities).first()
    return list(row["q"]) if row else None
