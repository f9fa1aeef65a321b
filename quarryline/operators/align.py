"""Strict joins by identity: exact key sets, one row per key, or an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.functions.ids import canonical_id
from quarryline.sources.tables import require_unique_ids

#: Fold markers of rows that aren't scored.
NOT_EVALUATED = ("", "test", "holdout", "heldout", "held_out", "unassigned", "unused", "none", "null", "nan", "na", "n/a")


def evaluated(fold: Column) -> Column:
    """True for rows to score: a number of 0 or more, or a text that isn't a marker."""
    text = F.lower(F.trim(fold.cast("string")))
    number = text.try_cast("double")
    return F.coalesce(F.when(number.isNotNull() & ~F.isnan(number), number >= 0).otherwise(~F.replace(text, F.lit("-"), F.lit("_")).isin(*NOT_EVALUATED)), F.lit(False))


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: key, side. One full outer join of distinct keys."""
    a = left.select(F.col(key).alias("_a")).distinct()
    b = right.select(F.col(key).alias("_b")).distinct()
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer").filter(F.col("_a").isNull() | F.col("_b").isNull())
    return both.select(F.coalesce("_a", "_b").alias(key), F.when(F.col("_b").isNull(), "left").otherwise("right").alias("side"))


def align_exact(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join after checks: unique non-null keys, and the same keys on both sides."""
    for df in (left, right):
        require_unique_ids(df, key)
    if not key_differences(left, right, key).isEmpty():
        raise ValueError(f"the tables hold different {key}s")
    return left.join(right, key)


def align_superset(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join where the right side may hold more keys, but all of the left's."""
    for df in (left, right):
        require_unique_ids(df, key)
    if not left.join(right, key, "left_anti").isEmpty():
        raise ValueError(f"{key}s of the left table are missing on the right")
    return left.join(right, key, "left")


def attach_features(base: DataFrame, features: DataFrame, key: str, prefix: str, fold: str | None = None) -> DataFrame:
    """Numeric features by exact key, each renamed to prefix__name; folds on both sides must agree, infinities are rejected."""
    names = [c for c in features.columns if c not in (key, fold)]
    kinds = {f.name: f.dataType for f in features.schema}
    if wrong := [c for c in names if not isinstance(kinds[c], T.NumericType)]:
        raise ValueError(f"features are numeric, unlike {wrong}")
    if clash := [c for c in names if f"{prefix}__{c}" in base.columns]:
        raise ValueError(f"columns exist already: {clash}")
    if names and not features.filter(" or ".join(f"abs(cast(`{c}` as double)) = double('infinity')" for c in names)).isEmpty():
        raise ValueError("features hold infinities")
    renamed = features.select(key, *([F.col(fold).alias("_fold")] if fold else []), *(F.col(c).alias(f"{prefix}__{c}") for c in names))
    joined = align_exact(base, renamed, key)
    if fold:
        if not joined.filter(~F.col(fold).eqNullSafe(F.col("_fold"))).isEmpty():
            raise ValueError("the tables' folds differ")
        joined = joined.drop("_fold")
    return joined


def align_predictions(tables: dict[str, DataFrame], key: str, target: str, fold: str, prediction: str = "prediction", tolerance: float = 1e-12) -> DataFrame:
    """key, target, fold and a prediction per model, of rows that are evaluated; targets and folds must agree, predictions be finite."""
    out: DataFrame | None = None
    for name, df in tables.items():
        kind = df.schema[key].dataType
        own = df.filter(evaluated(F.col(fold))).select(canonical_id(F.col(key), kind).alias("_key"), key, target, fold, F.col(prediction).cast("double").alias(name))
        if not own.filter(F.col(name).isNull() | F.isnan(name) | (F.abs(name) == float("inf"))).isEmpty():
            raise ValueError(f"{name} holds predictions that aren't finite")
        if out is None:
            require_unique_ids(own, "_key")
            out = own
            continue
        joined = align_exact(out, own.select("_key", F.col(target).alias("_t"), F.col(fold).alias("_f"), name), "_key")
        near = F.abs(F.col(target) - F.col("_t")) <= tolerance + tolerance * F.abs(F.col("_t"))
        if not joined.filter(~near | (F.col(fold).cast("string") != F.col("_f").cast("string"))).isEmpty():
            raise ValueError(f"{name} has other targets or folds")
        out = joined.drop("_t", "_f")
    return out.drop("_key")


def attach_folds(train: DataFrame, folds: DataFrame, key: str, fold: str = "fold") -> DataFrame:
    return align_exact(train, folds.select(key, fold), key)
