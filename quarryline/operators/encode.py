"""Target encodings and imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.quantiles import exact_quantiles

MISSING = "__MISSING__"


def _category(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(MISSING))


def _value(target: str, transform: str) -> Column:
    if transform not in ("log1p", "none"):
        raise ValueError("transform is log1p or none")
    y = F.col(target).cast("double")
    wrong = y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")) | ((y < 0) if transform == "log1p" else F.lit(False))
    return F.when(wrong, F.raise_error(F.lit("targets are finite, and not negative for log1p")).cast("double")).otherwise(F.log1p(y) if transform == "log1p" else y)


def full_encoding(train: DataFrame, column: str, target: str, *, smoothing: float = 10.0, transform: str = "log1p") -> DataFrame:
    """(category, code): the smoothed mean of the transformed target, (n mean + m G) / (n + m)."""
    t = train.select(_category(column).alias("category"), _value(target, transform).alias("y"))
    g = t.agg(F.avg("y").alias("g"))
    by = t.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    return by.join(F.broadcast(g)).select("category", ((F.col("s") + smoothing * F.col("g")) / (F.col("n") + smoothing)).alias("code"), "g")


def apply_encoding(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """df with te_<column>; categories not seen in training get the overall mean. The mapping joins as Spark sees fit: it is
    broadcast only while it is small."""
    overall = codes.agg(F.first("g").alias("_g"))
    keyed = codes.select(F.col("category").alias("_c"), "code")
    joined = df.join(keyed, _category(column) == F.col("_c"), "left").join(F.broadcast(overall))
    return joined.withColumn(f"te_{column}", F.coalesce("code", "_g").cast("float")).drop("_c", "code", "_g")


def out_of_fold_encoding(df: DataFrame, columns: list[str], target: str, *, fold: str = "fold", smoothing: float = 10.0, transform: str = "log1p", temporal: bool = False) -> DataFrame:
    """df with te_<column>: each row is coded without its own fold (temporal: from earlier folds only).

    No loop over folds: with the sums of a category and of a category in a fold, and the overall ones, the code is
    ((S_c - s_cf) + m G_f) / (N_c - n_cf + m) where G_f = (S - s_f) / (N - n_f); without other rows it is G_f. The category
    sums come from the category-by-fold sums, so the rows are read and combined once for each column.
    """
    if df.filter(F.col(fold).isNull()).limit(1).count() or df.select(fold).distinct().limit(2).count() < 2:
        raise ValueError("folds are two at least, and never null")
    y = _value(target, transform)
    folds = df.groupBy(F.col(fold).alias("_f")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"))
    other = (F.col("b._f") < F.col("a._f")) if temporal else (F.col("b._f") != F.col("a._f"))
    around = folds.alias("a").join(F.broadcast(folds.alias("b")), other, "left").groupBy("a._f").agg((F.sum("b.s") / F.sum("b.n")).alias("_g")).withColumnRenamed("_f", "_gf")
    out = df.join(F.broadcast(around), F.col(fold) == F.col("_gf"), "left").drop("_gf")
    for c in columns:
        cells = df.groupBy(_category(c).alias("_c"), F.col(fold).alias("_f")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"))
        if temporal:  # a category's sums over earlier folds
            earlier = Window.partitionBy("_c").orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
            rest = cells.select("_c", "_f", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n"), F.sum("s").over(earlier).alias("_s"))
        else:
            whole = cells.groupBy("_c").agg(F.sum("n").alias("_nc"), F.sum("s").alias("_sc"))
            rest = cells.join(whole, "_c").select("_c", "_f", (F.col("_nc") - F.col("n")).alias("_n"), (F.col("_sc") - F.coalesce("s", F.lit(0.0))).alias("_s"))
        code = F.when(F.col("_n") == 0, F.col("_g")).otherwise((F.col("_s") + smoothing * F.col("_g")) / (F.col("_n") + smoothing))
        joined = out.join(rest, (_category(c) == F.col("_c")) & (F.col(fold) == F.col("_f")), "left")
        out = joined.withColumn(f"te_{c}", code.cast("float")).drop("_c", "_f", "_n", "_s")
    return out.drop("_g")


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians; 0 where a column has no value."""
    found = {r["column"]: r["q"][0] for r in exact_quantiles(df, {c: F.col(c) for c in columns}, [0.5]).collect()}
    return {c: found.get(c, 0.0) for c in columns}


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.fillna(values)


def missing_flags(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with a 0/1 column per {column: flag}; null and blank are missing."""
    return df.withColumns({flag: (F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).cast("byte") for c, flag in columns.items()})
