"""Residual analysis: row errors, segments, failure modes and the worst rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.metrics import row_smape
from quarryline.operators.quantiles import exact_quantiles, quantile_values

MISSING = "<MISSING>"
#: Signals in product text.
MULTIPACK = r"(?iU)\b(?:pack|set|case|bundle|lot)\s+of\s+\d+\b|\b\d+\s*[x×]\s*\d+\b|\b\d+\s*(?:pack|packs|pcs|pieces)\b"
CURRENCY = r"(?iU)(?:₹|\$|€|£)|\b(?:rs\.?|inr|usd|eur|gbp)\b"
UNIT = r"(?iU)\b\d+(?:\.\d+)?\s*(?:mg|g|kg|ml|l|litre|liter|oz|lb|cm|mm|m)\b"
#: The failure modes, in this order.
FAILURE_MODES = ("severe_underprediction", "severe_overprediction", "near_zero_prediction", "negative_prediction", "has_multipack_signal", "has_currency_signal", "has_unit_signal")


def row_errors(df: DataFrame, target: str = "target", prediction: str = "prediction") -> DataFrame:
    """df with residual, abs_error, log_error, row_smape."""
    y, p = F.col(target), F.col(prediction)
    return df.withColumns({"residual": p - y, "abs_error": F.abs(p - y), "log_error": F.abs(F.log1p(F.greatest(p, F.lit(0.0))) - F.log1p(y)), "row_smape": row_smape(y, p)})


def price_tier(df: DataFrame, target: str = "target", cuts: tuple[float, float] | None = None) -> DataFrame:
    """df with price_tier: cheap up to the lower cut, luxury from the upper one, else mid; cuts are exact thirds unless given."""
    if cuts is None:
        cuts = tuple(quantile_values(df, F.col(target), (1 / 3, 2 / 3)) or (0.0, 0.0))
    low, high = cuts
    tier = F.lit("mid") if low >= high else F.when(F.col(target) <= low, "cheap").when(F.col(target) >= high, "luxury").otherwise("mid")
    return df.withColumn("price_tier", tier)


def brand_tier(df: DataFrame, brand: str) -> DataFrame:
    """df with brand_tier by how many rows a brand has: singleton, rare to 5, medium to 20, frequent; missing if blank.

    Counts are joined back, so that a frequent brand's rows needn't meet in one task.
    """
    name = F.when(F.trim(F.col(brand).cast("string")) != "", F.trim(F.col(brand).cast("string")))
    sizes = df.groupBy(name.alias("_b")).agg(F.count(F.lit(1)).alias("_n")).filter("_b is not null")
    n = F.col("_n")
    tier = F.when(name.isNull(), "missing").when(n == 1, "singleton").when(n <= 5, "rare").when(n <= 20, "medium").otherwise("frequent")
    return df.join(sizes, name == F.col("_b"), "left").withColumn("brand_tier", tier).drop("_b", "_n")


def text_signals(text: Column) -> dict[str, Column]:
    """Flags for multipack, currency and unit words, the word count, and its tier (bounds 0, 10, 30, 100)."""
    s = F.coalesce(text.cast("string"), F.lit(""))
    n = F.regexp_count(s, F.lit(r"(?U)\b\w+\b"))
    tier = F.when(n == 0, "empty").when(n <= 10, "short").when(n <= 30, "medium").when(n <= 100, "long").otherwise("very_long")
    return {"has_multipack": s.rlike(MULTIPACK), "has_currency": s.rlike(CURRENCY), "has_unit": s.rlike(UNIT), "n_words": n, "text_tier": tier}


def segment_summary(df: DataFrame, segment: str, *, key: str, target: str = "target", prediction: str = "prediction", least: int = 20) -> DataFrame:
    """Per segment value: 17 statistics of its rows' errors; df comes from row_errors."""
    y, p, s, a = F.col(target), F.col(prediction), F.col("row_smape"), F.col("abs_error")
    total = df.agg(F.count(F.lit(1)).alias("_rows"), F.sum("abs_error").alias("_sum"))
    rows = df.withColumn("segment", F.coalesce(F.col(segment).cast("string"), F.lit(MISSING)))
    quantiles = exact_quantiles(rows, {"s": s, "a": a, "y": y}, (0.5, 0.9, 0.95), by=["segment"]).groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("column", "q"))).alias("_q"))
    q = lambda name, i: F.col("_q")[name][i]
    by = rows.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("target_mean"), F.avg(p).alias("prediction_mean"), F.avg(p - y).alias("bias"), F.avg(a).alias("mae"),
        F.sqrt(F.avg((p - y) * (p - y))).alias("rmse"), F.avg(s).alias("smape"),
        (F.stddev_samp(s) / F.sqrt(F.count(F.lit(1)))).alias("smape_std_error"), F.sum(a).alias("_a"), F.avg((p < y).cast("double")).alias("underprediction_rate"),
        F.min_by(F.col(key), F.struct(-s, F.col(key))).alias("worst_id"),
    ).join(quantiles, "segment", "left")
    by = by.withColumns({"target_median": q("y", 0), "median_row_smape": q("s", 0), "p90_row_smape": q("s", 1), "p95_abs_error": q("a", 2)})
    out = by.join(F.broadcast(total)).withColumns({"share_rows": F.col("n") / F.col("_rows"), "share_abs_error": F.coalesce(F.try_divide("_a", "_sum"), F.lit(0.0)), "eligible": F.col("n") >= least})
    return out.drop("_a", "_rows", "_sum", "_q")


def rank_segments(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc("eligible"), F.desc("smape"), F.desc("n"), "segment")


def failure_modes(df: DataFrame, target: str = "target", prediction: str = "prediction", text: Column | None = None, *, floor: float = 1.0, near_zero: float = 1.0) -> DataFrame:
    """Per failure mode: rows, share, smape, mae, and the share of its rows whose smape reaches the 0.9 quantile of all.

    df comes from row_errors. The modes overlap, so flags are unpivoted. A mode without rows has count 0, prevalence 0 and
    null measures. The signals are those of text (none without one). See rank_modes for their order.
    """
    y, p, s = F.col(target), F.col(prediction), F.col("row_smape")
    signals = text_signals(F.lit("") if text is None else text)
    flags = (y > 0) & (p < 0.5 * y), p > 2.0 * F.greatest(y, F.lit(floor)), p <= near_zero, p < 0, signals["has_multipack"], signals["has_currency"], signals["has_unit"]
    cut = exact_quantiles(df, {"s": s}, [0.9]).select(F.col("q")[0].alias("_cut"))
    total = df.agg(F.count(F.lit(1)).alias("_rows"))
    named = F.explode(F.filter(F.array(*(F.when(c, n) for n, c in zip(FAILURE_MODES, flags, strict=True))), lambda x: x.isNotNull()))
    hit = df.select(named.alias("mode"), s.alias("s"), F.col("abs_error").alias("a")).join(F.broadcast(cut))
    by = hit.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("smape"), F.avg("a").alias("mae"), F.avg((F.col("s") >= F.col("_cut")).cast("double")).alias("share_top_decile_errors"))
    modes = df.sparkSession.createDataFrame([(m,) for m in FAILURE_MODES], "mode string")
    out = modes.join(F.broadcast(by), "mode", "left").join(F.broadcast(total))
    return out.select("mode", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide("n", "_rows"), F.lit(0.0)).alias("prevalence"), "smape", "mae", "share_top_decile_errors")


def rank_modes(modes: DataFrame) -> DataFrame:
    """Failure modes by falling smape, empty ones last."""
    return modes.orderBy(F.desc_nulls_last("smape"), "mode")


def overall(df: DataFrame, target: str = "target", prediction: str = "prediction", *, floor: float = 1.0) -> DataFrame:
    """One row of measures over all rows; df comes from row_errors."""
    y, p, s, a = F.col(target), F.col(prediction), F.col("row_smape"), F.col("abs_error")
    rate = lambda c: F.avg(c.cast("double"))
    relative = a / F.greatest(F.abs(y), F.lit(floor))
    sums = df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(s).alias("smape"), F.avg(a).alias("mae"), F.sqrt(F.avg((p - y) * (p - y))).alias("rmse"), F.avg(p - y).alias("bias"), rate(p < y).alias("underprediction_rate"),
        rate(p > y).alias("overprediction_rate"), rate(p == y).alias("exact_prediction_rate"), rate(relative <= 0.1).alias("within_10_percent_rate"), rate(relative <= 0.2).alias("within_20_percent_rate"),
    )
    q = exact_quantiles(df, {"a": a, "s": s}, (0.5, 0.9, 0.95, 0.99)).agg(F.map_from_entries(F.collect_list(F.struct("column", "q"))).alias("q"))
    names = {"median_abs_error": ("a", 0), "p90_abs_error": ("a", 1), "p95_abs_error": ("a", 2), "p99_abs_error": ("a", 3), "p90_row_smape": ("s", 1)}
    return sums.join(F.broadcast(q)).withColumns({n: F.col("q")[c][i] for n, (c, i) in names.items()}).drop("q")


def worst_rows(df: DataFrame, key: str, most: int = 50) -> DataFrame:
    """The `most` worst rows, a report, with error_rank; ties by the further errors, then by key."""
    order = [F.desc("row_smape"), F.desc("abs_error"), F.desc("log_error"), F.col(key)]
    return df.orderBy(*order).limit(most).withColumn("error_rank", F.row_number().over(Window.orderBy(*order)))
