"""Fitted blends and calibrations with what is known of them, and reports in JSON and HTML."""

from __future__ import annotations

import html
import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.metrics import row_smape
from quarryline.operators.align import evaluated
from quarryline.operators.blend import best_multiplier, blend, clamp, cross_fitted, effective_models, gram_matrix, optimize_weights


@dataclass
class Fitted:
    """What was fitted, its score on the rows fitted on and on rows that each fold left out, and further numbers."""

    kind: str
    columns: list[str]
    weights: list[float]
    alpha: float
    score: float
    cross_fitted_score: float | None
    details: dict = field(default_factory=dict)


def _score(df: DataFrame, y: str, p) -> float | None:
    return df.agg(F.avg(row_smape(F.col(y), p))).first()[0]


def pruned(weights: list[float], least: float) -> list[float]:
    """Weights below the least are dropped and the others raised to a sum of 1; the largest always stays."""
    kept = [w if w >= least or w == max(weights) else 0.0 for w in weights]
    return [w / sum(kept) for w in kept]


def matrix_diagnostics(df: DataFrame, columns: list[str]) -> dict:
    """Means, correlations, and the condition of the correlations, from one aggregate of products."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in columns)).first()
    means = {c: row[c] or 0.0 for c in columns}
    centred = df.select(*((F.col(c) - means[c]).alias(c) for c in columns))
    g = {(r["i"], r["j"]): r["value"] or 0.0 for r in gram_matrix(centred, columns).collect()}
    m = np.array([[g.get((a, b), g.get((b, a), 0.0)) for b in columns] for a in columns])
    spread = np.sqrt(np.maximum(np.diag(m), 1e-300))
    correlations = m / np.outer(spread, spread)
    low, high = np.linalg.eigvalsh(correlations)[[0, -1]]
    return {"rows": row["n"], "means": means, "correlations": correlations.round(6).tolist(), "condition": float(high / max(low, 1e-12)), "rank": int(np.linalg.matrix_rank(correlations, tol=1e-8))}


def fit_ensemble(oof: DataFrame, columns: list[str], target: str, fold: str | None = None, *, least_weight: float = 0.0, floor: float | None = None, ceiling: float | None = None) -> Fitted:
    """Weights of the models' out-of-fold predictions on evaluated rows, each model's own score, and the score of weights that were
    fitted without the fold they are applied to."""
    rows = oof.filter(evaluated(F.col(fold))) if fold else oof
    limits = {"floor": floor, "ceiling": ceiling}
    fit = lambda df: pruned(optimize_weights(df, columns, target, **limits).weights, least_weight)
    mixed = lambda w: clamp(blend(columns, w), floor, ceiling)
    chosen = optimize_weights(rows, columns, target, **limits)
    weights = pruned(chosen.weights, least_weight)
    cross = None
    if fold:
        cross = _score(cross_fitted(rows, fold, fit, lambda df, w: df.withColumn("_blend", mixed(w))), target, F.col("_blend"))
    single = {c: _score(rows, target, clamp(F.col(c), floor, ceiling)) for c in columns}
    details = {"method": chosen.method, "single_scores": single, "effective_models": effective_models(weights), "matrix": matrix_diagnostics(rows, columns)}
    return Fitted("ensemble", list(columns), weights, 1.0, _score(rows, target, mixed(weights)), cross, details)


def fit_postprocessor(oof: DataFrame, columns: list[str], target: str, weights: list[float] | None = None, fold: str | None = None, *, least_gain: float = 0.0, floor: float | None = None, ceiling: float | None = None) -> Fitted:
    """A multiplier of the blend that lowers SMAPE, kept only if it gains at least least_gain on rows that its fold left out."""
    rows = oof.filter(evaluated(F.col(fold))) if fold else oof
    weights = weights or [1 / len(columns)] * len(columns)
    ready = rows.withColumn("_blend", blend(columns, weights))
    limits = {"floor": floor, "ceiling": ceiling}
    fit = lambda df: best_multiplier(df, target, "_blend", **limits)
    plain = _score(ready, target, clamp(F.col("_blend"), floor, ceiling))
    alpha, cross = fit(ready), None
    if fold:
        cross = _score(cross_fitted(ready, fold, fit, lambda df, a: df.withColumn("_scaled", clamp(F.col("_blend") * a, floor, ceiling))), target, F.col("_scaled"))
        if cross is not None and plain - cross < least_gain:
            alpha = 1.0
    return Fitted("postprocessor", list(columns), weights, alpha, _score(ready, target, clamp(F.col("_blend") * alpha, floor, ceiling)), cross, {"score_before": plain, "limits": limits})


def apply_fitted(df: DataFrame, fitted: Fitted, name: str = "prediction", floor: float | None = None, ceiling: float | None = None) -> DataFrame:
    return df.withColumn(name, clamp(blend(fitted.columns, fitted.weights) * fitted.alpha, floor, ceiling))


def write_json(spark: SparkSession, path: str, report: Fitted | dict, *, overwrite: bool = False) -> None:
    """One JSON text, all or nothing, in any store that Spark writes to."""
    text = json.dumps(asdict(report) if isinstance(report, Fitted) else report, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r["value"] for r in spark.read.text(path).collect()))


def html_table(df: DataFrame, most: int = 200) -> str:
    """The first rows of a report table as HTML; `most` of them, as it is for reading."""
    cell = lambda v: html.escape("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in df.limit(most).collect())
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def write_html(spark: SparkSession, path: str, title: str, tables: dict[str, DataFrame], *, overwrite: bool = False, most: int = 200) -> None:
    """A page with a section for each table."""
    parts = "".join(f"<h2>{html.escape(n)}</h2>{html_table(t, most)}" for n, t in tables.items())
    page = f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{parts}</body></html>"
    spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)
