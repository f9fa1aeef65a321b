"""Command line: one command for each stage over tables in files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarryline.functions.quantities import physical_specs
from quarryline.operators import audit, reports, residuals, splits, training, validate
from quarryline.sources.tables import load_table, write_table


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarryline", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *arguments: str, **options) -> None:
        c = commands.add_parser(name, help=about)
        for a in arguments:
            c.add_argument(a)
        for a, default in options.items():
            if isinstance(default, bool):
                c.add_argument(f"--{a.replace('_', '-')}", action="store_true")
            elif isinstance(default, list):
                c.add_argument(f"--{a.replace('_', '-')}", nargs="+", default=default)
            else:
                c.add_argument(f"--{a.replace('_', '-')}", type=type(default) if default is not None else str, default=default)
        c.add_argument("--overwrite", action="store_true", help="replace a result that is there")

    command("audit", "findings of a train and a test table", "train", "test", "output", target=None, id=[], html=None)
    command("folds", "a table with folds", "table", "output", id="id", target=None, group=None, time=None, n_splits=5, seed=42)
    command("specs", "a catalog with physical quantities", "table", "output")
    command("train", "out-of-fold predictions", "table", "output", id="id", target="price", numeric=[], categorical=[], text=[], engine="ridge", n_splits=5)
    command("blend", "weights of out-of-fold predictions", "table", "output", target="price", columns=[], fold="fold")
    command("calibrate", "a multiplier of a blend", "table", "output", target="price", columns=[], fold="fold")
    command("errors", "segments, failure modes and overall measures", "table", "output", id="id", target="target", prediction="prediction", category=None, html=None)
    command("validate", "issues of a submission", "submission", "sample", "output", id="id", targets=[], scratch=None)
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    """The command's result is written to its output; 1 if a check fails."""
    table = lambda path: load_table(spark, path)
    write = lambda df: write_table(df, a.output, overwrite=a.overwrite)
    if a.command == "audit":
        found = audit.audit(table(a.train), table(a.test), target=a.target, ids=a.id)
        write(found)
        if a.html:
            reports.write_html(spark, a.html, "Audit", {"Findings": found}, overwrite=a.overwrite)
        return int(audit.status(found) == "error")
    if a.command == "folds":
        df = table(a.table).drop("fold")  # folds are dealt anew
        strategy = splits.resolve_strategy(bool(a.group), bool(a.time), bool(a.target))
        if strategy == "time":
            out = splits.time_folds(df, a.time, n_splits=a.n_splits)
        elif strategy == "kfold":
            out = splits.kfold(df, a.id, n_splits=a.n_splits, seed=a.seed)
        elif strategy == "group":
            out = splits.group_folds(df, a.group, n_splits=a.n_splits, seed=a.seed)
        else:
            regression = audit.infer_task(df, a.target) == "regression"
            strata = splits.regression_strata(df, a.target, n_splits=a.n_splits)[0] if regression else splits.class_strata(df, a.target, n_splits=a.n_splits)
            out = splits.stratified_group_folds(df, a.group, strata, n_splits=a.n_splits, seed=a.seed) if a.group else splits.stratified(df, a.id, strata, n_splits=a.n_splits, seed=a.seed)
        write(out)
    elif a.command == "specs":
        write(physical_specs(table(a.table)))
    elif a.command == "train":
        config = training.TrainingConfig(key=a.id, target=a.target, numeric=tuple(a.numeric), categorical=tuple(a.categorical), text=tuple(a.text), engine=a.engine, n_splits=a.n_splits)
        result = training.train_cross_validated(table(a.table), config)
        write(result.oof)
        print(f"{config.metric} {result.score:.6f}")
    elif a.command in ("blend", "calibrate"):
        fit = reports.fit_ensemble if a.command == "blend" else reports.fit_postprocessor
        fitted = fit(table(a.table), a.columns, a.target, fold=a.fold)
        reports.write_json(spark, a.output, fitted, overwrite=a.overwrite)
        print(f"smape {fitted.score:.6f}")
    elif a.command == "errors":
        rows = residuals.row_errors(table(a.table), a.target, a.prediction)
        tables = {"overall": residuals.overall(rows, a.target, a.prediction), "failure modes": residuals.rank_modes(residuals.failure_modes(rows, a.target, a.prediction))}
        if a.category:
            tables["segments"] = residuals.rank_segments(residuals.segment_summary(rows, a.category, key=a.id, target=a.target, prediction=a.prediction))
        write(tables["overall"])
        if a.html:
            reports.write_html(spark, a.html, "Errors", tables, overwrite=a.overwrite)
    else:
        found = validate.validate_submission_file(spark, a.submission, table(a.sample), key=a.id, targets=a.targets, scratch=a.scratch)
        write(found)
        return int(not found.filter(F.col("severity") == "error").isEmpty())
    return 0


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    return run(SparkSession.builder.appName("quarryline").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
