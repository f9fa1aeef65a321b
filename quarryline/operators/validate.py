"""The contract of a submission."""

from __future__ import annotations

import csv

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.sources.tables import malformed_rows, round_trip_equal

SCHEMA = "severity string, code string, column string, value double, message string"


class SubmissionInvalid(ValueError):
    pass


def validate_submission(submission: DataFrame, sample: DataFrame, *, key: str, targets: list[str], task: str = "regression", least: float | None = None, most: float | None = None, labels: list[str] | None = None,
                        probabilities: list[str] | None = None, tolerance: float = 1e-6, order: str | None = None, train_scale: float | None = None, extreme_factor: float = 10.0) -> DataFrame:
    """Issues of a submission against its sample: severity, code, column, value, message.

    Per-value checks are one aggregate over the submission; ids are compared by grouped counts and one full outer join. Row order is
    compared only by a column that states it (order), as tables have none.
    """
    found: list[tuple] = []
    say = lambda code, column, value, message, level="error": found.append((level, code, column, None if value is None else float(value), message))
    names, wanted = submission.columns, sample.columns
    if len(set(names)) < len(names):
        say("DUPLICATE_COLUMNS", None, None, "column names repeat")
    if set(names) != set(wanted):
        say("COLUMN_SCHEMA_MISMATCH", None, None, f"columns are {names}, not {wanted}")
    elif names != wanted:
        say("COLUMN_ORDER_MISMATCH", None, None, f"columns are {names}, not {wanted}")
    if key not in names:
        say("ID_COLUMN_MISSING", key, None, "no id column")
        return submission.sparkSession.createDataFrame(found, SCHEMA)
    here = [t for t in targets if t in names]
    number = {t: F.col(t).try_cast("double") for t in here}
    a = {"rows": F.count(F.lit(1)), "no_id": F.count_if(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == ""))}
    for t in here:
        x = number[t]
        a |= {f"{t}|missing": F.count_if(F.col(t).isNull() | F.isnan(F.col(t).try_cast("double"))), f"{t}|text": F.count_if(F.col(t).isNotNull() & x.isNull()), f"{t}|inf": F.count_if(F.abs(x) == float("inf")), f"{t}|k": F.countDistinct(F.col(t))}
        if task == "regression":
            a |= {f"{t}|low": F.count_if(x < least) if least is not None else F.lit(0), f"{t}|high": F.count_if(x > most) if most is not None else F.lit(0)}
            if train_scale:
                a[f"{t}|extreme"] = F.count_if(F.abs(x) > extreme_factor * train_scale)
        elif labels:
            a[f"{t}|label"] = F.count_if(F.col(t).isNotNull() & ~F.col(t).cast("string").isin(labels))
    if probabilities:
        p = [F.col(c).try_cast("double") for c in probabilities]
        total = p[0]
        for x in p[1:]:
            total = total + x
        a |= {"p|range": F.count_if(F.exists(F.array(*p), lambda v: v.isNull() | (v < 0) | (v > 1))), "p|sum": F.count_if(F.abs(total - 1) > tolerance)}
    r = submission.agg(*(v.cast("long").alias(k) for k, v in a.items())).first()
    n = sample.count()
    if r["rows"] != n:
        say("ROW_COUNT_MISMATCH", None, r["rows"], f"{r['rows']} rows, not {n}")
    if r["no_id"]:
        say("MISSING_IDS", key, r["no_id"], "rows without an id")
    repeated = submission.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").count()
    if repeated:
        say("DUPLICATE_IDS", key, repeated, "ids that repeat")
    ids = submission.select(F.col(key).cast("string").alias("_a")).distinct().join(sample.select(F.col(key).cast("string").alias("_b")).distinct(), F.col("_a") == F.col("_b"), "full_outer")
    other = ids.filter(F.col("_a").isNull() | F.col("_b").isNull()).count()
    if other:
        say("ID_SET_MISMATCH", key, other, "ids that only one table has")
    elif order and not repeated:
        moved = submission.select(key, F.col(order).alias("_o")).join(sample.select(key, F.col(order).alias("_p")), key).filter("_o <> _p").count()
        if moved:
            say("ID_ORDER_MISMATCH", key, moved, "ids in other places")
    for t in here:
        if r[f"{t}|missing"]:
            say("MISSING_PREDICTIONS", t, r[f"{t}|missing"], "rows without a prediction")
        if task == "regression":
            for name, code in (("text", "NON_NUMERIC_PREDICTIONS"), ("inf", "INFINITE_PREDICTIONS"), ("low", "PREDICTION_BELOW_MINIMUM"), ("high", "PREDICTION_ABOVE_MAXIMUM")):
                if r[f"{t}|{name}"]:
                    say(code, t, r[f"{t}|{name}"], "rows")
            if train_scale and r[f"{t}|extreme"]:
                say("EXTREME_PREDICTIONS", t, r[f"{t}|extreme"], "rows far above the training scale", "warning")
        elif labels and r[f"{t}|label"]:
            say("UNKNOWN_CLASS_LABELS", t, r[f"{t}|label"], "rows")
        if r["rows"] > 1 and r[f"{t}|k"] == 1:
            say("CONSTANT_PREDICTIONS", t, 1, "all predictions are equal", "warning")
        if t in wanted and not other and not repeated:
            same = submission.select(key, F.col(t).try_cast(sample.schema[t].dataType).alias("_x")).join(sample.select(key, F.col(t).alias("_y")), key).agg(F.bool_and(F.coalesce(F.col("_x").eqNullSafe(F.col("_y")), F.lit(False))).alias("s"), F.count("_y").alias("n")).first()
            if same["s"] and same["n"]:
                say("UNCHANGED_SAMPLE_VALUES", t, same["n"], "the sample's own values", "warning")
    if probabilities:
        for name, code in (("range", "PROBABILITY_OUT_OF_RANGE"), ("sum", "PROBABILITY_SUM_MISMATCH")):
            if r[f"p|{name}"]:
                say(code, None, r[f"p|{name}"], "rows")
    return submission.sparkSession.createDataFrame(found, SCHEMA)


def assert_valid(issues: DataFrame) -> None:
    if bad := [r["code"] for r in issues.filter("severity = 'error'").collect()]:
        raise SubmissionInvalid(", ".join(bad))


def validate_submission_file(spark: SparkSession, path: str, sample: DataFrame, *, key: str, targets: list[str], scratch: str | None = None, **options) -> DataFrame:
    """Issues of a CSV file, before and after it is read: FILE_NOT_FOUND, EMPTY_FILE, MISSING_HEADER, DUPLICATE_COLUMNS, CSV_READ_ERROR
    (bytes that aren't UTF-8), MALFORMED_CSV_ROWS, then those of validate_submission, and CSV_ROUND_TRIP_FAILED where
    scratch names a place to write to. The file is read by Spark only, from any store."""
    issue = lambda code, column, value, message: spark.createDataFrame([("error", code, column, None if value is None else float(value), message)], SCHEMA)
    try:
        lines = spark.read.text(path)
        first = lines.limit(1).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return issue("FILE_NOT_FOUND", None, None, "there is no such file")
        raise
    if not first:
        return issue("EMPTY_FILE", None, None, "the file is empty")
    if not first[0]["value"].strip():
        return issue("MISSING_HEADER", None, None, "the first line is blank")
    broken = lines.filter(~F.is_valid_utf8("value")).count()
    if broken:
        return issue("CSV_READ_ERROR", None, broken, "lines that aren't UTF-8")
    names = next(csv.reader([first[0]["value"].removeprefix("﻿")]))
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        return issue("DUPLICATE_COLUMNS", repeated[0], len(repeated), "column names repeat")
    ragged = malformed_rows(spark, path)
    n = ragged.count()
    if n:
        return issue("MALFORMED_CSV_ROWS", None, n, f"rows with another number of fields than the header, from line {ragged.first()['line']}")
    table = spark.read.option("header", True).csv(path)
    found = validate_submission(table, sample, key=key, targets=targets, **options)
    if scratch and found.filter("severity = 'error'").isEmpty():
        typed = table.select(key, *(F.col(t).try_cast("double").alias(t) if options.get("task", "regression") == "regression" else F.col(t) for t in targets))
        if not round_trip_equal(spark, typed, scratch, key):
            found = found.unionByName(issue("CSV_ROUND_TRIP_FAILED", None, None, "what is written isn't what is read again"))
    return found
