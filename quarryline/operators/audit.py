"""Dataset audit: profiles, identity, duplicates, leaks and drift."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.operators.quantiles import exact_quantiles, quantile_values, quantiles_of_counts

NULL_TOKEN = "<NULL>"
SEVERITIES = ("error", "warning", "info")


def finite(name: str) -> Column:
    """The column as double where it is a finite number, else null."""
    x = F.col(name).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def profile_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column with counts, moments and exact quantiles, all from one pass that counts values."""
    kinds = {f.name: f.dataType for f in df.schema}

    def pair(c: str) -> Column:
        x, whole = F.col(c).try_cast("double"), isinstance(kinds[c], T.IntegralType)
        kind = F.when(F.col(c).isNull(), 2).when(finite(c).isNull(), 1).otherwise(0)
        return F.struct(F.lit(c).alias("column"), kind.alias("kind"), x.alias("x"), (F.col(c).cast("bigint") if whole else F.lit(None).cast("bigint")).alias("whole"))

    counts = df.select(F.explode(F.array(*map(pair, columns))).alias("p")).select("p.*").groupBy("column", "kind", "x", "whole").agg(F.count(F.lit(1)).alias("n"))
    good, x, n = F.col("kind") == 0, F.when(F.col("kind") == 0, F.col("x")), F.col("n")
    sums = counts.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("kind") == 2, n)), F.lit(0)).alias("missing"), F.count_if(F.col("kind") != 2).alias("nunique"), F.coalesce(F.sum(F.when(F.col("kind") == 1, n)), F.lit(0)).alias("non_finite"),
        (F.sum(x * n) / F.sum(F.when(good, n))).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"),
    )
    finite_counts = counts.filter(good)
    spread = finite_counts.join(F.broadcast(sums.select("column", "mean")), "column").groupBy("column").agg(F.sum(n * (F.col("x") - F.col("mean")) ** 2).alias("squares"), F.sum("n").alias("k"))
    spread = spread.select("column", F.when(F.col("k") > 1, F.sqrt(F.col("squares") / (F.col("k") - 1))).otherwise(0.0).alias("std"))
    q = quantiles_of_counts(finite_counts.groupBy("column", "x").agg(F.sum("n").alias("n")), [0.01, 0.25, 0.5, 0.75, 0.99])
    out = sums.join(spread, "column", "left").join(q, "column", "left")
    names = ["rows", "missing", "nunique", "non_finite", "mean", "std", "min", *(F.col("q")[i].alias(c) for i, c in enumerate(("p01", "p25", "median", "p75", "p99"))), "max"]
    return out.select("column", *((F.col(c).cast("double") if isinstance(c, str) else c) for c in names))


def profile_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per text column: missing, blank, distinct, and lengths."""
    pair = lambda c: F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v"))
    values = df.select(F.explode(F.array(*map(pair, columns))).alias("p")).select("p.*")
    n = F.length("v")
    sums = values.groupBy("column").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("v").isNull()).alias("missing"), F.count_if(F.trim("v") == "").alias("blank"), F.avg(n).alias("mean_length"), F.max(n).cast("long").alias("max_length"))
    distinct = values.filter("v is not null").select("column", F.sha2("v", 256).alias("h")).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("nunique"))  # texts themselves aren't shuffled
    q = exact_quantiles(df, {c: F.length(F.col(c).cast("string")) for c in columns}, [0.5, 0.95])
    return sums.join(distinct, "column", "left").join(q, "column", "left").select("column", "rows", "missing", "blank", F.coalesce("nunique", F.lit(0)).alias("nunique"), "mean_length", F.col("q")[0].alias("median_length"), F.col("q")[1].alias("p95_length"), "max_length")


def top_values(df: DataFrame, column: str, most: int = 10) -> DataFrame:
    """The commonest values with their share, a report of `most` rows; ties by value."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(NULL_TOKEN))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    by = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(most)
    return by.join(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("_all")).alias("fraction"))


def semantic_type(df: DataFrame, columns: list[str], forced: dict[str, str] | None = None) -> dict[str, str]:
    """boolean, numeric, datetime, text (median length of 40 or more, or over 100 values) or categorical, per column."""
    kinds = {f.name: f.dataType for f in df.schema}
    out = {c: "boolean" if isinstance(kinds[c], T.BooleanType) else "numeric" if isinstance(kinds[c], T.NumericType) else "datetime" if isinstance(kinds[c], (T.DateType, T.TimestampType)) else "" for c in columns}
    texts = [c for c in columns if not out[c]]
    if texts:
        by = {r["column"]: r for r in profile_text(df, texts).collect()}
        known = {c: by[c]["median_length"] if c in by else None for c in texts}
        out |= {c: "unknown" if known[c] is None else "text" if known[c] >= 40 or by[c]["nunique"] > 100 else "categorical" for c in texts}
    return out | (forced or {})


def drift_ks(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """One row: the two-sample Kolmogorov-Smirnov statistic over all finite values, and the asymptotic p-value.

    Values are counted, summed within ranges, and only the running sums of ranges and of a range's own values are windows:
    no window sees more than a range.
    """
    both = train.select(finite(column).alias("x"), F.lit(1).alias("a")).union(test.select(finite(column), F.lit(0))).filter("x is not null")
    counts = both.groupBy("x").agg(F.sum("a").alias("a"), F.sum(1 - F.col("a")).alias("b"))
    cuts = [float(v) for v in (counts.agg(F.percentile_approx("x", [i / 64 for i in range(1, 64)]).alias("q")).first()["q"] or [])]
    part = sum(((F.col("x") > c).cast("int") for c in sorted(set(cuts))), F.lit(0))
    counts = counts.withColumn("r", part)
    ranges = counts.groupBy("r").agg(F.sum("a").alias("ra"), F.sum("b").alias("rb"))
    order = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    before = ranges.select("r", *(F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"before_{c}") for c in ("ra", "rb")), F.sum("ra").over(whole).alias("n"), F.sum("rb").over(whole).alias("m"))
    inside = Window.partitionBy("r").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs((F.col("before_ra") + F.sum("a").over(inside)) / F.col("n") - (F.col("before_rb") + F.sum("b").over(inside)) / F.col("m"))
    return counts.join(F.broadcast(before), "r").select(gap.alias("gap"), "n", "m").agg(F.max("gap").alias("ks"), F.max("n").alias("n_train"), F.max("m").alias("n_test"))


def ks_p_value(ks: float, n: int, m: int) -> float:
    """Asymptotic two-sided p-value of the statistic."""
    x = ks * math.sqrt(n * m / (n + m))
    return 1.0 if x < 0.2 else min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def drift_psi(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """One row: the population stability index over the deciles of train; null if they give fewer than two bins."""
    q = quantile_values(train, finite(column), [i / 10 for i in range(11)])
    edges = sorted(set(q or []))
    spark = train.sparkSession
    if len(edges) < 3:
        return spark.createDataFrame([(None,)], "psi double")
    bin_of = sum(((finite(column) >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    side = lambda df, n: df.filter(finite(column).isNotNull()).groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias(n))
    bins = spark.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    joined = bins.join(side(train, "a"), "bin", "left").join(side(test, "b"), "bin", "left").fillna(0)
    share = lambda c: F.greatest(F.col(c) / F.sum(c).over(Window.partitionBy()), F.lit(1e-6))
    return joined.select(share("a").alias("l"), share("b").alias("r")).agg(F.sum((F.col("r") - F.col("l")) * F.log(F.col("r") / F.col("l"))).alias("psi"))


def drift_categories(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """One row: total variation between the categories' shares, and how many test rows have a category not in train."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(NULL_TOKEN)).alias("v")
    both = train.select(value, F.lit(1).alias("a")).union(test.select(value, F.lit(0)))
    counts = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum(1 - F.col("a")).alias("b"))
    totals = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    gap = F.abs(F.coalesce(F.try_divide("a", "ta"), F.lit(0.0)) - F.coalesce(F.try_divide("b", "tb"), F.lit(0.0)))
    unseen = F.coalesce(F.sum(F.when(F.col("a") == 0, F.col("b"))), F.lit(0))
    return counts.join(F.broadcast(totals)).agg((F.sum(gap) / 2).alias("total_variation"), unseen.alias("unseen_rows"), F.try_divide(unseen, F.max("tb")).alias("unseen_rate"))


def drift_vocabulary(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """One row: vocabulary sizes and the share of test tokens, and of distinct ones, that train doesn't have."""
    def vocabulary(df: DataFrame, n: str) -> DataFrame:
        return df.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), 0)).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias(n))

    joined = vocabulary(train, "a").join(vocabulary(test, "b"), "t", "full_outer")
    new = F.col("a").isNull()
    return joined.agg(
        F.count("a").alias("train_vocabulary"), F.count("b").alias("test_vocabulary"),
        F.coalesce(F.try_divide(F.sum(F.when(new, F.col("b"))), F.sum("b")), F.lit(0.0)).alias("oov_token_rate"),
        F.coalesce(F.try_divide(F.count_if(new), F.count("b")), F.lit(0.0)).alias("oov_unique_rate"),
    )


def exact_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows that share all columns with another (null equals null), and the groups that they form."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"), F.count(F.lit(1)).alias("duplicate_groups"))


def conflicting_duplicates(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Groups of equal features with more than one target (null is one): the features, rows, targets."""
    return df.groupBy(*features).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.struct(target)).alias("n_targets")).filter("n_targets > 1")


def id_audit(train: DataFrame, test: DataFrame, ids: list[str]) -> DataFrame:
    """One row: rows with a missing id part, rows whose id repeats, test rows whose id is in train."""
    absent = " or ".join(f"`{c}` is null" for c in ids)
    repeats = train.groupBy(*ids).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_id_rows"))
    missing = train.agg(F.count_if(F.expr(absent)).alias("missing_id_rows"))
    known = train.select(*ids).distinct()
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ids]
    overlap = test.alias("t").join(known.alias("k"), same, "left_semi").agg(F.count(F.lit(1)).alias("overlap_rows"))
    return missing.join(repeats).join(overlap)


def target_leaks(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Per numeric feature: clone (equals the target wherever both are), its correlation, and rows that count; one aggregate."""
    per = []
    for c in features:
        both = F.col(c).isNotNull() & F.col(target).isNotNull()
        x, y = F.when(both, F.col(c).cast("double")), F.when(both, F.col(target).cast("double"))
        varied = (F.count(x) >= 20) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        per.append(F.struct(F.lit(c).alias("feature"), F.count(x).alias("n"), F.coalesce(F.bool_and(x == y), F.lit(False)).alias("is_clone"), F.when(varied, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).alias("correlation")))
    return df.agg(F.array(*per).alias("all")).select(F.explode("all").alias("p")).select("p.*")


def purity(df: DataFrame, category: str, target: str) -> DataFrame:
    """One row: rows in categories that repeat, those among them whose category has one target only, and their share."""
    by = df.filter(F.col(category).isNotNull()).groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.struct(target)).alias("k")).filter("n >= 2")
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("repeated_rows"), F.coalesce(F.sum(F.when(F.col("k") == 1, F.col("n"))), F.lit(0)).alias("pure_rows")).withColumn("purity", F.try_divide("pure_rows", "repeated_rows"))


def missingness(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: share missing in train and test, and the difference."""
    def rates(df: DataFrame, name: str) -> DataFrame:
        row = [F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("double")).alias(name)) for c in columns]
        return df.agg(F.array(*row).alias("all")).select(F.explode("all").alias("p")).select("p.*")

    return rates(train, "train_rate").join(rates(test, "test_rate"), "column").withColumn("delta", F.col("test_rate") - F.col("train_rate"))


def schema_differences(train: DataFrame, test: DataFrame, target: str | None = None) -> DataFrame:
    """A row per column that only one table has, or whose type differs: code, column, train_type, test_type."""
    a, b = dict(train.dtypes), dict(test.dtypes)
    rows = [("TEST_MISSING_COLUMNS", c, a[c], None) for c in a if c not in b and c != target]
    rows += [("TEST_EXTRA_COLUMNS", c, None, b[c]) for c in b if c not in a]
    rows += [("DTYPE_MISMATCH", c, a[c], b[c]) for c in a if c in b and a[c] != b[c]]
    return train.sparkSession.createDataFrame(rows, "code string, column string, train_type string, test_type string")


def narrower_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per numeric column, the smallest type that holds all its values: column, type, suggested; one aggregate."""
    kinds = dict(df.dtypes)
    per = []
    for c in columns:
        x = F.col(c)
        if kinds[c] in ("tinyint", "smallint", "int", "bigint"):
            fits = F.lit("bigint")
            for name, bits in (("int", 31), ("smallint", 15), ("tinyint", 7)):
                fits = F.when((F.min(x) >= -(2**bits)) & (F.max(x) < 2**bits), name).otherwise(fits)
        else:
            same = F.bool_and(x.isNull() | F.isnan(x) | (x.cast("float").cast("double") == x.cast("double")))
            fits = F.when(same, "float").otherwise(kinds[c])
        per.append(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), fits.alias("suggested")))
    return df.agg(F.array(*per).alias("all")).select(F.explode("all").alias("p")).select("p.*")


def infer_task(df: DataFrame, target: str) -> str:
    """classification for texts, booleans and whole numbers of few values; else regression."""
    if dict(df.dtypes)[target] in ("string", "boolean"):
        return "classification"
    x = F.col(target).cast("double")
    row = df.agg(F.bool_and(x == F.floor(x)).alias("whole"), F.countDistinct(x).alias("k"), F.count(x).alias("n")).first()
    return "classification" if row["whole"] and row["k"] <= max(20, 0.05 * row["n"]) else "regression"


def audit(train: DataFrame, test: DataFrame, *, target: str | None = None, ids: list[str] | None = None, missing_rate: float = 0.3, missing_delta: float = 0.1, drift: float = 0.2, unseen: float = 0.1, oov: float = 0.15) -> DataFrame:
    """Findings: severity, code, column, value, message, by severity, then code, then column.

    Thresholds are settings; each finding's statistic is one of this module's operators over all rows.
    """
    ids = ids or []
    found: list[tuple] = [("error" if r["code"] != "TEST_EXTRA_COLUMNS" else "warning", r["code"], r["column"], None, f"{r['train_type']} and {r['test_type']}") for r in schema_differences(train, test, target).collect()]
    say = lambda level, code, column, value, text: found.append((level, code, column, None if value is None else float(value), text))
    if ids:
        row = id_audit(train, test, ids).first()
        for code, name in (("ID_MISSING", "missing_id_rows"), ("ID_DUPLICATE", "duplicate_id_rows"), ("TRAIN_TEST_ID_OVERLAP", "overlap_rows")):
            if row[name]:
                say("error", code, ids[0], row[name], f"{row[name]} rows")
    kinds_of = dict(test.dtypes)
    features = [c for c, kind in train.dtypes if kinds_of.get(c) == kind and c not in ids and c != target]
    kinds = semantic_type(train, features)
    numeric = [c for c in features if kinds[c] == "numeric"]
    if target is None:
        say("info", "TARGET_NOT_CONFIGURED", None, None, "no target is named")
    else:
        if target in test.columns:
            say("error", "TARGET_PRESENT_IN_TEST", target, None, "test holds the target")
        row = train.agg(F.count_if(F.col(target).isNull()).alias("missing"), F.countDistinct(target).alias("k"), F.count_if(F.col(target).isNotNull() & finite(target).isNull()).alias("odd")).first()
        if row["missing"]:
            say("error", "TARGET_MISSING", target, row["missing"], "rows without a target")
        if row["k"] <= 1:
            say("error", "TARGET_CONSTANT", target, row["k"], "the target has one value")
        task = infer_task(train, target)
        if task == "regression" and row["odd"]:
            say("error", "TARGET_NONFINITE", target, row["odd"], "targets that aren't finite numbers")
        if task == "classification":
            rare = train.groupBy(target).count().filter("count < 5").count()
            if rare:
                say("warning", "RARE_TARGET_CLASSES", target, rare, "classes with fewer than 5 rows")
            for c in (c for c in features if kinds[c] == "categorical"):
                p = purity(train, c, target).first()
                if p["repeated_rows"] >= max(20, 0.1 * train.count()) and p["purity"] >= 0.98:
                    say("warning", "CATEGORICAL_TARGET_MAPPING", c, p["purity"], "categories give the class away")
        if numeric and dict(train.dtypes)[target] != "string":
            for r in target_leaks(train, target, numeric).collect():
                if r["is_clone"] and r["n"]:
                    say("error", "TARGET_CLONE_FEATURE", r["feature"], 1.0, "equals the target")
                elif r["correlation"] is not None and abs(r["correlation"]) >= 0.995:
                    say("warning", "NEAR_PERFECT_TARGET_CORRELATION", r["feature"], r["correlation"], "correlates with the target")
        if features:
            n = conflicting_duplicates(train, features, target).count()
            if n:
                say("warning", "CONFLICTING_DUPLICATE_TARGETS", target, n, "equal features with different targets")
    if features:
        n = exact_duplicates(train, [c for c in train.columns if c not in ids]).first()["duplicate_rows"]
        if n:
            say("warning", "EXACT_DUPLICATE_ROWS", None, n, "rows that repeat")
        n = exact_duplicates(train, features).first()["duplicate_rows"]
        if n:
            say("info", "DUPLICATE_TRAIN_FEATURES", None, n, "rows whose features repeat")
        same = [F.col(f"t.{c}").eqNullSafe(F.col(f"k.{c}")) for c in features]
        n = test.alias("t").join(train.select(*features).distinct().alias("k"), same, "left_semi").count()
        if n:
            say("warning", "TRAIN_TEST_FEATURE_OVERLAP", None, n, "test rows whose features are in train")
        for r in missingness(train, test, features).collect():
            if max(r["train_rate"] or 0, r["test_rate"] or 0) >= missing_rate:
                say("warning", "HIGH_MISSING_RATE", r["column"], r["train_rate"], "many values are missing")
            if abs(r["delta"] or 0) >= missing_delta:
                say("warning", "MISSINGNESS_DRIFT", r["column"], r["delta"], "missing shares differ")
        distinct = train.agg(*(F.countDistinct(c).alias(c) for c in features)).first()
        for c in features:
            if distinct[c] <= 1:
                say("warning", "CONSTANT_COLUMN", c, distinct[c], "one value or none")
            elif kinds[c] == "numeric":
                ks = drift_ks(train, test, c).first()["ks"]
                if (ks or 0) >= drift:
                    say("warning", "NUMERIC_DRIFT", c, ks, "distributions differ")
            elif kinds[c] == "categorical":
                r = drift_categories(train, test, c).first()
                if (r["total_variation"] or 0) >= drift:
                    say("warning", "CATEGORICAL_DRIFT", c, r["total_variation"], "shares differ")
                if (r["unseen_rate"] or 0) >= unseen:
                    say("warning", "UNSEEN_TEST_CATEGORIES", c, r["unseen_rate"], "test has new categories")
            elif kinds[c] == "text":
                lengths = [df.select(F.length(c).alias("n")) for df in (train, test)]
                ks = drift_ks(*lengths, "n").first()["ks"]
                if (ks or 0) >= drift:
                    say("warning", "TEXT_LENGTH_DRIFT", c, ks, "lengths differ")
                rate = drift_vocabulary(train, test, c).first()["oov_token_rate"]
                if rate >= oov:
                    say("warning", "TEXT_VOCABULARY_DRIFT", c, rate, "test has new words")
    found.sort(key=lambda x: (SEVERITIES.index(x[0]), x[1], x[2] or ""))
    return train.sparkSession.createDataFrame(found, "severity string, code string, column string, value double, message string")


def status(findings: DataFrame) -> str:
    levels = {r["severity"] for r in findings.select("severity").distinct().collect()}
    return "error" if "error" in levels else "warning" if "warning" in levels else "pass"
