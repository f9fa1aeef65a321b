"""Operators against hand-made results, invariants and rejections."""

import collections
import hashlib
import math
import re
import time
import unicodedata
from email.utils import formatdate

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quarryline.functions import ids, metrics, text
from quarryline.operators import align, audit, blend, boosting, encode, images, residuals, splits, text_features, training, validate
from quarryline.plans.dag import Runner, Stage
from quarryline.sources import tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def value(df):
    return df.first()[0]


# Metrics


def test_smape_values(spark):
    t = frame(spark, [(10.0, 12.0), (20.0, 15.0), (0.0, 0.0)], "y double, p double")
    assert value(t.agg(metrics.smape(F.col("y"), F.col("p")))) == pytest.approx((2 / 11 + 2 / 7) / 3)
    t = frame(spark, [(0.0, 5.0)], "y double, p double")
    assert value(t.agg(metrics.smape(F.col("y"), F.col("p")))) == 2.0
    t = frame(spark, [(1e-12, 2e-12)], "y double, p double")
    assert value(t.agg(metrics.smape(F.col("y"), F.col("p"), True))) == pytest.approx(200 / 3)


def test_mape_policies(spark):
    t = frame(spark, [(10.0, 12.0), (20.0, 15.0), (50.0, 50.0)], "y double, p double")
    y, p = F.col("y"), F.col("p")
    assert value(t.agg(metrics.mape(y, p))) == pytest.approx(0.15)
    z = frame(spark, [(0.0, 5.0), (10.0, 12.0)], "y double, p double")
    assert value(z.agg(metrics.mape(y, p, "ignore"))) == pytest.approx(0.2)
    with pytest.raises(Exception, match="zeros"):
        z.agg(metrics.mape(y, p, "raise")).collect()


@pytest.mark.parametrize(("y", "p", "macro"), [([0, 1, 1, 2], [0, 1, 0, 2], 7 / 9), (["a", "b", "b"], ["a", "a", "b"], 2 / 3)])
def test_f1(spark, y, p, macro):
    kind = "int" if isinstance(y[0], int) else "string"
    t = frame(spark, list(zip(y, p, strict=True)), f"y {kind}, p {kind}")
    assert metrics.f1_scores(t, "y", "p").first()["f1_macro"] == pytest.approx(macro)


def test_evaluate_rejects(spark):
    with pytest.raises(ValueError):
        metrics.get_metric("nothing")
    for rows in ([(1.0, float("nan"))], [(1.0, None)], [(float("inf"), 1.0)], []):
        with pytest.raises(Exception, match="metrics need rows"):
            metrics.evaluate(frame(spark, rows, "y double, p double"), "y", "p", ["SMAPE", "mae"]).collect()


def test_gradient_is_the_derivative(spark):
    t = frame(spark, [(10.0, 12.0), (20.0, 15.5), (7.0, 3.0)], "y double, p double")
    y, p, h = F.col("y"), F.col("p"), 1e-6
    near = (metrics.row_smape(y, p + h) - metrics.row_smape(y, p - h)) / (2 * h)
    for r in t.select(near.alias("a"), metrics.smape_gradient(y, p).alias("b")).collect():
        assert r["a"] == pytest.approx(r["b"], abs=1e-6)
    assert value(t.select(metrics.smape_gradient(y, p, floor=12.0)).limit(1)) == 0


# Identity


def test_ids(spark):
    t = frame(spark, [(1, 1.0, " a "), (2, 2.5, ""), (3, float("nan"), None)], "i int, d double, s string")
    key = lambda c, mode: [r[0] for r in t.select(ids.canonical_id(F.col(c), t.schema[c].dataType, mode)).collect()]
    assert key("i", "numeric") == ["number:1", "number:2", "number:3"]
    assert key("d", "numeric") == ["number:1", "number:2.5", None]
    assert key("s", "numeric") == ["text:a", None, None]
    assert key("i", "strict")[0] == "int:1" and key("d", "plain")[0] == "1"


# Folds


@pytest.mark.parametrize("n", [101, 5, 7])
def test_kfold_balance(spark, n):
    t = spark.range(n).withColumnRenamed("id", "k")
    f = splits.kfold(t, "k")
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert f.orderBy("k").collect() == splits.kfold(t.orderBy(F.desc("k")), "k").orderBy("k").collect()


def test_stratified_balance(spark):
    t = spark.range(75).select(F.col("id").alias("k"), (F.col("id") >= 50).cast("int").alias("y"))
    rows = splits.stratified(t, "k", F.col("y")).groupBy("fold", "y").count().collect()
    assert {(r["y"], r["count"]) for r in rows} == {(0, 10), (1, 5)}


def test_group_folds(spark):
    t = spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 20).alias("g"))
    f = splits.group_folds(t, "g")
    splits.validate_folds(f, group="g")
    assert {r["count"] for r in f.groupBy("fold").count().collect()} == {12}
    s = splits.stratified_group_folds(t.withColumn("y", (F.col("g") % 2)), "g", F.col("y"))
    splits.validate_folds(s, group="g")
    assert {r["count"] for r in s.groupBy("fold", "y").count().collect()} == {6}


def test_group_folds_are_balanced_over_many_groups(spark):
    # 120,000 groups of one or two rows; one row in 300 is of the rare stratum
    t = spark.range(160_000).select((F.col("id") % 120_000).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(300)) == 0).cast("int").alias("y"))
    for placed in (splits.stratified_group_folds(t, "g", F.col("y")), splits.group_folds(t, "g")):
        assert placed.count() == 160_000 and splits.leaking_groups(placed, "g").isEmpty()
        n = {r["fold"]: r for r in placed.groupBy("fold").agg(F.count("y").alias("rows"), F.sum("y").alias("rare")).collect()}
        assert sorted(n) == [0, 1, 2, 3, 4] and max(r["rows"] for r in n.values()) - min(r["rows"] for r in n.values()) <= 5
    placed = splits.stratified_group_folds(t, "g", F.col("y")).groupBy("fold").agg(F.sum("y").alias("rare")).agg(F.max("rare") - F.min("rare")).first()[0]
    assert placed <= 2


def test_stratified_groups_of_orders(spark, sf):
    t = splits.stratified_group_folds(spark.read.parquet(f"{sf}/orders.parquet"), "o_custkey", F.col("o_orderstatus"))
    largest = t.groupBy("o_custkey").count().agg(F.max("count")).first()[0]
    sizes = t.groupBy("o_orderstatus", "fold").count().groupBy("o_orderstatus").agg(F.count("fold").alias("folds"), (F.max("count") - F.min("count")).alias("gap")).collect()
    assert all(r["folds"] == 5 and r["gap"] <= largest for r in sizes)



def test_time_folds(spark):
    t = spark.range(90).select(F.col("id").alias("k"), F.expr("timestamp'2026-01-01' + make_interval(0,0,0,0,cast(id % 30 as int))").alias("ts"))
    f = splits.time_folds(t, "ts")
    splits.validate_folds(f, temporal=True)
    assert f.groupBy("ts").agg(F.countDistinct("fold").alias("n")).filter("n > 1").isEmpty()
    for k, a, b in splits.iter_folds(f, n_splits=5, temporal=True):
        assert a.agg(F.max("ts")).first()[0] < b.agg(F.min("ts")).first()[0], k


def test_strata_rules(spark):
    t = spark.range(500).select(F.exp(F.col("id") / 100).alias("y"))
    _, bins = splits.regression_strata(t, "y")
    assert bins == 20
    with pytest.raises(splits.InfeasibleStrata):
        splits.regression_strata(spark.range(6).select(F.lit(1.0).alias("y")), "y")
    c = spark.range(23).select((F.col("id") >= 20).cast("int").alias("y"))
    assert {r[0] for r in c.select(splits.class_strata(c, "y")).distinct().collect()} == {"0", "__RARE__"}
    with pytest.raises(splits.InfeasibleStrata):
        splits.class_strata(c, "y", rare="error")


def test_rare_classes_are_looked_up_where_they_are_many(spark):
    rows = [(i, i // 2) for i in range(40)] + [(i, 100) for i in range(40, 50)] + [(i, None) for i in range(50, 53)]
    t = frame(spark, rows, "id int, y int").withColumn("other", F.col("y") + 1)
    want = {i: "100" if y == 100 else "__RARE__" for i, y in rows}
    for most in (1_000, 21, 20, 0):  # 21 classes are rare, null among them
        strata = splits.class_strata(t, "y", most_listed=most)
        d = t.select("id", strata.alias("s"))
        assert {r["id"]: r["s"] for r in d.collect()} == want
        assert {r["s"]: r["n"] for r in t.groupBy(strata.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()} == {"100": 10, "__RARE__": 43}
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan) == (most < 21) and "Broadcast" not in plan
        folds = splits.stratified(t, "id", strata).join(d, "id").groupBy("s").pivot("fold").count().collect()
        assert len(folds) == 2 and all(max(r[1:]) - min(r[1:]) <= 1 for r in folds)
    assert {r["s"] for r in t.select(splits.class_strata(t, "y", n_splits=3, most_listed=0).alias("s")).collect()} == {"100", "__RARE__", None}  # three nulls are enough
    assert {r["s"] for r in t.select(splits.class_strata(t, "y").alias("s")).collect()} == {"100", "__RARE__"}
    many = spark.range(1_500)
    assert " in(id, " in str(splits.class_strata(many, "id", most_listed=1_500))
    assert " in(id, " not in str(splits.class_strata(many, "id"))  # the rare classes aren't in the column
    with pytest.raises(splits.InfeasibleStrata, match="and more"):
        splits.class_strata(t, "y", rare="error")


def test_strategy():
    assert splits.resolve_strategy(False, False, False) == "kfold" and splits.resolve_strategy(True, False, True) == "stratified_group"
    with pytest.raises(ValueError):
        splits.resolve_strategy(True, True, False)


def test_group_labels(spark):
    t = frame(spark, [(1, "a"), (2, "a"), (3, None)], "k int, g string")
    label = lambda m: [r[0] for r in t.select(splits.group_labels(t, ["g"], "k", m)).collect()]
    assert label("unique") == ["g:a", "g:a", "m:3"] and label("together")[2] == "m:"


# Encodings


BRANDS = [("A", 10.0, 0), ("A", 20.0, 1), ("B", 30.0, 0), ("B", 40.0, 1), (None, 25.0, 0), ("A", 25.0, 1)]


def codes(spark, rows, **k):
    t = frame(spark, rows, "brand string, y double, fold int")
    return [r["te_brand"] for r in encode.out_of_fold_encoding(t, ["brand"], "y", transform="none", **k).orderBy("fold", "y").collect()]


def test_own_target_does_not_count(spark):
    changed = [("A", 10_000.0, 0), *BRANDS[1:]]
    at = lambda rows: {(b, f): None for b, _, f in rows}
    a = frame(spark, BRANDS, "brand string, y double, fold int")
    b = frame(spark, changed, "brand string, y double, fold int")
    one = encode.out_of_fold_encoding(a, ["brand"], "y", transform="none").filter("brand = 'A' and fold = 0").first()["te_brand"]
    two = encode.out_of_fold_encoding(b, ["brand"], "y", transform="none").filter("brand = 'A' and fold = 0").first()["te_brand"]
    assert one == two and len(at(BRANDS)) == 5


def test_oof_equals_refit(spark):
    t = frame(spark, [(i, f"c{i % 7}", float(i * i % 31), i % 4) for i in range(200)], "k int, c string, y double, fold int")
    out = {r["k"]: r["te_c"] for r in encode.out_of_fold_encoding(t, ["c"], "y").collect()}
    for k in range(4):
        fit = encode.full_encoding(t.filter(F.col("fold") != k), "c", "y")
        for r in encode.apply_encoding(t.filter(F.col("fold") == k), "c", fit).collect():
            assert out[r["k"]] == pytest.approx(r["te_c"], rel=1e-6)


def test_unseen_category(spark):
    fit = encode.full_encoding(frame(spark, [("A", 20.0), ("B", 30.0)], "b string, y double"), "b", "y", transform="none")
    assert encode.apply_encoding(frame(spark, [("New",)], "b string"), "b", fit).first()["te_b"] == 25.0


def test_encoding_rejects(spark):
    with pytest.raises(ValueError):
        codes(spark, [("A", 1.0, 0)])
    with pytest.raises(ValueError):
        codes(spark, [("A", 1.0, 0), ("A", 1.0, None)])
    with pytest.raises(Exception, match="targets are finite"):
        codes(spark, [("A", None, 0), ("A", 1.0, 1)])


def test_temporal_encoding_looks_back_only(spark):
    t = frame(spark, [(1, "A", 10.0, 0), (2, "A", 99.0, 1), (3, "A", 7.0, 2)], "k int, b string, y double, fold int")
    out = {r["k"]: r["te_b"] for r in encode.out_of_fold_encoding(t, ["b"], "y", transform="none", temporal=True).collect()}
    assert out[1] is None and out[2] == 10.0 and out[3] == pytest.approx(54.5)


def test_medians(spark):
    t = frame(spark, [(1.0, None), (3.0, None), (None, None)], "a double, b double")
    assert encode.medians(t, ["a", "b"]) == {"a": 2.0, "b": 0.0}


# Joins


def test_align(spark):
    a, b = frame(spark, [(1, "x"), (2, "y")], "k int, a string"), frame(spark, [(2, 5), (1, 4)], "k int, b int")
    assert sorted(map(tuple, align.align_exact(a, b, "k").collect())) == [(1, "x", 4), (2, "y", 5)]
    with pytest.raises(ValueError, match="different"):
        align.align_exact(a, b.filter("k = 1"), "k")
    with pytest.raises(ValueError, match="repeated"):
        align.align_exact(a.union(a), b, "k")
    with pytest.raises(ValueError, match="missing"):
        align.align_superset(a, b.filter("k = 1"), "k")
    out = align.attach_features(a, b, "k", "dom")
    assert "dom__b" in out.columns
    with pytest.raises(ValueError, match="numeric"):
        align.attach_features(b, a, "k", "dom")


def test_align_predictions(spark):
    one = frame(spark, [(1, 10.0, "0", 9.0), (2, 20.0, "1", 19.0), (3, 5.0, "test", None)], "id int, y double, fold string, prediction double")
    two = frame(spark, [(2.0, 20.0, "1", 21.0), (1.0, 10.0, "0", 11.0)], "id double, y double, fold string, prediction double")
    out = align.align_predictions({"a": one, "b": two}, "id", "y", "fold")
    assert {(r["id"], r["a"], r["b"]) for r in out.collect()} == {(1, 9.0, 11.0), (2, 19.0, 21.0)}
    with pytest.raises(ValueError, match="targets"):
        align.align_predictions({"a": one, "b": two.withColumn("y", F.col("y") + 1)}, "id", "y", "fold")


# Audit


def test_drift(spark):
    a, b = spark.range(100).select(F.col("id").cast("double").alias("x")), spark.range(100).select((F.col("id") + 100.0).alias("x"))
    assert audit.drift_ks(a, b, "x").first()["ks"] == 1.0
    assert audit.drift_ks(a, a, "x").first()["ks"] == 0.0
    assert audit.ks_p_value(1.0, 100, 100) < 1e-6 and audit.ks_p_value(0.0, 5, 5) == 1.0
    assert audit.drift_psi(a, b, "x").first()["psi"] > 1
    assert audit.drift_psi(spark.range(5).select(F.lit(1.0).alias("x")), a, "x").first()["psi"] is None
    rng = np.random.default_rng(1)
    u, v = rng.normal(size=300), rng.normal(0.3, size=200)
    every = np.r_[u, v]
    known = max(abs((u <= t).mean() - (v <= t).mean()) for t in every)
    f = lambda x: spark.createDataFrame([(float(t),) for t in x], "x double")
    assert audit.drift_ks(f(u), f(v), "x").first()["ks"] == pytest.approx(known)


def test_vocabulary(spark):
    a, b = frame(spark, [("alpha beta known",)], "t string"), frame(spark, [("unseen vocabulary token",)], "t string")
    assert audit.drift_vocabulary(a, b, "t").first()["oov_token_rate"] == 1.0
    assert audit.drift_vocabulary(frame(spark, [("naïve café",)], "t string"), b, "t").first()["train_vocabulary"] == 2


def test_null_equals_null(spark):
    t = frame(spark, [(None, 1), (None, 1), ("a", 2)], "s string, i int")
    assert tuple(audit.exact_duplicates(t, ["s", "i"]).first()) == (2, 1)
    assert audit.conflicting_duplicates(frame(spark, [("a", 1), ("a", None)], "s string, y int"), ["s"], "y").count() == 1


def test_findings(spark):
    n = 100
    train = spark.range(n).select("id", F.lit("same").alias("constant"), (F.col("id") * 1.0).alias("x"), (F.col("id") * 2.0).alias("y"), F.when(F.col("id") % 2 == 0, 1.0).alias("gaps"), F.concat(F.lit("t"), F.col("id") % 3).alias("cat"))
    test = spark.range(n, n + 40).select("id", F.lit("same").alias("constant"), (F.col("id") + 500.0).alias("x"), F.lit(None).cast("double").alias("gaps"), F.lit("new").alias("cat"), F.lit(1).alias("extra"))
    before = train.collect()
    found = audit.audit(train, test.union(test.limit(1)), target="y", ids=["id"])
    got = {r["code"] for r in found.collect()}
    assert {"TEST_EXTRA_COLUMNS", "CONSTANT_COLUMN", "NEAR_PERFECT_TARGET_CORRELATION", "HIGH_MISSING_RATE", "MISSINGNESS_DRIFT", "NUMERIC_DRIFT", "CATEGORICAL_DRIFT", "UNSEEN_TEST_CATEGORIES"} <= got
    assert audit.status(found) == "warning" and train.collect() == before
    bad = audit.audit(train.union(train.limit(2)).withColumn("clone", F.col("y")), test.withColumns({"y": F.lit(1.0), "clone": F.lit(1.0)}).withColumn("x", F.lit("a")), target="y", ids=["id"])
    got = {r["code"] for r in bad.collect()}
    assert {"ID_DUPLICATE", "TARGET_PRESENT_IN_TEST", "TARGET_CLONE_FEATURE", "DTYPE_MISMATCH", "EXACT_DUPLICATE_ROWS", "DUPLICATE_TRAIN_FEATURES"} <= got
    assert audit.status(bad) == "error"
    plain = audit.audit(train.select("id", "x"), test.select("id", "x"))
    assert "TARGET_NOT_CONFIGURED" in {r["code"] for r in plain.collect()}
    flat = audit.audit(train.withColumn("y", F.lit(3.0)), test.select("x"), target="y")
    assert "TARGET_CONSTANT" in {r["code"] for r in flat.collect()}


# Residuals


def test_residuals(spark):
    t = spark.range(120).select(F.col("id").alias("k"), (12 * F.pow(F.lit(200.0), F.col("id") / 119)).alias("target"), F.concat(F.lit("b"), F.col("id") % 3).alias("brand"))
    t = t.withColumn("prediction", F.when(F.col("k").isin(5, 90), F.col("target") * 6).otherwise(F.col("target") * 1.1))
    e = residuals.row_errors(t)
    assert {r["k"] for r in residuals.worst_rows(e, "k", 2).collect()} == {5, 90}
    seg = residuals.segment_summary(residuals.price_tier(e), "price_tier", key="k")
    assert seg.agg(F.sum("n"), F.round(F.sum("share_rows"), 9)).first() == (120, 1.0)
    assert {r["segment"] for r in seg.collect()} == {"cheap", "mid", "luxury"}
    assert {r["brand_tier"] for r in residuals.brand_tier(e, "brand").select("brand_tier").distinct().collect()} == {"frequent"}
    assert residuals.price_tier(t.withColumn("target", F.lit(1.0))).select("price_tier").distinct().first()[0] == "mid"


# Blending


def test_weights_are_recovered(spark):
    t = spark.range(1, 200).select((F.col("id") * 3.0).alias("y")).select("y", (F.col("y") * 0.7).alias("a"), (F.col("y") * 1.1).alias("b"))
    found = blend.optimize_weights(t, ["a", "b"], "y")
    assert found.weights == pytest.approx([0.25, 0.75], abs=1e-4) and found.smape < 1e-4
    assert blend.effective_models([0.5, 0.5]) == pytest.approx(2)


def test_multiplier(spark):
    t = spark.range(1, 100).select((F.col("id") * 1.0).alias("p"), (F.col("id") * 1.25).alias("y"))
    assert blend.best_multiplier(t, "y", "p") == pytest.approx(1.25, abs=1e-6)
    assert blend.best_multiplier(t.select("p", F.lit(0.0).alias("y")), "y", "p") == 1.0


def test_blend_rules(spark):
    for bad in ([0.5, 0.6], [1.5, -0.5], [], [math.nan, 1.0]):
        with pytest.raises(ValueError):
            blend.check_weights(bad)
    t = frame(spark, [(1.0, 4.0)], "a double, b double")
    assert value(t.select(blend.blend(["a", "b"], [0.5, 0.5], "geometric"))) == pytest.approx(2.0)
    assert value(frame(spark, [(float("nan"),)], "a double").select(blend.clamp(F.col("a"), 0, 1))) is None
    z = frame(spark, [(0.0, 0.0, 0.0)], "a double, b double, c double")
    assert value(z.select(blend.aggregate_folds(["a", "b", "c"], "geometric"))) == 0.0


def test_cross_fit(spark):
    t = frame(spark, [(i, i % 3, float(i + 1), (i + 1) / 2) for i in range(30)], "k int, fold int, y double, p double")
    out = blend.cross_fitted(t, "fold", lambda d: blend.best_multiplier(d, "y", "p"), lambda d, a: d.withColumn("q", F.col("p") * a))
    assert out.count() == 30 and out.agg(metrics.smape(F.col("y"), F.col("q"))).first()[0] < 1e-6


# Submission


def test_submission_codes(spark):
    sample = frame(spark, [("001", 0.0), ("002", 0.0), ("003", 0.0)], "ID string, PRICE double")
    check = lambda df, **k: {r["code"] for r in validate.validate_submission(df, sample, key="ID", targets=["PRICE"], **k).collect()}
    good = frame(spark, [("001", 1.0), ("002", 2.0), ("003", 3.0)], "ID string, PRICE double")
    assert check(good, least=0.0) == set()
    validate.assert_valid(validate.validate_submission(good, sample, key="ID", targets=["PRICE"]))
    assert check(sample) == {"CONSTANT_PREDICTIONS", "UNCHANGED_SAMPLE_VALUES"}
    assert {"ID_SET_MISMATCH", "ROW_COUNT_MISMATCH"} <= check(good.filter("ID <> '001'"))
    assert "ID_COLUMN_MISSING" in check(good.drop("ID"))
    assert "COLUMN_ORDER_MISMATCH" in check(good.select("PRICE", "ID"))
    odd = frame(spark, [("001", "x"), ("001", "inf"), (None, None)], "ID string, PRICE string")
    assert {"DUPLICATE_IDS", "MISSING_IDS", "MISSING_PREDICTIONS", "NON_NUMERIC_PREDICTIONS", "INFINITE_PREDICTIONS"} <= check(odd)
    assert {"PREDICTION_ABOVE_MAXIMUM", "EXTREME_PREDICTIONS"} <= check(good, most=2.5, train_scale=0.1)
    p = good.withColumns({"probability_0": F.lit(0.7), "probability_1": F.lit(1.7)})
    assert {"PROBABILITY_OUT_OF_RANGE", "PROBABILITY_SUM_MISMATCH"} <= check(p, probabilities=["probability_0", "probability_1"])
    assert "UNKNOWN_CLASS_LABELS" in check(good, task="classification", labels=["1.0", "2.0"])
    moved = good.withColumn("o", F.col("PRICE") % 3)
    assert "ID_ORDER_MISMATCH" in {r["code"] for r in validate.validate_submission(moved, good.withColumn("o", F.col("PRICE")), key="ID", targets=["PRICE"], order="o").collect()}
    with pytest.raises(validate.SubmissionInvalid):
        validate.assert_valid(validate.validate_submission(odd, sample, key="ID", targets=["PRICE"]))


# Tables


def test_tables(spark, tmp_path):
    t = frame(spark, [("001", 1.5, float("nan")), ("002", None, 2.0)], "id string, a double, b double")
    tables.write_table(t, f"{tmp_path}/x.parquet")
    again = tables.load_table(spark, f"{tmp_path}/x.parquet")
    assert again.filter("b is null").count() == 1
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_table(t, f"{tmp_path}/x.parquet")
    tables.write_table(t.drop("b"), f"{tmp_path}/y.csv")
    assert {r["id"] for r in tables.load_table(spark, f"{tmp_path}/y.csv", text_ids=("id",)).collect()} == {"001", "002"}
    assert tables.round_trip_equal(spark, t.drop("b"), f"{tmp_path}/z.csv", "id")
    with pytest.raises(ValueError):
        tables.load_table(spark, "x.json")
    with pytest.raises(ValueError):
        tables.require_columns(t, ["missing"])
    (tmp_path / "bad.csv").write_text('a,b\n1,2\n1,2,3\n"x,y",2\n')
    assert [tuple(r) for r in tables.malformed_rows(spark, f"{tmp_path}/bad.csv").collect()] == [(3, 3)]
    assert tables.json_parameters('{"engine": "gbt", "model_params": {"maxIter": 3}}', "gbt") == {"maxIter": 3}
    with pytest.raises(ValueError):
        tables.json_parameters('{"engine": "gbt"}', "ridge")


def test_prices(spark):
    t = frame(spark, [("₹1,299.50",), ("Rs. 45",), ("Rs45",), ("0",), ("free",), (None,)], "p string")
    assert [r[0] for r in t.select(tables.parse_price(F.col("p"))).collect()] == [1299.5, 45.0, 45.0, None, None, None]


# Text, images, labels


def test_text(spark):
    t = frame(spark, [("Brand New Watch | 40mm - Waterproof",), ("",), (None,)], "s string")
    rows = t.select(*(c.alias(n) for n, c in text.surface_stats(F.col("s"), "t").items())).collect()
    assert rows[0]["t_char_len"] == 35 and rows[0]["t_word_count"] == 7 and rows[0]["t_delimiters_count"] == 2
    assert rows[1]["t_is_empty"] == rows[2]["t_is_empty"] == 1
    assert value(t.limit(1).select(text.catalog_text(F.lit(" "), F.lit(None)))) == "Unknown Product"
    n = frame(spark, [(" 5O0 m l ",), ("1 . 5 kg",)], "s string")
    assert [r[0] for r in n.select(text.normal_label_text(F.col("s"))).collect()] == ["500 ml", "1.5 kg"]
    lines = frame(spark, [(["NET WT 4 x 100 g", "net wt 4 x 100 G", "Energy 200 kcal 5 g", "hello"],)], "l array<string>")
    assert value(lines.select(text.packaging_lines(F.col("l")))) == "NET WT 4 x 100 g"


def test_label_text(spark):
    cases = {" 5O0 m l ": "500 ml", "1 , 5 k g": "1,5 kg", "75 c l • x": "75 cl x", "OO7 days": "OO7 days", "2×1O0g": "2x1O0g", "a|": "a", "5００ ml": "500 ml"}
    t = frame(spark, [(c,) for c in cases], "s string")
    assert [r[0] for r in t.select(text.normal_label_text(F.col("s"))).collect()] == list(cases.values())
    lines = {
        ("BEST SELLER", "100% satisfaction guaranteed", "Nutrition per 100 g", "NET WT 4 x 100 g"): ("NET WT 4 x 100 g", ["BEST SELLER", "100% satisfaction guaranteed", "Nutrition per 100 g"]),
        ("Special Offer: Pack of 3, Net Wt 500g", "Buy 1 Get 1 Free (250 ml each)"): (": Pack of 3, Net Wt 500 g | pack of 2 (250 ml each)", []),
        ("buy 2 get 1", "Buy 2 & get 1 free"): ("pack of 3", ["buy 2 get 1"]),
        ("65W Fast Charger", "65w fast charger!", None, ""): ("65W Fast Charger", []),
        ("Energy 200 kcal 5 g", "Energy bar, net wt 40 g"): ("Energy bar, net wt 40 g", ["Energy 200 kcal 5 g"]),
    }
    t = frame(spark, [(list(x),) for x in lines] + [(None,)], "l array<string>").select(text.packaging_text(F.col("l")).alias("p")).select("p.*")
    assert [(r["text"], r["rejected"]) for r in t.collect()] == [*lines.values(), ("", [])]


def test_harvest(spark):
    t = frame(spark, [("NET WT 4 x 100 g",), ("Net volume 750 ml",), ("Dimensions: 30 x 20 x 10 cm | 65W Fast Charger | Memory 256 GB",), (None,)], "s string")
    rows = text.harvested(t, "s").collect()
    assert (rows[0]["ocr_weight_g"], rows[0]["ocr_pack_count"], rows[0]["ocr_volume_ml"]) == (400.0, 4.0, None)
    assert (rows[1]["ocr_volume_ml"], rows[1]["ocr_pack_count"]) == (750.0, None)
    assert [rows[2][f"ocr_{n}"] for n in ("dim_length_cm", "dim_width_cm", "dim_height_cm", "power_watts", "storage_gb")] == [30.0, 20.0, 10.0, 65.0, 256.0]
    assert all(v is None for v in rows[3])


def test_alias_stems(spark):
    ids = ["a b", "A B", "CON", "x" * 130, "...", "ok", None]
    got = {r["id"]: r["alias"] for r in images.alias_stems(frame(spark, [(i,) for i in ids], "id string"), "id").collect()}
    head = lambda i: hashlib.sha256(f"str:{i}".encode()).hexdigest()[:12]
    assert got["ok"] == "ok" and got["CON"] == f"CON-{head('CON')}" and got["x" * 130] == f"{'x' * 100}-{head('x' * 130)}"
    assert got["a b"] == f"a_b-{head('a b')}" and got["A B"] == f"A_B-{head('A B')}" and got["..."].startswith("item")


def test_tfidf_equals_plain_counts(spark):
    texts = {1: "Café au lait, café noir", 2: "the big cafe of x y big", 3: "big noir", 4: None, 5: "a b"}
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()

    def words(t):
        w = re.findall(r"\b\w\w+\b", plain(t or ""))
        return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]

    def chars(t):
        out = []
        for w in (f" {x} " for x in (t or "").lower().split()):
            out += [w] if len(w) < 3 else [w[i : i + n] for n in range(3, 6) for i in range(len(w) - n + 1)]
        return out

    d = frame(spark, list(texts.items()), "id int, t string")
    for kind, terms, of in (("words", text_features.word_terms(F.col("t")), words), ("chars", text_features.char_terms(F.col("t")), chars)):
        counts = {i: collections.Counter(of(t)) for i, t in texts.items()}
        df = collections.Counter(x for c in counts.values() for x in c)
        raw = {(i, x): (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[x])) + 1) for i, c in counts.items() for x, n in c.items() if df[x] >= 2}
        norm = {i: math.sqrt(sum(v * v for (k, _), v in raw.items() if k == i)) for i in texts}
        known = {k: v / norm[k[0]] for k, v in raw.items()}
        assert {(r["id"], r["term"]): r["weight"] for r in text_features.tfidf(d, "id", terms).collect()} == pytest.approx(known)
        model = text_features.TfIdf("t", "v", kind).fit(d)
        vocabulary = model.stages[1].vocabulary
        got = {(r["id"], vocabulary[int(i)]): x for r in model.transform(d).collect() for i, x in zip(r["v"].indices, r["v"].values, strict=True)}
        assert got == pytest.approx(known) and set(vocabulary) == {x for _, x in known}
    assert text_features.tfidf(d.limit(0), "id", text_features.word_terms(F.col("t"))).count() == 0


def test_tfidf_broadcasts_no_counts(spark, tmp_path):
    frame(spark, [(1, "red bolt"), (2, "red ring"), (None, "red ring"), (3, None)], "id int, t string").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")  # a small file, whose size Spark takes for that of the counts
    terms = text_features.word_terms(F.col("t"), 1)
    d, few = text_features.tfidf(t, "id", terms), text_features.tfidf(t, "id", terms, most=100)
    assert "BroadcastHashJoin" not in d._jdf.queryExecution().executedPlan().toString()
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Inner, BuildRight" in plan and "BuildLeft" not in plan and sorted(few.collect()) == sorted(d.collect())
    ring, red = math.log(5 / 3) + 1, math.log(5 / 4) + 1  # the row without a key counts
    whole = math.hypot(ring, red)
    assert {(r["id"], r["term"]): r["weight"] for r in d.collect()} == pytest.approx({(1, "red"): 1.0, (2, "red"): red / whole, (2, "ring"): ring / whole})


def test_one_hot_has_a_rare_class(spark):
    t = frame(spark, [(c,) for c in "aaabbcd"], "c string")
    model = text_features.RareOneHot("c", "v", 2).fit(t)
    got = {r["c"]: r["v"].toArray().tolist() for r in model.transform(frame(spark, [(c,) for c in "abcdz"], "c string")).collect()}
    assert got == {"a": [1, 0, 0], "b": [0, 1, 0], "c": [0, 0, 1], "d": [0, 0, 1], "z": [0, 0, 0]}


def test_dense_vectors(spark):
    t = frame(spark, [(1, "red cotton shirt for men"), (2, "red cotton shirt for women"), (3, "steel water bottle one litre"), (4, None), (5, "red cotton shirt for men")], "id int, t string")
    e = {r["id"]: r["embedding"] for r in text_features.hashed_embedding(t, "id", "t", components=128, features=1 << 10).collect()}
    cosine = lambda a, b: sum(x * y for x, y in zip(e[a], e[b], strict=True))
    assert len(e) == 5 and e[4] is None and e[1] == e[5] and cosine(1, 1) == pytest.approx(1)
    assert cosine(1, 2) > 0.4 > cosine(1, 3)
    v = frame(spark, [(i, [float(i), 2.0 * i, (-1.0) ** i * 0.01]) for i in range(8)], "id int, v array<double>")
    model = text_features.fit_projection(v, "v", 2)
    assert model.explainedVariance[0] > 0.99
    assert all(len(r["projected"]) == 2 for r in text_features.project(v, "v", model).collect())
    with pytest.raises(ValueError):
        text_features.fit_projection(v, "v", 9)


def boosting_table(spark, n=300):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (n, 2))
    y = np.exp(1 + x[:, 0] + (x[:, 1] > 0)) - 1
    return frame(spark, [(i, float(a), float(b), float(v), int(i % 3), 0.0 if i % 10 == 0 else 1.0) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, price double, fold int, w double")


@pytest.mark.parametrize("objective", ["squared", "log_smape", "raw_mape"])
def test_boosting_on_surrogates(spark, objective):
    t = boosting_table(spark)
    v = VectorAssembler(inputCols=["a", "b"], outputCol="_features").transform(t.withColumn("_label", F.log1p("price") if objective != "raw_mape" else F.col("price"))).withColumn("_watched", F.col("fold") == 0)
    trees = boosting.BoostedTrees(objective=objective, rounds=25, rate=0.3, depth=3, patience=3, validation="_watched", weight="w")
    model = trees.fit(v)
    out = model.transform(v.filter("_watched"))
    mean = out.agg(F.avg(boosting.loss(objective, F.col("_label"), F.col("_raw")))).first()[0]
    assert mean == pytest.approx(min(trees.losses)) and mean < trees.losses[0]
    assert len(model.trees) == 2 + trees.losses.index(min(trees.losses))
    with pytest.raises(ValueError):
        boosting.BoostedTrees(objective="other")


def test_boosted_engine_with_weights(spark):
    t = boosting_table(spark, 150)
    config = training.TrainingConfig(numeric=("a", "b"), engine="boosted", n_splits=3, weight="w", objective="log_smape", params={"rounds": 8, "rate": 0.4, "depth": 3})
    result = training.train_cross_validated(t, config, t)
    assert result.score < 0.6 and result.oof.count() == result.test.count() == 150


def test_training_on_texts(spark):
    rows = [(i, f"{'silk' if i % 2 else 'cotton'} shirt {i % 7}", "rare" if i == 3 else "usual", 500.0 if i % 2 else 100.0, i % 3) for i in range(60)]
    t = frame(spark, rows, "id int, name string, kind string, price double, fold int")
    config = training.TrainingConfig(text=("name",), categorical=("kind",), n_splits=3, strength=0.1)
    result = training.train_cross_validated(t, config, t)
    assert result.score < 10 and result.oof.count() == result.test.count() == 60


def test_urls(spark):
    urls = ["HTTP://Example.com:80", "https://a.b/x?q=1#f", "ftp://x", "https://u:p@x/", None, "https://h:8443/p"]
    t = frame(spark, [(u,) for u in urls], "u string")
    assert [r[0] for r in t.select(images.normal_url(F.col("u"))).collect()] == ["http://example.com/", "https://a.b/x?q=1", None, None, None, "https://h:8443/p"]
    with pytest.raises(PermissionError):
        images.public_addresses("inner", lambda *_: [(0, 0, 0, "", ("10.0.0.1", 0))])
    with pytest.raises(ValueError):
        images.safe_path("/root/images", "../secret")
    assert images.backoff(0, "7") == 7 and images.backoff(0, "900") == 30


def test_fetch(spark):
    catalog = frame(spark, [("p1", "http://x/a | http://x/b"), ("p2", "http://x/a"), ("p3", "bad"), ("p4", "http://x/404")], "id string, urls string")
    refs = images.image_references(catalog, "id", "urls", 2)
    out = images.fetch_images(refs, lambda url: (404, None, b"") if "404" in url else (200, None, url.encode()), check_host=False)
    got = {(r["id"], r["image_index"]): r["status"] for r in out.collect()}
    assert got == {("p1", 0): "downloaded", ("p1", 1): "downloaded", ("p2", 0): "downloaded", ("p3", 0): "invalid_url", ("p4", 0): "failed"}
    assert images.manifest_summary(out, "id").first()["products_with_image"] == 2
    known = out.filter("status = 'downloaded'").select("url_sha256", "content_sha256", "byte_count").distinct()
    again = images.fetch_images(refs, lambda url: (404, None, b""), known=known, check_host=False)
    assert again.filter("status = 'cached'").count() == 3
    assert images.alias_stems(frame(spark, [("A",), ("a",), ("x y",)], "id string"), "id").filter("alias = 'x_y'").count() == 1


def test_requests_check_every_hop(monkeypatch):
    monkeypatch.setattr(images.socket, "getaddrinfo", lambda host, port: [(0, 0, 0, "", ("10.0.0.1" if host == "inner" else "93.184.216.34", 0))])
    monkeypatch.setattr(images.public_addresses, "__defaults__", (images.socket.getaddrinfo,))
    asked = []

    def fetch(url, address):
        asked.append((url, address))
        return {"http://a/1": (302, "/2", b""), "http://a/2": (301, "https://b/x", b""), "https://b/x": (200, None, b"ok"), "http://a/in": (302, "http://inner/", b""), "http://a/round": (302, "/round", b"")}[url]

    assert images.request(fetch, "http://a/1", True) == (200, None, b"ok")
    assert asked == [(u, "93.184.216.34") for u in ("http://a/1", "http://a/2", "https://b/x")]
    for url in ("http://a/in", "http://a/round", "ftp://a/x"):
        with pytest.raises(PermissionError):
            images.request(fetch, url, True)
    soon = formatdate(time.time() + 12, usegmt=True)
    assert 9 < images.backoff(0, soon) <= 12 and images.backoff(0, formatdate(0, usegmt=True)) == 0 and images.backoff(0, "later") < 2


def test_fold_feasibility(spark):
    t = frame(spark, [(i, i % 3, "a" if i < 3 else "b", float(i % 2), i) for i in range(12)], "id int, g int, c string, price double, t int")
    splits.check_feasible(t, 3, strata=F.col("c"), time="t")
    for n, options in ((4, {"strata": F.col("c")}), (4, {"group": "g"}), (13, {}), (12, {"time": "t"}), (1, {}), (3, {"group": "g", "strata": F.when(F.col("g") > 0, 1).otherwise(0)})):
        with pytest.raises(splits.InfeasibleStrata):
            splits.check_feasible(t, n, **options)
    folds, strategy = splits.stratified_or_kfold(t.withColumn("price", F.lit(1.0)), "id", "price", n_splits=3)
    assert strategy == "kfold" and splits.stratified_or_kfold(t, "id", "t", n_splits=3, bins=3)[1] == "stratified"
    made = splits.fold_metadata(folds, "id", strategy=strategy, n_splits=3, seed=42)
    assert made["rows"] == 12 and made["fold_rows"] == {"0": 4, "1": 4, "2": 4}
    assert made == splits.fold_metadata(folds.orderBy(F.desc("id")), "id", strategy=strategy, n_splits=3, seed=42)


def test_raw_tables_are_checked(spark):
    train = frame(spark, [("1", "a", "u", "5"), ("2", "b", None, "0")], "sample_id string, catalog_content string, image_link string, price string")
    test = train.drop("price").withColumn("sample_id", F.concat(F.lit("t"), "sample_id")).withColumn("n", F.col("sample_id"))
    sample = test.select("sample_id", F.lit(0.0).alias("price"), "n")
    a, b, c = tables.adapt_tables(train, test, sample, order="n")
    assert a.columns[:3] == ["PRODUCT_ID", "PRICE", "TITLE"] and "PRICE" not in b.columns and c.count() == 2
    for bad in ((train.withColumn("price", F.lit("-1")), test, sample), (train.withColumn("price", F.lit("x")), test, sample), (train, test, sample.limit(1)), (train.union(train), test, sample), (train.withColumn("sample_id", F.lit(" ")), test, sample), (train, test, sample.withColumn("n", F.lit("z")))):
        with pytest.raises(ValueError):
            tables.adapt_tables(*bad, order="n")


def test_detections(spark):
    d = "array<struct<text:string,confidence:double,bbox:array<int>,variant:string>>"
    rows = [([("NET WT 500 g", 0.9, [0, 0, 10, 10], "rgb"), ("net wt 500 G", 0.8, [0, 50, 10, 60], "gray"), ("other", 0.7, [0, 0, 10, 10], "rgb"), ("low", 0.1, [0, 90, 1, 91], "rgb")],)]
    out = images.merged_detections(frame(spark, rows, f"detections {d}")).first()["detections"]
    assert [x["text"] for x in out] == ["NET WT 500 g"]


def test_backfill(spark):
    c = frame(spark, [(1, "Rice 1 kg", None, None), (2, "Rice", None, "100 g"), (3, "Rice", "200 g", None)], "id int, TITLE string, PACK_SIZE string, DESCRIPTION string")
    labels = frame(spark, [(1, "5 kg"), (2, "500 g")], "id int, ocr_text string")
    out = {r["id"]: (r["weight_g"], r["weight_g_source"]) for r in images.backfill(c, labels, "id").collect()}
    assert out == {1: (1000.0, "title"), 2: (500.0, "ocr"), 3: (200.0, "pack_size")}
    labels = frame(spark, [(1, "65 W", 7.0), (2, "10 x 5 cm", float("nan"))], "id int, ocr_text string, ocr_weight_g double")
    out = {r["id"]: r for r in images.backfill(c, labels, "id").collect()}
    assert (out[1]["power_watts"], out[1]["power_watts_source"], out[2]["dim_length_cm"], out[2]["weight_g"], out[2]["weight_g_source"]) == (65.0, "ocr", 10.0, 100.0, "description")
    assert (out[3]["storage_gb"], out[3]["storage_gb_source"]) == (None, "missing")


def test_pooling(spark):
    t = frame(spark, [("a", 0, [3.0, 0.0]), ("a", 1, [0.0, 4.0]), ("b", 0, [0.0, 0.0])], "k string, i int, v array<double>")
    out = {r["k"]: r["embedding"] for r in images.pooled(t, "k", "i", "v", "weighted_mean").collect()}
    assert out["b"] is None and math.hypot(*out["a"]) == pytest.approx(1) and out["a"][0] / out["a"][1] == pytest.approx(1.5)


# Training


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(0, 0.1, 60)
    t = frame(spark, [(i, *map(float, x[i]), float(y[i]), i % 2) for i in range(60)], "id int, a double, b double, c double, price double, fold int")
    config = training.TrainingConfig(numeric=("a", "b", "c"), log_target=False, floor=None, n_splits=2, metric="rmse")
    found = training.train_cross_validated(t, config, test=t.limit(3))
    fit = np.array([i % 2 == 1 for i in range(60)])
    x = x / x[fit].std(0)  # numbers are put over their deviation in the rows fitted on
    xa, ya = x[fit] - x[fit].mean(0), y[fit] - y[fit].mean()
    w = np.linalg.solve(xa.T @ xa + 4 * np.eye(3), xa.T @ ya)
    known = (x[~fit] - x[fit].mean(0)) @ w + y[fit].mean()
    got = {r["id"]: r["prediction"] for r in found.oof.filter("fold = 0").collect()}
    assert [got[i] for i in range(0, 60, 2)] == pytest.approx(known, abs=1e-6)
    assert found.test.count() == 3 and found.signature == training.run_signature(t.orderBy(F.desc("id")), config)


def test_store_and_classes(spark, tmp_path):
    t = frame(spark, [(i, "red apple" if i % 3 else "blue sky", float(i % 3 > 0), i % 2) for i in range(40)], "id int, title string, y double, fold int")
    config = training.TrainingConfig(target="y", text=("title",), engine="logistic", n_splits=2, metric="accuracy")
    run = training.train_cross_validated(t, config)
    assert run.score == 1.0
    store = training.FoldStore(spark, f"{tmp_path}/store")
    for k, (m, fill) in enumerate(run.models):
        store.save(k, m, fill, run.signature, config)
    direct = {r["id"]: r["probabilities"] for r in training.predict_with_folds(run.models, t, config).collect()}
    for r in training.predict_from_store(store, t, config).collect():
        assert r["probabilities"] == pytest.approx(direct[r["id"]], abs=1e-12)
    with pytest.raises(ValueError, match="another run"):
        store.load(0, "other")
    with pytest.raises(ValueError):
        training.TrainingConfig(numeric=("a",), params={"objective": "x"})


# Stages


def test_stages(spark, tmp_path):
    calls = []

    def first(s, _):
        calls.append("first")
        return s.range(3)

    def second(s, inputs):
        calls.append("second")
        return inputs["first"].filter("id > 0")

    build = lambda x=1: Runner(spark, str(tmp_path), [Stage("second", second, ("first",)), Stage("first", first, settings={"x": x})])
    assert build().run(dry=True) == {"first": "would run", "second": "would run"} and not calls
    assert build().run() == {"first": "ran", "second": "ran"} and calls == ["first", "second"]
    assert build().run() == {"first": "cached", "second": "cached"}
    assert build(2).run() == {"first": "ran", "second": "ran"}
    assert build(2).run(force=("second",), until="second") == {"first": "cached", "second": "ran"}
    with pytest.raises(ValueError):
        Runner(spark, "x", [Stage("a", first, ("nowhere",))])
