"""Submission files, fitted blends with reports, and the command line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline import cli
from quarryline.operators import reports, validate


@pytest.fixture(scope="module")
def oof(spark):
    rng = np.random.default_rng(2)
    y = rng.uniform(10, 100, 120)
    rows = [(i, float(v), float(v * 0.8), float(v * 1.4), int(i % 3) if i else -1) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "id int, price double, a double, b double, fold int").cache()


@pytest.mark.parametrize(
    ("content", "code"),
    [
        (None, "FILE_NOT_FOUND"), (b"", "EMPTY_FILE"), (b"\n1,2\n", "MISSING_HEADER"), (b"id,price,price\n1,2,3\n", "DUPLICATE_COLUMNS"), (b"id,price\n1,\xff\xfe\n", "CSV_READ_ERROR"),
        (b"id,price\n1,2\n2\n", "MALFORMED_CSV_ROWS"), (b"id,price\n1,2\n2,x\n", "NON_NUMERIC_PREDICTIONS"), (b"id,price\n1,2\n3,4\n", "ID_SET_MISMATCH"), (b"id,price\n1,2.5\n2,3.25\n", None),
    ],
)
def test_submission_files(spark, tmp_path, content, code):
    path = tmp_path / "submission.csv"
    if content is not None:
        path.write_bytes(content)
    sample = spark.createDataFrame([("1", 0.0), ("2", 0.0)], "id string, price double")
    issues = validate.validate_submission_file(spark, str(path), sample, key="id", targets=["price"], scratch=f"{tmp_path}/again.csv")
    errors = [r["code"] for r in issues.filter("severity = 'error'").collect()]
    assert code in errors if code else not errors


def test_fitted_blend_and_calibration(spark, oof, tmp_path):
    fitted = reports.fit_ensemble(oof, ["a", "b"], "price", "fold")
    assert fitted.weights == pytest.approx([2 / 3, 1 / 3], abs=0.01) and fitted.score < 0.01 and fitted.cross_fitted_score < 0.02
    assert fitted.details["matrix"]["rows"] == 119 and fitted.details["matrix"]["rank"] == 1 and fitted.details["single_scores"]["a"] == pytest.approx(2 / 9)
    scaled = reports.fit_postprocessor(oof, ["a"], "price", fold="fold")
    assert scaled.alpha == pytest.approx(1.25, abs=1e-6) and scaled.score < 1e-6
    assert reports.fit_postprocessor(oof, ["a"], "price", fold="fold", least_gain=0.9).alpha == 1.0
    out = reports.apply_fitted(oof, scaled).agg(F.max(F.abs(F.col("prediction") - F.col("price")))).first()[0]
    assert out < 1e-4
    assert reports.pruned([0.9, 0.08, 0.02], 0.05) == pytest.approx([0.9 / 0.98, 0.08 / 0.98, 0])
    reports.write_json(spark, f"{tmp_path}/fitted", fitted)
    assert reports.read_json(spark, f"{tmp_path}/fitted")["weights"] == fitted.weights
    with pytest.raises(Exception, match="(?i)exist"):
        reports.write_json(spark, f"{tmp_path}/fitted", fitted)


def test_html_escapes(spark, tmp_path):
    t = spark.createDataFrame([("<b>", 1.5, None)], "a string, b double, c int")
    assert reports.html_table(t) == "<table><thead><tr><th>a</th><th>b</th><th>c</th></tr></thead><tbody><tr><td>&lt;b&gt;</td><td>1.5</td><td></td></tr></tbody></table>"
    reports.write_html(spark, f"{tmp_path}/page", "T & t", {"x": t})
    assert "T &amp; t" in spark.read.text(f"{tmp_path}/page").first()[0]


def test_command_line(spark, oof, tmp_path):
    table = f"{tmp_path}/oof.parquet"
    oof.withColumn("prediction", F.col("a")).withColumnRenamed("price", "target").write.parquet(table)
    run = lambda *a: cli.run(spark, cli.parser().parse_args([str(x) for x in a]))
    assert run("errors", table, f"{tmp_path}/overall.parquet", "--html", f"{tmp_path}/errors", "--category", "fold") == 0
    assert spark.read.parquet(f"{tmp_path}/overall.parquet").first()["n"] == 120 and "segments" in spark.read.text(f"{tmp_path}/errors").first()[0]
    assert run("folds", table, f"{tmp_path}/folds.parquet", "--id", "id") == 0
    assert run("calibrate", table, f"{tmp_path}/calibration", "--target", "target", "--columns", "a") == 0
    (tmp_path / "s.csv").write_text("id,price\n1,2\n1,3\n")
    spark.createDataFrame([("1", 0.0), ("2", 0.0)], "id string, price double").write.parquet(f"{tmp_path}/sample.parquet")
    assert run("validate", tmp_path / "s.csv", f"{tmp_path}/sample.parquet", f"{tmp_path}/issues.parquet", "--targets", "price") == 1
