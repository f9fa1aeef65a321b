"""Recognition runs through a hook for the engine."""

import pytest
from pyspark.sql import functions as F

from quarryline.operators import labels

ITEM = "key string, image_index int, content binary"


def make_engine():
    """Stands for an engine: the content says what is read of which variant."""

    def engine(content, variant):
        if content == b"broken":
            raise OSError("can't be read")
        return [(t.decode(), 0.95 if variant == "gray" else 0.6, (0, 20 * i, 100, 20 * i + 10)) for i, t in enumerate(content.split(b"\n")) if t]

    return engine


def test_recognition_run(spark):
    rows = [("a", 0, b"NET WT 4 x 100 g\nBEST SELLER"), ("b", 0, b"hello"), ("c", 0, b"broken"), ("d", 0, None), ("a", 1, b"\n\n65 W charger"), ("e", 0, b"")]
    out = {r["key"]: r for r in labels.recognise(spark.createDataFrame(rows, ITEM), "key", make_engine(), exit_at=0.9).collect()}
    assert {k: r["status"] for k, r in out.items()} == {"a": "ok", "b": "no_text", "c": "image_error", "d": "missing_image", "e": "no_text"}
    a = out["a"]
    assert (a["ocr_weight_g"], a["ocr_pack_count"], a["ocr_power_watts"], a["passes"]) == (400.0, 4.0, 65.0, 4)  # both images twice: gray is reliable, binary isn't run
    assert out["b"]["passes"] == 3 and "OSError" in out["c"]["error"] and out["d"]["passes"] == 0
    assert a["packaging_bbox"] == [0, 0, 100, 50] and a["evidence_confidence"] == pytest.approx(0.95)
    table = spark.createDataFrame([tuple(r) for r in out.values()], "key string, passes long, error string, ocr_text string, has_ocr int, detections_kept int, detections_rejected int, mean_confidence double, evidence_confidence double, packaging_bbox array<int>, ocr_weight_g double, ocr_volume_ml double, ocr_pack_count double, ocr_dim_length_cm double, ocr_dim_width_cm double, ocr_dim_height_cm double, ocr_power_watts double, ocr_voltage_volts double, ocr_battery_mah double, ocr_storage_gb double, status string")
    summary = labels.run_summary(table).first()
    assert (summary["n_products"], summary["with_text"], summary["with_quantity"], summary["with_further"], summary["failed"]) == (5, 1, 1, 1, 2)
    assert {r["entity"]: r["n"] for r in labels.coverage(table).collect()}["weight_g"] == 1
    with pytest.raises(RuntimeError):
        labels.run_summary(table, most_failures=0.1)


def test_images_in_one_place_are_rejected(spark):
    with pytest.raises(ValueError, match="one place"):
        labels.recognise(spark.createDataFrame([("a", 0, b"x"), ("a", 0, b"y")], ITEM), "key", make_engine())


def test_cache_keys_follow_everything_that_matters(spark):
    t = spark.createDataFrame([("a", ["h1"]), ("a", ["h2"]), ("b", ["h1"])], "k string, i array<string>")
    keys = [labels.cache_key(F.col("k"), F.col("i"), e, {"least": s}) for e, s in (("x", 1), ("y", 1), ("x", 2))]
    found = {v for r in t.select(*keys).collect() for v in r}
    assert len(found) == 9 and all(len(v) == 64 for v in found)
    assert t.select(labels.union_box(F.array(F.array(F.lit(1), F.lit(9), F.lit(5), F.lit(12)), F.array(F.lit(3), F.lit(2), F.lit(4), F.lit(20))))).first()[0] == [1, 2, 5, 20]
