"""Parsers against known values."""

import pytest
from pyspark.sql import functions as F

from quarryline.functions import quantities as Q


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def many(spark, column, cases):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", column(F.col("t")).alias("x"))
    return [r["x"] for r in df.orderBy("i").collect()]


WEIGHTS = [
    ("Samsung Galaxy Note 20 Ultra 5G Smartphone", None), ("4G LTE Wireless Mobile Router", None), ("Pure Kashmiri Saffron 5 g", 5.0), ("Basmati Rice 1.5 kg", 1500.0),
    ("16 oz", 453.592368), ("2.2 lbs", 997.903214), ("500 mg", 0.5), ("1/2 kg", 500.0), ("", None), (None, None), ("no quantity", None), ("500 g and 2 kg", 2000.0),
]
VOLUMES = [("1.5 L", 1500.0), ("3.4 fl oz", 100.5499), ("1 gallon", 3785.41), ("1/2 liter", 500.0), (None, None), ("5 kg", None)]


def close(found, wanted):
    return found == wanted or (found is not None and wanted is not None and found == pytest.approx(wanted, rel=1e-6))


def test_weights(spark):
    assert all(close(f, w) for f, (_, w) in zip(many(spark, Q.weight_grams, WEIGHTS), WEIGHTS, strict=True))


def test_volumes(spark):
    assert all(close(f, w) for f, (_, w) in zip(many(spark, Q.volume_ml, VOLUMES), VOLUMES, strict=True))


def test_packs(spark):
    cases = [
        ("Wooden Photo Frame 10 x 20 cm", (1.0, 0)), ("Energy Drink 6 x 250 ml", (6.0, 1)), ("2 * 500g", (2.0, 1)), ("6-pack", (6.0, 1)), ("10 pcs", (10.0, 1)),
        ("Pack of 2 (3 x 100ml)", (6.0, 1)), ("2 boxes of 6 pens", (12.0, 1)), ("(Pair of 2)", (2.0, 1)), ("A pair of", (1.0, 0)), ("one pair", (2.0, 1)), (None, (1.0, 0)), ("pack of 150, 4 x 5 ml", (150.0, 1)),
    ]
    assert [tuple(x) for x in many(spark, Q.pack_count, cases)] == [w for _, w in cases]


def test_dimensions(spark):
    none = (None,) * 4
    cases = [
        ("2 in 1 Shampoo 200 ml", none), ("All in 1 cream", none), ("12 in Heavy Duty", (30.48, None, None, None)), ('13.3"', (33.782, None, None, None)), ("1.5mm", (0.15, None, None, None)),
        ("60 x 180 cm", (180.0, 60.0, None, 10800.0)), ("10 x 20 x 30 cm", (30.0, 20.0, 10.0, 6000.0)), (None, none),
    ]
    for found, (_, wanted) in zip(many(spark, Q.dimensions_cm, cases), cases, strict=True):
        assert all(close(f, w) for f, w in zip(found, wanted, strict=True)), (found, wanted)


@pytest.mark.parametrize(("parse", "text", "wanted"), [
    (Q.power_watts, "60 W", 60), (Q.power_watts, "2 kw", 2000), (Q.voltage_volts, "18 v", 18), (Q.battery_mah, "10000 mah", 10000), (Q.battery_mah, "2 Ah", 2000),
    (Q.storage_gb, "128 GB", 128), (Q.storage_gb, "2 TB", 2048), (Q.storage_gb, "512 mb", 0.5), (Q.percentage, "60%", 60),
])
def test_others(spark, parse, text, wanted):
    assert one(spark, parse, text) == wanted


def test_model_codes(spark):
    code = one(spark, Q.model_codes, "Sony WH-1000XM4 headphones")
    assert (code["has"], code["count"]) == (1, 1) and code["longest"] >= 7
    assert tuple(one(spark, Q.model_codes, "COMBO PACK SIZE INCH")) == (0, 0, 0)


def test_specs(spark):
    rows = [
        ("Soap", "Pack of 6", "total net weight 1500 g"), ("Soap Pack of 4, Net Wt 100g each", None, None), ("Soap Pack of 4, Net Wt 400g (100g each)", "", ""), (None, None, None),
    ]
    out = Q.physical_specs(spark.createDataFrame(rows, "TITLE string, PACK_SIZE string, DESCRIPTION string"))
    assert out.columns[3:] == Q.SPEC_COLUMNS and len(Q.SPEC_COLUMNS) == 34
    a, b, c, d = out.collect()
    assert (a["pack_count"], a["total_weight_g"], a["weight_is_explicit_total"]) == (6, 1500, 1)
    assert (b["total_weight_g"], b["weight_is_per_item"], b["weight_is_explicit_total"]) == (400, 1, 0)
    assert (c["total_weight_g"], c["weight_is_explicit_total"]) == (400, 1)
    assert d["pack_count"] == 1 and d["has_weight"] == 0 and d["unit_weight_g"] is None


def test_specs_without_columns(spark):
    out = Q.physical_specs(spark.createDataFrame([("500 ml",)], "TITLE string"))
    assert out.first()["unit_volume_ml"] == 500 and out.columns == ["TITLE", *Q.SPEC_COLUMNS]
