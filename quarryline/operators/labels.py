"""Text off product images: a recognition run over a hook for the engine, its results and what they cover."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import LABEL_ENTITIES, harvested, packaging_text, tidy_label
from quarryline.operators.images import merged_detections

DETECTIONS = "array<struct<text:string,confidence:double,bbox:array<int>,variant:string>>"
#: What a product's run can end in.
STATUSES = ("ok", "no_text", "image_error", "missing_image")


def plain_key(text: Column) -> Column:
    """Text without case and signs, by which lines are compared."""
    return F.lower(F.regexp_replace(text, r"(?U)\W+", ""))


def union_box(boxes: Column) -> Column:
    """The smallest box around an array of boxes (left, top, right, bottom); null for none."""
    edge = lambda i, pick: pick(F.transform(boxes, lambda b: b[i]))
    return F.when(F.size(boxes) > 0, F.array(edge(0, F.array_min), edge(1, F.array_min), edge(2, F.array_max), edge(3, F.array_max)))


def require_one_image_a_place(images: DataFrame, key: str) -> None:
    """Raises where two images of a product have one index, as their order would be ambiguous."""
    twice = images.groupBy(key, "image_index").count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"several images in one place: {[(r[key], r['image_index']) for r in twice]}")


def cache_key(key: Column, content_hashes: Column, engine: str, settings: dict) -> Column:
    """SHA-256 of a product, its images, the engine's signature and the settings: what a result may be taken for again."""
    fixed = json.dumps([engine, settings], sort_keys=True)
    return F.sha2(F.to_json(F.struct(key.cast("string").alias("k"), content_hashes.alias("i"), F.lit(fixed).alias("s"))), 256)


def described(found: DataFrame, key: str, *, least: float = 0.35) -> DataFrame:
    """Per row of found (key, detections): ocr_text, ten quantities, has_ocr, mean_confidence, evidence_confidence (of lines that state
    a quantity), packaging_bbox, and how many detections were kept and rejected. Null detections count as none; texts are NFKC."""
    filled = found.withColumn("detections", F.coalesce("detections", F.array().cast(DETECTIONS)))
    merged = merged_detections(filled, least)
    read = merged.withColumn("_label", packaging_text(F.transform("detections", lambda d: d["text"]), compatible=True))
    parts = F.transform(F.filter(F.split("_label.text", r"\|"), lambda t: F.trim(t) != ""), plain_key)
    read = read.withColumn("_parts", parts).withColumn("_useful", F.filter("detections", lambda d: F.array_contains("_parts", plain_key(tidy_label(d["text"])))))
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, d: s + d["confidence"]) / F.size(a))
    out = read.select(
        key, F.col("_label.text").alias("ocr_text"), (F.col("_label.text") != "").cast("int").alias("has_ocr"), F.size("detections").alias("detections_kept"), F.size("_label.rejected").alias("detections_rejected"),
        mean(F.col("detections")).alias("mean_confidence"), mean(F.col("_useful")).alias("evidence_confidence"), union_box(F.transform("_useful", lambda d: d["bbox"])).alias("packaging_bbox"),
    )
    return harvested(out, "ocr_text")


def reliable(labels: DataFrame, exit_at: float) -> Column:
    """True for a row of described whose lines state a quantity with a mean confidence of exit_at or more."""
    any_value = F.coalesce(*(F.col(f"ocr_{n}") for n in LABEL_ENTITIES)).isNotNull()
    return F.coalesce(any_value & (F.col("evidence_confidence") >= exit_at), F.lit(False))


def recognise(images: DataFrame, key: str, engine: Callable[[bytes, str], list[tuple]], *, variants: Sequence[str] = ("rgb", "gray", "binary"), least: float = 0.35, exit_at: float = 0.85, adaptive: bool = True) -> DataFrame:
    """Per product of images (key, image_index, content): what its images' labels say, with status and the passes it took.

    engine(content, variant) gives (text, confidence, (left, top, right, bottom)) rows; it runs on the executors, once for each image
    and variant. After each variant, products whose labels are reliable already leave (if adaptive), so that later passes see the
    rest only. An image that the engine fails on counts as an error; a product with no image content has status
    missing_image. Each pass is cut in the session's checkpoint folder, as engines are dear. A product's images are few.
    """
    require_one_image_a_place(images, key)
    kind = dict(images.dtypes)[key]

    def run(variant: str):
        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows, errors = [], []
                for content in pdf["content"]:
                    try:
                        rows.append([{"text": unicodedata.normalize("NFKC", str(t)).strip(), "confidence": float(c), "bbox": [int(v) for v in b], "variant": variant} for t, c, b in engine(bytes(content), variant)])
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001  the error is the row's result
                        rows.append([]), errors.append(f"{type(e).__name__}: {e}"[:300])
                yield pd.DataFrame({key: pdf[key], "detections": rows, "error": errors})

        return read

    here = images.filter("content is not null")
    pending, passes = here, None
    for i, variant in enumerate(variants):
        done = pending.select(key, "content").mapInPandas(run(variant), f"`{key}` {kind}, detections {DETECTIONS}, error string").checkpoint()
        passes = done if passes is None else passes.union(done)
        by = passes.groupBy(key).agg(F.flatten(F.collect_list("detections")).alias("detections"))
        if not adaptive or i == len(variants) - 1:
            continue
        good = described(by, key, least=least).filter(reliable(by, exit_at)).select(key).checkpoint()
        pending = pending.join(good, key, "left_anti")
        if pending.isEmpty():
            break
    counts = passes.groupBy(key).agg(F.count(F.lit(1)).alias("passes"), F.count_if(F.col("error").isNull()).alias("_read"), F.array_join(F.collect_set("error"), " | ").alias("error"), F.flatten(F.collect_list("detections")).alias("detections"))
    labels = described(counts.select(key, "detections"), key, least=least)
    out = images.select(key).distinct().join(counts.drop("detections"), key, "left").join(labels, key, "left")
    status = F.when(F.col("passes").isNull(), "missing_image").when(F.col("has_ocr") == 1, "ok").when(F.col("_read") > 0, "no_text").otherwise("image_error")
    return out.withColumn("status", status).withColumns({"passes": F.coalesce("passes", F.lit(0)), "has_ocr": F.coalesce("has_ocr", F.lit(0)), "ocr_text": F.coalesce("ocr_text", F.lit(""))}).drop("_read")


def coverage(labels: DataFrame) -> DataFrame:
    """(entity, n, share): how many products have each quantity, in one pass."""
    n = F.count(F.lit(1))
    row = [F.struct(F.lit(e).alias("entity"), F.count(f"ocr_{e}").alias("n"), F.coalesce(F.try_divide(F.count(f"ocr_{e}"), n), F.lit(0.0)).alias("share")) for e in LABEL_ENTITIES]
    return labels.agg(F.array(*row).alias("all")).select(F.explode("all").alias("c")).select("c.*")


def run_summary(labels: DataFrame, *, most_failures: float = 1.0) -> DataFrame:
    """One row: products, those with text, with a quantity and with a further one, failures and their share. Raises where
    more than most_failures of the products failed."""
    main, more = (F.coalesce(*(F.col(f"ocr_{n}") for n in names)).isNotNull() for names in (("weight_g", "volume_ml", "pack_count"), ("dim_length_cm", "power_watts", "voltage_volts", "battery_mah", "storage_gb")))
    failed = F.col("status").isin("image_error", "missing_image")
    out = labels.agg(
        F.count(F.lit(1)).alias("n_products"), F.count_if(F.col("has_ocr") == 1).alias("with_text"), F.count_if(main).alias("with_quantity"), F.count_if(more).alias("with_further"), F.count_if(failed).alias("failed"),
        F.coalesce(F.avg(failed.cast("double")), F.lit(0.0)).alias("failure_rate"),
    )
    if most_failures < 1 and out.first()["failure_rate"] > most_failures:
        raise RuntimeError("too many products failed")
    return out
