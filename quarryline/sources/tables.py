"""Reading and writing tables, with the checks that go with them."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_table(spark: SparkSession, path: str, *, schema: T.StructType | None = None, text_ids: tuple[str, ...] = ()) -> DataFrame:
    """A .csv (also .csv.gz), .parquet or .pq table. Columns in text_ids of a CSV stay texts, leading zeros included."""
    suffixes = PurePosixPath(path).suffixes
    kind = "".join(suffixes[-2:]) if suffixes[-1:] == [".gz"] else "".join(suffixes[-1:])
    if kind in (".parquet", ".pq"):
        return normal_missing(spark.read.parquet(path))
    if kind not in (".csv", ".csv.gz"):
        raise ValueError(f"{path}: tables end in .csv, .csv.gz, .parquet or .pq")
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is not None:
        return reader.schema(schema).csv(path)
    df = reader.option("inferSchema", not text_ids).csv(path)
    return df.withColumns({c: F.trim(c) for c in text_ids}) if text_ids else df


def normal_missing(df: DataFrame) -> DataFrame:
    """NaN and null are one state: NaN becomes null."""
    floats = {f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)) for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.withColumns(floats) if floats else df


def require_columns(df: DataFrame, names: list[str]) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    if len(set(df.columns)) < len(df.columns):
        raise ValueError("column names repeat")


def require_unique_ids(df: DataFrame, key: str) -> None:
    """Ids are neither null nor repeated; one aggregate that Spark combines before its shuffle."""
    bad = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull())
    if not bad.isEmpty():
        raise ValueError(f"{key} holds null or repeated ids")


def write_table(df: DataFrame, path: str, *, overwrite: bool = False, one_file: bool = False) -> None:
    """By suffix to Parquet or CSV; existing results are kept unless overwrite. The committer makes it all or nothing."""
    df = df.coalesce(1) if one_file else df
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if path.endswith((".parquet", ".pq")):
        writer.parquet(path)
    elif path.endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        raise ValueError("tables end in .csv, .parquet or .pq")


def submission(df: DataFrame, key: str, target: str, prediction: str = "prediction") -> DataFrame:
    """The two columns of a submission; probabilities don't go with it."""
    return df.select(key, F.col(prediction).alias(target))


def round_trip_equal(spark: SparkSession, df: DataFrame, path: str, key: str, tolerance: float = 1e-12) -> bool:
    """Write as CSV, read again with the same schema, compare by key."""
    write_table(df, path, overwrite=True)
    again = load_table(spark, path, schema=df.schema)
    pairs = df.alias("a").join(again.alias("b"), F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full_outer")
    same = []
    for f in df.schema:
        a, b = F.col(f"a.{f.name}"), F.col(f"b.{f.name}")
        near = F.abs(a - b) <= tolerance + tolerance * F.abs(b) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.lit(False)
        same.append(a.eqNullSafe(b) | F.coalesce(near, F.lit(False)))
    alike = same[0]
    for s in same[1:]:
        alike = alike & s
    return pairs.filter(~alike).isEmpty()


def malformed_rows(spark: SparkSession, path: str, most: int = 10) -> DataFrame:
    """Lines of a CSV file whose number of fields isn't the header's, at most `most` (a report): line, n_fields."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id() + 1)
    fields = F.size(F.split(F.regexp_replace("value", r'"[^"]*"', ""), ",", -1))
    width = lines.orderBy("line").select(fields.alias("n")).first()["n"]
    return lines.select("line", fields.alias("n_fields")).filter((F.col("n_fields") != width) & (F.col("line") > 1)).orderBy("line").limit(most)


def json_parameters(text: str, engine: str) -> dict:
    """Model parameters of a JSON text, bare or under model_params; a stated engine must be the one asked for."""
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("parameters are a JSON object")
    if found.get("engine", engine) != engine:
        raise ValueError(f"parameters are for {found['engine']}, not {engine}")
    return found.get("model_params", {k: v for k, v in found.items() if k != "engine"})


#: Columns of the canonical catalog, and of the two raw layouts that become it.
CATALOG = ("PRODUCT_ID", "PRICE", "TITLE", "DESCRIPTION", "PACK_SIZE", "BRAND", "CATEGORY", "IMAGE_URL", "fold")


def parse_price(value) -> object:
    """A price above 0 out of text with thousands separators and currency signs, else null."""
    text = F.regexp_replace(F.regexp_replace(value.cast("string"), r"[,₹]|Rs\.?", ""), r"^\s*\.", "")
    price = F.trim(text).try_cast("double")
    return F.when(price > 0, price)


def adapt_catalog(df: DataFrame, key: str = "sample_id", text: str = "catalog_content", image: str = "image_link", price: str | None = "price") -> DataFrame:
    """A table of one text per product in the canonical layout: the whole text as TITLE, other fields blank."""
    out = [F.trim(F.col(key).cast("string")).alias("PRODUCT_ID")]
    if price:
        out.append(F.col(price).cast("double").alias("PRICE"))
    out.append(F.coalesce(F.col(text), F.lit("")).alias("TITLE"))
    out += [F.lit("").alias(c) for c in ("DESCRIPTION", "PACK_SIZE", "BRAND", "CATEGORY")]
    return df.select(*out, F.coalesce(F.col(image), F.lit("")).alias("IMAGE_URL"))


def adapt_tables(train: DataFrame, test: DataFrame, sample: DataFrame, *, key: str = "sample_id", price: str = "price", order: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, sample) in the canonical layout, after checks: needed columns, ids neither blank nor repeated, the same ids in
    test and sample (and the same places, by a column that states them), prices that are finite and not negative."""
    for name, df, needed in (("train", train, [key, "catalog_content", "image_link", price]), ("test", test, [key, "catalog_content", "image_link"]), ("sample", sample, [key, price])):
        require_columns(df, needed)
        ids = df.select(F.trim(F.col(key).cast("string")).alias(key))
        if not ids.filter(F.coalesce(F.col(key), F.lit("")) == "").isEmpty():
            raise ValueError(f"{name} has blank ids")
        require_unique_ids(ids, key)
    own, wanted = (df.select(F.trim(F.col(key).cast("string")).alias("_id"), *([F.col(order).alias(f"_{n}")] if order else [])) for n, df in enumerate((test, sample)))
    joined = own.withColumn("_a", F.lit(True)).join(wanted.withColumn("_b", F.lit(True)), "_id", "full_outer")
    moved = F.col("_0") != F.col("_1") if order else F.lit(False)
    if not joined.filter(F.col("_a").isNull() | F.col("_b").isNull() | moved).isEmpty():
        raise ValueError("test and sample hold different ids, or in other places")
    value = F.col(price).try_cast("double")
    if not train.filter(~F.coalesce((value >= 0) & ~F.isnan(value) & (value < float("inf")), F.lit(False))).isEmpty():
        raise ValueError("prices are finite numbers, and not negative")
    return adapt_catalog(train, key, price=price), adapt_catalog(test, key, price=None), sample.select(F.trim(F.col(key).cast("string")).alias("PRODUCT_ID"), F.col(price).cast("double").alias("PRICE"))


def split_labelled(df: DataFrame, key: str, price: str, *, share: float = 0.75, seed: int = 42) -> DataFrame:
    """df with role: unlabelled where the price is null; else train or valid.

    A row's place in a deterministic shuffle is its md5; the cut is on the hash's own scale, so no row is ranked against
    all others and the result doesn't depend on what else is in the table.
    """
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.withColumn("role", F.when(F.col(price).isNull(), "unlabelled").when(draw < int(share * 2**32), "train").otherwise("valid"))
