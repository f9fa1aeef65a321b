"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import embedding_join, html_text, licenses, ngram_jaccard, packing, pii, quality, sentencepiece_bpe, toxicity, vector_search


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.round_trip_digests(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), length=1024)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return vector_search.nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_groups(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_embedding_near_dedup, op2_license_scan, op3_sentencepiece, op4_pii, op5_packing, op6_toxicity, op7_nearest_neighbours, op8_quality, op9_html_text, op10_ngram_jaccard)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": licenses.oracle_sql(), "op4_pii": pii.ORACLE_SQL}
