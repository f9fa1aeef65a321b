"""More queries over the driver's tables: joins with checks, label texts, vectors of texts, folds and rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import metrics, quantities, text
from quarryline.operators import align, audit, blend, encode, images, splits, text_features
from quarryline.plans.catalog import _C, _P, ORACLES, QUERIES, Y, catalog, predicted, query, read, rounded

__all__ = ["ORACLES", "QUERIES"]  # the catalog's, with those registered here

# Joins with checks


@query("SELECT c_custkey, n_name FROM (SELECT c_custkey, c_nationkey AS n_nationkey FROM customer) JOIN nation USING (n_nationkey)")
def align_superset(spark, d):
    """Every nation that customers have is in nation, which may hold more."""
    used = read(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    found = align.align_superset(used, read(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(found, "n_nationkey").select("c_custkey", "n_name")


@query("SELECT p_partkey, p_size, round(p_retailprice, 2) AS img__price, p_size * 2 AS img__twice FROM part")
def attach_features(spark, d):
    p = read(spark, d, "part")
    features = p.select("p_partkey", F.col("p_retailprice").alias("price"), (F.col("p_size") * 2).alias("twice"), (F.col("p_partkey") % 5).alias("fold"))
    out = align.attach_features(p.select("p_partkey", "p_size", (F.col("p_partkey") % 5).alias("fold")), features, "p_partkey", "img", "fold")
    return out.select("p_partkey", "p_size", F.round("img__price", 2).alias("img__price"), "img__twice")


@query(f"WITH t AS ({_P}) SELECT round(avg(2 * abs(p - y) / (abs(p) + abs(y))), 6) AS smape, round(avg(abs(p - y)), 4) AS mae, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse FROM t")
def evaluate_metrics(spark, d):
    out = metrics.evaluate(predicted(spark, d), "y", "p", ["smape", "MAE", "rmse"])
    return out.select(F.round("smape", 6).alias("smape"), F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


@query(f"""WITH t AS ({_P}), m AS (SELECT fold AS f, (SELECT avg(y) FROM t AS o WHERE o.fold <> g.fold) AS m FROM (SELECT DISTINCT fold FROM t) AS g)
 SELECT o_orderkey, round(y - m, 3) AS residual FROM t JOIN m ON f = fold""")
def cross_fitted(spark, d):
    """What is fitted on the other folds is applied to a fold's own rows: here, the mean."""
    fit = lambda df: df.agg(F.avg("y")).first()[0]
    out = blend.cross_fitted(predicted(spark, d).select("o_orderkey", "y", "fold"), "fold", fit, lambda df, mean: df.withColumn("residual", Y() - mean))
    return out.select("o_orderkey", F.round("residual", 3).alias("residual"))


@query(f"""WITH t AS (SELECT o_orderkey, fold, o_orderpriority AS c, ln(1 + y) AS l FROM ({_P})), g AS (SELECT f.fold, (SELECT avg(l) FROM t WHERE t.fold < f.fold) AS g FROM (SELECT DISTINCT fold FROM t) f),
 s AS (SELECT f.fold, c, count(*) AS n, sum(l) AS s FROM (SELECT DISTINCT fold FROM t) f JOIN t ON t.fold < f.fold GROUP BY f.fold, c)
 SELECT o_orderkey, round(CASE WHEN coalesce(n, 0) = 0 THEN g ELSE (s + 10 * g) / (n + 10) END, 3) AS code FROM t JOIN g USING (fold) LEFT JOIN s USING (fold, c)""")
def te_temporal(spark, d):
    t = encode.out_of_fold_encoding(predicted(spark, d), ["o_orderpriority"], "y", temporal=True)
    return t.select("o_orderkey", F.round(F.col("te_o_orderpriority").cast("double"), 3).alias("code"))


# Types, strata, groups


@query("""SELECT 'doc_id' AS "column", 'numeric' AS kind UNION ALL SELECT 'n_chars', 'numeric'
 UNION ALL SELECT 'text', CASE WHEN median(length(text)) >= 40 OR count(DISTINCT text) > 100 THEN 'text' ELSE 'categorical' END FROM documents
 UNION ALL SELECT 'lang', CASE WHEN median(length(lang)) >= 40 OR count(DISTINCT lang) > 100 THEN 'text' ELSE 'categorical' END FROM documents
 UNION ALL SELECT 'source', CASE WHEN median(length(source)) >= 40 OR count(DISTINCT source) > 100 THEN 'text' ELSE 'categorical' END FROM documents""")
def semantic_types(spark, d):
    found = audit.semantic_type(read(spark, d, "documents"), ["doc_id", "text", "lang", "source", "n_chars"])
    return spark.createDataFrame(list(found.items()), "column string, kind string")


@query("""SELECT 'o_orderstatus' AS "column", 'classification' AS task UNION ALL SELECT 'o_totalprice', CASE WHEN bool_and(o_totalprice = floor(o_totalprice)) AND count(DISTINCT o_totalprice) <= greatest(20, 0.05 * count(o_totalprice)) THEN 'classification' ELSE 'regression' END FROM orders
 UNION ALL SELECT 'o_custkey', CASE WHEN count(DISTINCT o_custkey) <= greatest(20, 0.05 * count(o_custkey)) THEN 'classification' ELSE 'regression' END FROM orders""")
def inferred_tasks(spark, d):
    o = read(spark, d, "orders")
    return spark.createDataFrame([(c, audit.infer_task(o, c)) for c in ("o_orderstatus", "o_totalprice", "o_custkey")], "column string, task string")


@query("SELECT s AS stratum, sum(n)::BIGINT AS rows FROM (SELECT CASE WHEN count(*) < 12 THEN '__RARE__' ELSE o_custkey::VARCHAR END AS s, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY s")
def class_strata(spark, d):
    o = read(spark, d, "orders")
    return o.groupBy(splits.class_strata(o, "o_custkey", n_splits=12).alias("stratum")).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'm:' || o_orderkey ELSE 'g:' || o_custkey || chr(31) || o_orderpriority END AS label FROM orders")
def group_labels(spark, d):
    o = read(spark, d, "orders").withColumn("p", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")))
    return o.select("o_orderkey", splits.group_labels(o, ["o_custkey", "p"], "o_orderkey").alias("label"))


@query("SELECT fold, count(*)::BIGINT AS rows FROM (SELECT ((row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1) % 5)::SMALLINT AS fold FROM orders) GROUP BY fold")
def validated_folds(spark, d):
    t = splits.kfold(read(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    splits.validate_folds(t)
    return t.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"))


# Texts


_WORDS = r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\p{L}\p{N}\p{M}_][\p{L}\p{N}\p{M}_]+') AS w FROM documents),
 t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w)"""
_TFIDF = """, c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL), k AS (SELECT term, count(*) AS df, sum(n) AS total FROM c GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT {most}),
 r AS (SELECT doc_id, term, (1 + ln(n)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM c JOIN k USING (term)), s AS (SELECT doc_id, sqrt(sum(w * w)) AS m FROM r GROUP BY doc_id)
 SELECT doc_id, term, round(w / m, 6) AS weight FROM r JOIN s USING (doc_id)"""


@query(_WORDS + _TFIDF.format(most=2000))
def tfidf_words(spark, d):
    return rounded(text_features.tfidf(read(spark, d, "documents"), "doc_id", text_features.word_terms(F.col("text")), most=2000))


@query("""WITH w AS (SELECT p_partkey AS doc_id, unnest(list_transform(list_filter(regexp_split_to_array(lower(p_name), '\\s+'), lambda x: x <> ''), lambda x: ' ' || x || ' ')) AS w FROM part),
 t AS (SELECT doc_id, unnest(list_concat(CASE WHEN length(w) < 3 THEN [w] ELSE [] END, list_transform(range(1, length(w) - 1), lambda i: w[i:i + 2]), list_transform(range(1, length(w) - 2), lambda i: w[i:i + 3]), list_transform(range(1, length(w) - 3), lambda i: w[i:i + 4]))) AS term FROM w)"""
 + _TFIDF.format(most=120000).replace("FROM documents", "FROM part").replace("SELECT doc_id, term, round", "SELECT doc_id AS p_partkey, term, round"))
def tfidf_chars(spark, d):
    return rounded(text_features.tfidf(read(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", text_features.char_terms(F.col("p_name"))))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || '0 ml' WHEN 1 THEN '1,' || p_size || ' kg' WHEN 2 THEN p_size || 'x1O0g' ELSE 'code OO' || p_size END AS label FROM part")
def label_text(spark, d):
    k, s = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(F.lit(" "), s, F.lit("O m l |"))).when(k == 1, F.concat(F.lit("1 , "), s, F.lit(" k  g;"))).when(k == 2, F.concat(s, F.lit("×1O0g"))).otherwise(F.concat(F.lit("code OO"), s))
    return read(spark, d, "part").select("p_partkey", text.normal_label_text(raw).alias("label"))


@query(f"""SELECT PRODUCT_ID, 'pack of ' || (PRODUCT_ID % 3 + 2) || CASE WHEN DESCRIPTION IS NOT NULL THEN ' | NET WT ' || (PRODUCT_ID % 9 + 1) || ' g' ELSE '' END AS text,
 CASE WHEN DESCRIPTION IS NOT NULL THEN 3 ELSE 3 END::INT AS n_rejected FROM ({_C})""")
def label_rejected(spark, d):
    n = lambda k, a: (F.col("PRODUCT_ID") % k + a).cast("string")
    net = F.when(F.col("DESCRIPTION").isNotNull(), F.concat(F.lit("NET WT "), n(9, 1), F.lit(" g")))
    lines = F.array(F.concat(F.lit("Buy "), n(3, 1), F.lit(" & get 1 free")), net, F.lit("best seller"), F.lit("Energy 200 kcal per serving 5 g"), F.lit("hello"), net)
    return catalog(spark, d).select("PRODUCT_ID", text.packaging_text(lines).alias("p")).select("PRODUCT_ID", "p.text", F.size("p.rejected").alias("n_rejected"))


@query(f"""SELECT PRODUCT_ID, (PRODUCT_ID % 4 + 2) * (PRODUCT_ID % 50 + 1)::DOUBLE AS ocr_weight_g, (PRODUCT_ID % 4 + 2)::DOUBLE AS ocr_pack_count, NULL::DOUBLE AS ocr_volume_ml, (PRODUCT_ID % 60 + 5)::DOUBLE AS ocr_power_watts FROM ({_C})""")
def harvested(spark, d):
    n = lambda k, a: (F.col("PRODUCT_ID") % k + a).cast("string")
    t = catalog(spark, d).select("PRODUCT_ID", F.concat(F.lit("NET WT "), n(4, 2), F.lit(" x "), n(50, 1), F.lit(" g | "), n(60, 5), F.lit(" W fast charger")).alias("t"))
    return text.harvested(t, "t").select("PRODUCT_ID", "ocr_weight_g", "ocr_pack_count", "ocr_volume_ml", "ocr_power_watts")


@query("""SELECT id, CASE id WHEN 0 THEN 1000.0 WHEN 1 THEN 500.0 WHEN 2 THEN 200.0 WHEN 3 THEN 7.0 END::DOUBLE AS weight_g, CASE id WHEN 0 THEN 'title' WHEN 1 THEN 'ocr' WHEN 2 THEN 'pack_size' WHEN 3 THEN 'ocr' ELSE 'missing' END AS weight_g_source,
 CASE id WHEN 1 THEN 65.0 WHEN 3 THEN 20.0 END::DOUBLE AS power_watts, CASE id WHEN 1 THEN 'ocr' WHEN 3 THEN 'description' ELSE 'missing' END AS power_watts_source FROM range(5) r(id)""")
def backfilled(spark, d):
    """Title before label before pack field before description; given label quantities before those in its text."""
    products = spark.createDataFrame([(0, "Rice 1 kg", None, "2 kg"), (1, "Rice", None, "100 g"), (2, "Rice", "200 g", None), (3, "Lamp", "1 kg", "20 W"), (4, None, None, None)], "id long, TITLE string, PACK_SIZE string, DESCRIPTION string")
    labels = spark.createDataFrame([(0, "5 kg", None), (1, "500 g | 65 W", float("nan")), (3, "nothing", 7.0), (4, "", None)], "id long, ocr_text string, ocr_weight_g double")
    labels = labels.withColumn("ocr_weight_g", F.when(F.col("id") == 1, F.lit(500.0)).otherwise(F.col("ocr_weight_g")))
    return images.backfill(products, labels, "id").select("id", "weight_g", "weight_g_source", "power_watts", "power_watts_source")


# Images


@query("""SELECT count(*)::BIGINT AS n_references, count(DISTINCT l_orderkey)::BIGINT AS products, count(DISTINCT CASE WHEN l_linenumber <> 3 THEN l_orderkey END)::BIGINT AS products_with_image, count(*) FILTER (l_linenumber = 3)::BIGINT AS failed,
 count(*) FILTER (l_linenumber = 2)::BIGINT AS cached, sum(l_partkey)::BIGINT AS bytes, count(DISTINCT l_suppkey)::BIGINT AS objects FROM lineitem""")
def manifest_counts(spark, d):
    n = F.col("l_linenumber")
    status = F.when(n == 2, "cached").when(n == 3, "http_error").otherwise("downloaded")
    m = read(spark, d, "lineitem").select("l_orderkey", status.alias("status"), F.col("l_partkey").cast("long").alias("byte_count"), F.col("l_suppkey").cast("string").alias("content_sha256"))
    return images.manifest_summary(m, "l_orderkey")


@query("""WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a b/' || p_partkey WHEN 1 THEN 'CON' WHEN 2 THEN 'Same' ELSE '..x' || p_partkey || '.' END AS id FROM part), t AS (SELECT p_partkey, id, CASE p_partkey % 4 WHEN 0 THEN 'a_b_' || p_partkey WHEN 1 THEN 'CON-' || sha256('str:CON')[1:12] WHEN 2 THEN 'Same' ELSE 'x' || p_partkey END AS stem FROM s)
 SELECT p_partkey, stem || CASE WHEN count(*) OVER (PARTITION BY lower(stem)) > 1 THEN '-' || sha256('str:' || id)[1:12] ELSE '' END AS alias FROM t""")
def alias_stems(spark, d):
    k = F.col("p_partkey")
    p = k.cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("a b/"), p)).when(k % 4 == 1, F.lit("CON")).when(k % 4 == 2, F.lit("Same")).otherwise(F.concat(F.lit("..x"), p, F.lit(".")))
    return images.alias_stems(read(spark, d, "part").select("p_partkey", name.alias("id")), "id").select("p_partkey", "alias")


@query("SELECT p_partkey, ['NET WT ' || p_size || ' g', 'pack of 2'] AS texts FROM part")
def merged_labels(spark, d):
    """Of four detections one repeats a text and one isn't confident; the others come in reading order."""
    say = lambda t, c, x, y, v: F.struct(t.alias("text"), F.lit(c).alias("confidence"), F.array(*map(F.lit, (x, y, x + 100, y + 20))).alias("bbox"), F.lit(v).alias("variant"))
    net = F.concat(F.lit("NET WT "), F.col("p_size").cast("string"), F.lit(" g"))
    t = read(spark, d, "part").select("p_partkey", F.array(say(F.lit("pack of 2"), 0.8, 0, 50, "gray"), say(net, 0.95, 0, 0, "gray"), say(F.lower(net), 0.7, 0, 0, "binary"), say(F.lit("noise"), 0.1, 0, 90, "gray")).alias("detections"))
    return images.merged_detections(t).select("p_partkey", F.transform("detections", lambda x: x["text"]).alias("texts"))


# Quantities that catalog texts don't have


_GOLDEN = [
    ("Tea 8 oz tin", 226.796184, None, 1.0), ("2 lb flour", 907.18474, None, 1.0), ("milk 1 gallon", None, 3785.41, 1.0), ("juice 12 fl oz", None, 354.882, 1.0), ("pair of 2 socks", None, None, 2.0),
    ("2 boxes of 6 pens", None, None, 12.0), ("5G phone", None, None, 1.0), ("3 x 500 g dal", 500.0, None, 3.0), ("1/2 kg sugar", 500.0, None, 1.0), ("75 cl wine", None, 750.0, 1.0),
]


@query("SELECT * FROM (VALUES " + ", ".join("({}, {}, {}, {})".format(f"'{t}'", *("NULL::DOUBLE" if x is None else f"{x}::DOUBLE" for x in v)) for t, *v in _GOLDEN) + ") AS t(title, grams, ml, pack)")
def golden_quantities(spark, d):
    t = spark.createDataFrame([(t,) for t, *_ in _GOLDEN], "title string")
    c = F.col("title")
    return rounded(t.select("title", quantities.weight_grams(c).alias("grams"), quantities.volume_ml(c).alias("ml"), quantities.pack_count(c)["count"].alias("pack")))




@query("""WITH t AS (SELECT p_partkey AS k, p_size AS s, p_size % 5 + 1 AS p FROM part),
 v AS (SELECT *, CASE WHEN p > 1 AND (k % 7 <> 0 OR k % 6 IN (0, 2)) THEN p ELSE 1 END AS pack, CASE k % 6 WHEN 0 THEN s::DOUBLE WHEN 1 THEN (s + 0.5::DOUBLE) * 1000 END AS title_g, CASE WHEN k % 3 <> 0 THEN s::DOUBLE END AS text_g FROM t),
 w AS (SELECT *, coalesce(title_g, text_g) AS g, CASE WHEN title_g IS NOT NULL THEN 1 WHEN text_g IS NOT NULL THEN 3 ELSE 0 END AS rank FROM v)
 SELECT k AS PRODUCT_ID, pack::DOUBLE AS pack_count, (pack > 1)::INT AS is_multipack, g AS unit_weight_g, g * pack AS total_weight_g, round(ln(1 + g * pack), 4) AS log_total_weight_g, rank AS weight_source_rank, (rank = 3)::INT AS weight_is_per_item,
 CASE k % 6 WHEN 2 THEN s::DOUBLE WHEN 5 THEN 500.0 END AS unit_volume_ml, CASE k % 6 WHEN 2 THEN s::DOUBLE * pack WHEN 5 THEN 500.0 * pack END AS total_volume_ml,
 CASE WHEN k % 6 = 3 THEN greatest(s, p)::DOUBLE END AS dim_length_cm, CASE WHEN k % 6 = 3 THEN least(s, p)::DOUBLE END AS dim_width_cm, CASE WHEN k % 6 = 3 THEN (s * p)::DOUBLE END AS dim_volume_cm3,
 CASE WHEN k % 6 = 4 THEN s::DOUBLE END AS power_watts, CASE WHEN k % 6 = 5 THEN 220.0::DOUBLE END AS voltage_volts, CASE WHEN k % 6 = 4 THEN p * 1000::DOUBLE END AS battery_mah, CASE WHEN k % 6 = 4 THEN 128.0::DOUBLE END AS storage_gb,
 CASE WHEN k % 6 = 5 THEN s::DOUBLE END AS percentage_spec FROM w""")
def specs_core(spark, d):
    """The parsed columns that the catalog's texts decide."""
    names = "pack_count unit_weight_g total_weight_g log_total_weight_g unit_volume_ml total_volume_ml dim_length_cm dim_width_cm dim_volume_cm3 power_watts voltage_volts battery_mah storage_gb percentage_spec".split()
    out = quantities.physical_specs(catalog(spark, d))
    flags = [F.col(c).cast("int").alias(c) for c in ("is_multipack", "weight_source_rank", "weight_is_per_item")]
    return out.select("PRODUCT_ID", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in names), *flags)
