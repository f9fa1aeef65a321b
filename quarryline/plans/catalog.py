"""Queries over the driver's tables, one per operator, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import ids, metrics, quantities, text
from quarryline.operators import align, audit, blend, encode, images, quantiles, residuals, splits, training, validate
from quarryline.sources import tables
from quarryline.streaming import drift

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, directory) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns as doubles with so many digits, so that engines which add in another order agree."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c, kind in df.dtypes if kind in ("double", "float")})


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a regression: y the price, p a prediction within a fifth of it, fold by key."""
    o = read(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_orderstatus", F.col("o_totalprice").alias("y"), (F.col("o_totalprice") * (1 + ((F.col("o_orderkey") % 21) - 10) / 50)).alias("p"), (F.col("o_orderkey") % 5).cast("int").alias("fold"))


_P = "SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate, o_orderstatus, o_totalprice AS y, o_totalprice * (1 + ((o_orderkey % 21) - 10) / 50.0::DOUBLE) AS p, (o_orderkey % 5)::INT AS fold FROM orders"
_S = "CASE WHEN abs(y) + abs(p) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * abs(p - y) / (abs(y) + abs(p)) END"


def Y():  # noqa: N802
    return F.col("y")


def P():  # noqa: N802
    return F.col("p")


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a product catalog whose texts state quantities."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    say = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    pack = (F.col("p_size") % 5 + 1).cast("string")
    title = (
        F.when(k % 6 == 0, say(F.col("p_name"), " ", s, " g pack of ", pack)).when(k % 6 == 1, say(F.col("p_name"), " ", s, ".5 kg")).when(k % 6 == 2, say(F.col("p_name"), " ", pack, " x ", s, " ml bottle"))
        .when(k % 6 == 3, say("Cable ", s, " x ", pack, " cm 5G mobile")).when(k % 6 == 4, say("Charger ", s, " W ", pack, "000 mAh 128 GB")).otherwise(say("1/2 liter jug, ", s, "% cotton, 220 v WH-", s, "XM4"))
    )
    return read(spark, d, "part").select(
        F.col("p_partkey").alias("PRODUCT_ID"), title.alias("TITLE"), F.when(k % 7 != 0, say("set of ", pack)).alias("PACK_SIZE"), F.when(k % 3 != 0, say("Net wt ", s, " g each, ", F.col("p_type"))).alias("DESCRIPTION"),
        F.col("p_brand").alias("BRAND"), F.col("p_type").alias("CATEGORY"), F.col("p_retailprice").alias("PRICE"),
    )


_C = """SELECT p_partkey AS PRODUCT_ID, CASE WHEN p_partkey % 6 = 0 THEN p_name || ' ' || p_size || ' g pack of ' || (p_size % 5 + 1) WHEN p_partkey % 6 = 1 THEN p_name || ' ' || p_size || '.5 kg'
 WHEN p_partkey % 6 = 2 THEN p_name || ' ' || (p_size % 5 + 1) || ' x ' || p_size || ' ml bottle' WHEN p_partkey % 6 = 3 THEN 'Cable ' || p_size || ' x ' || (p_size % 5 + 1) || ' cm 5G mobile'
 WHEN p_partkey % 6 = 4 THEN 'Charger ' || p_size || ' W ' || (p_size % 5 + 1) || '000 mAh 128 GB' ELSE '1/2 liter jug, ' || p_size || '% cotton, 220 v WH-' || p_size || 'XM4' END AS TITLE,
 CASE WHEN p_partkey % 7 <> 0 THEN 'set of ' || (p_size % 5 + 1) END AS PACK_SIZE, CASE WHEN p_partkey % 3 <> 0 THEN 'Net wt ' || p_size || ' g each, ' || p_type END AS DESCRIPTION,
 p_brand AS BRAND, p_type AS CATEGORY, p_retailprice AS PRICE FROM part"""


# Metrics


def _metric(name: str, column, sql: str) -> None:
    def run(spark, d):
        return rounded(predicted(spark, d).agg(column(Y(), P()).alias("value")))

    run.__name__ = f"metric_{name}"
    query(f"WITH t AS ({_P}) SELECT round({sql}, 6) AS value FROM t")(run)


_metric("smape", metrics.smape, f"avg({_S})")
_metric("mape_epsilon", metrics.mape, "avg(abs(y - p) / greatest(abs(y), 1e-8::DOUBLE))")
_metric("mape_ignore", lambda y, p: metrics.mape(F.when(F.col("o_orderkey") % 9 == 0, 0.0).otherwise(y), p, "ignore"), "avg(abs(y - p) / abs(y)) FILTER (o_orderkey % 9 <> 0)")
_metric("mae", metrics.mae, "avg(abs(y - p))")
_metric("rmse", metrics.rmse, "sqrt(avg((y - p) * (y - p)))")


@query(f"WITH t AS ({_P}) SELECT round(avg((o_orderstatus = CASE WHEN o_orderkey % 4 = 0 THEN 'F' ELSE o_orderstatus END)::INT), 6) AS accuracy FROM t")
def metric_accuracy(spark, d):
    guess = F.when(F.col("o_orderkey") % 4 == 0, "F").otherwise(F.col("o_orderstatus"))
    return rounded(predicted(spark, d).agg(metrics.accuracy(F.col("o_orderstatus"), guess).alias("accuracy")))


@query(f"""WITH t AS (SELECT o_orderstatus AS a, CASE WHEN o_orderkey % 4 = 0 THEN 'F' ELSE o_orderstatus END AS b FROM ({_P})), l AS (SELECT a AS c FROM t UNION SELECT b FROM t),
 f AS (SELECT c, (SELECT count(*) FROM t WHERE a = c) AS s, (SELECT count(*) FROM t WHERE b = c) AS g, (SELECT count(*) FROM t WHERE a = c AND b = c) AS h FROM l)
 SELECT round(sum(h) / sum(s)::DOUBLE, 6) AS f1_micro, round(avg(coalesce(2.0 * h / nullif(s + g, 0), 0)), 6)::DOUBLE AS f1_macro, round(sum(s * coalesce(2.0 * h / nullif(s + g, 0), 0)) / sum(s), 6)::DOUBLE AS f1_weighted FROM f""")
def metric_f1(spark, d):
    guess = F.when(F.col("o_orderkey") % 4 == 0, "F").otherwise(F.col("o_orderstatus"))
    return rounded(metrics.f1_scores(predicted(spark, d).withColumn("b", guess), "o_orderstatus", "b"))


_OBJECTIVES = {
    "log_smape": ("tanh((p - y) / 0.05) * greatest(1e-4, 1 - tanh(abs(p - y) / 2) * tanh(abs(p - y) / 2))", "greatest(1e-3, greatest(1e-4, 1 - tanh(abs(p - y) / 2) * tanh(abs(p - y) / 2)) + 0.01)"),
    "raw_smape": ("2 * ((p - y) / sqrt((p - y) * (p - y) + 1e-4)) / greatest(1e-4, abs(p) + abs(y))", "greatest(1e-3, 2 / (greatest(1e-4, abs(p) + abs(y)) * sqrt((p - y) * (p - y) + 1e-4)))"),
    "log_mape": ("tanh(greatest(least(p - y, 8), -8) / 0.05) * exp(greatest(least(p - y, 8), -8))", "greatest(1e-3, exp(greatest(least(p - y, 8), -8)) + 0.01)"),
    "raw_mape": ("tanh((p - y) / 0.05) / greatest(1e-4, abs(y))", "greatest(1e-3, greatest(1e-4, 1 - tanh((p - y) / 0.05) * tanh((p - y) / 0.05)) / (0.05 * greatest(1e-4, abs(y))))"),
}


def _objective(kind: str, grad: str, hess: str) -> None:
    def run(spark, d):
        t = predicted(spark, d).select("o_orderkey", F.log1p("y").alias("y"), F.log1p("p").alias("p"))
        g, h = metrics.surrogate(kind, Y(), P())
        return rounded(t.select("o_orderkey", g.alias("grad"), h.alias("hess")))

    run.__name__ = f"obj_{kind}"
    fit = lambda s: s.replace("1e-4", "1e-4::DOUBLE").replace("1e-3", "1e-3::DOUBLE").replace("0.05", "0.05::DOUBLE").replace("0.01", "0.01::DOUBLE")
    query(f"WITH t AS (SELECT o_orderkey, ln(1 + y) AS y, ln(1 + p) AS p FROM ({_P})) SELECT o_orderkey, round({fit(grad)}, 6) AS grad, round({fit(hess)}, 6) AS hess FROM t")(run)


for _k, _v in _OBJECTIVES.items():
    _objective(_k, *_v)


@query(f"WITH t AS ({_P}) SELECT o_orderkey, round(2 * (sign(p - y) * (abs(y) + abs(p)) - abs(p - y) * sign(p)) / ((abs(y) + abs(p)) * (abs(y) + abs(p))) * 1000000.0::DOUBLE, 6) AS slope FROM t")
def smape_gradient(spark, d):
    return rounded(predicted(spark, d).select("o_orderkey", (metrics.smape_gradient(Y(), P()) * 1e6).alias("slope")))


# Residuals


_TIER = f"c AS (SELECT quantile_cont(y, 1/3::DOUBLE) AS lo, quantile_cont(y, 2/3::DOUBLE) AS hi FROM t), e AS (SELECT t.*, {_S} AS s, abs(p - y) AS a, CASE WHEN y <= lo THEN 'cheap' WHEN y >= hi THEN 'luxury' ELSE 'mid' END AS tier FROM t, c)"


@query(f"WITH t AS ({_P}), {_TIER} SELECT tier, o_orderpriority, count(*)::BIGINT AS n, round(avg(s), 6) AS smape, round(quantile_cont(s, 0.9), 6) AS p90 FROM e GROUP BY ALL")
def segment_price_tier(spark, d):
    t = residuals.price_tier(residuals.row_errors(predicted(spark, d), "y", "p"), "y")
    by = ["price_tier", "o_orderpriority"]
    q = quantiles.exact_quantiles(t, {"s": F.col("row_smape")}, [0.9], by=by).select(*by, F.col("q")[0].alias("p90"))
    return rounded(t.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("row_smape").alias("smape")).join(q, by).withColumnRenamed("price_tier", "tier"))


@query(f"WITH t AS ({_P}) SELECT o_orderkey, round(p - y, 4) AS residual, round(abs(p - y), 4) AS abs_error, round(abs(ln(1 + p) - ln(1 + y)), 6) AS log_error, round({_S}, 6) AS row_smape FROM t")
def row_errors(spark, d):
    t = residuals.row_errors(predicted(spark, d), "y", "p")
    return t.select("o_orderkey", F.round("residual", 4).alias("residual"), F.round("abs_error", 4).alias("abs_error"), F.round("log_error", 6).alias("log_error"), F.round("row_smape", 6).alias("row_smape"))


@query(f"""WITH t AS ({_P}), e AS (SELECT *, {_S} AS s, abs(p - y) AS a FROM t), g AS (SELECT count(*) AS rows, sum(a) AS total FROM e)
 SELECT o_orderpriority AS segment, count(*)::BIGINT AS n, round(avg(y), 4) AS target_mean, round(quantile_cont(y, 0.5), 4) AS target_median, round(avg(p), 4) AS prediction_mean, round(avg(p - y), 4) AS bias, round(avg(a), 4) AS mae,
 round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(avg(s), 4) AS smape, round(quantile_cont(s, 0.5), 4) AS median_row_smape, round(quantile_cont(s, 0.9), 4) AS p90_row_smape, round(quantile_cont(a, 0.95), 4) AS p95_abs_error,
 round(stddev_samp(s) / sqrt(count(*)), 4) AS smape_std_error, round(avg((p < y)::INT), 4) AS underprediction_rate, arg_min(o_orderkey, (-s, o_orderkey)) AS worst_id, round(count(*) / any_value(rows), 4) AS share_rows,
 round(sum(a) / any_value(total), 4) AS share_abs_error, count(*) >= 20 AS eligible FROM e, g GROUP BY o_orderpriority""")
def segment_category(spark, d):
    t = residuals.row_errors(predicted(spark, d), "y", "p")
    return rounded(residuals.segment_summary(t, "o_orderpriority", key="o_orderkey", target="y", prediction="p"), 4)


_TEXTS = ("set of 3 cups", "rice 5 kg for Rs. 40", "12 x 6 mm tiles, 4 pcs", "plain box")
_MODES = f"""WITH t AS (SELECT o_orderkey, y, CASE o_orderkey % 9 WHEN 0 THEN 0.4::DOUBLE * y WHEN 1 THEN 2.5::DOUBLE * y WHEN 2 THEN 0.5 WHEN 3 THEN -1.0 ELSE p END AS p,
 CASE o_orderkey % 4 {" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TEXTS))} END AS text FROM ({_P})), e AS (SELECT *, round({_S}, 9) AS s, abs(p - y) AS a FROM t)"""


def _errors(spark, d):
    """Predictions with failures of every kind, and texts with signals."""
    key = F.col("o_orderkey") % 9
    p = F.when(key == 0, Y() * 0.4).when(key == 1, Y() * 2.5).when(key == 2, 0.5).when(key == 3, -1.0).otherwise(P())
    t = predicted(spark, d).withColumn("p", p).withColumn("text", F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("o_orderkey") % 4 + 1).cast("int")))
    return residuals.row_errors(t, "y", "p").withColumn("row_smape", F.round("row_smape", 9))


@query(f"""{_MODES}, c AS (SELECT quantile_cont(s, 0.9) AS cut, count(*) AS rows FROM e),
 f AS (SELECT s, a, cut, [y > 0 AND p < 0.5 * y, p > 2 * greatest(y, 1), p <= 1, p < 0, regexp_matches(text, '\\b(?:pack|set|case|bundle|lot)\\s+of\\s+\\d+\\b|\\b\\d+\\s*[x×]\\s*\\d+\\b|\\b\\d+\\s*(?:pack|packs|pcs|pieces)\\b', 'i'),
 regexp_matches(text, '(?:₹|\\$|€|£)|\\b(?:rs\\.?|inr|usd|eur|gbp)\\b', 'i'), regexp_matches(text, '\\b\\d+(?:\\.\\d+)?\\s*(?:mg|g|kg|ml|l|litre|liter|oz|lb|cm|mm|m)\\b', 'i')] AS flags FROM e, c),
 m AS (SELECT unnest(['severe_underprediction', 'severe_overprediction', 'near_zero_prediction', 'negative_prediction', 'has_multipack_signal', 'has_currency_signal', 'has_unit_signal']) AS mode, unnest(range(1, 8)) AS i)
 SELECT mode, count(s)::BIGINT AS n, round(count(s) / (SELECT count(*) FROM e), 4) AS prevalence, round(avg(s), 4) AS smape, round(avg(a), 4) AS mae, round(avg((s >= cut)::INT), 4) AS share_top_decile_errors FROM m LEFT JOIN f ON flags[i] GROUP BY mode""")
def failure_modes(spark, d):
    return rounded(residuals.failure_modes(_errors(spark, d), "y", "p", F.col("text")), 4)


@query("SELECT * FROM (VALUES ('severe_underprediction', 0::BIGINT, 0.0::DOUBLE, NULL::DOUBLE), ('severe_overprediction', 0, 0.0, NULL), ('near_zero_prediction', 0, 0.0, NULL), ('negative_prediction', 0, 0.0, NULL), ('has_multipack_signal', 0, 0.0, NULL), ('has_currency_signal', 0, 0.0, NULL), ('has_unit_signal', 0, 0.0, NULL)) t(mode, n, prevalence, smape)")
def failure_modes_empty(spark, d):
    """Modes without rows are listed with a count of 0."""
    t = residuals.row_errors(predicted(spark, d).withColumn("p", Y()), "y", "p")
    return residuals.failure_modes(t, "y", "p").select("mode", "n", "prevalence", "smape")


@query(f"""{_MODES} SELECT o_orderkey, regexp_matches(text, '\\bset of|\\bx \\d|pcs') AS has_multipack, contains(text, 'Rs.') AS has_currency, regexp_matches(text, '\\d (kg|mm)\\b') AS has_unit FROM t""")
def error_signals(spark, d):
    s = residuals.text_signals(F.col("text"))
    return _errors(spark, d).select("o_orderkey", *(s[n].alias(n) for n in ("has_multipack", "has_currency", "has_unit")))


@query(f"""{_MODES} SELECT count(*)::BIGINT AS n, round(avg(s), 4) AS smape, round(avg(a), 4) AS mae, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(avg(p - y), 4) AS bias,
 round(quantile_cont(a, 0.5), 4) AS median_abs_error, round(quantile_cont(a, 0.9), 4) AS p90_abs_error, round(quantile_cont(a, 0.95), 4) AS p95_abs_error, round(quantile_cont(a, 0.99), 4) AS p99_abs_error, round(quantile_cont(s, 0.9), 4) AS p90_row_smape,
 round(avg((p < y)::INT), 4) AS underprediction_rate, round(avg((p > y)::INT), 4) AS overprediction_rate, round(avg((p = y)::INT), 4) AS exact_prediction_rate, round(avg((a / greatest(abs(y), 1) <= 0.1::DOUBLE)::INT), 4) AS within_10_percent_rate, round(avg((a / greatest(abs(y), 1) <= 0.2::DOUBLE)::INT), 4) AS within_20_percent_rate FROM e""")
def overall_metrics(spark, d):
    return rounded(residuals.overall(_errors(spark, d), "y", "p"), 4)


@query(f"WITH t AS ({_P}), e AS (SELECT *, {_S} AS s, abs(p - y) AS a, abs(ln(1 + greatest(p, 0)) - ln(1 + y)) AS l FROM t) SELECT o_orderkey, row_number() OVER (ORDER BY round(s, 9) DESC, round(a, 6) DESC, o_orderkey)::INT AS error_rank FROM e QUALIFY error_rank <= 50")
def worst_n(spark, d):
    t = residuals.row_errors(predicted(spark, d), "y", "p").withColumns({"row_smape": F.round("row_smape", 9), "abs_error": F.round("abs_error", 6)})
    return residuals.worst_rows(t, "o_orderkey").select("o_orderkey", "error_rank")


@query(f"WITH c AS (SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM ({_P})) SELECT o_orderkey, CASE WHEN n = 1 THEN 'singleton' WHEN n <= 5 THEN 'rare' WHEN n <= 20 THEN 'medium' ELSE 'frequent' END AS brand_tier FROM c")
def brand_tier(spark, d):
    return residuals.brand_tier(predicted(spark, d), "o_custkey").select("o_orderkey", "brand_tier")


@query("""SELECT doc_id, n::INT AS n_words, CASE WHEN n = 0 THEN 'empty' WHEN n <= 10 THEN 'short' WHEN n <= 30 THEN 'medium' WHEN n <= 100 THEN 'long' ELSE 'very_long' END AS text_tier
 FROM (SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}_]+')) AS n FROM documents)""")
def text_tier(spark, d):
    s = residuals.text_signals(F.col("text"))
    return read(spark, d, "documents").select("doc_id", s["n_words"].cast("int").alias("n_words"), s["text_tier"].alias("text_tier"))


# Folds


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1) % 5)::SMALLINT AS fold FROM orders")
def fold_kfold(spark, d):
    return splits.kfold(read(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderstatus, md5('42|' || o_orderkey), o_orderkey) - 1) % 5)::SMALLINT AS fold FROM orders")
def fold_stratified(spark, d):
    return splits.stratified(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", F.col("o_orderstatus")).select("o_orderkey", "fold")


@query("""WITH u AS (SELECT o_orderdate AS t, row_number() OVER (ORDER BY o_orderdate) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderdate FROM orders)),
 f AS (SELECT t, CASE WHEN r < n - 5 * (n // 6) THEN -1 ELSE (r - (n - 5 * (n // 6))) // (n // 6) END::SMALLINT AS fold FROM u) SELECT o_orderkey, fold FROM orders JOIN f ON o_orderdate = t""")
def fold_time(spark, d):
    return splits.time_folds(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").select("o_orderkey", "fold")


@query("SELECT 0::BIGINT AS leaking_groups, 5::BIGINT AS folds, true AS even")
def fold_group(spark, d):
    t = splits.group_folds(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey")
    sizes = t.groupBy("fold").count().agg(F.count(F.lit(1)).alias("folds"), (F.max("count") - F.min("count") <= 40).alias("even"))
    return splits.leaking_groups(t, "o_custkey").agg(F.count(F.lit(1)).alias("leaking_groups")).join(sizes)


@query("SELECT 0::BIGINT AS leaking_groups, 5::BIGINT AS folds")
def fold_stratified_group(spark, d):
    t = splits.stratified_group_folds(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", F.col("o_orderstatus"))
    return splits.leaking_groups(t, "o_custkey").agg(F.count(F.lit(1)).alias("leaking_groups")).join(t.agg(F.countDistinct("fold").alias("folds")))


@query(f"WITH t AS ({_P}) SELECT fold, count(*)::BIGINT AS rows, round(avg(y), 4) AS target_mean, round(stddev_samp(y), 4) AS target_std, round(min(y), 4) AS target_min, round(max(y), 4) AS target_max, round(count(*) / (SELECT count(*) FROM t), 4) AS fraction FROM t GROUP BY fold")
def fold_summary(spark, d):
    return rounded(splits.fold_summary(predicted(spark, d), "y"), 4)


@query("SELECT o_custkey, count(DISTINCT o_orderkey % 5)::BIGINT AS n_folds FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey % 5) > 1")
def fold_group_leak_check(spark, d):
    return splits.leaking_groups(predicted(spark, d), "o_custkey")


@query("""WITH q AS (SELECT list_distinct(quantile_cont(o_totalprice, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])) AS e FROM orders)
 SELECT s AS stratum, count(*)::BIGINT AS n FROM (SELECT len(list_filter(e, lambda x: o_totalprice > x))::INT AS s FROM orders, q) GROUP BY s""")
def regression_strata(spark, d):
    t = read(spark, d, "orders").select("o_totalprice")
    stratum, _ = splits.regression_strata(t, "o_totalprice")
    return t.groupBy(stratum.cast("int").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


# Text and quantities


_NUM = "TRY_CAST(nullif(regexp_extract(t, '(?i)\\b([0-9]+(?:\\.[0-9]+)?)\\s*{}', 1), '') AS DOUBLE)"


def _parse(name: str, parse, sql: str) -> None:
    def run(spark, d):
        return rounded(catalog(spark, d).select("PRODUCT_ID", parse(F.col("TITLE")).alias("value")))

    run.__name__ = f"parse_{name}"
    query(f"SELECT PRODUCT_ID, round(({sql})::DOUBLE, 6) AS value FROM (SELECT PRODUCT_ID, TITLE AS t FROM ({_C}))")(run)


_parse("weight", quantities.weight_grams, "coalesce(" + _NUM.format("kg\\b") + " * 1000, CASE WHEN t NOT LIKE '%5G mobile%' THEN " + _NUM.format("g\\b") + " END)")
_parse("volume", quantities.volume_ml, "CASE WHEN t LIKE '1/2 liter%' THEN 500 ELSE " + _NUM.format("ml\\b") + " END")
_parse("power", quantities.power_watts, _NUM.format("w\\b"))
_parse("voltage", quantities.voltage_volts, _NUM.format("v\\b"))
_parse("battery", quantities.battery_mah, _NUM.format("mah\\b"))
_parse("storage", quantities.storage_gb, _NUM.format("gb\\b"))
_parse("percentage", quantities.percentage, _NUM.format("%"))


@query(f"""SELECT PRODUCT_ID, CASE WHEN n BETWEEN 1.5 AND 200 THEN n ELSE 1 END::DOUBLE AS count, (n BETWEEN 1.5 AND 200)::INT AS is_multi FROM (SELECT PRODUCT_ID,
 coalesce(TRY_CAST(nullif(coalesce(nullif(regexp_extract(TITLE, 'pack of ([0-9]+)', 1), ''), regexp_extract(TITLE, '([0-9]+) x [0-9]+ ml', 1)), '') AS DOUBLE), 1) AS n FROM ({_C}))""")
def parse_pack(spark, d):
    return catalog(spark, d).select("PRODUCT_ID", quantities.pack_count(F.col("TITLE")).alias("p")).select("PRODUCT_ID", "p.count", "p.is_multi")


@query(f"""SELECT PRODUCT_ID, round(CASE WHEN b IS NOT NULL THEN greatest(a, b) ELSE a END, 6)::DOUBLE AS length, round(least(a, b), 6)::DOUBLE AS width, NULL::DOUBLE AS height, round(a * b, 6)::DOUBLE AS volume FROM (SELECT PRODUCT_ID,
 TRY_CAST(nullif(regexp_extract(TITLE, '([0-9]+) x ([0-9]+) cm', 1), '') AS DOUBLE) AS a, TRY_CAST(nullif(regexp_extract(TITLE, '([0-9]+) x ([0-9]+) cm', 2), '') AS DOUBLE) AS b FROM ({_C}))""")
def parse_dims(spark, d):
    return rounded(catalog(spark, d).select("PRODUCT_ID", quantities.dimensions_cm(F.col("TITLE")).alias("x")).select("PRODUCT_ID", "x.*"))


@query(f"SELECT PRODUCT_ID, (len(c) > 0)::INT AS has, len(c)::INT AS count, coalesce(list_max(list_transform(c, lambda x: length(x))), 0)::INT AS longest FROM (SELECT PRODUCT_ID, list_filter(regexp_extract_all(TITLE, '\\bWH-[0-9]+XM4\\b|\\b[0-9]G\\b'), lambda x: x LIKE 'WH%') AS c FROM ({_C}))")
def model_codes(spark, d):
    return catalog(spark, d).select("PRODUCT_ID", quantities.model_codes(F.col("TITLE")).alias("c")).select("PRODUCT_ID", "c.*")


@query()
def specs_full(spark, d):
    return quantities.physical_specs(catalog(spark, d))


@query("""SELECT doc_id, length(t)::INT AS text_char_len, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> ''))::INT AS text_word_count, round((len(regexp_extract_all(t, '[0-9]')) / greatest(length(t), 1))::FLOAT::DOUBLE, 6) AS text_digit_ratio,
 round((len(regexp_extract_all(t, '[A-Z]')) / greatest(length(t), 1))::FLOAT::DOUBLE, 6) AS text_upper_ratio, len(regexp_extract_all(t, '[|/+*-]'))::INT AS text_delimiters_count, (length(t) = 0)::INT::TINYINT AS text_is_empty FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def text_surface(spark, d):
    stats = text.surface_stats(F.col("text"), "text")
    return rounded(read(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in stats.items())))


@query(f"SELECT PRODUCT_ID, concat_ws(' | ', 'Title: ' || TITLE, 'Brand: ' || BRAND, 'Category: ' || CATEGORY, 'Description: ' || DESCRIPTION[1:256]) AS text FROM ({_C})")
def format_catalog(spark, d):
    return catalog(spark, d).select("PRODUCT_ID", text.catalog_text(F.col("TITLE"), F.col("BRAND"), F.col("CATEGORY"), F.col("DESCRIPTION")).alias("text"))


@query(f"SELECT PRODUCT_ID, trim(' __FIELD_TITLE__ ' || TITLE || ' __FIELD_PACK_SIZE__ ' || coalesce(PACK_SIZE, '')) AS text FROM ({_C})")
def combined_text(spark, d):
    return catalog(spark, d).select("PRODUCT_ID", text.combined_text(catalog(spark, d), ["TITLE", "PACK_SIZE"]).alias("text"))


@query(f"SELECT PRODUCT_ID, CASE WHEN DESCRIPTION IS NOT NULL THEN 'NET WT ' || (PRODUCT_ID % 9) || ' g | ' ELSE '' END || 'pack of ' || (PRODUCT_ID % 3 + 2) AS text FROM ({_C})")
def label_lines(spark, d):
    n = lambda k, a=0: (F.col("PRODUCT_ID") % k + a).cast("string")
    lines = F.array(F.when(F.col("DESCRIPTION").isNotNull(), F.concat(F.lit("NET WT "), n(9), F.lit(" g"))), F.lit("Energy 200 kcal per serving 5 g"), F.concat(F.lit("buy "), n(3, 1), F.lit(" get 1 free")), F.lit("50% extra"), F.lit("hello"))
    return catalog(spark, d).select("PRODUCT_ID", text.packaging_lines(lines).alias("text"))


# Encodings


_CODE = "(s + 10 * g) / (n + 10)"


@query(f"WITH t AS (SELECT o_orderpriority AS category, ln(1 + y) AS y FROM ({_P})), g AS (SELECT avg(y) AS g FROM t), c AS (SELECT category, count(*) AS n, sum(y) AS s FROM t GROUP BY category) SELECT category, round({_CODE}, 6) AS code FROM c, g")
def te_full(spark, d):
    return rounded(encode.full_encoding(predicted(spark, d), "o_orderpriority", "y").select("category", "code"))


@query(f"""WITH t AS (SELECT *, ln(1 + y) AS l FROM ({_P})), f AS (SELECT DISTINCT fold FROM t), g AS (SELECT f.fold, avg(l) AS g FROM f JOIN t ON t.fold <> f.fold GROUP BY f.fold),
 c AS (SELECT f.fold, o_orderpriority, count(*) AS n, sum(l) AS s FROM f JOIN t ON t.fold <> f.fold GROUP BY ALL)
 SELECT o_orderkey, round({_CODE}, 4) AS code FROM t JOIN g USING (fold) JOIN c USING (fold, o_orderpriority)""")
def te_oof(spark, d):
    t = encode.out_of_fold_encoding(predicted(spark, d), ["o_orderpriority"], "y")
    return t.select("o_orderkey", F.round(F.col("te_o_orderpriority").cast("double"), 4).alias("code"))


@query(f"""WITH t AS (SELECT o_custkey % 97 AS c, ln(1 + y) AS y FROM ({_P}) WHERE o_orderkey % 4 <> 0), g AS (SELECT avg(y) AS g FROM t), m AS (SELECT c, count(*) AS n, sum(y) AS s FROM t WHERE c < 90 GROUP BY c)
 SELECT o_orderkey, round(coalesce({_CODE}, h), 3) AS code FROM (SELECT o_orderkey, o_custkey % 97 AS c FROM orders WHERE o_orderkey % 4 = 0) LEFT JOIN (SELECT c, n, s, g FROM m, (SELECT avg(y) AS g FROM t WHERE c < 90)) USING (c), (SELECT avg(y) AS h FROM t WHERE c < 90)""")
def te_unseen(spark, d):
    t = predicted(spark, d).withColumn("c", F.col("o_custkey") % 97)
    codes = encode.full_encoding(t.filter("o_orderkey % 4 <> 0 and c < 90"), "c", "y")
    return encode.apply_encoding(t.filter("o_orderkey % 4 = 0"), "c", codes).select("o_orderkey", F.round(F.col("te_c").cast("double"), 3).alias("code"))


@query("WITH t AS (SELECT p_partkey, nullif(p_size % 7, 0) AS x FROM part) SELECT p_partkey, coalesce(x, (SELECT quantile_cont(x, 0.5) FROM t))::DOUBLE AS x, (x IS NULL)::INT::TINYINT AS missing FROM t")
def impute_median(spark, d):
    t = read(spark, d, "part").select("p_partkey", F.nullif(F.col("p_size") % 7, F.lit(0)).cast("double").alias("x"))
    flagged = encode.missing_flags(t, {"x": "missing"})
    return encode.impute(flagged, encode.medians(t, ["x"]))


# Joins and identity


@query(f"WITH t AS ({_P}) SELECT o_orderkey, round(y, 6) AS y, round(p * 1.01::DOUBLE, 6) AS b FROM t")
def align_strict(spark, d):
    t = predicted(spark, d)
    return rounded(align.align_exact(t.select("o_orderkey", "y"), t.select("o_orderkey", (P() * 1.01).alias("b")), "o_orderkey"))


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'test' WHEN 1 THEN '-1' WHEN 2 THEN 'held-out' WHEN 3 THEN NULL WHEN 4 THEN '3' ELSE 'a' END AS fold FROM orders WHERE o_orderkey % 6 IN (4, 5)")
def evaluated_rows(spark, d):
    k = F.col("o_orderkey") % 6
    fold = F.when(k == 0, "test").when(k == 1, "-1").when(k == 2, "held-out").when(k == 4, "3").when(k == 5, "a")
    return read(spark, d, "orders").select("o_orderkey", fold.alias("fold")).filter(align.evaluated(F.col("fold")))


@query("SELECT o_orderkey, o_totalprice, ((row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1) % 5)::SMALLINT AS fold FROM orders")
def join_folds(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return align.attach_folds(o, splits.kfold(o.select("o_orderkey"), "o_orderkey"), "o_orderkey")


@query("SELECT c_custkey AS k, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def anti_missing_ids(spark, d):
    return align.key_differences(read(spark, d, "customer").select(F.col("c_custkey").alias("k")), read(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query(f"WITH t AS ({_P}) SELECT o_orderkey, fold, round(p, 4) AS a, round(p * 0.9::DOUBLE, 4) AS b FROM t")
def align_oof(spark, d):
    t = predicted(spark, d)
    one = t.select("o_orderkey", "y", "fold", P().alias("prediction"))
    two = t.select(F.col("o_orderkey").cast("double").alias("o_orderkey"), "y", "fold", (P() * 0.9).alias("prediction"))
    return rounded(align.align_predictions({"a": one, "b": two}, "o_orderkey", "y", "fold").select("o_orderkey", "fold", "a", "b"), 4)


@query("SELECT o_orderkey, 'number:' || o_orderkey AS n, 'int:' || o_orderkey AS s, 'text:' || o_orderstatus AS t FROM orders")
def canonical_ids(spark, d):
    o = read(spark, d, "orders")
    kind = o.schema["o_orderkey"].dataType
    return o.select("o_orderkey", ids.canonical_id(F.col("o_orderkey"), kind).alias("n"), ids.canonical_id(F.col("o_orderkey"), kind, "strict").alias("s"), ids.canonical_id(F.concat(F.lit(" "), F.col("o_orderstatus")), o.schema["o_orderstatus"].dataType).alias("t"))


# Audit


def halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as train and test, with the test prices raised a little."""
    o = read(spark, d, "orders").withColumn("x", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice") * 1.05).otherwise(F.col("o_totalprice")))
    return o.filter("o_orderkey % 4 <> 0"), o.filter("o_orderkey % 4 = 0")


_H = "SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice * 1.05::DOUBLE ELSE o_totalprice END AS x, (o_orderkey % 4 <> 0) AS train FROM orders"


@query("""SELECT c AS column, count(*)::DOUBLE AS rows, count(*) FILTER (v IS NULL)::DOUBLE AS missing, count(DISTINCT v)::DOUBLE AS nunique, 0::DOUBLE AS non_finite, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4)::DOUBLE AS min,
 round(quantile_cont(v, 0.01), 4)::DOUBLE AS p01, round(quantile_cont(v, 0.25), 4)::DOUBLE AS p25, round(quantile_cont(v, 0.5), 4)::DOUBLE AS median, round(quantile_cont(v, 0.75), 4)::DOUBLE AS p75, round(quantile_cont(v, 0.99), 4)::DOUBLE AS p99, round(max(v), 4)::DOUBLE AS max
 FROM (SELECT 'l_quantity' AS c, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem) GROUP BY c""")
def profile_numeric(spark, d):
    return rounded(audit.profile_numeric(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), 4)


@query("SELECT 'text' AS column, count(*)::BIGINT AS rows, count(*) FILTER (text IS NULL)::BIGINT AS missing, count(*) FILTER (trim(text) = '')::BIGINT AS blank, count(DISTINCT text)::BIGINT AS nunique, round(avg(length(text)), 4) AS mean_length, round(quantile_cont(length(text), 0.5), 4)::DOUBLE AS median_length, round(quantile_cont(length(text), 0.95), 4)::DOUBLE AS p95_length, max(length(text))::BIGINT AS max_length FROM documents")
def profile_text(spark, d):
    return rounded(audit.profile_text(read(spark, d, "documents"), ["text"]), 4)


@query("SELECT source AS value, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS fraction FROM documents GROUP BY source ORDER BY n DESC, value LIMIT 10")
def top_values(spark, d):
    return rounded(audit.top_values(read(spark, d, "documents"), "source"))


@query(f"WITH t AS ({_H}), v AS (SELECT x, count(*) FILTER (train) AS a, count(*) FILTER (NOT train) AS b FROM t GROUP BY x), n AS (SELECT sum(a) AS n, sum(b) AS m FROM v), c AS (SELECT sum(a) OVER (ORDER BY x) / n AS p, sum(b) OVER (ORDER BY x) / m AS q FROM v, n) SELECT round(max(abs(p - q)), 6)::DOUBLE AS ks, (SELECT n FROM n)::BIGINT AS n_train, (SELECT m FROM n)::BIGINT AS n_test FROM c")
def drift_ks(spark, d):
    return rounded(audit.drift_ks(*halves(spark, d), "x"))


@query(f"""WITH t AS ({_H}), q AS (SELECT quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM t WHERE train), b AS (SELECT len(list_filter(e, lambda v: x >= v)) AS bin, train FROM t, q),
 s AS (SELECT bin, greatest(count(*) FILTER (train) / (SELECT count(*) FROM b WHERE train), 1e-6) AS l, greatest(count(*) FILTER (NOT train) / (SELECT count(*) FROM b WHERE NOT train), 1e-6) AS r FROM b GROUP BY bin) SELECT round(sum((r - l) * ln(r / l)), 6) AS psi FROM s""")
def drift_psi(spark, d):
    return rounded(audit.drift_psi(*halves(spark, d), "x"))


@query("""WITH t AS (SELECT CASE WHEN o_orderkey % 4 = 0 AND o_custkey % 10 = 0 THEN 'new' ELSE o_orderpriority END AS v, o_orderkey % 4 <> 0 AS train FROM orders), c AS (SELECT v, count(*) FILTER (train) AS a, count(*) FILTER (NOT train) AS b FROM t GROUP BY v), n AS (SELECT sum(a) AS ta, sum(b) AS tb FROM c)
 SELECT round(sum(abs(a / ta - b / tb)) / 2, 6)::DOUBLE AS total_variation, coalesce(sum(b) FILTER (a = 0), 0)::BIGINT AS unseen_rows, round(coalesce(sum(b) FILTER (a = 0), 0) / any_value(tb), 6)::DOUBLE AS unseen_rate FROM c, n""")
def drift_tv(spark, d):
    a, b = halves(spark, d)
    b = b.withColumn("o_orderpriority", F.when(F.col("o_custkey") % 10 == 0, "new").otherwise(F.col("o_orderpriority")))
    return rounded(audit.drift_categories(a, b, "o_orderpriority"))


@query("""WITH w AS (SELECT unnest(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+'), lambda x: length(x) >= 2)) AS t, doc_id % 4 <> 0 AS train FROM documents), c AS (SELECT t, count(*) FILTER (train) AS a, count(*) FILTER (NOT train) AS b FROM w GROUP BY t)
 SELECT count(*) FILTER (a > 0)::BIGINT AS train_vocabulary, count(*) FILTER (b > 0)::BIGINT AS test_vocabulary, round(sum(b) FILTER (a = 0) / sum(b), 6)::DOUBLE AS oov_token_rate, round(count(*) FILTER (a = 0) / count(*) FILTER (b > 0), 6)::DOUBLE AS oov_unique_rate FROM c""")
def drift_oov(spark, d):
    t = read(spark, d, "documents")
    return rounded(audit.drift_vocabulary(t.filter("doc_id % 4 <> 0"), t.filter("doc_id % 4 = 0"), "text"))


@query("WITH g AS (SELECT text, lang, count(*) AS n FROM documents GROUP BY text, lang HAVING count(*) > 1) SELECT coalesce(sum(n), 0)::BIGINT AS duplicate_rows, count(*)::BIGINT AS duplicate_groups FROM g")
def dup_exact(spark, d):
    return audit.exact_duplicates(read(spark, d, "documents"), ["text", "lang"])


@query("SELECT o_custkey, o_orderpriority, count(*)::BIGINT AS n_rows, count(DISTINCT o_orderstatus)::BIGINT AS n_targets FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderstatus) > 1")
def dup_conflict(spark, d):
    return audit.conflicting_duplicates(read(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderstatus")


@query("""SELECT 0::BIGINT AS missing_id_rows, (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1))::BIGINT AS duplicate_id_rows,
 (SELECT count(*) FROM orders t WHERE o_orderkey % 4 = 0 AND EXISTS (SELECT 1 FROM orders k WHERE k.o_orderkey % 4 <> 0 AND k.o_custkey = t.o_custkey AND k.o_orderpriority = t.o_orderpriority))::BIGINT AS overlap_rows""")
def semi_overlap(spark, d):
    return audit.id_audit(*halves(spark, d), ["o_custkey", "o_orderpriority"])


@query("SELECT 'l_quantity' AS feature, count(*)::BIGINT AS n, false AS is_clone, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem UNION ALL SELECT 'l_extendedprice', count(*), true, 1.0 FROM lineitem UNION ALL SELECT 'l_tax', count(*), false, round(corr(l_tax, l_extendedprice), 6) FROM lineitem")
def leak_corr(spark, d):
    return rounded(audit.target_leaks(read(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_extendedprice", "l_tax"]))


@query("WITH g AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS k FROM orders GROUP BY o_custkey HAVING count(*) >= 2) SELECT sum(n)::BIGINT AS repeated_rows, coalesce(sum(n) FILTER (k = 1), 0)::BIGINT AS pure_rows, round(coalesce(sum(n) FILTER (k = 1), 0) / sum(n), 6)::DOUBLE AS purity FROM g")
def purity(spark, d):
    return rounded(audit.purity(read(spark, d, "orders"), "o_custkey", "o_orderstatus"))


@query("SELECT * FROM (VALUES ('TEST_MISSING_COLUMNS', 'o_orderdate', 'timestamp_ntz', NULL), ('TEST_EXTRA_COLUMNS', 'extra', NULL, 'int'), ('DTYPE_MISMATCH', 'o_custkey', 'bigint', 'string')) t(code, \"column\", train_type, test_type)")
def schema_diff(spark, d):
    o = read(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    return audit.schema_differences(o, o.drop("o_orderdate").withColumns({"extra": F.lit(1), "o_custkey": F.col("o_custkey").cast("string")}))


@query("SELECT 'x' AS column, round(avg((p_size % 7 = 0)::INT) FILTER (p_partkey % 4 <> 0), 6) AS train_rate, round(avg((p_size % 7 = 0)::INT) FILTER (p_partkey % 4 = 0), 6) AS test_rate, round(avg((p_size % 7 = 0)::INT) FILTER (p_partkey % 4 = 0) - avg((p_size % 7 = 0)::INT) FILTER (p_partkey % 4 <> 0), 6) AS delta FROM part")
def missingness(spark, d):
    t = read(spark, d, "part").select("p_partkey", F.nullif(F.col("p_size") % 7, F.lit(0)).alias("x"))
    return rounded(audit.missingness(t.filter("p_partkey % 4 <> 0"), t.filter("p_partkey % 4 = 0"), ["x"]))


@query("SELECT * FROM (VALUES ('p_size', 'int', 'tinyint'), ('p_retailprice', 'double', 'double')) t(\"column\", type, suggested)")
def narrower_types(spark, d):
    return audit.narrower_types(read(spark, d, "part"), ["p_size", "p_retailprice"])


_F = "o_custkey, o_orderstatus, o_orderpriority, x"


def _found(level: str, code: str, column: str | None, value: str, message: str, where: str, source: str) -> str:
    return f"SELECT '{level}' AS severity, '{code}' AS code, {f"'{column}'" if column else 'NULL'} AS \"column\", ({value})::DOUBLE AS value, '{message}' AS message FROM ({source}) WHERE {where}"


def _ks(column: str) -> str:
    return f"""SELECT max(abs(a / n - b / m)) AS v FROM (SELECT sum(sum(train::INT)) OVER o AS a, sum(sum((NOT train)::INT)) OVER o AS b, (SELECT count(*) FROM h WHERE train) AS n, (SELECT count(*) FROM h WHERE NOT train) AS m
 FROM h GROUP BY {column} WINDOW o AS (ORDER BY {column} ROWS UNBOUNDED PRECEDING))"""


def _shares(column: str, what: str) -> str:
    return f"SELECT {what} AS v FROM (SELECT count(*) FILTER (train) AS a, count(*) FILTER (NOT train) AS b, (SELECT count(*) FROM h WHERE train) AS n, (SELECT count(*) FROM h WHERE NOT train) AS m FROM h GROUP BY {column})"


_FOUND = [
    _found("error", "ID_DUPLICATE", "o_orderkey", "v", "rows", "v > 0", "SELECT coalesce(sum(n), 0) AS v FROM (SELECT count(*) AS n FROM h WHERE train GROUP BY o_orderkey HAVING count(*) > 1)"),
    _found("error", "TARGET_MISSING", "o_totalprice", "v", "rows without a target", "v > 0", "SELECT count(*) AS v FROM h WHERE train AND o_totalprice IS NULL"),
    _found("error", "TARGET_CLONE_FEATURE", "x", "1", "equals the target", "v", "SELECT bool_and(x = o_totalprice) AS v FROM h WHERE train"),
    _found("warning", "NEAR_PERFECT_TARGET_CORRELATION", "o_custkey", "v", "correlates with the target", "abs(v) >= 0.995", "SELECT corr(o_custkey, o_totalprice) AS v FROM h WHERE train"),
    _found("warning", "CONFLICTING_DUPLICATE_TARGETS", "o_totalprice", "v", "equal features with different targets", "v > 0", f"SELECT count(*) AS v FROM (SELECT 1 FROM h WHERE train GROUP BY {_F} HAVING count(DISTINCT o_totalprice) > 1)"),
    _found("warning", "EXACT_DUPLICATE_ROWS", None, "v", "rows that repeat", "v > 0", f"SELECT coalesce(sum(n), 0) AS v FROM (SELECT count(*) AS n FROM h WHERE train GROUP BY {_F}, o_totalprice HAVING count(*) > 1)"),
    _found("info", "DUPLICATE_TRAIN_FEATURES", None, "v", "rows whose features repeat", "v > 0", f"SELECT coalesce(sum(n), 0) AS v FROM (SELECT count(*) AS n FROM h WHERE train GROUP BY {_F} HAVING count(*) > 1)"),
    _found("warning", "TRAIN_TEST_FEATURE_OVERLAP", None, "v", "test rows whose features are in train", "v > 0", f"SELECT count(*) AS v FROM h WHERE NOT train AND ({_F}) IN (SELECT ({_F}) FROM h WHERE train)"),
    *(_found("warning", "HIGH_MISSING_RATE", c, "v", "many values are missing", "v >= 0.3", f"SELECT avg(({c} IS NULL)::INT) AS v FROM h WHERE train") for c in _F.split(", ")),
    *(_found("warning", "CONSTANT_COLUMN", c, "v", "one value or none", "v <= 1", f"SELECT count(DISTINCT {c}) AS v FROM h WHERE train") for c in _F.split(", ")),
    *(_found("warning", "NUMERIC_DRIFT", c, "v", "distributions differ", "v >= 0.2", _ks(c)) for c in ("o_custkey", "x")),
    *(_found("warning", "CATEGORICAL_DRIFT", c, "v", "shares differ", "v >= 0.2", _shares(c, "sum(abs(a / n - b / m)) / 2")) for c in ("o_orderstatus", "o_orderpriority")),
    *(_found("warning", "UNSEEN_TEST_CATEGORIES", c, "v", "test has new categories", "v >= 0.1", _shares(c, "sum(CASE WHEN a = 0 THEN b / m ELSE 0 END)")) for c in ("o_orderstatus", "o_orderpriority")),
]


@query(f"WITH h AS ({_H}) " + " UNION ALL ".join(_FOUND))
def audit_findings(spark, d):
    a, b = halves(spark, d)
    drop = ["o_orderdate"]
    return audit.audit(a.drop(*drop), b.drop(*drop, "o_totalprice"), target="o_totalprice", ids=["o_orderkey"])


# Blending and calibration


@query(f"WITH t AS ({_P}) SELECT o_orderkey, round(0.25::DOUBLE * p + 0.75::DOUBLE * (y + 1), 6) AS b FROM t")
def blend_arith(spark, d):
    t = predicted(spark, d).withColumn("q", Y() + 1)
    return rounded(t.select("o_orderkey", blend.blend(["p", "q"], [0.25, 0.75]).alias("b")))


@query(f"WITH t AS ({_P}) SELECT o_orderkey, round(exp(0.25::DOUBLE * ln(p) + 0.75::DOUBLE * ln(y + 1)), 4) AS b FROM t")
def blend_geo(spark, d):
    t = predicted(spark, d).withColumn("q", Y() + 1)
    return rounded(t.select("o_orderkey", blend.blend(["p", "q"], [0.25, 0.75], "geometric").alias("b")), 4)


@query(f"WITH t AS ({_P}), a AS (SELECT 0.5::DOUBLE * pow(4.0::DOUBLE, i / 128.0::DOUBLE) AS alpha FROM range(129) r(i)) SELECT round(alpha, 6) AS alpha, round(avg(2 * abs(p * alpha - y) / (abs(y) + abs(p * alpha))), 6) AS smape FROM t, a GROUP BY alpha")
def alpha_grid(spark, d):
    return rounded(blend.alpha_grid(predicted(spark, d), "y", "p"))


@query("SELECT 1.25::DOUBLE AS alpha")
def calibrated(spark, d):
    t = predicted(spark, d).withColumn("q", Y() / 1.25)
    return spark.createDataFrame([(round(blend.best_multiplier(t, "y", "q"), 6),)], "alpha double")


@query(f"WITH t AS ({_P}) SELECT 'p' AS i, 'p' AS j, round(sum(p / 1000 * p / 1000), 0) AS value FROM t UNION ALL SELECT 'p', 'y', round(sum(p / 1000 * y / 1000), 0) FROM t UNION ALL SELECT 'y', 'y', round(sum(y / 1000 * y / 1000), 0) FROM t")
def gram_matrix(spark, d):
    t = predicted(spark, d).select((P() / 1000).alias("p"), (Y() / 1000).alias("y"))
    return rounded(blend.gram_matrix(t, ["p"], "y"), 0)


@query("SELECT 0.25::DOUBLE AS a, 0.75::DOUBLE AS b")
def blend_weights(spark, d):
    t = predicted(spark, d).select(Y().alias("y"), (Y() * 0.7).alias("a"), (Y() * 1.1).alias("b"))
    w = blend.optimize_weights(t, ["a", "b"], "y").weights
    return spark.createDataFrame([tuple(round(x, 3) for x in w)], "a double, b double")


@query(f"WITH t AS ({_P}) SELECT o_orderkey, round(least(greatest(p, 1000), 200000), 4)::DOUBLE AS p FROM t")
def clamped(spark, d):
    return rounded(predicted(spark, d).select("o_orderkey", blend.clamp(P(), 1000, 200000).alias("p")), 4)


@query(f"WITH t AS ({_P}) SELECT o_orderkey, round((p + 2 * p + y) / 3, 4) AS mean, round(quantile_cont(v, 0.5), 4)::DOUBLE AS median, round(exp((ln(p) + ln(2 * p) + ln(y)) / 3), 4) AS geometric FROM (SELECT o_orderkey, p, y, unnest([p, 2 * p, y]) AS v FROM t) GROUP BY o_orderkey, p, y")
def predict_aggregates(spark, d):
    t = predicted(spark, d).select("o_orderkey", P().alias("a"), (P() * 2).alias("b"), Y().alias("c"))
    return rounded(t.select("o_orderkey", *(blend.aggregate_folds(["a", "b", "c"], m).alias(m) for m in ("mean", "median", "geometric"))), 4)


# Submission, preparation, images, streams, training


@query("SELECT * FROM (VALUES ('error', 'DUPLICATE_IDS', 'id', 1.0::DOUBLE), ('error', 'ID_SET_MISMATCH', 'id', 1.0), ('error', 'MISSING_PREDICTIONS', 'v', 1.0), ('error', 'PREDICTION_BELOW_MINIMUM', 'v', 1.0)) t(severity, code, \"column\", value)")
def validate_submission(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").cast("double").alias("v"))
    sent = n.select(F.when(F.col("id") == 3, 4).otherwise(F.col("id")).alias("id"), F.when(F.col("id") == 5, None).when(F.col("id") == 6, -1.0).otherwise(F.col("v")).alias("v"))
    return validate.validate_submission(sent, n, key="id", targets=["v"], least=0.0).drop("message")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE round(p_retailprice, 2) END AS price FROM part")
def parse_price(spark, d):
    shown = F.when(F.col("p_partkey") % 5 == 0, "free").when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("₹"), F.format_number("p_retailprice", 2))).otherwise(F.concat(F.lit("Rs. "), F.format_number("p_retailprice", 2)))
    return rounded(read(spark, d, "part").select("p_partkey", tables.parse_price(shown).alias("price")), 2)


@query("SELECT p_partkey::VARCHAR AS PRODUCT_ID, p_retailprice AS PRICE, p_name AS TITLE, '' AS DESCRIPTION, '' AS PACK_SIZE, '' AS BRAND, '' AS CATEGORY, 'http://x/' || p_partkey AS IMAGE_URL FROM part")
def adapt_schema(spark, d):
    raw = read(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), F.col("p_name").alias("catalog_content"), F.concat(F.lit("http://x/"), F.col("p_partkey")).alias("image_link"), F.col("p_retailprice").alias("price"))
    return tables.adapt_catalog(raw)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'unlabelled' WHEN ('0x' || substr(md5('42|' || o_orderkey), 1, 8))::BIGINT < (0.75 * 4294967296)::BIGINT THEN 'train' ELSE 'valid' END AS role FROM orders")
def split_75_25(spark, d):
    t = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("price"))
    return tables.split_labelled(t, "o_orderkey", "price").select("o_orderkey", "role")


@query("SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages")
def url_normalize(spark, d):
    return read(spark, d, "pages").select("page_id", images.normal_url(F.regexp_replace("url", "^http://([^/]+)", "HTTP://$1:80")).alias("url"))


@query("SELECT p_partkey, (i - 1)::INT AS image_index, 'https://x.example/' || p_partkey || '/' || i AS source_url FROM part, range(1, 3) r(i)")
def url_explode(spark, d):
    urls = F.concat(*(x for i in (1, 2, 3) for x in (F.lit("https://X.example/"), F.col("p_partkey"), F.lit(f"/{i} | "))))
    return images.image_references(read(spark, d, "part").withColumn("u", urls), "p_partkey", "u", 2).select("p_partkey", "image_index", "source_url")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem WHERE l_returnflag <> 'R') WHERE r <= 2")
def topn_images(spark, d):
    m = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_linenumber", "l_partkey").alias("image_index"), F.when(F.col("l_returnflag") != "R", "cached").otherwise("failed").alias("status"))
    return images.first_images(m, "l_orderkey", 2).select("l_orderkey", "l_linenumber")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) / list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 6)::DOUBLE AS norm FROM embeddings")
def l2_norm(spark, d):
    v = images.l2_normalised(F.col("embedding"))
    return rounded(read(spark, d, "embeddings").select("vec_id", F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x).alias("norm")))


@query("""WITH c AS (SELECT label, i, sum(x * pow(0.5::DOUBLE, vec_id % 3)) / sum(pow(0.5::DOUBLE, vec_id % 3)) AS v FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i)
 SELECT label, round(v / sqrt(n), 5) AS first FROM c JOIN (SELECT label, sum(v * v) AS n FROM c GROUP BY label) USING (label) WHERE i = 1""")
def pool_weighted(spark, d):
    t = read(spark, d, "embeddings").withColumn("i3", F.col("vec_id") % 3)
    return images.pooled(t, "label", "i3", "embedding", "weighted_mean").select("label", F.round(F.element_at("embedding", 1), 5).alias("first"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    t = drift.windowed_counts(read(spark, d, "events"), "ts", "event_type", "value")
    return rounded(t.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), 4)


@query()
def train_ridge_oof(spark, d):
    t = predicted(spark, d).withColumn("size", F.log1p("p"))
    config = training.TrainingConfig(key="o_orderkey", target="y", numeric=("size",), categorical=("o_orderpriority",), fold="fold")
    return training.train_cross_validated(t, config).oof.select("o_orderkey", "fold", "prediction")
