"""Image references, label detections and their quantities."""

from __future__ import annotations

import ipaddress
import posixpath
import random
import socket
import time
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.ids import canonical_id
from quarryline.functions.quantities import physical_specs
from quarryline.functions.text import LABEL_ENTITIES

OK = ("downloaded", "cached")
REDIRECTED = (301, 302, 303, 307, 308)
RETRIED = (408, 425, 429, 500, 502, 503, 504)


def normal_url(url: Column) -> Column:
    """http(s) without credentials, host in lower case, no default port or fragment, at least the path /; else null."""
    pattern = r"^(?i)(https?)://([^/?#@\s]+)(/[^?#\s]*)?(\?[^#\s]*)?(?:#\S*)?$"
    part = lambda i: F.regexp_extract(F.trim(url), pattern, i)
    scheme = F.lower(part(1))
    host = F.lower(part(2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    path = F.when(part(3) == "", "/").otherwise(part(3))
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), F.regexp_replace(host, ":$", ""), path, part(4)))


def image_references(catalog: DataFrame, key: str, urls: str, most: int = 1) -> DataFrame:
    """key, image_index, input_url, source_url, url_sha256: up to `most` addresses of a list divided by |, as the setting asks."""
    parts = F.slice(F.filter(F.transform(F.split(F.coalesce(F.col(urls), F.lit("")), r"\|"), F.trim), lambda u: u != ""), 1, most)
    listed = catalog.select(key, F.posexplode(parts).alias("image_index", "input_url"))
    return listed.withColumn("source_url", normal_url(F.col("input_url"))).withColumn("url_sha256", F.sha2("source_url", 256))


def first_images(manifest: DataFrame, key: str, most: int = 1) -> DataFrame:
    """Of usable images, the `most` lowest indexes of each product; Spark limits each partition before the shuffle."""
    order = Window.partitionBy(key).orderBy("image_index")
    return manifest.filter(F.col("status").isin(*OK)).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


#: Names that some file systems keep for devices.
RESERVED_NAMES = r"^(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"


def alias_stems(df: DataFrame, key: str) -> DataFrame:
    """df with alias: the id as a safe file stem, "item" for one without safe characters. Stems of over 120 characters and
    reserved names are cut to 100 and get the head of the canonical id's hash; so do stems that several rows share, but for case."""
    shown = F.regexp_replace(F.trim(F.col(key).cast("string")), r"[^A-Za-z0-9._-]+", "_")
    stem = F.coalesce(F.regexp_replace(shown, r"^[ ._]+|[ ._]+$", ""), F.lit(""))
    stem = F.when(stem == "", "item").otherwise(stem)
    mark = F.concat(F.lit("-"), F.substring(F.sha2(F.coalesce(canonical_id(F.col(key), df.schema[key].dataType, "strict"), F.lit("")), 256), 1, 12))
    stem = F.when((F.length(stem) > 120) | F.upper(stem).rlike(RESERVED_NAMES), F.concat(F.substring(stem, 1, 100), mark)).otherwise(stem)
    marked = df.withColumn("_stem", stem)
    clash = marked.groupBy(F.lower("_stem").alias("_low")).agg(F.count(F.lit(1)).alias("_n"))
    joined = marked.join(clash, F.lower("_stem") == F.col("_low"))
    return joined.withColumn("alias", F.when(F.col("_n") > 1, F.concat("_stem", mark)).otherwise(F.col("_stem"))).drop("_stem", "_low", "_n")


def safe_path(root: str, path: str) -> str:
    """The path under root, or an error if it leads out of it."""
    whole = posixpath.normpath(posixpath.join(root, path))
    if not whole.startswith(posixpath.normpath(root) + "/"):
        raise ValueError(f"{path} leads out of {root}")
    return whole


def public_addresses(host: str, resolve: Callable = socket.getaddrinfo) -> list[str]:
    """A host's addresses, all of which must be global: requests never reach inner networks."""
    found = sorted({a[4][0] for a in resolve(host, None)})
    if not found or any(not ipaddress.ip_address(a).is_global for a in found):
        raise PermissionError(f"{host} has addresses that aren't public")
    return found


def backoff(attempt: int, header: str | None, base: float = 0.75, most: float = 30.0) -> float:
    """Seconds to wait before the next attempt: what the server asks for, in seconds or as a date, up to most; else growing
    with jitter."""
    if header and header.strip().isdigit():
        return min(most, float(header))
    if header:
        try:
            at = parsedate_to_datetime(header)
            return min(most, max(0.0, at.timestamp() - time.time()))
        except (TypeError, ValueError):
            pass
    return min(most, base * 2**attempt + random.random() * base)


def request(fetch: Callable, url: str, check_host: bool, most_redirects: int = 5) -> tuple[int, str | None, bytes]:
    """fetch's answer, with redirects followed. Where hosts are checked, every hop's host is, and fetch gets the checked address
    to connect to, so that the name can't be resolved to an inner one in between."""
    for _ in range(most_redirects + 1):
        parts = urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.hostname:
            raise PermissionError(f"{url} isn't an address of the web")
        code, header, body = fetch(url, public_addresses(parts.hostname)[0]) if check_host else fetch(url)
        if code not in REDIRECTED or not header:
            return code, header, body
        url = urljoin(url, header)
    raise PermissionError("too many redirects")


def fetch_images(references: DataFrame, fetch: Callable[..., tuple[int, str | None, bytes]], *, known: DataFrame | None = None, attempts: int = 4, most_bytes: int = 25 * 2**20, check_host: bool = True, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """references with status, http_status, byte_count, content_sha256, attempts, error.

    Distinct addresses are fetched once on the executors through fetch(url, address) -> (status, header, body), which connects to
    the address given (where check_host is off, fetch(url)), and joined back; header is Retry-After, or of a redirect its
    Location. Redirects are followed by the same checks (request). Those in
    known (url_sha256, content_sha256, byte_count), a table of earlier results, aren't fetched again.
    """
    urls = references.filter("source_url is not null").select("url_sha256", "source_url").distinct()
    old = None
    if known is not None:
        old = known.select("url_sha256", F.lit("cached").alias("status"), F.lit(None).cast("int").alias("http_status"), "byte_count", "content_sha256", F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))
        urls = urls.join(known, "url_sha256", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for pdf in batches:
            rows = []
            for key, url in zip(pdf["url_sha256"], pdf["source_url"], strict=True):
                code, size, digest, error, n = None, None, None, None, 0
                try:
                    for n in range(1, attempts + 1):
                        code, header, body = request(fetch, url, check_host)
                        if code in RETRIED and n < attempts:
                            wait(backoff(n - 1, header))
                            continue
                        if code != 200:
                            error = f"HTTP {code}"
                        elif len(body) > most_bytes:
                            error = "too large"
                        else:
                            size, digest = len(body), hashlib.sha256(body).hexdigest()
                        break
                except Exception as e:  # noqa: BLE001  the error is the row's result
                    error = f"{type(e).__name__}: {e}"[:300]
                rows.append((key, "failed" if error else "downloaded", code, size, digest, n, error))
            yield pd.DataFrame(rows, columns=["url_sha256", "status", "http_status", "byte_count", "content_sha256", "attempts", "error"]).astype({"http_status": "Int64", "byte_count": "Int64"})

    done = urls.mapInPandas(run, "url_sha256 string, status string, http_status int, byte_count long, content_sha256 string, attempts int, error string")
    done = done if old is None else done.unionByName(old)
    return references.join(done, "url_sha256", "left").withColumn("status", F.coalesce("status", F.lit("invalid_url")))


def manifest_summary(manifest: DataFrame, key: str) -> DataFrame:
    """One row: references, products, those with an image, failures, cache hits, bytes and distinct objects."""
    ok = F.col("status").isin(*OK)
    return manifest.agg(
        F.count(F.lit(1)).alias("n_references"), F.countDistinct(key).alias("products"), F.countDistinct(F.when(ok, F.col(key))).alias("products_with_image"), F.count_if(~ok).alias("failed"),
        F.count_if(F.col("status") == "cached").alias("cached"), F.coalesce(F.sum("byte_count"), F.lit(0)).alias("bytes"), F.countDistinct("content_sha256").alias("objects"),
    )


def l2_normalised(vector: Column) -> Column:
    """The vector over its norm; null for zero or non-finite vectors."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(vector, lambda x: x.cast("double") / norm))


def pooled(df: DataFrame, key: str, index: str, vector: str, method: str = "mean", decay: float = 0.5) -> DataFrame:
    """(key, embedding): a product's vectors by mean, max or index-weighted mean (decay ** index), then over its norm.

    Aggregated by component, so that a product's vectors are never gathered in a list; Spark combines them before the shuffle.
    """
    w = F.pow(F.lit(decay), F.col(index)) if method == "weighted_mean" else F.lit(1.0)
    parts = df.select(key, w.alias("w"), F.posexplode(vector).alias("i", "x")).groupBy(key, "i")
    value = F.max("x").cast("double") if method == "max" else F.sum(F.col("x") * F.col("w")) / F.sum("w")
    cells = parts.agg(value.alias("x"))
    listed = cells.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return listed.select(key, l2_normalised(F.col("v")).alias("embedding"))


def merged_detections(df: DataFrame, least: float = 0.35, overlap: float = 0.85) -> DataFrame:
    """df with detections (text, confidence, bbox, variant) merged: confident ones, best first, without repeats of a text and without
    boxes that cover one kept from the same variant; back in reading order. One row's array is one product's image."""
    good = F.filter("detections", lambda d: (d["confidence"] >= least) & (F.trim(d["text"]) != ""))
    ranked = F.array_sort(F.transform(good, lambda d: F.struct((-d["confidence"]).alias("c"), d["bbox"][1].alias("y"), d["bbox"][0].alias("x"), d.alias("d"))))
    key = lambda t: F.lower(F.regexp_replace(t, r"(?U)\W", ""))

    def area(b: Column) -> Column:
        return F.greatest(b[2] - b[0], F.lit(0)) * F.greatest(b[3] - b[1], F.lit(0))

    def iou(a: Column, b: Column) -> Column:
        w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
        common = F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))
        return F.coalesce(F.try_divide(common.cast("double"), (area(a) + area(b) - common).cast("double")), F.lit(0.0))

    def add(acc: Column, r: Column) -> Column:
        d = r["d"]
        again = F.exists(acc, lambda k: (key(k["text"]) == key(d["text"])) | ((k["variant"] == d["variant"]) & (iou(k["bbox"], d["bbox"]) > overlap)))
        return F.when(again, acc).otherwise(F.concat(acc, F.array(d)))

    kept = F.aggregate(ranked, F.filter("detections", lambda d: F.lit(False)), add)
    read = F.array_sort(F.transform(kept, lambda d: F.struct(d["bbox"][1].alias("y"), d["bbox"][0].alias("x"), d.alias("d"))))
    return df.withColumn("detections", F.transform(read, lambda r: r["d"]))


def backfill(catalog: DataFrame, labels: DataFrame, key: str, *, title: str = "TITLE", pack: str = "PACK_SIZE", description: str = "DESCRIPTION", text: str = "ocr_text") -> DataFrame:
    """catalog with ten quantities (LABEL_ENTITIES), each from the first of title, label, pack field and description that states
    it, and where it is from (<quantity>_source, or missing).

    Of labels, columns ocr_weight_g, ocr_volume_ml and ocr_pack_count, where it has them, come before what is parsed from
    its text; a non-finite one counts as missing. Keys are unique in both tables; a product without a label takes the other sources.
    """
    given = [c for c in ("ocr_weight_g", "ocr_volume_ml", "ocr_pack_count") if c in labels.columns]
    own = catalog.columns
    joined = catalog.join(labels.select(key, F.col(text).alias("_label"), *(F.col(c).cast("double").alias(f"_{c}") for c in given)), key, "left")
    names = []
    for n, c, role in (("title", title, "title"), ("ocr", "_label", "title"), ("pack_size", pack, "pack"), ("description", description, "description")):
        if c in joined.columns:
            names.append(n)
            rest = joined.columns
            roles = dict(title="_none", pack="_none", description="_none") | {role: "_source"}
            parsed = physical_specs(joined.select(F.struct(*rest).alias("_rest"), F.col(c).alias("_source")), **roles)
            values = [F.when(F.col("is_multipack") == 1, F.col(x)) if q == "pack_count" else F.col(x) for q, x in LABEL_ENTITIES.items()]
            joined = parsed.select("_rest.*", F.struct(*(v.cast("double").alias(q) for v, q in zip(values, LABEL_ENTITIES, strict=True))).alias(f"_{n}"))

    def stated(quantity: str, n: str) -> Column:
        x = F.col(f"_{n}")[quantity]
        if n == "ocr" and f"ocr_{quantity}" in given:
            x = F.col(f"_ocr_{quantity}")
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)

    out = []
    for q in LABEL_ENTITIES:
        out += [F.coalesce(*(stated(q, n) for n in names)).alias(q), F.coalesce(*(F.when(stated(q, n).isNotNull(), n) for n in names), F.lit("missing")).alias(f"{q}_source")]
    return joined.select(*(c for c in own if c not in LABEL_ENTITIES), *out)
