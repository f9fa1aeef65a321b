"""What the operators share: checkpoints, word hashing, connected components."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir as the cluster names it; only in local mode, where all share one disk, a folder of our own
    if it is unset. On a cluster that is an error, as other machines couldn't read such a folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarryline-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder, so that a lost executor costs a reread only."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files, broadcasts and checkpoints of rounds that are over. It does so when the driver collects
    its garbage, which by itself may be half an hour apart."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def star_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For the graph with edges a-b over 0..n-1, the smallest node of each node's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    return label


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph of (a long, b long), as (node, component), component the smallest node.

    Alternates large-star and small-star rounds until the edges stay as they are. A round has only grouped minima,
    which Spark combines before the shuffle, and joins whose hot keys adaptive execution splits; no component is
    ever gathered in one task. Each round is cut in the checkpoint folder.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
        else:
            both = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = both.join(least, "u")
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        out = out.filter("a <> b")
        return out if large else out.distinct()

    def mark(pairs: DataFrame):
        return pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = cut(edges.filter("a <> b").select("a", "b").distinct())
    seen = mark(now)
    while seen[0]:
        now = cut(star(star(now, True), False))
        if (new := mark(now)) == seen:
            break
        seen = new
    release(edges.sparkSession)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words through a bounded cache."""

    def __init__(self, most: int = 1_000_000):
        self.seen: dict[str, int] = {}
        self.most = most

    def __call__(self, words: list[str]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        try:
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in seen:
                    seen[w] = xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, hashes: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of k words (lower case, split at white space).

    A text of fewer words is one shingle of all of them; a text without words has none.
    """
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = hashes(words)
    n = max(1, len(w) - k + 1)
    h = np.full(n, min(len(w), k), np.uint64)
    for i in range(min(k, len(w))):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n])
    return np.unique(h)


NO_NODE = -(2**63)


def link_result(rows: DataFrame, reps: DataFrame, found: DataFrame) -> DataFrame:
    """One row per row of rows (id, k): id, n_links, component_id, kept.

    reps: (k, least, times), a distinct item, its smallest id and its number of rows. found: (a, b, w), where b is
    NO_NODE it says that k = a has w linked rows with other k, else it is an edge. A null k links with nothing.
    """
    links = found.filter(F.col("b") == NO_NODE).groupBy(F.col("a").alias("k")).agg(F.sum("w").alias("w"))
    parts = connected_components(found.filter(F.col("b") != NO_NODE).select("a", "b")).select(F.col("node").alias("k"), "component")
    info = reps.select("k", "least", "times").join(links, "k", "left").join(parts, "k", "left").withColumn("component", F.coalesce("component", "k"))
    least = info.groupBy("component").agg(F.min("least").alias("component_id"))
    info = info.join(least, "component").select("k", (F.coalesce("w", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "k").join(info, "k", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()))


def with_scores(docs: DataFrame, name: str, scorer: Callable) -> DataFrame:
    """docs with a further column of scores; rows pass through whole, so that texts are neither shuffled nor read twice.

    scorer() is called once in each task and gives a function from a list of texts to a list of scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in batches:
            texts, out = batch.column("text"), []
            for i in range(0, batch.num_rows, 1000):
                out += score(texts.slice(i, 1000).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(name, DoubleType())]))


def sound_vector(name: str):
    """True for a vector that is not null, not zero, and has finite components only."""
    x = F.col(name)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(x.isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))
