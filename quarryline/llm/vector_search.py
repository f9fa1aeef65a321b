"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import cut, sound_vector


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Centroids of the rows of x; an empty cluster takes the row farthest from its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        d = _squared(x, c)
        own = d.argmin(axis=1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        for empty in np.nonzero(n == 0)[0]:
            far = int(d[np.arange(len(x)), own].argmax())
            c[empty], d[far] = x[far], 0
    return c


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * x @ c.T)


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, budget: int) -> list[int]:
    """Cells (i * len(second) + j) by growing first[i] + second[j], until they hold budget entries; empty ones are left out."""
    order1, order2 = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[order1], second[order2]
    cells, held, width = [], 0, len(b)
    heap, next_in_row = [(a[0] + b[0], 0, 0)], [0] * len(a)
    while heap and held < budget:
        _, i, j = heapq.heappop(heap)
        cell = int(order1[i]) * width + int(order2[j])
        if counts[cell]:
            cells.append(cell)
            held += int(counts[cell])
        next_in_row[i] = j + 1
        if j + 1 < width:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return cells


def _place(books):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = books.value
        for pdf in batches:
            if len(pdf):
                x = np.asarray(pdf["vector"].to_list(), np.float64)
                h = first.shape[1]
                cell = _squared(x[:, :h], first).argmin(axis=1) * len(second) + _squared(x[:, h:], second).argmin(axis=1)
                yield pdf.assign(cell=cell.astype(np.int32))

    return run


def _true_neighbours(queries, k: int):
    """For a bounded sample of queries, the k nearest of each batch: (query, cell, distance)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = queries.value
        for pdf in batches:
            if not len(pdf):
                continue
            d = _squared(q, np.asarray(pdf["vector"].to_list(), np.float64))
            n = min(k, d.shape[1])
            at = np.argpartition(d, n - 1, axis=1)[:, :n]
            cell = pdf["cell"].to_numpy()
            yield pd.DataFrame({"query": np.repeat(np.arange(len(q)), n), "cell": cell[at].ravel(), "d": np.take_along_axis(d, at, 1).ravel()})

    return run


def _route(plan):
    """Per query and shard, the cells to look into; bound is an upper limit of the k-th distance found in them, from the
    entries of a fixed sample that lie there (none if they are too few)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (first, second), counts, shard_from, shard_to, sample, sample_cells, budget, k = plan.value
        h = first.shape[1]
        for pdf in batches:
            out = {"shard": [], "id": [], "vector": [], "bound": [], "cells": []}
            for vec_id, vector in zip(pdf["id"], pdf["vector"], strict=True):
                x = np.asarray(vector, np.float64)[None]
                visited = traverse(_squared(x[:, :h], first)[0], _squared(x[:, h:], second)[0], counts, budget)
                d = _squared(x, sample[np.isin(sample_cells, visited)])[0]
                bound = float(np.partition(d, k)[k]) if len(d) > k else np.inf
                by_shard: dict[int, list[int]] = {}
                for cell in visited:
                    for shard in range(shard_from[cell], shard_to[cell] + 1):
                        by_shard.setdefault(shard, []).append(cell)
                for shard, cells in by_shard.items():
                    for c, v in zip(out, (shard, vec_id, vector, bound, cells), strict=True):
                        out[c].append(v)
            yield pd.DataFrame(out)

    return run


def _rerank(k: int):
    """Rows sorted by shard, the index first: exact distances of each query to the entries of its cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, index = None, None
        for pdf in batches:
            out = []
            for s, rows in pdf.groupby("shard", sort=False):
                if s != shard:
                    shard, index = s, None
                entries, asks = rows[~rows["ask"]], rows[rows["ask"]]
                if len(entries):
                    new = (entries["cell"].to_numpy(), np.asarray(entries["vector"].to_list(), np.float64), entries["ids"].to_list())
                    index = new if index is None else (np.concatenate([index[0], new[0]]), np.concatenate([index[1], new[1]]), index[2] + new[2])
                if len(asks) and index is not None:
                    out += search(index, asks)
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    def search(index, asks: pd.DataFrame) -> list:
        cell, x, ids = index
        out = []
        rough = _squared(np.asarray(asks["vector"].to_list(), np.float64), x)
        for row, (vec_id, vector, bound, cells) in enumerate(zip(asks["id"], asks["vector"], asks["bound"], asks["cells"], strict=True)):
            at = np.nonzero((rough[row] <= bound * (1 + 1e-9) + 1e-9) & np.isin(cell, cells))[0]
            if len(at) > 4 * k:  # by the rough distance, those that can be among the k + 1 nearest entries
                at = at[rough[row][at] <= np.partition(rough[row][at], k)[k] + 1e-6]
            d = np.sqrt(((x[at] - np.asarray(vector, np.float64)) ** 2).sum(axis=1))
            near = sorted((float(v), int(i)) for a, v in zip(at, d, strict=True) for i in ids[a] if i != vec_id)[:k]
            out += [(vec_id, i, v) for v, i in near]
        return out

    return run


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, *, k: int = 10, recall: float = 0.97, sample_rows: int = 20_000, tuning_queries: int = 64, bound_rows: int = 2048, shard_rows: int = 256, most_centroids: int = 256, seed: int = 11
) -> DataFrame:
    """For each row of queries (vec_id, embedding), its k nearest found in vectors (vec_id, embedding) by Euclidean
    distance in double precision, ties to the smaller vec_id, itself left out: query_id, rank, vec_id, score.

    An inverted multi-index: both halves of a vector are quantised by their own codebook (k-means on a hash sample of
    about sample_rows rows), every vector is entered under its pair of centroids, and a query walks the pairs by summed
    distance with a heap until they hold enough entries, which are then ranked exactly. How many are enough is
    measured: tuning_queries sampled queries are answered by brute force, and the budget is the smallest that reaches
    the stated recall on them. Codebooks, cell counts (at most most_centroids squared) and samples are all that is
    broadcast. Entries lie in shards of about shard_rows; a task holds one shard and streams the queries sent to it.

    Equal vectors are one entry with their k + 1 smallest vec_ids, which is all an answer can use. Vectors that are
    null, zero, or have null or non-finite components take no part, nor do those whose length isn't the most common
    one; null vec_ids take no part. Fewer than k candidates: all of them. Empty tables give an empty result.
    """
    spark = vectors.sparkSession

    def sound(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
        return df.filter(sound_vector("vector") & F.col("id").isNotNull())

    entries, asks = sound(vectors), sound(queries)
    kind = dict(entries.dtypes)["vector"]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    widths = entries.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if widths is None:
        return empty
    d = widths["d"]
    entries, asks = entries.filter(F.size("vector") == d), asks.filter(F.size("vector") == d)
    hashed = entries.select("id", "vector", F.xxhash64("vector").alias("k1"), F.hash("vector").alias("k2"))
    first_ids = hashed.withColumn("r", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))).filter(F.col("r") <= k + 1)
    index = first_ids.groupBy("k1", "k2").agg(F.first(F.when(F.col("r") == 1, F.col("vector")), ignorenulls=True).alias("vector"), F.sort_array(F.collect_list("id")).alias("ids"))
    index = cut(index)
    n = index.count()
    draw = F.pmod(F.xxhash64("k1", F.lit(seed)), F.lit(2**30))
    drawn = index.filter(draw <= int(min(1, sample_rows / n) * 2**30)).select("vector").toPandas()
    sample = np.asarray(drawn["vector"].to_list(), np.float64)[: 2 * sample_rows]
    h = max(1, d // 2)
    c = max(1, min(most_centroids, round(math.sqrt(n / 128)), len(sample)))
    books = spark.sparkContext.broadcast((k_means(sample[:, :h], c, seed=seed), k_means(sample[:, h:], c if d > 1 else 1, seed=seed)))
    placed = cut(index.select("k1", "vector", "ids").mapInPandas(_place(books), f"k1 long, vector {kind}, ids array<long>, cell int"))
    (first, second), width = books.value, len(books.value[1])
    counts = np.zeros(len(first) * width, np.int64)
    for row in placed.groupBy("cell").count().collect():
        counts[row["cell"]] = row["count"]

    n_asks = asks.count()
    if not n_asks:
        return empty
    some = asks.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2**30)) <= int(min(1, 2 * tuning_queries / n_asks) * 2**30)).orderBy("id").limit(tuning_queries).toPandas()
    budget = n
    if len(some):
        q = np.asarray(some["vector"].to_list(), np.float64)
        truth = placed.select("vector", "cell").mapInPandas(_true_neighbours(spark.sparkContext.broadcast(q), k + 1), "query int, cell int, d double")
        truth = truth.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("d", "cell"))).filter(F.col("r").between(2, k + 1)).select("query", "cell").collect()
        needed = []
        for i, x in enumerate(q):
            order = np.argsort((_squared(x[None, :h], first)[0][:, None] + _squared(x[None, h:], second)[0]).ravel(), kind="stable")
            reach = np.empty(len(order), np.int64)
            reach[order] = np.cumsum(counts[order])
            needed += [int(reach[row["cell"]]) for row in truth if row["query"] == i]
        budget = int(np.sort(needed)[min(len(needed) - 1, math.ceil(recall * len(needed)))]) if needed else n

    blocks = np.maximum(1, -(-counts // shard_rows))
    shard_from, shard_to, shard, filled = np.zeros(len(counts), int), np.zeros(len(counts), int), 0, 0
    for cell, rows in enumerate(counts):
        if filled and filled + rows > shard_rows:
            shard, filled = shard + 1, 0
        shard_from[cell], shard_to[cell] = shard, shard + blocks[cell] - 1
        shard, filled = (shard + blocks[cell], 0) if blocks[cell] > 1 else (shard, filled + rows)
    known = sample[:bound_rows]
    known_cells = _squared(known[:, :h], first).argmin(axis=1) * width + _squared(known[:, h:], second).argmin(axis=1)
    plan = spark.sparkContext.broadcast(((first, second), counts, shard_from.tolist(), shard_to.tolist(), known, known_cells, budget, k))
    table = spark.createDataFrame([(cell, int(shard_from[cell]), int(blocks[cell])) for cell in np.nonzero(counts)[0].tolist()], "cell int, start int, blocks int")
    entry_rows = placed.join(table, "cell").select(
        (F.col("start") + F.pmod(F.col("k1"), F.col("blocks"))).cast("int").alias("shard"), F.lit(False).alias("ask"), F.lit(None).cast("long").alias("id"), "vector", "ids", "cell", F.lit(None).cast("double").alias("bound"), F.lit(None).cast("array<int>").alias("cells")
    )
    routed = asks.mapInPandas(_route(plan), f"shard int, id long, vector {kind}, bound double, cells array<int>")
    ask_rows = routed.select("shard", F.lit(True).alias("ask"), "id", "vector", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("int").alias("cell"), "bound", "cells")
    near = entry_rows.union(ask_rows).repartition("shard").sortWithinPartitions("shard", "ask").mapInPandas(_rerank(k), "query_id long, vec_id long, score double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
