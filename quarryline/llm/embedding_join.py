"""Near-duplicate embeddings by an exact metric range join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import NO_NODE, cut, link_result, mix64, sound_vector, star_labels

_SLACK = 1e-6


def _unit(vectors: list) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of the sample, each the farthest from those chosen before it."""
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(far.argmax()))
    return sample[chosen]


def _assign(pivots, radius: float):
    """Home cell of each vector, and the cells that a vector within the radius could have as its home.

    With u at home in cell j and |u - v| <= r, the triangle inequality gives d(v, p_j) <= d(v, p_home) + 2r. The second
    test is its sharper form for Euclidean distances: v is within r of the plane halfway between both pivots.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pivots.value
        for pdf in batches:
            parts = [pdf.head(0).drop(columns="g").assign(cell=np.empty(0, np.int64), home=np.empty(0, bool))]
            for g, rows in pdf.groupby("g", sort=False):
                if g not in held:
                    parts.append(rows.drop(columns="g").assign(cell=g, home=True))
                    continue
                at, to, nearest = _subcells(held[g], _unit(rows["vector"].to_list()), radius)
                cell = mix64(np.uint64(g & 0xFFFFFFFFFFFFFFFF) ^ mix64(to.astype(np.uint64) + np.uint64(1))).astype(np.int64)
                parts.append(rows.drop(columns="g").iloc[at].assign(cell=cell, home=nearest))
            yield pd.concat(parts, ignore_index=True)

    return run


def _subcells(p: np.ndarray, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pivot, whether it is the row's nearest) for every pivot whose cell a row has to be in, by the tests of _assign."""
    apart = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
    d = np.sqrt(np.maximum(0, 2 - 2 * x @ p.T))
    home = d.argmin(axis=1)
    best = d[np.arange(len(d)), home][:, None]
    near = (d - best <= 2 * radius + _SLACK) & (d * d - best * best <= 2 * radius * apart[home] + _SLACK)
    near[np.arange(len(d)), home] = True
    at, to = np.nonzero(near)
    return at, to, to == home[at]


def _choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pivots of a cell from a bounded sample of its vectors."""
    for pdf in batches:
        chosen = [choose_pivots(_unit(list(map(list, sample))), n).tolist() for sample, n in zip(pdf["sample"], pdf["p"], strict=True)]
        yield pd.DataFrame({"cell": pdf["cell"], "pivots": chosen})


def _divide(radius: float):
    """Rows sorted by task: first a cell's pivots, then its vectors, streamed; a vector goes to the parts that are open to it,
    and is at home in one if it was at home in the cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, p = None, None
        for pdf in batches:
            parts = [pdf.head(0)[["k", "times", "vector", "cell", "home"]]]
            for t, rows in pdf.groupby("task", sort=False):
                if t != task:
                    task, p = t, None
                if len(first := rows[rows["pivots"].notna()]):
                    p = np.array([list(v) for v in first["pivots"].iloc[0]], np.float64)
                rows = rows[rows["pivots"].isna()]
                for i in range(0, len(rows), 4096):
                    some = rows.iloc[i : i + 4096]
                    at, to, nearest = _subcells(p, _unit(some["vector"].to_list()), radius)
                    part = some.iloc[at][["k", "times", "vector", "cell", "home"]]
                    cell = mix64(part["cell"].to_numpy().astype(np.int64).view(np.uint64) ^ mix64(to.astype(np.uint64) + np.uint64(1))).view(np.int64)
                    parts.append(part.assign(cell=cell, home=part["home"].to_numpy().astype(bool) & nearest))
            yield pd.concat(parts, ignore_index=True).astype({"k": "int64", "times": "int64", "cell": "int64", "home": "bool"})

    return run


def divide_cells(placed: DataFrame, radius: float, cell_rows: int, *, most_parts: int = 64, levels: int = 8) -> DataFrame:
    """placed with every cell of many vectors at home cut again by pivots of its own, and again, up to `levels` times.

    With u at home in part j of a cell and v in the cell, |u - v| <= r leaves v open for j by the same inequality, whether v
    is at home there or a copy; so copies stay bounded by the metric inside every part, however large the table is. A cell's
    pivots, most_parts at most, come from a sample of it and go to its tasks only; rows are dealt to them by salt.
    """
    kind = dict(placed.dtypes)["vector"]
    for level in range(levels):
        sizes = placed.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("n"), F.count(F.lit(1)).alias("m"))
        large = cut(sizes.filter(F.col("n") > 4 * cell_rows).select("cell", "n", F.ceil(F.col("m") / (16 * cell_rows)).cast("int").alias("salts"), F.least(F.lit(most_parts), F.ceil(2 * F.col("n") / cell_rows)).cast("int").alias("p")))
        if large.isEmpty():
            break
        of_large = placed.join(large, "cell")
        draw = F.pmod(F.xxhash64("k", F.lit(f"part {level}")), F.col("n")) < 4 * F.col("p")
        samples = of_large.filter(F.col("home") & draw).groupBy("cell").agg(F.collect_list("vector").alias("sample"), F.first("p").alias("p"))
        pivots = samples.mapInPandas(_choose, "cell long, pivots array<array<double>>").join(large, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        none = F.lit(None)
        first = pivots.select(F.xxhash64("cell", "salt").alias("task"), F.lit(False).alias("row"), "pivots", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("times"), none.cast(kind).alias("vector"), "cell", F.lit(False).alias("home"))
        rows = of_large.withColumn("salt", F.pmod(F.xxhash64("k"), F.col("salts")).cast("int"))
        rows = rows.select(F.xxhash64("cell", "salt").alias("task"), F.lit(True).alias("row"), none.cast("array<array<double>>").alias("pivots"), "k", "times", "vector", "cell", "home")
        divided = first.union(rows).repartition("task").sortWithinPartitions("task", "row").mapInPandas(_divide(radius), f"k long, times long, vector {kind}, cell long, home boolean")
        placed = cut(placed.join(large, "cell", "left_anti").select("k", "times", "vector", "cell", "home").union(divided))
    return placed


def _join(threshold: float):
    """Rows sorted by task: first a bounded block of vectors at home, then whatever may lie near them, streamed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, block, counts = None, None, None
        for pdf in batches:
            out = []
            for t, rows in pdf.groupby("task", sort=False):
                if t != task:
                    out += finish(block, counts)
                    task, block, counts = t, None, None
                members, others = rows[~rows["other"]], rows[rows["other"]]
                if len(members):
                    new = (members["k"].to_numpy(), np.asarray(members["vector"].to_list(), np.float64))
                    block = new if block is None else tuple(np.concatenate(x) for x in zip(block, new, strict=True))
                    counts = np.zeros(len(block[0]), np.int64)
                for i in range(0, len(others) if block is not None else 0, 2048):  # a block may have none at home
                    out += compare(block, others.iloc[i : i + 2048], counts)
            yield frame(out)
        yield frame(finish(block, counts))

    def compare(block, others: pd.DataFrame, counts: np.ndarray) -> list:
        k, x = block
        ok, y = others["k"].to_numpy(), np.asarray(others["vector"].to_list(), np.float64)
        linked = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)) >= threshold
        linked &= k[:, None] != ok
        counts += linked @ others["times"].to_numpy()
        a, b = np.nonzero(linked)
        label, key = star_labels(len(k) + len(ok), a, b + len(k)), np.concatenate([k, ok])
        far = np.nonzero(label != np.arange(len(key)))[0]
        return [np.stack([key[far], key[label[far]], np.zeros(len(far), np.int64)], 1)]

    def finish(block, counts) -> list:
        if block is None:
            return []
        some = np.nonzero(counts)[0]
        return [np.stack([block[0][some], np.full(len(some), NO_NODE), counts[some]], 1)]

    def frame(rows: list) -> pd.DataFrame:
        a, b, w = np.concatenate(rows or [np.empty((0, 3), np.int64)]).T
        return pd.DataFrame({"a": a, "b": b, "w": w})

    return run


def near_duplicate_vectors(vectors: DataFrame, *, threshold: float = 0.98, cell_rows: int = 1024, most_pivots: int = 4096) -> DataFrame:
    """Per row of (vec_id, embedding, label): vec_id, n_links, component_id, kept; links are pairs of equal label with
    cosine >= threshold in double precision, and none is lost.

    An exact metric range join over unit vectors, where the threshold is a chord length r. Pivots, at most most_pivots
    in all and broadcast, cut each label's vectors into cells; a vector is copied to the cells that the triangle
    inequality leaves open. Cells that are still large are cut again by pivots of their own (divide_cells), so that no
    cell grows with the table. Every cell is then joined by itself, in blocks of about cell_rows vectors at home against the
    cell's streamed rest. Tasks return link counts and spanning stars, so links are never rows. Equal vectors of a
    label are joined once and counted.

    A null label, or a vector that is null, zero, or has null or non-finite components, links with nothing: n_links 0
    and its own component. Vectors of unequal length do not link. Repeated vec_ids count as separate rows; an empty
    table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("label"))
    sound = sound_vector("vector") & F.col("label").isNotNull()
    rows = base.withColumn("k", F.when(sound, F.xxhash64("label", "vector", F.hash("vector"))))
    reps = cut(
        rows.filter("k is not null")
        .groupBy("k", F.xxhash64(F.col("label"), F.size("vector")).alias("g"), "vector")
        .agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("times"))
    )
    sizes = reps.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    total = reps.count()
    target = max(cell_rows, math.ceil(2 * total / most_pivots))
    wanted = sizes.filter(F.col("n") > target).withColumn("p", F.ceil(F.col("n") / target))
    share = (F.col("p") * 4 / F.col("n") * 2**30).cast("long")
    drawn = reps.join(wanted, "g").filter(F.pmod(F.xxhash64("k", F.lit("pivot")), F.lit(2**30)) <= share).select("g", "p", "vector").collect()
    by_group: dict[int, list] = {}
    for row in drawn:
        by_group.setdefault(row["g"], [row["p"]]).append(row["vector"])
    pivots = spark.sparkContext.broadcast({g: choose_pivots(_unit(x[1:]), x[0]) for g, x in by_group.items()})

    radius = math.sqrt(2 - 2 * threshold)
    placed = cut(reps.select("k", "times", "vector", "g").mapInPandas(_assign(pivots, radius), f"k long, times long, vector {dict(reps.dtypes)['vector']}, cell long, home boolean"))
    placed = divide_cells(placed, radius, cell_rows)
    blocks = placed.filter("home").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("blocks"))
    dealt = placed.join(blocks, "cell")
    members = dealt.filter("home").withColumn("block", F.pmod(F.xxhash64("k", F.lit("block")), F.col("blocks")).cast("int")).withColumn("other", F.lit(False))
    others = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("other", F.lit(True))
    tasks = members.select("cell", "block", "other", "k", "times", "vector").union(others.select("cell", "block", "other", "k", "times", "vector"))
    tasks = tasks.select(F.xxhash64("cell", "block").alias("task"), "other", "k", "times", "vector")
    found = cut(tasks.repartition("task").sortWithinPartitions("task", "other").mapInPandas(_join(threshold), "a long, b long, w long"))
    return link_result(rows, reps, found).withColumnRenamed("id", "vec_id")
