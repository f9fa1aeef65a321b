"""Fold assignment without leaks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.quantiles import quantile_values

WARM_UP = -1


def shuffle_key(key: Column, seed: int) -> Column:
    """A deterministic shuffle that other engines can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def _ranked_folds(df: DataFrame, key: str, strata: Column, n: int, seed: int, fold: str) -> DataFrame:
    """Fold = place in the order of (stratum, shuffle), modulo n: at most 1 apart within strata and overall.

    The place is the number of rows in earlier strata and shuffle buckets, of which there are as many as the rows need, plus
    the rank within one: rows are ranked in many partitions, never in one.
    """
    n_rows = df.count()
    digits = next((k for k in range(2, 7) if n_rows <= 50_000 * 16**k), 7)  # of the hash: buckets hold 50,000 rows or fewer
    marked = df.withColumns({"_s": strata, "_h": shuffle_key(F.col(key), seed)}).withColumn("_b", F.conv(F.substring("_h", 1, digits), 16, 10).cast("int"))
    sizes = marked.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.groupBy("_s").agg(F.sum("_n").alias("_t"))
    before = total.withColumn("_o", F.sum("_t").over(Window.orderBy("_s")) - F.col("_t")).select(F.col("_s").alias("_s1"), "_o")
    within = sizes.withColumn("_w", F.sum("_n").over(Window.partitionBy("_s").orderBy("_b")) - F.col("_n"))
    offsets = within.join(before, F.col("_s").eqNullSafe(F.col("_s1"))).select(F.col("_s").alias("_s2"), F.col("_b").alias("_b2"), (F.col("_o") + F.col("_w")).alias("_at"))
    joined = marked.join(offsets, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_b") == F.col("_b2")))
    rank = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", key)) - 1
    return joined.withColumn(fold, F.pmod(F.col("_at") + rank, F.lit(n)).cast("short")).select(*df.columns, fold)


def kfold(df: DataFrame, key: str, *, n_splits: int = 5, seed: int = 42, fold: str = "fold") -> DataFrame:
    """Shuffled folds whose sizes differ by at most 1."""
    return _ranked_folds(df, key, F.lit(0), n_splits, seed, fold)


def stratified(df: DataFrame, key: str, strata: Column, *, n_splits: int = 5, seed: int = 42, fold: str = "fold") -> DataFrame:
    """Folds whose sizes differ by at most 1, in every stratum and overall."""
    return _ranked_folds(df, key, strata, n_splits, seed, fold)


def regression_strata(df: DataFrame, target: str, *, n_splits: int = 5, bins: int = 20) -> tuple[Column, int]:
    """(stratum column, number of bins): right-closed bins between distinct quantiles, as many as give every bin n_splits
    rows. All numbers of bins are tried together. Raises if not even two do."""
    tries = list(range(bins, 1, -1))
    wanted = sorted({i / b for b in tries for i in range(b + 1)})
    at = dict(zip(wanted, quantile_values(df, F.col(target), wanted) or [], strict=False))
    cuts = {b: sorted({at[i / b] for i in range(b + 1) if at}) for b in tries}
    tries = [b for b in tries if len(cuts[b]) >= 3]
    if not tries:
        raise InfeasibleStrata("the target has too few values for bins")
    bin_of = lambda b: sum(((F.col(target) > e).cast("int") for e in cuts[b][1:-1]), F.lit(0))
    inner = F.array(*(F.struct(F.lit(b).alias("b"), F.array(*map(F.lit, cuts[b][1:-1])).alias("edges")) for b in tries))
    tried = df.select(F.col(target).cast("double").alias("x"), F.explode(inner).alias("t")).filter("x is not null").groupBy("t.b", F.size(F.filter("t.edges", lambda e: F.col("x") > e)).alias("bin")).count()
    least = {r["b"]: r["least"] for r in tried.groupBy("b").agg(F.min("count").alias("least"), F.count(F.lit(1)).alias("bins")).filter("bins >= 2").collect() if r["bins"] == len(cuts[r["b"]]) - 1}
    for b in tries:
        if least.get(b, 0) >= n_splits:
            return bin_of(b), len(cuts[b]) - 1
    raise InfeasibleStrata("the target has too few rows per bin")


class InfeasibleStrata(ValueError):
    pass


def class_strata(df: DataFrame, target: str, *, n_splits: int = 5, rare: str = "pool", most_listed: int = 1_000) -> Column:
    """The target as stratum, with classes of fewer than n_splits rows pooled, or rejected. Null is a class of its own.

    Up to most_listed rare classes are named in the column. Where there are more, it looks up each row's class in the table of
    class sizes by a sorted join, so that the driver holds no more of them than that.
    """
    few = [r[target] for r in df.groupBy(target).count().filter(F.col("count") < n_splits).select(target).limit(most_listed + 1).collect()]
    if few and rare == "error":
        raise InfeasibleStrata(f"classes with fewer than {n_splits} rows: {few[:20]}{' and more' if len(few) > 20 else ''}")
    own, label = F.col(target), F.col(target).cast("string")
    if not few:
        return label
    if len(few) > most_listed:
        name = f"_{target}_class"
        classes = df.select(own.alias(name)).hint("merge").alias("_classes").where(F.col(name).eqNullSafe(own.outer()))  # the alias hides df's own target, so that the outer one is meant
        return F.when(classes.select(F.count(F.lit(1))).scalar() < n_splits, "__RARE__").otherwise(label)
    listed = own.isin([c for c in few if c is not None])
    return F.when(listed | own.isNull() if None in few else listed, "__RARE__").otherwise(label)


def group_labels(df: DataFrame, columns: list[str], row_key: str, missing: str = "unique") -> Column:
    """One label per group of columns; rows with a missing part are groups of their own, one group, or rejected."""
    parts = [F.col(c).cast("string") for c in columns]
    absent = parts[0].isNull()
    for p in parts[1:]:
        absent = absent | p.isNull()
    lone = {"unique": F.concat(F.lit("m:"), F.col(row_key).cast("string")), "together": F.lit("m:"), "error": F.raise_error(F.lit("a group column is null"))}[missing]
    return F.when(absent, lone).otherwise(F.concat(F.lit("g:"), F.concat_ws("\x1f", *parts)))


def _place_groups(df: DataFrame, group: str, vectors: DataFrame, place, *, n_splits: int, seed: int, fold: str) -> DataFrame:
    """df with a fold for each group of vectors (group, _v: its counts), by one rule at every size.

    Groups of equal counts are a class, which is dealt round the folds: the places within it are ranked by hash, in many
    partitions. What is left over of each class, fewer than n_splits groups, is placed one by one by
    place(classes), which takes rows (_v, _left) and gives (_v, _i, _f). The driver sees such classes only, never groups.
    """
    marked = vectors.withColumn("_h", F.xxhash64(F.col(group), F.lit(seed))).withColumn("_b", F.pmod("_h", F.lit(256)))
    sizes = marked.groupBy("_v", "_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_v", "_b", (F.sum("_n").over(Window.partitionBy("_v").orderBy("_b")) - F.col("_n")).alias("_o"), F.sum("_n").over(Window.partitionBy("_v")).alias("_m"))
    classes = sizes.groupBy("_v").agg(F.sum("_n").alias("_m")).select("_v", (F.col("_m") % n_splits).alias("_left")).filter("_left > 0")
    table = df.sparkSession.createDataFrame(list(place(classes)), "_v array<long>, _i long, _f int")
    rank = F.row_number().over(Window.partitionBy("_v", "_b").orderBy("_h", group)) - 1
    placed = marked.join(offsets, ["_v", "_b"]).withColumn("_at", F.col("_o") + rank).withColumn("_i", F.col("_at") - (F.col("_m") - F.col("_m") % n_splits)).join(table, ["_v", "_i"], "left")
    chosen = placed.select(F.col(group).alias("_g"), F.coalesce("_f", F.pmod("_at", F.lit(n_splits)).cast("int")).cast("short").alias(fold))
    return df.join(chosen, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")


def group_folds(df: DataFrame, group: str, *, n_splits: int = 5, seed: int = 42, fold: str = "fold") -> DataFrame:
    """No group in two folds, sizes even: groups of one size are dealt round the folds, and what is left over of each size
    goes onto the lightest fold, the largest first. Of N rows, there are at most sqrt(2 N) sizes."""

    def place(classes: DataFrame) -> Iterator[tuple]:
        load = [0] * n_splits
        for row in classes.orderBy(F.desc("_v")).toLocalIterator():
            for i in range(row["_left"]):
                k = min(range(n_splits), key=lambda f: (load[f], f))
                load[k] += row["_v"][0]
                yield row["_v"], i, k

    sizes = df.groupBy(group).agg(F.array(F.count(F.lit(1))).alias("_v"))
    return _place_groups(df, group, sizes, place, n_splits=n_splits, seed=seed, fold=fold)


def stratified_group_folds(df: DataFrame, group: str, strata: Column, *, n_splits: int = 5, fold: str = "fold", seed: int = 42) -> DataFrame:
    """No group in two folds. Groups of equal counts in every stratum are dealt round the folds; what is left over of them
    goes where the strata's counts then differ least between folds, the most uneven strata first. What the driver
    holds grows with the number of different counts, not with that of groups."""
    counts = df.withColumn("_s", strata.cast("string")).groupBy(group).pivot("_s").count().fillna(0)
    names = [c for c in counts.columns if c != group]
    vectors = counts.select(group, F.array(*(F.col(f"`{c}`").cast("long") for c in names)).alias("_v"))

    def place(classes: DataFrame) -> Iterator[tuple]:
        sums = counts.agg(*(F.sum(f"`{c}`").alias(str(i)) for i, c in enumerate(names))).first()
        totals = [max(1, n or 0) for n in sums]
        load = [[0] * len(names) for _ in range(n_splits)]
        for row in sorted(classes.collect(), key=lambda r: (-_spread(r["_v"]), r["_v"])):
            v = row["_v"]
            for i in range(row["_left"]):

                def cost(k: int, v=v) -> tuple:
                    new = [[x + (c if f == k else 0) for x, c in zip(own, v, strict=True)] for f, own in enumerate(load)]
                    return sum(_spread([own[j] / totals[j] for own in new]) for j in range(len(names))), sum(load[k]), k

                k = min(range(n_splits), key=cost)
                load[k] = [x + c for x, c in zip(load[k], v, strict=True)]
                yield v, i, k

    return _place_groups(df, group, vectors, place, n_splits=n_splits, seed=seed, fold=fold)


def _spread(x: list[float]) -> float:
    mean = sum(x) / len(x)
    return (sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5


def _ranked(values: DataFrame, column: str, ranges: int = 64) -> DataFrame:
    """Distinct values with _r, their place from 0, and _u, their number. A window sees one range at a time: its place is the number of
    values in earlier ranges, of which there are few, plus the place within it."""
    number = F.col(column).cast("timestamp").cast("double") if dict(values.dtypes)[column] in ("timestamp", "date", "timestamp_ntz") else F.col(column).cast("double")
    cuts = values.agg(F.percentile_approx(number, [i / ranges for i in range(1, ranges)]).alias("q")).first()["q"] or []
    marked = values.withColumn("_g", sum(((number > c).cast("int") for c in sorted(set(cuts))), F.lit(0)))
    sizes = marked.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_g", (F.sum("_n").over(Window.orderBy("_g")) - F.col("_n")).alias("_o"), F.sum("_n").over(Window.partitionBy()).alias("_u"))
    place = F.row_number().over(Window.partitionBy("_g").orderBy(column)) - 1 + F.col("_o")
    return marked.join(F.broadcast(offsets), "_g").withColumn("_r", place).drop("_g", "_o")


def time_folds(df: DataFrame, time: str, *, n_splits: int = 5, fold: str = "fold") -> DataFrame:
    """Blocks of distinct times, the earliest of them a warm-up (-1); equal times stay together.

    Only the distinct times are ranked, within ranges of about equal size. With U of them, a block has U div (n + 1), and
    what is left over leads.
    """
    times = df.select(time).filter(F.col(time).isNotNull()).distinct()
    ranked = _ranked(times, time)
    block = F.expr(f"_u div {n_splits + 1}")
    first = F.col("_u") - n_splits * block
    place = ranked.withColumn(fold, F.when(F.col("_r") < first, F.lit(WARM_UP)).otherwise(F.floor((F.col("_r") - first) / block)).cast("short")).select(F.col(time).alias("_t"), fold)
    return df.join(place, F.col(time) == F.col("_t"), "left").drop("_t")


def resolve_strategy(groups: bool, time: bool, target: bool) -> str:
    if time and groups:
        raise ValueError("time and group folds can't be had together")
    return "time" if time else "stratified_group" if groups and target else "group" if groups else "stratified" if target else "kfold"


def validate_folds(df: DataFrame, *, fold: str = "fold", n_splits: int = 5, group: str | None = None, temporal: bool = False) -> None:
    """Folds are whole numbers 0..n-1 (and -1, if temporal), all there, and no group is in two."""
    seen = {r[0] for r in df.select(fold).distinct().limit(n_splits + 3).collect()}
    if seen - ({WARM_UP} if temporal else set()) != set(range(n_splits)):
        raise ValueError(f"folds are {sorted(map(str, seen))}")
    if group and not leaking_groups(df, group, fold).isEmpty():
        raise ValueError("a group lies in several folds")


def check_feasible(df: DataFrame, n_splits: int, *, strata: Column | None = None, group: str | None = None, time: str | None = None) -> None:
    """Raises InfeasibleStrata where n_splits folds can't be had: too few rows, rows of a stratum, groups, groups of a stratum, or times."""
    if n_splits < 2:
        raise InfeasibleStrata("folds are 2 at least")

    def need(n: int | None, what: str, least: int = n_splits) -> None:
        if (n or 0) < least:
            raise InfeasibleStrata(f"{n or 0} {what}, but {least} are needed")

    need(df.count(), "rows")
    if time:
        need(df.select(time).filter(F.col(time).isNotNull()).distinct().count(), "times", n_splits + 1)
    unit = [] if group is None else [group]
    if group:
        need(df.select(group).distinct().count(), "groups")
    if strata is not None:
        sizes = df.select(strata.cast("string").alias("_s"), *unit)
        by = sizes.groupBy("_s").agg(F.count_distinct(*unit).alias("n") if group else F.count(F.lit(1)).alias("n"))
        need(by.agg(F.min("n")).first()[0], "rows or groups in the smallest stratum")


def stratified_or_kfold(df: DataFrame, key: str, target: str, *, n_splits: int = 5, seed: int = 42, bins: int = 20, fold: str = "fold") -> tuple[DataFrame, str]:
    """(df with folds, strategy): folds stratified by the target's bins, or plain ones where it has too few values or rows for bins."""
    try:
        stratum, _ = regression_strata(df, target, n_splits=n_splits, bins=bins)
    except InfeasibleStrata:
        return kfold(df, key, n_splits=n_splits, seed=seed, fold=fold), "kfold"
    return stratified(df, key, stratum, n_splits=n_splits, seed=seed, fold=fold), "stratified"


def fold_metadata(df: DataFrame, key: str, *, strategy: str, n_splits: int, seed: int, fold: str = "fold") -> dict:
    """What a fold file is of: strategy, settings, rows of each fold, and a fingerprint of keys and folds whatever their order."""
    sizes = {str(r[fold]): r["count"] for r in df.groupBy(fold).count().collect()}
    row = df.agg(F.sum(F.xxhash64(key, fold).cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(key, fold)).alias("x")).first()
    return {"strategy": strategy, "n_splits": n_splits, "seed": seed, "rows": sum(sizes.values()), "fold_rows": sizes, "fingerprint": f"{row['s']}:{row['x']}"}


def leaking_groups(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    return df.groupBy(group).agg(F.countDistinct(fold).alias("n_folds")).filter("n_folds > 1")


def fold_summary(df: DataFrame, target: str, fold: str = "fold") -> DataFrame:
    total = Window.partitionBy()
    by_fold = df.groupBy(fold).agg(F.count(F.lit(1)).alias("rows"), F.avg(target).alias("target_mean"), F.stddev_samp(target).alias("target_std"), F.min(target).alias("target_min"), F.max(target).alias("target_max"))
    return by_fold.withColumn("fraction", F.col("rows") / F.sum("rows").over(total))


def iter_folds(df: DataFrame, *, n_splits: int, fold: str = "fold", temporal: bool = False) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(k, training rows, validation rows): all other folds, or all earlier ones and the warm-up."""
    for k in range(n_splits):
        yield k, df.filter(F.col(fold) < k if temporal else F.col(fold) != k), df.filter(F.col(fold) == k)
