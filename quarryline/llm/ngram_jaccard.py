"""N-gram Jaccard self-join of documents by a chosen-path search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import NO_NODE, WordHashes, connected_components, cut, link_result, mix64, shingles, star_labels

COORDINATES = 128


def _min_hashes(tokens: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The smallest hash of the set under each of the coordinate functions."""
    low = (tokens >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(first), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 512):
        h = (low[i : i + 512, None] ^ first) * second
        h ^= h >> np.uint32(15)
        np.minimum(best, h.min(axis=0), out=best)
    return best


def _coordinate_functions(seed: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) + np.uint64(seed << 20))
    x = (x >> np.uint64(32)).astype(np.uint32)
    return x[:COORDINATES], x[COORDINATES:] | np.uint32(1)


def _sign(seed: int, runs: int, k: int):
    """Per document: set fingerprint and size, the paths of its first level for each run, and its min-hash coordinates."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest

        hashes, (first, second) = WordHashes(), _coordinate_functions(seed)
        salt = mix64(np.arange(1, runs + 1, dtype=np.uint64))
        for pdf in batches:
            key, size, paths, sig = [], [], [], []
            for text in pdf["text"]:
                s = shingles(text, hashes, k)
                size.append(len(s))
                if not len(s):
                    key.append(None), paths.append(None), sig.append(None)
                    continue
                m = _min_hashes(s, first, second)
                key.append(int(np.uint64(xxh3_64_intdigest(s.tobytes())).astype(np.int64)))
                paths.append(mix64(m[:runs].astype(np.uint64) ^ salt).astype(np.int64))
                sig.append((m & np.uint32(0x7FFF)).astype(np.int16))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "k": pd.array(key, "Int64"), "row": pdf["row"], "size": size, "paths": paths, "sig": sig})

    return run


def _compare(keep_at: float, size_ratio: float):
    """Within each small bucket (rows sorted by path), brute force over coordinates; a star per group found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            open_path = pdf["path"].iloc[-1] if len(pdf) else None
            rest = pdf[pdf["path"] == open_path]
            yield stars(pdf[pdf["path"] != open_path])
        if rest is not None:
            yield stars(rest)

    def stars(pdf: pd.DataFrame) -> pd.DataFrame:
        path, k, n = pdf["path"].to_numpy(), pdf["k"].to_numpy(), pdf["size"].to_numpy()
        a, b = [], []
        if len(pdf):
            sig = np.stack(pdf["sig"].to_list())
            lag = 1
            while len(at := np.nonzero(path[:-lag] == path[lag:])[0]):
                lo, hi = np.minimum(n[at], n[at + lag]), np.maximum(n[at], n[at + lag])
                at = at[(k[at] != k[at + lag]) & (lo >= size_ratio * hi)]
                for i in range(0, len(at), 20_000):
                    part = at[i : i + 20_000]
                    part = part[(sig[part] == sig[part + lag]).mean(axis=1) >= keep_at]
                    a.append(part), b.append(part + lag)
                lag += 1
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        label = star_labels(len(pdf), a, b)
        far = np.nonzero(label != np.arange(len(pdf)))[0]
        return pd.DataFrame({"a": k[far], "b": k[label[far]]})

    return run


def _keyed(k: int):
    """Texts that have words, with their set fingerprints."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest

        hashes = WordHashes()
        for pdf in batches:
            sets = [(t, shingles(t, hashes, k)) for t in pdf["text"]]
            rows = [(int(np.uint64(xxh3_64_intdigest(s.tobytes())).astype(np.int64)), t) for t, s in sets if len(s)]
            yield pd.DataFrame({"k": pd.array([r[0] for r in rows], "Int64"), "text": pd.array([r[1] for r in rows], "string")})

    return run


def _verify(threshold: float, k: int):
    """Exact Jaccard within a block or between two blocks of one candidate group (rows sorted by task)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest

        hashes, held, open_task = WordHashes(), [], None
        for pdf in batches:
            out = []
            for task, key, times, block, i, j, text in zip(*(pdf[c] for c in ("task", "k", "times", "block", "i", "j", "text")), strict=True):
                if task != open_task:
                    out += pairs(held)
                    held, open_task = [], task
                s = shingles(text, hashes, k)
                if len(s) and int(np.uint64(xxh3_64_intdigest(s.tobytes())).astype(np.int64)) == key:
                    held.append((key, times, block, i, j, s))
            yield frame(out)
        yield frame(pairs(held))

    def frame(rows: list) -> pd.DataFrame:
        rows = rows or [np.empty((0, 3), np.int64)]
        a, b, w = np.concatenate(rows).T
        return pd.DataFrame({"a": a, "b": b, "w": w})

    def pairs(held: list) -> list:
        if len(held) < 2:
            return []
        seen: set[int] = set()
        held = [x for x in held if not (x[0] in seen or seen.add(x[0]))]
        key, times, block = (np.array([x[c] for x in held], np.int64) for c in (0, 1, 2))
        i, j = held[0][3], held[0][4]
        sets = [x[5] for x in held]
        n = np.array([len(s) for s in sets])
        tokens, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        order = np.argsort(tokens, kind="stable")
        tokens, row = tokens[order], row[order]
        new = np.r_[True, tokens[1:] != tokens[:-1]] if len(tokens) else np.empty(0, bool)
        column = np.cumsum(new) - 1
        shared = np.bincount(column)[column] > 1
        row, column = row[shared], np.cumsum(np.r_[True, column[shared][1:] != column[shared][:-1]])[: shared.sum()] - 1 if shared.any() else column[shared]
        inter = np.zeros((len(sets), len(sets)))
        width, start = max(1, 4_000_000 // len(sets)), 0
        while start < len(row):
            c0 = column[start]
            stop = np.searchsorted(column, c0 + width)
            m = np.zeros((len(sets), min(width, column[stop - 1] - c0 + 1)), np.float32)
            m[row[start:stop], column[start:stop] - c0] = 1
            inter += m @ m.T
            start = stop
        linked = inter >= threshold * (n[:, None] + n - inter) - 1e-9
        np.fill_diagonal(linked, False)
        if i != j:
            linked &= block[:, None] != block
        w = linked @ times
        some = np.nonzero(w)[0]
        label = star_labels(len(sets), *np.nonzero(linked))
        far = np.nonzero(label != np.arange(len(sets)))[0]
        none = np.full(len(some), NO_NODE)
        return [np.stack([key[some], none, w[some]], 1), np.stack([key[far], key[label[far]], np.zeros(len(far), np.int64)], 1)]

    return run


def _sampled_partners(queries, threshold: float, most: int = 4):
    """For a bounded sample of sets, up to `most` others of each task whose sketches agree on the threshold or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, sketches = queries.value
        held: list[list[int]] = [[] for _ in asked]
        for pdf in batches:
            k = pdf["k"].to_numpy()
            for i in range(0, len(pdf), 128):
                sig = np.stack(pdf["sig"].iloc[i : i + 128].to_list())
                alike = np.count_nonzero(sketches[:, None, :] == sig[None], axis=2) >= threshold * COORDINATES
                for q, at in zip(*np.nonzero(alike), strict=True):
                    if len(held[q]) < most and asked[q] != k[i + at]:
                        held[q].append(int(k[i + at]))
        pairs = [(int(asked[q]), other) for q, others in enumerate(held) for other in others]
        yield pd.DataFrame(pairs, columns=["a", "b"]).astype("int64")

    return run


def _children():
    """Five paths from each path, by two coordinates each that the path samples: a pair at 0.8 shares one but for 6 in 1,000."""

    def at(c: int):
        return F.element_at("sig", F.pmod(F.xxhash64("path", F.lit(c)), F.lit(COORDINATES)).cast("int") + 1)

    return F.explode(F.array(*(F.xxhash64("path", F.lit(c), at(2 * c), at(2 * c + 1)) for c in range(5)))).alias("path")


def _candidates(rows: DataFrame, sketch: DataFrame, *, small: int, depth: int, keep_at: float, size_ratio: float) -> DataFrame:
    """Edges (a, b) that hold together the sets whose sketches agree on keep_at or more, as far as these runs find them.

    rows: (k, path, g), a set in the bucket `path` and the group it is known to be in. Buckets of one group tell
    nothing new and go. Those of at most `small` rows are compared by brute force. In a larger one every sketch is held
    against that of the bucket's hub. A split leaves a pair that agrees on a share s of the coordinates 5 s^2 common paths
    in the mean: where the mean share with the hub is 0.45 or more, splitting wouldn't thin the bucket out, so it is one
    candidate group of near copies, to be compared exactly. The rest is split on coordinates sampled by the path.
    """
    to_compare, edges = [], []
    for level in range(depth):
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("hub"), F.min("g").alias("g0"), F.max("g").alias("g1"))
        live = cut(rows.join(sizes.filter("n > 1 and g0 <> g1").drop("g0", "g1"), "path"))
        to_compare.append(live.filter(F.col("n") <= small).select("path", "k"))
        large = live.filter(F.col("n") > small)
        if large.isEmpty():
            break
        if level == depth - 1:  # as long a path as this is shared by near copies
            edges.append(large.select(F.col("k").alias("a"), F.col("hub").alias("b")))
            break
        hubs = large.select("path", "hub").distinct().join(sketch.select(F.col("k").alias("hub"), F.col("sig").alias("hub_sig")), "hub").select("path", "hub_sig")
        same = F.aggregate(F.zip_with("sig", "hub_sig", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y) / F.lit(float(COORDINATES))
        held = large.join(sketch.select("k", "sig"), "k").join(hubs, "path").select("path", "k", "g", "n", "hub", "sig", same.alias("same"))
        held = cut(held)
        alike = cut(held.groupBy("path").agg((F.avg("same") >= 0.45).alias("alike")))
        held = held.join(alike, "path")
        edges.append(held.filter("alike").select(F.col("k").alias("a"), F.col("hub").alias("b")))
        rows = held.filter("not alike").select("k", "g", _children())
    buckets = to_compare[0]
    for more in to_compare[1:]:
        buckets = buckets.union(more)
    near = buckets.join(sketch, "k").repartition("path").sortWithinPartitions("path").mapInPandas(_compare(keep_at, size_ratio), "a long, b long")
    for more in edges:
        near = near.union(more)
    return near


def _row_hash(docs: DataFrame):
    """A hash of the whole row, whatever the types of its columns."""
    return F.xxhash64(*(F.to_json(F.struct(docs[f"`{c}`"].alias("v"))) for c in sorted(docs.columns)))


def _linked(docs: DataFrame, *, threshold: float = 0.8, words: int = 5, recall: float = 0.999, runs: int = 10, most_rounds: int = 4, small: int = 256, depth: int = 4, block: int = 512, sample: int = 384, most_broadcast: int = 500_000, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, reps, found): per row doc_id, k (its set's fingerprint) and row (a hash of the whole row); per set its
    smallest id and its number of rows; and links as link_result takes them."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _row_hash(docs).alias("row"))
    signed = cut(base.mapInPandas(_sign(seed, runs, words), "doc_id long, k long, row long, size int, paths array<long>, sig array<short>"))
    some = signed.filter("k is not null")
    reps = cut(some.groupBy("k").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("times"), F.first("size").alias("size"), F.first("paths").alias("paths"), F.first("sig").alias("sig")))
    sketch = reps.select("k", "size", "sig")
    keep_at = max(0.0, threshold - 0.22)  # of 128 coordinates, at least so many agree at the threshold but for about 1 pair in 10^8

    asked = sketch.select("k", "sig").orderBy(F.xxhash64("k", F.lit("asked")), "k").limit(sample).collect()
    partners = None
    if asked:
        queries = spark.sparkContext.broadcast((np.array([r["k"] for r in asked]), np.array([r["sig"] for r in asked], np.int16)))
        partners = cut(sketch.select("k", "sig").mapInPandas(_sampled_partners(queries, threshold), "a long, b long"))
    groups = None
    for turn in range(most_rounds):
        if groups is None:
            rows = reps.select("k", F.col("k").alias("g"), F.explode("paths").alias("path"))
        else:  # other coordinate functions
            again = base.mapInPandas(_sign(seed + turn, runs, words), "doc_id long, k long, row long, size int, paths array<long>, sig array<short>").filter("k is not null").dropDuplicates(["k"])
            rows = cut(again.join(groups.withColumnRenamed("node", "k"), "k", "left").select("k", F.coalesce("g", "k").alias("g"), F.explode("paths").alias("path")))
        near = _candidates(rows, sketch, small=small, depth=depth, keep_at=keep_at, size_ratio=threshold)
        if groups is not None:
            near = near.union(groups.select(F.col("node").alias("a"), F.col("g").alias("b")))
        groups = cut(connected_components(near).withColumnRenamed("component", "g"))
        if partners is None or _recall(partners, groups) >= recall:
            break
    else:
        raise RuntimeError(f"{most_rounds} rounds of {runs} runs don't reach a recall of {recall}")

    counts = groups.join(reps.select(F.col("k").alias("node"), "size"), "node").groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("total"))
    counts = counts.select("g", F.ceil(F.greatest(F.col("m") / block, F.col("total") / (block * 1000))).cast("int").alias("blocks"))
    members = groups.join(counts, "g").join(reps.select(F.col("k").alias("node"), "doc", "times"), "node")
    member = members.select("g", F.col("node").alias("k"), "doc", "times", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "blocks")
    member, named = cut(member), base.filter("doc_id is not null").select("doc_id", "text")
    if member.count() <= most_broadcast:  # their ids are few: other texts aren't shuffled
        named = named.join(F.broadcast(member.select(F.col("doc").alias("doc_id"))), "doc_id", "left_semi")
    texts = member.join(named, member["doc"] == named["doc_id"]).drop("doc_id")
    unnamed = base.filter("doc_id is null and text is not null").select("text")
    if not unnamed.isEmpty():  # sets that occur without a doc_id only are found by their fingerprints
        own = unnamed.mapInPandas(_keyed(words), "k long, text string").join(member.filter("doc is null").select("k"), "k", "left_semi").dropDuplicates(["k"])
        texts = texts.unionByName(member.filter("doc is null").join(own, "k"))
    tasks = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    tasks = tasks.select(F.xxhash64("g", "i", "j").alias("task"), "k", "times", "block", "i", "j", "text")
    found = cut(tasks.repartition("task").sortWithinPartitions("task").mapInPandas(_verify(threshold, words), "a long, b long, w long"))
    return signed.select("doc_id", "k", "row"), reps.select("k", F.col("doc").alias("least"), "times"), found


def _recall(partners: DataFrame, groups: DataFrame) -> float:
    """The share of the sampled links whose two sets are in one group."""
    of = groups.select("node", "g")
    joined = partners.join(of.select(F.col("node").alias("a"), F.col("g").alias("ga")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("g").alias("gb")), "b", "left")
    share = joined.agg(F.avg(F.coalesce(F.col("ga") == F.col("gb"), F.lit(False)).cast("double"))).first()[0]
    return 1.0 if share is None else share


def jaccard_groups(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, n_links (other rows whose word shingles have Jaccard >= threshold), component_id, kept.

    The search is a chosen-path join over min-hash coordinates. Each run puts a set into the bucket of one sampled
    coordinate. Buckets of at most `small` sets are compared by brute force; larger ones are split again on coordinates
    sampled by the bucket's own path, up to `depth` times, but for near copies of the bucket's hub (see _candidates).
    A pair at the threshold survives a run with probability about 0.75. Rounds of `runs` runs are repeated
    until the measured recall is `recall`: the links of `sample` sets, found by brute force over all
    sketches, must lie within groups. Buckets whose rows are in one group already aren't compared again. Last, all
    pairs inside a group are compared exactly, in blocks of about `block` sets: no group is gathered in one task, no
    pair is emitted as a row (tasks return link counts and spanning stars).

    Options are those of _linked: threshold 0.8, words 5, recall 0.999, runs 10, most_rounds 4 (an error
    is raised if they don't reach the recall), small 256, depth 4, block 512, sample 384, most_broadcast 500,000
    (more candidates than that meet the texts in a join by doc_id instead; the result is the same), seed 7.

    Equal shingle sets are joined once and counted. Rows with a null text, or without words, link with nothing: their
    component is their own doc_id. A null doc_id keeps a row; it takes the component of its text's group. Repeated
    doc_ids count as separate rows. An empty table gives an empty result. Other columns are ignored.
    """
    rows, reps, found = _linked(docs, **options)
    return link_result(rows.select(F.col("doc_id").alias("id"), "k"), reps, found).withColumnRenamed("id", "doc_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs of which one of each group is left: the one of the smallest doc_id, of repeated ids that of the
    smallest hash of the whole row, of wholly equal rows one.

    Rows with a null doc_id stay, as nothing names them, and so do rows with a null text or without words. A row under a
    repeated doc_id is judged by its own text. An empty table gives an empty result; other columns are kept as they are.
    """
    rows, reps, found = _linked(docs, **options)
    parts = connected_components(found.filter(F.col("b") != NO_NODE).select("a", "b")).select(F.col("node").alias("k"), "component")
    several = reps.join(parts, "k", "left").filter("component is not null or times > 1").select("k", F.coalesce("component", "k").alias("component"))
    named = rows.filter("doc_id is not null").join(several, "k").select("doc_id", "row", "component")
    chosen = named.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    judged = named.join(chosen, "component").groupBy("row").agg(F.min((F.struct("doc_id", "row") == F.col("first")).cast("int")).alias("stays"), F.count(F.lit(1)).alias("n"))
    name = "_row"
    while name in docs.columns:
        name = f"_{name}"
    judged = cut(judged.filter("stays = 0 or n > 1").select(F.col("row").alias(name), "stays"))
    hashed = docs.withColumn(name, _row_hash(docs))
    left = hashed.join(judged, name, "left_anti")
    repeated = judged.filter("stays = 1").drop("stays")
    if not repeated.isEmpty():
        left = left.unionByName(hashed.join(repeated, name).dropDuplicates([name]))
    return left.select(docs.columns)
