"""Toxicity scores by class-conditional Kneser-Ney models over the characters of words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import cut, mix64, with_scores

ORDINARY, TOXIC, SHARED = 0, 1, 2
#: Characters in the longest n-grams; the class models have orders from LEAST on, the shared model those up to LEAST.
ORDER, LEAST = 5, 3
#: Discounts that left-out rows choose from: None is that estimated from counts of counts.
DISCOUNTS = (None, 2.0, 4.0)
_MARKS = "\"'()[]{}<>.,;:!?*#$%&|-_/\\«»„“”‘’…"
_BEGIN, _END = 1, 2
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """The whole text's words in lower case, split at white space, without the marks around them."""
    return [w.strip(_MARKS) or w for w in (text or "").lower().split()]


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the characters of words, each with a begin and an end mark, laid out flat: the word's number, whether it is a
    word's begin, and by order n the hashes of the n characters that end there. What lies before a begin counts as
    empty characters. The context of an n-gram is the (n - 1)-gram that ends one place before."""
    n = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(n)
    code = np.empty(int(ends[-1]) if len(words) else 0, np.uint64)
    inner = np.ones(len(code), bool)
    inner[ends - 1] = inner[ends - n] = False
    code[ends - n], code[ends - 1] = _BEGIN, _END
    code[inner] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.zeros(len(code), bool)
    first[ends - n] = True
    keys, empty = np.zeros((ORDER + 1, len(code)), np.uint64), np.zeros(1, np.uint64)
    for m in range(1, ORDER + 1):
        before = np.roll(keys[m - 1], 1)
        before[first] = empty
        keys[m] = mix64(before * _STEP + code + np.uint64(1))
        empty = mix64(empty * _STEP + np.uint64(1))
    return np.repeat(np.arange(len(words)), n), first, keys


_COUNTS = ("n0", "n1", "n2")


_GRAM_COLUMNS = [*(f"k{m}" for m in range(ORDER, 0, -1)), *(f"c{m}" for m in range(ORDER, 0, -1)), *_COUNTS]
_GRAM_SCHEMA = ", ".join(f"{c} long" for c in _GRAM_COLUMNS)


def longest_grams(words: list[str], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The longest n-grams of words, with their counts (words, 3) added up: their hashes and those of their ends and contexts."""
    at = 0
    while at < len(words):
        size, stop = 0, at
        while stop < len(words) and (stop == at or size < 500_000):
            size += len(words[stop]) + 2
            stop += 1
        word, begins, keys = grams_of(words[at:stop])
        place = np.nonzero(~begins)[0]
        _, first, inverse = np.unique(keys[ORDER][place], return_index=True, return_inverse=True)
        sums = [np.bincount(inverse, weights=counts[at:stop, c][word[place]], minlength=len(first)).astype(np.int64) for c in range(3)]
        first, orders = place[first], range(ORDER, 0, -1)
        columns = (*(keys[m][first] for m in orders), *(keys[m - 1][first - 1] for m in orders))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*(c.view(np.int64) for c in columns), *sums)], _GRAM_COLUMNS)
        at = stop


def _count(learners):
    """Per partition: the longest n-grams of its words, with the numbers of documents among each class's learners that have
    a word with them, and of occurrences in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, every, known = learners.value, Counter(), {}

        def grams() -> Iterator[pa.RecordBatch]:
            words = list(every)
            counts = np.zeros((len(words), 3), np.int64)
            counts[:, SHARED] = list(every.values())
            if known:
                counts[:, :SHARED] = [known.get(w, (0, 0)) for w in words]
            yield from longest_grams(words, counts)
            every.clear(), known.clear()

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                every.update(words)
                if (label := of.get(doc)) is not None:
                    for w in set(words):
                        known.setdefault(w, [0, 0])[label] += 1
            if len(every) > 300_000:
                yield from grams()
        yield from grams()

    return run


def gram_counts(longest: DataFrame) -> list[DataFrame]:
    """From the longest n-grams of parts of the corpus, by order from the longest: (key, context, n0, n1, n2).

    The longest n-grams have their counts added up; a shorter one has the number of its different longer
    ones (by the character before), of each class and of all texts: the Kneser-Ney counts. They grow with the corpus.
    """
    of = cut(longest.groupBy(f"k{ORDER}").agg(*(F.first(c).alias(c) for c in _GRAM_COLUMNS[1 : 2 * ORDER]), *(F.sum(c).alias(c) for c in _COUNTS)))
    out = [of]
    for m in range(ORDER - 1, 0, -1):
        rest = [c for c in of.columns if c[0] in "kc" and int(c[1:]) <= m and c != f"k{m}"]
        of = cut(of.groupBy(f"k{m}").agg(*(F.first(c).alias(c) for c in rest), *(F.sum((F.col(c) > 0).cast("long")).alias(c) for c in _COUNTS)))
        out.append(of)
    return [t.select(F.col(f"k{m}").alias("key"), F.col(f"c{m}").alias("context"), *_COUNTS) for m, t in zip(range(ORDER, 0, -1), out, strict=True)]


def _needed(grams: DataFrame, m: int) -> DataFrame:
    """Those n-grams of order m that tell the classes apart: above LEAST those that a class has seen, at LEAST those in a
    context that a class has seen (elsewhere both classes pass everything on, alike), below it all."""
    if m > LEAST:
        return grams.filter("n0 + n1 > 0")
    return grams.join(grams.filter("n0 + n1 > 0").select("context").distinct(), "context", "left_semi") if m == LEAST else grams


def discounts(counts: np.ndarray, fixed: float | None = None, n: list[int] | None = None) -> np.ndarray:
    """What is taken off each count: a fixed discount, or those for 1, 2 and 3 or more that the numbers n of n-grams
    counted 1, 2, 3 and 4 times give (of counts, unless given)."""
    if fixed is not None:
        return np.minimum(counts, fixed)
    n = n or [int(np.sum(counts == i)) for i in range(1, 5)]
    y = n[0] / max(1, n[0] + 2 * n[1])
    by = np.array([0.0, *(min(i, max(0.0, i - (i + 1) * y * n[i] / max(1, n[i - 1]))) for i in (1, 2, 3))])
    return np.where(counts > 0, np.minimum(counts, by[np.minimum(counts, 3).astype(np.int64)]), 0)


def gather(grams: list[DataFrame]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """What scoring needs of gram_counts: by order (key, context, counts), and, up to LEAST, how many n-grams of all texts are
    counted 1, 2, 3 and 4 times. Its size is bounded by the texts of the labelled sample times the alphabet."""
    found = []
    for m, table in zip(range(ORDER, 0, -1), grams, strict=True):
        t = _needed(table, m).toArrow()
        key, context = (t.column(c).to_numpy().view(np.uint64) for c in ("key", "context"))
        counts = np.stack([t.column(c).to_numpy() for c in _COUNTS], 1)
        n = [int(np.sum(counts[:, SHARED] == i)) for i in range(1, 5)]
        if m == LEAST:  # its table isn't whole here
            n = [x or 0 for x in table.agg(*(F.sum((F.col("n2") == i).cast("long")) for i in range(1, 5))).first()]
        found.append((key, context, counts, n))
    return found


def shares_of(found: list[tuple], fixed: float | None) -> list[tuple]:
    """Parts of a Model from what gather returns: by order from 0, sorted keys of n-grams, for each the share that either
    class and the shared model keep for it, and the share that they pass on after it (1 where they haven't seen it)."""
    kept_by, passed_by = {}, {}
    for m, (key, context, counts, shared_n) in zip(range(ORDER, 0, -1), found, strict=True):
        contexts, of = np.unique(context, return_inverse=True)
        kept, passed = np.zeros((len(key), 3), np.float32), np.ones((len(contexts), 3), np.float32)
        for c in (ORDINARY, TOXIC, SHARED):
            off = discounts(counts[:, c], fixed) if c != SHARED else discounts(counts[:, c], None, shared_n)
            total = np.bincount(of, weights=counts[:, c], minlength=len(contexts))
            kept[:, c] = (counts[:, c] - off) / np.maximum(total[of], 1e-9)
            passed[:, c] = np.where(total > 0, np.maximum(np.bincount(of, weights=off, minlength=len(contexts)), 1e-4) / np.maximum(total, 1e-9), 1)
        kept_by[m], passed_by[m - 1] = (key, kept), (contexts, passed)
    parts, none = [], (np.empty(0, np.uint64), np.empty((0, 3), np.float32))
    for m in range(ORDER + 1):
        (key, kept), (contexts, passed) = kept_by.get(m, none), passed_by.get(m, none)
        keys = np.union1d(key, contexts)
        values = np.zeros((len(keys), 6), np.float32)
        values[:, 3:] = 1
        values[np.searchsorted(keys, key), :3] = kept
        values[np.searchsorted(keys, contexts), 3:] = passed
        parts.append((keys, values))
    return parts


_UNSEEN = np.array([0, 0, 0, 1, 1, 1], np.float32)


class Lookup:
    """Values of sorted 64-bit keys, which are hashes, through an open-addressed table; absent keys have those of _UNSEEN."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = np.r_[keys, np.zeros(1, np.uint64)], np.r_[values, _UNSEEN[None]]
        self.mask = np.uint64((1 << (2 * len(keys) + 1).bit_length()) - 1)
        self.slots = np.full(int(self.mask) + 1, len(keys), np.int32)
        rows, slot = np.arange(len(keys), dtype=np.int32), keys & self.mask
        while len(rows):
            free = self.slots[slot] == len(keys)
            self.slots[slot[free]] = rows[free]
            left = self.slots[slot] != rows
            rows, slot = rows[left], (slot[left] + np.uint64(1)) & self.mask

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        slot = wanted & self.mask
        row, none = self.slots[slot], len(self.keys) - 1
        left = np.nonzero((row != none) & (self.keys[row] != wanted))[0]
        while len(left):
            slot[left] = (slot[left] + np.uint64(1)) & self.mask
            row[left] = now = self.slots[slot[left]]
            left = left[(now != none) & (self.keys[now] != wanted[left])]
        return self.values[row]


class Model:
    """Interpolated Kneser-Ney over the characters of words, one for each class.

    Counts of the longest n-grams are numbers of documents that have a word with them (of all texts: occurrences), those
    of shorter ones numbers of different characters before. The class models back off from ORDER to LEAST and then to
    the shared model of all texts, which backs off from LEAST down to single characters and to 1 / 200: what a class has
    seen too rarely to outlive the discount counts as it does for the other class. In contexts that neither class has
    seen the shared model is taken below LEAST only, the same for both.
    """

    def __init__(self, parts: list[tuple], most_words: int = 400_000):
        self.tables = [Lookup(*part) for part in parts]
        self.seen: dict[str, float] = {}
        self.most_words = most_words

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        """(words, 2): each word's log-likelihood under the ordinary and the toxic model."""
        word, begins, keys = grams_of(words)
        at = np.nonzero(~begins)[0]
        found = [table(k) for table, k in zip(self.tables, keys, strict=True)]
        p = np.full((len(at), 2), 1 / 200)
        for m in range(1, LEAST + 1):
            p = found[m][at, 2:3] + found[m - 1][at - 1, 5:6] * p
        for m in range(LEAST, ORDER + 1):
            p = found[m][at, :2] + found[m - 1][at - 1, 3:5] * p
        p = np.log(p)
        return np.stack([np.bincount(word[at], weights=p[:, c], minlength=len(words)) for c in (ORDINARY, TOXIC)], 1)

    def know(self, words: set[str]) -> None:
        """Work out the gains of words not met before, a bounded number of characters at a time."""
        if len(self.seen) > self.most_words:
            self.seen.clear()
        new, at = list(words.difference(self.seen)), 0
        while at < len(new):
            size, stop = 0, at
            while stop < len(new) and (stop == at or size < 200_000):
                size += len(new[stop]) + 2
                stop += 1
            both = self.log_likelihoods(new[at:stop])
            self.seen.update(zip(new[at:stop], (both[:, TOXIC] - both[:, ORDINARY]).tolist(), strict=True))
            at = stop

    def gain(self, words: list[str]) -> np.ndarray:
        """Per word, the log-likelihood under the toxic model less that under the ordinary one."""
        try:
            return np.fromiter(map(self.seen.__getitem__, words), np.float64, len(words))
        except KeyError:
            self.know(set(words))
            return np.fromiter(map(self.seen.__getitem__, words), np.float64, len(words))

    def features_of(self, texts: list[str | None]) -> list[tuple[float, ...]]:
        """Features of texts; the words of all of them are worked out together."""
        words = [words_of(t) for t in texts]
        self.know(set().union(*words))
        return [self.features(w) for w in words]

    def features(self, words: list[str], window: int = 16, level: float = 2.5) -> tuple[float, ...]:
        """Length-normalised gains of a text: of all its words, of its most toxic window, of what exceeds the level by the
        number of words and by its root; of its three highest words; and the length itself."""
        g = np.clip(self.gain(words), -8, 8)
        if not len(g):
            return (0.0,) * N_FEATURES
        sums = np.cumsum(np.r_[0, g])
        n = min(window, len(g))
        over = float(np.maximum(g - level, 0).sum())
        top = np.partition(g, len(g) - min(3, len(g)))[-3:].sum()
        return float(g.mean()), float((sums[n:] - sums[:-n]).max() / window), over / len(g), over / math.sqrt(len(g)), float(top), math.log1p(len(g))


N_FEATURES = 6


def scorer(fitted) -> Callable:
    """What with_scores calls in each task."""
    parts, (coefficients, constant) = fitted

    def start():
        m = Model(parts.value)

        def score(texts: list[str | None]) -> list[float]:
            z = [constant + sum(a * x for a, x in zip(coefficients, f, strict=True)) for f in m.features_of(texts)]
            return [1 / (1 + math.exp(-max(-500.0, min(500.0, v)))) for v in z]

        return score

    return start


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Newton steps on standardised columns; coefficients of x as given, and the constant.

    The penalty is one unit at least, so that a few rows don't give large coefficients."""
    mid, spread = np.average(x, axis=0, weights=w), np.maximum(x.std(axis=0), 1e-9)
    z = np.c_[(x - mid) / spread, np.ones(len(x))]
    beta = np.zeros(z.shape[1])
    w = w / w.mean()
    penalty = np.diag(np.r_[np.full(z.shape[1] - 1, 1 + ridge * len(x)), 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + penalty, z.T @ (w * (y - p)) - penalty @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    coefficients = beta[:-1] / spread
    return coefficients, float(beta[-1] - coefficients @ mid)


def held_out(doc_id, parts: int, part: int):
    """True for rows whose labels may not be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def _split_labels(labels: DataFrame, most_per_class: int, ordinary_times: int, left_out: float) -> tuple[dict, dict, dict]:
    """(learners, judges, numbers of labels): doc_id -> class of a bounded sample of labelled rows, by hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.withColumn("draw", F.xxhash64("doc_id", F.lit("toxicity")))
    share = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    even = min(most_per_class, share.get(0, 0), share.get(1, 0))
    judges, learn = {}, {}
    for y, times in ((0, ordinary_times), (1, 1)):
        n = min(times * even, share.get(y, 0))
        ids = [r["doc_id"] for r in known.filter(F.col("y") == y).orderBy("draw", "doc_id").select("doc_id").limit(n + (1 - y) * most_per_class).collect()]
        at = n - int(left_out * n if y or n == share.get(y) else 0)
        learn |= dict.fromkeys(ids[:at], y)
        judges |= dict.fromkeys(ids[at:], y)
    return learn, judges, share


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, most_per_class: int = 2_000, ordinary_times: int = 6, left_out: float = 0.25):
    """(model, scale) learnt from the texts of docs and the labelled rows of labels (doc_id, toxic).

    The longest n-grams of the words of all texts are counted, and from them the Kneser-Ney counts of all shorter ones
    (gram_counts): tables that grow with the corpus and stay distributed. Class counts come from a bounded sample of the labelled rows, by hash, as
    only their ids can be broadcast: most_per_class toxic ones at most, and ordinary_times as many ordinary ones. What
    scoring needs are the n-grams of that sample and the shared counts behind them; they are broadcast as sorted arrays,
    none merged or left out. A share left_out of the sampled rows, or as many as most_per_class more ordinary ones, are left
    out of the counts: they choose the discount (of DISCOUNTS, by their likelihood) and set the scale, a logistic curve
    over the text's gains, weighted to the labels' own proportions.
    """
    spark = docs.sparkSession
    learn, judges, share = _split_labels(labels, most_per_class, ordinary_times, left_out)
    learners = spark.sparkContext.broadcast(learn)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = gather(gram_counts(texts.mapInArrow(_count(learners), _GRAM_SCHEMA)))
    candidates = [(d, spark.sparkContext.broadcast(shares_of(found, d))) for d in DISCOUNTS]
    del found

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Model(parts.value) for _, parts in candidates]
        for batch in batches:
            x = [row for m in models for row in m.features_of(batch.column("text").to_pylist())]
            i = np.repeat(np.arange(len(models), dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(x, pa.list_(pa.float64())), pa.array(batch.column("y").to_pylist() * len(models), pa.int32())], ["i", "x", "y"])

    sample = spark.createDataFrame(list(judges.items()), "doc_id long, y int")  # bounded by most_per_class
    judged = texts.join(F.broadcast(sample), "doc_id").select("text", "y").mapInArrow(judge, "i int, x array<double>, y int").toPandas()
    best = None
    for i, (_, parts) in enumerate(candidates):
        seen = judged[judged["i"] == i]
        y = seen["y"].to_numpy()
        if len(set(y.tolist())) < 2:
            return parts, ((2.0, 2.0, 0.0, 1.0, 0.2, 0.0), -6.0)
        x = np.array(seen["x"].to_list())
        weight = np.where(y == 1, share[1] / (y == 1).sum(), share[0] / (y == 0).sum())
        coefficients, constant = logistic(x, y, weight)
        z = np.clip(x @ coefficients + constant, -30, 30)
        loss = float((weight * np.log1p(np.exp(np.where(y == 1, -z, z)))).sum())
        if best is None or loss < best[0]:
            best = (loss, parts, (tuple(map(float, coefficients)), constant))
    return best[1], best[2]


def score_toxicity(docs: DataFrame, fitted) -> DataFrame:
    """Per row of docs: doc_id, score between 0 and 1. A null or empty text scores as one without any evidence."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_scores(texts, "score", scorer(fitted)).select("doc_id", "score")


def classify_toxicity(docs: DataFrame, labels: DataFrame, *, parts: int = 5, part: int = 0, **options) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted (1 if score >= 0.5).

    Labels are learnt only from rows whose crc32 of doc_id as text, modulo parts, isn't part. Labels that are null or
    not 0 or 1 don't count; of repeated labels the higher counts. A null doc_id is not held out and has no label.
    A null or empty text has no gains: its score is the scale's constant. Repeated rows score alike. Without labels of
    both classes the scale is a fixed one. An empty table gives an empty result.
    """
    learnt = labels.filter(~held_out(F.col("doc_id"), parts, part))
    scored = score_toxicity(docs, fit_toxicity(docs, learnt, **options))
    return scored.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, parts: int = 5, part: int = 0, **options) -> DataFrame:
    """The rows of docs that aren't scored toxic, whole. A score column of docs' own, if it has one, is left alone.

    Null and empty texts are scored by the scale's constant alone, and so stay unless most labels are toxic. Null and
    repeated doc_ids keep their rows; an empty table gives an empty result.
    """
    fitted = fit_toxicity(docs, labels.filter(~held_out(F.col("doc_id"), parts, part)), **options)
    name = "_toxicity"
    while name in docs.columns:
        name = f"_{name}"
    return with_scores(docs, name, scorer(fitted)).filter(F.col(name) < 0.5).drop(name)
