"""Operators of the training-data subpackage against brute force, libraries, held-out labels and odd tables."""

import hashlib
import html
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from quarryline.llm import embedding_join, html_text, licenses, ngram_jaccard, packing, pii, quality, sentencepiece_bpe, toxicity, vector_search  # noqa: E402

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, score string, k int"
ODD = [(1, None, "s", 1), (2, "", None, 2), (3, "one", "s", 3), (None, "no id here at all", "s", 4), (4, "x" * 30_000, "s", 5), (5, "a b c d e f g h", "s", 6), (5, "a b c d e f g h", "s", 6), (6, " \n\t ", "s", 7)]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").limit(120).cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


# 10: n-gram Jaccard


def groups_by_force(texts: dict) -> dict:
    """doc_id -> (links, smallest doc_id of its component)."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()
    link = {i: [j for j in sets if j != i and sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])] for i in sets}
    out = {}
    for i in sorted(sets):
        if i not in out:
            todo, seen = [i], {i}
            while todo:
                for j in link[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            out |= {j: (len(link[j]), i) for j in seen}
    return out


def test_jaccard_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    passage = " ".join(rng.choices(words, k=60))
    for i in range(60):
        texts[i] = " ".join(rng.choices(words, k=rng.randint(5, 150))) + (" " + passage if i % 3 == 0 else "")
    base = rng.choices(words, k=120)
    for i in range(100, 200):  # one large group of near copies
        w = list(base)
        w[rng.randrange(len(w))] = f"new{i}"
        texts[i] = " ".join(w)
    texts |= {300: texts[5], 301: texts[5].upper(), 302: "", 303: None}
    found = ngram_jaccard.jaccard_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), small=16, block=24)
    assert {r["doc_id"]: (r["n_links"], r["component_id"]) for r in found.collect()} == groups_by_force(texts)


def test_jaccard_on_odd_tables(odd, none, spark):
    out = ngram_jaccard.jaccard_groups(odd)
    got = {r["doc_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out.collect()}
    assert out.count() == len(ODD) and got[5] == (1, 5, True) and got[1] == (0, 1, True) and got[6] == (0, 6, True)
    assert ngram_jaccard.jaccard_groups(none).count() == 0
    assert sorted(rows(ngram_jaccard.drop_near_duplicates(odd).filter("doc_id = 5"), "doc_id")) == [(5,)]
    assert ngram_jaccard.drop_near_duplicates(odd).columns == odd.columns


def test_jaccard_verifies_rows_without_doc_id(spark):
    words = [f"w{i}" for i in range(80)]
    near = " ".join(["other", *words[1:]])
    t = spark.createDataFrame([(1, " ".join(words)), (None, near), (None, " ".join([*words[:-1], "last"])), (2, "nothing alike in here at all")], "doc_id long, text string")
    got = sorted(rows(ngram_jaccard.jaccard_groups(t), "doc_id", "n_links", "component_id"), key=str)
    assert got == sorted([(1, 2, 1), (None, 2, 1), (None, 2, 1), (2, 0, 2)], key=str)


def test_near_duplicates_are_dropped_by_row(spark):
    words = [f"w{i}" for i in range(80)]
    text, near, other = " ".join(words), " ".join([*words[:-1], "last"]), "nothing alike in here at all"
    data = [(3, text, "x"), (4, near, "x"), (None, near, "x"), (4, other, "x"), (None, text, "y"), (None, text, "y"), (5, other + " but more of it", "x"), (3, text, "x")]
    t = spark.createDataFrame(data, "doc_id long, text string, row string").withColumn("_row", F.lit(1))
    links = sorted(rows(ngram_jaccard.jaccard_groups(t), "doc_id", "n_links"), key=str)
    assert links == sorted([(3, 5), (4, 5), (None, 5), (4, 0), (None, 5), (None, 5), (5, 0), (3, 5)], key=str)
    left = ngram_jaccard.drop_near_duplicates(t)
    assert left.columns == t.columns
    assert sorted(rows(left, "doc_id", "text", "row"), key=str) == sorted([(3, text, "x"), (None, near, "x"), (4, other, "x"), (None, text, "y"), (None, text, "y"), (5, other + " but more of it", "x")], key=str)


def test_near_copies_leave_at_their_first_bucket(spark):
    """A large group of near copies, links across its border, and a passage that many share: no link is lost, and rows don't multiply."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(900)]
    base, texts = rng.choices(vocabulary, k=140), {}
    for i in range(150):
        w = list(base)
        w[rng.randrange(20)] = f"new{i}"
        texts[i] = " ".join(w)
    edge = list(base)
    for j in (30, 50, 70):  # near some of the group, not all
        edge[j] = "edge"
    texts[200] = " ".join(edge)
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts |= {i: f"{passage} {' '.join(rng.choices(vocabulary, k=90))}" for i in range(300, 400)}
    found = ngram_jaccard.jaccard_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), small=12, block=40)
    assert {r["doc_id"]: (r["n_links"], r["component_id"]) for r in found.collect()} == groups_by_force(texts)


# 1 and 7: vectors


def vector_table(spark, n=300, d=16):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, d))
    x[50:90] = x[50] + rng.normal(scale=0.02, size=(40, d))
    x[90:100] = x[3]
    data = [(i, [float(np.float32(v)) for v in x[i]], int(i % 3) if i < 50 else 1) for i in range(n)]
    data += [(1000, None, 1), (1001, [0.0] * d, 1), (1002, [float("nan")] * d, 1), (1003, [None] * d, 1), (1004, data[60][1], None), (1005, [1.0, 2.0], 1), (None, data[0][1], 2)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("times", F.lit("clash")), {i: (np.array(v), y) for i, v, y in data[:n]}


@pytest.mark.parametrize(("cell_rows", "most_pivots"), [(1024, 4096), (16, 4096), (4, 8)])
def test_vector_links_equal_brute_force(spark, cell_rows, most_pivots):
    table, data = vector_table(spark)
    out = embedding_join.near_duplicate_vectors(table, cell_rows=cell_rows, most_pivots=most_pivots)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out.collect() if r["vec_id"] is not None}
    link = {i: [j for j, (v, z) in data.items() if j != i and y == z and u @ v / math.sqrt((u @ u) * (v @ v)) >= 0.98] for i, (u, y) in data.items()}
    assert out.count() == len(data) + 7
    for i in data:
        assert got[i][0] == len(link[i])
        assert not link[i] or got[i][1] <= min(i, *link[i])
        assert link[i] or got[i][1:] == (i, True)
    assert all(got[i] == (0, i, True) for i in (1000, 1001, 1002, 1003, 1004, 1005))
    assert embedding_join.near_duplicate_vectors(table.limit(0)).count() == 0


def test_search_is_exact_on_small_tables(spark):
    table, data = vector_table(spark)
    found: dict = {}
    for r in vector_search.nearest_neighbours(table, table.filter("vec_id % 50 = 0"), k=10, recall=1.0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {0, 50, 100, 150, 200, 250}
    own = {**{i: v for i, (v, _) in data.items()}, 1004: data[60][0]}
    for q, got in found.items():
        known = sorted((float(np.sqrt(((own[q] - v) ** 2).sum())), i) for i, v in own.items() if i != q)[:10]
        assert [i for _, i, _ in sorted(got)] == [i for _, i in known]
        assert [s for *_, s in sorted(got)] == pytest.approx([s for s, _ in known], abs=1e-12)
    assert vector_search.nearest_neighbours(table.limit(0), table).count() == 0
    assert vector_search.nearest_neighbours(table, table.limit(0)).count() == 0


def test_search_recall(spark, sf):
    table = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(np.random.default_rng(2).normal(size=(3000, 16)))], "vec_id long, embedding array<float>")
    got = rows(vector_search.nearest_neighbours(table, table.filter("vec_id % 100 = 0")), "query_id", "vec_id")
    x = np.array([r[0] for r in table.orderBy("vec_id").select("embedding").collect()])
    hits = 0
    for q in range(0, 3000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & {v for a, v in got if a == q})
    assert len(got) == 300 and hits / 300 >= 0.9


def test_traversal_is_in_order():
    rng = np.random.default_rng(0)
    a, b, n = rng.random(7), rng.random(9), rng.integers(0, 4, 63)
    cells = vector_search.traverse(a, b, n, 10**9)
    cost = [a[c // 9] + b[c % 9] for c in cells]
    assert cost == sorted(cost) and set(cells) == set(np.nonzero(n)[0].tolist())


# 3 and 5: tokens


TEXTS = ["", "a", " ", "  a", "a  ", "\n\n x", "a" * 500, "日本語テスト", "🙂🙂 x", "▁▁x", "<s> hi </s>", "<0x41>", " " * 40 + "x", "a\tb\r\n", "naïve café", "\x00\x01", "ab" * 3000, "0" * 700, "the quick brown fox. " * 20]


def test_pieces_equal_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    library, model = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_bpe.PieceModel(PIECES)
    rng = random.Random(1)
    cases = TEXTS + ["".join(rng.choice("abcdeè∂ thon") for _ in range(rng.randrange(400))) for _ in range(60)]
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ABCDabcd0123+/", "eth", "aA", "日本語a", "thequickbrown.-_"):  # long words, of all kinds
        cases += ["".join(rng.choices(letters, k=n)) for n in (33, 34, 700, 6000)]
    cases += [f"{left}{' ' * n}{right}" for n in [*range(60), 1000] for left, right in (("", ""), ("a", "the x"), ("\n", "∂"), ("", "\n"))]
    cases += ["international" * 900, "".join(rng.choice(["ing", "tion", "er", "an", "the"]) for _ in range(4000)), " ".join("".join(rng.choices("etaoinshr", k=60)) for _ in range(100))]
    for text, data in zip(cases, model.encode(cases), strict=True):
        ids = np.frombuffer(data, "<u4").tolist()
        assert ids == library.encode(text), text
        assert model.decode(np.array([1, *ids, 2])).decode() == library.decode([1, *ids, 2])
    for _ in range(200):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259)]) for _ in range(rng.randrange(12))]
        assert model.decode(np.array(ids, np.int64)).decode() == library.decode(ids)


def test_piece_queries(spark, odd, none):
    out = sentencepiece_bpe.round_trip_digests(odd, PIECES)
    assert out.count() == len(ODD) and sentencepiece_bpe.round_trip_digests(none, PIECES).count() == 0
    assert [n > 2 for (n,) in rows(out.filter("doc_id is null"), "n_tokens")] == [True]
    empty = out.filter("doc_id = 1").first()
    assert empty["n_tokens"] == 2 and empty["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    back = sentencepiece_bpe.decode_documents(sentencepiece_bpe.encode_documents(odd, PIECES), PIECES)
    assert sorted(rows(back, "text")) == sorted((t or "",) for _, t, *_ in ODD)


def test_bytes_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(BYTES)
    own, rng = packing.ByteEncoder(BYTES, added=True), random.Random(2)
    parts = [" ", "\n", "a", "the", "  ", "\t", ".", "é", "1", "'s", "日", " x", "\r", "\x1c", "　", "\xa0", "<|endoftext|>", "!!"]
    for text in TEXTS + ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(1500)]:
        assert np.frombuffer(own(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def check_packing(out, texts):
    own = packing.ByteEncoder(BYTES)
    by_doc, by_sequence = {}, {}
    for r in out.collect():
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, text in texts.items():
        ids, at = np.r_[np.frombuffer(own(text or ""), "<u4"), 0].astype("<u4"), 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0


def test_packing(docs, odd, none):
    check_packing(packing.pack_documents(docs.repartition(7), BYTES, windows=3, parts_per_group=2), {r["doc_id"]: r["text"] for r in docs.collect()})
    unique = odd.dropDuplicates(["doc_id"]).filter("doc_id is not null")
    check_packing(packing.pack_documents(unique, BYTES), {r["doc_id"]: r["text"] for r in unique.collect()})
    assert packing.pack_documents(odd, BYTES).filter("doc_id is null").count() > 0
    assert packing.pack_documents(none, BYTES).count() == 0


def test_added_tokens_are_ids_of_their_own(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library, rng = tokenizers.Tokenizer.from_file(BYTES), random.Random(3)
    parts = [" ", "\n", "a", "the", "  ", ".", "é", "'s", "日", " x", "<|endoftext|>", "<|endof", "|>", "<"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", " x<|endoftext|>  y z"] + ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(300)]
    known = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    out = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTES).collect()
    assert {r["doc_id"] for r in out} == set(known)
    for r in out:
        ids = known[r["doc_id"]]
        assert r["doc_tokens"] == len(ids), texts[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()), texts[r["doc_id"]]


# 4: personal data


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def base_spans(text: str) -> str:
    found = [(m.start(), n, k, m.end()) for n, (k, (p, ok)) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if ok(m.group())]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def test_personal_data_equals_plain_patterns(spark):
    rng = random.Random(7)
    parts = ["a@b.co", "x_y@z", "@", ".", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-4567", "+1", " ", "-", "7", "é", "🙂", "b.c_d@e.f", "  ", "\n", "call", "00000000001"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(500)] + [None, "", "1" * 5000, "a." * 4000 + "@x.y", "1 2" * 3000]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.span_digests(table).collect():
        known = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(known.encode()).hexdigest(), texts[r["doc_id"]]
        assert ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in BASE) == known
        assert r["n_email"] == known.count("email:")


def test_added_kinds_and_masks(spark):
    t = spark.createDataFrame([(1, "account GB82 WEST 1234 5698 7654 32 and GB83WEST12345698765432"), (2, "my ssn is 123-45-6789"), (3, "part 123-45-6789"), (4, "mail a@b.co or 1.2.3.4.")], "doc_id long, text string")
    got = dict(rows(pii.span_digests(t), "doc_id", "spans"))
    assert got == {1: "iban:8:35", 2: "ssn:10:21", 3: "", 4: "email:5:11,ip:15:22"}
    assert dict(rows(pii.redact(t), "doc_id", "text"))[4] == "mail [EMAIL] or [IP]."
    assert pii.redact(t).columns == t.columns


def test_personal_data_on_odd_tables(odd, none):
    assert pii.span_digests(odd).count() == len(ODD) and pii.span_digests(none).count() == 0
    assert sorted(rows(pii.redact(odd), "text"), key=str) == sorted(((t,) for _, t, *_ in ODD), key=str)
    text = pii.span_digests(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


# 6 and 8: classifiers


def labelled(spark, kind, n=400):
    rng = random.Random(3)
    syllables = "ba be bi do du fa ke lo mi nu pa ra so ti".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    data = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 80))]
        y = int(rng.random() < 0.3)
        if kind == "toxic" and y:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["zgrunt", "zgruntel", "vorkish", "vorkas"])
        if kind == "quality" and not y:
            words = [w + "$$$" for w in words]
        data.append((i, " ".join(words), y))
    return spark.createDataFrame(data, "doc_id long, text string, y int")


@pytest.mark.parametrize(("kind", "classify"), [("toxic", toxicity.classify_toxicity), ("quality", quality.classify_quality)])
def test_classifiers_on_held_out_rows(spark, kind, classify):
    t = labelled(spark, kind)
    out = classify(t.select("doc_id", "text"), t.select("doc_id", F.col("y").alias(kind))).join(t.select("doc_id", "y"), "doc_id").collect()
    parts, part = (5, 0) if kind == "toxic" else (3, 1)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == part) for r in out)
    test = [r for r in out if r["held_out"]]
    assert len(out) == 400 and sum(r["predicted"] == r["y"] for r in test) / len(test) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)


@pytest.mark.parametrize(("name", "classify", "drop"), [("toxic", toxicity.classify_toxicity, toxicity.drop_toxic), ("quality", quality.classify_quality, quality.drop_low_quality)])
def test_classifiers_on_odd_tables(spark, odd, none, name, classify, drop):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (5, 1), (6, 7)], f"doc_id long, {name} int")
    scored = classify(odd, labels).collect()
    by_id = {i: {r["score"] for r in scored if r["doc_id"] == i} for i in (None, 1, 2, 5)}
    assert len(scored) == len(ODD) and by_id[1] == by_id[2] and all(len(x) == 1 for x in by_id.values())  # null and empty texts, and repeated rows, score alike
    assert classify(odd, labels.limit(0)).filter("score is null").count() == 0
    assert classify(none, labels).count() == 0
    assert drop(odd, labels).columns == odd.columns


def test_labels_that_may_not_be_learnt_change_nothing(spark):
    t = labelled(spark, "toxic", 150)
    labels = t.select("doc_id", F.col("y").alias("toxic"))
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id"), 5, 0), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(rows(toxicity.classify_toxicity(t.select("doc_id", "text"), x), "doc_id", "score")) for x in (labels, flipped))
    assert a == b


def plain_kneser_ney(words, words_of_all, fixed):
    """word -> log-likelihood under a model of words {word: count} that backs off to one of words_of_all, with dictionaries."""

    def counts(of):
        out = {m: {} for m in range(1, 6)}
        for w, n in of.items():
            marked = [0] * 4 + [1, *map(ord, w), 2]
            for i in range(5, len(marked)):
                g = tuple(marked[i - 4 : i + 1])
                out[5][g] = out[5].get(g, 0) + n
        for m in range(4, 0, -1):
            for g in out[m + 1]:
                out[m][g[1:]] = out[m].get(g[1:], 0) + 1
        return out

    def taken(table, n):
        if fixed[0] is not None:
            return min(n, fixed[0])
        of = [sum(v == i for v in table.values()) for i in range(1, 5)]
        y = of[0] / max(1, of[0] + 2 * of[1])
        k = min(n, 3)
        return min(n, max(0.0, min(k, k - (k + 1) * y * of[k] / max(1, of[k - 1]))))

    def p(tables, g, m, below):
        table = tables[m]
        inside = {x: n for x, n in table.items() if x[:-1] == g[-m:-1]}
        total = sum(inside.values())
        if not total:
            return below
        off = {x: taken(table, n) for x, n in inside.items()}
        return (inside.get(g[-m:], 0) - off.get(g[-m:], 0)) / total + max(sum(off.values()), 1e-4) / total * below

    own, every = counts(words), counts(words_of_all)

    def score(w):
        marked, out = [0] * 4 + [1, *map(ord, w), 2], 0.0
        for i in range(5, len(marked)):
            g, q = tuple(marked[i - 4 : i + 1]), 1 / 200
            keep, fixed[0] = fixed[0], None
            for m in range(1, 4):
                q = p(every, g, m, q)
            fixed[0] = keep
            for m in range(3, 6):
                q = p(own, g, m, q)
            out += math.log(q)
        return out

    return score


def longest_grams(spark, data):
    """The longest n-grams of rows (word, n0, n1, n2), in three parts."""
    parts = [b for i in range(3) for b in toxicity.longest_grams([d[0] for d in data[i::3]], np.array([d[1:] for d in data[i::3]], np.int64).reshape(-1, 3))]
    return spark.createDataFrame(pa.Table.from_batches(parts))


@pytest.mark.parametrize("fixed", [None, 2.0])
def test_kneser_ney_equals_a_plain_model(spark, fixed):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices(["ba", "be", "zo", "ra", "xi", "é"], k=rng.randint(1, 4)))
    data = [(w, *rng.choice([(0, 0), (3, 0), (0, 2), (1, 4), (1, 1)]), rng.randint(1, 9)) for w in sorted({word() for _ in range(150)})]
    grams = toxicity.gram_counts(longest_grams(spark, data))
    model = toxicity.Model(toxicity.shares_of(toxicity.gather(grams), fixed))
    words = [*(d[0] for d in data[:20]), "unseen", "baba", "zoé", "🙂", "x" * 300]
    got = model.log_likelihoods(words)
    ordinary, toxic = (plain_kneser_ney({d[0]: d[1 + c] for d in data if d[1 + c]}, {d[0]: d[3] for d in data}, [fixed]) for c in (0, 1))
    assert got[:20] == pytest.approx(np.array([(ordinary(w), toxic(w)) for w in words[:20]]), rel=1e-5)
    assert model.gain(words) == pytest.approx([toxic(w) - ordinary(w) for w in words], rel=1e-4, abs=1e-4)


def test_counts_grow_with_all_texts(spark):
    """What the model gathers covers words that no learner has, none left out or merged."""
    few = [("alpha", 1, 0, 1), ("beta", 0, 1, 1)]
    more = few + [(f"w{i:05d}", 0, 0, 1) for i in range(3000)]
    for data in (few, more):
        plain = {(" " * 4 + "^" + w + "$")[i - 4 : i + 1] for w, *_ in data for i in range(5, len(w) + 6)}
        assert toxicity.gram_counts(longest_grams(spark, data))[0].count() == len(plain)


def test_non_negative_risk():
    rng = np.random.default_rng(0)
    pos, neg = np.c_[np.ones(300), rng.normal(2, 1, 300)], np.c_[np.ones(300), rng.normal(-2, 1, 300)]
    mixed = np.r_[pos[:150], neg[:150]]
    w = quality.non_negative_fit(mixed.T @ mixed, pos.T @ pos, 0.5)
    assert (pos @ w > 0).mean() > 0.9 and (neg @ w < 0).mean() > 0.9


def test_moments_equal_plain_sums_and_give_the_prior(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["one", "Two", "three.", "4", "##"] if i % 10 >= 3 else ["$$$", "&&&", "x"], k=rng.randint(5, 40))) for i in range(600)]
    trusted = [i for i in range(600) if i % 10 >= 3 and i % 4 == 0]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    total = quality.all_moments(t, spark.sparkContext.broadcast(frozenset(trusted)), fan_in=2)
    x = quality.features(texts)
    assert np.allclose(total[0], x.T @ x) and np.allclose(total[1], x[trusted].T @ x[trusted])
    assert 0.69 < quality.estimate_prior(*total) < 0.8


def risk(x_u, x_p, prior, w, ridge=0.0):
    """The non-negative risk over rows, plainly."""
    loss = lambda z: ((1 - z) ** 2).mean() / 4
    rest = loss(-(x_u @ w)) - prior * loss(-(x_p @ w))
    return prior * loss(x_p @ w) + max(0.0, rest)


def test_fit_from_moments_minimises_the_risk_over_rows():
    rng = np.random.default_rng(1)
    pos, neg = np.c_[np.ones(400), rng.normal([1, 0.5], 1, (400, 2))], np.c_[np.ones(400), rng.normal([-1, 0], 1, (400, 2))]
    mixed = np.r_[pos[:200], neg[:200]]
    w = quality.non_negative_fit(mixed.T @ mixed, pos.T @ pos, 0.5, ridge=1e-6)
    at = risk(mixed, pos, 0.5, w)
    assert all(risk(mixed, pos, 0.5, w + d) >= at - 1e-6 for d in rng.normal(scale=0.05, size=(200, 3)))


# 9: pages


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(60)
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_text.main_text(pages).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", source[r["page_id"]], re.S).group(1)
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner))
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_page_rules(spark):
    story = "A long enough sentence of the story, with commas, and more words to count. " * 3
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><a href=x>Menu</a></nav><div class="sidebar-2"><p>Side text {story}</p></div>
    <div class="post-12"><h1>Head &amp; tail</h1><p>One<b>two</b>  three <p>{story}<ul><li>item<li>other</ul><div class="ad">buy</div><form><p>name</p></form><script>var a = "<p>no</p>";</script><!-- <p>hidden</p> --></div>
    <div id="comments"><p>Reader says {story}</p></div><footer>&copy; x</footer></body></html>"""
    short = page.replace("post-12", "post-7").replace(story, "Brief. ")
    table = spark.createDataFrame([(1, "http://h.example/a", page), (2, "https://www.h.example:8080/b", short), (3, None, None), (4, "http://x/", ""), (5, "http://x/", "plain < text &lt;b&gt;"), (6, "http://x/", "<p>cut <b")], "page_id long, url string, html string").withColumn("path", F.lit("clash"))
    got = dict(rows(html_text.main_text(table), "page_id", "text"))
    clean = " ".join(story.split())
    assert got[1] == f"Head & tail\nOnetwo three\n{clean}\nitem\nother"
    assert got[2].startswith("Head & tail\nOnetwo three\nBrief.")
    assert got[3] == got[4] == "" and got[5] == "plain < text <b>" and got[6] == "cut"
    assert dict(rows(html_text.main_text(table, most_broadcast=0), "page_id", "text")) == got
    assert html_text.main_text(table.limit(0)).count() == 0


STORY = "A long enough sentence of the story, with commas, and more words to count. "
NESTED = {
    "lead and sections": ("<article><h1>Head</h1><p>Lead.</p><section><p>{a}</p></section><section><p>{b}</p></section></article><div class=low>{note}</div>", "Head|Lead.|{a}|{b}"),
    "sections of other classes": ("<article><section class=intro><p>{a}</p></section><section class=rest><p>{b}{b}</p></section></article>", "{a}|{b} {b}"),
    "lead and body": ("<div class=post><h1>Head</h1><p>Lead.</p><div class=body><p>{a}</p><p>{b}</p></div></div><div class=low><a href=x>{a}</a></div>", "Head|Lead.|{a}|{b}"),
    "title beside the body": ("<div class=post><div class=top><h1>Head</h1></div><div class=body><p>{a}</p></div><ul><li><a href=x>More of it</a></ul></div>", "Head|{a}|More of it"),
    "table": ("<article><h1>Head</h1><p>Before.</p><table><tr><td>{a}</td><td>{b}</td></tr></table><p>After.</p></article>", "Head|Before.|{a}|{b}|After."),
    "table in the body": ("<h1>Head</h1><p>{note}</p><table><tr><td>{a}</td><td>{b}</td></tr></table>", "Head|{note}|{a}|{b}"),
    "main around": ("<main><h1>Head</h1><article><p>{a}</p></article></main><div class=low>{note}</div>", "Head|{a}"),
    "two articles": ("<div class=x><article class=one><p>{a}</p></article><article class=two><p>{b}{b}</p></article></div><div class=low>{note}</div>", "{a}|{b} {b}"),
    "class names that only mention a part": ("<div class='layout no-sidebar'><article><h1>Head</h1><h2 class=header>Part</h2><p>{a}</p><p>x <math><mi>n</mi></math> y</p></article></div><div class=tiny>tiny</div>", "Head|Part|{a}|x n y"),
    "article within layout by class": ("<div class=sidebar><p>{note}</p><main><h1>Head</h1><p>{a}</p></main></div>", "Head|{a}"),
    "comments as articles": ("<article><h1>Head</h1><p>{a}</p></article><div id=comments><article><p>{b}{b}</p></article></div>", "Head|{a}"),
    "links beside": ("<div class=post><p>Lead.</p><div class=body><p>{a}</p></div><div class=list><a href=x>{note}</a></div></div>", "Lead.|{a}"),
}


@pytest.mark.parametrize("name", NESTED)
def test_articles_in_nested_containers_are_whole(spark, name):
    parts = {"a": STORY * 6, "b": (STORY * 8).upper(), "note": "A line of forty characters and some more at the foot."}
    page, known = NESTED[name]
    clean = {k: " ".join(v.split()) for k, v in parts.items()}
    table = spark.createDataFrame([(i, "http://h.example/", f"<html><body>{page.format(**parts)}</body></html>") for i in range(2)], "page_id long, url string, html string")
    expected = "\n".join(x.format(**clean) for x in known.split("|"))
    assert rows(html_text.main_text(table), "text") == [(expected,)] * 2


def test_votes_decide_and_odd_pages(spark):
    """The container that most pages of a host vote for wins, also on a page where another one holds more; counted plainly."""
    page = lambda a, b: f"<html><body><article class=story><p>{a}</p></article><div class=box><p>{b}</p></div></body></html>"
    note = "An unlinked line of text in a box, of some length. "
    data = [(i, "http://h.example/", page(STORY * 6, note)) for i in range(5)] + [(7, "http://h.example/x", page(STORY * 4, note * 12)), (7, "http://h.example/x", page(STORY * 4, note * 12)), (None, None, None)]
    t = spark.createDataFrame(data, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "salt", "path", "votes")})
    votes: dict = {}
    for _, _, h in data[:-1]:
        scores = html_text.container_scores(*html_text.parse(h))
        best = html_text.best_path(scores)
        votes[best] = votes.get(best, 0) + scores[best] / sum(v for v in scores.values() if v > 0)
    assert max(votes, key=votes.get) == "body/article.story"
    for most in (100_000, 0):
        got = rows(html_text.main_text(t, most_broadcast=most), "page_id", "text")
        assert len(got) == 8 and (None, "") in got
        assert sorted(x for p, x in got if p == 7) == [" ".join((STORY * 4).split())] * 2
    assert note.strip() in html_text.extract(data[5][2], html_text.best_path(html_text.container_scores(*html_text.parse(data[5][2]))))


# 2: licences


def test_licences(spark, odd, none):
    t = spark.createDataFrame([(1, "Intro line\nreleased under the  MIT license\nmore"), (2, licenses.TEMPLATES[2][1].lower()), (3, "nothing here of the kind"), (4, "Released under the BSD license."), (5, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["n_units"]) for r in licenses.scan_licenses(t).collect()}
    assert got[1] == ("MIT", 1) and got[2] == ("MIT", 1) and got[3] == (None, 0) and got[5] == (None, 0)
    assert licenses.scan_licenses(odd).count() == len(ODD) and licenses.scan_licenses(none).count() == 0
    assert rows(licenses.scan_licenses(odd).filter("doc_id is null"), "license", "n_units") == [(None, 0)]


def test_size_bounds_lose_nothing():
    for n in range(1, 60):
        lo, hi = licenses.size_bounds(n, 0.8)
        for m in range(1, 120):
            assert (lo <= m <= hi) or 2 * min(m, n) / (m + n) < 0.8


def wrapped(text: str, mark: str = "# ", n: int = 9) -> str:
    w = text.split()
    return "\n".join(mark + " ".join(w[i : i + n]) for i in range(0, len(w), n))


def test_licences_within_documents(spark):
    rng = random.Random(8)
    prose = wrapped(" ".join(rng.choice("the of code file and runs on data that is under a new version".split()) for _ in range(400)), "")
    text = dict(reversed(licenses.TEMPLATES)) | {f"{n} long": t for n, t in licenses.TEMPLATES if len(t) > 300}
    cases = {
        f"{wrapped(text['Apache-2.0 long'])}\n\n{prose}": ("Apache-2.0", 2),  # its first line matches the notice
        f"{wrapped(text['GPL-3.0 long'], ' * ')}\n{prose}": ("GPL-3.0", 1),
        f"{prose}\n{wrapped(text['MIT long'], '')}": ("MIT", 1),
        f"{prose}\n(c) 2020 Foo. All rights reserved.\n{prose}": ("Proprietary", 1),
        f"{prose} This module is released under the MIT License, see below. {prose}": ("MIT", 1),
        f"{prose}\nSee also: this work is licensed under the GNU General\nPublic License, version 2.\n{prose}": ("GPL-2.0", 1),
        f"{prose}\nThis work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.": ("CC-BY-NC-4.0", 1),
        prose: (None, 0),
    }
    got = {r["doc_id"]: (r["license"], r["n_units"]) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(cases.values()))


def test_full_licence_texts(spark):
    texts = licenses.full_texts()
    head, tail = "Some project\n\nCopyright (c) 2020 Foo. All rights reserved.\n\n", "\nmore words after it\n"
    data = [(i, f"{head * e}{t}{tail * e}") for i, (_, t) in enumerate(texts) for e in (0, 1)]
    got = {}
    for r in licenses.scan_licenses(spark.createDataFrame(data, "doc_id long, text string")).collect():
        got.setdefault(texts[r["doc_id"]][0], []).append(r["license"])
    assert len(got) >= 11 and got == {n: [n, n] for n in got}


def test_best_runs_equal_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        b = licenses.bigrams([rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))])
        words = [rng.choice("abcdefgh") for _ in range(25)]
        grams = [f"{x} {y}" for x, y in zip(words, words[1:], strict=False)]
        known = max((2 * len(g & b) / (len(g) + len(b)) for i in range(24) for j in range(i, 24) for g in [set(grams[i : j + 1])]), default=0)
        found = licenses.runs_of(grams, b, 0.8)
        assert max((d for _, d, *_ in found), default=0) == (known if known >= 0.8 else 0)


@pytest.mark.parametrize("name", ["op2_license_scan", "op4_pii"])
def test_sql(spark, sf, name):
    from quarryline.llm import queries

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    out = c.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, sf)
    names = sorted(df.columns)
    at = [out.columns.index(n) for n in names]
    assert sorted((tuple(r[i] for i in at) for r in out.fetchall()), key=repr) == sorted(rows(df, *names), key=repr)


# The pipeline


def test_stages_on_odd_tables(spark, odd, none, sf):
    """Nulls, empty and repeated rows, and columns with names that the stages use themselves pass through all stages."""
    import corpus_pipeline

    for docs in (odd, none, odd.select("text", "doc_id"), odd.withColumn("task", F.lit("x")).withColumn("_row", F.col("k")).withColumn("n_chars", F.lit(1))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
            out.collect()
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_run_computes_each_stage_once(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    t = labelled(spark, "quality", 120)
    t.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    t.select("doc_id", F.col("y").alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}

    def counted(name, stage):
        seen[name] = passed = spark.sparkContext.accumulator(0)

        def rows_of(batches):
            for b in batches:
                passed.add(b.num_rows)
                yield b

        def run(*args):
            out = stage(*args)
            return out.mapInArrow(rows_of, out.schema)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(*s) for s in corpus_pipeline.STAGES])
    docs = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count()
    counts = [a.value for a in seen.values()]
    assert counts[0] == 120 and 120 >= counts[1] == counts[2] == counts[3] == docs


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
            after = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert set(after) <= set(before)
            if name == "near_duplicates":
                known = groups_by_force(before)
                assert set(after) == {i for i, (_, least) in known.items() if i == least}
            elif name == "personal_data":
                assert set(after) == set(before)
                for i, t in after.items():
                    assert (t == before[i]) == (not base_spans(before[i])) or "[" in t
            else:
                gone = set(before) - set(after)
                clean = [i for i in before if i in labels and (labels[i]["toxic"] == 0 if name == "toxicity" else labels[i]["quality"] == 1)]
                assert sum(i in gone for i in clean) <= 0.1 * len(clean)
            before = after
    check_packing(docs, before)
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing" and corpus_pipeline.ORACLE_SQL is None
