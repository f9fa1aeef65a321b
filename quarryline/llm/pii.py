"""Personal data: regular expressions propose spans, validators confirm them, context words adjust their score.

DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with one start are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

#: The spans that each kind proposes. Java syntax; possessive where nothing follows that could need less,
#: and bound to the start of a run of the first character's class, where the leftmost match begins in any case. Only
#: cards of 12 digits and more are proposed: shorter runs fail anyway.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}

#: What a text must hold for the kind to be looked for at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-"}

#: A validated span's score by itself, and the words nearby that raise it.
SCORES = {"email": 0.9, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|courriel|correo)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|carte|karte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|telefono)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social|security|taxpayer)\b",
}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if a string of capitals and digits passes the IBAN check."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int").isNull() | (F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int") <= 255)))
    if kind == "card":
        return F.when(F.length(_digits(m)).between(12, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        plain = F.regexp_replace(m, " ", "")
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)
    if kind == "ssn":
        return ~F.substring(m, 1, 3).isin("000", "666") & (F.substring(m, 1, 1) != "9") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")
    return F.lit(True)


_SPAN = "array<struct<start:int,kind:int,end:int,score:double>>"


def kind_spans(text: Column, kind: str, context_chars: int = 40) -> Column:
    """Validated spans of one kind: array of (start, kind number, end, score), in code points, end exclusive.

    The text between matches and the matches themselves, by split and regexp_extract_all, give positions in one pass.
    """
    pattern = PATTERNS[kind]
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hit"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        near = F.substring(text, F.greatest(F.lit(1), start - context_chars + 1), end - start + 2 * context_chars)
        score = F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT[kind]), 0.3).otherwise(0.0)
        span = F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), F.least(F.lit(1.0), score).alias("score")))
        kept = F.when(x["hit"].isNotNull() & _valid(kind, x["hit"]), F.concat(acc["out"], span)).otherwise(acc["out"])
        return F.struct(F.coalesce(end, start).alias("pos"), kept.alias("out"))

    none = F.array().cast(_SPAN)
    found = F.aggregate(pairs, F.struct(F.lit(0).alias("pos"), none.alias("out")), add, lambda acc: acc["out"])
    needs = NEEDS[kind]
    there = F.contains(text, F.lit(needs)) if needs else text.rlike("[0-9]{4}" if kind == "iban" else "[0-9]")
    return F.when(there, found).otherwise(none)


def personal_spans(docs: DataFrame, *, text: str = "text", least_score: float = 0.5, context_chars: int = 40) -> DataFrame:
    """docs with a column pii_spans: array of (start, kind, end, score) by start, then kind.

    Spans of the base kinds (email, ip, card, phone) are leftmost and non-overlapping per kind, and stay whatever their
    score; those of the added kinds (iban, ssn) stay if validated and scored at least_score, to which a context word
    within context_chars characters adds. A null or empty text has no spans. Rows depend on nothing but themselves.
    """
    source = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = F.concat(*(kind_spans(source, k, context_chars) for k in KINDS[:4]))
    more = F.filter(F.concat(*(kind_spans(source, k, context_chars) for k in KINDS[4:])), lambda s: s["score"] >= least_score)
    return docs.withColumn("pii_spans", F.array_sort(F.concat(base, more)))


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with every span of personal data in the text column replaced by its kind in brackets, as [EMAIL].

    Of spans that overlap, the first and then the longer one names the replacement, which covers all of them.
    """
    with_spans = personal_spans(docs, text=text)
    source = F.col(text)

    def add(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["pos"]
        tag = F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit("]"))
        out = F.when(fresh, F.concat(acc["out"], F.substring(source, acc["pos"] + 1, s["start"] - acc["pos"]), tag)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), out.alias("out"))

    done = F.aggregate("pii_spans", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), add, lambda acc: F.concat(acc["out"], F.substring(source, acc["pos"] + 1, F.length(source))))
    return with_spans.withColumn(text, F.when(F.size("pii_spans") > 0, done).otherwise(source)).select(*docs.columns)


def span_digests(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added (spans of added kinds). Scores
    are in the pii_spans of personal_spans. A null text counts as empty; null and repeated doc_ids keep their rows."""
    found = personal_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "pii_spans")

    def shown(spans: Column) -> Column:
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")

    count = lambda i: F.size(F.filter("pii_spans", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])),
        F.sha2(shown(F.filter("pii_spans", lambda s: s["kind"] < 4)), 256).alias("base_sha256"),
        shown(F.col("pii_spans")).alias("spans"),
        F.size(F.filter("pii_spans", lambda s: s["kind"] >= 4)).cast("long").alias("n_added"),
    )


#: The same result in DuckDB's SQL. Its expressions know no lookbehind, so the patterns are the plain ones.
ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS (
  SELECT doc_id, t, k.kind, k.n,
    string_split_regex(t, k.pattern) AS gaps, regexp_extract_all(t, k.pattern) AS hits
  FROM docs, (VALUES
    ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'),
    ('ip', 1, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
    ('card', 2, '[0-9](?:[ -]?[0-9])+'),
    ('phone', 3, '\+[0-9][ ().0-9-]+[0-9]'),
    ('iban', 4, '\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b'),
    ('ssn', 5, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b')) AS k(kind, n, pattern)
  WHERE regexp_matches(t, k.pattern)
),
placed AS (
  SELECT doc_id, t, kind, n, hits[i] AS hit,
    (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM raw)
),
told AS (
  SELECT doc_id, kind, n, s, s + length(hit) AS e, hit, regexp_replace(hit, '[^0-9]', '', 'g') AS digits,
    replace(hit, ' ', '') AS plain,
    substr(t, greatest(1, s - 39), length(hit) + 80) AS near
  FROM placed
),
valid AS (
  SELECT doc_id, kind, n, s, e FROM told WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN list_max(list_transform(string_split(hit, '.'), lambda p: try_cast(p AS HUGEINT))) <= 255
    WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, length(digits)), lambda i:
      CASE WHEN i % 2 = 0 THEN digits[length(digits) - i]::INT
      WHEN digits[length(digits) - i]::INT > 4 THEN digits[length(digits) - i]::INT * 2 - 9
      ELSE digits[length(digits) - i]::INT * 2 END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    WHEN 'iban' THEN length(plain) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(substr(plain, 5) || substr(plain, 1, 4), ''), lambda c: (CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)::BIGINT),
      lambda a, x: (CASE WHEN x < 10 THEN a * 10 + x ELSE a * 100 + x END) % 97) % 97 = 1
    ELSE NOT regexp_matches(hit, '^(000|666|9)|-00-|-0000$') AND regexp_matches(near, '(?i)\b(?:ssn|social|security|taxpayer)\b') END
),
by_doc AS (
  SELECT doc_id,
    count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
    count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, n, e) FILTER (n < 4), '') AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, n, e) AS spans, count(*) FILTER (n >= 4) AS n_added
  FROM valid GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card,
  coalesce(n_phone, 0)::BIGINT AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_added, 0)::BIGINT AS n_added
FROM docs d LEFT JOIN by_doc USING (doc_id)
"""
