"""Columns over catalog and label text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarryline.functions.quantities import clean, let, physical_specs


def surface_stats(text: Column, prefix: str) -> dict[str, Column]:
    """Lengths, shares of digits and capitals, and delimiters of a text; null counts as empty."""
    s = F.coalesce(text.cast("string"), F.lit(""))
    n = F.length(s)
    words = F.size(F.filter(F.split(s, r"(?U)\s+"), lambda w: w != ""))
    share = lambda p: (F.regexp_count(s, F.lit(p)) / F.greatest(n, F.lit(1))).cast("float")
    return {
        f"{prefix}_char_len": n.cast("int"),
        f"{prefix}_word_count": words.cast("int"),
        f"{prefix}_digit_ratio": share(r"(?U)\d"),
        f"{prefix}_upper_ratio": share("[A-Z]"),
        f"{prefix}_delimiters_count": F.regexp_count(s, F.lit(r"[|/+\-*]")).cast("int"),
        f"{prefix}_is_empty": (n == 0).cast("byte"),
    }


def catalog_text(title: Column, brand: Column | None = None, category: Column | None = None, description: Column | None = None, most_description: int = 256) -> Column:
    """"Title: ... | Brand: ... | Category: ... | Description: ..." of the fields that aren't blank."""
    parts = []
    for name, column in (("Title", title), ("Brand", brand), ("Category", category), ("Description", description)):
        if column is not None:
            value = clean(column)
            shown = F.substring(value, 1, most_description) if name == "Description" else value
            parts.append(F.when(value != "", F.concat(F.lit(f"{name}: "), shown)))
    joined = F.concat_ws(" | ", *parts)
    return F.when(joined == "", "Unknown Product").otherwise(joined)


def combined_text(df: DataFrame, columns: list[str]) -> Column:
    """Fields one after another, each behind its marker " __FIELD_<NAME>__ "."""
    return F.trim(F.concat(*(x for c in columns for x in (F.lit(f" __FIELD_{c.upper()}__ "), F.coalesce(F.col(c).cast("string"), F.lit(""))))))


@F.pandas_udf(StringType())
def compatibility_form(text: pd.Series) -> pd.Series:
    """NFKC, for which Spark has no function."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


#: Patterns of label text. (?U) makes \b, \d and \w Unicode-aware.
SPLIT_UNIT = r"(?iU)\b(m|k|c)\s+(l|g)\b"
SPACED_NUMBER = r"(?U)(\d)\s*([.,])\s*(\d)"
LETTER_O_NUMBER = r"(?iU)\b([0-9Oo]+(?:[.,][0-9Oo]+)?)\s*(kg|g|gm|mg|ml|cl|l|oz|lb)\b"
PROMOTION = (
    r"(?iU)\b(?:100\s*%\s*satisfaction|best\s*seller|money\s*back|free\s*shipping|limited\s*(?:time\s*)?offer|"
    r"special\s*offer|premium\s+quality|buy\s+now|save\s*\d+\s*%|\d+\s*%\s*off)\b"
)
BUY_GET = r"(?iU)\bbuy\s+(\d+)\s*(?:&|and)?\s*get\s+(\d+)\s+free\b"
NUTRITION = (
    r"(?iU)\b(?:nutrition|nutritional|serving(?:s|\s+size)?|calories?|energy|protein|carbohydrate|sugars?|sodium|cholesterol|"
    r"daily\s+value|ingredients?|per\s+100\s*[gm]l?)\b"
)
NET_CONTEXT = r"(?iU)\b(?:net\s*(?:wt|weight|vol(?:ume)?)|net\s+contents?|contents?|quantity|qty)\b"
LABEL_UNIT = (
    r"(?iU)(?<![a-z])\d+(?:[.,]\d+)?\s*(?:kg|kgs|kilograms?|g|gm|gms|grams?|mg|lb|lbs|oz|ounces?|"
    r"l|ltr|lit(?:er|re)s?|ml|millilit(?:er|re)s?|cl)(?![a-z])"
)
TECHNICAL_UNIT = (
    r"(?iU)(?<![a-z])\d+(?:[.,]\d+)?\s*[- ]?\s*(?:mm|cm|m|met(?:er|re)s?|inch(?:es)?|in|ft|feet|\"|"
    r"kilowatts?|kw|watts?|w|kv|volts?|v|mah|ah|wh|mb|gb|tb)(?![a-z])"
)
LABEL_PACK = (
    r"(?iU)\b(?:pack|set|box|case|bundle|combo)\s*(?:of\s*)?\d+\b|\b\d+\s*(?:pack|packs|count|ct|pcs|pieces)\b|"
    r"\b\d+\s*[x×*]\s*\d+(?:[.,]\d+)?\s*(?:kg|g|gm|mg|l|ml|cl|oz|lb)\b"
)


def rewritten(text: Column, pattern: str, change) -> Column:
    """text with every match put through change, an expression over the match."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hit"))
    whole = F.array_join(F.transform(parts, lambda x: F.concat(x["gap"], F.coalesce(F.when(x["hit"].isNotNull(), change(x["hit"])), F.lit("")))), "")
    return F.when(text.rlike(pattern), whole).otherwise(text)


def tidy_label(text: Column) -> Column:
    """normal_label_text of text in compatibility form."""
    s = F.translate(text, "×✕•", "xx ")
    s = F.regexp_replace(F.regexp_replace(s, SPLIT_UNIT, "$1$2"), SPACED_NUMBER, "$1$2$3")

    def repaired(hit: Column) -> Column:
        return F.concat(F.translate(F.regexp_extract(hit, LETTER_O_NUMBER, 1), "Oo", "00"), F.lit(" "), F.regexp_extract(hit, LETTER_O_NUMBER, 2))

    s = let(s, lambda t: rewritten(t, LETTER_O_NUMBER, repaired))
    return F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r"^[ |;,_-]+|[ |;,_-]+$", "")


def normal_label_text(text: Column) -> Column:
    """Text read off a label in one spelling: NFKC, signs, "1 . 5" and "m l" closed up, O as 0 in a number before a unit, one
    blank between both, single blanks, no marks at the ends. Null counts as empty."""
    return tidy_label(compatibility_form(F.coalesce(text, F.lit(""))))


def packaging_text(lines: Column, *, compatible: bool = False) -> Column:
    """(text, rejected) of an array of label lines: those that state a quantity, joined by " | ", and the others.

    "buy x get y free" becomes "pack of x+y"; promotions go; lines alike but for case and signs count once; nutrition facts
    stay only beside net contents or packs. Empty lines count as none; a null array gives an empty text. Lines that are
    NFKC already (compatible) need no Python.
    """
    given = F.coalesce(lines, F.array().cast("array<string>"))
    raw = given if compatible else F.split(compatibility_form(F.array_join(F.transform(given, lambda x: F.coalesce(x, F.lit(""))), "\x01")), "\x01")
    number = lambda hit, i: F.regexp_extract(hit, BUY_GET, i).cast("long")
    offer = lambda t: rewritten(t, BUY_GET, lambda hit: F.concat(F.lit("pack of "), (number(hit, 1) + number(hit, 2)).cast("string")))
    tidy = F.filter(F.transform(raw, lambda t: tidy_label(F.coalesce(t, F.lit("")))), lambda t: t != "")
    pairs = F.transform(tidy, lambda t: let(offer(t), lambda line: F.struct(line.alias("line"), tidy_label(F.regexp_replace(line, PROMOTION, " ")).alias("kept"))))
    keyed = F.transform(pairs, lambda x: F.struct(x["line"].alias("line"), x["kept"].alias("kept"), F.lower(F.regexp_replace(x["kept"], r"(?U)\W+", "")).alias("key")))

    def judged(rows: Column) -> Column:
        keys = F.transform(rows, lambda x: x["key"])
        once = F.filter(rows, lambda x, i: (x["key"] == "") | (F.array_position(keys, x["key"]) == i + 1))

        def good(x: Column) -> Column:
            strong = x["kept"].rlike(NET_CONTEXT) | x["kept"].rlike(LABEL_PACK)
            return (x["key"] != "") & (strong | (~x["kept"].rlike(NUTRITION) & (x["kept"].rlike(LABEL_UNIT) | x["kept"].rlike(TECHNICAL_UNIT))))

        marked = F.transform(once, lambda x: F.struct(x["line"].alias("line"), x["kept"].alias("kept"), good(x).alias("good")))
        return let(marked, lambda m: F.struct(F.array_join(F.transform(F.filter(m, lambda x: x["good"]), lambda x: x["kept"]), " | ").alias("text"), F.transform(F.filter(m, lambda x: ~x["good"]), lambda x: x["line"]).alias("rejected")))

    return let(keyed, judged)


def packaging_lines(lines: Column) -> Column:
    """The text of packaging_text."""
    return packaging_text(lines)["text"]


#: What a label can state, and the parsed column that holds it.
LABEL_ENTITIES = {
    "weight_g": "total_weight_g", "volume_ml": "total_volume_ml", "pack_count": "pack_count", "dim_length_cm": "dim_length_cm", "dim_width_cm": "dim_width_cm",
    "dim_height_cm": "dim_height_cm", "power_watts": "power_watts", "voltage_volts": "voltage_volts", "battery_mah": "battery_mah", "storage_gb": "storage_gb",
}


def harvested(df: DataFrame, text: str, prefix: str = "ocr_") -> DataFrame:
    """df with the ten quantities that a text states, null where it doesn't; a pack counts only where one is stated."""
    own = [c for c in df.columns]
    specs = physical_specs(df.select(F.struct(*own).alias("_own"), F.col(text).alias("_text")), title="_text", pack="_none", description="_none")
    value = {n: F.when(F.col("is_multipack") == 1, F.col(c)) if n == "pack_count" else F.col(c) for n, c in LABEL_ENTITIES.items()}
    return specs.select("_own.*", *(v.cast("double").alias(f"{prefix}{n}") for n, v in value.items()))
