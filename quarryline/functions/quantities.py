"""Physical quantities out of catalog text, as columns.

A quantity is parsed from every match at once (regexp_extract_all of number, unit and what follows), never row by row
in Python. Patterns are case-insensitive Java expressions with Unicode classes, as the texts aren't all English.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units and what they are worth.
GRAMS = {
    "mg": 0.001, "mgs": 0.001, "milligram": 0.001, "milligrams": 0.001,
    "g": 1.0, "gm": 1.0, "gms": 1.0, "gram": 1.0, "grams": 1.0,
    "kg": 1000.0, "kgs": 1000.0, "kilo": 1000.0, "kilos": 1000.0, "kilogram": 1000.0, "kilograms": 1000.0,
    "oz": 28.349523, "ounce": 28.349523, "ounces": 28.349523,
    "lb": 453.59237, "lbs": 453.59237, "pound": 453.59237, "pounds": 453.59237,
}
MILLILITRES = {
    "ml": 1.0, "mls": 1.0, "milliliter": 1.0, "milliliters": 1.0, "millilitre": 1.0, "millilitres": 1.0,
    "l": 1000.0, "lt": 1000.0, "ltr": 1000.0, "ltrs": 1000.0, "liter": 1000.0, "liters": 1000.0, "litre": 1000.0, "litres": 1000.0, "cl": 10.0, "cls": 10.0,
    "fl oz": 29.5735, "fl. oz": 29.5735, "fl.oz": 29.5735, "floz": 29.5735, "fluid ounce": 29.5735, "fluid ounces": 29.5735,
    "gal": 3785.41, "gals": 3785.41, "gallon": 3785.41, "gallons": 3785.41, "pint": 473.176, "pints": 473.176, "quart": 946.353, "quarts": 946.353,
}
CENTIMETRES = {"mm": 0.1, "cm": 1.0, "m": 100.0, "inch": 2.54, "inches": 2.54, '"': 2.54, "in": 2.54, "ft": 30.48, "feet": 30.48}
#: Units that make "3 x 100 ml" a multipack.
MULTIPACK_UNITS = (
    "ml", "mls", "milliliter", "milliliters", "millilitre", "millilitres", "l", "lt", "ltr", "ltrs", "liter", "liters", "litre", "litres", "g", "gm",
    "gms", "gram", "grams", "kg", "kgs", "kilo", "kilos", "kilogram", "kilograms", "oz", "ounce", "ounces", "floz", "lb", "lbs", "pound", "pounds",
    "pcs", "piece", "pieces", "pack", "packs", "bottle", "bottles", "can", "cans", "sachet", "sachets", "tab", "tabs", "tablet", "tablets", "cap",
    "caps", "capsule", "capsules", "bags", "wipes", "sheets",
)
#: Patterns. (?U) makes \b, \d and \w Unicode-aware.
_I = r"(?iU)"
NUMBER = r"(\d+(?:\.\d+)?)"
WEIGHT = rf"\b{NUMBER}\s*(kg|kgs|kilograms?|kilos?|gm?s?|grams?|mg|mgs|milligrams?|oz|ounces?|lbs?|pounds?|g)\b"
VOLUME = rf"\b{NUMBER}\s*(ml|mls|millilit(?:er|re)s?|ltr?s?|lit(?:er|re)s?|cl|fl\.?\s*oz|fluid\s*ounces?|gallons?|gals?|pints?|quarts?|l)\b"
FRACTION = r"\b(\d+)\s*/\s*(\d+)\s*([a-zA-Z]+|\"|inch(?:es)?)\b"
LENGTH = r"(cm|mm|m|inch(?:es)?|\"|in|ft|feet)(?!\w)"
DIM_3D = rf"\b{NUMBER}\s*(?:x|\*)\s*{NUMBER}\s*(?:x|\*)\s*{NUMBER}\s*{LENGTH}"
DIM_2D = rf"\b{NUMBER}\s*(?:x|\*)\s*{NUMBER}\s*{LENGTH}"
DIM_1D = rf"\b{NUMBER}\s*[- ]*(inch(?:es)?|\"|in|cm|mm|m|ft|feet)(?!\w)"
MULTIPACK = rf"\b{NUMBER}\s*(?:x|\*)\s*{NUMBER}\s*([a-zA-Z]+|\"|inch(?:es)?)\b"
PACK_OF = r"\b(?:pack\s+of|set\s+of|combo\s+of|box\s+of|case\s+of|bundle\s+of|pair\s+of)\s*(\d+)\b"
COUNTED = r"\b(\d+)\s*[- ]*(?:pack|pk|pcs|pieces|bottles|cans|count|ct|units)\b"
NESTED = (
    r"\b(\d+)\s*(?:boxes?|packs?|cases?|cartons?|bundles?)\s*(?:of|x)\s*(\d+)\s*"
    r"(?:pcs?|pieces?|units?|items?|pens?|bottles?|cans?|sachets?|bags?|bars?|tablets?|capsules?)?\b"
)
PAIR = r"\bpair\b(?!\s+of\b)"
POWER = rf"\b{NUMBER}\s*[- ]*(w|watts?|kw|kilowatts?)\b"
VOLTAGE = rf"\b{NUMBER}\s*[- ]*(v|volts?|kv)\b"
BATTERY = rf"\b{NUMBER}\s*[- ]*(mah|ah)\b"
STORAGE = rf"\b{NUMBER}\s*[- ]*(tb|gb|mb)\b"
PERCENTAGE = rf"\b{NUMBER}\s*%(?!\w)"
MODEL_CODE = r"(?U)\b(?:[A-Z0-9]{1,8}[-_/][A-Z0-9]{1,8}|[A-Z]{1,4}\d{2,6}[A-Z0-9]*|[A-Z0-9]{2,}\d{2,}[A-Z0-9]*)\b"
NO_CODES = (
    "PACK", "SET", "COMBO", "SIZE", "INCH", "INCHES", "GRAMS", "WATT", "VOLT", "PRICE", "INDIA", "TABLET", "TABLETS", "CAPSULES", "BOTTLE", "PIECE",
    "PIECES",
)
MOBILE_WORDS = (
    "network", "cellular", "lte", "sim", "band", "phone", "speed", "wireless", "mobile",
)
NO_INCH_AFTER = (
    "1", "one", "pouch", "pack", "box", "bag", "a", "the", "stock", "color",
)
NO_INCH_BEFORE = (
    "all", "built", "plugged", "made", "packed",
)
TOTAL_BEFORE = r"(?iU)(?:\btotal(?:\s+(?:net\s+)?(?:weight|wt|volume|vol))?|\bnet\s+(?:wt|weight|vol|volume)|\bgross\s+weight)\.?\s*[:=-]?\s*$"
EACH_AFTER = r"(?iU)^\s*(?:each\b|per\s+(?:item|unit|piece|pack|bottle|bar|can)\b|/\s*(?:ea|each|pc|item|unit|bar|bottle|can)\b)"
LARGEST_PACK = 200.0


def clean(text: Column) -> Column:
    """Trimmed text, empty for null."""
    return F.coalesce(F.regexp_replace(text.cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def _worth(unit: Column, table: dict[str, float]) -> Column:
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.try_element_at(known, F.lower(unit))


def _first(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, _I + pattern, group)


def _number(text: Column) -> Column:
    return text.try_cast("double")


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(_I + pattern), group)


def let(value: Column, body) -> Column:
    """body(value), where value is worked out once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _found(text: Column, pattern: str, body) -> Column:
    """body of the first match, null if there is none. The text is searched once; body takes groups out of the match."""
    return let(_first(text, pattern, 0), lambda hit: F.when(hit != "", body(hit)))


def _with_digits(text: Column, body) -> Column:
    """body of the cleaned text, null if that has no digit, as nothing could match then."""
    return let(clean(text), lambda t: F.when(t.rlike(r"(?U)\d"), body(t)))


def measures(text: Column, pattern: str, before: int = 60, after: int = 40) -> Column:
    """All matches as an array of (number, unit, head, tail): what stands before and after in so many characters.

    The text is searched for matches once. Only where there are some, the gaps between them come from split; positions
    follow from lengths, numbers and units from the matches themselves.
    """
    kind = "array<struct<number:double,unit:string,hit:string,head:string,tail:string>>"

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        head = F.substring(text, F.greatest(F.lit(1), start - before + 1), F.least(F.lit(before), start))
        number, unit = _number(_first(x["hit"], "^" + NUMBER, 1)), F.lower(F.regexp_replace(x["hit"], _I + "^" + NUMBER + r"\s*", ""))
        item = F.struct(number.alias("number"), unit.alias("unit"), x["hit"].alias("hit"), head.alias("head"), F.substring(text, end + 1, F.lit(after)).alias("tail"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["hit"].isNotNull(), F.concat(acc["out"], F.array(item))).otherwise(acc["out"]).alias("out"))

    def located(hits: Column) -> Column:
        zipped = F.arrays_zip(F.split(text, _I + pattern, -1).alias("gap"), hits.alias("hit"))
        return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), add, lambda acc: acc["out"])

    return let(_all(text, pattern, 0), lambda hits: F.when(F.size(hits) > 0, located(hits)).otherwise(F.array().cast(kind)))


def _fraction(text: Column, table: dict[str, float]) -> Column:
    def worth(hit: Column) -> Column:
        over, under = _number(_first(hit, FRACTION, 1)), _number(_first(hit, FRACTION, 2))
        return F.when(under != 0, over / under * _worth(_first(hit, FRACTION, 3), table))

    return _found(text, FRACTION, worth)


def _largest(found: Column, table: dict[str, float], least: float, most: float) -> Column:
    values = F.transform(found, lambda m: m["number"] * _worth(m["unit"], table))
    return F.array_max(F.filter(values, lambda v: v.between(least, most)))


def weight_grams(text: Column) -> Column:
    """Grams: a fraction first, else the largest match between 0.1 mg and 200 kg that isn't a mobile network's "5G"."""
    mobile = lambda m: (m["unit"] == "g") & (F.upper(F.trim(m["hit"])).rlike("^[2-6]G$") | F.lower(F.substring(m["tail"], 1, 25)).rlike("|".join(MOBILE_WORDS)))
    return _with_digits(text, lambda t: F.coalesce(_fraction(t, GRAMS), _largest(F.filter(measures(t, WEIGHT), lambda m: ~mobile(m)), GRAMS, 0.0001, 200_000.0)))


def volume_ml(text: Column) -> Column:
    """Millilitres: a fraction first, else the largest match between 0.01 ml and 50 l."""
    return _with_digits(text, lambda t: F.coalesce(_fraction(t, MILLILITRES), _largest(measures(t, VOLUME), MILLILITRES, 0.01, 50_000.0)))


def dimensions_cm(text: Column) -> Column:
    """(length, width, height, volume) in cm: the first of three, else of two (volume is the area), else of one dimensions."""
    names = ("length", "width", "height", "volume")
    none = F.lit(None).cast("double")
    out = lambda *x: F.struct(*(c.alias(n) for c, n in zip(x, names, strict=True)))

    def sizes(hit: Column, pattern: str, n: int) -> Column:
        unit = _worth(_first(hit, pattern, n + 1), CENTIMETRES)
        return let(unit, lambda u: F.array(*(_number(_first(hit, pattern, i)) * u for i in range(1, n + 1))))

    three = lambda hit: let(sizes(hit, DIM_3D, 3), lambda x: let(F.sort_array(x, asc=False), lambda y: out(y[0], y[1], y[2], x[0] * x[1] * x[2])))
    two = lambda hit: let(sizes(hit, DIM_2D, 2), lambda x: let(F.sort_array(x, asc=False), lambda y: out(y[0], y[1], none, x[0] * x[1])))

    def one(t: Column):
        def body(hit: Column) -> Column:
            tail = F.lower(F.ltrim(F.regexp_extract(t, _I + DIM_1D + r"(?=(.{0,15}))", 3)))
            head = F.lower(F.rtrim(F.substring(F.split(t, _I + DIM_1D, 2)[0], -10, 10)))
            word = (F.lower(_first(hit, DIM_1D, 2)) == "in") & (tail.rlike(f"^(?:{'|'.join(NO_INCH_AFTER)})") | head.rlike(f"(?:{'|'.join(NO_INCH_BEFORE)})$"))
            return F.when(~word, sizes(hit, DIM_1D, 1)[0])

        return out(_found(t, DIM_1D, body), none, none, none)

    return F.coalesce(_with_digits(text, lambda t: F.coalesce(_found(t, DIM_3D, three), _found(t, DIM_2D, two), one(t))), out(none, none, none, none))


def _scaled(pattern: str, large: str, factor: float):
    def parse(text: Column) -> Column:
        worth = lambda hit: _number(_first(hit, pattern, 1)) * F.when(F.lower(_first(hit, pattern, 2)).rlike(large), factor).otherwise(1.0)
        return _with_digits(text, lambda t: _found(t, pattern, worth))

    return parse


power_watts = _scaled(POWER, "k", 1000.0)
voltage_volts = _scaled(VOLTAGE, "k", 1000.0)
battery_mah = _scaled(BATTERY, "^ah$", 1000.0)


def storage_gb(text: Column) -> Column:
    def worth(hit: Column) -> Column:
        unit = F.lower(_first(hit, STORAGE, 2))
        return _number(_first(hit, STORAGE, 1)) * F.when(unit == "tb", 1024.0).when(unit == "mb", 1 / 1024.0).otherwise(1.0)

    return _with_digits(text, lambda t: _found(t, STORAGE, worth))


def percentage(text: Column) -> Column:
    return _with_digits(text, lambda t: _number(_first(t, PERCENTAGE, 1)))


def pack_count(text: Column) -> Column:
    """(count, is_multi): "2 boxes of 6" at once; else the product of at most one factor of each way to state a pack, or
    the largest of them where the product passes 200; else 1."""
    fits = lambda c: F.when((c > 1) & (c <= LARGEST_PACK), c)
    group = lambda pattern: lambda hit: fits(_number(_first(hit, pattern, 1)))

    def counted(t: Column) -> Column:
        nested = _found(t, NESTED, lambda hit: fits(_number(_first(hit, NESTED, 1)) * _number(_first(hit, NESTED, 2))))
        times = F.filter(F.transform(_all(t, MULTIPACK, 0), lambda hit: F.when(F.lower(_first(hit, MULTIPACK, 3)).isin(*MULTIPACK_UNITS), fits(_number(_first(hit, MULTIPACK, 1))))), lambda c: c.isNotNull())
        factors = F.filter(F.array(F.try_element_at(times, F.lit(1)), _found(t, PACK_OF, group(PACK_OF)), _found(t, COUNTED, group(COUNTED)), F.when(t.rlike(_I + PAIR), 2.0)), lambda c: c.isNotNull())
        stated = lambda f: F.when(F.size(f) > 0, let(F.aggregate(f, F.lit(1.0), lambda a, x: a * x), lambda p: F.when(p <= LARGEST_PACK, p).otherwise(F.array_max(f))))
        return F.coalesce(nested, let(factors, stated))

    count = let(clean(text), lambda t: F.when(t.rlike(r"(?U)\d"), counted(t)).when(t.rlike(_I + PAIR), 2.0))
    return let(count, lambda c: F.struct(F.coalesce(c, F.lit(1.0)).alias("count"), c.isNotNull().cast("int").alias("is_multi")))


def model_codes(text: Column) -> Column:
    """(has, count, longest) of codes that mix letters and digits."""
    codes = F.filter(F.regexp_extract_all(clean(text), F.lit(MODEL_CODE), 0), lambda c: ~F.upper(c).isin(*NO_CODES) & c.rlike("[0-9]") & c.rlike("[A-Z]"))
    return let(codes, lambda x: F.struct((F.size(x) > 0).cast("int").alias("has"), F.size(x).alias("count"), F.coalesce(F.array_max(F.transform(x, F.length)), F.lit(0)).alias("longest")))


def quantity_scope(text: Column, value: Column, pattern: str, table: dict[str, float]) -> Column:
    """per_item, total or unknown, by what stands around the matches that have the value; "each" outweighs "total"."""
    plain = {u: v for u, v in table.items() if " " not in u}
    same = F.filter(measures(text, pattern), lambda m: F.abs(m["number"] * _worth(F.regexp_replace(m["unit"], " ", ""), plain) - value) <= F.greatest(F.lit(1e-6), F.abs(value) * 1e-6))
    scope = lambda found: F.when(F.exists(found, lambda m: m["tail"].rlike(EACH_AFTER)), "per_item").when(F.exists(found, lambda m: m["head"].rlike(TOTAL_BEFORE)), "total").otherwise("unknown")
    return F.when(value.isNull(), "unknown").otherwise(let(same, scope))


#: The output columns in order; FLOAT unless named below.
SPEC_COLUMNS = (
    "pack_count is_multipack unit_weight_g total_weight_g log_total_weight_g has_weight weight_source_rank weight_is_explicit_total weight_is_per_item "
    "unit_volume_ml total_volume_ml log_total_volume_ml has_volume volume_source_rank volume_is_explicit_total volume_is_per_item "
    "dim_length_cm dim_width_cm dim_height_cm dim_volume_cm3 has_dimensions density_proxy aspect_ratio power_watts has_power voltage_volts battery_mah "
    "storage_gb has_storage percentage_spec has_model_code model_code_count max_model_code_len is_tech_spec"
).split()
_BYTES = {
    "is_multipack", "has_weight", "weight_source_rank", "weight_is_explicit_total", "weight_is_per_item", "has_volume", "volume_source_rank", "volume_is_explicit_total",
    "volume_is_per_item", "has_dimensions", "has_power", "has_storage", "has_model_code", "is_tech_spec",
}
_INTS = {"model_code_count", "max_model_code_len"}


def physical_specs(df: DataFrame, title: str = "TITLE", pack: str = "PACK_SIZE", description: str = "DESCRIPTION") -> DataFrame:
    """df with the SPEC_COLUMNS. Title comes before pack before description; missing columns count as empty.

    Fields are cleaned, then parsed, then combined, each in one projection. A text without digits isn't searched; in others a
    field is searched once for each pattern, and again only around what was found.
    """
    have = lambda name: clean(F.col(name)) if name in df.columns else F.lit("")
    own = df.columns
    out = df.withColumns({"_t": have(title), "_p": have(pack), "_d": have(description)})
    fields = ("_t", "_p", "_d")
    out = out.withColumns(
        {f"{f}_pack": pack_count(F.col(f)) for f in fields} | {f"{f}_w": weight_grams(F.col(f)) for f in fields} | {f"{f}_v": volume_ml(F.col(f)) for f in fields} | {f"{f}_dim": dimensions_cm(F.col(f)) for f in fields}
    )
    tech, named = F.concat(F.col("_t"), F.lit(" "), F.col("_d")), F.when(F.col("_t") != "", F.col("_t")).otherwise(F.col("_d"))
    rank = lambda s: F.when(F.col(f"_t_{s}").isNotNull(), 1).when(F.col(f"_p_{s}").isNotNull(), 2).when(F.col(f"_d_{s}").isNotNull(), 3).otherwise(0)
    of_rank = lambda r: F.when(r == 1, F.col("_t")).when(r == 2, F.col("_p")).when(r == 3, F.col("_d")).otherwise("")
    multi = F.array_max(F.filter(F.array(F.col("_p_pack"), F.col("_t_pack")), lambda x: x["is_multi"] == 1))
    out = out.withColumns(
        {
            "_pack": F.coalesce(multi, F.col("_d_pack")), "_w": F.coalesce("_t_w", "_p_w", "_d_w"), "_v": F.coalesce("_t_v", "_p_v", "_d_v"), "_wr": rank("w"), "_vr": rank("v"),
            "_dim": F.when(F.col("_t_dim.length").isNotNull(), F.col("_t_dim")).when(F.col("_p_dim.length").isNotNull(), F.col("_p_dim")).otherwise(F.col("_d_dim")),
            "_power": power_watts(tech), "_volt": voltage_volts(tech), "_mah": battery_mah(tech), "_gb": storage_gb(tech), "_pct": percentage(named), "_code": model_codes(named),
        }
    )
    out = out.withColumns({"_ws": quantity_scope(of_rank(F.col("_wr")), F.col("_w"), WEIGHT, GRAMS), "_vs": quantity_scope(of_rank(F.col("_vr")), F.col("_v"), VOLUME, MILLILITRES)})
    total = lambda value, scope: F.when(F.col(scope) == "total", F.col(value)).otherwise(F.col(value) * F.col("_pack.count"))
    out = out.withColumns({"_tw": total("_w", "_ws"), "_tv": total("_v", "_vs")})
    c = F.col
    specs = {
        "pack_count": c("_pack.count"), "is_multipack": c("_pack.is_multi"),
        "unit_weight_g": c("_w"), "total_weight_g": c("_tw"), "log_total_weight_g": F.log1p("_tw"), "has_weight": c("_w").isNotNull(), "weight_source_rank": c("_wr"),
        "weight_is_explicit_total": c("_w").isNotNull() & (c("_ws") == "total"), "weight_is_per_item": c("_w").isNotNull() & (c("_ws") == "per_item"),
        "unit_volume_ml": c("_v"), "total_volume_ml": c("_tv"), "log_total_volume_ml": F.log1p("_tv"), "has_volume": c("_v").isNotNull(), "volume_source_rank": c("_vr"),
        "volume_is_explicit_total": c("_v").isNotNull() & (c("_vs") == "total"), "volume_is_per_item": c("_v").isNotNull() & (c("_vs") == "per_item"),
        "dim_length_cm": c("_dim.length"), "dim_width_cm": c("_dim.width"), "dim_height_cm": c("_dim.height"), "dim_volume_cm3": c("_dim.volume"), "has_dimensions": c("_dim.length").isNotNull(),
        "density_proxy": c("_tw") / (c("_dim.volume") + 1.0), "aspect_ratio": c("_dim.length") / (c("_dim.width") + 1e-3),
        "power_watts": c("_power"), "has_power": c("_power").isNotNull(), "voltage_volts": c("_volt"), "battery_mah": c("_mah"), "storage_gb": c("_gb"), "has_storage": c("_gb").isNotNull(),
        "percentage_spec": c("_pct"), "has_model_code": c("_code.has"), "model_code_count": c("_code.count"), "max_model_code_len": c("_code.longest"),
        "is_tech_spec": (c("_code.has") == 1) | c("_gb").isNotNull() | c("_power").isNotNull(),
    }
    typed = [specs[n].cast("byte" if n in _BYTES else "int" if n in _INTS else "float").alias(n) for n in SPEC_COLUMNS]
    return out.select(*own, *typed)
