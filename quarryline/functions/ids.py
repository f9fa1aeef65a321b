"""Comparable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_id(column: Column, kind: T.DataType, mode: str = "numeric") -> Column:
    """A string key of an identifier; null for what can't be one (null, blank, not finite).

    strict: the type is part of the key, so that 1, 1.0, "1" and true differ. numeric: whole numbers of any numeric
    type agree (number:1) and texts are trimmed (text:a). plain: as numeric without the kind, so that 1 and "1" agree.
    """
    whole = isinstance(kind, T.IntegralType)
    real = isinstance(kind, (T.FractionalType, T.DecimalType))
    text = F.trim(column.cast("string"))
    if mode == "strict":
        tag = "bool" if isinstance(kind, T.BooleanType) else "int" if whole else "float" if real else "str"
        return F.when(text != "", F.concat(F.lit(f"{tag}:"), column.cast("string")))
    if mode not in ("numeric", "plain"):
        raise ValueError("mode is strict, numeric or plain")
    if real:
        value = column.cast("double")
        text = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.when(F.floor(value) == value, value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("string")))
    prefix = "" if mode == "plain" else "number:" if whole or real else "text:"
    return F.when(text != "", F.concat(F.lit(prefix), text))
