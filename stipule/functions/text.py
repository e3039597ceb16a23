"""Text functions: anchored matching, UTF-16 lengths, plain number text, JSON text."""

from __future__ import annotations

import json
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def full_match(c: Column, regex: str) -> Column:
    """Whether the whole text matches; a final newline is not forgiven."""
    return c.rlike(rf"\A(?:{regex})\z")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, which counts supplementary characters twice."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def _strip_zeros(text: Column) -> Column:
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")).otherwise(text)


def plain_double(c: Column) -> Column:
    """A double without exponent or trailing zeros; NULL for NaN and infinities.

    Works on the shortest text of the double: its digits are padded to the place
    that the exponent names.
    """
    x = c.cast("double")
    text = F.abs(x).cast("string")
    power = F.coalesce(F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    digits = F.regexp_replace(F.regexp_replace(text, r"E.*$", ""), r"\.", "")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    wide = F.rpad(digits, F.greatest(power + 1, F.length(digits)), F.lit("0"))
    large = F.concat(F.substring(wide, F.lit(1), power + 1), F.lit("."), F.substring(wide, power + 2, F.length(wide)))
    shown = F.when(~text.contains("E"), text).when(power < 0, small).otherwise(large)
    number = F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), _strip_zeros(shown))
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("string")).when(x == 0, F.lit("0")).otherwise(number)


def plain_decimal(c: Column) -> Column:
    """A decimal without trailing zeros."""
    return _strip_zeros(c.cast("string"))


def quoted(c: Column) -> Column:
    """A JSON string; only quotes, backslashes and control characters are escaped, with small hexadecimal digits."""
    whole = F.to_json(F.struct(c.alias("s")))
    shown = F.substring(whole, F.lit(6), F.length(whole) - 6)
    small = shown
    for digit in "ABCDEF":
        # An escape begins at a backslash that no other one escapes.
        small = F.regexp_replace(small, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}")
    return F.when(c.rlike(r"[\x0B\x0E\x0F\x1A-\x1F]"), small).otherwise(shown)


def json_text(c: Column, kind: T.DataType) -> Column:
    """Canonical JSON of a typed value: sorted keys, no null members, plain numbers.

    NULL stays NULL, so that a member can be left out; in arrays it is ``null``.
    """
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(c.isNotNull(), F.coalesce(plain_double(c), F.lit("null")))
    if isinstance(kind, T.DecimalType):
        return plain_decimal(c)
    if isinstance(kind, T.StringType):
        return F.when(c.isNotNull(), quoted(c))
    if isinstance(kind, T.VariantType):
        return variant_json(c)
    if isinstance(kind, T.ArrayType):
        inner = F.transform(c, lambda x: F.coalesce(json_text(x, kind.elementType), F.lit("null")))
        return F.concat(F.lit("["), F.array_join(inner, ","), F.lit("]"))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.filter(F.map_entries(c), lambda e: e["value"].isNotNull()))
        inner = F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), json_text(e["value"], kind.valueType)))
        return F.concat(F.lit("{"), F.array_join(inner, ","), F.lit("}"))
    if isinstance(kind, T.StructType):
        members = []
        for f in sorted(kind.fields, key=lambda f: utf16(f.name)):
            member = F.concat(F.lit(_string(f.name) + ":"), json_text(c.getField(f.name), f.dataType))
            members.append(member)
        inner = F.concat_ws(",", *members) if members else F.lit("")
        return F.when(c.isNotNull(), F.concat(F.lit("{"), inner, F.lit("}")))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.when(c.isNotNull(), quoted(c.cast("string")))
    return c.cast("string")


def utf16(key: str) -> bytes:
    """Keys sort by UTF-16 units."""
    return key.encode("utf-16-be", "surrogatepass")


def number_text(x: float | Decimal) -> str:
    """A finite number without exponent or trailing zeros."""
    text = format(x if isinstance(x, Decimal) else Decimal(repr(x)), "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text


def render(value: Any, indent: int = 0, depth: int = 0) -> str:
    """Canonical JSON of a parsed value; ``indent`` spaces a level, 0 for compact."""
    pad, end = ("\n" + " " * indent * (depth + 1), "\n" + " " * indent * depth) if indent else ("", "")
    if isinstance(value, dict):
        held = sorted(((k, v) for k, v in value.items() if v is not None), key=lambda e: utf16(e[0]))
        colon = ": " if indent else ":"
        inner = [f"{pad}{_string(k)}{colon}{render(v, indent, depth + 1)}" for k, v in held]
        return "{" + ",".join(inner) + (end if inner else "") + "}"
    if isinstance(value, list):
        inner = [pad + render(v, indent, depth + 1) for v in value]
        return "[" + ",".join(inner) + (end if inner else "") + "]"
    if isinstance(value, str):
        return _string(value)
    if value is None or isinstance(value, float) and (value != value or abs(value) == float("inf")):
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float, Decimal)):
        return str(value) if isinstance(value, int) else number_text(value)
    return _string(str(value))


# The escapes of JSON text.
ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _string(text: str) -> str:
    return '"' + "".join(ESCAPES.get(c, f"\\u{ord(c):04x}" if c < " " else c) for c in text) + '"'


def parsed(text: str) -> Any:
    """A JSON value; numbers with a fraction or an exponent keep all their digits."""
    return json.loads(text, parse_float=Decimal)


def variant_json(c: Column, indent: int = 0) -> Column:
    """Canonical JSON of VARIANTs whose shape no contract knows; Arrow batches.

    Spark writes numbers that are none as strings, so values with such strings
    are looked at themselves.
    """

    @F.pandas_udf(T.StringType())
    def shown(texts: pd.Series, odd: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else render(parsed(t) if v is None else v.toPython(), indent) for t, v in zip(texts, odd, strict=True)], dtype=object)

    text = F.to_json(c)
    return shown(text, F.when(text.rlike('"(NaN|-?Infinity)"'), c))


def pretty_json(c: Column, indent: int = 2) -> Column:
    """JSON text laid out with ``indent`` spaces a level; for display, in Arrow batches."""

    @F.pandas_udf(T.StringType())
    def laid_out(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else render(parsed(t), indent))

    return laid_out(c)
