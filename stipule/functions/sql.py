"""SQL text: literals, names and types.  Contracts compile to text, which is parsed once in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable
from decimal import Decimal
from typing import Any

from pyspark.sql import types as T

PLAIN = re.compile(r"[A-Za-z0-9 _.,:;()\[\]#@%&*+/<>=!?|^~-]*")


def text(value: str) -> str:
    """A string literal.  What the session's parser settings could read otherwise is written in hexadecimal."""
    return f"'{value}'" if PLAIN.fullmatch(value) else f"CAST(X'{value.encode('utf-8').hex()}' AS STRING)"


def name(value: str) -> str:
    """A quoted column or member name."""
    return "`" + value.replace("`", "``") + "`"


def double(value: float) -> str:
    """A double literal."""
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def type_text(kind: T.DataType) -> str:
    """A type, with quoted member names."""
    if isinstance(kind, T.StructType):
        return "struct<" + ",".join(f"{name(f.name)}:{type_text(f.dataType)}" for f in kind.fields) + ">"
    if isinstance(kind, T.ArrayType):
        return f"array<{type_text(kind.elementType)}>"
    if isinstance(kind, T.MapType):
        return f"map<{type_text(kind.keyType)},{type_text(kind.valueType)}>"
    return kind.simpleString()


def null(kind: T.DataType) -> str:
    return f"CAST(NULL AS {type_text(kind)})"


def constant(value: Any, kind: T.DataType) -> str | None:
    """A plain Python value as a literal of a type; None if it is not plain."""
    if value is None:
        return null(kind)
    if isinstance(value, bool):
        return f"CAST({'TRUE' if value else 'FALSE'} AS {type_text(kind)})"
    return f"CAST({text(str(value))} AS {type_text(kind)})" if isinstance(value, (str, int, float, Decimal)) else None


def struct(members: Iterable[tuple[str, str]]) -> str:
    """A struct of named texts."""
    return f"named_struct({', '.join(f'{text(n)}, {c}' for n, c in members)})"


def array(items: Iterable[str], kind: str = "string") -> str:
    held = ", ".join(items)
    return f"array({held})" if held else f"CAST(array() AS array<{kind}>)"


def any_of(conditions: Iterable[str]) -> str:
    """Whether any condition holds; the parser balances the chain."""
    return " OR ".join(f"({c})" for c in conditions) or "FALSE"


def full_match(c: str, regex: str) -> str:
    """Whether the whole text matches; a final newline is not forgiven."""
    anchored = rf"\A(?:{regex})\z"
    return f"rlike({c}, {text(anchored)})"
