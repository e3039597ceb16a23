"""Declared types of contract fields, with the Spark types their values have."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column
from pyspark.sql import types as T

if TYPE_CHECKING:
    from stipule.plans.contract import Contract


class DeclaredType:
    """Base of all declared types."""

    def spark(self) -> T.DataType:
        """The type of a decoded value."""
        raise NotImplementedError

    def core(self) -> DeclaredType:
        """The type without newtypes around it."""
        return self


@dataclass(frozen=True)
class Scalar(DeclaredType):
    """A primitive; ``json`` is its JSON Schema name."""

    name: str
    type: T.DataType
    json: str

    def spark(self) -> T.DataType:
        return self.type


String = Scalar("String", T.StringType(), "string")
Boolean = Scalar("Boolean", T.BooleanType(), "boolean")
Int = Scalar("Int", T.IntegerType(), "integer")
Long = Scalar("Long", T.LongType(), "integer")
Float = Scalar("Float", T.FloatType(), "number")
Double = Scalar("Double", T.DoubleType(), "number")
BigDecimal = Scalar("BigDecimal", T.DecimalType(38, 18), "number")
BigInt = Scalar("BigInt", T.DecimalType(38, 0), "number")
#: Types whose values the numeric constraints look at.
NUMERIC = (Int, Long, Float, Double)
EPOCH = (Int, Long)


@dataclass(frozen=True)
class ListOf(DeclaredType):
    """A list; every element must decode."""

    item: DeclaredType

    def spark(self) -> T.DataType:
        return T.ArrayType(self.item.spark())


@dataclass(frozen=True)
class SetOf(ListOf):
    """A list without repeated elements."""


@dataclass(frozen=True)
class MapOf(DeclaredType):
    """String keys to values that must all decode."""

    value: DeclaredType

    def spark(self) -> T.DataType:
        return T.MapType(T.StringType(), self.value.spark())


@dataclass(frozen=True)
class Nested(DeclaredType):
    """A record with a contract of its own."""

    contract: Contract

    def spark(self) -> T.DataType:
        return self.contract.struct_type()


@dataclass(frozen=True)
class Either(DeclaredType):
    """One of two types: ``{"left": …}`` or ``{"right": …}``, or tagged by a discriminator key."""

    left: DeclaredType
    right: DeclaredType
    key: str | None = None
    left_tag: str = "left"
    right_tag: str = "right"

    def spark(self) -> T.DataType:
        return T.StructType([T.StructField("left", self.left.spark()), T.StructField("right", self.right.spark())])


@dataclass(frozen=True)
class Wrapper(DeclaredType):
    """A newtype; it decodes and is constrained as what it wraps."""

    name: str
    inner: DeclaredType

    def spark(self) -> T.DataType:
        return self.inner.spark()

    def core(self) -> DeclaredType:
        return self.inner.core()


@dataclass(frozen=True)
class Extract(DeclaredType):
    """A string that must match a pattern whole; its groups are the fields of the value.

    Without groups there must be one field, which takes the whole string.
    """

    pattern: str
    fields: tuple[tuple[str, DeclaredType], ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "fields", tuple(self.fields))
        groups = re.compile(self.pattern).groups
        if len(self.fields) != max(groups, 1):
            raise ValueError(f"pattern {self.pattern!r} has {groups} groups for {len(self.fields)} fields")

    def spark(self) -> T.DataType:
        return T.StructType([T.StructField(n, t.spark()) for n, t in self.fields])


@dataclass(frozen=True)
class Custom(DeclaredType):
    """A decoder of one's own: from a column (VARIANT in raw records) to a value, or NULL."""

    type: T.DataType
    decode: Callable[[Column], Column]
    json: str = "any"

    def spark(self) -> T.DataType:
        return self.type


def json_name(kind: DeclaredType) -> str:
    """JSON Schema's name for a declared type; ``any`` where it has none."""
    kind = kind.core()
    if isinstance(kind, Scalar):
        return kind.json
    if isinstance(kind, ListOf):
        return "array"
    if isinstance(kind, (Nested, Either, MapOf)):
        return "object"
    return kind.json if isinstance(kind, Custom) else "any"


def java_double(value: Any) -> str:
    """A number as Java prints a double."""
    x = float(value)
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return repr(x) if "e" not in repr(x) else f"{x:.10f}".rstrip("0")
    digits, _, power = f"{x!r}".partition("e")
    if not power:
        digits, _, power = f"{x:.17e}".partition("e")
        for n in range(1, 18):
            if float(f"{x:.{n}e}") == x:
                digits = f"{x:.{n}e}".partition("e")[0]
                break
    return f"{digits if '.' in digits else digits + '.0'}E{int(power)}"
