"""Filters: a predicate tree that runs as a Column or exports as a document-store query.

Predicates have two truth values, SQL has three.  Negation is pushed to the
leaves when compiling, and every leaf has a negated form of its own that keeps
rows without a value where they belong.  No ``coalesce`` is needed on top, so
predicates reach the file scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stipule.functions.text import full_match
from stipule.plans.contract import Contract

Lookup = Callable[[str], "Operand"]
LOGICAL = ("$and", "$or", "$nor")


@dataclass(frozen=True)
class Operand:
    """What a predicate reads: the value to compare with a constant, raw text, and whether null is explicit."""

    like: Callable[[Any], Column]
    text: Column
    there: Column
    null: Column


class Expr:
    """A node of a filter."""

    def column(self, at: Lookup, negated: bool = False) -> Column:
        """The predicate, or its negation, as a Column that is never NULL in effect."""
        raise NotImplementedError

    def to_mongo_query(self) -> dict[str, Any]:
        """The predicate as a query document."""
        raise NotImplementedError

    def __and__(self, other: Expr) -> Expr:
        return And(self, other)

    def __or__(self, other: Expr) -> Expr:
        return Or(self, other)

    def __invert__(self) -> Expr:
        return Not(self)


@dataclass(frozen=True)
class And(Expr):
    left: Expr
    right: Expr

    def column(self, at: Lookup, negated: bool = False) -> Column:
        a, b = self.left.column(at, negated), self.right.column(at, negated)
        return a | b if negated else a & b

    def to_mongo_query(self) -> dict[str, Any]:
        a, b = self.left.to_mongo_query(), self.right.to_mongo_query()
        flat = not any(k in LOGICAL for k in (*a, *b)) and not a.keys() & b.keys()
        return a | b if flat else {"$and": [a, b]}


@dataclass(frozen=True)
class Or(Expr):
    left: Expr
    right: Expr

    def column(self, at: Lookup, negated: bool = False) -> Column:
        a, b = self.left.column(at, negated), self.right.column(at, negated)
        return a & b if negated else a | b

    def to_mongo_query(self) -> dict[str, Any]:
        return {"$or": [self.left.to_mongo_query(), self.right.to_mongo_query()]}


@dataclass(frozen=True)
class Not(Expr):
    inner: Expr

    def column(self, at: Lookup, negated: bool = False) -> Column:
        return self.inner.column(at, not negated)

    def to_mongo_query(self) -> dict[str, Any]:
        return {"$nor": [self.inner.to_mongo_query()]}


@dataclass(frozen=True)
class Exists(Expr):
    name: str
    wanted: bool = True

    def column(self, at: Lookup, negated: bool = False) -> Column:
        o = at(self.name)
        return o.there if self.wanted != negated else ~o.there

    def to_mongo_query(self) -> dict[str, Any]:
        return {self.name: {"$exists": self.wanted}}


@dataclass(frozen=True)
class Equal(Expr):
    """Equality; ``None`` matches an explicit null only."""

    name: str
    value: Any
    wanted: bool = True

    def column(self, at: Lookup, negated: bool = False) -> Column:
        o, positive = at(self.name), self.wanted != negated
        if self.value is None:
            return o.null if positive else ~o.null
        return o.like(self.value) == self.value if positive else ~o.like(self.value).eqNullSafe(F.lit(self.value))

    def to_mongo_query(self) -> dict[str, Any]:
        return {self.name: self.value if self.wanted else {"$ne": self.value}}


#: Comparisons and what each becomes when negated.
COMPARE: dict[str, tuple[Callable, Callable]] = {
    "$gt": (lambda c, v: c > v, lambda c, v: c <= v),
    "$gte": (lambda c, v: c >= v, lambda c, v: c < v),
    "$lt": (lambda c, v: c < v, lambda c, v: c >= v),
    "$lte": (lambda c, v: c <= v, lambda c, v: c > v),
}


@dataclass(frozen=True)
class Compare(Expr):
    """An ordering comparison.  As ``double``, NaN never compares."""

    name: str
    op: str
    value: Any
    double: bool = False

    def column(self, at: Lookup, negated: bool = False) -> Column:
        held = at(self.name).like(self.value)
        c = held.cast("double") if self.double else held
        yes, no = COMPARE[self.op]
        if not negated:
            return yes(c, self.value) & ~F.isnan(c) if self.double else yes(c, self.value)
        return c.isNull() | no(c, self.value) | F.isnan(c) if self.double else c.isNull() | no(c, self.value)

    def to_mongo_query(self) -> dict[str, Any]:
        return {self.name: {self.op: float(self.value) if self.double else self.value}}


def _kind(constant: Any) -> type:
    return bool if isinstance(constant, bool) else str if isinstance(constant, str) else float


@dataclass(frozen=True)
class Within(Expr):
    name: str
    values: tuple[Any, ...]
    wanted: bool = True

    def column(self, at: Lookup, negated: bool = False) -> Column:
        o, positive = at(self.name), self.wanted != negated
        # Constants of one kind are looked up together.
        kinds: dict[type, list[Any]] = {}
        for v in self.values:
            kinds.setdefault(_kind(v), []).append(v)
        out = F.lit(not positive)
        for k, values in enumerate(kinds.values()):
            c = o.like(values[0])
            inside = c.isin(*values)
            one = inside if positive else c.isNull() | ~inside
            out = one if not k else out | one if positive else out & one
        return out

    def to_mongo_query(self) -> dict[str, Any]:
        return {self.name: {"$in" if self.wanted else "$nin": list(self.values)}}


@dataclass(frozen=True)
class Text(Expr):
    """A predicate on text as it stands; other values never match."""

    name: str
    op: str
    value: str

    def column(self, at: Lookup, negated: bool = False) -> Column:
        c = at(self.name).text
        hit = {"contains": c.contains, "startsWith": c.startswith}[self.op](self.value) if self.op != "matches" else full_match(c, self.value)
        return c.isNull() | ~hit if negated else hit

    def to_mongo_query(self) -> dict[str, Any]:
        # Within a quoted stretch only its end mark means something.
        literal = rf"\Q{self.value.replace(r'\E', r'\E\\E\Q')}\E"
        if self.op == "matches":
            anchored = self.value.startswith("^") and self.value.endswith("$")
            return {self.name: {"$regex": self.value if anchored else f"^{self.value}$"}}
        return {self.name: {"$regex": literal if self.op == "contains" else f"^{literal}"}}


@dataclass(frozen=True)
class FieldFilter:
    """Predicates of one field."""

    name: str
    jvm: bool = False

    def exists(self) -> Expr:
        return Exists(self.name)

    def not_exists(self) -> Expr:
        return Exists(self.name, False)

    is_defined, is_none, is_empty = exists, not_exists, not_exists

    def equal_to(self, value: Any) -> Expr:
        return Equal(self.name, value)

    def not_equal_to(self, value: Any) -> Expr:
        return Equal(self.name, value, False)

    is_, is_not = equal_to, not_equal_to

    def is_some(self, value: Any) -> Expr:
        return Equal(self.name, value)

    def _compare(self, op: str, value: Any) -> Expr:
        return Compare(self.name, op, value, self.jvm and not isinstance(value, str))

    def gt(self, value: Any) -> Expr:
        return self._compare("$gt", value)

    def gte(self, value: Any) -> Expr:
        return self._compare("$gte", value)

    def lt(self, value: Any) -> Expr:
        return self._compare("$lt", value)

    def lte(self, value: Any) -> Expr:
        return self._compare("$lte", value)

    __gt__, __ge__, __lt__, __le__ = gt, gte, lt, lte

    def in_(self, values: Sequence[Any]) -> Expr:
        return Within(self.name, tuple(values))

    def not_in(self, values: Sequence[Any]) -> Expr:
        return Within(self.name, tuple(values), False)

    def contains(self, text: str) -> Expr:
        return Text(self.name, "contains", text)

    def starts_with(self, text: str) -> Expr:
        return Text(self.name, "startsWith", text)

    def matches(self, regex: str) -> Expr:
        re.compile(regex)
        return Text(self.name, "matches", regex)


@dataclass(frozen=True)
class Filter:
    """Typed builder: ``Filter(contract).field("age").gte(18)``; unknown names raise."""

    contract: Contract | None = None
    jvm: bool = field(default=False, kw_only=True)

    def field(self, name: str) -> FieldFilter:
        if self.contract is not None:
            self.contract.field(name)
        return FieldFilter(name, self.jvm)


def matching(df: DataFrame, expr: Expr, contract: Contract | None = None, raw: str | None = None, *, nulls: str = "absent", jvm: bool = False) -> DataFrame:
    """The rows of ``df`` that a filter accepts."""
    return df.filter(predicate(df, expr, contract, raw, nulls=nulls, jvm=jvm))


def predicate(df: DataFrame, expr: Expr, contract: Contract | None = None, raw: str | None = None, *, nulls: str = "absent", jvm: bool = False) -> Column:
    """A filter over a table's columns, or over the VARIANT records of ``raw``."""
    if raw is None:

        def column(name: str) -> Operand:
            c = F.col(f"`{name}`")
            text = c if isinstance(df.schema[name].dataType, T.StringType) else F.lit(None).cast("string")
            return Operand(lambda _: c, text, c.isNotNull(), c.isNull() if nulls == "explicit" else F.lit(False))

        return expr.column(column)

    from stipule.functions import sql
    from stipule.functions.scopes import Inline
    from stipule.functions.values import VariantValue, decode, decoded_column
    from stipule.functions.values import member as member_of
    from stipule.plans.types import Boolean, Double, String

    if contract is None:
        raise ValueError("raw records need a contract to decode by")

    def member(name: str) -> Operand:
        f, at = contract.field(name), Inline()
        m = member_of(VariantValue(sql.name(raw)), f)
        there = F.expr(f"NOT {m.absent(at)} AND NOT {m.null(at)}")
        # The JVM's predicates do not decode: they look at the value as it stands.
        as_is = lambda v: F.expr(decode(at, m, {str: String, bool: Boolean, float: Double}[_kind(v)], True))
        return Operand(as_is if jvm else lambda _: decoded_column(m, f), as_is(""), there, F.expr(m.null(at)))

    return F.coalesce(expr.column(member), F.lit(False))
