"""Contracts: fields, constraints, policies, cross-field rules and aspects.

Descriptors are immutable and checked when they are made, so a wrong contract
fails at start-up, not on data.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import types as T

from stipule.plans.types import DeclaredType, ListOf, Nested


class _Missing:
    """Marks a field without a default."""

    def __repr__(self) -> str:
        return "MISSING"


MISSING = _Missing()
#: Constraints in the order in which their violations are reported.
CONSTRAINTS = (
    "non_empty", "min_length", "max_length", "min", "max", "pattern", "extract", "email", "url", "uuid", "future", "past",
    "positive", "multiple_of", "validators",
)
POLICIES = ("immutable", "internal", "reserved", "masked")


@dataclass(frozen=True)
class Field:
    """One field of a contract.

    ``validators`` are functions from the decoded value to an array of messages.
    ``masked`` is the text that replaces the value.  ``include`` promotes the
    fields of a nested contract to this record's own level.
    """

    name: str
    type: DeclaredType
    optional: bool = False
    default: Any = MISSING
    non_empty: bool = False
    min_length: int | None = None
    max_length: int | None = None
    min: int | None = None
    max: int | None = None
    pattern: str | None = None
    extract: str | None = None
    email: bool = False
    url: bool = False
    uuid: bool = False
    future: bool = False
    past: bool = False
    positive: bool = False
    multiple_of: float | None = None
    validators: tuple[Callable[[Column], Column], ...] = ()
    immutable: bool = False
    internal: bool = False
    reserved: bool = False
    masked: str | None = None
    include: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "validators", tuple(self.validators))
        if not self.name:
            raise ValueError("a field needs a name")
        for regex in (self.pattern, self.extract):
            if regex is not None:
                re.compile(regex)
        if self.include and not isinstance(self.type, Nested):
            raise ValueError(f"{self.name}: only a nested contract can be included")
        if self.multiple_of == 0:
            raise ValueError(f"{self.name}: a multiple of 0 means nothing")

    @property
    def has_default(self) -> bool:
        return self.default is not MISSING

    @property
    def required(self) -> bool:
        return not self.optional and not self.has_default

    @property
    def nested(self) -> Contract | None:
        """The contract of the value or of a list's elements."""
        kind = self.type.core()
        kind = kind.item.core() if isinstance(kind, ListOf) else kind
        return kind.contract if isinstance(kind, Nested) else None


@dataclass(frozen=True)
class Rule:
    """A cross-field rule: the message is a violation where ``holds`` is false.

    ``holds`` gets the decoded record as a struct column.  As in SQL, a NULL
    outcome does not violate.
    """

    message: str
    holds: Callable[[Column], Column]


class _Names:
    """Attribute access to field names; unknown names raise."""

    def __init__(self, names: Iterable[str]) -> None:
        self._names = frozenset(names)

    def __getattr__(self, name: str) -> str:
        if name.startswith("__") or name not in self._names:
            raise AttributeError(f"no field {name!r}; nested selectors are not supported")
        return name


@dataclass(frozen=True)
class Contract:
    """A named list of fields; closed unless ``open``."""

    name: str
    declared: tuple[Field, ...]
    open: bool = False
    rules: tuple[Rule, ...] = ()
    source: Contract | None = field(default=None, repr=False)

    @staticmethod
    def define(name: str, *declared: Field, open: bool = False, rules: Sequence[Rule] = ()) -> Contract:
        """Make a contract."""
        return Contract(name, tuple(declared), open, tuple(rules))

    def __post_init__(self) -> None:
        seen: dict[str, str] = {}
        for f in self.fields:
            other = seen.setdefault(f.name.lower(), f.name)
            if sum(x.name.lower() == f.name.lower() for x in self.fields) > 1:
                raise ValueError(f"{self.name}: fields {other!r} and {f.name!r} differ only by case, which Spark ignores, or repeat")

    @property
    def fields(self) -> tuple[Field, ...]:
        """Fields at this record's level: included contracts are expanded, one level deep."""
        out: list[Field] = []
        for f in self.declared:
            out.extend(f.type.contract.declared if f.include else (f,))
        return tuple(out)

    @property
    def f(self) -> _Names:
        """Checked field names: ``contract.f.age``."""
        return _Names(x.name for x in self.fields)

    def field(self, name: str) -> Field:
        """A field by its exact name."""
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(f"{self.name} has no field {name!r}")

    def struct_type(self) -> T.StructType:
        """The type of a decoded record, with included contracts nested."""
        return T.StructType([T.StructField(f.name, f.type.spark(), nullable=True, metadata=policy_metadata(f)) for f in self.declared])

    def wire_type(self) -> T.StructType:
        """The type of a record at its own level; only optional fields are nullable."""
        return T.StructType([T.StructField(f.name, f.type.spark(), nullable=not f.required, metadata=policy_metadata(f)) for f in self.fields])

    def aspect(self, name: str, *declared: Field, inherit: str = "none", exclude: Sequence[str] = (), rules: Sequence[Rule] = ()) -> Contract:
        """A structural variant: constraints of like-named fields carry over, policies do not.

        A constraint that the aspect's field sets itself wins.  With ``inherit``
        as ``"all"`` every field of this contract must be declared or excluded.
        Aspects are closed and have only their own rules.
        """
        names, own = {f.name for f in self.fields}, {f.name for f in declared}
        if inherit not in ("none", "all"):
            raise ValueError("inherit is 'none' or 'all'")
        if exclude and inherit != "all":
            raise ValueError(f"{name}: exclude needs inherit='all'")
        if unknown := sorted(set(exclude) - names):
            raise ValueError(f"{name}: {self.name} has no {', '.join(unknown)} to exclude")
        if inherit == "all" and (left := [f.name for f in self.fields if f.name not in own and f.name not in exclude]):
            raise ValueError(f"{name}: declare or exclude {', '.join(left)}")
        if both := sorted(own & set(exclude)):
            raise ValueError(f"{name}: {', '.join(both)} both declared and excluded")
        if not declared:
            raise ValueError(f"{name}: an aspect needs fields")
        return Contract(name, tuple(_inherited(f, self) for f in declared), False, tuple(rules), self)

    def is_aspect_of(self, other: Contract) -> bool:
        """Whether this contract was derived from ``other``."""
        return self.source is other or self.source == other

    def json_schema(self) -> dict[str, Any]:
        """The draft-07 schema of a record."""
        from stipule.plans.schema import json_schema

        return json_schema(self)


def _inherited(own: Field, source: Contract) -> Field:
    try:
        base = source.field(own.name)
    except KeyError:
        return own
    plain = {f.name: f.default for f in fields(Field) if f.name in CONSTRAINTS}
    return replace(own, **{c: getattr(base, c) for c in CONSTRAINTS if getattr(own, c) == plain[c]})


def policy_metadata(f: Field) -> dict[str, Any]:
    """Column metadata that names a field's policies."""
    return {p: getattr(f, p) for p in POLICIES if getattr(f, p) not in (False, None)}
