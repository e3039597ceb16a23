"""Violations: single checks as SQL text, and arrays of them built in plain branches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from stipule.functions import sql

VIOLATION = "struct<path:array<string>,code:string,message:string>"
NONE = f"CAST(array() AS array<{VIOLATION}>)"
#: Branches whose code fits in one method; more are gathered by a filter, outside generated code.
BRANCHES = 64


def violation(path: Sequence[str], code: str, message: str) -> str:
    """One violation, from texts."""
    return sql.struct([("path", sql.array(path)), ("code", code), ("message", message)])


@dataclass(frozen=True)
class Check:
    """Where something is wrong (a condition that is never NULL), and the violations to report there."""

    fails: str
    found: str

    @classmethod
    def one(cls, fails: str, path: Sequence[str], code: str, message: str) -> Check:
        """A check that reports a single violation."""
        return cls(fails, f"array({violation(path, code, message)})")

    def when(self, gate: str) -> Check:
        """The same check, only where ``gate`` holds."""
        return self if gate == "TRUE" else Check(f"{gate} AND ({self.fails})", self.found)


def collected(checks: Sequence[Check]) -> str:
    """All violations in order.  Each check is a plain branch, so up to ``BRANCHES`` stay in generated code."""
    some = [c for c in checks if c.fails != "FALSE"]
    if len(some) > BRANCHES:
        found = ", ".join(f"CASE WHEN {c.fails} THEN {c.found} END" for c in some)
        return f"CAST(flatten(filter(array({found}), held -> held IS NOT NULL)) AS array<{VIOLATION}>)"
    found = ", ".join(f"CASE WHEN {c.fails} THEN {c.found} ELSE {NONE} END" for c in some)
    return f"CAST(concat({found}) AS array<{VIOLATION}>)" if some else NONE


def any_fails(checks: Sequence[Check]) -> str:
    """Whether any check fails; no array is built for it."""
    return sql.any_of(c.fails for c in checks if c.fails != "FALSE")


def dotted(violation: Column) -> Column:
    """The path of a violation as dotted text; the root is empty."""
    return F.array_join(violation.getField("path"), ".")
