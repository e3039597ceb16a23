"""The constraints of a field as violation predicates, in reporting order."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from stipule.functions import sql
from stipule.functions.scopes import Scope
from stipule.plans import types as D
from stipule.plans.contract import Field

# The patterns of the format constraints.
EMAIL = r"[^@\s]+@[^@\s]+\.[^@\s]+"
URL = r"https?://[^\s/$.?#].[^\s]*"
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
#: Beyond this, rounding a ratio to a whole number saturates.
ROUND_LIMIT = 9.3e18


class Constraint(NamedTuple):
    """A violated constraint: its name, where it fails, and the message, as texts."""

    name: str
    fails: str
    message: str


def no_whitespace(c: Column) -> Column:
    """A validator: one message where the text holds white space, with its first 40 characters."""
    found = F.concat(F.lit("must not contain whitespace (got '"), F.substring(c, 1, 40), F.lit("')"))
    return F.when(c.rlike(r"(?U)\s"), F.array(found)).otherwise(F.array().cast("array<string>"))


def _clock(at: Scope, now: Column | None) -> str:
    return "unix_millis(current_timestamp())" if now is None else at.apply(lambda: now, key=f"clock {id(now)}")


def constraints(at: Scope, f: Field, c: str, now: Column | None = None, strict_reference: bool = False) -> list[Constraint]:
    """The constraints that apply to a decoded value of the field's type; none fails where it is NULL.

    A constraint on a type that it does not know is ignored.  Under
    ``strict_reference``, string constraints on an optional newtype are too.
    """
    kind, name = f.type.core(), f.name
    text = kind == D.String and not (strict_reference and f.optional and isinstance(f.type, D.Wrapper))
    number, epoch = kind in D.NUMERIC, kind in D.EPOCH
    x = c if kind == D.Double else f"CAST({c} AS DOUBLE)"
    out: list[Constraint] = []

    # The texts of the messages.
    def add(code: str, fails: str, message: str, got: str | None = None) -> None:
        shown = sql.text(f"'{name}' {message}")
        out.append(Constraint(code, f"coalesce({fails}, FALSE)", shown if got is None else f"concat({shown}, CAST({got} AS STRING), ')')"))

    if f.non_empty and text:
        add("nonEmpty", f"{c} = ''", "must not be empty")
    elif f.non_empty and isinstance(kind, (D.ListOf, D.MapOf)):
        add("nonEmpty", f"size({c}) = 0", "must not be empty")
    if text:
        units = f"CAST(octet_length(encode({c}, 'UTF-16BE')) / 2 AS INT)"
        # Cheaper lengths that bound the UTF-16 one decide most rows.
        if f.min_length is not None:
            add("minLength", f"char_length({c}) < {f.min_length} AND {units} < {f.min_length}", f"must be at least {f.min_length} characters (got ", units)
        if f.max_length is not None:
            add("maxLength", f"octet_length({c}) > {f.max_length} AND {units} > {f.max_length}", f"must be at most {f.max_length} characters (got ", units)
    if number:
        if f.min is not None:
            add("min", f"{x} < {sql.double(f.min)}", f"must be >= {f.min} (got ", x)
        if f.max is not None:
            add("max", f"{x} > {sql.double(f.max)} AND NOT isnan({x})", f"must be <= {f.max} (got ", x)
    if text:
        if f.pattern is not None:
            add("pattern", f"NOT {sql.full_match(c, f.pattern)}", "does not match required pattern")
        if f.extract is not None:
            add("extract", f"NOT {sql.full_match(c, f.extract)}", "does not match required format")
        for on, code, regex, what in ((f.email, "email", EMAIL, "email address"), (f.url, "url", URL, "URL"), (f.uuid, "uuid", UUID, "UUID")):
            if on:
                add(code, f"NOT {sql.full_match(c, regex)}", f"is not a valid {what}")
    if epoch and f.future:
        add("future", f"{c} <= {_clock(at, now)}", "must be a future timestamp (got ", c)
    if epoch and f.past:
        add("past", f"{c} >= {_clock(at, now)}", "must be a past timestamp (got ", c)
    if number and f.positive:
        add("positive", f"{x} <= {sql.double(0)}", "must be positive (got ", x)
    if number and f.multiple_of is not None:
        ratio = f"({x} / {sql.double(f.multiple_of)})"
        off = f"(abs({ratio} - round({ratio})) > {sql.double(1e-7)} OR abs({ratio}) > {sql.double(ROUND_LIMIT)}) AND NOT isnan({ratio})"
        add("multipleOf", off, f"must be a multiple of {D.java_double(f.multiple_of)} (got ", x)
    return out
