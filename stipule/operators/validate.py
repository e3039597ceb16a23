"""Validation of DataFrames: whole records, partial ones, and patches against stored state."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stipule.functions import sql
from stipule.functions.scopes import Scope, Table
from stipule.functions.values import TypedValue, Value, VariantValue
from stipule.operators.compiler import Compiler, Options, Record
from stipule.operators.deltas import as_map, as_record, deep_merge, extra_fields
from stipule.operators.violations import NONE, Check, any_fails, collected
from stipule.plans.contract import Contract


class Results(NamedTuple):
    """Names of the result columns."""

    value: str = "value"
    is_valid: str = "is_valid"
    violations: str = "violations"
    extras: str = "extras"
    draft: str = "draft"


class Columns(Value):
    """A DataFrame's columns as a record.  A column that does not exist is absent."""

    def __init__(self, df: DataFrame, contract: Contract, nulls: str, unknown: tuple[str, ...]) -> None:
        if nulls not in ("absent", "explicit"):
            raise ValueError("nulls is 'absent' or 'explicit'")
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.explicit = nulls == "explicit"
        self.names = [f.name for f in contract.fields if f.name in self.types] + list(unknown)

    def member(self, name: str, heavy: bool = False) -> Value:
        path = (sql.text(name),)
        return TypedValue(sql.name(name), self.types[name], self.explicit, path) if name in self.types else TypedValue(None, None, self.explicit, path)

    def absent(self, at: Scope) -> str:
        return "FALSE"

    null = absent

    def is_object(self, at: Scope) -> str:
        return "TRUE"

    def fixed_keys(self) -> list[str] | None:
        return self.names


def source(df: DataFrame, contract: Contract, raw: str | None, nulls: str = "absent", closed_columns: bool = False) -> Value:
    """The record of each row: the table's columns, or the VARIANT or struct column ``raw``.

    With ``closed_columns``, columns that the contract does not declare count as unknown keys.
    """
    if raw is None:
        declared = {f.name for f in contract.fields}
        return Columns(df, contract, nulls, tuple(c for c in df.columns if c not in declared) if closed_columns else ())
    kind = df.schema[raw].dataType
    if isinstance(kind, T.VariantType):
        return VariantValue(sql.name(raw))
    if isinstance(kind, (T.StructType, T.MapType)):
        return TypedValue(sql.name(raw), kind, nulls == "explicit")
    raise TypeError(f"{raw} holds {kind.simpleString()}; a record is a VARIANT, a struct or a map")


def _guarded(at: Scope, record: Value, checks: list[Check]) -> list[Check]:
    """Checks behind one for rows that hold no record at all."""
    if isinstance(record, Columns):
        return checks
    whole = at.keep(record.is_object(at))
    root = Check.one(f"NOT {whole}", (), f"concat('TYPE_MISMATCH(declared type,', {record.kind_text()}, ')')", "'record has an incorrect type'")
    return [root, *(c.when(whole) for c in checks)]


def _results(table: Table, record: Record, checks: list[Check], names: Results) -> dict[str, str]:
    """The three result columns; valid rows build no array."""
    valid = table.keep(f"NOT ({any_fails(checks)})")
    return {
        names.value: f"CASE WHEN {valid} THEN {record.value} END",
        names.is_valid: valid,
        names.violations: f"CASE WHEN {valid} THEN {NONE} ELSE {collected(checks)} END",
    }


def validate(df: DataFrame, contract: Contract, raw: str | None = None, *, nulls: str = "absent", options: Options = Options(), closed_columns: bool = False, names: Results = Results()) -> DataFrame:
    """``df`` with the decoded record, validity, violations, and extras of open contracts.

    The record is NULL, and extras are empty, where there are violations.
    """
    table, value = Table(df), source(df, contract, raw, nulls, closed_columns)
    record = Compiler(table, options).record(table, value, contract)
    out: dict[str, str | Column] = dict(_results(table, record, _guarded(table, value, record.checks), names))
    if contract.open:
        out[names.extras] = F.when(F.col(out[names.is_valid]), extras_of(df, contract, raw)).otherwise(F.create_map().cast("map<string,variant>"))
    return table.selected(out)


def with_validity(df: DataFrame, contract: Contract, raw: str | None = None, *, nulls: str = "absent", options: Options = Options(), closed_columns: bool = False, name: str = "is_valid") -> DataFrame:
    """``df`` with only the validity of each row, from the same conditions."""
    table, value = Table(df), source(df, contract, raw, nulls, closed_columns)
    record = Compiler(table, options).record(table, value, contract)
    return table.selected({name: f"NOT ({any_fails(_guarded(table, value, record.checks))})"})


def extras_of(df: DataFrame, contract: Contract, raw: str | None = None) -> Column:
    """Undeclared members of each record, as a map of VARIANTs."""
    declared = [f.name for f in contract.fields]
    if raw is not None and isinstance(df.schema[raw].dataType, T.VariantType):
        return extra_fields(F.col(f"`{raw}`"), declared)
    fields = df.schema.fields if raw is None else df.schema[raw].dataType.fields
    at = (lambda n: F.col(f"`{n}`")) if raw is None else (lambda n: F.col(f"`{raw}`").getField(n))
    pairs = [x for f in fields if f.name not in declared for x in (F.lit(f.name), _variant(at(f.name), f.dataType))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,variant>")


def _variant(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.VariantType):
        return c
    return F.to_variant_object(c) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else c.cast("variant")


def validate_partial(df: DataFrame, contract: Contract, raw: str, *, options: Options = Options(), names: Results = Results()) -> DataFrame:
    """Validation without missing fields and rules; ``draft`` keeps the declared members as given.

    A null on a field that is not optional is a mismatch, as anywhere else.
    """
    table, value = Table(df), source(df, contract, raw)
    record = Compiler(table, options).record(table, value, contract, partial=True)
    out = _results(table, record, _guarded(table, value, record.checks), names)
    del out[names.value]
    declared = F.array(*[F.lit(f.name) for f in contract.fields])
    draft = as_record(F.map_filter(as_map(F.col(sql.name(raw))), lambda k, _: F.array_contains(declared, k)))
    return table.selected({names.draft: F.when(F.col(out[names.is_valid]), draft), **out})


def validate_patch(df: DataFrame, contract: Contract, current: str, patch: str, *, options: Options = Options(), names: Results = Results()) -> DataFrame:
    """A partial update in ``patch`` checked against the stored record in ``current``.

    ``value`` is the merged record.  Both are VARIANT, struct or map columns.
    """
    table, given = Table(df), source(df, contract, patch)
    record = Compiler(table, options).patch(table, source(df, contract, current), given, contract)
    out: dict[str, str | Column] = dict(_results(table, record, _guarded(table, given, record.checks), names))
    if contract.open:
        whole = deep_merge(F.col(sql.name(current)), F.col(sql.name(patch)))
        out[names.extras] = F.when(F.col(out[names.is_valid]), extra_fields(whole, [f.name for f in contract.fields])).otherwise(F.create_map().cast("map<string,variant>"))
    return table.selected(out)


def validate_aspect_patch(df: DataFrame, contract: Contract, aspect: Contract, current: str, patch: str, *, options: Options = Options(), names: Results = Results()) -> DataFrame:
    """A patch that is first a valid record of an aspect, whose nulls then count as absent.

    Where the aspect finds violations, those are reported and the contract is not consulted.
    """
    if not aspect.is_aspect_of(contract):
        raise ValueError(f"{aspect.name} is no aspect of {contract.name}")
    table, own = Table(df), source(df, aspect, patch)
    compiler = Compiler(table, options)
    first = _guarded(table, own, compiler.record(table, own, aspect).checks)
    good = table.keep(f"NOT ({any_fails(first)})")
    given = table.apply(lambda c: as_record(F.map_filter(as_map(c), lambda _, v: ~F.is_variant_null(v))), sql.name(patch))
    record = compiler.patch(table, source(df, contract, current), VariantValue(given), contract)
    then = _results(table, record, record.checks, names)
    valid = table.keep(f"{good} AND {then[names.is_valid]}")
    found = f"CASE WHEN {good} THEN {then[names.violations]} ELSE {collected(first)} END"
    return table.selected({names.value: f"CASE WHEN {valid} THEN {record.value} END", names.is_valid: valid, names.violations: found})
