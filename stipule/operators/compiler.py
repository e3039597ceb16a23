"""Compiles contracts to checks and value texts: whole records, parts, and patches.

Results that several others use are named in a scope, so the compiled plan is
linear in the number of fields, whatever the nesting.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column

from stipule.functions import sql
from stipule.functions.checks import constraints
from stipule.functions.scopes import Elements, Scope, Table
from stipule.functions.values import TypedValue, Value, VariantValue, decode, filled, listed, member, struct_of
from stipule.operators.deltas import deep_merge
from stipule.operators.violations import NONE, Check, any_fails, collected, violation
from stipule.plans import types as D
from stipule.plans.contract import Contract, Field


@dataclass(frozen=True)
class Options:
    """How to compile: decoder family, fixed clock, and documented oddities."""

    jvm: bool = False
    now: Column | None = None
    strict_reference: bool = False


@dataclass(frozen=True)
class Record:
    """A compiled record: its checks, and its decoded struct, whether or not they pass."""

    checks: list[Check]
    value: str


class Compiler:
    """Compiles within the rows of one table."""

    def __init__(self, table: Table, opt: Options) -> None:
        self.table, self.opt = table, opt
        self.lists: dict[tuple, str] = {}

    # Records ------------------------------------------------------------------

    def record(self, at: Scope, value: Value, contract: Contract, partial: bool = False) -> Record:
        """A record: unknown keys, then each field, then rules if all fields pass."""
        checks, held = self.unknown_keys(at, value, contract), {}
        for f in contract.fields:
            m = member(value, f)
            got, found = self.field(at, m, f, partial)
            checks += found
            held[f.name] = filled(at, m, f, got)
        shown = struct_of(contract, lambda f: held[f.name])
        if partial or not contract.rules:
            return Record(checks, shown)
        shown = at.keep(shown)
        return Record(checks + self.rules(at, shown, contract, value.path, checks), shown)

    def rules(self, at: Scope, record: str, contract: Contract, path: tuple[str, ...], checks: list[Check]) -> list[Check]:
        """Cross-field rules over the decoded record, where ``checks`` pass; NULL passes."""
        if not contract.rules:
            return []
        fine = at.keep(f"NOT ({any_fails(checks)})")
        held = [at.apply(r.holds, record) for r in contract.rules]
        return [Check.one(f"{fine} AND NOT coalesce({h}, TRUE)", path, "'CONSTRAINT(validateContract)'", sql.text(r.message)) for h, r in zip(held, contract.rules, strict=True)]

    def unknown_keys(self, at: Scope, value: Value, contract: Contract, patch: bool = False) -> list[Check]:
        """One violation for each undeclared key, in key order, where the contract is closed."""
        if contract.open:
            return []
        names = [f.name for f in contract.fields]
        tail = "'" if patch else "' (contract is closed)"
        one = lambda k, there: Check.one(there, (*value.path, sql.text(k)), "'UNKNOWN_FIELD'", sql.text(f"Unknown field '{k}{tail}"))
        if (fixed := value.fixed_keys()) is not None:
            return [one(k, "TRUE") for k in sorted(set(fixed) - set(names))]
        if isinstance(value, TypedValue) and hasattr(value.type, "names"):
            return [one(k, f"NOT {value.member(k).absent(at)}") for k in sorted(set(value.type.names) - set(names))]
        extra = at.keep(f"array_sort(array_except({value.keys(at)}, {sql.array(map(sql.text, names))}))")
        k = self.table.variable()
        said = f"concat({sql.text('Unknown field ' + chr(39))}, {k}, {sql.text(tail)})"
        return [Check(f"coalesce(size({extra}) > 0, FALSE)", f"transform({extra}, {k} -> {violation((*value.path, k), "'UNKNOWN_FIELD'", said)})")]

    # Fields -------------------------------------------------------------------

    def field(self, at: Scope, m: Value, f: Field, partial: bool = False) -> tuple[str, list[Check]]:
        """A field's decoded value and its checks: missing, reserved, mismatch, else its content."""
        out: list[Check] = []
        if f.required and not partial:
            out.append(Check.one(m.absent(at), m.path, "'MISSING'", sql.text(f"'{f.name}' is required")))
        got, inner = self.decoded(at, m, f.type)
        if f.reserved:
            out.append(Check.one(f"NOT {m.absent(at)}", m.path, "'RESERVED'", sql.text(f"'{f.name}' is reserved and cannot be set")))
            return got, out
        if not (isinstance(m, TypedValue) and m.is_total(f.type.core())):
            out.append(self.mismatch(m, f"{self.there(at, m, f)} AND {got} IS NULL", f"'{f.name}' has an incorrect type"))
        return got, out + self.content(at, m, f, got, inner)

    def there(self, at: Scope, m: Value, f: Field) -> str:
        """Whether a field has something to decode: a null where it is optional has not."""
        return f"NOT {m.absent(at)}" + (f" AND NOT {m.null(at)}" if f.optional else "")

    def mismatch(self, m: Value, fails: str, message: str) -> Check:
        """A value that does not decode."""
        return Check.one(fails, m.path, f"concat('TYPE_MISMATCH(declared type,', {m.kind_text()}, ')')", sql.text(message))

    def decoded(self, at: Scope, m: Value, kind: D.DeclaredType) -> tuple[str, list[Check]]:
        """A decoded value (NULL where there is none) and the checks of records within it."""
        kind = kind.core()
        if isinstance(kind, D.Nested):
            inner = self.record(at, m, kind.contract)
            gate = at.keep(m.is_object(at))
            return at.keep(f"CASE WHEN {gate} THEN {inner.value} END"), [c.when(gate) for c in inner.checks]
        if isinstance(kind, D.ListOf) and isinstance(kind.item.core(), D.Nested) and m.elements() is not None:
            column = self.elements(at, m, kind.item.core().contract)
            x = self.table.variable()
            got = listed(at, at.keep(f"transform({column}, {x} -> {x}.value)"), kind, self.opt.jvm)
            fails = f"{got} IS NOT NULL AND coalesce(exists({column}, {x} -> {x}.bad), FALSE)"
            return got, [Check(fails, f"flatten(transform({column}, {x} -> {x}.found))")]
        return decode(at, m, kind, self.opt.jvm), []

    def elements(self, at: Scope, m: Value, contract: Contract) -> str:
        """The compiled records of a list: an array of ``value``, ``bad`` and ``found``."""
        key = (id(at), m.elements(), contract.name, id(contract), m.path)
        if key not in self.lists:
            scope = Elements(at, m.elements())
            path = (*m.path, f"CAST({scope.at} AS STRING)")
            value = m.element(scope.element, path)
            inner = self.record(scope, value, contract)
            gate = scope.keep(value.is_object(scope))
            bad = scope.keep(f"{gate} AND ({any_fails(inner.checks)})")
            out = {"value": f"CASE WHEN {gate} THEN {inner.value} END", "bad": bad, "found": f"CASE WHEN {bad} THEN {collected(inner.checks)} ELSE {NONE} END"}
            self.lists[key] = scope.closed(out)
        return self.lists[key] + at.index()

    def content(self, at: Scope, m: Value, f: Field, got: str, inner: list[Check]) -> list[Check]:
        """Constraints, validators and nested checks of a value that decodes."""
        out = [Check.one(c.fails, m.path, sql.text(f"CONSTRAINT({c.name})"), c.message) for c in constraints(at, f, got, self.opt.now, self.opt.strict_reference)]
        for validator in f.validators:
            said = at.keep(f"CASE WHEN {got} IS NOT NULL THEN {at.apply(validator, at.keep(got))} END")
            x = self.table.variable()
            out.append(Check(f"coalesce(size({said}) > 0, FALSE)", f"transform({said}, {x} -> {violation(m.path, "'CONSTRAINT(validateWith)'", x)})"))
        return out + inner

    # Patches ------------------------------------------------------------------

    def patch(self, at: Scope, current: Value, patch: Value, contract: Contract) -> Record:
        """Checks of a partial update against stored state, and the merged record.

        Only what the patch sets is checked; stored fields are decoded and trusted.
        Nested records are patched in turn, so their own policies hold.
        """
        out = self.unknown_keys(at, patch, contract, patch=True)
        merged: dict[str, str] = {}
        for f in contract.fields:
            p, c = member(patch, f), member(current, f)
            stored = self.decoded(at, c, f.type)[0]
            held = filled(at, c, f, stored)
            if f.immutable or f.reserved:
                code, said = ("IMMUTABLE", "is immutable and cannot be changed") if f.immutable else ("RESERVED", "is reserved and cannot be set")
                out.append(Check.one(f"NOT {p.absent(at)}", p.path, f"'{code}'", sql.text(f"'{f.name}' {said}")))
                merged[f.name] = held
            else:
                value, checks = self._patched(at, c, p, f)
                out += checks
                merged[f.name] = f"CASE WHEN {p.absent(at)} THEN {held} ELSE {value} END"
            wrong = f"{p.absent(at)} AND {self.there(at, c, f)} AND {stored} IS NULL"
            out.append(self.mismatch(c, wrong, f"'{f.name}' in current record has an unexpected type"))
            if f.required:
                out.append(Check.one(f"{p.absent(at)} AND {c.absent(at)}", p.path, "'MISSING'", sql.text(f"'{f.name}' is required")))
        shown = struct_of(contract, lambda f: merged[f.name])
        if contract.rules:
            shown = at.keep(shown)
        return Record(out + self.rules(at, shown, contract, patch.path, out), shown)

    def _patched(self, at: Scope, c: Value, p: Value, f: Field) -> tuple[str, list[Check]]:
        kind = f.type.core()
        if isinstance(kind, D.Nested):
            both = at.keep(f"{c.is_object(at)} AND {p.is_object(at)}")
            deep = self.patch(at, c, p, kind.contract)
            got, fresh = self.decoded(at, p, f.type)
            inner = [k.when(both) for k in deep.checks] + [k.when(f"NOT {both}") for k in fresh]
            return f"CASE WHEN {both} THEN {deep.value} ELSE {got} END", self._given(at, p, f, got, inner)
        effective = p
        if isinstance(p, VariantValue) and isinstance(c, VariantValue) and isinstance(kind, (D.MapOf, D.Either, D.Custom)):
            made = at.apply(deep_merge, at.keep(c.whole()), at.keep(p.whole()), key=f"merge {c.whole()} {p.whole()}")
            whole = at.keep(f"CASE WHEN {c.is_object(at)} AND {p.is_object(at)} THEN {made} ELSE {p.whole()} END")
            effective = VariantValue(whole, path=p.path)
        got, inner = self.decoded(at, effective, f.type)
        return got, self._given(at, effective, f, got, inner)

    def _given(self, at: Scope, value: Value, f: Field, got: str, inner: list[Check]) -> list[Check]:
        wrong = self.mismatch(value, f"{self.there(at, value, f)} AND {got} IS NULL", f"'{f.name}' has an incorrect type")
        return [wrong, *self.content(at, value, f, got, inner)]
