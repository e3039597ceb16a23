"""Sanitizing, flattening, and records back to raw form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stipule.functions import sql
from stipule.functions.text import json_text, pretty_json, variant_json
from stipule.functions.values import struct_of
from stipule.operators.deltas import as_list, as_map, as_record, is_record, text_of
from stipule.plans import types as D
from stipule.plans.contract import Contract, Field
from stipule.plans.patch import literal


def sanitize(df: DataFrame, contract: Contract) -> DataFrame:
    """Drop internal columns, mask masked ones, and do the same within nested records.

    Other columns pass through.  Masked columns become text.
    """
    out = []
    for c in df.schema.fields:
        f = _field(contract, c.name)
        if f is None:
            out.append(F.col(f"`{c.name}`"))
        elif not f.internal:
            out.append((F.lit(f.masked) if f.masked is not None else _typed(F.col(f"`{c.name}`"), c.dataType, f)).alias(c.name))
    return df.select(*out)


def _field(contract: Contract, name: str) -> Field | None:
    return next((f for f in contract.fields if f.name == name), None)


def _typed(c: Column, kind: T.DataType, f: Field) -> Column:
    nested = f.type.core()
    if isinstance(nested, D.Either) and isinstance(kind, T.StructType):
        for side, branch in (("left", nested.left.core()), ("right", nested.right.core())):
            if isinstance(branch, D.Nested) and side in kind.names:
                c = c.withField(side, clean_struct(c.getField(side), kind[side].dataType, branch.contract))
        return c
    if f.nested is None:
        return c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: clean_struct(x, kind.elementType, f.nested))
    return clean_struct(c, kind, f.nested)


def clean_struct(c: Column, kind: T.DataType, contract: Contract) -> Column:
    """A struct without internal members and with masked ones replaced; NULL stays NULL."""
    if not isinstance(kind, T.StructType):
        return c
    members = []
    for m in kind.fields:
        f = _field(contract, m.name)
        if f is None or not f.internal:
            held = c.getField(m.name)
            members.append((held if f is None else F.lit(f.masked) if f.masked is not None else _typed(held, m.dataType, f)).alias(m.name))
    return F.when(c.isNotNull(), F.struct(*members))


def sanitize_raw(record: Column, contract: Contract, tagged: bool = True) -> Column:
    """The same for VARIANT records: keys are judged where present, even when null.

    ``tagged`` also cleans the branches of tagged unions, and a value whose tag
    names no branch by all of them; without it their sensitive members pass
    through, as they do in other implementations.
    """
    hidden = [f.name for f in contract.fields if f.internal]
    kept = F.map_filter(as_map(record), lambda k, _: ~k.isin(*hidden)) if hidden else as_map(record)

    def clean(k: Column, v: Column) -> Column:
        out = v
        for f in reversed(contract.fields):
            new = literal(f.masked) if f.masked is not None else _raw(v, f, tagged)
            if new is not None:
                out = F.when(k == f.name, new).otherwise(out)
        return out

    return as_record(F.transform_values(kept, clean))


def _raw(v: Column, f: Field, tagged: bool) -> Column | None:
    """A nested value cleaned, or None where there is nothing to clean."""
    kind = f.type.core()
    member = lambda name: F.try_element_at(as_map(v), F.lit(name))
    if isinstance(kind, D.Nested):
        return F.when(is_record(v), sanitize_raw(v, kind.contract, tagged)).otherwise(v)
    if isinstance(kind, D.ListOf) and f.nested is not None:
        each = lambda x: F.when(is_record(x), sanitize_raw(x, f.nested, tagged)).otherwise(x)
        return F.when(as_list(v).isNotNull(), F.to_variant_object(F.transform(as_list(v), each))).otherwise(v)
    if not isinstance(kind, D.Either):
        return None
    sides = (("left", kind.left.core(), kind.left_tag), ("right", kind.right.core(), kind.right_tag))
    out = v
    if kind.key is not None and tagged:
        # A tag of no branch does not tell which members are sensitive, so those of every branch count.
        for _, branch, _ in sides:
            out = sanitize_raw(out, branch.contract, tagged) if isinstance(branch, D.Nested) else out
        out = F.when(is_record(v), out).otherwise(v)
    for side, branch, tag in sides:
        if kind.key is None and not isinstance(branch, D.Nested):
            continue
        if kind.key is None:
            out = F.when(member(side).isNotNull(), _side_cleaned(v, side, branch.contract, tagged)).otherwise(out)
        elif tagged:
            is_side = F.coalesce(text_of(member(kind.key)) == tag, F.lit(False))
            out = F.when(is_side, sanitize_raw(v, branch.contract, tagged) if isinstance(branch, D.Nested) else v).otherwise(out)
    return out


def _side_cleaned(v: Column, side: str, contract: Contract, tagged: bool) -> Column:
    def clean(k: Column, x: Column) -> Column:
        return F.when((k == side) & is_record(x), sanitize_raw(x, contract, tagged)).otherwise(x)

    return as_record(F.transform_values(as_map(v), clean))


def flatten(df: DataFrame, contract: Contract, record: str = "value") -> DataFrame:
    """A decoded record's fields as columns, included contracts at the same level."""
    at = F.col(f"`{record}`")
    cols = []
    for f in contract.declared:
        inner = f.type.contract.declared if f.include else ()
        cols += [at.getField(f.name).getField(g.name).alias(g.name) for g in inner] if f.include else [at.getField(f.name).alias(f.name)]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != record], *cols)


def rebuild(df: DataFrame, contract: Contract, record: str = "value") -> DataFrame:
    """The inverse of :func:`flatten`: wire-level columns back into one struct."""
    names = {f.name for f in contract.fields}
    whole = F.expr(struct_of(contract, lambda f: sql.name(f.name)))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], whole.alias(record))


def to_raw(record: Column, contract: Contract, drop_nulls: bool = True) -> Column:
    """A decoded record as a VARIANT at wire level: includes flat, unions enveloped or tagged.

    NULL members are dropped, or kept as JSON nulls.
    """
    pairs = []
    for f in contract.declared:
        if f.include:
            pairs += [(g, record.getField(f.name).getField(g.name)) for g in f.type.contract.declared]
        else:
            pairs.append((f, record.getField(f.name)))
    null = F.parse_json(F.lit("null"))
    entries = F.array(*[F.struct(F.lit(f.name).alias("key"), _wire(c, f.type.core(), drop_nulls).alias("value")) for f, c in pairs])
    if drop_nulls:
        entries = F.filter(entries, lambda e: e["value"].isNotNull())
    else:
        entries = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["value"], null).alias("value")))
    return F.when(record.isNotNull(), as_record(F.map_from_entries(entries)))


def to_patch_raw(record: Column, contract: Contract) -> Column:
    """A decoded record as a patch: what is NULL is not set."""
    return to_raw(record, contract)


def _wire(c: Column, kind: D.DeclaredType, drop_nulls: bool) -> Column:
    if isinstance(kind, D.Nested):
        return to_raw(c, kind.contract, drop_nulls)
    if isinstance(kind, D.ListOf):
        return F.when(c.isNotNull(), F.to_variant_object(F.transform(c, lambda x: _wire(x, kind.item.core(), drop_nulls))))
    if isinstance(kind, D.MapOf):
        return F.when(c.isNotNull(), as_record(F.transform_values(c, lambda _, x: _wire(x, kind.value.core(), drop_nulls))))
    if isinstance(kind, D.Either):
        return _wire_either(c, kind, drop_nulls)
    if isinstance(kind, (D.Extract,)):
        return F.when(c.isNotNull(), F.to_variant_object(c))
    return c.cast("variant")


def _wire_either(c: Column, kind: D.Either, drop_nulls: bool) -> Column:
    out = F.lit(None).cast("variant")
    for side, branch, tag in (("left", kind.left.core(), kind.left_tag), ("right", kind.right.core(), kind.right_tag)):
        held = c.getField(side)
        body = _wire(held, branch, drop_nulls)
        if kind.key is None:
            shown = as_record(F.create_map(F.lit(side), body))
        else:
            inner = as_map(body) if isinstance(branch, D.Nested) else F.create_map(F.lit("value"), body)
            shown = as_record(F.map_concat(F.map_filter(inner, lambda k, _: k != kind.key), F.create_map(F.lit(kind.key), literal(tag))))
        out = F.when(held.isNotNull(), shown).otherwise(out)
    return out


def to_json(df: DataFrame, record: str, indent: int = 0) -> Column:
    """Canonical JSON of a struct column, built natively from its type; laid out where ``indent`` is given."""
    out = json_text(F.col(f"`{record}`"), df.schema[record].dataType)
    return pretty_json(out, indent) if indent else out


def raw_to_json(record: Column, indent: int = 0) -> Column:
    """Canonical JSON of a VARIANT whose shape no contract tells."""
    return variant_json(record, indent)


def sanitize_json(df: DataFrame, contract: Contract, raw: str | None = None, indent: int = 0) -> Column:
    """Canonical JSON of sanitized records: of the declared and other columns, or of ``raw``."""
    if raw is not None:
        return raw_to_json(sanitize_raw(F.col(f"`{raw}`"), contract), indent)
    clean = sanitize(df, contract)
    members = []
    for c in clean.schema.fields:
        f = _field(contract, c.name)
        held = F.lit(f.masked) if f is not None and f.masked is not None else F.col(f"`{c.name}`")
        members.append((held if f is None or f.masked is not None else _typed(held, df.schema[c.name].dataType, f)).alias(c.name))
    out = json_text(F.struct(*members), clean.schema)
    return pretty_json(out, indent) if indent else out
