"""JSON Schema (draft-07) of a contract."""

from __future__ import annotations

import json
from typing import Any

from stipule.plans.contract import Contract, Field
from stipule.plans.types import ListOf, Nested, Scalar, json_name

DRAFT = "http://json-schema.org/draft-07/schema#"
#: Keyword of each constraint that takes its argument, and fixed keywords of those without one.
VALUED = {"min_length": "minLength", "max_length": "maxLength", "min": "minimum", "max": "maximum", "pattern": "pattern", "extract": "pattern", "multiple_of": "multipleOf"}
FLAGS: dict[str, dict[str, Any]] = {
    "email": {"format": "email"}, "url": {"format": "uri"}, "uuid": {"format": "uuid"},
    "future": {"x-future": True}, "past": {"x-past": True}, "positive": {"exclusiveMinimum": 0},
}


def json_schema(contract: Contract) -> dict[str, Any]:
    """Properties, required names unless none, and no further properties where closed."""
    out: dict[str, Any] = {"$schema": DRAFT, "type": "object", "properties": {f.name: field_schema(f) for f in contract.fields}}
    if required := [f.name for f in contract.fields if f.required]:
        out["required"] = required
    if not contract.open:
        out["additionalProperties"] = False
    return out


def json_schema_text(contract: Contract, indent: int | None = None) -> str:
    """The schema as text with sorted keys."""
    return json.dumps(json_schema(contract), sort_keys=True, indent=indent, ensure_ascii=False, separators=None if indent else (",", ":"))


def _shape(f: Field) -> dict[str, Any]:
    kind, name = f.type.core(), json_name(f.type)
    if name == "any" or (f.optional and isinstance(kind, ListOf)):
        return {}
    if isinstance(kind, Nested):
        return _inner(kind.contract)
    if isinstance(kind, ListOf):
        item = kind.item.core()
        inner = _inner(item.contract) if isinstance(item, Nested) else {"type": item.json} if isinstance(item, Scalar) else {}
        return {"type": "array", "items": inner} if inner else {"type": "array"}
    return {"type": name}


def _inner(contract: Contract) -> dict[str, Any]:
    return {k: v for k, v in json_schema(contract).items() if k != "$schema"}


def field_schema(f: Field) -> dict[str, Any]:
    """One property: its shape, its constraints and its policies."""
    out = _shape(f)
    array = out.get("type") == "array"
    for name, keyword in VALUED.items():
        if (value := getattr(f, name)) is not None:
            out[keyword] = value
    for name, extra in FLAGS.items():
        if getattr(f, name):
            out |= extra
    if f.non_empty:
        if array:
            out["minItems"] = 1
        elif f.min_length is None or f.min_length < 1:
            out["minLength"] = 1
    for policy in ("immutable", "internal", "reserved"):
        if getattr(f, policy):
            out[f"x-{policy}"] = True
    if f.masked is not None:
        out["x-masked"] = f.masked
    return out
