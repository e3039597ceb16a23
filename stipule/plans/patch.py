"""Patches: constants and functions of the current value, by field."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from stipule.plans.contract import Contract


@dataclass(frozen=True)
class Patch:
    """An immutable set of changes; a constant wins over a function of the same field."""

    fields: Mapping[str, Any] = field(default_factory=dict)
    modifiers: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)
    contract: Contract | None = None

    @classmethod
    def empty(cls, contract: Contract | None = None) -> Patch:
        return cls({}, {}, contract)

    @classmethod
    def from_raw(cls, raw: Mapping[str, Any], contract: Contract | None = None) -> Patch:
        """A patch of constants; names are not checked."""
        return cls(dict(raw), {}, contract)

    def _checked(self, name: str) -> str:
        if self.contract is not None:
            self.contract.field(name)
        return name

    def set(self, name: str, value: Any) -> Patch:
        """Set a field."""
        return Patch({**self.fields, self._checked(name): value}, self.modifiers, self.contract)

    def unset(self, name: str) -> Patch:
        """Set a field to an explicit null."""
        return self.set(name, None)

    def modify(self, name: str, change: Callable[[Column], Column]) -> Patch:
        """Set a field to a function of its current value, where there is one."""
        return Patch(self.fields, {**self.modifiers, self._checked(name): change}, self.contract)

    def put_all(self, values: Mapping[str, Any]) -> Patch:
        """Set several fields; names are not checked."""
        return Patch({**self.fields, **values}, self.modifiers, self.contract)

    def to_raw(self) -> dict[str, Any]:
        """The constants only."""
        return dict(self.fields)

    to_map = to_raw

    def size(self) -> int:
        return len({*self.fields, *self.modifiers})

    def is_empty(self) -> bool:
        return not self.size()

    def delta(self, current: Callable[[str], Column], present: Callable[[str], Column]) -> Column:
        """The changes as a map of VARIANTs: modifiers of present fields, then constants."""
        changed = F.create_map().cast("map<string,variant>")
        for name, change in self.modifiers.items():
            if name not in self.fields:
                one = F.create_map(F.lit(name), change(current(name)).cast("variant"))
                changed = F.map_concat(changed, F.when(present(name), one).otherwise(F.create_map().cast("map<string,variant>")))
        for name, value in self.fields.items():
            changed = F.map_concat(changed, F.create_map(F.lit(name), literal(value)))
        return changed


def literal(value: Any) -> Column:
    """A constant as a VARIANT; None is a JSON null."""
    import json

    if isinstance(value, Column):
        return value.cast("variant")
    if value is None or isinstance(value, (dict, list, tuple, bool)):
        return F.parse_json(F.lit(json.dumps(value)))
    return F.lit(value).cast("variant")
