"""Views: an ordered list of omissions, masks and computed columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipule.plans.contract import Contract
from stipule.plans.patch import literal


@dataclass(frozen=True)
class Omit:
    name: str


@dataclass(frozen=True)
class Mask:
    name: str
    text: str = "***"


@dataclass(frozen=True)
class Compute:
    """``make`` gets a function from names to columns of the record so far."""

    name: str
    make: Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class View:
    """An immutable sequence of steps, applied in order."""

    steps: tuple[Any, ...] = ()
    contract: Contract | None = None

    @classmethod
    def empty(cls, contract: Contract | None = None) -> View:
        return cls((), contract)

    of = empty

    def _plus(self, step: Any, checked: bool = True) -> View:
        if checked and self.contract is not None:
            self.contract.field(step.name)
        return View((*self.steps, step), self.contract)

    def omit(self, name: str) -> View:
        """Remove a field; nothing happens where it is absent."""
        return self._plus(Omit(name))

    def mask(self, name: str, text: str = "***") -> View:
        """Replace a field by a text where it is present."""
        return self._plus(Mask(name, text))

    def compute(self, name: str, make: Callable[[Callable[[str], Column]], Column]) -> View:
        """Add or replace a field from the record as the steps before left it."""
        return self._plus(Compute(name, make), checked=False)

    def size(self) -> int:
        return len(self.steps)

    def is_empty(self) -> bool:
        return not self.steps

    def apply(self, df: DataFrame) -> DataFrame:
        """The view of a table: one projection a step, which Catalyst collapses."""
        return reduce(_table_step, self.steps, df)

    def apply_raw(self, record: Column) -> Column:
        """The view of a VARIANT record."""
        from stipule.operators.deltas import as_map, as_record

        return as_record(reduce(_record_step, self.steps, as_map(record)))


def _table_step(df: DataFrame, step: Any) -> DataFrame:
    if isinstance(step, Omit):
        return df.drop(step.name)
    if isinstance(step, Mask):
        return df.withColumn(step.name, F.lit(step.text)) if step.name in df.columns else df
    return df.withColumn(step.name, step.make(lambda n: F.col(f"`{n}`")))


def _record_step(m: Column, step: Any) -> Column:
    if isinstance(step, Omit):
        return F.map_filter(m, lambda k, _: k != step.name)
    if isinstance(step, Mask):
        return F.transform_values(m, lambda k, v: F.when(k == step.name, literal(step.text)).otherwise(v))
    made = F.create_map(F.lit(step.name), step.make(lambda n: F.try_element_at(m, F.lit(n))).cast("variant"))
    return F.map_concat(F.map_filter(m, lambda k, _: k != step.name), made)
