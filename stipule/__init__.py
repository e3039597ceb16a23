"""Data contracts for Spark: declare fields once, run them as Column expressions.

The engine turns immutable Python descriptors into DataFrame plans.  Nothing in
the core path leaves the JVM, so Catalyst prunes, pushes down and generates code
for validation, patching, sanitizing and filtering alike, in batch or streams.
"""

from stipule.plans.contract import MISSING, Contract, Field, Rule
from stipule.plans.filters import Filter
from stipule.plans.patch import Patch
from stipule.plans.types import (
    BigDecimal,
    BigInt,
    Boolean,
    Custom,
    Double,
    Either,
    Extract,
    Float,
    Int,
    ListOf,
    Long,
    MapOf,
    Nested,
    SetOf,
    String,
    Wrapper,
)
from stipule.plans.view import View

__all__ = [
    "MISSING", "BigDecimal", "BigInt", "Boolean", "Contract", "Custom", "Double", "Either", "Extract", "Field", "Filter",
    "Float", "Int", "ListOf", "Long", "MapOf", "Nested", "Patch", "Rule", "SetOf", "String", "View", "Wrapper",
]
