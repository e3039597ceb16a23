"""Map-level operators over VARIANT records: differences, deep merges, extra keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP = "map<string,variant>"
#: Levels that records merge to; deeper ones on both sides fail.
DEPTH = 24


def as_map(v: Column) -> Column:
    """A VARIANT record as a map; NULL where it is none."""
    return F.try_variant_get(v, "$", MAP)


def as_record(m: Column) -> Column:
    """A map of VARIANTs as a VARIANT record."""
    return F.to_variant_object(m)


def is_record(v: Column) -> Column:
    """Whether a VARIANT is a record."""
    return as_map(v).isNotNull()


def as_list(v: Column) -> Column:
    """A VARIANT list as an array; NULL where it is none."""
    return F.try_variant_get(v, "$", "array<variant>")


def text_of(v: Column) -> Column:
    """A VARIANT string; NULL where it is none."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def right_difference(base: Column, updated: Column) -> Column:
    """Entries of ``updated`` that are new or changed; shallow.

    VARIANT has no equality, so values compare by their JSON, which sorts keys.
    """
    before = as_map(base)
    same = lambda k, v: F.to_json(F.try_element_at(before, k)).eqNullSafe(F.to_json(v))
    return as_record(F.map_filter(as_map(updated), lambda k, v: ~F.coalesce(F.map_contains_key(before, k), F.lit(False)) | ~same(k, v)))


#: The same result under its other name.
difference_delta = right_difference


def deep_merge(base: Column, delta: Column, depth: int = DEPTH) -> Column:
    """``delta`` over ``base``: records merge, anything else is replaced, other base keys stay.

    Spark expressions cannot recurse, so records are merged to ``depth`` levels, at
    a cost that is linear in it.  Where both sides have records below that, the
    query fails, as replacing them would lose keys of ``base``.
    """

    def entry(_: Column, old: Column, new: Column) -> Column:
        both = is_record(old) & is_record(new)
        deeper = deep_merge(old, new, depth - 1) if depth > 1 else F.raise_error(F.lit("deep_merge: records on both sides nest deeper than its depth; raise it")).cast("variant")
        return F.when(new.isNull(), old).when(both, deeper).otherwise(new)

    return as_record(F.map_zip_with(as_map(base), as_map(delta), entry))


def extra_fields(v: Column, declared: Sequence[str]) -> Column:
    """Entries whose key is not declared, as a map; top level only."""
    names = [F.lit(n) for n in declared]
    known = F.array(*names) if names else F.array().cast("array<string>")
    return F.map_filter(as_map(v), lambda k, _: ~F.array_contains(known, k))


def without_nulls(v: Column) -> Column:
    """A record without its null members; top level only."""
    return as_record(F.map_filter(as_map(v), lambda _, x: ~F.is_variant_null(x)))
