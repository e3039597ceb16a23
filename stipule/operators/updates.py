"""Patches and drafts applied to stored records, and reports of what was wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipule.functions import sql
from stipule.functions.scopes import Inline
from stipule.functions.values import VariantValue, decoded_column, member
from stipule.operators.compiler import Options
from stipule.operators.deltas import as_map, as_record
from stipule.operators.validate import Results, validate, validate_patch
from stipule.plans.contract import Contract
from stipule.plans.patch import Patch


def apply_to(raw: str, patch: Patch, contract: Contract | None = None) -> Column:
    """The VARIANT records of a column with a patch laid over them; nothing is checked."""
    return as_record(_overlaid(as_map(F.col(sql.name(raw))), _delta(raw, patch, contract)))


def _delta(raw: str, patch: Patch, contract: Contract | None) -> Column:
    contract, record = contract or patch.contract, VariantValue(sql.name(raw))

    def current(name: str) -> Column:
        return decoded_column(member(record, contract.field(name)), contract.field(name)) if contract is not None else F.expr(record.member(name).whole())

    return patch.delta(current, lambda name: F.expr(f"NOT {record.member(name, True).absent(Inline())}"))


def apply_patch(df: DataFrame, contract: Contract, patch: Patch, raw: str, *, options: Options = Options(), names: Results = Results()) -> DataFrame:
    """Apply a patch to each stored VARIANT record and validate only what changed.

    A constant equal to the stored value is no change.
    """
    before, delta = as_map(F.col(sql.name(raw))), _delta(raw, patch, contract)
    same = lambda k, v: F.to_json(F.try_element_at(before, k)).eqNullSafe(F.to_json(v))
    changed = as_record(F.map_filter(delta, lambda k, v: ~(F.map_contains_key(before, k) & same(k, v))))
    return validate_patch(df.withColumn("_patch", changed), contract, raw, "_patch", options=options, names=names).drop("_patch")


def patch_join(current: DataFrame, patches: DataFrame, contract: Contract, key: str, *, raw: str = "raw", patch: str = "patch", order: str | None = None, options: Options = Options()) -> DataFrame:
    """Stored records joined with their patches by key and validated; rows without a patch pass.

    With ``order``, of several patches for a key the one of greatest order is
    taken, and of those the one of greatest JSON text, reduced before the shuffle;
    without it, keys of ``patches`` must be unique.
    """
    given = patches.select(key, F.col(sql.name(patch)).alias("_patch"), *([F.col(sql.name(order)).alias("_order")] if order else []))
    if order is not None:
        given = given.groupBy(key).agg(F.max_by("_patch", F.struct("_order", F.to_json("_patch"))).alias("_patch"))
    joined = current.join(given, key, "left")
    filled = joined.withColumn("_patch", F.coalesce("_patch", F.parse_json(F.lit("{}"))))
    return validate_patch(filled, contract, raw, "_patch", options=options).drop("_patch")


def merge_drafts(*drafts: Column) -> Column:
    """Drafts merged from left to right; later ones win, NULL drafts add nothing."""
    out = F.create_map().cast("map<string,variant>")
    for d in drafts:
        new = F.coalesce(as_map(d), F.create_map().cast("map<string,variant>"))
        out = _overlaid(out, new)
    return as_record(out)


def _overlaid(old: Column, new: Column) -> Column:
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def finalize(df: DataFrame, contract: Contract, draft: str = "draft", *, options: Options = Options()) -> DataFrame:
    """Full validation of accumulated drafts, which keep members as they were given."""
    return validate(df, contract, draft, options=options)


def draft_size(draft: Column) -> Column:
    """Number of fields in a draft."""
    return F.coalesce(F.size(as_map(draft)), F.lit(0))


def violation_rows(df: DataFrame, key: str, violations: str = "violations") -> DataFrame:
    """One row for each violation: key, dotted path, code and message."""
    one = df.select(F.col(key), F.explode(violations).alias("v"))
    return one.select(key, F.array_join("v.path", ".").alias("path"), F.col("v.code").alias("code"), F.col("v.message").alias("message"))


def violation_report(df: DataFrame, violations: str = "violations") -> DataFrame:
    """Counts of violations by path and code."""
    one = df.select(F.explode(violations).alias("v"))
    return one.groupBy(F.array_join("v.path", ".").alias("path"), F.col("v.code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def quarantine(df: DataFrame, is_valid: str = "is_valid") -> tuple[DataFrame, DataFrame]:
    """The valid rows and the others."""
    return df.where(F.col(is_valid)), df.where(~F.col(is_valid))
