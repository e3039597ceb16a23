"""Contracts over streams: the same columns, and state where records arrive in parts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stipule.functions.text import parsed
from stipule.operators.compiler import Options
from stipule.operators.updates import patch_join, quarantine
from stipule.operators.validate import validate
from stipule.plans.contract import Contract


def validated(stream: DataFrame, contract: Contract, raw: str | None = None, **how) -> DataFrame:
    """A stream of records with their results; row by row, so no state is kept."""
    return validate(stream, contract, raw, **how)


def quarantining(stream: DataFrame, good: str, bad: str, checkpoint: str) -> DataStreamWriter:
    """Validated rows to one Parquet folder and the others to another, batch by batch.

    A replayed batch overwrites its own folders, so files appear once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for rows, path in zip(quarantine(batch), (good, bad), strict=True):
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def patching(stream: DataFrame, contract: Contract, key: str, load: Callable[[SparkSession], DataFrame], save: Callable[[DataFrame, int], None], checkpoint: str, *, order: str, options: Options = Options()) -> DataStreamWriter:
    """Patches from a stream joined batch by batch with stored records.

    ``load`` gives the records, ``save`` takes the results of a batch with its number.
    """

    def merge(batch: DataFrame, number: int) -> None:
        save(patch_join(load(batch.sparkSession), batch, contract, key, order=order, options=options), number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def _kept(value: Any) -> str:
    """JSON text with explicit nulls and all digits of numbers."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_kept(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_kept, value)) + "]"
    return str(value) if isinstance(value, Decimal) else json.dumps(value, ensure_ascii=False)


def accumulated_drafts(stream: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Drafts merged for each key as their parts arrive: ``key, draft`` after each batch.

    ``text`` holds JSON records; later ones, by ``order`` and then their text within
    a batch, win.  The state of a key is its merged record.  Text that is no JSON
    record adds nothing; ``rejected`` counts those of a batch.
    """
    kind = stream.schema[key].dataType.simpleString()

    def merge(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, bad = parsed(state.get[0]) if state.exists else {}, 0
        for part in pd.concat(list(batches)).sort_values([order, text], kind="stable")[text]:
            try:
                one = parsed(part) if part else {}
            except ValueError:
                one = None
            if isinstance(one, dict):
                held |= one
            else:
                bad += 1
        shown = _kept(held)
        state.update((shown,))
        yield pd.DataFrame({key: [k[0]], "draft": [shown], "rejected": [bad]})

    grouped = stream.select(key, text, order).groupBy(key)
    return grouped.applyInPandasWithState(merge, f"`{key}` {kind}, draft string, rejected int", "draft string", "update", GroupStateTimeout.NoTimeout)


def violation_counts(stream: DataFrame, time: str, window: str = "1 minute", late: str = "5 minutes", violations: str = "violations") -> DataFrame:
    """Violations by time window, path and code, with a watermark for late rows."""
    one = stream.withWatermark(time, late).select(time, F.explode(violations).alias("v"))
    by = (F.window(time, window).alias("window"), F.array_join("v.path", ".").alias("path"), F.col("v.code").alias("code"))
    return one.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
