"""Records in and out: JSON text, maps, and files of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stipule.operators.deltas import as_map, as_record
from stipule.operators.reshape import raw_to_json
from stipule.plans.contract import Contract


def parsed(df: DataFrame, text: str, raw: str = "raw") -> DataFrame:
    """JSON text parsed once into a VARIANT column; text that is no JSON becomes NULL."""
    return df.withColumn(raw, F.try_parse_json(F.col(f"`{text}`")))


def read_json_lines(spark: SparkSession, path: str, raw: str = "raw") -> DataFrame:
    """A file of one JSON record a line, as VARIANT."""
    return spark.read.text(path).select(F.try_parse_json("value").alias(raw))


def write_json_lines(df: DataFrame, raw: str, path: str, mode: str = "errorifexists") -> None:
    """VARIANT records as canonical JSON, one a line."""
    df.select(raw_to_json(F.col(f"`{raw}`")).alias("value")).write.mode(mode).text(path)


def from_struct(df: DataFrame, columns: Sequence[str] | None = None, raw: str = "raw") -> DataFrame:
    """Columns gathered into a VARIANT record; NULL is a JSON null."""
    names = list(columns or df.columns)
    return df.withColumn(raw, F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in names])))


def optional_nulls_dropped(record: Column, contract: Contract) -> Column:
    """A record as map-based callers mean it: a null optional field is absent."""
    optional = [f.name for f in contract.fields if f.optional]
    if not optional:
        return record
    return as_record(F.map_filter(as_map(record), lambda k, v: ~(k.isin(*optional) & F.is_variant_null(v))))


def quarantined_write(df: DataFrame, good: str, bad: str, is_valid: str = "is_valid") -> None:
    """Valid and invalid rows written to two Parquet folders."""
    from stipule.operators.updates import quarantine

    ok, wrong = quarantine(df, is_valid)
    ok.write.mode("overwrite").parquet(good)
    wrong.write.mode("overwrite").parquet(bad)
