"""Records in, violations out."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from stipule.operators.validate import validate, validate_patch


def raw_df(spark, *records, **cols):
    """Rows of VARIANT records: dicts, or JSON text."""
    texts = [(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(texts, "i int, text string").withColumn("raw", F.try_parse_json("text"))


def codes(row):
    return [(".".join(v.path), v.code.split("(declared type")[0]) for v in row.violations]


def check(spark, contract, *records, **how):
    """The violations of each record, as (path, code)."""
    out = validate(raw_df(spark, *records), contract, "raw", **how).orderBy("i").collect()
    return [codes(r) for r in out]


def one(spark, contract, record, **how):
    """The whole result row of a record."""
    return validate(raw_df(spark, record), contract, "raw", **how).collect()[0]


def patched(spark, contract, current, patch, **how):
    """The result row of a patch."""
    df = spark.createDataFrame([(json.dumps(current), json.dumps(patch))], "a string, b string")
    return validate_patch(df.select(F.parse_json("a").alias("a"), F.parse_json("b").alias("b")), contract, "a", "b", **how).collect()[0]
