"""Headline queries, timed; prints one line of JSON.

Each is run once to compile and then three times; the median counts.  Results go
to Spark's no-op sink, so every column of every row is computed.  ``scan_control``
reads the same table and columns as ``validate_lineitem`` and does nothing else.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipule import queries as q
from stipule.operators.reshape import sanitize, sanitize_json
from stipule.operators.updates import patch_join
from stipule.operators.validate import validate, with_validity
from stipule.plans.filters import Filter, matching

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "4g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cases(spark: SparkSession) -> dict[str, DataFrame]:
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    lineitem, customer = read("lineitem"), read("customer")
    used = [f.name for f in q.LINEITEM.fields]
    f = Filter()
    fine = f.field("l_quantity").gte(10.0) & ~f.field("l_shipdate").exists() | f.field("l_discount").in_([0.05, 0.06]) & f.field("l_returnflag").starts_with("R")
    return {
        "scan_control": lineitem.select(*used),
        "validate_lineitem": validate(lineitem.select(*used), q.LINEITEM).select("is_valid", "violations"),
        "validity_lineitem": with_validity(lineitem.select(*used), q.LINEITEM),
        "validate_customer": validate(customer, q.CUSTOMER),
        "validate_raw_events": validate(q._raw_events(spark, SF), q.PROPS, "raw"),  # noqa: SLF001
        "filter_lineitem": matching(lineitem, fine).select("l_orderkey", "l_linenumber"),
        "sanitize_customer": sanitize(customer, q.PRIVATE),
        "sanitize_json_customer": customer.select(sanitize_json(customer, q.PRIVATE).alias("json")),
        "patch_join_customer": patch_join(q._customers(spark, SF), q._patches(spark, SF), q.CUSTOMER, "c_custkey"),  # noqa: SLF001
        "violation_report": q.QUERIES["violation_report"](spark, SF),
        "nested_lists": validate(q._baskets(spark, SF), q.BASKET).select("o", F.size("violations")),  # noqa: SLF001
    }


def timed(df: DataFrame) -> float:
    took = []
    for _ in range(4):
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return median(took[1:])


def main() -> None:
    spark = session()
    seconds = {name: round(timed(df), 4) for name, df in cases(spark).items()}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
