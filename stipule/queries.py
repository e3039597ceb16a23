"""Queries that run every operator over the sample tables, with the same result in SQL.

The tables hold no nulls, absent keys or wrong types, so several queries make
them on both sides by a rule over the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipule.functions.checks import no_whitespace
from stipule.functions.text import plain_double
from stipule.operators.compiler import Options
from stipule.operators.deltas import as_map, deep_merge, right_difference
from stipule.operators.reshape import clean_struct, flatten, raw_to_json, sanitize, sanitize_json, sanitize_raw, to_json, to_raw
from stipule.operators.updates import apply_patch, apply_to, finalize, merge_drafts, patch_join, violation_report, violation_rows
from stipule.operators.validate import extras_of, validate, validate_aspect_patch, validate_partial, validate_patch, with_validity
from stipule.plans.contract import Contract, Field, Rule
from stipule.plans.filters import Expr, Filter, matching
from stipule.plans.patch import Patch
from stipule.plans.types import BigDecimal, Boolean, Double, Either, Extract, Int, ListOf, Long, MapOf, Nested, SetOf, String, Wrapper
from stipule.plans.view import View

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name], SQL[name] = run, sql
        return run

    return add


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Contracts -----------------------------------------------------------------

CUSTOMER = Contract.define(
    "Customer",
    Field("c_custkey", Long, immutable=True),
    Field("c_name", String, non_empty=True, max_length=18, pattern=r"Customer#\d+"),
    Field("c_nationkey", Int, min=0, max=24),
    Field("c_acctbal", Double, min=0, max=9000),
    Field("c_mktsegment", String, pattern="[A-M].*"),
)
ORDERS = Contract.define(
    "Orders",
    Field("o_orderkey", Long),
    Field("o_custkey", Long),
    Field("o_orderstatus", String, min_length=1, pattern="[OF]"),
    Field("o_totalprice", Double, positive=True, max=400000),
    Field("o_orderpriority", String, optional=True, non_empty=True),
)
LINEITEM = Contract.define(
    "Lineitem",
    Field("l_orderkey", Long),
    Field("l_linenumber", Int, min=1),
    Field("l_quantity", Double, min=2),
    Field("l_discount", Double),
    Field("l_tax", Double),
    rules=(Rule("discount exceeds tax", lambda r: r.getField("l_discount") <= r.getField("l_tax")),),
)
PROPS = Contract.define("Props", Field("k", Int, min=10, max=89))
#: Raw event records: some keys missing, null, of another type, or unknown.
RAW_TEXT = """case when event_id % 11 = 0 then '{"k": null}' when event_id % 7 = 0 then '{}'
 when event_id % 5 = 0 then '{"k": "' || (event_id % 50) || '"}' when event_id % 3 = 0 then '{"k": 5.5, "z": 1}'
 else props end"""


def _raw_events(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events").select("event_id", F.try_parse_json(F.expr(RAW_TEXT)).alias("raw"))


def _paths(df: DataFrame, key: str) -> DataFrame:
    return violation_rows(df, key).select(key, "path", "code")


# Validation ----------------------------------------------------------------


@_query(
    "validate_customer_violations",
    """
SELECT c_custkey, path, code FROM (
  SELECT c_custkey, 'c_name' path, 'CONSTRAINT(maxLength)' code FROM customer WHERE length(c_name) > 18
  UNION ALL SELECT c_custkey, 'c_name', 'CONSTRAINT(pattern)' FROM customer WHERE NOT regexp_full_match(c_name, 'Customer#\\d+')
  UNION ALL SELECT c_custkey, 'c_acctbal', 'CONSTRAINT(min)' FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT c_custkey, 'c_acctbal', 'CONSTRAINT(max)' FROM customer WHERE c_acctbal > 9000
  UNION ALL SELECT c_custkey, 'c_mktsegment', 'CONSTRAINT(pattern)' FROM customer WHERE NOT regexp_full_match(c_mktsegment, '[A-M].*'))""",
)
def validate_customer_violations(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(validate(_read(spark, sf, "customer"), CUSTOMER), "c_custkey")


@_query(
    "validate_messages",
    """
SELECT c_custkey, '''c_nationkey'' must be <= 20 (got ' || c_nationkey || '.0)' AS message FROM customer WHERE c_nationkey > 20
UNION ALL SELECT c_custkey, '''c_name'' must be at least 19 characters (got ' || length(c_name) || ')' FROM customer WHERE length(c_name) < 19""",
)
def validate_messages(spark: SparkSession, sf: str) -> DataFrame:
    c = Contract.define("C", Field("c_nationkey", Int, max=20), Field("c_name", String, min_length=19))
    return violation_rows(validate(_read(spark, sf, "customer"), c), "c_custkey").select("c_custkey", "message")


@_query(
    "validate_orders_ok",
    """
SELECT o_orderkey, (o_orderstatus IN ('O', 'F') AND o_totalprice > 0 AND o_totalprice <= 400000) AS is_valid FROM orders""",
)
def validate_orders_ok(spark: SparkSession, sf: str) -> DataFrame:
    return with_validity(_read(spark, sf, "orders"), ORDERS).select("o_orderkey", "is_valid")


@_query(
    "validate_missing_and_null",
    """
SELECT c_custkey, path, code FROM (
  SELECT c_custkey, 'c_acctbal' path, 'MISSING' code FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT c_custkey, 'c_extra', 'MISSING' FROM customer
  UNION ALL SELECT c_custkey, 'c_acctbal', 'CONSTRAINT(min)' FROM customer WHERE c_custkey % 7 <> 0 AND c_acctbal < 0)""",
)
def validate_missing_and_null(spark: SparkSession, sf: str) -> DataFrame:
    c = Contract.define("C", Field("c_custkey", Long), Field("c_acctbal", Double, min=0), Field("c_extra", String))
    df = _read(spark, sf, "customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))
    return _paths(validate(df, c), "c_custkey")


@_query(
    "validate_explicit_nulls",
    """
SELECT c_custkey, 'c_acctbal' AS path, 'TYPE_MISMATCH(declared type,null)' AS code FROM customer WHERE c_custkey % 7 = 0""",
)
def validate_explicit_nulls(spark: SparkSession, sf: str) -> DataFrame:
    c = Contract.define("C", Field("c_custkey", Long), Field("c_acctbal", Double), Field("c_name", String, optional=True))
    gone = F.col("c_custkey") % 7 != 0
    df = _read(spark, sf, "customer").withColumns({"c_acctbal": F.when(gone, F.col("c_acctbal")), "c_name": F.when(gone, F.col("c_name"))})
    return _paths(validate(df, c, nulls="explicit"), "c_custkey")


@_query("validate_unknown_columns", "SELECT n_nationkey, 'n_regionkey' AS path, 'UNKNOWN_FIELD' AS code FROM nation")
def validate_unknown_columns(spark: SparkSession, sf: str) -> DataFrame:
    c = Contract.define("N", Field("n_nationkey", Int), Field("n_name", String))
    return _paths(validate(_read(spark, sf, "nation"), c, closed_columns=True), "n_nationkey")


@_query(
    "cross_field_lineitem",
    """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 2 THEN 'CONSTRAINT(min)' ELSE 'CONSTRAINT(validateContract)' END AS code
FROM lineitem WHERE l_quantity < 2 OR l_discount > l_tax""",
)
def cross_field_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    out = validate(_read(spark, sf, "lineitem"), LINEITEM)
    return out.select("l_orderkey", "l_linenumber", F.explode("violations").alias("v")).select("l_orderkey", "l_linenumber", F.col("v.code").alias("code"))


@_query(
    "multiple_of_part",
    """
SELECT p_partkey, 'CONSTRAINT(multipleOf)' AS code FROM part WHERE abs(p_retailprice / 0.5 - round(p_retailprice / 0.5)) > 1e-7""",
)
def multiple_of_part(spark: SparkSession, sf: str) -> DataFrame:
    c = Contract.define("P", Field("p_partkey", Long), Field("p_retailprice", Double, multiple_of=0.5))
    return _paths(validate(_read(spark, sf, "part"), c), "p_partkey").select("p_partkey", "code")


@_query(
    "formats_of_text",
    """
SELECT page_id, code FROM (
  SELECT page_id, 'CONSTRAINT(url)' code FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'ftp://a.b' WHEN 1 THEN 'http://a' ELSE url END u FROM pages)
    WHERE NOT regexp_full_match(u, 'https?://[^\\s/$.?#].[^\\s]*')
  UNION ALL SELECT page_id, 'CONSTRAINT(email)' FROM pages WHERE page_id % 5 = 0
  UNION ALL SELECT page_id, 'CONSTRAINT(uuid)' FROM pages WHERE page_id % 3 = 0)""",
)
def formats_of_text(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    url = F.when(k % 4 == 0, "ftp://a.b").when(k % 4 == 1, "http://a").otherwise(F.col("url"))
    mail = F.when(k % 5 == 0, "a b@c.d").otherwise(F.concat(F.lit("u"), k.cast("string"), F.lit("@example.org")))
    ident = F.when(k % 3 == 0, "123e4567-e89b-12d3-a456-42661417400").otherwise("123e4567-E89B-12d3-a456-426614174000")
    c = Contract.define("Page", Field("url", String, url=True), Field("mail", String, email=True), Field("ident", String, uuid=True))
    return _paths(validate(_read(spark, sf, "pages").select("page_id", url.alias("url"), mail.alias("mail"), ident.alias("ident")), c), "page_id").select("page_id", "code")


@_query(
    "future_and_past",
    """
SELECT event_id, CASE WHEN epoch_ms(ts) <= 1704153600000 THEN 'CONSTRAINT(future)' ELSE 'CONSTRAINT(past)' END AS code FROM events
UNION ALL SELECT event_id, 'CONSTRAINT(past)' FROM events WHERE epoch_ms(ts) = 1704153600000""",
)
def future_and_past(spark: SparkSession, sf: str) -> DataFrame:
    c = Contract.define("E", Field("at", Long, future=True), Field("too", Long, past=True))
    df = _read(spark, sf, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at")).withColumn("too", F.col("at"))
    return _paths(validate(df, c, options=Options(now=F.lit(1704153600000))), "event_id").select("event_id", "code")


@_query(
    "custom_validator",
    """
SELECT p_partkey, 'must not contain whitespace (got ''' || left('a ' || p_type, 40) || ''')' AS message FROM part WHERE p_partkey % 3 = 0""",
)
def custom_validator(spark: SparkSession, sf: str) -> DataFrame:
    c = Contract.define("P", Field("p_type", String, validators=(no_whitespace,)))
    spaced = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("a "), F.col("p_type"))).otherwise("a")
    return violation_rows(validate(_read(spark, sf, "part").select("p_partkey", spaced.alias("p_type")), c), "p_partkey").select("p_partkey", "message")


@_query(
    "violation_report",
    """
SELECT path, code, count(*) AS n FROM (
  SELECT 'c_acctbal' path, 'CONSTRAINT(min)' code FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 'c_acctbal', 'CONSTRAINT(max)' FROM customer WHERE c_acctbal > 9000
  UNION ALL SELECT 'c_mktsegment', 'CONSTRAINT(pattern)' FROM customer WHERE NOT regexp_full_match(c_mktsegment, '[A-M].*')) GROUP BY ALL""",
)
def report(spark: SparkSession, sf: str) -> DataFrame:
    return violation_report(validate(_read(spark, sf, "customer"), CUSTOMER))


@_query(
    "validated_values",
    """
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal BETWEEN 0 AND 9000 AND length(c_name) <= 18 AND regexp_full_match(c_mktsegment, '[A-M].*')""",
)
def validated_values(spark: SparkSession, sf: str) -> DataFrame:
    out = validate(_read(spark, sf, "customer"), CUSTOMER).where("is_valid")
    return out.select("value.c_custkey", "value.c_name", "value.c_acctbal")


# Raw records ---------------------------------------------------------------

_EVENT_CASES = f"""
SELECT event_id, t, json_extract_string(t, '$.k') AS k, json_type(t, '$.k') AS kind FROM (SELECT event_id, {RAW_TEXT} AS t FROM events)"""


@_query(
    "raw_violations",
    f"""
WITH e AS ({_EVENT_CASES})
SELECT event_id, 'z' AS path, 'UNKNOWN_FIELD' AS code FROM e WHERE json_exists(t, '$.z')
UNION ALL SELECT event_id, 'k', 'MISSING' FROM e WHERE NOT json_exists(t, '$.k')
UNION ALL SELECT event_id, 'k', 'TYPE_MISMATCH(declared type,null)' FROM e WHERE kind = 'NULL'
UNION ALL SELECT event_id, 'k', 'TYPE_MISMATCH(declared type,DECIMAL)' FROM e WHERE kind = 'DOUBLE'
UNION ALL SELECT event_id, 'k', 'CONSTRAINT(min)' FROM e WHERE kind NOT IN ('NULL', 'DOUBLE') AND TRY_CAST(k AS INT) < 10
UNION ALL SELECT event_id, 'k', 'CONSTRAINT(max)' FROM e WHERE kind NOT IN ('NULL', 'DOUBLE') AND TRY_CAST(k AS INT) > 89""",
)
def raw_violations(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(validate(_raw_events(spark, sf), PROPS, "raw"), "event_id")


@_query("raw_decode", f"WITH e AS ({_EVENT_CASES}) SELECT event_id, CASE WHEN kind NOT IN ('NULL', 'DOUBLE') THEN TRY_CAST(k AS INT) END AS k FROM e")
def raw_decode(spark: SparkSession, sf: str) -> DataFrame:
    c = Contract.define("P", Field("k", Int, optional=True), open=True)
    return validate(_raw_events(spark, sf), c, "raw").select("event_id", "value.k")


@_query("raw_decode_jvm", f"WITH e AS ({_EVENT_CASES}) SELECT event_id, COALESCE(kind IN ('UBIGINT', 'BIGINT'), false) AS is_valid FROM e")
def raw_decode_jvm(spark: SparkSession, sf: str) -> DataFrame:
    c = Contract.define("P", Field("k", Int), open=True)
    return validate(_raw_events(spark, sf), c, "raw", options=Options(jvm=True)).select("event_id", "is_valid")


@_query("extras_of_open", f"WITH e AS ({_EVENT_CASES}) SELECT event_id, json_extract_string(t, '$.z') AS z FROM e WHERE json_exists(t, '$.z')")
def extras_of_open(spark: SparkSession, sf: str) -> DataFrame:
    df = _raw_events(spark, sf)
    c = Contract.define("P", Field("k", Int), open=True)
    return df.select("event_id", F.to_json(F.try_element_at(extras_of(df, c, "raw"), F.lit("z"))).alias("z")).where("z is not null")


@_query("defaults_of_absent", f"WITH e AS ({_EVENT_CASES}) SELECT event_id, COALESCE(TRY_CAST(k AS INT), -1) AS k FROM e WHERE kind IS NULL OR kind NOT IN ('NULL', 'DOUBLE')")
def defaults_of_absent(spark: SparkSession, sf: str) -> DataFrame:
    c = Contract.define("P", Field("k", Int, default=-1))
    return validate(_raw_events(spark, sf), c, "raw").where("is_valid").select("event_id", "value.k")


@_query(
    "partial_drafts",
    f"WITH e AS ({_EVENT_CASES}) SELECT event_id, NOT json_exists(t, '$.k') AS empty FROM e WHERE (kind IS NULL OR kind NOT IN ('NULL', 'DOUBLE')) AND COALESCE(TRY_CAST(k AS INT), 50) BETWEEN 10 AND 89",
)
def partial_drafts(spark: SparkSession, sf: str) -> DataFrame:
    out = validate_partial(_raw_events(spark, sf), PROPS, "raw").where("is_valid")
    return out.select("event_id", (F.size(as_map(F.col("draft"))) == 0).alias("empty"))


# Nested records, unions, newtypes -------------------------------------------

ITEM = Contract.define("Item", Field("qty", Double, min=5), Field("part", Long, min=0), Field("tax", Double, internal=True))
BASKET = Contract.define("Basket", Field("o", Long), Field("items", ListOf(Nested(ITEM)), non_empty=True))


def _baskets(spark: SparkSession, sf: str) -> DataFrame:
    li = _read(spark, sf, "lineitem")
    item = F.struct("l_linenumber", F.col("l_partkey"), F.col("l_quantity").alias("qty"), F.col("l_partkey").alias("part"), F.col("l_tax").alias("tax"))
    listed = li.groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(item)).alias("i"))
    return listed.select("o", F.transform("i", lambda x: F.struct(x["qty"].alias("qty"), x["part"].alias("part"), x["tax"].alias("tax"))).alias("items"))


@_query(
    "nested_list_paths",
    """
SELECT l_orderkey AS o, 'items.' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_tax) - 1) || '.qty' AS path
FROM lineitem QUALIFY l_quantity < 5""",
)
def nested_list_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(validate(_baskets(spark, sf), BASKET), "o").select("o", "path")


@_query("nested_list_sanitized", "SELECT l_orderkey AS o, sum(l_quantity) AS qty, count(*) AS n, false AS leaked FROM lineitem GROUP BY 1")
def nested_list_sanitized(spark: SparkSession, sf: str) -> DataFrame:
    out = sanitize(_baskets(spark, sf), BASKET)
    leaked = "tax" in out.schema["items"].dataType.elementType.names
    total = F.aggregate("items", F.lit(0.0), lambda a, x: a + x["qty"])
    return out.select("o", total.alias("qty"), F.size("items").cast("long").alias("n"), F.lit(leaked).alias("leaked"))


STAMPS = Contract.define("Stamps", Field("o_orderdate", Long, optional=True), Field("o_totalprice", Double, positive=True))
DOCUMENT = Contract.define("Document", Field("o_orderkey", Long), Field("stamps", Nested(STAMPS), include=True))


@_query("include_flatten", "SELECT o_orderkey, o_totalprice, o_totalprice > 200000 AS large FROM orders WHERE o_orderkey % 3 <> 0 AND o_totalprice > 0")
def include_flatten(spark: SparkSession, sf: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 3 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    df = _read(spark, sf, "orders").select("o_orderkey", price.alias("o_totalprice"))
    flat = flatten(validate(df, DOCUMENT).where("is_valid").select("value"), DOCUMENT)
    return flat.select("o_orderkey", "o_totalprice", (F.col("o_totalprice") > 200000).alias("large"))


CARD = Contract.define("Card", Field("number", String, masked="****"), Field("amount", Int, min=1))
BANK = Contract.define("Bank", Field("account", String, non_empty=True), Field("code", String, internal=True))
PAID = Contract.define("Paid", Field("id", Int), Field("by", Either(Nested(CARD), Nested(BANK), key="kind", left_tag="card", right_tag="bank")))
PAID_TEXT = """case event_id % 4 when 0 then '{"id": 1, "by": {"kind": "card", "number": "n' || event_id || '", "amount": 3}}'
 when 1 then '{"id": 1, "by": {"kind": "bank", "account": "a' || event_id || '", "code": "s"}}'
 when 2 then '{"id": 1, "by": {"kind": "cash", "account": "a", "code": "s"}}' else '{"id": 1, "by": {"kind": "card", "amount": 3}}' end"""


@_query(
    "tagged_union",
    """
SELECT event_id, event_id % 4 IN (0, 1) AS is_valid, CASE event_id % 4 WHEN 0 THEN 'n' || event_id END AS number, CASE event_id % 4 WHEN 1 THEN 'a' || event_id END AS account FROM events""",
)
def tagged_union(spark: SparkSession, sf: str) -> DataFrame:
    df = _read(spark, sf, "events").select("event_id", F.parse_json(F.expr(PAID_TEXT)).alias("raw"))
    return validate(df, PAID, "raw").select("event_id", "is_valid", F.col("value.by.left.number").alias("number"), F.col("value.by.right.account").alias("account"))


@_query(
    "tagged_union_sanitized",
    """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"by":{"amount":3,"kind":"card","number":"****"},"id":1}' WHEN 1 THEN '{"by":{"account":"a' || event_id || '","kind":"bank"},"id":1}'
 WHEN 2 THEN '{"by":{"account":"a","kind":"cash"},"id":1}' ELSE '{"by":{"amount":3,"kind":"card"},"id":1}' END AS json FROM events""",
)
def tagged_union_sanitized(spark: SparkSession, sf: str) -> DataFrame:
    df = _read(spark, sf, "events").select("event_id", F.parse_json(F.expr(PAID_TEXT)).alias("raw"))
    return df.select("event_id", F.to_json(sanitize_raw(F.col("raw"), PAID)).alias("json"))


@_query(
    "plain_union",
    """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'e' || event_id END AS l, CASE WHEN event_id % 2 = 1 THEN CAST(event_id AS INT) END AS r FROM events""",
)
def plain_union(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("""case when event_id % 2 = 0 then '{"v": {"left": "e' || event_id || '"}}' else '{"v": {"left": 1, "right": ' || event_id || '}}' end""")
    c = Contract.define("H", Field("v", Either(String, Int)))
    df = _read(spark, sf, "events").select("event_id", F.parse_json(text).alias("raw"))
    return validate(df, c, "raw").select("event_id", F.col("value.v.left").alias("l"), F.col("value.v.right").alias("r"))


@_query(
    "extract_groups",
    """
SELECT c_custkey, regexp_extract(c_name, '^(Customer)#(\\d+)$', 1) AS kind, CAST(regexp_extract(c_name, '^(Customer)#(\\d+)$', 2) AS BIGINT) AS number FROM customer""",
)
def extract_groups(spark: SparkSession, sf: str) -> DataFrame:
    named = Extract(r"(Customer)#(\d+)", (("kind", String), ("number", Long)))
    c = Contract.define("C", Field("c_name", named))
    return validate(_read(spark, sf, "customer"), c).select("c_custkey", "value.c_name.kind", "value.c_name.number")


@_query("wrapper_constraints", "SELECT c_custkey, 'CONSTRAINT(min)' AS code FROM customer WHERE c_acctbal < 0")
def wrapper_constraints(spark: SparkSession, sf: str) -> DataFrame:
    c = Contract.define("C", Field("c_acctbal", Wrapper("Balance", Double), min=0))
    return _paths(validate(_read(spark, sf, "customer"), c), "c_custkey").select("c_custkey", "code")


@_query("collections", "SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS n, event_id % 10 AS total FROM events WHERE event_id % 5 <> 0")
def collections(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("""'{"s": [1, ' || (case when event_id % 2 = 0 then 1 else 2 end) || '], "m": {"a": ' || (case when event_id % 5 = 0 then '"x"' else string(event_id % 10) end) || '}}'""")
    c = Contract.define("C", Field("s", SetOf(Int)), Field("m", MapOf(Long)))
    out = validate(_read(spark, sf, "events").select("event_id", F.parse_json(text).alias("raw")), c, "raw").where("is_valid")
    return out.select("event_id", F.size("value.s").cast("long").alias("n"), F.col("value.m")["a"].alias("total"))


# Filters -------------------------------------------------------------------

_f = Filter()
_segment, _balance, _name = _f.field("c_mktsegment"), _f.field("bal"), _f.field("c_name")
#: Filters over customers whose balance is NULL for every seventh key, and the same in SQL.
FILTERS: dict[str, tuple[Expr, str]] = {
    "exists": (_balance.exists(), "bal IS NOT NULL"),
    "not_exists": (_balance.not_exists(), "bal IS NULL"),
    "eq": (_segment.equal_to("BUILDING"), "c_mktsegment = 'BUILDING'"),
    "ne": (_balance.not_equal_to(0.0), "bal IS DISTINCT FROM 0"),
    "gt": (_balance.gt(5000.0), "bal > 5000"),
    "gte": (_balance.gte(5000.0), "bal >= 5000"),
    "lt": (_balance.lt(100.0), "bal < 100"),
    "lte": (_balance.lte(100.0), "bal <= 100"),
    "in": (_segment.in_(["BUILDING", "MACHINERY"]), "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "in_empty": (_segment.in_([]) | _balance.lt(0.0), "bal < 0"),
    "not_in": (_segment.not_in(["BUILDING", "MACHINERY"]), "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    "is_some": (_segment.is_some("BUILDING"), "c_mktsegment = 'BUILDING'"),
    "contains": (_name.contains("#00000001"), "contains(c_name, '#00000001')"),
    "starts_with": (_name.starts_with("Customer#00000002"), "starts_with(c_name, 'Customer#00000002')"),
    "matches": (_name.matches(r"Customer#\d*7"), "regexp_full_match(c_name, 'Customer#\\d*7')"),
    "and": (_segment.equal_to("BUILDING") & _balance.gt(0.0), "c_mktsegment = 'BUILDING' AND bal > 0"),
    "or": (_segment.equal_to("BUILDING") | _balance.gt(0.0), "c_mktsegment = 'BUILDING' OR bal > 0"),
    "not_gt": (~_balance.gt(0.0), "bal IS NULL OR bal <= 0"),
    "not_in_not": (~_balance.in_([1.0, 2.0]), "bal IS NULL OR bal NOT IN (1, 2)"),
    "not_or": (~(_segment.equal_to("BUILDING") | _balance.lt(100.0)), "c_mktsegment <> 'BUILDING' AND (bal IS NULL OR bal >= 100)"),
    "not_and": (~(_segment.equal_to("BUILDING") & _balance.exists()), "c_mktsegment <> 'BUILDING' OR bal IS NULL"),
    "not_not": (~~_balance.gt(0.0), "bal > 0"),
    "jvm_number": (Filter(jvm=True).field("bal").gte(5000), "bal >= 5000"),
    "jvm_text": (Filter(jvm=True).field("c_mktsegment").lt("C"), "c_mktsegment < 'C'"),
}
_BALANCES = "(SELECT *, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS bal FROM customer)"


def _filter_query(expr: Expr) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = _read(spark, sf, "customer").withColumn("bal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))
        return matching(df, expr).select("c_custkey")

    return run


for _key, (_expr, _where) in FILTERS.items():
    QUERIES[f"filter_{_key}"], SQL[f"filter_{_key}"] = _filter_query(_expr), f"SELECT c_custkey FROM {_BALANCES} WHERE {_where}"


@_query("filter_raw", f"WITH e AS ({_EVENT_CASES}) SELECT event_id FROM e WHERE NOT COALESCE(CASE WHEN kind NOT IN ('NULL', 'DOUBLE') THEN TRY_CAST(k AS INT) END >= 20, false)")
def filter_raw(spark: SparkSession, sf: str) -> DataFrame:
    return matching(_raw_events(spark, sf), ~Filter(PROPS).field("k").gte(20), PROPS, "raw").select("event_id")


@_query("filter_raw_null", f"WITH e AS ({_EVENT_CASES}) SELECT event_id FROM e WHERE kind = 'NULL'")
def filter_raw_null(spark: SparkSession, sf: str) -> DataFrame:
    return matching(_raw_events(spark, sf), Filter(PROPS).field("k").equal_to(None), PROPS, "raw").select("event_id")


# Sanitizing, views, JSON -----------------------------------------------------

PRIVATE = Contract.define("Private", Field("c_custkey", Long), Field("c_name", String, masked="***"), Field("c_acctbal", Double, internal=True))


@_query("sanitize_customer", "SELECT c_custkey, '***' AS c_name, c_nationkey, c_mktsegment FROM customer")
def sanitize_customer(spark: SparkSession, sf: str) -> DataFrame:
    return sanitize(_read(spark, sf, "customer"), PRIVATE)


@_query(
    "sanitize_raw",
    """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"k":"#","x":1}' ELSE '{"x":1}' END AS json FROM events""",
)
def sanitize_raw_records(spark: SparkSession, sf: str) -> DataFrame:
    c = Contract.define("S", Field("k", Int, masked="#"), Field("s", String, internal=True))
    text = F.expr("""case when event_id % 2 = 0 then '{"k": null, "s": "t", "x": 1}' else '{"s": 2, "x": 1}' end""")
    return _read(spark, sf, "events").select("event_id", F.to_json(sanitize_raw(F.parse_json(text), c)).alias("json"))


@_query("view_pipeline", "SELECT s_suppkey, '<hidden>' AS s_name, s_acctbal * 2 AS doubled, s_acctbal * 2 + 1 AS more FROM supplier")
def view_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    view = View().compute("doubled", lambda c: c("s_acctbal") * 2).omit("s_acctbal").omit("s_nationkey").mask("s_name", "<hidden>").compute("more", lambda c: c("doubled") + 1)
    return view.apply(_read(spark, sf, "supplier"))


@_query("view_raw", """SELECT event_id, '{"k":"***","n":' || event_id || '}' AS json FROM events""")
def view_raw(spark: SparkSession, sf: str) -> DataFrame:
    df = _read(spark, sf, "events").withColumn("raw", F.parse_json(F.lit('{"k": 1, "gone": 2}')))
    view = View().mask("k").mask("absent").omit("gone").compute("n", lambda _: F.col("event_id"))
    return df.select("event_id", F.to_json(view.apply_raw(F.col("raw"))).alias("json"))


@_query(
    "json_of_records",
    """
SELECT n_nationkey, '{"key":' || n_nationkey || ',"name":"' || n_name || '","tags":["a\\"b",null]}' AS json FROM nation""",
)
def json_of_records(spark: SparkSession, sf: str) -> DataFrame:
    r = F.struct(F.array(F.lit('a"b'), F.lit(None)).alias("tags"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("gone"), F.col("n_nationkey").alias("key"))
    df = _read(spark, sf, "nation").select("n_nationkey", r.alias("r"))
    return df.select("n_nationkey", to_json(df, "r").alias("json"))


@_query(
    "json_sanitized",
    """SELECT r_regionkey, '{"r_name":"?","r_regionkey":' || r_regionkey || '}' AS json FROM region""",
)
def json_sanitized(spark: SparkSession, sf: str) -> DataFrame:
    c = Contract.define("R", Field("r_regionkey", Int), Field("r_name", String, masked="?"))
    df = _read(spark, sf, "region").select("r_regionkey", "r_name")
    return df.select("r_regionkey", sanitize_json(df, c).alias("json"))


@_query(
    "json_numbers",
    """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '1500' WHEN 1 THEN '12300000000' WHEN 2 THEN '0.00000125' WHEN 3 THEN '-0.5' ELSE NULL END AS shown FROM part""",
)
def json_numbers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    x = F.when(k == 0, 1500.0).when(k == 1, 1.23e10).when(k == 2, 1.25e-6).when(k == 3, -0.5).otherwise(float("nan"))
    return _read(spark, sf, "part").select("p_partkey", plain_double(x).alias("shown"))


@_query("json_of_raw", """SELECT event_id, '{"a":{"b":1.5},"z":[null,' || event_id || ']}' AS json FROM events""")
def json_of_raw(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("""'{"z": [null, ' || event_id || '], "a": {"n": null, "b": 1.50}, "y": null}'""")
    return _read(spark, sf, "events").select("event_id", raw_to_json(F.parse_json(text)).alias("json"))


@_query("raw_of_records", """SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '{"k":' || n_nationkey || '}' ELSE '{"k":' || n_nationkey || ',"s":"' || n_name || '"}' END AS json FROM nation""")
def raw_of_records(spark: SparkSession, sf: str) -> DataFrame:
    c = Contract.define("N", Field("k", Int), Field("s", String, optional=True))
    r = F.struct(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 2 != 0, F.col("n_name")).alias("s"))
    return _read(spark, sf, "nation").select("n_nationkey", F.to_json(to_raw(r, c)).alias("json"))


@_query("clean_structs", "SELECT c_custkey, '***' AS name FROM customer")
def clean_structs(spark: SparkSession, sf: str) -> DataFrame:
    df = _read(spark, sf, "customer").select("c_custkey", F.struct("c_name", "c_acctbal").alias("r"))
    return df.select("c_custkey", clean_struct(F.col("r"), df.schema["r"].dataType, PRIVATE).getField("c_name").alias("name"))


# Patches, deltas, drafts, aspects --------------------------------------------


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    df = _read(spark, sf, "customer")
    return df.select("c_custkey", F.to_variant_object(F.struct(*[c for c in df.columns])).alias("raw"))


PATCH_TEXT = """case c_custkey % 6 when 0 then '{"c_custkey": 1}' when 1 then '{"c_acctbal": -1}' when 2 then '{"c_acctbal": 77.5}'
 when 3 then '{"c_nationkey": "x"}' when 4 then '{"zzz": 1, "c_name": null}' else '{}' end"""


def _patches(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "customer").select("c_custkey", F.parse_json(F.expr(PATCH_TEXT)).alias("patch"))


@_query(
    "patch_violations",
    """
SELECT c_custkey, 'c_custkey' AS path, 'IMMUTABLE' AS code FROM customer WHERE c_custkey % 6 = 0
UNION ALL SELECT c_custkey, 'c_acctbal', 'CONSTRAINT(min)' FROM customer WHERE c_custkey % 6 = 1
UNION ALL SELECT c_custkey, 'c_nationkey', 'TYPE_MISMATCH(declared type,STRING)' FROM customer WHERE c_custkey % 6 = 3
UNION ALL SELECT c_custkey, 'zzz', 'UNKNOWN_FIELD' FROM customer WHERE c_custkey % 6 = 4
UNION ALL SELECT c_custkey, 'c_name', 'TYPE_MISMATCH(declared type,null)' FROM customer WHERE c_custkey % 6 = 4""",
)
def patch_violations(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(patch_join(_customers(spark, sf), _patches(spark, sf), CUSTOMER, "c_custkey"), "c_custkey")


@_query("patch_values", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 6 = 2 THEN 77.5 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 6 IN (2, 5)")
def patch_values(spark: SparkSession, sf: str) -> DataFrame:
    out = patch_join(_customers(spark, sf), _patches(spark, sf), CUSTOMER, "c_custkey").where("is_valid")
    return out.select("c_custkey", "value.c_name", "value.c_acctbal")


@_query("patch_latest", "SELECT c_custkey, COALESCE(CAST(max(o_orderkey) AS DOUBLE), c_acctbal) AS c_acctbal FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, customer.c_acctbal")
def patch_latest(spark: SparkSession, sf: str) -> DataFrame:
    c = Contract.define("C", Field("c_custkey", Long), Field("c_acctbal", Double), open=True)
    made = F.parse_json(F.concat(F.lit('{"c_acctbal": '), F.col("o_orderkey").cast("string"), F.lit("}")))
    patches = _read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), made.alias("patch"), F.col("o_orderkey").alias("n"))
    return patch_join(_customers(spark, sf), patches, c, "c_custkey", order="n").select("c_custkey", "value.c_acctbal")


@_query("patch_applied", "SELECT c_custkey, upper(c_mktsegment) || '!' AS c_mktsegment, (upper(c_mktsegment) || '!') SIMILAR TO '[A-M].*' AS is_valid FROM customer")
def patch_applied(spark: SparkSession, sf: str) -> DataFrame:
    patch = Patch.empty(CUSTOMER).modify("c_mktsegment", lambda c: F.concat(F.upper(c), F.lit("!"))).set("c_nationkey", 3)
    out = apply_patch(_customers(spark, sf), CUSTOMER, patch, "raw")
    shown = F.try_variant_get(apply_to("raw", patch, CUSTOMER), "$.c_mktsegment", "string")
    return out.select("c_custkey", shown.alias("c_mktsegment"), "is_valid")


STORE = Contract.define("Store", Field("id", Long, immutable=True), Field("left", Int, min=0), Field("held", Int, min=0), rules=(Rule("held beyond left", lambda r: r.getField("held") <= r.getField("left")),))
SHELF = Contract.define("Shelf", Field("sku", String), Field("store", Nested(STORE)))


@_query(
    "patch_nested",
    """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'store.id' WHEN 1 THEN 'store' ELSE '' END AS path,
 CASE event_id % 3 WHEN 0 THEN 'IMMUTABLE' WHEN 1 THEN 'CONSTRAINT(validateContract)' ELSE '' END AS code FROM events""",
)
def patch_nested(spark: SparkSession, sf: str) -> DataFrame:
    stored = F.parse_json(F.lit('{"sku": "a", "store": {"id": 9, "left": 2, "held": 1}}'))
    patch = F.parse_json(F.expr("""case event_id % 3 when 0 then '{"store": {"id": 10}}' when 1 then '{"store": {"held": 5}}' else '{"store": {"left": 3}}' end"""))
    df = _read(spark, sf, "events").select("event_id", stored.alias("now"), patch.alias("p"))
    out = validate_patch(df, SHELF, "now", "p").withColumn("v", F.try_element_at("violations", F.lit(1)))
    return out.select("event_id", F.coalesce(F.array_join("v.path", "."), F.lit("")).alias("path"), F.coalesce("v.code", F.lit("")).alias("code"))


@_query("delta_customers", "SELECT c_custkey, c_custkey % 3 = 0 AS changed_balance, c_custkey % 5 = 0 AS added FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0")
def delta_customers(spark: SparkSession, sf: str) -> DataFrame:
    after = F.expr("""case when c_custkey % 3 = 0 then '{"c_acctbal": -5' else '{"c_custkey": ' || c_custkey end || case when c_custkey % 5 = 0 then ', "extra": null}' else '}' end""")
    df = _customers(spark, sf).select("c_custkey", as_map(right_difference(F.col("raw"), F.parse_json(after))).alias("d")).where(F.size("d") > 0)
    return df.select("c_custkey", F.map_contains_key("d", "c_acctbal").alias("changed_balance"), F.map_contains_key("d", "extra").alias("added"))


@_query("deep_merge", """SELECT event_id, '{"a":{"b":{"c":' || event_id || ',"d":2},"e":3},"f":[1],"g":null}' AS json FROM events""")
def deep_merged(spark: SparkSession, sf: str) -> DataFrame:
    base = F.parse_json(F.lit('{"a": {"b": {"c": 1, "d": 2}, "e": 3}, "f": [1, 2], "g": {"h": 1}}'))
    delta = F.parse_json(F.expr("""'{"a": {"b": {"c": ' || event_id || '}}, "f": [1], "g": null}'"""))
    return _read(spark, sf, "events").select("event_id", F.to_json(deep_merge(base, delta)).alias("json"))


@_query("draft_merge", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice > 0 AND o_totalprice <= 400000")
def draft_merge(spark: SparkSession, sf: str) -> DataFrame:
    df = _read(spark, sf, "orders")
    half = lambda *cols: df.select(F.col("o_orderkey").alias("k"), F.to_variant_object(F.struct(*cols)).alias("raw"))
    one = validate_partial(half("o_orderkey", "o_custkey"), ORDERS, "raw").select("k", F.col("draft").alias("d1"))
    two = validate_partial(half("o_orderstatus", "o_totalprice"), ORDERS, "raw").select("k", F.col("draft").alias("d2"))
    merged = one.join(two, "k").select("k", merge_drafts(F.col("d1"), F.col("d2")).alias("draft"))
    return finalize(merged, ORDERS).where("is_valid").select("value.o_orderkey", "value.o_custkey", "value.o_orderstatus", "value.o_totalprice")


SEGMENT_PATCH = CUSTOMER.aspect("SegmentPatch", Field("c_mktsegment", String, optional=True), Field("c_acctbal", Double, optional=True, max=5000))


@_query("aspect_violations", "SELECT c_custkey, 'c_acctbal' AS path, CASE WHEN c_acctbal < 0 THEN 'CONSTRAINT(min)' ELSE 'CONSTRAINT(max)' END AS code FROM customer WHERE c_acctbal < 0 OR c_acctbal > 5000")
def aspect_violations(spark: SparkSession, sf: str) -> DataFrame:
    df = _read(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return _paths(validate(df, SEGMENT_PATCH), "c_custkey")


@_query("aspect_patch", "SELECT c_custkey, c_custkey % 2 = 0 AS is_valid, CASE WHEN c_custkey % 2 = 0 THEN CAST(10 AS DOUBLE) END AS c_acctbal FROM customer")
def aspect_patch(spark: SparkSession, sf: str) -> DataFrame:
    patch = F.parse_json(F.expr("""case when c_custkey % 2 = 0 then '{"c_acctbal": 10, "c_mktsegment": null}' else '{"c_acctbal": 6000}' end"""))
    df = _customers(spark, sf).withColumn("p", patch)
    return validate_aspect_patch(df, CUSTOMER, SEGMENT_PATCH, "raw", "p").select("c_custkey", "is_valid", "value.c_acctbal")


@_query("json_schema", """SELECT 'Props' AS name, '{"$schema":"http://json-schema.org/draft-07/schema#","additionalProperties":false,"properties":{"k":{"maximum":89,"minimum":10,"type":"integer"}},"required":["k"],"type":"object"}' AS schema""")
def schema_text(spark: SparkSession, sf: str) -> DataFrame:
    from stipule.plans.schema import json_schema_text

    return spark.createDataFrame([("Props", json_schema_text(PROPS))], "name string, schema string")


@_query("decimal_and_boolean", "SELECT event_id, event_id % 3 = 0 AS b, CAST(event_id AS DOUBLE) + 0.25 AS d FROM events")
def decimal_and_boolean(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("""'{"b": ' || (case when event_id % 3 = 0 then 'true' else 'false' end) || ', "d": "' || event_id || '.25"}'""")
    c = Contract.define("C", Field("b", Boolean), Field("d", BigDecimal))
    out = validate(_read(spark, sf, "events").select("event_id", F.parse_json(text).alias("raw")), c, "raw")
    return out.select("event_id", "value.b", F.col("value.d").cast("double").alias("d"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of the customer contract."""
    return validate_customer_violations(spark, sf)
