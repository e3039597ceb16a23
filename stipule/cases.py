"""Queries over records made to break contracts, by a rule over the key; with the same result in SQL.

Together with ``stipule.queries`` they run every operator on rows that it decides on.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stipule.functions.checks import no_whitespace
from stipule.operators.compiler import Options
from stipule.operators.deltas import as_map, as_record, deep_merge, difference_delta
from stipule.operators.reshape import raw_to_json, sanitize, sanitize_json, sanitize_raw, to_json, to_patch_raw, to_raw
from stipule.operators.updates import apply_patch, apply_to, draft_size, merge_drafts, quarantine, violation_rows
from stipule.operators.validate import validate, validate_partial, validate_patch
from stipule.operators.violations import dotted
from stipule.plans.contract import Contract, Field, Rule
from stipule.plans.filters import Filter, matching, predicate
from stipule.plans.patch import Patch
from stipule.plans.schema import json_schema_text
from stipule.plans.types import BigDecimal, Boolean, Custom, Double, Either, Int, ListOf, Long, MapOf, Nested, String, Wrapper
from stipule.plans.view import View
from stipule.queries import BANK, CARD, CUSTOMER, FILTERS, PAID, PAID_TEXT, _customers, _paths, _query, _raw_events, _read, _EVENT_CASES
from stipule.sources.records import optional_nulls_dropped
from stipule.streaming.flows import accumulated_drafts, validated, violation_counts

#: The place of a line separator, which JSON leaves as it is.
SEPARATOR = "\u2028"


def _events(spark: SparkSession, sf: str, text: str, name: str = "raw") -> DataFrame:
    """Events with a record from a SQL text."""
    return _read(spark, sf, "events").select("event_id", F.parse_json(F.expr(text)).alias(name))


# Constraints and policies that fail ------------------------------------------

TICKET = Contract.define("Ticket", Field("tracking", String, default="PENDING", reserved=True), Field("title", String, non_empty=True), Field("note", String, optional=True, max_length=5))
TICKET_TEXT = """case event_id % 4 when 0 then '{"title": "", "tracking": "x"}' when 1 then '{"title": "t", "tracking": null}'
 when 2 then '{"title": "t", "note": "abcdef"}' else '{"title": "t", "note": "abcde"}' end"""


@_query(
    "reserved_empty_long",
    """
SELECT event_id, path, code FROM (
  SELECT event_id, 'tracking' path, 'RESERVED' code FROM events WHERE event_id % 4 IN (0, 1)
  UNION ALL SELECT event_id, 'title', 'CONSTRAINT(nonEmpty)' FROM events WHERE event_id % 4 = 0
  UNION ALL SELECT event_id, 'note', 'CONSTRAINT(maxLength)' FROM events WHERE event_id % 4 = 2)""",
)
def reserved_empty_long(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(validate(_events(spark, sf, TICKET_TEXT), TICKET, "raw"), "event_id")


@_query("reserved_defaults", "SELECT event_id, 'PENDING' AS tracking FROM events WHERE event_id % 4 = 3")
def reserved_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return validate(_events(spark, sf, TICKET_TEXT), TICKET, "raw").where("is_valid").select("event_id", "value.tracking")


@_query(
    "reserved_in_drafts_and_patches",
    """
SELECT event_id, how, 'RESERVED' AS code FROM events, (VALUES ('draft'), ('patch')) v(how) WHERE event_id % 4 IN (0, 1)
UNION ALL SELECT event_id, how, 'CONSTRAINT(nonEmpty)' FROM events, (VALUES ('draft'), ('patch')) v(how) WHERE event_id % 4 = 0
UNION ALL SELECT event_id, how, 'CONSTRAINT(maxLength)' FROM events, (VALUES ('draft'), ('patch')) v(how) WHERE event_id % 4 = 2""",
)
def reserved_in_drafts_and_patches(spark: SparkSession, sf: str) -> DataFrame:
    df = _events(spark, sf, TICKET_TEXT).withColumn("now", F.parse_json(F.lit('{"title": "old"}')))
    draft, patch = validate_partial(df, TICKET, "raw"), validate_patch(df, TICKET, "now", "raw")
    one = lambda out, how: _paths(out, "event_id").select("event_id", F.lit(how).alias("how"), "code")
    return one(draft, "draft").unionByName(one(patch, "patch"))


@_query(
    "empty_collections",
    """
SELECT event_id, path, 'CONSTRAINT(nonEmpty)' AS code FROM (
  SELECT event_id, 'l' path FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'm' FROM events WHERE event_id % 3 = 0)""",
)
def empty_collections(spark: SparkSession, sf: str) -> DataFrame:
    c = Contract.define("C", Field("l", ListOf(Int), non_empty=True), Field("m", MapOf(Int), non_empty=True))
    text = """'{"l": ' || case when event_id % 2 = 0 then '[]' else '[1]' end || ', "m": ' || case when event_id % 3 = 0 then '{}' else '{"a": 1}' end || '}'"""
    return _paths(validate(_events(spark, sf, text), c, "raw"), "event_id")


@_query(
    "validators_and_extracts",
    """
SELECT event_id, 'CONSTRAINT(validateWith)' AS code, 'must not contain whitespace (got ''a ' || event_id || ''')' AS message FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'CONSTRAINT(extract)', '''e'' does not match required format' FROM events WHERE event_id % 5 = 0""",
)
def validators_and_extracts(spark: SparkSession, sf: str) -> DataFrame:
    c = Contract.define("C", Field("s", String, validators=(no_whitespace,)), Field("e", String, extract=r"[a-z]+-\d+"))
    text = """'{"s": "a' || case when event_id % 3 = 0 then ' ' else '' end || event_id || '", "e": "k' || case when event_id % 5 = 0 then '' else '-' end || event_id || '"}'"""
    return violation_rows(validate(_events(spark, sf, text), c, "raw"), "event_id").select("event_id", "code", "message")


@_query("custom_decoder", "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN DATE '2024-01-01' + CAST(event_id % 28 AS INT) END AS day FROM events")
def custom_decoder(spark: SparkSession, sf: str) -> DataFrame:
    day = Custom(T.DateType(), lambda v: F.try_variant_get(v, "$", "string").try_cast("date"))
    c = Contract.define("C", Field("d", day), Field("more", ListOf(day), optional=True))
    text = """case when event_id % 4 = 0 then '{"d": "no day"}' else '{"d": "' || string(date_add(date'2024-01-01', int(event_id % 28))) || '", "more": ["2024-01-01"]}' end"""
    return validate(_events(spark, sf, text), c, "raw").select("event_id", F.col("value.d").alias("day"))


INNER = Contract.define("Inner", Field("a", Int, min=1), Field("b", String, optional=True))
OUTER = Contract.define("Outer", Field("n", Nested(INNER)), Field("list", ListOf(Nested(INNER)), optional=True), rules=(Rule("a is two", lambda r: r.getField("n").getField("a") != 2),))


@_query(
    "nested_codes",
    """
SELECT event_id, path, code FROM (
  SELECT event_id, 'n.a' path, 'MISSING' code FROM events WHERE event_id % 5 = 0
  UNION ALL SELECT event_id, 'n', 'TYPE_MISMATCH(declared type,BIGINT)' FROM events WHERE event_id % 5 = 1
  UNION ALL SELECT event_id, 'list.1.a', 'CONSTRAINT(min)' FROM events WHERE event_id % 5 = 2
  UNION ALL SELECT event_id, 'list.0.z', 'UNKNOWN_FIELD' FROM events WHERE event_id % 5 = 2
  UNION ALL SELECT event_id, '', 'CONSTRAINT(validateContract)' FROM events WHERE event_id % 5 = 3)""",
)
def nested_codes(spark: SparkSession, sf: str) -> DataFrame:
    text = """case event_id % 5 when 0 then '{"n": {"b": "x"}}' when 1 then '{"n": 3}' when 2 then '{"n": {"a": 1}, "list": [{"a": 1, "z": 2}, {"a": 0}]}'
     when 3 then '{"n": {"a": 2}}' else '{"n": {"a": 1}, "list": []}' end"""
    return _paths(validate(_events(spark, sf, text), OUTER, "raw"), "event_id")


WIDE = Contract.define("Wide", *[Field(f"f{i}", Int, min=0, max=9) for i in range(60)], rules=(Rule("f1 above f0", lambda r: r.getField("f1") >= r.getField("f0")),))


@_query(
    "wide_contract",
    """
SELECT event_id, path, code FROM (
  SELECT event_id, 'f' || event_id % 60 path, 'CONSTRAINT(max)' code FROM events WHERE event_id % 2 = 0
  UNION ALL SELECT event_id, '', 'CONSTRAINT(validateContract)' FROM events WHERE event_id % 2 = 1 AND event_id % 3 = 0)""",
)
def wide_contract(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    value = lambda i: F.when((k % 2 == 0) & (k % 60 == i), 10).when((k % 2 == 1) & (k % 3 == 0) & F.lit(i == 0), 5).otherwise(4)
    df = _read(spark, sf, "events").select("event_id", *[value(i).alias(f"f{i}") for i in range(60)])
    return _paths(validate(df, WIDE), "event_id")


# Patches and open contracts ----------------------------------------------------


@_query("list_patch", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'list.0.a' ELSE '' END AS path, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS kept FROM events")
def list_patch(spark: SparkSession, sf: str) -> DataFrame:
    text = """case event_id % 3 when 0 then '{"list": [{"a": 0}]}' when 1 then '{"list": [{"a": 7}]}' else '{"n": {"b": "y"}}' end"""
    df = _events(spark, sf, text).withColumn("now", F.parse_json(F.lit('{"n": {"a": 1}, "list": [{"a": 1}, {"a": 3}]}')))
    out = validate_patch(df, OUTER, "now", "raw")
    path = F.coalesce(dotted(F.try_element_at("violations", F.lit(1))), F.lit(""))
    return out.select("event_id", path.alias("path"), F.greatest(F.lit(0), F.coalesce(F.size("value.list"), F.lit(0))).alias("kept"))


OPEN = Contract.define("Open", Field("key", String), Field("value", String, non_empty=True), open=True)


@_query("open_extras", """SELECT event_id, event_id % 2 = 1 AS is_valid, CASE WHEN event_id % 2 = 1 THEN '{"none":null,"x":' || event_id || '}' ELSE '{}' END AS extras FROM events""")
def open_extras(spark: SparkSession, sf: str) -> DataFrame:
    text = """'{"key": "k", "x": ' || event_id || ', "none": null, "value": "' || case when event_id % 2 = 1 then 'v' else '' end || '"}'"""
    return validate(_events(spark, sf, text), OPEN, "raw").select("event_id", "is_valid", F.to_json(as_record(F.col("extras"))).alias("extras"))


@_query("open_patch_extras", """SELECT event_id, '{"x":{"a":1,"b":' || event_id || '},"y":3}' AS extras, 'w' AS value FROM events""")
def open_patch_extras(spark: SparkSession, sf: str) -> DataFrame:
    text = """'{"value": "w", "x": {"b": ' || event_id || '}, "y": 3}'"""
    df = _events(spark, sf, text).withColumn("now", F.parse_json(F.lit('{"key": "k", "value": "v", "x": {"a": 1, "b": 0}}')))
    out = validate_patch(df, OPEN, "now", "raw")
    return out.select("event_id", F.to_json(as_record(F.col("extras"))).alias("extras"), "value.value")


@_query("patch_unset", """SELECT event_id, event_id % 2 = 0 AS is_valid, CASE WHEN event_id % 2 = 0 THEN '{"n":{"a":1},"list":null}' ELSE '{"list":[],"n":null}' END AS shown FROM events""".replace('{"n":{"a":1},"list":null}', '{"list":null,"n":{"a":1}}'))
def patch_unset(spark: SparkSession, sf: str) -> DataFrame:
    df = _read(spark, sf, "events").select("event_id", F.parse_json(F.lit('{"n": {"a": 1}, "list": []}')).alias("raw"))
    even, odd = (Patch.empty(OUTER).unset(name) for name in ("list", "n"))
    one = lambda patch, part: apply_patch(df.where(part), OUTER, patch, "raw").select("event_id", "is_valid", F.to_json(apply_to("raw", patch)).alias("shown"))
    return one(even, "event_id % 2 = 0").unionByName(one(odd, "event_id % 2 = 1"))


@_query("patch_surface", "SELECT 2 AS size, false AS empty, '{\"a\":1}' AS shown, 3 AS more, true AS nothing, 'c_name' AS selected, false AS nested")
def patch_surface(spark: SparkSession, sf: str) -> DataFrame:
    patch = Patch.from_raw({"a": 1}).modify("b", lambda c: c)
    nested = hasattr(CUSTOMER.f, "c_name.x") or hasattr(CUSTOMER.f, "nothing")
    row = (patch.size(), patch.is_empty(), json.dumps(patch.to_raw(), separators=(",", ":")), patch.put_all({"c": 2, "a": 0}).size(), Patch.empty().is_empty(), CUSTOMER.f.c_name, nested)
    return spark.createDataFrame([row], "size int, empty boolean, shown string, more int, nothing boolean, selected string, nested boolean")


@_query("view_surface", "SELECT r_regionkey, '***' AS r_name, 3 AS size, false AS empty FROM region")
def view_surface(spark: SparkSession, sf: str) -> DataFrame:
    view = View.of().mask("r_name").omit("r_comment").compute("size", lambda _: F.lit(3))
    return view.apply(_read(spark, sf, "region")).select("r_regionkey", "r_name", "size", F.lit(view.is_empty()).alias("empty"))


# Unions and sanitizing ---------------------------------------------------------

INVOICE = Contract.define("Invoice", Field("id", Int), Field("by", Either(Nested(CARD), Nested(BANK))), Field("last", Nested(BANK), optional=True))
INVOICE_TEXT = """case event_id % 3 when 0 then '{"id": 1, "by": {"left": {"number": "n", "amount": 3}}, "last": {"account": "a", "code": "s"}}'
 when 1 then '{"id": 1, "by": {"right": {"account": "a", "code": "s"}}, "last": null}' else '{"id": 1, "by": {"right": {"account": "b", "code": "s"}}}' end"""


@_query(
    "plain_union_sanitized",
    """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"by":{"left":{"amount":3,"number":"****"}},"id":1,"last":{"account":"a"}}' WHEN 1 THEN '{"by":{"right":{"account":"a"}},"id":1,"last":null}'
 ELSE '{"by":{"right":{"account":"b"}},"id":1}' END AS json FROM events""",
)
def plain_union_sanitized(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf, INVOICE_TEXT).select("event_id", F.to_json(sanitize_raw(F.col("raw"), INVOICE)).alias("json"))


@_query(
    "typed_union_sanitized",
    """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"by":{"left":{"amount":3,"number":"****"}},"id":1,"last":{"account":"a"}}' WHEN 1 THEN '{"by":{"right":{"account":"a"}},"id":1}'
 ELSE '{"by":{"right":{"account":"b"}},"id":1}' END AS json FROM events""",
)
def typed_union_sanitized(spark: SparkSession, sf: str) -> DataFrame:
    out = validate(_events(spark, sf, INVOICE_TEXT), INVOICE, "raw").select("event_id", "value.*")
    clean = sanitize(out, INVOICE).withColumn("r", F.struct("id", "by", "last"))
    return clean.select("event_id", to_json(clean, "r").alias("json"))


@_query(
    "unions_to_raw",
    """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"by":{"amount":3,"kind":"card","number":"n' || event_id || '"},"id":1}' WHEN 1 THEN '{"by":{"account":"a' || event_id || '","code":"s","kind":"bank"},"id":1}' END AS tagged,
 CASE event_id % 3 WHEN 0 THEN '{"by":{"left":{"amount":3,"number":"n"}},"id":1,"last":{"account":"a","code":"s"}}' WHEN 1 THEN '{"by":{"right":{"account":"a","code":"s"}},"id":1}'
 ELSE '{"by":{"right":{"account":"b","code":"s"}},"id":1}' END AS plain FROM events""",
)
def unions_to_raw(spark: SparkSession, sf: str) -> DataFrame:
    df = _read(spark, sf, "events").select("event_id", F.parse_json(F.expr(PAID_TEXT)).alias("a"), F.parse_json(F.expr(INVOICE_TEXT)).alias("b"))
    out = validate(df, PAID, "a").withColumnRenamed("value", "one").drop("is_valid", "violations")
    out = validate(out, INVOICE, "b")
    return out.select("event_id", F.to_json(to_raw(F.col("one"), PAID)).alias("tagged"), F.to_json(to_raw(F.col("value"), INVOICE)).alias("plain"))


@_query("patch_of_records", """SELECT event_id, CASE event_id % 5 WHEN 4 THEN '{"list":[],"n":{"a":1}}' WHEN 3 THEN '{"n":{"a":2}}' ELSE '{"n":{"a":1}}' END AS patch FROM events WHERE event_id % 5 IN (1, 2, 4)""")
def patch_of_records(spark: SparkSession, sf: str) -> DataFrame:
    text = """case event_id % 5 when 0 then '{"n": {}}' when 3 then '{"n": {"a": 2}}' when 4 then '{"n": {"a": 1}, "list": []}' else '{"n": {"a": 1}, "list": null}' end"""
    out = validate(_events(spark, sf, text), OUTER, "raw").where("is_valid")
    return out.select("event_id", F.to_json(to_patch_raw(F.col("value"), OUTER)).alias("patch"))


@_query("optional_nulls_dropped", """SELECT event_id, CASE event_id % 2 WHEN 0 THEN '{"n":null,"z":null}' ELSE '{"list":[1],"n":1}' END AS json FROM events""")
def nulls_dropped(spark: SparkSession, sf: str) -> DataFrame:
    text = """case event_id % 2 when 0 then '{"n": null, "list": null, "z": null}' else '{"n": 1, "list": [1]}' end"""
    return _events(spark, sf, text).select("event_id", F.to_json(optional_nulls_dropped(F.col("raw"), OUTER)).alias("json"))


# Filters -------------------------------------------------------------------------


@_query("filter_text_of_numbers", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey < 10")
def filter_text_of_numbers(spark: SparkSession, sf: str) -> DataFrame:
    f = Filter()
    numbers = f.field("c_acctbal").contains("5") | f.field("c_custkey").starts_with("1") | f.field("c_nationkey").matches(r"\d+")
    return matching(_read(spark, sf, "customer"), numbers | f.field("c_mktsegment").equal_to("BUILDING") | ~f.field("c_custkey").gte(10)).select("c_custkey")


_TEXTS = """case event_id % 5 when 0 then '{"k": "30"}' when 1 then '{"k": 30}' when 2 then '{"k": null}' when 3 then '{}' else '{"k": ' || event_id || '}' end"""


@_query(
    "filter_jvm_raw",
    """
SELECT event_id, event_id % 5 = 0 AS text, event_id % 5 = 1 OR event_id = 30 AND event_id % 5 = 4 AS number, event_id % 5 IN (0, 1) OR event_id = 30 AND event_id % 5 = 4 AS either, event_id % 5 = 2 AS nothing,
 event_id % 5 <> 0 AS other, event_id % 5 = 0 AS starts, event_id % 5 = 1 OR event_id % 5 = 4 AND event_id >= 18 AS above, event_id % 5 IN (0, 1, 4) AS there FROM events""",
)
def filter_jvm_raw(spark: SparkSession, sf: str) -> DataFrame:
    c = Contract.define("K", Field("k", Int))
    df, k = _events(spark, sf, _TEXTS), Filter(c, jvm=True).field("k")
    tests = {"text": k.equal_to("30"), "number": k.equal_to(30), "either": k.in_(["30", 30]), "nothing": k.equal_to(None), "other": k.not_equal_to("30"), "starts": k.starts_with("3"), "above": k.gte(18), "there": k.exists()}
    return df.select("event_id", *[predicate(df, e, c, "raw", jvm=True).alias(n) for n, e in tests.items()])


@_query(
    "filter_decoded_raw",
    """
SELECT event_id, event_id % 5 IN (0, 1) OR event_id = 30 AND event_id % 5 = 4 AS same, event_id % 5 IN (0, 1) OR event_id % 5 = 4 AND event_id >= 18 AS above,
 event_id % 5 = 0 AS text, event_id % 5 NOT IN (0, 1, 4) AS gone FROM events""",
)
def filter_decoded_raw(spark: SparkSession, sf: str) -> DataFrame:
    c = Contract.define("K", Field("k", Int))
    df, k = _events(spark, sf, _TEXTS), Filter(c).field("k")
    tests = {"same": k.equal_to(30), "above": k.gte(18), "text": k.contains("30"), "gone": k.not_exists()}
    return df.select("event_id", *[predicate(df, e, c, "raw").alias(n) for n, e in tests.items()])


#: Filters as documents; keys are those of ``FILTERS``, and three with characters that patterns know.
MONGO = {
    "exists": '{"bal": {"$exists": true}}', "ne": '{"bal": {"$ne": 0.0}}', "gte": '{"bal": {"$gte": 5000.0}}', "in": '{"c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}}',
    "not_in": '{"c_mktsegment": {"$nin": ["BUILDING", "MACHINERY"]}}', "contains": '{"c_name": {"$regex": "\\\\Q#00000001\\\\E"}}', "and": '{"c_mktsegment": "BUILDING", "bal": {"$gt": 0.0}}',
    "or": '{"$or": [{"c_mktsegment": "BUILDING"}, {"bal": {"$gt": 0.0}}]}', "not_gt": '{"$nor": [{"bal": {"$gt": 0.0}}]}', "jvm_number": '{"bal": {"$gte": 5000.0}}',
    "quoted": '{"a": {"$regex": "^\\\\Qx\\\\E\\\\\\\\E\\\\Qy\\\\E"}}', "anchored": '{"a": {"$regex": "^b.$"}}', "both": '{"$and": [{"a": {"$gt": 1}}, {"a": {"$lt": 5}}]}',
}


@_query("mongo_queries", " UNION ALL ".join(f"SELECT '{n}' AS name, '{t}' AS document" for n, t in MONGO.items()))
def mongo_queries(spark: SparkSession, sf: str) -> DataFrame:
    a = Filter().field("a")
    made = {n: e for n, (e, _) in FILTERS.items()} | {"quoted": a.starts_with("x\\Ey"), "anchored": a.matches("b."), "both": a.gt(1) & a.lt(5)}
    return spark.createDataFrame([(n, json.dumps(made[n].to_mongo_query())) for n in MONGO], "name string, document string")


# JSON and schemas ------------------------------------------------------------------


@_query("json_separators", f"""SELECT event_id, '{{"k":1,"s":"a' || chr(8232) || 'b' || chr(133) || event_id || '{SEPARATOR}\\u001f\\u000b\\\\u001F\\"\\n"}}' AS json FROM events""")
def json_separators(spark: SparkSession, sf: str) -> DataFrame:
    s = F.concat(F.lit("a\u2028b\x85"), F.col("event_id").cast("string"), F.lit(SEPARATOR + '\x1f\x0b\\u001F"\n'))
    df = _read(spark, sf, "events").select("event_id", F.struct(s.alias("s"), F.lit(1).alias("k")).alias("r"))
    return df.select("event_id", to_json(df, "r").alias("json"))


@_query(
    "json_raw_numbers",
    """
SELECT event_id, '{"a":12345678901234567890.5,"b":10000000000,"c":null,"d":"NaN","e":' || event_id || '.25,"f":0.00000015}' AS json FROM events""",
)
def json_raw_numbers(spark: SparkSession, sf: str) -> DataFrame:
    held = {"a": "cast('12345678901234567890.50' as decimal(38,2))", "b": "1.0E10D", "c": "double('Infinity')", "d": "'NaN'", "e": "event_id + 0.250", "f": "1.5E-7D"}
    raw = F.to_variant_object(F.struct(*[F.expr(x).alias(n) for n, x in held.items()]))
    return _read(spark, sf, "events").select("event_id", raw_to_json(raw).alias("json"))


@_query(
    "json_pretty",
    """
SELECT event_id, '{' || chr(10) || '  "a": [' || chr(10) || '    1,' || chr(10) || '    null' || chr(10) || '  ],' || chr(10) || '  "b": {},' || chr(10) || '  "c": [],' || chr(10) || '  "n": ' || event_id || chr(10) || '}' AS json,
 '{' || chr(10) || '  "c_name": "***",' || chr(10) || '  "k": 1' || chr(10) || '}' AS clean FROM events""",
)
def json_pretty(spark: SparkSession, sf: str) -> DataFrame:
    c = Contract.define("P", Field("c_name", String, masked="***"), Field("s", String, internal=True), open=True)
    df = _events(spark, sf, """'{"n": ' || event_id || ', "c": [], "b": {"x": null}, "a": [1, null], "z": null}'""").withColumn("two", F.parse_json(F.lit('{"k": 1, "c_name": "n", "s": "t"}')))
    return df.select("event_id", raw_to_json(F.col("raw"), 2).alias("json"), sanitize_json(df, c, "two", 2).alias("clean"))


@_query("json_pretty_records", "SELECT n_nationkey, '{' || chr(10) || ' \"k\": ' || n_nationkey || ',' || chr(10) || ' \"l\": []' || chr(10) || '}' AS json FROM nation")
def json_pretty_records(spark: SparkSession, sf: str) -> DataFrame:
    df = _read(spark, sf, "nation").select("n_nationkey", F.struct(F.array().cast("array<int>").alias("l"), F.col("n_nationkey").alias("k")).alias("r"))
    return df.select("n_nationkey", to_json(df, "r", 1).alias("json"))


SCHEMAS = {
    "Full": (
        Contract.define(
            "Full", Field("id", Long, immutable=True, internal=True), Field("name", String, non_empty=True, max_length=9, pattern="[a-z]+"), Field("mail", Wrapper("Mail", String), optional=True, email=True, masked="#"),
            Field("price", BigDecimal, default=1), Field("rate", Double, optional=True, multiple_of=0.5, positive=True), Field("on", Boolean, default=True, reserved=True), Field("at", Long, optional=True, past=True),
        ),
        '{"$schema":"http://json-schema.org/draft-07/schema#","additionalProperties":false,"properties":{"at":{"type":"integer","x-past":true},"id":{"type":"integer","x-immutable":true,"x-internal":true},'
        '"mail":{"format":"email","type":"string","x-masked":"#"},"name":{"maxLength":9,"minLength":1,"pattern":"[a-z]+","type":"string"},"on":{"type":"boolean","x-reserved":true},"price":{"type":"number"},'
        '"rate":{"exclusiveMinimum":0,"multipleOf":0.5,"type":"number"}},"required":["id","name"],"type":"object"}',
    ),
    "Outer": (
        OUTER,
        '{"$schema":"http://json-schema.org/draft-07/schema#","additionalProperties":false,"properties":{"list":{},"n":{"additionalProperties":false,"properties":{"a":{"minimum":1,"type":"integer"},"b":{"type":"string"}},'
        '"required":["a"],"type":"object"}},"required":["n"],"type":"object"}',
    ),
    "Open": (OPEN, '{"$schema":"http://json-schema.org/draft-07/schema#","properties":{"key":{"type":"string"},"value":{"minLength":1,"type":"string"}},"required":["key","value"],"type":"object"}'),
}


@_query("json_schemas", " UNION ALL ".join(f"SELECT '{n}' AS name, '{t}' AS schema, 1 + length('{t}') > 0 AS laid_out" for n, (_, t) in SCHEMAS.items()))
def json_schemas(spark: SparkSession, sf: str) -> DataFrame:
    laid_out = lambda c: json.loads(json_schema_text(c, 2)) == json.loads(json_schema_text(c)) and "\n  " in json_schema_text(c, 2)
    return spark.createDataFrame([(n, json_schema_text(c), laid_out(c)) for n, (c, _) in SCHEMAS.items()], "name string, schema string, laid_out boolean")


# Deltas, drafts, aspects, reports ------------------------------------------------------


@_query("deep_merge_deep", """SELECT event_id, '{"a":{"b":{"c":{"d":{"e":{"f":{"g":' || event_id || ',"keep":1},"l":[2]}}}}}}' AS json FROM events""")
def deep_merge_deep(spark: SparkSession, sf: str) -> DataFrame:
    base = F.parse_json(F.lit('{"a": {"b": {"c": {"d": {"e": {"f": {"g": 0, "keep": 1}, "l": [1, {"x": 1}]}}}}}}'))
    df = _events(spark, sf, """'{"a": {"b": {"c": {"d": {"e": {"f": {"g": ' || event_id || '}, "l": [2]}}}}}}'""")
    return df.select("event_id", F.to_json(deep_merge(base, F.col("raw"))).alias("json"))


@_query("difference_of_records", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"b":{"c":2}}' ELSE '{"d":null}' END AS delta FROM events""")
def difference_of_records(spark: SparkSession, sf: str) -> DataFrame:
    df = _events(spark, sf, """case when event_id % 2 = 0 then '{"a": 1, "b": {"c": 2}}' else '{"a": 1, "b": {"c": 1, "x": 0}, "d": null}' end""")
    return df.select("event_id", F.to_json(difference_delta(F.parse_json(F.lit('{"b": {"x": 0, "c": 1}, "a": 1}')), F.col("raw"))).alias("delta"))


@_query("draft_sizes", "SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS INT) AS size, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS merged FROM events")
def draft_sizes(spark: SparkSession, sf: str) -> DataFrame:
    df = _events(spark, sf, """case event_id % 3 when 0 then '{"title": "t", "note": "n"}' when 1 then '{"note": "n"}' else '{"other": 1}' end""")
    out = validate_partial(df, TICKET, "raw").withColumn("twice", merge_drafts(F.col("draft"), F.lit(None).cast("variant"), F.col("draft")))
    return out.select("event_id", draft_size(F.col("draft")).alias("size"), draft_size(F.col("twice")).alias("merged"))


ALL = CUSTOMER.aspect("All", Field("c_acctbal", Double, max=500), Field("c_mktsegment", String), Field("label", String, optional=True), inherit="all", exclude=("c_custkey", "c_name", "c_nationkey"))


@_query(
    "aspect_of_all",
    """
SELECT c_custkey, path, code FROM (
  SELECT c_custkey, 'c_acctbal' path, 'CONSTRAINT(min)' code FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'c_acctbal', 'CONSTRAINT(max)' FROM customer WHERE c_acctbal > 500
  UNION ALL SELECT c_custkey, 'c_mktsegment', 'CONSTRAINT(pattern)' FROM customer WHERE NOT regexp_full_match(c_mktsegment, '[A-M].*'))""",
)
def aspect_of_all(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(validate(_read(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), ALL), "c_custkey")


def _refused(make) -> bool:
    try:
        make()
    except (ValueError, KeyError, AttributeError):
        return True
    return False


@_query("definitions_refused", "SELECT * FROM (VALUES ('exclude without all', true), ('left out', true), ('unknown exclude', true), ('no fields', true), ('nested selector', true), ('unknown field', true), ('fine', false)) v(what, refused)")
def definitions_refused(spark: SparkSession, sf: str) -> DataFrame:
    own = Field("c_name", String)
    tried = {
        "exclude without all": lambda: CUSTOMER.aspect("A", own, exclude=("c_acctbal",)), "left out": lambda: CUSTOMER.aspect("A", own, inherit="all"),
        "unknown exclude": lambda: CUSTOMER.aspect("A", own, inherit="all", exclude=("zzz",)), "no fields": lambda: CUSTOMER.aspect("A"),
        "nested selector": lambda: OUTER.f.n.a, "unknown field": lambda: Filter(CUSTOMER).field("zzz"), "fine": lambda: CUSTOMER.aspect("A", own),
    }
    return spark.createDataFrame([(n, _refused(f)) for n, f in tried.items()], "what string, refused boolean")


@_query("fields_of_contracts", "SELECT * FROM (VALUES ('tracking', 0, false, true), ('title', 1, true, false), ('note', 2, false, false)) v(name, place, required, reserved)")
def fields_of_contracts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(f.name, k, f.required, f.reserved) for k, f in enumerate(TICKET.fields)], "name string, place int, required boolean, reserved boolean")


@_query(
    "violation_texts",
    """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS n,
 CASE event_id % 4 WHEN 0 THEN 'tracking:''tracking'' is reserved and cannot be set;title:''title'' must not be empty' WHEN 1 THEN 'tracking:''tracking'' is reserved and cannot be set'
 WHEN 2 THEN 'note:''note'' must be at most 5 characters (got 6)' ELSE '' END AS said, event_id % 4 = 3 AS kept FROM events""",
)
def violation_texts(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = quarantine(validate(_events(spark, sf, TICKET_TEXT), TICKET, "raw"))
    said = F.array_join(F.transform("violations", lambda v: F.concat(dotted(v), F.lit(":"), v["message"])), ";")
    one = lambda df, kept: df.select("event_id", F.size("violations").alias("n"), said.alias("said"), F.lit(kept).alias("kept"))
    return one(good, True).unionByName(one(bad, False))


@_query("jvm_lists", "SELECT event_id, event_id % 2 = 0 AS is_valid, CASE WHEN event_id % 2 = 0 THEN 2 END AS n FROM events")
def jvm_lists(spark: SparkSession, sf: str) -> DataFrame:
    df = _events(spark, sf, """case when event_id % 2 = 0 then '{"n": {"a": 1}, "list": [{"a": 1}, {"a": 2}]}' else '{"n": {"a": "1"}, "list": []}' end""")
    out = validate(df, OUTER, "raw", options=Options(jvm=True))
    return out.select("event_id", "is_valid", F.size("value.list").alias("n"))


# Streams ----------------------------------------------------------------------------------


def _streamed(df: DataFrame, mode: str) -> DataFrame:
    """The result table of a stream that runs until all input is read."""
    spark = df.sparkSession
    name = f"stream_{os.urandom(8).hex()}"
    q = df.writeStream.outputMode(mode).format("memory").queryName(name)
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        q = q.option("checkpointLocation", f"{folder.rstrip('/')}/{name}")
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = _read(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf}/{name}.parquet*")


@_query(
    "stream_violations",
    f"""
WITH e AS ({_EVENT_CASES.replace("FROM events", ", ts FROM events").replace("AS t , ts", "AS t, ts").replace("SELECT event_id, t,", "SELECT event_id, ts, t,")})
SELECT path, code, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT 'z' AS path, 'UNKNOWN_FIELD' AS code, count(*) n FROM e WHERE json_exists(t, '$.z')
  UNION ALL SELECT 'k', 'MISSING', count(*) FROM e WHERE NOT json_exists(t, '$.k')
  UNION ALL SELECT 'k', 'TYPE_MISMATCH(declared type,null)', count(*) FROM e WHERE kind = 'NULL'
  UNION ALL SELECT 'k', 'TYPE_MISMATCH(declared type,DECIMAL)', count(*) FROM e WHERE kind = 'DOUBLE'
  UNION ALL SELECT 'k', 'CONSTRAINT(min)', count(*) FROM e WHERE kind NOT IN ('NULL', 'DOUBLE') AND TRY_CAST(k AS INT) < 10
  UNION ALL SELECT 'k', 'CONSTRAINT(max)', count(*) FROM e WHERE kind NOT IN ('NULL', 'DOUBLE') AND TRY_CAST(k AS INT) > 89) GROUP BY ALL HAVING sum(n) > 0""",
)
def stream_violations(spark: SparkSession, sf: str) -> DataFrame:
    from stipule.queries import PROPS, RAW_TEXT

    events = _stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.try_parse_json(F.expr(RAW_TEXT)).alias("raw"))
    counts = _streamed(violation_counts(validated(events, PROPS, "raw"), "ts", "1 hour"), "complete")
    return counts.groupBy("path", "code").agg(F.sum("n").alias("n"))


@_query("stream_drafts", """SELECT c_custkey, '{"a":' || CASE WHEN c_custkey % 3 = 0 THEN c_nationkey ELSE 1 END || ',"b":"x"}' AS draft, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS rejected FROM customer""")
def stream_drafts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    later = F.when(k % 3 == 0, F.concat(F.lit('{"a": '), F.col("c_nationkey").cast("string"), F.lit("}"))).otherwise('{"b": "x"}')
    parts = F.array(F.struct(F.lit(1).alias("at"), F.lit('{"a": 1, "b": "x"}').alias("part")), F.struct(F.lit(2).alias("at"), later.alias("part")), F.struct(F.lit(3).alias("at"), F.when(k % 4 == 0, "no json").alias("part")))
    stream = _stream(spark, sf, "customer").select(k, F.explode(parts).alias("p")).select("c_custkey", "p.*")
    out = _streamed(accumulated_drafts(stream, "c_custkey", "part", "at"), "update")
    return out.groupBy("c_custkey").agg(F.max_by("draft", F.length("draft")).alias("draft"), F.sum("rejected").cast("int").alias("rejected"))
