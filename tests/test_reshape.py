"""Sanitizing, views, JSON, patches and deltas."""

import json

import pytest
from helpers import codes, raw_df
from models import *  # noqa: F403
from pyspark.sql import functions as F
from stipule import Field, Int, Nested, Patch, String, View
from stipule.functions.text import plain_double, pretty_json, render
from stipule.operators.deltas import as_map, deep_merge, difference_delta, extra_fields, right_difference, without_nulls
from stipule.operators.reshape import flatten, raw_to_json, rebuild, sanitize, sanitize_json, sanitize_raw, to_json, to_patch_raw, to_raw
from stipule.operators.updates import apply_patch, apply_to, draft_size, finalize, merge_drafts, patch_join, quarantine, violation_report
from stipule.operators.validate import validate
from stipule.sources.records import from_struct, optional_nulls_dropped, parsed, quarantined_write, read_json_lines, write_json_lines


def column(spark, c, *records):
    return [json.loads(r[0]) for r in raw_df(spark, *records).orderBy("i").select(F.to_json(c)).collect()]


def test_sanitize_raw(spark):
    clean = sanitize_raw(F.col("raw"), USER)
    assert column(spark, clean, {"id": 1, "password": None, "x": 2}, {"name": "a"}) == [{"password": "***", "x": 2}, {"name": "a"}]
    clean = sanitize_raw(F.col("raw"), INVOICE)
    left = {"payment": {"left": {"cardNumber": "1", "cvv": "2", "amount": 3}}}
    right = {"payment": {"right": {"accountRef": "1", "sortCode": "2"}}}
    assert column(spark, clean, left, right) == [{"payment": {"left": {"cardNumber": "****", "amount": 3}}}, {"payment": {"right": {"accountRef": "1"}}}]
    cart = Contract.define("Cart", Field("items", ListOf(Nested(CARD))), Field("one", Nested(CARD), optional=True))  # noqa: F405
    record = {"items": [{"cvv": "1", "amount": 2}, 5], "one": None}
    assert column(spark, sanitize_raw(F.col("raw"), cart), record) == [{"items": [{"amount": 2}, 5], "one": None}]


def test_tagged_unions_can_leak_on_request(spark):
    c = Contract.define("P", Field("p", Either(Nested(CARD), Nested(BANK), key="k", left_tag="c", right_tag="b")))  # noqa: F405
    record = {"p": {"k": "c", "cvv": "1", "amount": 2}}
    assert column(spark, sanitize_raw(F.col("raw"), c), record) == [{"p": {"k": "c", "amount": 2}}]
    assert column(spark, sanitize_raw(F.col("raw"), c, tagged=False), record) == [record]


def test_unknown_tags_hide_what_any_branch_hides(spark):
    c = Contract.define("P", Field("p", Either(Nested(CARD), Nested(BANK), key="k", left_tag="c", right_tag="b")))  # noqa: F405
    clean = {"p": {"amount": 2, "cardNumber": "****"}}
    secret = {"cvv": "1", "amount": 2, "cardNumber": "9", "sortCode": "s"}
    got = column(spark, sanitize_raw(F.col("raw"), c), {"p": {"k": "x", **secret}}, {"p": secret}, {"p": {"k": 3, **secret}}, {"p": "text"}, {"p": {"k": "b", "sortCode": "s", "amount": 2}})
    assert got == [{"p": {"k": "x", **clean["p"]}}, clean, {"p": {"k": 3, **clean["p"]}}, {"p": "text"}, {"p": {"k": "b", "amount": 2}}]


def test_sanitize_typed(spark):
    df = spark.createDataFrame([(1, "p", ("s", 2.0), 9), (2, None, None, 9)], "id long, password string, pay struct<cvv:string,amount:double>, extra int")
    c = Contract.define("C", *USER.declared, Field("pay", Nested(CARD)))  # noqa: F405
    rows = sanitize(df, c).collect()
    assert [r.asDict(True) for r in rows] == [{"password": "***", "pay": {"amount": 2.0}, "extra": 9}, {"password": "***", "pay": None, "extra": 9}]
    assert df.select(sanitize_json(df, c)).collect()[0][0] == '{"extra":9,"password":"***","pay":{"amount":2}}'


def test_views(spark):
    df = spark.createDataFrame([(1, "a")], "x int, s string")
    view = View().compute("y", lambda c: c("x") + 1).omit("x").mask("s").mask("gone").compute("z", lambda c: c("y") * 2)
    assert view.apply(df).collect()[0].asDict() == {"s": "***", "y": 2, "z": 4} and view.size() == 5 and View.empty().is_empty()
    raw = View(contract=USER).omit("id").mask("password").apply_raw(F.col("raw"))
    assert column(spark, raw, {"id": 1, "password": "p", "k": 1}, {"k": 2}) == [{"password": "***", "k": 1}, {"k": 2}]


def test_json(spark):
    df = spark.createDataFrame([((1.5, None, ['q"\n\\', None], {"b": 1, "a": None}),)], "r struct<d:double,n:string,a:array<string>,m:map<string,int>>")
    assert df.select(to_json(df, "r")).collect()[0][0] == '{"a":["q\\"\\n\\\\",null],"d":1.5,"m":{"b":1}}'
    numbers = [1e10, 1.0, 1.5e-7, float("nan"), 123456789.25, -0.0, 1e300, -2.5e-10, float("inf"), 100.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in numbers], "x double").select(plain_double(F.col("x"))).collect()]
    assert got == ["10000000000", "1", "0.00000015", None, "123456789.25", "0", "1" + "0" * 300, "-0.00000000025", None, "100"]
    assert raw_df(spark, {"z": [None, 1.50], "a": {"n": None}}).select(raw_to_json(F.col("raw"))).collect()[0][0] == '{"a":{},"z":[null,1.5]}'
    assert raw_df(spark, {"b": [1], "a": {}, "c": []}).select(pretty_json(F.to_json("raw"))).collect()[0][0] == '{\n  "a": {},\n  "b": [\n    1\n  ],\n  "c": []\n}'
    assert render({"k": "\u0001\t/é"}) == '{"k":"\\u0001\\t/é"}'


def test_records_back_to_raw(spark):
    df = validate(raw_df(spark, {"title": "t", "createdAt": 5}), DOCUMENT, "raw")
    assert json.loads(df.select(F.to_json(to_raw(F.col("value"), DOCUMENT))).collect()[0][0]) == {"title": "t", "createdAt": 5, "updatedAt": 0}
    assert json.loads(df.select(F.to_json(to_raw(F.col("value"), DOCUMENT, drop_nulls=False))).collect()[0][0])["body"] is None
    assert "body" not in json.loads(df.select(F.to_json(to_patch_raw(F.col("value"), DOCUMENT))).collect()[0][0])
    flat = flatten(df.select("value"), DOCUMENT)
    assert flat.columns == ["title", "body", "createdAt", "updatedAt"]
    assert rebuild(flat, DOCUMENT).select("value").collect()[0].value.stamps.createdAt == 5
    for record in ({"ownerId": "o", "pet": {"kind": "dog", "name": "d", "age": 2}}, {"ownerId": "o", "pet": {"kind": "cat", "name": "c", "indoor": False}}):
        out = validate(raw_df(spark, record), PET, "raw").select(F.to_json(to_raw(F.col("value"), PET)))
        assert json.loads(out.collect()[0][0]) == record
    record = {"label": "l", "value": {"right": 4}}
    assert json.loads(validate(raw_df(spark, record), HOLDER, "raw").select(F.to_json(to_raw(F.col("value"), HOLDER))).collect()[0][0]) == record


def test_deltas(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"c":1},"d":2}', '{"a":1,"b":{"c":2},"e":null}')], "x string, y string").select(F.parse_json("x").alias("x"), F.parse_json("y").alias("y"))
    got = df.select(F.to_json(right_difference(F.col("x"), F.col("y"))), F.to_json(difference_delta(F.col("x"), F.col("y"))), F.to_json(deep_merge(F.col("x"), F.col("y"))), F.map_keys(extra_fields(F.col("y"), ["a", "b"])), F.to_json(without_nulls(F.col("y")))).collect()[0]
    assert [json.loads(x) if isinstance(x, str) else x for x in got] == [{"b": {"c": 2}, "e": None}, {"b": {"c": 2}, "e": None}, {"a": 1, "b": {"c": 2}, "d": 2, "e": None}, ["e"], {"a": 1, "b": {"c": 2}}]


def test_deep_merge_never_drops_what_lies_too_deep(spark):
    df = raw_df(spark, {"a": {"b": {"c": {"d": {"e": 1, "f": 2}, "g": 5}}}})
    delta = F.parse_json(F.lit('{"a": {"b": {"c": {"d": {"e": 3}}}}}'))
    with pytest.raises(Exception, match="nest deeper"):
        df.select(F.to_json(deep_merge(F.col("raw"), delta, 4))).collect()
    assert column(spark, deep_merge(F.col("raw"), delta), {"a": {"b": {"c": {"d": {"e": 1, "f": 2}}}}}) == [{"a": {"b": {"c": {"d": {"e": 3, "f": 2}}}}}]
    flat = F.parse_json(F.lit('{"a": {"b": {"c": {"d": 7}}}}'))
    assert column(spark, deep_merge(F.col("raw"), flat), {"a": {"b": {"c": {"d": {"e": 1}, "g": 5}}}}) == [{"a": {"b": {"c": {"d": 7, "g": 5}}}}]


def test_patches(spark):
    patch = Patch.empty(USER).modify("age", lambda c: c + 1).modify("email", lambda c: F.upper(c)).set("name", "B").unset("password")
    assert patch.size() == 4 and patch.to_raw() == {"name": "B", "password": None} and Patch.from_raw({"z": 1}).put_all({"y": 2}).to_map() == {"z": 1, "y": 2}
    assert column(spark, apply_to("raw", patch), {"id": 1, "age": 3, "name": "A"}) == [{"id": 1, "age": 4, "name": "B", "password": None}]
    rows = apply_patch(raw_df(spark, {"id": 1, "age": 150, "name": "A"}, {"id": 1, "name": "B"}), USER, patch, "raw").orderBy("i").collect()
    assert [codes(r) for r in rows] == [[("age", "CONSTRAINT(max)")], []] and rows[1].value.name == "B"
    same = Patch.empty(USER).set("id", 1)  # no change, so immutability does not matter
    assert apply_patch(raw_df(spark, {"id": 1, "name": "A"}), USER, same, "raw").collect()[0].is_valid


def test_patch_join_takes_the_latest(spark):
    current = raw_df(spark, {"id": 1, "name": "A"}, {"id": 2, "name": "B"})
    patches = spark.createDataFrame([(0, '{"name":"X"}', 1), (0, '{"name":"Y"}', 2)], "i int, p string, n int").select("i", F.parse_json("p").alias("patch"), "n")
    rows = patch_join(current, patches, USER, "i", order="n").orderBy("i").collect()
    assert [r.value.name for r in rows] == ["Y", "B"]


def test_drafts(spark):
    df = spark.createDataFrame([('{"id":1,"name":"A"}', '{"name":"B"}', None)], "a string, b string, c string").select(*[F.parse_json(x).alias(x) for x in "abc"])
    merged = df.select(merge_drafts(F.col("a"), F.col("b"), F.col("c")).alias("draft"))
    assert merged.select(draft_size(F.col("draft"))).collect()[0][0] == 2
    row = finalize(merged, USER).collect()[0]
    assert row.is_valid and row.value.name == "B"


def test_reports_and_sources(spark, tmp_path):
    df = validate(parsed(spark.createDataFrame([('{"id":1}',), ("[",), ('{"id":2,"name":"x"}',)], "t string"), "t"), USER, "raw")
    assert {(r.path, r.code.split("(")[0], r.n) for r in violation_report(df).collect()} == {("name", "MISSING", 1), ("", "TYPE_MISMATCH", 1)}
    good, bad = quarantine(df)
    assert (good.count(), bad.count()) == (1, 2)
    quarantined_write(df.select("is_valid"), f"{tmp_path}/good", f"{tmp_path}/bad")
    assert spark.read.parquet(f"{tmp_path}/bad").count() == 2
    write_json_lines(good, "raw", f"{tmp_path}/lines")
    assert read_json_lines(spark, f"{tmp_path}/lines").select(F.to_json("raw")).collect()[0][0] == '{"id":2,"name":"x"}'
    assert from_struct(spark.createDataFrame([(1, None)], "a int, b string")).select(F.to_json("raw")).collect()[0][0] == '{"a":1,"b":null}'
    assert column(spark, optional_nulls_dropped(F.col("raw"), USER), {"email": None, "name": None}) == [{"name": None}]
    assert as_map is not None and Int is not None and String is not None
