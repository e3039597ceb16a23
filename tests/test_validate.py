"""Validation of raw and typed records: exact violation lists."""

import pytest
from helpers import check, codes, one, patched, raw_df
from models import *  # noqa: F403
from pyspark.sql import functions as F
from stipule import Contract, Field, Float, Int, Long, String
from stipule.functions.checks import no_whitespace
from stipule.operators.compiler import Options
from stipule.operators.validate import extras_of, validate, validate_aspect_patch, validate_partial, with_validity


def test_records(spark):
    got = check(
        spark, USER,
        {"id": 1}, {"id": 1, "name": None}, {"id": 1, "name": "", "age": 200},
        {"id": 1, "name": "Carol", "email": None, "age": 25, "password": None},
        {"id": 1, "name": "A", "b": 1, "a": 2}, {"id": 1, "name": "A", "age": None}, "[1]", "not json", '{"id":1,"id":2,"name":"A"}',
    )
    assert got == [
        [("name", "MISSING")],
        [("name", "TYPE_MISMATCH")],
        [("name", "CONSTRAINT(nonEmpty)"), ("age", "CONSTRAINT(max)")],
        [],
        [("a", "UNKNOWN_FIELD"), ("b", "UNKNOWN_FIELD")],
        [("age", "TYPE_MISMATCH")],
        [("", "TYPE_MISMATCH")],
        [("", "TYPE_MISMATCH")],
        [("", "TYPE_MISMATCH")],
    ]


def test_strict_decoding(spark):
    c = Contract.define("C", Field("i", Int, optional=True), Field("s", String, optional=True), Field("f", Float, optional=True), Field("l", Long, optional=True))
    bad = lambda name: [(name, "TYPE_MISMATCH")]
    cases = [
        ({"i": 3000000000}, bad("i")), ({"i": 1.5}, bad("i")), ({"i": "30"}, []), ({"i": "+30"}, []), ({"i": " 30"}, bad("i")), ({"i": True}, bad("i")),
        ({"s": 1}, bad("s")), ({"s": True}, bad("s")), ({"f": 1}, []), ({"f": "1e3"}, []), ({"f": "x"}, bad("f")), ({"l": 3000000000}, []), ({"l": {}}, bad("l")),
    ]
    assert check(spark, c, *[r for r, _ in cases]) == [want for _, want in cases]
    jvm = check(spark, c, {"i": "30"}, {"f": 1}, {"f": 1.5}, options=Options(jvm=True))
    assert jvm == [bad("i"), bad("f"), []]


def test_nested(spark):
    assert check(
        spark, PROFILE,
        {"userId": 7, "handle": "a", "address": {"street": "", "city": "S"}}, {"userId": 7, "handle": "a", "address": {}},
        {"userId": 7, "handle": "a", "address": None}, {"userId": 7, "handle": "a", "address": 3}, {"userId": 7, "handle": "a"},
    ) == [[("address.street", "CONSTRAINT(nonEmpty)")], [("address.street", "MISSING"), ("address.city", "MISSING")], [], [("address", "TYPE_MISMATCH")], []]
    assert check(spark, ORDER, {"id": "a", "items": [{"name": "x", "qty": 0}, {"name": "", "qty": 2, "z": 1}]}, {"id": "a", "items": []}, {"id": "a", "items": [1]}) == [
        [("items.0.qty", "CONSTRAINT(min)"), ("items.1.z", "UNKNOWN_FIELD"), ("items.1.name", "CONSTRAINT(nonEmpty)")],
        [("items", "CONSTRAINT(nonEmpty)")],
        [("items", "TYPE_MISMATCH")],
    ]
    assert check(spark, SHELF, {"sku": "a", "inventory": {"warehouseId": "W", "available": 2, "reserved": 5}}) == [[("inventory", "CONSTRAINT(validateContract)")]]


def test_reserved_default_and_policies(spark):
    assert check(spark, TICKET, {"title": "t"}, {"title": "t", "trackingId": 5}) == [[], [("trackingId", "RESERVED")]]
    assert one(spark, TICKET, {"title": "t"}).value.trackingId == "PENDING"


def test_rules_run_only_after_fields_pass(spark):
    assert check(spark, STAY, {"name": "", "checkIn": 2, "checkOut": 1}, {"name": "a", "checkIn": 2, "checkOut": 1}, {"name": "a", "checkIn": 1, "checkOut": 2}) == [
        [("name", "CONSTRAINT(nonEmpty)")], [("", "CONSTRAINT(validateContract)")], [],
    ]


def test_either(spark):
    left, right, both, wrong = (one(spark, HOLDER, {"label": "x", "value": v}) for v in ({"left": "e"}, {"right": 4}, {"left": 1, "right": 4}, {"left": 1}))
    assert (left.value.value.left, right.value.value.right, both.value.value.right) == ("e", 4, 4)
    assert codes(wrong) == [("value", "TYPE_MISMATCH")]
    assert check(spark, PET, {"ownerId": "o", "pet": {"kind": "cat", "name": "c"}}, {"ownerId": "o", "pet": {"kind": "dog", "name": "d"}}, {"ownerId": "o", "pet": {"kind": "cow", "name": "d"}}) == [
        [], [("pet", "TYPE_MISMATCH")], [("pet", "TYPE_MISMATCH")],
    ]


def test_include_is_flat(spark):
    row = one(spark, DOCUMENT, {"title": "t", "createdAt": 5})
    assert (row.value.stamps.createdAt, row.value.stamps.updatedAt) == (5, 0)
    assert check(spark, DOCUMENT, {"title": "t"}, {"title": "t", "stamps": {}, "createdAt": 1}) == [[("createdAt", "MISSING")], [("stamps", "UNKNOWN_FIELD")]]


def test_wrappers_and_extraction(spark):
    assert check(spark, MEMBER, {"id": 1, "contact": "no mail"}, {"id": 1, "contact": "a@b.c"}) == [[("contact", "CONSTRAINT(email)")], []]
    row = one(spark, BOOKING, {"day": "2024-06-01", "code": "AB-1234"})
    assert (tuple(row.value.day), row.value.code.value) == ((2024, 6, 1), "AB-1234")
    assert check(spark, BOOKING, {"day": "2024-06-01x"}, {"day": "2024-06-01\n"}) == [[("day", "TYPE_MISMATCH")]] * 2
    strict = Contract.define("S", Field("w", Wrapper("W", String), optional=True, max_length=1))  # noqa: F405
    assert check(spark, strict, {"w": "long"}) == [[("w", "CONSTRAINT(maxLength)")]]
    assert check(spark, strict, {"w": "long"}, options=Options(strict_reference=True)) == [[]]


def test_collections(spark):
    row = one(spark, BAGS, {"tags": ["a", "b"], "ids": [1, 1, "2"], "sizes": {"x": 1}, "price": "1.50"})
    assert row.value.tags == ["a", "b"] and row.value.ids == [1, 2] and row.value.sizes == {"x": 1.0} and float(row.value.price) == 1.5
    assert check(spark, BAGS, {"tags": ["a", 1]}, {"ids": [1, None]}, {"sizes": {"x": "y"}}) == [[("tags", "TYPE_MISMATCH")], [("ids", "TYPE_MISMATCH")], [("sizes", "TYPE_MISMATCH")]]


def test_constraint_bounds(spark):
    c = Contract.define(
        "C", Field("s", String, optional=True, min_length=2, max_length=3), Field("n", Double, optional=True, min=1, max=5, multiple_of=0.5),  # noqa: F405
        Field("p", Int, optional=True, positive=True), Field("u", String, optional=True, url=True), Field("t", Long, optional=True, future=True), Field("q", Long, optional=True, past=True),
        Field("x", String, optional=True, extract=r"\d+"),
    )
    cases = [
        ({"s": "a"}, ["minLength"]), ({"s": "ab"}, []), ({"s": "abc"}, []), ({"s": "abcd"}, ["maxLength"]), ({"s": "😀"}, []), ({"s": "😀😀"}, ["maxLength"]),
        ({"n": 1}, []), ({"n": 0.5}, ["min"]), ({"n": 5}, []), ({"n": 5.5}, ["max"]), ({"n": 1.25}, ["multipleOf"]), ({"n": "NaN"}, []), ({"p": 0}, ["positive"]), ({"p": 1}, []),
        ({"u": "http://a"}, ["url"]), ({"u": "http://ab"}, []), ({"u": "ftp://ab"}, ["url"]), ({"t": 100}, ["future"]), ({"t": 101}, []), ({"q": 100}, ["past"]), ({"q": 99}, []), ({"x": "1a"}, ["extract"]),
    ]
    got = check(spark, c, *[r for r, _ in cases], options=Options(now=F.lit(100)))
    assert [[code for _, code in g] for g in got] == [[f"CONSTRAINT({n})" for n in want] for _, want in cases]


def test_messages(spark):
    row = one(spark, PRODUCT, {"name": "", "code": "x", "slug": "a b"})
    assert [v.message for v in row.violations] == ["'name' must not be empty", "'code' does not match required pattern", "must not contain whitespace (got 'a b')"]
    row = one(spark, USER, {"id": "x", "name": "A", "age": -1, "z": 1})
    assert [v.message for v in row.violations] == ["Unknown field 'z' (contract is closed)", "'id' has an incorrect type", "'age' must be >= 0 (got -1.0)"]
    assert no_whitespace is not None


def test_open_contracts(spark):
    df = raw_df(spark, {"key": "k", "value": "v", "source": 1, "none": None}, {"key": "k", "value": "", "x": 1})
    good, bad = validate(df, OPEN, "raw").orderBy("i").collect()
    assert {k: str(v) for k, v in good.extras.items()} == {"source": "1", "none": "null"} and bad.extras == {} and not bad.is_valid
    assert df.select(F.map_keys(extras_of(df, OPEN, "raw")).alias("k")).collect()[1].k == ["x"]


def test_partial(spark):
    df = raw_df(spark, {"name": "A"}, {"id": 3}, {"name": None}, {"zip": 1}, {"age": 500})
    rows = validate_partial(df, USER, "raw").orderBy("i").collect()
    assert [codes(r) for r in rows] == [[], [], [("name", "TYPE_MISMATCH")], [("zip", "UNKNOWN_FIELD")], [("age", "CONSTRAINT(max)")]]
    assert str(rows[0].draft) == '{"name":"A"}' and rows[2].draft is None


def test_patches(spark):
    stored = {"id": 1, "name": "A", "age": -1}
    row = patched(spark, USER, stored, {"name": "B"})
    assert row.is_valid and (row.value.name, row.value.age) == ("B", -1)  # stored fields are trusted
    assert codes(patched(spark, USER, stored, {"id": 2, "zz": 1})) == [("zz", "UNKNOWN_FIELD"), ("id", "IMMUTABLE")]
    assert codes(patched(spark, USER, {"id": "x"}, {})) == [("id", "TYPE_MISMATCH"), ("name", "MISSING")]
    assert codes(patched(spark, TICKET, {"title": "t"}, {"trackingId": "X"})) == [("trackingId", "RESERVED")]
    row = patched(spark, USER, {"id": 1, "name": "A", "email": "e"}, {"email": None})
    assert row.is_valid and row.value.email is None
    shelf = {"sku": "a", "inventory": {"warehouseId": "W", "available": 2, "reserved": 1}}
    assert codes(patched(spark, SHELF, shelf, {"inventory": {"warehouseId": "X"}})) == [("inventory.warehouseId", "IMMUTABLE")]
    assert codes(patched(spark, SHELF, shelf, {"inventory": {"reserved": 3}})) == [("inventory", "CONSTRAINT(validateContract)")]
    row = patched(spark, SHELF, shelf, {"inventory": {"available": 9}})
    assert tuple(row.value.inventory) == ("W", 9, 1)
    assert codes(patched(spark, STAY, {"name": "a", "checkIn": 5, "checkOut": 6}, {"checkOut": 2})) == [("", "CONSTRAINT(validateContract)")]
    assert codes(patched(spark, ORDER, {"id": "a", "items": [{"name": "x", "qty": 1}]}, {"items": [{"name": "y", "qty": 0}]})) == [("items.0.qty", "CONSTRAINT(min)")]


def test_aspect_patch(spark):
    aspect = USER.aspect("Patch", Field("name", String, optional=True), Field("email", String, optional=True))
    df = spark.createDataFrame([('{"id":1,"name":"A"}', p) for p in ('{"name":"B","email":null}', '{"name":""}', '{"age":1}')], "a string, b string")
    rows = validate_aspect_patch(df.select(F.parse_json("a").alias("a"), F.parse_json("b").alias("b")), USER, aspect, "a", "b").collect()
    assert [codes(r) for r in rows] == [[], [("name", "CONSTRAINT(nonEmpty)")], [("age", "UNKNOWN_FIELD")]] and rows[0].value.name == "B"
    with pytest.raises(ValueError):
        validate_aspect_patch(df, ORDER, aspect, "a", "b")


def test_typed_columns(spark):
    df = spark.createDataFrame([(1, "A", 5.5), (2, None, None)], "id long, name string, age double")
    rows = validate(df, USER).orderBy("id").collect()
    assert [codes(r) for r in rows] == [[("age", "TYPE_MISMATCH")], [("name", "MISSING")]]
    rows = validate(df.drop("age"), USER, nulls="explicit").orderBy("id").collect()
    assert [codes(r) for r in rows] == [[], [("name", "TYPE_MISMATCH")]]
    assert [r.is_valid for r in with_validity(df, USER).collect()] == [False, False]
    assert validate(df.limit(0), USER).count() == 0
    with pytest.raises(TypeError):
        validate(df, USER, "name")


def test_typed_nested(spark):
    df = spark.createDataFrame([("a", [("x", 0), ("", 2)])], "id string, items array<struct<name:string,qty:int>>")
    assert codes(validate(df, ORDER).collect()[0]) == [("items.0.qty", "CONSTRAINT(min)"), ("items.1.name", "CONSTRAINT(nonEmpty)")]


def test_custom_decoders_and_deep_includes(spark):
    from pyspark.sql import types as T
    from stipule import Custom

    day = Custom(T.DateType(), lambda v: F.try_to_date(F.try_variant_get(v, "$", "string"), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.try_variant_get(v, "$", "string").try_cast("date"))
    c = Contract.define("C", Field("d", day), Field("o", day, optional=True))
    assert check(spark, c, {"d": "2024-01-31"}, {"d": "nope"}, {"d": "2024-01-31", "o": None}, {}) == [[], [("d", "TYPE_MISMATCH")], [], [("d", "MISSING")]]
    deep = Contract.define("Deep", Field("top", Nested(DOCUMENT), include=True))  # noqa: F405
    row = one(spark, deep, {"title": "t", "stamps": {"createdAt": 1}})
    assert row.is_valid and row.value.top.stamps.createdAt == 1


def test_open_patch_keeps_extras_of_both(spark):
    row = patched(spark, OPEN, {"key": "k", "value": "v", "x": {"a": 1}}, {"value": "w", "x": {"b": 2}, "y": 3})
    assert row.is_valid and row.value.value == "w" and {k: str(v) for k, v in row.extras.items()} == {"x": '{"a":1,"b":2}', "y": "3"}
    map_patch = patched(spark, BAGS, {"sizes": {"a": 1.0}}, {"sizes": {"b": 2}})
    assert map_patch.value.sizes == {"a": 1.0, "b": 2.0}


def test_messages_of_patches(spark):
    row = patched(spark, TICKET, {"title": 3}, {"trackingId": "x", "zz": 1})
    assert [v.message for v in row.violations] == ["Unknown field 'zz'", "'trackingId' is reserved and cannot be set", "'title' in current record has an unexpected type"]
    row = patched(spark, USER, {"id": 1, "name": "A"}, {"id": 2, "name": 4})
    assert [v.message for v in row.violations] == ["'id' is immutable and cannot be changed", "'name' has an incorrect type"]


def test_plans_grow_in_proportion_to_fields(spark):
    def size(n):
        c = Contract.define("W", *[Field(f"f{i}", Int, min=0, max=9) for i in range(n)], rules=(Rule("r", lambda r: r.getField("f0") <= r.getField("f1")),))  # noqa: F405
        return len(validate(raw_df(spark, {}), c, "raw")._jdf.queryExecution().optimizedPlan().toString()), c

    (small, _), (large, _) = size(20), size(80)
    assert large < 5 * small
    wide = size(300)[1]
    out = validate(raw_df(spark, {f"f{i}": 1 for i in range(300)}, {f"f{i}": 11 for i in range(299)}), wide, "raw").orderBy("i").collect()
    assert [len(r.violations) for r in out] == [0, 300] and out[0].value.f299 == 1


def test_four_nested_levels_and_lists_of_lists(spark):
    c = Contract.define("L0", Field("a", Int, min=1))
    record = {"a": 0}
    for k in range(1, 4):
        c = Contract.define(f"L{k}", Field("a", Int, min=1), Field("n", ListOf(Nested(c)) if k != 2 else Nested(c)), rules=(Rule("a below 9", lambda r: r.getField("a") < 9),))  # noqa: F405
        record = {"a": 9 if k == 3 else 1, "n": [{**record, "a": 1}, record] if k != 2 else record}
    # Lists within lists: rules and checks of every element keep their places.
    got = check(spark, c, record, {**record, "a": 1, "n": []}, {"a": 9, "n": []})
    assert got == [[("n.0.n.n.1.a", "CONSTRAINT(min)"), ("n.1.n.n.1.a", "CONSTRAINT(min)")], [], [("", "CONSTRAINT(validateContract)")]]


def test_names_that_look_like_the_compilers_own(spark):
    df = spark.createDataFrame([(1, -1, "it's `$x` \\")], "_s0 int, e1 int, `a'b.c` string")
    c = Contract.define("N", Field("_s0", Int, min=0), Field("e1", Int, min=0), Field("a'b.c", String, pattern=r"it's `\$x` \\"))
    row = validate(df, c).collect()[0]
    assert codes(row) == [("e1", "CONSTRAINT(min)")] and row["_s0"] == 1


def test_many_checks_still_compile(spark):
    c = Contract.define("W", *[Field(f"f{i}", Int, min=0, max=9) for i in range(70)])
    df = spark.createDataFrame([(1,), (12,)], "n int").select(*[(F.col("n") if i % 2 else F.lit(-1)).alias(f"f{i}") for i in range(70)])
    before = spark.conf.get("spark.sql.codegen.fallback")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        rows = validate(df, c).select("violations").collect()
    finally:
        spark.conf.set("spark.sql.codegen.fallback", before)
    assert sorted(len(r.violations) for r in rows) == [35, 70] and all([v.path[0] for v in r.violations] == sorted([v.path[0] for v in r.violations], key=lambda p: int(p[1:])) for r in rows)
