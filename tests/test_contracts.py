"""Definitions: aspects, JSON Schema, names and what they refuse."""

import pytest
from models import *  # noqa: F403
from stipule import Contract, Double, Either, Extract, Field, Int, ListOf, Long, MapOf, Nested, SetOf, String
from stipule.plans.schema import json_schema_text
from stipule.plans.types import java_double


def test_aspects():
    patch = USER.aspect("Patch", Field("email", String, optional=True, email=True), Field("name", String, optional=True, max_length=5), Field("new", String))
    name = patch.field("name")
    assert (name.non_empty, name.max_length, name.optional) == (True, 5, True)
    assert not patch.aspect("Again", Field("id", Long)).field("id").immutable and not USER.aspect("A", Field("password", String)).field("password").masked
    assert patch.is_aspect_of(USER) and not patch.is_aspect_of(ORDER) and not patch.open and STAY.aspect("S", Field("name", String)).rules == ()
    full = USER.aspect("Full", *[Field(f.name, f.type, optional=True) for f in USER.fields if f.name != "id"], inherit="all", exclude=("id",))
    assert len(full.fields) == 4
    for bad in (
        {"inherit": "all"}, {"exclude": ("id",)}, {"inherit": "all", "exclude": ("zzz",)}, {"inherit": "some"},
        {"inherit": "all", "exclude": ("id", "name", "email", "age", "password")},
    ):
        with pytest.raises(ValueError):
            USER.aspect("Bad", Field("name", String), **bad)
    with pytest.raises(ValueError):
        USER.aspect("Empty")
    assert [f.name for f in DOCUMENT.aspect("D", Field("createdAt", Long)).fields] == ["createdAt"]


def test_definitions_that_are_refused():
    with pytest.raises(ValueError):
        Contract.define("C", Field("a", Int), Field("A", Int))
    with pytest.raises(ValueError):
        Extract(r"(a)(b)", (("x", String),))
    with pytest.raises(Exception, match="unterminated|missing"):
        Field("a", String, pattern="(")
    with pytest.raises(ValueError):
        Field("a", Int, include=True)
    with pytest.raises(ValueError):
        Field("", Int)


def test_introspection():
    assert [f.name for f in DOCUMENT.fields] == ["title", "body", "createdAt", "updatedAt"]
    assert [f.name for f in USER.fields if f.required] == ["id", "name"]
    assert not USER.wire_type()["id"].nullable and USER.wire_type()["id"].metadata == {"immutable": True, "internal": True}
    deep = Contract.define("Deep", Field("d", Nested(DOCUMENT), include=True))
    assert [f.name for f in deep.fields] == ["title", "body", "stamps"]  # one level only


def test_json_schema():
    assert USER.json_schema() == {
        "$schema": "http://json-schema.org/draft-07/schema#", "type": "object", "required": ["id", "name"], "additionalProperties": False,
        "properties": {
            "id": {"type": "integer", "x-immutable": True, "x-internal": True}, "name": {"type": "string", "maxLength": 100, "minLength": 1}, "email": {"type": "string"},
            "age": {"type": "integer", "minimum": 0, "maximum": 150}, "password": {"type": "string", "x-masked": "***"},
        },
    }
    props = ORDER.json_schema()["properties"]
    assert props["items"]["type"] == "array" and props["items"]["minItems"] == 1 and "$schema" not in props["items"]["items"]
    c = Contract.define(
        "C", Field("l", ListOf(String)), Field("o", ListOf(String), optional=True), Field("e", Either(Int, String)), Field("m", MapOf(Int)), Field("x", Extract("a", (("v", String),))),
        Field("p", String, pattern="a", extract="b", min_length=3, non_empty=True), Field("n", Double, positive=True, multiple_of=0.5), Field("s", SetOf(Int)), Field("t", Long, future=True, past=True),
        open=True,
    )
    p = c.json_schema()["properties"]
    assert p["l"] == {"type": "array", "items": {"type": "string"}} and p["o"] == {} and p["e"] == {"type": "object"} and p["m"] == {"type": "object"} and p["x"] == {}
    assert p["p"] == {"type": "string", "pattern": "b", "minLength": 3} and p["n"] == {"type": "number", "exclusiveMinimum": 0, "multipleOf": 0.5}
    assert p["s"]["items"] == {"type": "integer"} and p["t"] == {"type": "integer", "x-future": True, "x-past": True} and "additionalProperties" not in c.json_schema()
    assert json_schema_text(OPEN).startswith('{"$schema"') and "\n" in json_schema_text(OPEN, 2)


def test_java_doubles():
    assert [java_double(x) for x in (0.01, 5, 0.5, 1e7, 1.5e-5, 12345678.5)] == ["0.01", "5.0", "0.5", "1.0E7", "1.5E-5", "1.23456785E7"]
