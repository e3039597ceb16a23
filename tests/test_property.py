"""Random records against a plain Python statement of the rules."""

import json

from helpers import codes, raw_df
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from stipule import Contract, Field, Int, ListOf, Nested, String
from stipule.operators.validate import validate

INNER = Contract.define("Inner", Field("q", Int, min=1), Field("t", String, optional=True, max_length=2))
C = Contract.define("C", Field("a", Int, min=0, max=9), Field("b", String, optional=True, non_empty=True), Field("d", Int, default=3), Field("r", Int, optional=True, reserved=True), Field("n", ListOf(Nested(INNER)), optional=True))


def decodes(kind, v):
    if kind is String:
        return isinstance(v, str)
    if isinstance(v, str):
        bare = v[1:] if v[:1] in ("+", "-") else v
        return bare.isascii() and bare.isdigit() and -(2**31) <= int(v) < 2**31
    return isinstance(v, int) and not isinstance(v, bool) and -(2**31) <= v < 2**31


def expected(contract, record, path=""):
    names = {f.name for f in contract.fields}
    out = [(path + k, "UNKNOWN_FIELD") for k in sorted(record) if k not in names]
    for f in contract.fields:
        at = path + f.name
        if f.name not in record:
            out += [(at, "MISSING")] if f.required else []
            continue
        v = record[f.name]
        if f.reserved:
            out.append((at, "RESERVED"))
        elif v is None:
            out += [] if f.optional else [(at, "TYPE_MISMATCH")]
        elif isinstance(f.type, ListOf):
            if not isinstance(v, list) or not all(isinstance(x, dict) for x in v):
                out.append((at, "TYPE_MISMATCH"))
            else:
                for i, x in enumerate(v):
                    out += expected(INNER, x, f"{at}.{i}.")
        elif not decodes(f.type, v):
            out.append((at, "TYPE_MISMATCH"))
        else:
            x = int(v) if f.type is Int else v
            checks = (("nonEmpty", f.non_empty and x == ""), ("maxLength", f.max_length is not None and len(x) > f.max_length if isinstance(x, str) else False), ("min", f.min is not None and x < f.min), ("max", f.max is not None and x > f.max))
            out += [(at, f"CONSTRAINT({n})") for n, bad in checks if bad]
    return out


leaf = st.one_of(st.none(), st.booleans(), st.integers(-3, 12), st.just(2**31), st.floats(0, 9).map(lambda x: round(x, 1) + 0.05), st.sampled_from(["", "ab", "abc", "7", "-1", "+2", " 3", "é"]))
inner = st.dictionaries(st.sampled_from(["q", "t", "z"]), leaf, max_size=3)
records = st.dictionaries(st.sampled_from(["a", "b", "d", "r", "n", "x"]), st.one_of(leaf, st.lists(st.one_of(inner, st.integers(0, 3)), max_size=3)), max_size=6)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(records, min_size=60, max_size=120))
def test_random_records(spark, batch):
    out = validate(raw_df(spark, *batch), C, "raw").select("i", "violations", "is_valid").orderBy("i").collect()
    for r, record in zip(out, batch, strict=True):
        want = expected(C, record)
        assert codes(r) == want, json.dumps(record)
        assert r.is_valid == (not want)
