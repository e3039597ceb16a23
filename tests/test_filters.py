"""Truth of every predicate over absent, null, NaN, matching and other values, plain and negated."""

import pytest
from helpers import raw_df
from pyspark.sql import functions as F
from stipule import Contract, Double, Field, Filter, Long, String
from stipule.plans.filters import matching, predicate

C = Contract.define("C", Field("n", Double, optional=True), Field("s", String, optional=True), Field("k", Long, optional=True))
f = Filter(C)
N, S = f.field("n"), f.field("s")
#: Predicate and the rows it accepts of those below.
RAW = [{}, {"n": None, "s": None}, {"n": 5, "s": "abc"}, {"n": 7.5, "s": "xbc"}, {"n": "NaN", "s": "a.c"}]
CASES = [
    (N.exists(), [2, 3, 4]), (N.not_exists(), [0, 1]), (N.equal_to(5.0), [2]), (N.not_equal_to(5.0), [0, 1, 3, 4]), (N.equal_to(None), [1]), (N.not_equal_to(None), [0, 2, 3, 4]),
    (N.gt(5.0), [3, 4]), (N.gte(5.0), [2, 3, 4]), (N.lt(7.5), [2]), (N.lte(7.5), [2, 3]), (N.in_([5.0, 7.5]), [2, 3]), (N.not_in([5.0]), [0, 1, 3, 4]), (N.in_([]), []), (N.not_in([]), [0, 1, 2, 3, 4]),
    (S.contains("bc"), [2, 3]), (S.starts_with("a"), [2, 4]), (S.matches("a.c"), [2, 4]), (S.matches("a"), []), (S.is_some("abc"), [2]),
    (N.gt(5.0) & S.starts_with("x"), [3]), (N.gt(5.0) | S.starts_with("a"), [2, 3, 4]),
]


def test_truth_table(spark):
    df = raw_df(spark, *RAW)
    cols = []
    for k, (e, _) in enumerate(CASES):
        cols += [predicate(df, e, C, "raw").alias(f"p{k}"), predicate(df, ~e, C, "raw").alias(f"n{k}"), predicate(df, ~~e, C, "raw").alias(f"d{k}")]
    rows = df.select("i", *cols).orderBy("i").collect()
    for k, (_, want) in enumerate(CASES):
        assert [r.i for r in rows if r[f"p{k}"]] == want, k
        assert [r.i for r in rows if r[f"n{k}"]] == [i for i in range(5) if i not in want], k
        assert [r.i for r in rows if r[f"d{k}"]] == want, k


def test_typed_columns_agree(spark):
    df = spark.createDataFrame([(0, None, None), (2, 5.0, "abc"), (3, 7.5, "xbc"), (4, float("nan"), "a.c")], "i int, n double, s string")
    for e, want in CASES:
        if "None" in str(e):
            continue
        want = [i for i in want if i != 1]
        assert sorted(r.i for r in matching(df, e).collect()) == want, e
        assert sorted(r.i for r in matching(df, ~e).collect()) == [i for i in (0, 2, 3, 4) if i not in want], e
    null = matching(df, N.equal_to(None), nulls="explicit")
    assert [r.i for r in null.collect()] == [0]


def test_jvm_numbers(spark):
    df = spark.createDataFrame([(0, None), (1, 5.0), (2, float("nan"))], "i int, n double")
    g = Filter(jvm=True).field("n")
    assert [r.i for r in matching(df, g.gt(4)).collect()] == [1]
    assert sorted(r.i for r in matching(df, ~g.gt(4)).collect()) == [0, 2]
    assert g.gt(4).to_mongo_query() == {"n": {"$gt": 4.0}}


def test_mongo():
    a, b = N.gt(1.0), S.equal_to("x")
    assert a.to_mongo_query() == {"n": {"$gt": 1.0}}
    assert (a & b).to_mongo_query() == {"n": {"$gt": 1.0}, "s": "x"}
    assert (a & N.lt(5.0)).to_mongo_query() == {"$and": [{"n": {"$gt": 1.0}}, {"n": {"$lt": 5.0}}]}
    assert (a & (a | b)).to_mongo_query() == {"$and": [{"n": {"$gt": 1.0}}, {"$or": [{"n": {"$gt": 1.0}}, {"s": "x"}]}]}
    assert (~b).to_mongo_query() == {"$nor": [{"s": "x"}]}
    assert N.in_([3.0, 1.0]).to_mongo_query() == {"n": {"$in": [3.0, 1.0]}} and N.not_in([1.0]).to_mongo_query() == {"n": {"$nin": [1.0]}}
    assert N.exists().to_mongo_query() == {"n": {"$exists": True}} and S.not_equal_to("x").to_mongo_query() == {"s": {"$ne": "x"}}
    assert S.contains("a.b").to_mongo_query() == {"s": {"$regex": r"\Qa.b\E"}} and S.starts_with("a").to_mongo_query() == {"s": {"$regex": r"^\Qa\E"}}
    assert S.matches("a+").to_mongo_query() == {"s": {"$regex": "^a+$"}} and S.matches("^a+$").to_mongo_query() == {"s": {"$regex": "^a+$"}}


def test_unknown_names():
    with pytest.raises(KeyError):
        f.field("zzz")
    with pytest.raises(AttributeError):
        _ = C.f.zzz
    assert C.f.n == "n"


def pushed(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("PushedFilters: ")[1].split("\n")[0]


def test_predicates_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    g = Filter()
    e = g.field("c_acctbal").gt(5000.0) & ~g.field("c_nationkey").in_([1, 2]) & g.field("c_name").starts_with("Customer")
    text = pushed(matching(df, e).select("c_custkey"))
    assert "GreaterThan(c_acctbal,5000.0)" in text and "StringStartsWith(c_name,Customer)" in text and "c_nationkey" in text
    assert "LessThanOrEqual(c_acctbal,5000.0)" in pushed(matching(df, ~g.field("c_acctbal").gt(5000.0)))


def test_core_plans_have_no_python(spark):
    from stipule.operators.validate import validate
    from stipule.queries import CUSTOMER

    df = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    plan = validate(df, CUSTOMER).select("violations")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.lstrip().startswith("*(1)")
    two = validate(df.select("c_custkey", "c_acctbal", "c_name"), Contract.define("X", Field("c_acctbal", Double, min=0))).select("is_valid")
    assert "ReadSchema: struct<c_acctbal:double>" in two._jdf.queryExecution().executedPlan().toString()
    assert F is not None
