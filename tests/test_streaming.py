"""Streams give what batches give, and drafts build up over batches."""

import json

from helpers import raw_df
from models import USER
from pyspark.sql import functions as F
from stipule.operators.validate import validate
from stipule.streaming.flows import accumulated_drafts, patching, quarantining, validated, violation_counts


def test_validation_streams(spark, tmp_path):
    raw_df(spark, {"id": 1, "name": "A"}, {"id": 2}, {"id": 3, "name": ""}).select("i", "text").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("i int, text string").parquet(f"{tmp_path}/in").withColumn("raw", F.try_parse_json("text"))
    quarantining(validated(stream, USER, "raw").select("i", "is_valid"), f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert [r.i for r in spark.read.parquet(f"{tmp_path}/good").collect()] == [0]
    assert sorted(r.i for r in spark.read.parquet(f"{tmp_path}/bad").collect()) == [1, 2]


def test_patches_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(0, '{"name":"X"}', 1), (0, '{"name":""}', 2)], "i int, p string, n int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("i int, p string, n int").parquet(f"{tmp_path}/in").select("i", F.parse_json("p").alias("patch"), "n")
    got = []
    load = lambda s: raw_df(s, {"id": 1, "name": "A"})
    patching(stream, USER, "i", load, lambda df, k: got.extend(df.select("is_valid").collect()), f"{tmp_path}/cp", order="n").trigger(availableNow=True).start().awaitTermination()
    assert [r.is_valid for r in got] == [False]


def test_drafts_of_a_stream(spark, tmp_path):
    parts = [(1, '{"id": 1}', 1), (1, '{"name": "A"}', 2), (2, '{"name": "B"}', 1), (1, '{"name": "C"}', 3)]
    spark.createDataFrame(parts, "k int, part string, n int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k int, part string, n int").parquet(f"{tmp_path}/in")
    drafts = accumulated_drafts(stream, "k", "part", "n")
    q = drafts.writeStream.outputMode("update").format("memory").queryName("drafts").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.k: json.loads(r.draft) for r in spark.table("drafts").collect()} == {1: {"id": 1, "name": "C"}, 2: {"name": "B"}}


def test_counts_by_window(spark):
    df = raw_df(spark, {"id": 1}, {"id": 2, "name": ""}).withColumn("at", F.timestamp_seconds(F.col("i") * 120))
    out = violation_counts(validate(df, USER, "raw"), "at").collect()
    assert {(r.path, r.n) for r in out} == {("name", 1)} and len(out) == 2


def test_drafts_keep_going_after_text_that_is_no_record(spark, tmp_path):
    spark.createDataFrame([(1, '{"id": 1.50}', 1), (1, "no json", 2), (1, "[1]", 3), (2, None, 1)], "k int, part string, n int").write.parquet(f"{tmp_path}/in")
    drafts = accumulated_drafts(spark.readStream.schema("k int, part string, n int").parquet(f"{tmp_path}/in"), "k", "part", "n")
    drafts.writeStream.outputMode("update").format("memory").queryName("bad_drafts").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert {(r.k, r.draft, r.rejected) for r in spark.table("bad_drafts").collect()} == {(1, '{"id":1.50}', 2), (2, "{}", 0)}
