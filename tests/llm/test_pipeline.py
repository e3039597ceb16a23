"""The pipeline, stage by stage, against plain versions; and the registered queries."""

import random

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from stipule.llm import langid, pii
from stipule.llm.common import written
from stipule.llm.queries import QUERIES
from test_corpus_operators import check_packing, plain_components

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    now = docs
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r for r in now.collect()}
        out = written(stage(spark, now, SF), name)
        if name != "pack":
            assert out.columns == docs.columns, name
        rows = out.collect()
        if name == "language_id":
            assert {r.doc_id for r in rows} == {i for i, r in before.items() if any(c.isalpha() for c in r.text)}
        if name == "near_dedup":
            want = plain_components([(i, r.text) for i, r in before.items()], 5)
            assert sorted(r.doc_id for r in rows) == sorted(i for i, (_, _, kept) in want.items() if kept)
        if name == "personal_data":
            assert {r.doc_id: (r.text, r.n_chars) for r in rows} == {i: (t := pii.redact(r.text), len(t)) for i, r in before.items()}
        if name == "mix_sources":
            assert {r.doc_id for r in rows} <= set(before) and all(r == before[r.doc_id] for r in rows)
            mixture = rows
        if name == "pack":
            total = sum(len(r.text.encode().split()) for r in mixture)
            assert sum(r.n_tokens for r in rows) == total and rows[0].bucket is not None
        now = out
    once = docs.where("doc_id < 50")
    check_packing(pipeline.pack(spark, once, SF).collect(), [(r.doc_id, r.text) for r in once.collect()], 2048, 32768)


def test_run_and_odd_rows(spark, odd, empty):
    assert pipeline.run(spark, SF).count() > 100 and len(pipeline.STAGES) == 5
    for table in (odd, empty):
        now = table
        for name, stage in pipeline.STAGES:
            now = written(stage(spark, now, SF), name)
            assert name == "pack" or now.columns == table.columns
    assert langid.UNKNOWN == "und"


def test_every_query_runs(spark):
    import __spark_entry__ as entry

    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, query in QUERIES.items():
        rows = query(spark, SF).count()
        assert rows == n or name in ("op4_mixing", "op5_packing", "op7_neighbours"), name


def test_texts_with_letters_but_no_language_go(spark, docs):
    rng = random.Random(1)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(900))
    junk = spark.createDataFrame([(10**9, "z" * 300), (10**9 + 1, letters), (10**9 + 2, "aB" * 200)], "doc_id long, text string")
    more = docs.unionByName(junk, allowMissingColumns=True)
    kept = {r.doc_id for r in pipeline.language_id(spark, more, SF).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text)}


def test_unknown_languages_are_told_by_the_network(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    some = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, "und").otherwise(F.col("lang")))
    net = langid.fit(some)
    told = {r.doc_id: r.lang_pred for r in langid.predicted(some, net).collect()}
    for r in pipeline.language_id(spark, some, SF).select("doc_id", "lang").collect():
        assert r.doc_id % 3 == 2 or r.lang == told[r.doc_id]
    real = {r.doc_id: r.lang for r in docs.collect() if told[r.doc_id] != langid.UNKNOWN}
    assert sum(told[i] == lang for i, lang in real.items()) > 0.95 * len(real) > 0


def test_one_language_is_enough(spark, empty):
    one = spark.createDataFrame([(k, "some words of one language, and more of them here", "en") for k in range(40)] + [(99, "q" * 290, None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in pipeline.language_id(spark, one, SF).collect()) == list(range(40)) and pipeline.language_id(spark, empty, SF).count() == 0
