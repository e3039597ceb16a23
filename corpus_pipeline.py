"""From raw documents to packed training batches, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``.  All
but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipule.llm import langid, minhash, mixing, packing, pii
from stipule.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells; where ``lang`` is null, empty or ``und`` it becomes that one.

    Texts without letters, null texts, and texts that the network sees in no language
    go.  Rows of null id or language are judged by their
    text like others; repeated rows stay or go together; an empty table stays empty.
    """
    return langid.accepted(docs, langid.fit(docs), lang_col="lang")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of near-duplicates.

    Rows without words, and rows of null id, stay; a repeated row stays once; an
    empty table stays empty.
    """
    return minhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind; ``n_chars`` follows the text.

    All rows stay; null and empty texts, and ``n_chars`` of null texts, stay as they are.
    """
    out = pii.redacted(docs)
    if "n_chars" in out.columns:
        kind = out.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mixture takes them: once for each epoch of their leaf.

    Null languages and sources are leaves of their own; rows of equal id in a leaf, or
    of null id, go together; a table without any word gives no rows.
    """
    return mixing.mixed(docs).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches for every piece of every document.

    Null and empty texts give one row without a bucket; null ids and repeated rows are
    packed like others; an empty table gives no rows.
    """
    return packing.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: SQL cannot train a network or hash as Spark does; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
