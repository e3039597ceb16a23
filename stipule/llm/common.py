"""Helpers shared by the operators: table access, scratch tables, Arrow maps."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch.  Texts average a few kilobytes, so a batch stays at
#: a few megabytes; the byte limit covers runs of very long texts.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data folder through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch may hold, for this session; smaller bounds stay as they are.

    A result is computed when its user asks for it, so the bounds have to outlast the call.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, None)
        if now is None or not now.isdecimal() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def crc_mod(id_col: str, modulus: int) -> Column:
    """crc32 of an id written as decimal text, modulo ``modulus``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


#: Folders of scratch tables that go when this process ends.
_FOLDERS: set[str] = set()
#: Spark then deletes the shuffle files of a query when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors for written intermediate tables.

    The session's ``spark.checkpoint.dir`` names it.  Only where that is unset on a
    single machine, as in a test, a temporary folder takes its place.  The tables
    that results read stay until this process ends, or until :func:`cleared`.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="stipule-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/stipule-{context.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS.add(path)
        atexit.register(_ended, context._jvm, context._jsc.hadoopConfiguration(), path)  # noqa: SLF001
    return path


def _deleted(jvm, settings, path: str) -> None:
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(settings).delete(at, True)


def _ended(jvm, settings, path: str) -> None:
    try:
        _deleted(jvm, settings, path)
    except Exception:  # noqa: BLE001  the JVM may have ended first; the folder's owner clears it then
        pass


def written(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` to a scratch table and read it back, which cuts its lineage.

    A lost executor then costs a re-read of shared files, not the whole job.  The
    shuffle files behind the table go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path  # noqa: SLF001
    return out


def dropped(df: DataFrame) -> None:
    """Delete the scratch table behind a DataFrame returned by :func:`written`."""
    context, path = df.sparkSession.sparkContext, getattr(df, "_scratch", None)
    if path:
        _deleted(context._jvm, context._jsc.hadoopConfiguration(), path)  # noqa: SLF001


def cleared(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that read them are lost."""
    context = spark.sparkContext
    _deleted(context._jvm, context._jsc.hadoopConfiguration(), scratch_root(spark))  # noqa: SLF001


#: Rows of one key that a task should meet in a join, and the most keys that are spread.
SPREAD, MOST_SPREAD = 1_000, 50_000


def hot_keys(counts: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The keys with more than ``SPREAD`` rows and the ``_shares`` to deal them in, from the driver; None without any.

    ``counts`` holds ``keys`` and ``_m``, their rows.  At most ``MOST_SPREAD`` keys, the
    most frequent, which is placement only: each other one has less than a
    ``MOST_SPREAD``-th of all rows.
    """
    known = " and ".join(f"`{k}` is not null" for k in keys)
    shares = F.ceil(F.col("_m") / SPREAD).cast("int").alias("_shares")
    hot = counts.where(F.col("_m") > SPREAD).where(known).orderBy(F.desc("_m"), *keys).limit(MOST_SPREAD).select(*keys, shares)
    found = hot.collect()
    return counts.sparkSession.createDataFrame(found, hot.schema) if found else None


def spread_join(many: DataFrame, one: DataFrame, keys: Sequence[str], by: Sequence[str], counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has a row for each key; no key's rows meet in one task.

    The rows of a frequent key are dealt out by a hash of ``by``, and its row of
    ``one`` is repeated for each share.  ``counts`` is as in :func:`hot_keys`, where
    it is known already.
    """
    keys = list(keys)
    hot = hot_keys(many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")) if counts is None else counts, keys)
    if hot is None:
        return many.join(one, keys, how)
    # A null key joins with nothing, wherever its rows go.
    known = F.expr(" and ".join(f"`{k}` is not null" for k in keys))
    shares = F.when(known, F.coalesce("_shares", F.lit(1))).otherwise(MOST_SPREAD)
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("_share", F.pmod(F.xxhash64(*by), shares).cast("int")).drop("_shares")
    return dealt.join(shared(one, hot, keys), [*keys, "_share"], how).drop("_share")


def shared(one: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``one`` with a column ``_share``: 0, and for hot keys further rows for their other shares."""
    more = one.join(F.broadcast(hot), list(keys)).withColumn("_share", F.explode(F.sequence(F.lit(1), F.col("_shares") - 1))).drop("_shares")
    return one.withColumn("_share", F.lit(0)).unionByName(more)


def arrow_map(
    df: DataFrame,
    columns: Sequence[str],
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: T.StructType | str,
) -> DataFrame:
    """``mapInArrow`` over the named columns only, with bounded batches."""
    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(fn, schema)


def text_bytes(value: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty."""
    return value.encode("utf-8", "surrogatepass") if value else b""
