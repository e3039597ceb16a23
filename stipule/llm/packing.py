"""Packing into optimal length buckets.

Texts longer than ``MAX_LEN`` tokens are cut in pieces of that length.  A
dynamic programme over the global length histogram, which has at most
``MAX_LEN`` entries, picks the bucket lengths that need the least padding in
all.  Inside a bucket, pieces take seeded random places, and every
``TOKEN_BUDGET // length`` of them form a batch.

A piece's place is its rank in its bucket.  Ranks come from counts over hash
bins: those before a piece's bin are summed, those in it are numbered.  A bin
has a fixed share of a bucket, so no bucket meets in one task.

Words, runs without ASCII white space, count as tokens.

Defined results: null and empty texts, without tokens, give one row with piece
0 and null bucket, batch and slot; null ids and repeated rows are packed like
others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stipule.llm.common import table, written
from stipule.llm.mixing import words

MAX_LEN, BUCKETS, TOKEN_BUDGET, SEED = 2048, 8, 32768, 31
#: Bits of the hash that pick a bin: 16,384 bins in each bucket.
BITS = 14


def bucket_lengths(counts: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The at most ``buckets`` lengths, rising, that minimise total padding.

    Each piece is padded to the least bucket length that holds it.  Of equally
    good choices, the one with the fewest buckets and then the least lengths from
    the top down is taken.
    """
    lengths = sorted(n for n, c in counts.items() if c and n > 0)
    if not lengths:
        return []
    at = np.array(lengths, np.int64)
    many = np.concatenate([[0], np.cumsum([counts[n] for n in lengths])]).astype(np.int64)
    total = np.concatenate([[0], np.cumsum([counts[n] * n for n in lengths])]).astype(np.int64)
    n = len(lengths)
    # cost[i]: least padding of the first i lengths with k buckets, the last ending at length i - 1.
    cost, back = np.full(n + 1, np.iinfo(np.int64).max // 4), []
    cost[0] = 0
    best, used = None, 0
    for k in range(1, min(buckets, n) + 1):
        after, choice = np.full(n + 1, np.iinfo(np.int64).max // 4), np.zeros(n + 1, int)
        for j in range(k, n + 1):
            options = cost[:j] + at[j - 1] * (many[j] - many[:j]) - (total[j] - total[:j])
            choice[j] = int(options.argmin())
            after[j] = options[choice[j]]
        back.append(choice)
        cost = after
        if best is None or cost[n] < best:
            best, used = cost[n], k
    out, j = [], n
    for k in range(used, 0, -1):
        out.append(lengths[j - 1])
        j = back[k - 1][j]
    return out[::-1]


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_len: int = MAX_LEN, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """Every piece of every text with its bucket, batch and slot."""
    n, k = F.col("_n"), F.col("_k")
    sizes = df.select(F.col(id_col).alias("_id"), words(text_col).alias("_n"))
    pieces = sizes.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((n - 1) / max_len)))))
    pieces = written(pieces.select("_id", k.cast("int").alias("_k"), F.least(F.lit(max_len).cast("long"), n - k * max_len).alias("_n")), "packing")
    counts = {int(r["_n"]): int(r["count"]) for r in pieces.groupBy("_n").count().collect()}  # at most max_len + 1 rows
    tops = bucket_lengths(counts, buckets)
    bucket = F.lit(None).cast("int")
    for b in reversed(range(len(tops))):
        bucket = F.when(n <= tops[b], F.lit(b)).otherwise(bucket)
    length = F.element_at(F.array(*[F.lit(x) for x in tops]), F.col("_b") + 1) if tops else F.lit(None).cast("int")
    h = F.xxhash64(F.lit(SEED), "_id", "_k")
    # Equal pieces are one row until they are placed: those of a null or repeated id would share a bin.
    same = pieces.where(n > 0).groupBy("_id", "_k", "_n").agg(F.count(F.lit(1)).alias("_m"))
    placed = same.select("*", bucket.alias("_b"), h.alias("_h"), F.shiftrightunsigned(h, 64 - BITS).alias("_bin"))
    # At most 2 ** BITS counts for each bucket, whatever the input.
    starts = placed.groupBy("_b", "_bin").agg(F.sum("_m").alias("_c")).select("_b", "_bin", (F.sum("_c").over(Window.partitionBy("_b").orderBy("_bin")) - F.col("_c")).alias("_start"))
    before = F.sum("_m").over(Window.partitionBy("_b", "_bin").orderBy("_h", "_id", "_k", "_n").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")
    ranked = placed.withColumn("_in", before).join(starts, ["_b", "_bin"]).withColumn("_at", F.explode(F.sequence(F.col("_start") + F.col("_in"), F.col("_start") + F.col("_in") + F.col("_m") - 1)))
    size = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / length)).cast("long")
    cols = [F.col("_id").alias(id_col), k.alias("piece"), n.alias("n_tokens")]
    some = ranked.select(*cols, F.col("_b").alias("bucket"), length.alias("bucket_len"), F.floor(F.col("_at") / size).alias("batch"), (F.col("_at") % size).cast("int").alias("slot"))
    none = pieces.where(n == 0).select(*cols, *(F.lit(None).cast(t).alias(c) for c, t in (("bucket", "int"), ("bucket_len", "int"), ("batch", "long"), ("slot", "int"))))
    return some.unionByName(none)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets and batches for every piece of every whole text of ``documents``."""
    return packed(table(spark, sf_dir, "documents"))
