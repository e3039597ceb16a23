"""Mixing by hierarchical budgets over a domain, language, source tree.

A token budget flows from the root to the leaves.  A node shares its budget
among its children by weight; a child never gets more than its subtree can
supply, and what it cannot use goes to its siblings.  Only what a whole sibling
group cannot use reaches the level above.  A leaf supplies its tokens at most
``max_epochs`` times.

A leaf takes whole epochs while its budget lasts, then a prefix of one more: the
documents in the seeded order of that epoch whose running token total stays
within the rest.  The prefix ends at a threshold in (hash, id) order.  It is found by
summing tokens over hash digits, so no leaf is ever sorted or gathered, however
large; only the documents of one last digit pair are ordered.

Words, runs without ASCII white space, count as tokens.  Ids are integers.

Defined results: null texts have no tokens; null domains, languages or sources
form leaves named ``""``; rows without tokens belong to the epochs taken whole
and to the prefix where they fall; rows of equal ids in one leaf, or of null ids,
are taken or left together; an empty table, or one without tokens, gives no rows;
extra columns stay within :func:`mixed`'s ``row``, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stipule.llm.common import dropped, table, written

#: Relative weights by tree path; a path that is not listed weighs 1.
WEIGHTS: dict[tuple[str, ...], float] = {
    ("d0",): 4, ("d1",): 3, ("d2",): 2, ("d3",): 1,
    **{(f"d{d}", lang): w for d in range(4) for lang, w in (("en", 4), ("de", 2), ("fr", 2), ("es", 1))},
}
#: The budget as a share of all tokens, the most epochs, the seed, and the most leaves.
SHARE, MAX_EPOCHS, SEED, MAX_LEAVES = 1.0, 2, 23, 100_000
#: Bits of a hash digit.
DIGIT = 12
LEVELS = ("_m_domain", "_m_lang", "_m_source")


def words(text_col: str = "text") -> Column:
    """Number of words of a text; null counts none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source_col: str = "source") -> Column:
    """One of four domains by the source's checksum, where a table names no domain."""
    return F.concat(F.lit("d"), (F.crc32(F.coalesce(F.col(source_col).cast("string"), F.lit("")).cast("binary")) % 4).cast("string"))


class Leaf(NamedTuple):
    """A leaf's path, the tokens it has, and its budget."""

    path: tuple[str, ...]
    supply: int
    budget: int


def share_out(budget: Fraction, wanted: Sequence[tuple[Fraction, Fraction]]) -> list[Fraction]:
    """Split a budget over (weight, capacity) pairs; what one cannot use goes to the others."""
    given, open_ = [Fraction(0)] * len(wanted), [k for k, (w, c) in enumerate(wanted) if w > 0 and c > 0]
    left = budget
    while open_ and left > 0:
        total = sum(wanted[k][0] for k in open_)
        full = [k for k in open_ if left * wanted[k][0] / total >= wanted[k][1]]
        if not full:
            for k in open_:
                given[k] = left * wanted[k][0] / total
            break
        for k in full:
            given[k] = wanted[k][1]
        left -= sum(wanted[k][1] for k in full)
        open_ = [k for k in open_ if k not in set(full)]
    return given


def budgets(supply: Mapping[tuple[str, ...], int], total: int, weights: Mapping[tuple[str, ...], float], max_epochs: int = MAX_EPOCHS) -> list[Leaf]:
    """Leaf budgets in whole tokens, rounded down.  What weighs 0 gets nothing, and others get its share."""
    barred = {p for p in supply if any(weights.get(p[: k + 1], 1) <= 0 for k in range(len(p)))}

    def capacity(paths: list[tuple[str, ...]]) -> Fraction:
        return sum((max_epochs * Fraction(supply[p]) for p in paths if p not in barred), Fraction(0))

    out: list[Leaf] = []

    def give(prefix: tuple[str, ...], paths: list[tuple[str, ...]], budget: Fraction) -> None:
        if paths == [prefix]:
            out.append(Leaf(prefix, supply[prefix], int(budget)))
            return
        depth, groups = len(prefix), {}
        for p in paths:
            groups.setdefault(p[: depth + 1], []).append(p)
        keys = sorted(groups)
        wanted = [(Fraction(str(weights.get(k, 1))), capacity(groups[k])) for k in keys]
        for k, part in zip(keys, share_out(budget, wanted), strict=True):
            give(k, groups[k], part)

    paths = sorted(supply)
    if paths:
        give((), paths, min(Fraction(total), capacity(paths)))
    return out


def _keyed(df: DataFrame, id_col: str, text_col: str, levels: Sequence[Column]) -> DataFrame:
    named = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(LEVELS, levels, strict=True)]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    return df.select(row, *named, words(text_col).alias("_m_n"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_m_id"))


def _hash(epoch: Column) -> Column:
    return F.xxhash64(F.lit(SEED), epoch, F.col("_m_id"))


def _digit(h: Column, k: int) -> Column:
    return F.shiftrightunsigned(h, 64 - DIGIT * (k + 1)).bitwiseAND((1 << DIGIT) - 1)


def _cut(rows: DataFrame, key: str) -> DataFrame:
    """For each leaf, the digit at which running tokens pass ``_m_rest``, and the rest before it.

    ``rows`` are sums by leaf and digit: at most ``2 ** DIGIT`` for each leaf.
    """
    order = Window.partitionBy("_m_leaf").orderBy(key)
    run = rows.withColumn("_m_sum", F.sum("_m_n").over(order))
    passed = run.where(F.col("_m_sum") > F.col("_m_rest"))
    return passed.groupBy("_m_leaf").agg(F.min(F.struct(key, (F.col("_m_rest") - F.col("_m_sum") + F.col("_m_n")).alias("rest"))).alias("_m_at")).select("_m_leaf", F.col(f"_m_at.{key}").alias(f"{key}_cut"), F.col("_m_at.rest").alias("_m_left"))


def thresholds(narrow: DataFrame, leaves: list[Leaf]) -> DataFrame | None:
    """Per leaf: whole epochs, and the last (hash, id) of the prefix of the next epoch.

    ``cut_h`` and ``cut_id`` are null where the prefix is empty.
    """
    spark = narrow.sparkSession
    told = [(k, *x.path, x.budget // x.supply, x.budget % x.supply) for k, x in enumerate(leaves) if x.supply and x.budget]
    if not told:
        return None
    plan = F.broadcast(spark.createDataFrame(told, f"_m_leaf int, {', '.join(f'{n} string' for n in LEVELS)}, _m_full long, _m_rest long"))
    rows = narrow.join(plan, list(LEVELS)).where(F.col("_m_rest") > 0)
    rows = rows.withColumn("_m_h", _hash(F.col("_m_full").cast("int"))).withColumns({f"_m_d{k}": _digit(F.col("_m_h"), k) for k in (0, 1)})
    # A leaf's rest is less than its supply, so the running total passes it at some digit.
    one = _cut(rows.groupBy("_m_leaf", "_m_d0").agg(F.sum("_m_n").alias("_m_n"), F.first("_m_rest").alias("_m_rest")), "_m_d0")
    first = F.broadcast(spark.createDataFrame(one.collect(), one.schema))  # at most MAX_LEAVES rows
    in_one = rows.join(first, "_m_leaf").where(F.col("_m_d0") == F.col("_m_d0_cut"))
    two = _cut(in_one.groupBy("_m_leaf", "_m_d1").agg(F.sum("_m_n").alias("_m_n"), F.first("_m_left").alias("_m_rest")), "_m_d1")
    second = F.broadcast(spark.createDataFrame(two.collect(), two.schema))
    in_two = in_one.drop("_m_left").join(second, "_m_leaf").where(F.col("_m_d1") == F.col("_m_d1_cut"))
    # Rows of one id, or of none, are one row here, as they are taken together.
    whole = in_two.groupBy("_m_leaf", "_m_h", "_m_id").agg(F.sum("_m_n").alias("_m_n"), F.first("_m_left").alias("_m_left"))
    peers = Window.partitionBy("_m_leaf").orderBy("_m_h", "_m_id").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        whole.withColumn("_m_sum", F.sum("_m_n").over(peers))
        .where(F.col("_m_sum") <= F.col("_m_left"))
        .groupBy("_m_leaf")
        .agg(F.max(F.struct("_m_h", "_m_id")).alias("_m_at"))
        .select("_m_leaf", F.col("_m_at._m_h").alias("_m_cut_h"), F.col("_m_at._m_id").alias("_m_cut_id"))
    )
    cuts = plan.join(first.drop("_m_left"), "_m_leaf", "left").join(second.drop("_m_left"), "_m_leaf", "left").join(last, "_m_leaf", "left")
    return spark.createDataFrame(cuts.collect(), cuts.schema)


def mixed(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: Sequence[Column] | None = None, *,
    weights: Mapping[tuple[str, ...], float] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """``df``'s rows once for each epoch that takes them.

    Columns: ``row`` (the whole row), the leaf's ``domain``, ``lang`` and
    ``source``, ``n_tokens``, and ``epoch``, from 0.
    """
    levels = levels or (domain_of(), F.col("lang"), F.col("source"))
    keyed = _keyed(df, id_col, text_col, levels)
    narrow = written(keyed.select(*LEVELS, "_m_id", "_m_n"), "mixing")
    supply = narrow.groupBy(*LEVELS).agg(F.sum("_m_n").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(supply) > MAX_LEAVES:
        raise ValueError(f"the tree has more than {MAX_LEAVES} leaves")
    held = {tuple(r)[:3]: int(r["n"]) for r in supply}
    leaves = budgets(held, int(Fraction(str(share)) * sum(held.values())), weights, max_epochs)
    cuts = thresholds(narrow, leaves)
    dropped(narrow)
    names = [F.col(n).alias(n.removeprefix("_m_")) for n in LEVELS]
    if cuts is None:
        return keyed.select("row", *names, F.col("_m_n").alias("n_tokens"), F.lit(0).alias("epoch")).limit(0)
    h = _hash(F.col("_m_full").cast("int"))
    d0, d1 = _digit(h, 0), _digit(h, 1)
    inside = (F.col("_m_rest") > 0) & (
        (d0 < F.col("_m_d0_cut"))
        | (d0 == F.col("_m_d0_cut")) & ((d1 < F.col("_m_d1_cut")) | (d1 == F.col("_m_d1_cut")) & F.coalesce(F.struct(h.alias("h"), F.col("_m_id").alias("i")) <= F.struct(F.col("_m_cut_h").alias("h"), F.col("_m_cut_id").alias("i")), F.lit(False)) & F.col("_m_cut_h").isNotNull())
    )
    copies = F.col("_m_full").cast("int") + F.coalesce(inside, F.lit(False)).cast("int")
    chosen = keyed.join(F.broadcast(cuts), list(LEVELS)).withColumn("_m_copies", copies).where(F.col("_m_copies") > 0)
    return chosen.select("row", *names, F.col("_m_n").alias("n_tokens"), F.explode(F.sequence(F.lit(0), F.col("_m_copies") - 1)).alias("epoch"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that each leaf of the tree gives to the mixture, by epoch."""
    out = mixed(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "epoch", "domain", "lang", "source", "n_tokens")
