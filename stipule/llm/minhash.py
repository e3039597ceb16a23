"""Near-duplicates by HyperMinHash banding, estimated, then confirmed on full sets.

1. Texts become sets of word-shingle hashes; equal sets are one class from here
   on, found by aggregation.
2. Each class has a HyperMinHash sketch of ``REGISTERS`` compressed registers.
   Bands of ``ROWS`` registers name its buckets.
3. Every member of a bucket meets the bucket's least member.  Collision-corrected
   estimates drop pairs far below the similarity, full sets confirm the rest, and
   links are joined to components.
4. Buckets whose other members still lie in several components are compared
   within, in blocks, so that no link is lost where the least member is not
   linked to all.  Pairs in one component are skipped, and a block gives at most
   a spanning set of links, so no pairs of a group are ever emitted.

A pair at the similarity of 0.8 shares no band with a probability below 2e-6, and
is dropped by its estimate with one below 1e-6.

Defined results: texts without words, and null texts, have empty sets and link
with nothing; a row with a null id links with nothing and has a null component;
rows that repeat an id share its links; an empty table gives no rows; other columns
are ignored, or kept where whole rows are returned.  Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipule.llm.common import arrow_map, dropped, spread_join, table, text_bytes, written
from stipule.llm.components import components
from stipule.llm.sketch import MIX, REGISTERS, Shingler, estimated, mixed, registers, slack

ROWS = 6
WIDTH, PERCENT = 5, 80
#: Members of a block, and the bytes of sets that it aims at.
BLOCK, BLOCK_BYTES = 1024, 16 << 20


def _binary(arrays: list[bytes]) -> pa.Array:
    return pa.array(arrays, pa.binary())


def features(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``_id``, set size, set digest and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            sizes, keys, regs = [], [], []
            for value in batch.column(1):
                held = shingler.shingles(text_bytes(value.as_py()))
                sizes.append(len(held))
                keys.append(xxhash.xxh3_128_digest(held) if len(held) else None)
                regs.append(registers(held).tobytes() if len(held) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), _binary(keys), _binary(regs)], names=["_id", "_n", "_key", "_regs"])

    return arrow_map(df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")), ["_id", "_text"], run, "_id long, _n long, _key binary, _regs binary")


def full_sets(df: DataFrame, width: int) -> DataFrame:
    """``id`` and its sorted shingle hashes, for rows of ``id`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            sets = [shingler.shingles(text_bytes(v.as_py())).tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(sets)], names=["id", "held"])

    return arrow_map(df, ["id", "text"], run, "id long, held binary")


def banded(classes: DataFrame) -> DataFrame:
    """One row ``(k, id)`` for each class and band; ``k`` names a bucket of one band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(ids), -1, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(regs.shape[1], dtype=np.uint64), regs.shape[:2])
            for k in range(ROWS):
                key = mixed(key * MIX[0] + regs[:, :, k])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(ids, regs.shape[1]), pa.int64())], names=["k", "id"])

    return arrow_map(classes, ["id", "regs"], run, "k long, id long")


def _sketches(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(at).to_pylist()), np.uint16).reshape(batch.num_rows, REGISTERS)


def promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose corrected estimate may reach the similarity."""
    side = lambda s: classes.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"r_{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (2, 4))
            keep = _promising(_sketches(batch, 3), _sketches(batch, 5), na, nb, percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    # Many pairs have one ``b``, the least member of a bucket.
    joined = spread_join(pairs, side("b"), ["b"], ["a"]).join(side("a"), "a")
    return arrow_map(joined, ["a", "b", "n_a", "r_a", "n_b", "r_b"], run, "a long, b long")


def _promising(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    least = percent / 100
    near = estimated(ra, rb, na, nb) >= least - slack(na, nb, least)
    return near & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    joint = np.concatenate([a, b])
    joint.sort(kind="stable")  # merges two sorted runs
    both = int(np.count_nonzero(joint[1:] == joint[:-1]))
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that are linked by their full sets."""
    side = lambda s: sets.select(F.col("id").alias(s), F.col("held").alias(f"s_{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = spread_join(pairs, side("b"), ["b"], ["a"]).join(side("a"), "a")
    return arrow_map(joined, ["a", "b", "s_a", "s_b"], run, "a long, b long")


class _Roots:
    """Union-find over the components met in one block."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x


def _block_links(rows: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Component pairs joined by a link between members of one pair of blocks."""
    comp = rows["c"].to_numpy()
    block = rows["blk"].to_numpy()
    apart = rows["i"][0].as_py() != rows["j"][0].as_py()
    size = rows["n"].to_numpy().astype(float)
    regs = np.frombuffer(b"".join(rows["regs"].to_pylist()), np.uint16).reshape(len(comp), REGISTERS)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["held"]]
    band = rows["k"][0].as_py()
    roots, found = _Roots(), []
    first = np.arange(len(comp))
    for x in range(len(comp) - 1):
        other = first[x + 1 :]
        other = other[(comp[other] != comp[x]) & ((block[other] != block[x]) | (not apart))]
        if not len(other):
            continue
        near = other[_promising(regs[x][None, :], regs[other], np.full(len(other), size[x]), size[other], percent)]
        for y in near:
            a, b = roots.find(int(comp[x])), roots.find(int(comp[y]))
            if a != b and _first_bucket(regs[x], regs[y]) == band and linked(sets[x], sets[y], percent):
                roots.up[max(a, b)] = min(a, b)
                found.append((a, b))
    return found


def _first_bucket(a: np.ndarray, b: np.ndarray) -> int:
    """The bucket of the first band that two sketches share: where their pair is compared."""
    same = (a == b).reshape(-1, ROWS).all(axis=1)
    at = int(same.argmax())
    key = np.array([at], np.uint64)
    for v in a[at * ROWS : at * ROWS + ROWS].astype(np.uint64):
        key = mixed(key * MIX[0] + v)
    return int(key.view(np.int64)[0])


def within_buckets(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components ``(a, b)`` found by comparing the members of each bucket.

    ``members`` are ``(k, id, c)``.  A bucket is split in blocks by a hash of the
    id, and every pair of its blocks is a group of its own.
    """
    held = members.join(classes.select("id", "n"), "id")
    many = held.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("w") * 8 / BLOCK_BYTES)).cast("int")
    dealt = held.join(many.select("k", blocks.alias("nb")), "k").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    whole = dealt.join(classes.select("id", "regs"), "id").join(sets, "id").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = whole.select("k", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "c", "n", "regs", "held")
    names = ["k", "i", "j", "blk", "c", "n", "regs", "held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []

        def flush() -> pa.RecordBatch:
            found = _block_links(pa.concat_tables(waiting).combine_chunks(), percent)
            return pa.RecordBatch.from_arrays([pa.array([f[s] for f in found], pa.int64()) for s in (0, 1)], names=["a", "b"])

        key = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            cuts = [r for r in range(len(keys)) if keys[r] != (keys[r - 1] if r else key)]
            for start, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if start < end and keys[start] != key:
                    if waiting:
                        yield flush()
                    waiting, key = [], keys[start]
                if start < end:
                    waiting.append(part.slice(start, end - start))
        if waiting:
            yield flush()

    placed = rows.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    return arrow_map(placed, names, run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Each row's id, set size, ``component_id`` (least id reachable) and ``kept``."""
    feats = written(features(df, id_col, text_col, width), "sketches")
    usable = feats.where(F.col("_id").isNotNull() & (F.col("_n") > 0))
    least = usable.groupBy("_key").agg(F.min("_id").alias("id"))
    sketch = usable.select(F.col("_id").alias("id"), "_key", F.col("_n").alias("n"), F.col("_regs").alias("regs"))
    classes = written(least.join(sketch, ["id", "_key"]).dropDuplicates(["id", "_key"]), "classes")
    bands = banded(classes)
    buckets = bands.groupBy("k").agg(F.min("id").alias("p"), F.max("id").alias("q"), F.count(F.lit(1)).alias("m")).where("p < q")
    buckets = written(buckets, "buckets")
    members = written(spread_join(bands, buckets.select("k", "p", "m"), ["k"], ["id"], buckets.select("k", F.col("m").alias("_m"))), "members")
    pairs = written(members.where("id > p").select(F.col("id").alias("a"), F.col("p").alias("b")).distinct(), "met")
    near = written(promising(pairs, classes, percent), "pairs")
    wanted = members.where("m > 2").select("id").union(near.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi")
    sets = written(full_sets(texts, width), "sets")
    if not usable.groupBy("_id").count().where("count > 1").isEmpty():
        again, sets = sets, written(sets.distinct(), "sets")
        dropped(again)
    first = components(confirmed(near, sets, percent))
    others = members.where("m > 2 and id > p").select("k", "id").join(first.select(F.col("v").alias("id"), "c"), "id", "left")
    second = components(within_buckets(others.select("k", "id", F.coalesce("c", "id").alias("c")), classes, sets, percent))
    label = classes.select("id", "_key").join(first.select(F.col("v").alias("id"), "c"), "id", "left").select("_key", F.coalesce("c", "id").alias("c"))
    label = spread_join(label, second.select(F.col("v").alias("c"), F.col("c").alias("c2")), ["c"], ["_key"], how="left")
    label = written(label.select("_key", F.coalesce("c2", "c").alias("_c")), "labels")
    out = written(spread_join(feats.select("_id", "_n", "_key"), label, ["_key"], ["_id"], how="left"), "verdict")
    for done in (feats, classes, buckets, members, pairs, near, sets, first, second, label):
        dropped(done)
    component = F.when(F.col("_id").isNotNull(), F.coalesce("_c", "_id"))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``df`` with one row of each group of near-duplicates; all columns stay.

    The row of least id stays, once where it is repeated; rows of null id stay.
    """
    verdict = near_duplicates(df, id_col, text_col, width=width, percent=percent)
    gone = written(verdict.where(~F.col("kept")).select(F.col(id_col).alias("_id")).distinct(), "gone")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(id_col).cast("long").alias("_id"))
    kept = rows.join(gone, "_id", "left_anti")
    twice = written(rows.groupBy("_id").count().where("count > 1 and _id is not null").select("_id"), "twice")
    if not twice.isEmpty():
        kept = kept.join(twice, "_id", "left_anti").unionByName(kept.join(twice, "_id", "left_semi").dropDuplicates(["_id"]).select("_id", "_row"))
    return kept.select("_row.*")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents, by four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)
