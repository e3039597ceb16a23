"""Removing repeated passages by longest previous factors over suffix order.

Every ``LENGTH``-byte window that also starts in a document of smaller id goes;
the first occurrence stays.  Rows of equal text are settled first: all but the
least id go whole.  Of the distinct texts:

1. Each text's windows fall in runs that share an anchor (see ``suffixes``).
   Equal windows have equal anchors, so only runs whose anchor occurs in two
   texts can repeat.  Anchors are compared as packed 5-byte numbers in buckets;
   one that a task already meets in several texts costs its bucket one entry.
2. The bytes of those runs are brought together by anchor.  Suffixes are sorted,
   and a window whose longest previous factor in a smaller document has full
   length is marked.
3. An anchor in more than ``HEAVY`` texts is not gathered: equal runs are settled
   by aggregating their digests.  One run of each kind is left; up to ``KINDS`` of
   them are gathered, and of more the windows are aggregated by their digests.

Runs count as equal if anchor and digest agree, which for different ones has a
probability of 2 ** -64 for each pair; texts by 64 bits, where only different texts
that also share an anchor with no third one could be taken for one.

Matches never cross documents, and overlapping ones are judged on the input.

Defined results: null texts are empty; texts shorter than a window keep all;
rows of equal id never remove each other, and rows of null id neither remove nor
lose anything; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipule.llm.common import arrow_map, dropped, hot_keys, shared, spread_join, table, text_bytes, written
from stipule.llm.sketch import MIX, mixed
from stipule.llm.suffixes import LENGTH, merged, repeated, runs, window_words
from stipule.llm.suffixes import digests as digests_of

#: Bits of an anchor within its bucket, anchors a bucket aims at, least bits of a bucket's number.
LOW_BITS, BUCKET_ANCHORS, LEAST_BITS = 40, 500_000, 8
#: Texts of one anchor that are gathered in one task, and runs looked at together.
HEAVY, CHUNK_ROWS = 500, 20_000
#: Different runs of a frequent anchor that are gathered in one task: their windows take 15 MB.
KINDS = 10_000
#: Anchors a task collects before it writes them out, and rows it gives out at once.
FLUSH, ROWS_OUT = 500_000, 50_000
LOW = np.uint64((1 << LOW_BITS) - 1)
#: Kinds of runs: of anchors in few texts, in many, and those settled within a batch.
FEW, MANY, KNOWN = 0, 1, 2


def digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, bytes, digest and number of the text, and SHA-256 of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [text_bytes(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array([xxhash.xxh3_128_digest(b) for b in raw], pa.binary()), pa.array([_text_number(b) for b in raw], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in raw], pa.string())],
                names=["id", "n", "key", "text", "sha"],
            )

    return arrow_map(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), ["id", "text"], run, "id long, n long, key binary, text long, sha string")


def _packed(values: np.ndarray) -> bytes:
    """Numbers below 2 ** 40 as 5 bytes each."""
    return np.ascontiguousarray(values.astype("<u8")[:, None].view(np.uint8)[:, :5]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8")[:, 0]


def _text_number(data: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(data), "little", signed=True)


def _anchors(data: bytes, bits: int) -> np.ndarray:
    return runs(data).anchor >> np.uint64(64 - bits - LOW_BITS)


def anchor_entries(df: DataFrame, text_col: str, bits: int) -> DataFrame:
    """Packed anchors of all texts by bucket: ``bucket, known, anchors, texts, counts``.

    Of an anchor that one task meets in several texts, the bucket gets one entry
    with their number; the others are known to be shared and only pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, seen, size = [], [], set(), 0
        for batch in batches:
            for value in batch.column(0):
                data = text_bytes(value.as_py())
                if len(data) < LENGTH or (digest := xxhash.xxh3_128_digest(data)) in seen:
                    continue
                seen.add(digest)
                found = np.unique(_anchors(data, bits))
                held.append(found)
                own.append(_text_number(data))
                size += len(found)
                if size >= FLUSH:
                    yield _entries(held, own, bits)
                    held, own, seen, size = [], [], set(), 0
        if held:
            yield _entries(held, own, bits)

    return arrow_map(df, [text_col], run, "bucket long, known boolean, anchors binary, texts binary, counts binary")


def _entries(held: list[np.ndarray], own: list[int], bits: int) -> pa.RecordBatch:
    anchor = np.concatenate(held)
    text = np.repeat(np.array(own, np.int64).view(np.uint64), [len(h) for h in held])
    order = np.argsort(anchor, kind="stable")
    first = np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]])
    many = np.diff(np.append(np.flatnonzero(first), len(anchor)))
    count = np.zeros(len(anchor), np.int64)
    count[order[first]] = many
    rows: list[tuple] = []
    for known, pick in ((False, np.flatnonzero(count > 0)), (True, np.flatnonzero(count == 0))):
        # Known entries need no bucket: their texts deal them out.
        bucket = (anchor[pick] >> np.uint64(LOW_BITS)) if not known else mixed(text[pick]) >> np.uint64(64 - bits)
        by = np.argsort(bucket, kind="stable")
        pick, bucket = pick[by], bucket[by]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for part, b in zip(np.split(pick, cuts), bucket[np.concatenate([[0], cuts])] if len(pick) else [], strict=False):
            high = (anchor[part] >> np.uint64(LOW_BITS)).astype("<u4").tobytes() if known else np.minimum(count[part], 65535).astype("<u2").tobytes()
            rows.append((int(b), known, _packed(anchor[part] & LOW), text[part].astype("<u8").tobytes(), high))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "known", "anchors", "texts", "counts"])


def shared_anchors(entries: DataFrame) -> DataFrame:
    """``(text, anchor)`` where the anchor is in several texts; a null text marks an anchor as heavy."""

    def out(text: np.ndarray, anchor: np.ndarray, heavy: np.ndarray) -> Iterator[pa.RecordBatch]:
        texts = pa.concat_arrays([pa.array(text.astype(np.int64)), pa.nulls(len(heavy), pa.int64())])
        whole = pa.RecordBatch.from_arrays([texts, pa.array(np.concatenate([anchor, heavy]).astype(np.int64))], names=["text", "anchor"])
        for k in range(0, whole.num_rows, ROWS_OUT):
            yield whole.slice(k, ROWS_OUT)

    def bucket(number: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor = np.concatenate([_unpacked(p[0]) for p in parts])
        text = np.concatenate([np.frombuffer(p[1], "<u8") for p in parts])
        count = np.concatenate([np.frombuffer(p[2], "<u2") for p in parts]).astype(np.int64)
        order = np.lexsort((text, anchor))
        anchor, text, count = anchor[order], text[order], count[order]
        starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(anchor))))
        ends = np.append(starts[1:], len(anchor)) - 1
        total = np.add.reduceat(count, starts)
        shared = (text[starts] != text[ends]) | (np.maximum.reduceat(count, starts) > 1)
        keep = shared[group]
        high = np.uint64(number << LOW_BITS)
        return out(text[keep], anchor[keep] | high, anchor[starts[total > HEAVY]] | high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            for number, known, anchors, texts, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if known:
                    anchor = _unpacked(anchors) | np.frombuffer(extra, "<u4").astype(np.uint64) << np.uint64(LOW_BITS)
                    yield from out(np.frombuffer(texts, "<u8"), anchor, np.zeros(0, np.uint64))
                    continue
                if number != at and parts:
                    yield from bucket(at, parts)
                    parts = []
                at = number
                parts.append((anchors, texts, extra))
        if parts:
            yield from bucket(at, parts)

    placed = entries.repartition("known", "bucket").sortWithinPartitions("known", "bucket")
    return arrow_map(placed, ["bucket", "known", "anchors", "texts", "counts"], run, "text long, anchor long")


def compressed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, z`` with the text's number and its bytes compressed, for a cheap shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            raw = [text_bytes(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_text_number(b) for b in raw], pa.int64()), pa.array([pack.compress(b) for b in raw], pa.binary())], names=["id", "text", "z"])

    return arrow_map(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), ["id", "text"], run, "id long, text long, z binary")


def run_rows(texts: DataFrame, bits: int) -> DataFrame:
    """The runs of ``(id, text, z, light, heavy)`` whose anchors are listed: ``kind, anchor, d, id, text, at, size, held``.

    ``at`` is the first window's place and ``held`` the bytes of all its windows.
    Where a batch has the same run in a document of smaller id, the later one goes
    whole, which needs no comparison: its ``kind`` is ``KNOWN`` and its bytes stay.
    """

    names = ["kind", "anchor", "d", "id", "text", "at", "size", "held"]

    def given(anchors: list[np.ndarray], digest: list[np.ndarray], high: list[np.ndarray], rows: list[int], at: list[np.ndarray], held: list[bytes], batch: pa.RecordBatch) -> pa.RecordBatch:
        join = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)
        who = np.repeat(rows, [len(a) for a in at]).astype(np.int64)
        ids, anchor, d = batch.column(0).to_numpy(zero_copy_only=False)[who], join(anchors, np.int64), join(digest, np.uint64).view(np.int64)
        order = np.lexsort((ids, d, anchor))
        new = np.concatenate([np.ones(min(1, len(order)), bool), (anchor[order][1:] != anchor[order][:-1]) | (d[order][1:] != d[order][:-1])])
        needed = np.zeros(len(order), bool)
        needed[order] = ids[order] == ids[order[new]][np.cumsum(new) - 1]
        kind = np.where(needed, np.where(join(high, bool), MANY, FEW), KNOWN).astype(np.int32)
        kept = pa.array([h if n else None for h, n in zip(held, needed.tolist(), strict=True)], pa.binary())
        size = pa.array([len(h) for h in held], pa.int32())
        cols = [pa.array(kind), pa.array(anchor * needed), pa.array(d * needed), pa.array(ids), batch.column(1).take(pa.array(who)), pa.array(join(at, np.int64)), size, kept]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            anchors, digest, high, rows, at, held = [], [], [], [], [], []
            listed = [[set(x) if x else () for x in batch.column(k).to_pylist()] for k in (3, 4)]
            for row, z in enumerate(batch.column(2)):
                data, light, heavy = open_.decompress(z.as_py()), listed[0][row], listed[1][row]
                found = runs(data)
                anchor = (found.anchor >> np.uint64(64 - bits - LOW_BITS)).astype(np.int64)
                pick = np.array([k for k, a in enumerate(anchor.tolist()) if a in light or a in heavy], np.intp)
                anchors.append(anchor[pick])
                high.append(np.array([a in heavy for a in anchors[-1].tolist()], bool))
                rows.append(row)
                at.append(found.start[pick])
                digest.append(digests_of(np.frombuffer(data, np.uint8), found.start[pick], found.end[pick]))
                held += [data[s:e] for s, e in zip(at[-1].tolist(), (found.end[pick] + LENGTH - 1).tolist(), strict=True)]
                if len(held) > ROWS_OUT:
                    yield given(anchors, digest, high, rows, at, held, batch)
                    anchors, digest, high, rows, at, held = [], [], [], [], [], []
            yield given(anchors, digest, high, rows, at, held, batch)

    return arrow_map(texts, ["id", "text", "z", "light", "heavy"], run, "kind int, anchor long, d long, id long, text long, at long, size int, held binary")


def _windows(held: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all windows of some runs, the run of each, and its place in the run."""
    many = pc.binary_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(held.to_pylist()), np.uint8)
    begin = np.cumsum(many) - many
    many = many - LENGTH + 1
    whose = np.repeat(np.arange(len(held)), many)
    place = np.arange(len(whose)) - np.repeat(np.cumsum(many) - many, many)
    return window_words(data, place + begin[whose]), whose, place


def _intervals(ids: np.ndarray, texts: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (ids, texts, s, e)], names=["id", "text", "s", "e"])


def _settled(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Intervals from whole anchors, their rows sorted by anchor and id."""
    anchor, d, ids, texts, at = (rows[c].to_numpy() for c in ("anchor", "d", "id", "text", "at"))
    size = rows["size"].to_numpy()
    order = np.lexsort((np.arange(len(ids)), d, anchor))
    new = np.concatenate([[True], (anchor[order][1:] != anchor[order][:-1]) | (d[order][1:] != d[order][:-1])])
    kind = np.empty(len(ids), np.int64)  # which distinct run a row is
    kind[order] = np.cumsum(new) - 1
    rep = order[new]  # the first row of each, so that of least id
    # A run that a smaller document has too goes whole.
    whole = ids > ids[rep][kind]
    yield _intervals(ids[whole], texts[whole], at[whole], (at + size)[whole])
    # Differing runs of one anchor are compared window by window.  Those of
    # different anchors have no windows in common, so one suffix order serves all.
    home = anchor[rep]
    several = np.concatenate([[False], home[1:] == home[:-1]])
    several[:-1] |= several[1:]
    asked = np.flatnonzero(several)
    if not len(asked):
        return
    words, whose, place = _windows(rows["held"].take(pa.array(rep[asked])).combine_chunks())
    flags = repeated(words, ids[rep[asked]][whose])
    hit = np.flatnonzero(flags)
    if not len(hit):
        return
    # Stretches of marked windows within one run.
    cut = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (whose[hit[1:]] != whose[hit[:-1]])])
    first, last = hit[cut], hit[np.append(np.flatnonzero(cut)[1:], len(hit)) - 1]
    of = asked[whose[first]]
    # The same document may have a run several times.
    same = np.flatnonzero(~whole & np.isin(kind, of))
    by = np.argsort(kind[same], kind="stable")
    same, kinds = same[by], kind[same][by]
    low, high = np.searchsorted(kinds, of, "left"), np.searchsorted(kinds, of, "right")
    many = high - low
    row = same[np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]
    yield _intervals(ids[row], texts[row], at[row] + np.repeat(place[first], many), at[row] + np.repeat(place[last], many) + LENGTH)


def gathered(rows: DataFrame) -> DataFrame:
    """Intervals ``(id, text, s, e)`` to remove, from runs brought together by anchor.

    Runs of heavy anchors, and known ones, are dealt out by id instead.  The former come
    back as they are:
    with ``anchor``, ``d`` and ``held``, and ``e - s`` their size.
    """

    def plain(found: pa.RecordBatch) -> pa.RecordBatch:
        none = [pa.nulls(found.num_rows, t) for t in (pa.int64(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([*found.columns, *none], names=out)

    def passed(rows: pa.RecordBatch) -> pa.RecordBatch:
        at, many = rows.column("at"), pc.equal(rows.column("kind"), MANY)
        only = lambda c: pc.if_else(many, rows.column(c), pa.scalar(None, rows.column(c).type))
        cols = [rows.column("id"), rows.column("text"), at, pc.add(at, rows.column("size").cast(pa.int64())), only("anchor"), only("d"), rows.column("held")]
        return pa.RecordBatch.from_arrays(cols, names=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            few = pc.equal(batch.column("kind"), FEW)
            light = batch.filter(few)
            if light.num_rows < batch.num_rows:
                yield passed(batch.filter(pc.invert(few)))
            waiting.append(light)
            count += light.num_rows
            if count < CHUNK_ROWS:
                continue
            # The last anchor may go on in the next batch.
            held = pa.Table.from_batches(waiting)
            anchor = held["anchor"].to_numpy()
            end = int(np.searchsorted(anchor, anchor[-1]))
            if end:
                yield from map(plain, _settled(held.slice(0, end)))
            rest = held.slice(end).combine_chunks()
            waiting, count = rest.to_batches(), rest.num_rows if end else 0
        if sum(b.num_rows for b in waiting):
            yield from map(plain, _settled(pa.Table.from_batches(waiting)))

    names, out = ["kind", "anchor", "d", "id", "text", "at", "size", "held"], ["id", "text", "s", "e", "anchor", "d", "held"]
    salted = rows.select(*names, F.when(F.col("kind") != FEW, F.pmod(F.xxhash64("id", "at"), F.lit(1 << 20))).otherwise(0).alias("salt"))
    placed = salted.repartition("anchor", "salt").sortWithinPartitions("kind", "anchor", "id")
    return arrow_map(placed, names, run, "id long, text long, s long, e long, anchor long, d long, held binary")


def aggregated(rows: DataFrame) -> DataFrame:
    """The same intervals for the runs of heavy anchors: by their digests, then of one run of each kind.

    No run's or window's rows meet in one task, however many there are.
    """

    def windows(rows: DataFrame, hot: list[tuple[int, int, int]]) -> DataFrame:
        """``id, text, s, w1, w2`` of all windows of some runs, and the share of a frequent one that a row belongs to."""
        often = np.array(sorted(hot), np.int64).reshape(-1, 3)

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                words, whose, place = _windows(batch.column(3))
                one, two = np.zeros(len(whose), np.uint64), np.ones(len(whose), np.uint64)
                for w in words:
                    one, two = mixed(one * MIX[0] + w), mixed(two * MIX[1] ^ w)
                one, two = one.view(np.int64), two.view(np.int64)
                ids, texts, at = (batch.column(k).to_numpy(zero_copy_only=False)[whose] for k in range(3))
                share = np.zeros(len(whose), np.int32)
                if len(often):
                    held = often[np.minimum(np.searchsorted(often[:, 0], one), len(often) - 1)]
                    some = np.flatnonzero((held[:, 0] == one) & (held[:, 1] == two))
                    share[some] = mixed((ids[some] * 31 + at[some] + place[some]).view(np.uint64)) % held[some, 2].astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, texts, at + place, one, two, share)], names=["id", "text", "s", "w1", "w2", "_share"])

        return arrow_map(rows, ["id", "text", "s", "held"], explode, "id long, text long, s long, w1 long, w2 long, _share int")

    counted = F.count(F.lit(1)).alias("_m")
    least = written(rows.groupBy("anchor", "d").agg(F.min("id").alias("least"), counted), "least")
    kinds = least.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    told = written(spread_join(least, kinds, ["anchor"], ["d"], kinds.withColumnRenamed("kinds", "_m")), "kinds")
    dropped(least)
    settled = written(spread_join(rows, told.drop("_m"), ["anchor", "d"], ["id", "s"], told.select("anchor", "d", "_m")), "heavy")
    dropped(told)
    whole = settled.where("id > least").select("id", "text", "s", "e")
    # One run of each kind is left.  Few kinds of an anchor are compared like runs of a rare one.
    left = settled.where("id = least")
    few = left.where((F.col("kinds") > 1) & (F.col("kinds") <= KINDS))
    some = gathered(few.select(F.lit(FEW).alias("kind"), "anchor", "d", "id", "text", F.col("s").alias("at"), (F.col("e") - F.col("s")).cast("int").alias("size"), "held")).select("id", "text", "s", "e")
    differing, key = left.where(F.col("kinds") > KINDS), ["w1", "w2"]
    first = written(windows(differing, []).groupBy(*key).agg(F.min("id").alias("least"), F.max("id").alias("most"), counted).where("least < most").drop("most"), "windows")
    hot = hot_keys(first.drop("least"), key)
    first = first.drop("_m")
    dealt = [tuple(r) for r in hot.collect()] if hot is not None else []  # at most MOST_SPREAD
    copies = shared(first, hot, key) if hot is not None else first.withColumn("_share", F.lit(0))
    apart = windows(differing, dealt).join(copies, [*key, "_share"]).where("id > least").select("id", "text", "s", (F.col("s") + LENGTH).alias("e"))
    return whole.unionByName(some).unionByName(apart)


def removals(df: DataFrame, id_col: str, text_col: str, found: DataFrame) -> DataFrame:
    """For rows with intervals: ``id, text``, bytes and spans removed, and the digest of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            removed, parts, sha = [], [], []
            for z, cut in zip(batch.column(2), batch.column(3), strict=True):
                data, gone, left, done = open_.decompress(z.as_py()), merged([(c["s"], c["e"]) for c in cut.as_py()]), hashlib.sha256(), 0
                for s, e in gone:
                    left.update(data[done:s])
                    done = e
                left.update(data[done:])
                removed.append(sum(e - s for s, e in gone))
                parts.append(len(gone))
                sha.append(left.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(parts, pa.int64()), pa.array(sha, pa.string())], names=["id", "text", "removed", "parts", "left"])

    # A document's intervals are fewer than its bytes.
    cuts = found.groupBy("id", "text").agg(F.collect_list(F.struct("s", "e")).alias("cuts"))
    return arrow_map(compressed(df, id_col, text_col).join(cuts, ["id", "text"]), ["id", "text", "z", "cuts"], run, "id long, text long, removed long, parts long, left string")


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``."""
    sizes = written(digests(df, id_col, text_col), "digests")
    total = sizes.agg(F.sum("n")).collect()[0][0] or 0
    bits = max(LEAST_BITS, math.ceil(math.log2(max(total, 1) / 18 / BUCKET_ANCHORS)))
    shared = written(shared_anchors(anchor_entries(df.where(F.col(id_col).isNotNull()), text_col, bits)), "shared")
    heavy = shared.where("text is null").select("anchor").distinct().withColumn("heavy", F.lit(True))
    listed = shared.where("text is not null").join(heavy, "anchor", "left")
    # A text's anchors are fewer than its bytes.
    by_text = listed.groupBy("text").agg(F.collect_set(F.when(F.col("heavy").isNull(), F.col("anchor"))).alias("light"), F.collect_set(F.when(F.col("heavy"), F.col("anchor"))).alias("heavy"))
    usable = sizes.where(F.col("id").isNotNull() & (F.col("n") >= LENGTH))
    first = usable.groupBy("key").agg(F.min("id").alias("first"), F.min("text").alias("text"))
    wanted = first.select(F.col("first").alias("id"), "text").join(by_text, "text")
    texts = compressed(df.where(F.col(id_col).isNotNull()), id_col, text_col)
    found = written(gathered(run_rows(texts.join(wanted, ["id", "text"]), bits)), "found")
    dropped(shared)
    cuts, many = found.where("anchor is null").select("id", "text", "s", "e"), found.where("anchor is not null")
    if not many.isEmpty():
        cuts = cuts.unionByName(aggregated(many))
    left = written(removals(df, id_col, text_col, cuts).distinct(), "left")
    dropped(found)
    first = usable.groupBy("key").agg(F.min("id").alias("first"))
    out = spread_join(sizes, first, ["key"], ["id"], how="left").join(left, ["id", "text"], "left")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    pick = lambda whole, part, none: F.when(copy, whole).otherwise(F.coalesce(part, none))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_bytes"),
        pick(F.col("n"), F.col("removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("parts"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.sha2(F.lit("").cast("binary"), 256), F.col("left"), F.col("sha")).alias("kept_sha256"),
    )


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses to passages of earlier documents."""
    return repeats(table(spark, sf_dir, "documents"))
