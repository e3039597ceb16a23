"""Approximate nearest neighbours by stable projections indexed with kd-trees.

Largest inner product becomes smallest distance: vectors get one more component
that gives all the same norm, queries are scaled to it.  Gaussian (2-stable)
projections to ``DIMS`` dimensions keep distances up to a chi-square factor: the
squared projected distance over the squared distance follows chi-square with
``DIMS`` degrees of freedom.

A kd-tree over projected vectors, with splits fitted on a bounded sample, deals
all rows to cells; in a cell, a finer kd-tree groups them in leaves.  A query
takes cells, then leaves, by rising projected distance and verifies their
vectors exactly.  It stops at the first whose box lies so far that a vector at
the k-th best distance so far would have projected nearer with probability
``CONFIDENCE``.  A first round over the nearest ``FIRST`` cells gives the bound
with which the second round prunes all others.

Equal vectors are one entry with its ``k + 1`` smallest ids, which answer for
the rest in every ranking.  Cells are searched in groups of at most about
twice ``CELL_ROWS`` vectors and chunks of about ``CHUNK`` queries.  A cell's vectors
are shuffled once for each chunk of the queries that are sent to it, so not at
all where none is.

Defined results: rows that repeat an id count as one, that of least bytes; vectors that are null, zero, or hold null or non-finite
components, and those of another length than the most common one, take no part,
nor do rows of null id; with fewer candidates all are returned; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stipule.llm.common import arrow_map, dropped, spread_join, table, written

K, QUERY_MOD = 20, 20
DIMS, CONFIDENCE, SEED = 8, 0.95, 3
CELL_ROWS, LEAF_ROWS, MAX_CELLS, SAMPLE, FIRST, CHUNK = 2048, 128, 65_536, 40_000, 3, 16_384
#: Distances of queries to cells that are held at once: 16 MB.
AT_ONCE = 1 << 21


def chi_square_cdf(x: float, dims: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(dims // 2):
        total += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * total


def chi_square_quantile(p: float, dims: int) -> float:
    """The value that a chi-square variable stays below with probability ``p``."""
    low, high = 0.0, 1.0
    while chi_square_cdf(high, dims) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, dims) < p else (low, middle)
    return high


class Split(NamedTuple):
    """Inner node: rows whose coordinate ``dim`` is below ``cut`` go left. Children at or below -1 are leaves."""

    dim: int
    cut: float
    left: int
    right: int


def kd_tree(points: np.ndarray, leaf_rows: float) -> tuple[list[Split], int]:
    """Median splits along the widest coordinate; leaf ``n`` is child ``-1 - n``."""
    nodes: list[Split] = []
    leaves = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        part = points[rows]
        if len(rows) > max(leaf_rows, 1):
            spread = part.max(axis=0) - part.min(axis=0)
            dim = int(spread.argmax())
            cut = float(np.partition(part[:, dim], len(rows) // 2)[len(rows) // 2])
            low = part[:, dim] < cut
            if 0 < low.sum() < len(rows):
                at = len(nodes)
                nodes.append(Split(dim, cut, 0, 0))
                left = grow(rows[low])
                nodes[at] = Split(dim, cut, left, grow(rows[~low]))
                return at
        leaves += 1
        return -leaves

    grow(np.arange(len(points)))
    return nodes, max(leaves, 1)


def leaf_of(nodes: list[Split], points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    at = np.zeros(len(points), np.int64) if nodes else np.full(len(points), -1, np.int64)
    if nodes:
        dim, cut, left, right = (np.array(x) for x in zip(*nodes, strict=True))
        while (inner := np.flatnonzero(at >= 0)).size:
            n = at[inner]
            at[inner] = np.where(points[inner, dim[n]] < cut[n], left[n], right[n])
    return -1 - at


def box_distance(low: np.ndarray, high: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) to boxes (columns)."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d : d + 1]
        out += np.maximum(np.maximum(low[:, d] - x, x - high[:, d]), 0) ** 2
    return out


class Space(NamedTuple):
    """What projecting needs: the matrix, the common norm, and the stored type."""

    matrix: np.ndarray
    norm: float
    kind: str

    def vectors(self, column: pa.Array) -> np.ndarray:
        """Stored vectors as rows of doubles."""
        flat = np.frombuffer(b"".join(column.to_pylist()), self.kind)
        return flat.reshape(len(column), len(self.matrix) - 1).astype(np.float64)

    def data(self, x: np.ndarray) -> np.ndarray:
        """Projections of data vectors, completed to the common norm."""
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return x @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def query(self, q: np.ndarray) -> np.ndarray:
        """Projections of queries, scaled to the common norm."""
        return (q * self.scale(q)[:, None]) @ self.matrix[:-1]

    def scale(self, q: np.ndarray) -> np.ndarray:
        """Factors that give queries the common norm."""
        return self.norm / np.sqrt((q * q).sum(axis=1))

    def squared(self, score: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Squared distances for inner products with unscaled queries."""
        return np.maximum(2 * self.norm**2 - 2 * scale * score, 0)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """Runs of equal (cell, sub, chunk) and kind in sorted batches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            yield tuple(keys[start][:3]), int(keys[start][3]), batch.slice(start, end - start)


class Cell:
    """The vectors of one group, with a kd-tree over their projections."""

    def __init__(self, space: Space, ids: np.ndarray, x: np.ndarray) -> None:
        self.space = space
        flat = space.data(x)
        nodes, n = kd_tree(flat, LEAF_ROWS)
        leaf = leaf_of(nodes, flat)
        order = np.lexsort((ids, leaf))
        self.ids, self.x, leaf, flat = ids[order], x[order], leaf[order], flat[order]
        self.starts = np.searchsorted(leaf, np.arange(n + 1))
        self.low = np.minimum.reduceat(flat, self.starts[:-1])
        self.high = np.maximum.reduceat(flat, self.starts[:-1])

    def search(self, q: np.ndarray, worst: np.ndarray, k: int, factor: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """The best ``k`` of each query among the vectors it verifies.

        ``worst`` is the k-th best inner product known so far, -inf if none is.
        All queries take their next leaf together; those at one leaf share a product.
        """
        scale = self.space.scale(q)
        far = box_distance(self.low, self.high, self.space.query(q))
        order = far.argsort(axis=1, kind="stable")
        far = np.take_along_axis(far, order, 1)
        best = np.full((len(q), k), -np.inf)
        whom = np.full((len(q), k), np.iinfo(np.int64).max)
        active = np.arange(len(q))
        for step in range(order.shape[1]):
            kth = np.maximum(worst[active], best[active, -1])
            limit = np.where(np.isfinite(kth), factor * self.space.squared(kth, scale[active]), np.inf)
            active = active[far[active, step] <= limit]
            if not len(active):
                break
            leaf = order[active, step]
            by = leaf.argsort(kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[by])) + 1
            for rows in np.split(active[by], cuts):
                n = order[rows[0], step]
                part = slice(self.starts[n], self.starts[n + 1])
                scores = q[rows] @ self.x[part].T
                # Most leaves better few queries: only those are ranked anew.
                better = scores.max(axis=1) >= np.maximum(best[rows, -1], worst[rows])
                if not better.any():
                    continue
                rows, scores = rows[better], scores[better]
                joint = np.concatenate([best[rows], scores], axis=1)
                names = np.concatenate([whom[rows], np.broadcast_to(self.ids[part], scores.shape)], axis=1)
                top = np.lexsort((names, -joint), axis=1)[:, :k]
                best[rows], whom[rows] = np.take_along_axis(joint, top, 1), np.take_along_axis(names, top, 1)
        # What is worse than the k-th best known cannot be in the result.
        keep = np.isfinite(best) & (best >= worst[:, None])
        return [(w[m], b[m]) for w, b, m in zip(whom, best, keep, strict=True)]


def searched(rows: DataFrame, space: Space, k: int, factor: float) -> DataFrame:
    """``(q, id, score)`` of the best ``k`` for each query and group.

    ``rows`` are ``cell, sub, chunk, kind, id, vec, worst``: kind 0 data, kind 1 queries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, cell = None, [], None
        for at, kind, part in _groups(batches):
            if at != key:
                key, held, cell = at, [], None
            if kind == 0:
                held.append(part)
                continue
            if not held:
                continue  # a query sent to a cell without vectors
            if cell is None:
                ids = np.concatenate([p.column("id").to_numpy(zero_copy_only=False) for p in held])
                cell = Cell(space, ids, np.concatenate([space.vectors(p.column("vec")) for p in held]))
            worst = part.column("worst").to_numpy(zero_copy_only=False).astype(float)
            found = cell.search(space.vectors(part.column("vec")), np.where(np.isnan(worst), -np.inf, worst), k, factor)
            q = np.repeat(part.column("id").to_numpy(zero_copy_only=False), [len(w) for w, _ in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int64()), pa.array(np.concatenate([w for w, _ in found]), pa.int64()), pa.array(np.concatenate([b for _, b in found]), pa.float64())],
                names=["q", "id", "score"],
            )

    names = ["cell", "sub", "chunk", "kind", "id", "vec", "worst"]
    placed = rows.select(*names).repartition("cell", "sub", "chunk").sortWithinPartitions("cell", "sub", "chunk", "kind", "id")
    return arrow_map(placed, names, run, "q long, id long, score double")


def vectors(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """Usable rows as ``id`` and binary ``vec``, and the stored number type."""
    held = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    kind = "<f4" if isinstance(df.schema[vec_col].dataType.elementType, T.FloatType) else "<f8"
    finite = F.forall(held, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    usable = rows.where(F.col("id").isNotNull() & held.isNotNull() & (F.size(held) > 0) & finite & F.exists(held, lambda x: x != 0))
    size = usable.groupBy(F.size(held).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    usable = usable.where(F.size(held) == (size[0]["n"] if size else 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)
            wide = len(flat) // max(batch.num_rows, 1)
            raw = [flat[i * wide : (i + 1) * wide].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "vec"])

    return arrow_map(usable, ["id", "v"], run, "id long, vec binary"), kind


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """Equal vectors as one row: ``id`` (the least), ``vec``, ``ids`` (the ``keep`` least).

    Each task first collapses its own rows, so a very common vector costs the
    shuffle one row a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(set(v))[:keep] for v in held.values()], pa.list_(pa.int64()))], names=["vec", "ids"])
            held.clear()
            return out

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held.setdefault(v, [])
                own.append(i)
                if len(own) > 8 * keep:
                    held[v] = sorted(set(own))[:keep]
            if len(held) > 20_000:
                yield flush()
        if held:
            yield flush()

    local = arrow_map(rows, ["id", "vec"], run, "vec binary, ids array<long>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    return local.groupBy("vec").agg(ids.alias("ids")).select(F.col("ids")[0].alias("id"), "vec", "ids")


def nearest(df: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", *, k: int = K, confidence: float = CONFIDENCE) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` largest inner products found.

    ``queries`` picks query rows by their ``id``; a query's own row is no candidate.
    """
    found, kind = vectors(df, id_col, vec_col)
    rows = written(found, "vectors")
    spark = df.sparkSession
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        again, rows = rows, written(rows.groupBy("id").agg(F.min("vec").alias("vec")), "vectors")
        dropped(again)
    classes = written(distinct_vectors(rows, k + 1), "distinct")
    few = classes.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(SAMPLE)
    sample = np.array([np.frombuffer(r["vec"], kind) for r in few.collect()], float)
    names = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], names)
    wide = sample.shape[1]

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind).reshape(-1, wide).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array([float((x * x).sum(axis=1).max(initial=0))])], names=["m"])

    top = arrow_map(classes, ["vec"], norms, "m double").agg(F.max("m").alias("m"), F.count(F.lit(1))).collect()[0]["m"]
    matrix = np.random.default_rng(SEED).normal(size=(wide + 1, DIMS))
    space = Space(matrix, math.sqrt(top), kind)
    total = classes.count()
    cells = max(1, min(MAX_CELLS, -(-total // CELL_ROWS)))
    nodes, _ = kd_tree(space.data(sample), len(sample) / cells)
    factor = chi_square_quantile(confidence, DIMS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = space.data(space.vectors(batch.column(1))) if batch.num_rows else np.zeros((0, DIMS))
            cell = leaf_of(nodes, flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), *(pa.array(flat[:, d]) for d in range(DIMS))], names=["id", "vec", "cell", *(f"p{d}" for d in range(DIMS))])

    placed = written(arrow_map(classes, ["id", "vec"], place, "id long, vec binary, cell int, " + ", ".join(f"p{d} double" for d in range(DIMS))), "placed")
    edges = [f(f"p{d}").alias(f"{n}{d}") for n, f in (("l", F.min), ("h", F.max)) for d in range(DIMS)]
    boxes = sorted(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *edges).collect())  # at most about MAX_CELLS rows
    low = np.array([[b[f"l{d}"] for d in range(DIMS)] for b in boxes])
    high = np.array([[b[f"h{d}"] for d in range(DIMS)] for b in boxes])
    number, subs = np.array([b["cell"] for b in boxes]), {b["cell"]: -(-b["n"] // (2 * CELL_ROWS)) for b in boxes}
    asked = rows.where(queries)

    def routed(first: bool):
        def sent(q: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            far = box_distance(low, high, space.query(q))
            near = np.zeros(far.shape, bool)
            np.put_along_axis(near, far.argsort(axis=1, kind="stable")[:, :FIRST], True, 1)
            if first:
                return np.nonzero(near)
            limit = np.where(np.isnan(worst), np.inf, factor * space.squared(worst, space.scale(q)))
            return np.nonzero(~near & (far <= limit[:, None]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, AT_ONCE // len(low))
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    who, where = sent(space.vectors(part.column(1)), part.column(2).to_numpy(zero_copy_only=False).astype(float))
                    take = part.take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([pa.array(number[where].astype(np.int32)), *take.columns], names=["cell", "id", "vec", "worst"])

        return run

    def round_of(ask: DataFrame, first: bool) -> DataFrame:
        to = written(arrow_map(ask, ["id", "vec", "worst"], routed(first), "cell int, id long, vec binary, worst double"), "routed")
        used = [(r["cell"], int(subs[r["cell"]]), -(-r["count"] // CHUNK)) for r in to.groupBy("cell").count().collect()]  # a row a cell
        plan = F.broadcast(spark.createDataFrame(used, "cell int, subs int, chunks int"))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(n)).cast("int")
        data = placed.join(plan, "cell").withColumn("sub", deal(SEED + 2, "subs")).select("cell", "sub", each("chunks").alias("chunk"), F.lit(0).alias("kind"), "id", "vec", F.lit(None).cast("double").alias("worst"))
        sent = to.join(plan, "cell").withColumn("chunk", deal(SEED + 1, "chunks")).select("cell", each("subs").alias("sub"), "chunk", F.lit(1).alias("kind"), "id", "vec", "worst")
        out = written(searched(data.unionByName(sent), space, k + 1, factor), "found")
        dropped(to)
        return out

    one = round_of(asked.withColumn("worst", F.lit(None).cast("double")), True)
    # At most (k + 1) * FIRST scores for each query and group.  Its own row may be among the k + 1.
    bound = one.groupBy("q").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select(F.col("q").alias("id"), F.when(F.size("s") > k, F.element_at("s", k + 1)).alias("worst"))
    two = round_of(asked.join(bound, "id", "left"), False)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    both = one.unionByName(two).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    named = spread_join(written(both, "best"), classes.select("id", "ids"), ["id"], ["q"]).select(F.col("q").alias("query_id"), "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return named.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector of ``embeddings``."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % QUERY_MOD == 0)
