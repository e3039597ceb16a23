"""Connected components of a distributed edge list, labelled by their least vertex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipule.llm.common import dropped, spread_join, written


def components(edges: DataFrame) -> DataFrame:
    """From edges ``(a, b)`` to ``(v, c)``: each vertex on an edge and its component's least vertex.

    Each round hooks every vertex to its least neighbour, follows the hooks to
    their roots by doubling, and contracts the edges to roots.  Every root left
    is least among its neighbours, so the vertices at least halve each round;
    stars, which near-copies form, take one.  Neighbours are aggregated, and where
    edges or hooks are joined those of a frequent vertex are spread, so a vertex of
    any degree is no burden on one task.
    """
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    total: DataFrame | None = None
    while not left.isEmpty():
        both = left.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.*")
        root = _rooted(written(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("c")), "hooks"))
        if total is None:
            total = root
        else:
            known = spread_join(total.withColumnRenamed("c", "r"), root.select(F.col("v").alias("r"), F.col("c").alias("c2")), ["r"], ["v"], how="left")
            total, old = written(known.select("v", F.coalesce("c2", "r").alias("c")), "components"), total
            dropped(old)
        at = lambda side: root.select(F.col("v").alias(side), F.col("c").alias(f"c_{side}"))
        half = written(spread_join(left, at("a"), ["a"], ["b"]), "edges")
        after = spread_join(half, at("b"), ["b"], ["a"]).select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).where("a < b").distinct()
        left, old = written(after, "edges"), left
        dropped(old)
        dropped(half)
        if root is not total:
            dropped(root)
    dropped(left)
    if total is None:
        kind = edges.schema["a"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"v {kind}, c {kind}")
    return total


def _rooted(hooks: DataFrame) -> DataFrame:
    """Follow hooks ``(v, c)`` until every vertex points to a root."""
    while True:
        jump = spread_join(hooks.select("v", "c"), hooks.select(F.col("v").alias("c"), F.col("c").alias("c2")), ["c"], ["v"]).select("v", F.col("c2").alias("c"), (F.col("c") != F.col("c2")).alias("moved"))
        new = written(jump, "hooks")
        moved = not new.where("moved").isEmpty()
        dropped(hooks)
        hooks = new
        if not moved:
            return hooks
