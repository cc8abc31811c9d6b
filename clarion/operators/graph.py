"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clarion.functions.lineage import remove, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v.

    Large: each node's larger neighbours are hung on its least neighbour (or itself).
    Small: each node and its smaller neighbours are hung on the least of them.
    The minimum per node is combined before the shuffle, so a hub costs one row a task.
    """
    if large:
        seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = seen.groupBy("u").agg(F.min("v").alias("m"))
        out = seen.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every node of an edge; component is the least id reachable.

    Self loops, repeated and reversed edges and null ends are allowed (null ends are
    dropped). Nodes without edges do not appear: their component is their own id.
    The number of rounds grows with the logarithm of the graph; every round is written
    to the shared folder, the one before it goes, and only two counters come back to the driver.
    """
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    rounds: list[str] = []
    e = stored(e.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct(), rounds)
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        e = stored(_star(_star(e, large=True), large=False), rounds)
        remove(e.sparkSession, rounds.pop(0))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
