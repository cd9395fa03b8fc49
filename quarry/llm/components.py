"""Connected components of a large sparse graph, by alternating star operations.

Large-star hangs every node's larger neighbours on its smallest neighbour,
small-star does so with the smaller ones; after few rounds every node hangs on
the smallest of its component.  A round is two groupings with map-side
combining, and its result is a scratch table, so nothing is recomputed after an
executor is lost.  Edges never reach the driver, only their count and checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), both directions present if ``large``, else u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = edges.join(least, "u")
    if large:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    rows, before = edges.count(), None
    state = scratch.save(pairs, f"{name}0", rows)
    step = 0
    while True:
        step += 1
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _star(down, False).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        state = scratch.save(small, f"{name}{step}", rows)
        sign = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if step > 1:
            scratch.drop(f"{name}{step - 2}")
        if sign == before:
            break
        rows, before = sign[0], sign
    own = state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(own)
