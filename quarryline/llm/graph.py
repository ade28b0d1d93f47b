"""Connected components of an edge table by alternating star contractions.

Each round is two grouped minima and joins back. No neighbourhood is ever gathered: minima are
combined before the shuffle, and rows of a hot node are dealt over tasks by the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.sources.scratch import materialize

ROUNDS = 40
#: Edges that a task may get if all of them have one node.
LARGE = 1_000_000


def _stars(edges: DataFrame, both: bool, large: bool) -> DataFrame:
    """Links each node's neighbours (larger ones if both directions count, else smaller ones) to its smallest."""
    ways = edges.select("u", "v")
    if both:
        ways = ways.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:  # written, so that the join may split a node with many neighbours
        least = materialize(least, "least")
    joined = ways.join(least, "u")
    out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if both else joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of each node that is not the smallest of its component.

    edges: columns u, v; loops and repeated edges do no harm; an empty table gives no rows.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    mark = None
    for _ in range(ROUNDS):
        said = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if said[0] == 0 or said == mark:
            break
        mark = said
        now = materialize(_stars(_stars(now, True, said[0] > LARGE), False, said[0] > LARGE), "edges")
    else:
        raise RuntimeError(f"components not found in {ROUNDS} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
