"""Connected components as alternating large-star / small-star joins.

Each round is two shuffles keyed by node; hub nodes are summarised by a map-side
``min`` before anything is grouped, so a component of any size never meets in one
task.  Every round is written to shared storage, and the loop ends when a round
changes no edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.plans.scratch import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hook the neighbours of every node to the smallest node of its neighbourhood.

    large: neighbours above the node are hooked; otherwise those below it, and itself.
    """
    if large:
        arcs = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = arcs.groupBy("src").agg(F.min("dst").alias("lo")).select("src", F.least("src", "lo").alias("lo"))
        out = arcs.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("lo").alias("dst"))
    else:
        low = edges.groupBy("src").agg(F.min("dst").alias("lo"))
        out = edges.join(low, "src").select(F.explode(F.array(F.struct(F.col("dst").alias("src"), F.col("lo").alias("dst")), F.struct(F.col("src"), F.col("lo").alias("dst")))).alias("e")).select("e.src", "e.dst")
    return out.where("src != dst").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component = smallest node reachable.

    Null endpoints and self loops carry no connection (a node that has only a self
    loop is not returned).  Repeated and reversed edges count once.  No edges give no rows.
    """
    e = edges.select(F.greatest(src, dst).alias("src"), F.least(src, dst).alias("dst"), F.col(src).isNull() | F.col(dst).isNull() | (F.col(src) == F.col(dst))).toDF("src", "dst", "void").where("not void").drop("void").distinct()
    e = materialise(e)
    mark = None
    for _ in range(max_rounds):
        e = materialise(_star(_star(e, True), False))
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if now == mark:
            return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
