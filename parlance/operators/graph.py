"""Walks over any edge table (src, dst): frontier joins, one per hop, each written to shared storage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.plans.scratch import materialise


#: Hops after which a walk without a stated depth is given up.
MAX_HOPS = 10_000


#: Hops whose rows are written together as one table of the next size.
FAN = 16


class Seen:
    """What a walk has found: a table per hop, of which FAN at a time become one.

    A row is written once for its hop and once more for every size of table it moves up to, so what is
    written grows with the rows found (times the logarithm of the hops), and few tables are read in a hop.
    """

    def __init__(self, fan: int = FAN):
        self.fan, self.sizes = fan, [[]]

    def add(self, rows: DataFrame) -> None:
        self.sizes[0].append(rows)
        for k in range(len(self.sizes)):
            if len(self.sizes[k]) < self.fan:
                return
            if k + 1 == len(self.sizes):
                self.sizes.append([])
            self.sizes[k + 1].append(materialise(reduce(DataFrame.unionByName, self.sizes[k])))
            self.sizes[k] = []

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [t for tables in self.sizes for t in tables])


#: Entries of a node that one task walks on from; a node that more have reached is dealt to several tasks.
HOT = 2_000


def _onward(edge: DataFrame, rows: int, steps: DataFrame) -> DataFrame:
    """``(entry, node)``: where one step leads from a hop of so many rows; what many entries have reached is walked on from by several tasks."""
    few = edge.select("entry", "node")

    def walk(few, steps, on):
        return few.join(steps, on).select("entry", F.col("next").alias("node"))

    if rows <= HOT:
        return walk(few, steps, ["node"])
    hot = materialise(few.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).withColumn("ways", F.ceil(F.col("n") / HOT).cast("int")))
    ways, held = hot.agg(F.sum("ways"), F.sum("n")).first()
    if not held:
        return walk(few, steps, ["node"])
    hot, tasks = F.broadcast(hot.drop("n")), max(edge.sparkSession.sparkContext.defaultParallelism, 2 * ways)  # a row for HOT rows of the hop, at most
    shares = few.join(hot, "node").select("entry", "node", F.pmod(F.xxhash64("entry"), "ways").cast("int").alias("way")).repartition(tasks, "node", "way")
    each = steps.join(hot, "node").select("node", "next", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way")).repartition(tasks, "node", "way")
    found = walk(shares, each, ["node", "way"])
    return found if held == rows else found.unionByName(walk(few.join(hot, "node", "left_anti"), steps, ["node"]))


def reach(edges: DataFrame, start: DataFrame, depth: int | None = None, direction: str = "out", ready: bool = False) -> DataFrame:
    """``(entry, node, depth)``: nodes within ``depth`` hops of each entry (any number if None), at their smallest depth.

    A hop writes only what it found; the last of a stated depth is left to the caller, who writes it if it is read more than
    once.  Without a depth the walk ends when a hop finds nothing new, and raises after MAX_HOPS hops.
    ready: the edges are written already and none comes twice.
    """
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    into = edges.select(F.col("dst").alias("node"), F.col("src").alias("next"))
    steps = {"out": out, "in": into, "both": out.unionByName(into)}[direction]
    steps = steps if ready else materialise(steps.distinct())
    seen, edge = Seen(), materialise(start.select("entry", "node").distinct().withColumn("depth", F.lit(0)))
    seen.add(edge)
    for k in range(1, (MAX_HOPS if depth is None else depth) + 1):
        rows = edge.count()
        if not rows:
            return seen.rows()
        found = _onward(edge, rows, steps).withColumn("depth", F.lit(k))
        least = seen.rows().unionByName(found).groupBy("entry", "node").agg(F.min("depth").alias("depth"))
        if k == depth:
            return least
        edge = materialise(least.where(F.col("depth") == k))
        seen.add(edge)
    if depth is None:
        raise RuntimeError(f"the walk did not end in {MAX_HOPS} hops")
    return seen.rows()


def _lighter_ends(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Each edge with the entries of that end which fewer have reached; ``_other`` is the end still to be looked up."""
    n = materialise(reached.groupBy("node").agg(F.count(F.lit(1)).alias("n")))
    both = edges.join(n.toDF("src", "_src"), "src").join(n.toDF("dst", "_dst"), "dst")
    both = materialise(both.withColumn("_by_src", F.col("_src") <= F.col("_dst")).drop("_src", "_dst"))
    by_src = both.where("_by_src").join(reached.toDF("entry", "src"), "src").select("entry", F.col("dst").alias("_other"), *edges.columns)
    by_dst = both.where("not _by_src").join(reached.toDF("entry", "dst"), "dst").select("entry", F.col("src").alias("_other"), *edges.columns)
    return by_src.unionByName(by_dst)


def induced(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Edges with both ends among an entry's reached nodes; what is given is read several times."""
    r = reached.select("entry", "node").where("entry is not null")
    return _lighter_ends(edges, r).join(r.toDF("entry", "_other"), ["entry", "_other"]).drop("_other")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge ends that are no nodes."""
    n = nodes.select("node").distinct()
    a = edges.select(F.col("src").alias("node"), "dst").join(n, "node", "left_anti").select(F.col("node").alias("missing"), F.lit("src").alias("side"))
    b = edges.select(F.col("dst").alias("node"), "src").join(n, "node", "left_anti").select(F.col("node").alias("missing"), F.lit("dst").alias("side"))
    return a.unionByName(b).groupBy("missing", "side").agg(F.count(F.lit(1)).alias("n_edges"))


def minimal_context(edges: DataFrame, start: DataFrame, nodes: DataFrame, wanted: str, depth: int) -> DataFrame:
    """Upstream nodes up to the smallest depth that holds a node of the wanted type, and the entry's direct out-neighbours."""
    up = materialise(reach(edges, start, depth, "in"))
    hit = up.where("depth > 0").join(nodes.where(F.col("type") == wanted).select("node"), "node", "left_semi").groupBy("entry").agg(F.min("depth").alias("enough"))
    above = up.join(hit, "entry").where("depth <= enough").select("entry", "node")
    direct = start.select("entry", F.col("node").alias("src")).join(edges, "src").select("entry", F.col("dst").alias("node"))
    return above.unionByName(direct).distinct()


def coverage(children: DataFrame, parent: str, state: str) -> DataFrame:
    """none / partial / full over children whose state is one of these."""
    full, none = F.bool_and(F.col(state) == "full"), F.bool_and(F.col(state) == "none")
    return children.groupBy(parent).agg(F.when(full, "full").when(none, "none").otherwise("partial").alias("coverage"), F.count(F.lit(1)).alias("n_children"))


def inherited(nodes: DataFrame) -> DataFrame:
    """Value of a node or of its nearest ancestor that has one; nodes: node (unique), parent, value.

    Pointers double: after k rounds a node without a value yet points 2^k levels up, so that chains
    of any length end within log2 of the number of nodes.  What is open then runs in a circle and,
    like a chain that ends without one, has no value.
    """
    now = materialise(nodes.select("node", "value", F.when(F.col("value").isNull(), F.col("parent")).alias("at")))
    levels = 1
    while levels <= nodes.count() and not (open_ := now.where("at is not null")).isEmpty():
        up = now.select(F.col("node").alias("at"), F.col("value").alias("found"), F.col("at").alias("next"))
        moved = open_.join(up, "at", "left").select("node", F.col("found").alias("value"), F.col("next").alias("at"))
        now = materialise(now.where("at is null").unionByName(moved))
        levels *= 2
    return now.select("node", "value")


def unreachable(edges: DataFrame, nodes: DataFrame, start_types: list[str]) -> DataFrame:
    """Nodes that no walk of any length from a node of the start types gets to."""
    start = nodes.where(F.col("type").isin(*start_types)).select(F.lit(0).alias("entry"), "node")
    return nodes.join(reach(edges, start).select("node"), "node", "left_anti")
