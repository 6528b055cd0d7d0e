"""Places of rows in their group's order, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.common import arrow_with
from parlance.plans.scratch import materialise


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with its rows numbered from 0 in each group, as ``name long``; written once.

    Rows are range-partitioned by group and order, so a group of any size is split over partitions; a
    partition counts its own rows as they stream by, and the few groups that reach over a border (two a partition
    at most, which bounds the broadcasts) get the counts of the partitions before.  Rows equal in ``order`` are
    dealt by a salt and numbered in any order.  ``group`` must not be null; nulls in ``order`` come first.
    """
    made = [c for c in ("_salt", "_range", "_local") if c in df.columns]
    if made:
        raise ValueError(f"reserved columns: {made}")

    def run(parts):
        last, n = object(), 0
        for b in parts:
            local = []
            for g in b.column(group).to_pylist():
                last, n = g, n + 1 if g == last else 0
                local.append(n)
            yield {"_local": local}

    keys = [group, *order, "_salt"]
    ranged = df.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = materialise(arrow_with(ranged.drop("_salt").withColumn("_range", F.spark_partition_id()), "_local long", run))
    ends = rows.groupBy("_range").agg(F.min(group).alias("lo"), F.max(group).alias("hi"))
    ends = ends.select("_range", F.explode(F.array_distinct(F.array("lo", "hi"))).alias(group))
    size = rows.join(F.broadcast(ends), ["_range", group]).groupBy("_range", group).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = size.withColumn("_before", before).where("_before > 0").drop("_n")
    out = rows.join(F.broadcast(starts), ["_range", group], "left")
    return out.withColumn(name, F.col("_local") + F.coalesce("_before", F.lit(0))).drop("_range", "_local", "_before")
