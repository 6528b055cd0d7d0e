"""A stored full-text index: postings in blocks with score bounds, built once and extended by segments.

``postings/segment=k/part=p`` holds blocks of at most BLOCK_ROWS postings of one term of one scope, best first (high
counts in short texts), with the block's highest count and shortest text; ``p`` is a hash of scope and term, so a
question reads the partitions of its terms and an added text touches only those of its own.  ``sizes/segment=k`` holds
how many texts a scope has and how long they are.  Blocks are cut from sorted streams, so a term of any frequency is
spread over tasks and never gathered in one.  Tasks follow the words to index and the postings to add up, TASK_ROWS
each, so that what one holds does not grow with the texts.

``search`` first reads the blocks' bounds alone.  The best block of each term gives every question scores that its
k-th best fragment reaches at least; a block whose bound, with the best of the question's other terms, stays below
that holds no fragment of the result and is not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.operators.retrieve import BROADCAST_ROWS, TOP_CHANNEL, postings, rank_by, small, terms
from parlance.plans.scratch import materialise

#: Postings of a block, and partitions of a segment by term.
BLOCK_ROWS, PARTS = 128, 16
K1, B = 1.2, 0.75
#: Words that a task indexes, and postings that it adds up to scores.
TASK_ROWS = 1_000_000
#: Scores are rounded to five digits; a block this close below the limit is still read.
MARGIN = 1e-4


def _part(scope: Column, term: Column) -> Column:
    return F.pmod(F.xxhash64(scope, term), F.lit(PARTS)).cast("int")


def _tasks(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def add_segment(docs: DataFrame, path: str, segment: int, key: str, scope: str, text: str, block_rows: int = BLOCK_ROWS) -> None:
    """Write the postings of new texts; a segment that is written again replaces itself."""
    sizes = docs.select(F.col(scope).alias("scope"), F.size(terms(F.col(text))).cast("long").alias("n")).groupBy("scope").agg(F.count(F.lit(1)).alias("docs"), F.count("n").alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"))
    sizes.write.mode("overwrite").parquet(f"{path}/sizes/segment={segment}")
    spark = docs.sparkSession
    tasks = _tasks(spark, spark.read.parquet(f"{path}/sizes/segment={segment}").agg(F.sum("words")).first()[0] or 0)
    p = postings(docs, key, scope, text, tasks=tasks).withColumn("part", _part(F.col("scope"), F.col("term")))
    kinds = {c: p.schema[c].dataType.simpleString() for c in ("scope", "id")}
    schema = f"part int, scope {kinds['scope']}, term string, n int, max_tf long, min_length int, ids array<{kinds['id']}>, tfs array<long>, lengths array<int>"
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(frames):
        head, rows = None, []

        def block():
            ids, tfs, lengths = zip(*rows, strict=True)
            return (*head, len(ids), max(tfs), min(lengths), list(ids), list(tfs), list(lengths))

        for f in frames:
            out = []
            for part, sc, term, i, tf, length in f.itertuples(index=False):
                if rows and (head != (part, sc, term) or len(rows) == block_rows):
                    out.append(block())
                    rows = []
                head = (part, sc, term)
                rows.append((i, tf, length))
            yield pd.DataFrame(out, columns=names, dtype=object)
        if rows:
            yield pd.DataFrame([block()], columns=names, dtype=object)

    order = ["part", "scope", "term", F.desc("tf"), "length", "id"]
    sorted_rows = p.select("part", "scope", "term", "id", "tf", "length").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    sorted_rows.mapInPandas(cut, schema).write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings/segment={segment}")


def _weight(tf: Column, length: Column) -> Column:
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("avg_len")))


def asked_blocks(spark: SparkSession, path: str, questions: DataFrame) -> DataFrame:
    """``(question_id, scope, term, segment, part, n, max_tf, min_length, docs, df, avg_len, bound)``: every block of every asked term; no postings are read."""
    q = questions.select("question_id", "scope", F.explode(F.array_distinct(terms(F.col("question")))).alias("term"))
    q = materialise(q.withColumn("part", _part(F.col("scope"), F.col("term"))))
    parts = [r.part for r in q.select("part").distinct().collect()]  # PARTS at most
    heads = spark.read.parquet(f"{path}/postings").where(F.col("part").isin(parts)).select("segment", "part", "scope", "term", "n", "max_tf", "min_length")
    asked = heads.join(small(q.select("scope", "term").distinct()), ["scope", "term"], "left_semi")
    asked = materialise(asked)
    df = asked.groupBy("scope", "term").agg(F.sum("n").alias("df"))
    sizes = spark.read.parquet(f"{path}/sizes").groupBy("scope").agg(F.sum("docs").alias("docs"), F.try_divide(F.sum("words"), F.sum("texts")).alias("avg_len"))
    rows = asked.join(df, ["scope", "term"]).join(sizes, "scope")
    return q.drop("part").join(rows, ["scope", "term"]).withColumn("bound", _weight(F.col("max_tf"), F.col("min_length")))


def _scored(spark: SparkSession, path: str, blocks: DataFrame) -> DataFrame:
    """``(question_id, fragment_id, score)``: what the given blocks add up to."""
    parts = [r.part for r in blocks.select("part").distinct().collect()]  # PARTS at most
    keys = ["segment", "part", "scope", "term", "n", "max_tf", "min_length"]
    read = spark.read.parquet(f"{path}/postings").where(F.col("part").isin(parts)).join(small(blocks.select(*keys).distinct()), keys, "left_semi")
    each = read.select("scope", "term", F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("p")).select("scope", "term", F.col("p.ids").alias("fragment_id"), F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("length"))
    q = blocks.select("question_id", "scope", "term", "docs", "df", "avg_len").distinct()
    tasks = _tasks(spark, blocks.agg(F.sum("n")).first()[0] or 0)
    # dealt by text: what a question's terms add up to in a text is summed where the text is
    if q.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = each.repartition(tasks, "fragment_id").join(F.broadcast(q), ["scope", "term"])
    else:
        rows = each.join(q, ["scope", "term"]).repartition(tasks, "fragment_id")
    return rows.groupBy("question_id", "fragment_id").agg(F.sum(_weight(F.col("tf"), F.col("length"))).alias("score"))


def search(spark: SparkSession, path: str, questions: DataFrame, k: int = TOP_CHANNEL) -> DataFrame:
    """BM25 (any of the terms) inside a question's scope over all segments, as bm25_top; questions: question_id, scope, question."""
    return rank_by(_scored(spark, path, wanted_blocks(spark, path, questions, k)).withColumn("score", F.round("score", 5)), "question_id", F.desc("score"), F.col("fragment_id")).where(F.col("rank") <= k)


def wanted_blocks(spark: SparkSession, path: str, questions: DataFrame, k: int = TOP_CHANNEL) -> DataFrame:
    """The asked blocks that can hold one of a question's k best fragments."""
    blocks = materialise(asked_blocks(spark, path, questions))
    first = blocks.withColumn("_k", F.row_number().over(Window.partitionBy("question_id", "term").orderBy(F.desc("bound"), "segment", "min_length"))).where("_k = 1").drop("_k")
    partial = _scored(spark, path, materialise(first))
    limit = rank_by(partial, "question_id", F.desc("score"), F.col("fragment_id")).where(F.col("rank") == k).select("question_id", F.col("score").alias("limit"))
    best = blocks.groupBy("question_id", "term").agg(F.max("bound").alias("best"))
    total = best.groupBy("question_id").agg(F.sum("best").alias("total"))
    kept = blocks.join(best, ["question_id", "term"]).join(total, "question_id").join(limit, "question_id", "left")
    kept = kept.where(F.col("limit").isNull() | (F.col("bound") + F.col("total") - F.col("best") >= F.col("limit") - MARGIN))
    return materialise(kept.drop("best", "total", "limit"))
