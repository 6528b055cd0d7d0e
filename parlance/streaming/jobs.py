"""Structured Streaming forms of the log jobs: each ends by itself (available-now trigger) and has a batch twin.

No job uses processing-time timers: age is counted from the arrival column, so a run over
what is there always terminates.  Every wait is bounded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parlance.operators.events import apply_new, hold_outcome, missing_referents, scopes_of
from parlance.operators.folds import Fold
from parlance.plans.scratch import materialise
from parlance.streaming.state import BatchLog, StateTable

#: Seconds after which a run is given up.
WAIT = 600


def read_log(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_now(stream: DataFrame, target: str, checkpoint: str, batch: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> None:
    """Process what is there, then stop; rows go to Parquet at ``target`` or to ``batch``."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(batch).start() if batch else w.format("parquet").option("path", target).start()
    try:
        if not q.awaitTermination(WAIT):
            raise TimeoutError("the stream did not end")
    finally:
        q.stop()


def apply_once(target: BatchLog, applied: StateTable) -> Callable[[DataFrame, int], None]:
    """Batch function: of each aggregate, versions above the highest one applied so far go to ``target``, each once.

    applied: (aggregate_id, version), the highest version per aggregate; only the batch's aggregates are read from it and
    written.  Of events with one version the first by position counts.  Nothing that was written to ``target`` is read again.
    """

    def step(batch: DataFrame, number: int) -> None:
        new = target.put(apply_new(batch, applied.before(number)), number)
        applied.put(new.groupBy("aggregate_id").agg(F.max("version").alias("version")), number)

    return step


def notifications(events: DataFrame, category: Column, interview: Column, project: Column) -> DataFrame:
    """One row per event and scope."""
    return events.select("commit_position", F.explode(scopes_of(category, interview, project)).alias("scope"))


def subscribe(events: DataFrame, allowed: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """A stream of a log, limited to the types that their category lets through and, where ``after`` names one, to later positions.

    allowed: category, event_type; after: category, position; both small declared tables.  Where a subscription has got
    to is kept in its checkpoint: a later run of the same one goes on with what has come since.
    """
    out = events.join(F.broadcast(allowed), ["category", "event_type"], "left_semi")
    if after is None:
        return out
    return out.join(F.broadcast(after), "category", "left").where("position is null or commit_position > position").drop("position")


@dataclass(frozen=True)
class Held:
    """What a job that holds events keeps: those applied (with ``applied_at``), parked and pending, when referents opened, the newest position."""

    applied: BatchLog
    parked: BatchLog
    pending: BatchLog
    opened: StateTable
    newest: StateTable

    @classmethod
    def at(cls, spark: SparkSession, path: str, schema: T.StructType, referent: str) -> Held:
        position = schema["commit_position"].dataType
        opened = T.StructType([T.StructField(referent, schema[referent].dataType), T.StructField("opened_at", position)])
        newest = T.StructType([T.StructField("log", T.StringType()), T.StructField("commit_position", position)])
        applied = T.StructType([*schema.fields, T.StructField("applied_at", position)])
        return cls(BatchLog(spark, f"{path}/applied", applied), BatchLog(spark, f"{path}/parked", schema), BatchLog(spark, f"{path}/pending", schema), StateTable(spark, f"{path}/opened", opened, [referent]), StateTable(spark, f"{path}/newest", newest, ["log"]))


def hold_missing(held: Held, referent: str, opens: Column, park_after: int) -> Callable[[DataFrame, int], None]:
    """Batch function for a log in order of position: an event is applied once its referent has opened, in order of ``applied_at`` and position.

    opens: whether an event makes its referent known.  What waits is joined again in every batch, and parked when
    the log has gone on by more than ``park_after`` positions without the referent.  Only positions decide, so
    results are those of ``hold_outcomes`` however the log is cut into batches.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*held.pending.schema.names).unionByName(held.pending.last_before(number))
        before = held.opened.before(number)
        fresh = batch.where(opens).groupBy(referent).agg(F.min("commit_position").alias("opened_at")).join(before, referent, "left_anti")
        held.opened.put(fresh, number)
        top = batch.agg(F.max("commit_position")).first()[0]
        was = [r.commit_position for r in held.newest.before(number).collect()]  # one row
        top = max([p for p in (top, *was) if p is not None], default=None)
        held.newest.put(spark.createDataFrame([("log", top)], held.newest.schema), number)
        known = before.unionByName(held.opened.of([number])) if number % held.opened.full or not number else held.opened.of([number])
        judged = rows.join(known.join(rows.select(referent).distinct(), referent, "left_semi"), referent, "left").withColumn("outcome", hold_outcome(park_after, F.lit(top)))
        held.applied.put(judged.where("outcome = 'applied'").withColumn("applied_at", F.greatest("commit_position", "opened_at")), number)
        held.parked.put(judged.where("outcome = 'parked'"), number)
        held.pending.put(judged.where("outcome = 'held'"), number)

    return step


def redrive_parked(held: Held, referent: str) -> tuple[DataFrame, DataFrame]:
    """(redriven, still parked): parked events are judged again by the referents known now, without a limit on how late these came."""
    return missing_referents(held.parked.all(), held.opened.before(), referent)


class Projection:
    """Folds a log batch by batch: every version once and in order, whatever comes twice, late or early.

    Versions that a gap separates from those applied wait in ``pending``.  Ready events become states, which are merged into
    those of their keys; only keys of the batch are read from a state table and written.
    """

    def __init__(self, spark: SparkSession, path: str, events: DataFrame, folds: dict[str, Fold]):
        self.folds = folds
        self.ready, self.pending = (BatchLog(spark, f"{path}/{n}", events.schema) for n in ("ready", "pending"))
        upto = T.StructType([events.schema["aggregate_id"], events.schema["version"]])
        self.upto = StateTable(spark, f"{path}/upto", upto, ["aggregate_id"])
        none = spark.createDataFrame([], events.schema)
        self.states = {n: StateTable(spark, f"{path}/state-{n}", f.merge(f.of(none)).schema, f.keys) for n, f in folds.items()}

    def step(self, batch: DataFrame, number: int) -> None:
        rows = batch.select(*self.pending.schema.names).unionByName(self.pending.last_before(number))
        rows = apply_new(rows, self.upto.before(number), keep="_applied")
        nth = F.row_number().over(Window.partitionBy("aggregate_id").orderBy("version"))
        # judged once, though both logs are written from it
        rows = materialise(rows.withColumn("_ready", F.col("version") == F.coalesce("_applied", F.lit(-1)) + nth))
        ready = self.ready.put(rows.where("_ready"), number)
        self.pending.put(rows.where("not _ready"), number)
        self.upto.put(ready.groupBy("aggregate_id").agg(F.max("version").alias("version")), number)
        for name, fold in self.folds.items():
            new, state = fold.of(ready), self.states[name]
            old = state.before(number).join(new.select(*fold.keys), fold.keys, "left_semi")
            state.put(fold.merge(old.unionByName(new)), number)

    def result(self, name: str) -> DataFrame:
        return self.folds[name].result(self.states[name].before())
