"""Streaming queries over the driver's events, written as files first; their SQL is that of the batch twins."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from parlance import bind
from parlance.bindings import events as ev
from parlance.operators import folds
from parlance.plans.scratch import materialise, scratch_dir
from parlance.streaming import jobs
from parlance.streaming.state import BatchLog, StateTable

QUERIES, SQL = {}, {}
#: Positions that an event waits for its referent before it is parked.
PARK_AFTER = 300
#: Files of a batch: all of a part's.
ALL_FILES = 1_000_000


def _streamed(rows_of, parts, batch):
    """A log that grows by a part at a time, and a stream that is run again after each; a part may be any number of files."""
    path = checkpoint = None
    for part in parts:
        rows = rows_of(part)
        s = rows.sparkSession
        path, checkpoint = path or scratch_dir(s), checkpoint or scratch_dir(s)
        rows.write.mode("append").parquet(path)
        jobs.run_now(jobs.read_log(s, path, rows.schema, ALL_FILES), "", checkpoint, batch)


def _range(rows, column, k, n):
    """The k-th of n equal ranges of a number's span."""
    lo, hi = rows.agg(F.min(column), F.max(column)).first()
    step = (hi - lo) // n + 1
    return rows.where((F.col(column) >= lo + k * step) & (F.col(column) < lo + (k + 1) * step))


def v5_stream_apply_once(s, d):
    """Versions in order, cut into six batches, each of which also repeats a part of the one before: each version is applied once."""
    e = materialise(bind.event_log(s, d).select("aggregate_id", "version", "commit_position"))

    def part(k):
        rows = _range(e, "version", k, 6)
        return rows.unionByName(_range(e, "version", k - 1, 6).where("version % 5 = 0")) if k else rows

    schema = e.schema
    out = BatchLog(s, scratch_dir(s), schema)
    applied = StateTable(s, scratch_dir(s), _only(schema, "aggregate_id", "version"), ["aggregate_id"])
    _streamed(part, range(6), jobs.apply_once(out, applied))
    return out.all()


def _only(schema, *names):
    return type(schema)([schema[n] for n in names])


def _held(s, d):
    e = materialise(bind.event_log(s, d).select("aggregate_id", "event_type", "commit_position", "version"))
    held = jobs.Held.at(s, scratch_dir(s), e.schema, "aggregate_id")
    _streamed(lambda k: _range(e, "commit_position", k, 5), range(5), jobs.hold_missing(held, "aggregate_id", F.col("event_type") == "signup", PARK_AFTER))
    return held


def v8_stream_hold(s, d):
    """What becomes of every event in five batches: applied (and when), parked or still held."""
    held = _held(s, d)
    parts = [held.applied.all().withColumn("outcome", F.lit("applied"))]
    parts += [x.withColumns({"applied_at": F.lit(None).cast("long"), "outcome": F.lit(o)}) for x, o in ((held.parked.all(), "parked"), (held.pending.last_before(1 << 40), "held"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("commit_position", "aggregate_id", "event_type", "outcome", "applied_at")


def v9_stream_redrive(s, d):
    """Parked events of the stream, judged again at its end."""
    done, parked = jobs.redrive_parked(_held(s, d), "aggregate_id")
    both = done.withColumn("outcome", F.lit("redriven")).unionByName(parked.withColumn("outcome", F.lit("still_parked")))
    return both.select("commit_position", "outcome")


def s8_stream_subscription(s, d):
    """A subscription run twice, with new files in between: each event of an allowed type arrives once."""
    e = ev._cat(s, d).select("commit_position", "category", "event_type")
    allowed = s.createDataFrame(list(ev._ALLOWED), "category string, event_type string")
    path, target, checkpoint = scratch_dir(s), scratch_dir(s), scratch_dir(s)
    for k in range(2):
        e.where(F.col("commit_position") % 2 == k).write.mode("append").parquet(path)
        jobs.run_now(jobs.subscribe(jobs.read_log(s, path, e.schema, 2), allowed), target, checkpoint)
    return s.read.schema(e.schema).parquet(target)


def _read(fold, job):
    """The fold, reading the wide events of the log as its job does."""
    return replace(fold, prepare=lambda e, then=fold.prepare: then(ev._READS[job](e)))


#: Makers: expressions need a session.
FOLDS = {
    "fragments": folds.fragments,
    "headers": folds.headers,
    "entities": folds.entities,
    "metadata": folds.metadata,
    "speakers": folds.speakers,
    "kept_edits": lambda: folds.kept_edits(["aggregate_id", "dimension"]),
    "overlays": folds.overlays,
    "statuses": folds.statuses,
}


def v23_incremental(s, d):
    """The states of all jobs after a stream of batches that come out of order, with gaps and repeats; equal to those of one replay."""
    e = materialise(ev._wide(s, d))
    cut = F.pmod(F.xxhash64("commit_position"), F.lit(4))

    def part(k):
        rows = e.where(cut == 3 - k)
        return rows.unionByName(e.where((cut == 4 - k) & (F.col("version") % 3 == 0))) if k else rows

    p = jobs.Projection(s, scratch_dir(s), s.createDataFrame([], e.schema), {n: _read(make(), n) for n, make in FOLDS.items()})
    _streamed(part, range(4), p.step)
    return ev.all_states({n: p.result(n) for n in FOLDS})


def v17_stream_notifications(s, d):
    e = ev._cat(s, d).select("commit_position", "aggregate_id", "category")
    i = F.when(F.col("aggregate_id") % 6 != 0, F.col("aggregate_id").cast("string"))
    path, target = scratch_dir(s), scratch_dir(s)
    e.write.parquet(path)
    jobs.run_now(jobs.notifications(jobs.read_log(s, path, e.schema), F.col("category"), i, (F.col("aggregate_id") % 4).cast("string")), target, scratch_dir(s))
    out = s.read.schema("commit_position long, scope string").parquet(target)
    return out.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.max("commit_position").alias("newest"))


for f in (v5_stream_apply_once, v8_stream_hold, v9_stream_redrive, s8_stream_subscription, v17_stream_notifications, v23_incremental):
    QUERIES[f.__name__] = f
SQL["v5_stream_apply_once"] = f"WITH {bind.EVENTS} SELECT aggregate_id, version, commit_position FROM event_log"
_HELD = f"""{bind.EVENTS}, op AS (SELECT aggregate_id, min(commit_position) AS opened_at FROM event_log WHERE event_type = 'signup' GROUP BY 1), tp AS (SELECT max(commit_position) AS newest FROM event_log),
ho AS (SELECT commit_position, aggregate_id, event_type, opened_at, CASE WHEN opened_at <= commit_position + {PARK_AFTER} THEN 'applied' WHEN newest > commit_position + {PARK_AFTER} THEN 'parked' ELSE 'held' END AS outcome FROM event_log LEFT JOIN op USING (aggregate_id), tp)"""
SQL["v8_stream_hold"] = f"WITH {_HELD} SELECT commit_position, aggregate_id, event_type, outcome, CASE WHEN outcome = 'applied' THEN greatest(commit_position, opened_at) END AS applied_at FROM ho"
SQL["v9_stream_redrive"] = f"WITH {_HELD} SELECT commit_position, CASE WHEN opened_at IS NULL THEN 'still_parked' ELSE 'redriven' END AS outcome FROM ho WHERE outcome = 'parked'"
SQL["s8_stream_subscription"] = ev.SQL["s8_subscription"]
SQL["v17_stream_notifications"] = ev.SQL["v17_notifications"]
SQL["v23_incremental"] = ev.SQL["v23_rebuild"]
