"""Streams cut in many ways, stopped and started again, against one replay or a plain version."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.bindings import events as ev
from parlance.bindings import streams
from parlance.operators import events as op
from parlance.operators import folds
from parlance.streaming import jobs
from parlance.streaming.state import BatchLog, StateTable, batches

LOG = "aggregate_id int, version int, commit_position long, word string"


def put_files(spark, path, schema, parts):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)


def test_state_table_keeps_the_newest_row(spark, tmp_path):
    """Whatever the distance of full batches; a batch that runs again changes nothing; old folders are not read."""
    schema = T.StructType.fromDDL("k int, v string")
    for full in (1, 3, 100):
        r, want = random.Random(full), {}
        state = StateTable(spark, f"{tmp_path}/{full}", schema, ["k"], full)
        assert state.before().count() == 0
        for number in range(8):
            rows = [(k, f"{number}/{k}") for k in r.sample(range(6), r.randrange(0, 4))]
            for _ in range(2):
                assert {x.k: x.v for x in state.before(number).collect()} == want
                state.put(spark.createDataFrame(rows, schema), number)
            want |= dict(rows)
        assert {x.k: x.v for x in state.before().collect()} == want
    assert batches(spark, f"{tmp_path}/1") == list(range(8)) and StateTable(spark, f"{tmp_path}/1", schema, ["k"], 1).of([7]).count() == len(set(x.k for x in StateTable(spark, f"{tmp_path}/1", schema, ["k"], 1).before().collect()))


def test_versions_above_the_applied_one(spark, tmp_path):
    """Ten batches with repeats, late versions and two events of one version; stopped after four and started again."""
    r, position, parts = random.Random(6), 0, []
    for _ in range(10):
        part = []
        for _ in range(r.randrange(1, 12)):
            position += 1
            part.append((r.randrange(3), r.randrange(12), position, f"w{position}"))
        parts.append(part)
    want, at = [], {}
    for part in parts:
        first = {}
        for a, v, p, w in part:
            first.setdefault((a, v), (a, v, p, w))
        new = [x for x in first.values() if x[1] > at.get(x[0], -1)]
        want += new
        for a, v, _, _ in new:
            at[a] = max(at.get(a, -1), v)
    schema = spark.createDataFrame([], LOG).schema
    out = BatchLog(spark, f"{tmp_path}/out", schema)
    state = lambda: StateTable(spark, f"{tmp_path}/at", T.StructType(schema.fields[:2]), ["aggregate_id"], 4)
    for some in (parts[:4], parts[4:]):
        put_files(spark, f"{tmp_path}/in", LOG, some)
        jobs.run_now(jobs.read_log(spark, f"{tmp_path}/in", schema, 1), "", f"{tmp_path}/checkpoint", jobs.apply_once(out, state()))
    assert sorted(map(tuple, out.all().collect())) == sorted(want)
    assert {x.aggregate_id: x.version for x in state().before().collect()} == at


@pytest.mark.parametrize("cuts", [1, 3, 7])
def test_held_events_come_out_as_in_one_batch(spark, tmp_path, cuts):
    r = random.Random(8)
    rows = [(r.randrange(9), p, p * 3, "open" if r.random() < 0.12 else "use") for p in range(60)]
    e = spark.createDataFrame(rows, LOG)
    opens = F.col("word") == "open"
    want = {x.commit_position: x.outcome for x in op.hold_outcomes(e, "aggregate_id", opens, 40).collect()}
    first = {}
    for a, _, p, w in rows:
        if w == "open":
            first.setdefault(a, p)
    plain = {p: "applied" if first.get(a, 10**9) <= p + 40 else "parked" if 59 * 3 > p + 40 else "held" for a, _, p, _ in rows}
    assert want == plain and set(want.values()) == {"applied", "parked", "held"}
    at = sorted(r.sample(range(1, 60), cuts - 1))
    put_files(spark, f"{tmp_path}/in", LOG, [rows[a:b] for a, b in zip([0, *at], [*at, 60], strict=True)])
    held = jobs.Held.at(spark, f"{tmp_path}/held", e.schema, "aggregate_id")
    jobs.run_now(jobs.read_log(spark, f"{tmp_path}/in", e.schema, 1), "", f"{tmp_path}/checkpoint", jobs.hold_missing(held, "aggregate_id", opens, 40))
    got = {x.commit_position: "applied" for x in held.applied.all().collect()} | {x.commit_position: "parked" for x in held.parked.all().collect()} | {x.commit_position: "held" for x in held.pending.last_before(99).collect()}
    assert got == want and held.applied.all().count() + held.parked.all().count() + held.pending.last_before(99).count() == 60
    assert all(x.applied_at == max(x.commit_position, first[x.aggregate_id]) for x in held.applied.all().collect())
    redriven, parked = jobs.redrive_parked(held, "aggregate_id")
    late = {p for a, _, p, _ in rows if want[p] == "parked" and a in first}
    assert {x.commit_position for x in redriven.collect()} == late and parked.count() == sum(o == "parked" for o in want.values()) - len(late)


def test_subscription_goes_on_where_it_stopped(spark, tmp_path):
    schema = "commit_position long, category string, event_type string"
    allowed = spark.createDataFrame([("A", "x"), ("B", "y")], "category string, event_type string")
    after = spark.createDataFrame([("B", 3)], "category string, position long")
    kind = spark.createDataFrame([], schema).schema
    rows = [(p, "AB"[p % 2], "xyz"[p % 3]) for p in range(24)]
    for k in range(3):
        put_files(spark, f"{tmp_path}/in", schema, [rows[8 * k : 8 * k + 8]])
        jobs.run_now(jobs.subscribe(jobs.read_log(spark, f"{tmp_path}/in", kind, 1), allowed, after), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        got = [x.commit_position for x in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()]
        assert sorted(got) == [p for p, c, t in rows[: 8 * k + 8] if (c, t) in (("A", "x"), ("B", "y")) and not (c == "B" and p <= 3)]


def wide_events(spark, r, n):
    rows, ikinds = [], [k for kinds in ev._INTERVIEW_KIND.values() for k in kinds]
    for a in range(3):
        for v in range(n):
            t = r.choice(list(ev._KIND))
            rows.append((a, v, len(rows), t, ev._KIND[t], r.choice((None, float(v))), v / n, r.choice(ikinds), f"e{r.randrange(3)}", f"n{v}", r.choice((None, f"t{v}")), r.choice((None, f"l{v}")), f"s{v % 2}", v % 5, {r.choice("xyz"): r.choice((None, str(v)))}))
    return rows, "aggregate_id int, version int, commit_position int, event_type string, kind string, value double, confidence double, ikind string, entity_id string, iname string, title string, language string, status string, lens_version int, diff map<string,string>"


@pytest.mark.parametrize("seed", [1, 2])
def test_every_projection_equals_one_replay(spark, tmp_path, seed):
    """A log dealt over batches in any order, with repeats, and the stream started again in between."""
    r = random.Random(seed)
    rows, schema = wide_events(spark, r, 25)
    parts = [[] for _ in range(5)]
    for row in rows:
        for k in {r.randrange(5) for _ in range(r.choice((1, 1, 2)))}:
            parts[k].append(row)
    e = spark.createDataFrame(rows, schema)
    made = lambda: jobs.Projection(spark, f"{tmp_path}/p", e.limit(0), {n: streams._read(make(), n) for n, make in streams.FOLDS.items()})
    for some in (parts[:3], parts[3:]):
        put_files(spark, f"{tmp_path}/in", schema, some)
        jobs.run_now(jobs.read_log(spark, f"{tmp_path}/in", e.schema, 1), "", f"{tmp_path}/checkpoint", made().step)
    p = made()
    got = ev.all_states({n: p.result(n) for n in streams.FOLDS}).collect()
    want = ev.all_states({n: replay(ev._READS[n](e)) for n, replay in ev._REPLAY.items()}).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {x.job for x in want} == set(streams.FOLDS)
    assert p.pending.last_before(99).count() == 0


def test_a_gap_waits(spark, tmp_path):
    """Versions after a missing one change no state until it comes; each version counts once."""
    schema = "aggregate_id int, version int, commit_position int, status string"
    e = spark.createDataFrame([], schema)
    p = jobs.Projection(spark, f"{tmp_path}/p", e, {"statuses": folds.statuses()})
    p.step(spark.createDataFrame([(1, 0, 0, "a"), (1, 2, 2, "a"), (1, 0, 9, "b"), (2, 1, 5, "z")], schema), 0)
    assert {(x.aggregate_id, x.n) for x in p.result("statuses").collect()} == {(1, 0)} and p.pending.last_before(1).count() == 2
    p.step(spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 2, "a")], schema), 1)
    assert {(x.aggregate_id, x.n) for x in p.result("statuses").collect()} == {(1, 2)} and p.pending.last_before(2).count() == 1


def test_first_of_equal_versions(spark):
    rows = [(1, 0, 5, "late"), (1, 0, 2, "early"), (1, 1, None, "none"), (1, 1, 7, "some")]
    for order in (rows, rows[::-1]):
        got = op.first_of(spark.createDataFrame(order, LOG).repartition(3), ["aggregate_id", "version"]).collect()
        assert {(x.version, x.word) for x in got} == {(0, "early"), (1, "some")}
