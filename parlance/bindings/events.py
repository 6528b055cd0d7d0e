"""Event log and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance import bind
from parlance.bind import EVENTS, FRAGMENTS, share_sql
from parlance.functions.ids import hashed_share, uuid5
from parlance.operators import events as op
from parlance.plans.scratch import materialise, scratch_dir
from parlance.sources import io

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: How the driver's event types stand for kinds of log events.
_KIND = {"view": "edited", "click": "generated", "purchase": "overridden", "error": "cleared", "signup": "attributed"}
_CATEGORY = {"view": "Sentence", "click": "Sentence", "purchase": "Interview", "error": "Project", "signup": "Interview"}


def _case(m):
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"


def _of(m):
    out = F.lit(None).cast("string")
    for k, v in m.items():
        out = F.when(F.col("event_type") == k, v).otherwise(out)
    return out


_ALLOWED = (("Sentence", "view"), ("Interview", "signup"), ("Project", "error"))
_CAT = f"cat AS (SELECT *, {_case(_CATEGORY)} AS category, {_case(_KIND)} AS kind FROM event_log)"


def _cat(s, d):
    return bind.event_log(s, d).withColumns({"category": _of(_CATEGORY), "kind": _of(_KIND)})


@query("s7_read_stream", f"WITH {EVENTS} SELECT commit_position, aggregate_id, version, event_type, value FROM event_log WHERE aggregate_id = 1 AND version >= 3 ORDER BY version LIMIT 20")
def s7(s, d):
    """The log appended in two calls, the second of which repeats a part of the first; then one stream of it."""
    e, path = bind.event_log(s, d).select("commit_position", "aggregate_id", "version", "event_type", "value"), scratch_dir(s)
    io.append_events(e.where("version % 3 != 1"), path, first=True)
    io.append_events(e.where("version % 3 != 0"), path)
    return op.read_stream(s.read.schema(e.schema).parquet(path), 1, from_version=3, limit=20)


@query("s7_append", f"WITH {EVENTS} SELECT aggregate_id, version, count(*) AS n FROM event_log GROUP BY ALL")
def s7_append(s, d):
    """Every version is in the log once after two overlapping appends."""
    e, path = bind.event_log(s, d), scratch_dir(s)
    io.append_events(e.where("version % 3 != 1").unionByName(e.where("version % 6 = 0")), path, first=True)
    io.append_events(e.where("version % 3 != 0"), path)
    return s.read.schema(e.schema).parquet(path).groupBy("aggregate_id", "version").agg(F.count(F.lit(1)).alias("n"))


@query("s8_subscription", f"WITH {EVENTS}, {_CAT} SELECT commit_position, category, event_type FROM cat WHERE (category, event_type) IN ({', '.join(map(str, _ALLOWED))})")
def s8(s, d):
    allowed = F.broadcast(s.createDataFrame(list(_ALLOWED), "category string, event_type string"))
    return op.subscribe(_cat(s, d), allowed).select("commit_position", "category", "event_type")


@query("v1_envelopes", f"WITH {EVENTS} SELECT fault, count(*) AS n FROM (SELECT CASE WHEN commit_position % 50 = 0 THEN 'event_id' WHEN ts IS NULL THEN 'occurred_at' WHEN version - (commit_position % 70 = 1)::INT * 100000 < 0 THEN 'version' END AS fault FROM event_log) GROUP BY fault")
def v1(s, d):
    e = bind.event_log(s, d).withColumn("event_uuid", F.when(F.col("commit_position") % 50 == 0, "none").otherwise(uuid5(F.col("commit_position").cast("string"))))
    e = e.withColumn("version", F.col("version") - (F.col("commit_position") % 70 == 1).cast("int") * 100000)
    return op.validate_envelopes(e).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


#: Kinds of interview events that the driver's types stand for, by the position's remainder.
_INTERVIEW_KIND = {
    "view": ("updated", "speaker_renamed", "utterance_identified", "stitch_removed"),
    "click": ("claim_extracted", "lens_item_generated", "lens_item_overridden", "segment_identified"),
    "purchase": ("status_changed", "lens_applied", "segment_removed", "speaker_merged"),
    "error": ("updated", "utterance_identified", "lens_item_generated", "status_changed"),
    "signup": ("created", "speaker_created", "speaker_created", "archived"),
}
_IK = "CASE " + " ".join(f"WHEN event_type = '{t}' AND commit_position % 4 = {k} THEN '{kind}'" for t, kinds in _INTERVIEW_KIND.items() for k, kind in enumerate(kinds)) + " END"
_V2 = f"""ie AS (SELECT aggregate_id, version, {_IK} AS kind, 'e' || (version % 5) AS entity_id, 'n' || version AS name, CASE WHEN version % 3 > 0 THEN 't' || version END AS title, CASE WHEN version % 4 = 0 THEN 'l' || (version % 7) END AS language, 's' || (version % 3) AS status, version % 6 AS lens_version FROM event_log)"""


def _interview_columns():
    """What the interview jobs read of an event."""
    v, kind = F.col("version"), F.lit(None).cast("string")
    for t, kinds in _INTERVIEW_KIND.items():
        for k, x in enumerate(kinds):
            kind = F.when((F.col("event_type") == t) & (F.col("commit_position") % 4 == k), x).otherwise(kind)
    tag = lambda mark, x: F.concat(F.lit(mark), x)
    return {"kind": kind, "entity_id": tag("e", v % 5), "name": tag("n", v), "title": F.when(v % 3 > 0, tag("t", v)), "language": F.when(v % 4 == 0, tag("l", v % 7)), "status": tag("s", v % 3), "lens_version": v % 6}


def _interview_events(s, d):
    return bind.event_log(s, d).select("aggregate_id", "version", *(c.alias(n) for n, c in _interview_columns().items()))


_HEADERS = """hd AS (SELECT aggregate_id, arg_max(title, version) FILTER (WHERE kind IN ('created', 'updated') AND title IS NOT NULL) AS title, arg_max(language, version) FILTER (WHERE kind IN ('created', 'updated') AND language IS NOT NULL) AS language,
arg_max(CASE kind WHEN 'created' THEN 'created' WHEN 'archived' THEN 'archived' ELSE status END, version) FILTER (WHERE kind IN ('created', 'archived', 'status_changed')) AS status, arg_max(lens_version, version) FILTER (WHERE kind = 'lens_applied') AS lens_version, max(version) AS version FROM ie GROUP BY 1)"""


@query("v2_interview_state", f"WITH {EVENTS}, {_V2}, {_HEADERS} SELECT * FROM hd")
def v2(s, d):
    return op.interview_headers(_interview_events(s, d))


@query(
    "v2_interview_entities",
    f"""WITH {EVENTS}, {_V2}, x AS (SELECT *, CASE WHEN kind LIKE 'speaker%' THEN 'speaker' WHEN kind IN ('utterance_identified', 'stitch_removed') THEN 'utterance' WHEN kind LIKE 'claim%' THEN 'claim' WHEN kind LIKE 'lens_item%' THEN 'lens_item' WHEN kind LIKE 'segment%' THEN 'segment' END AS entity FROM ie),
y AS (SELECT aggregate_id, entity, entity_id, max(version) FILTER (WHERE kind IN ('speaker_created', 'utterance_identified', 'claim_extracted', 'lens_item_generated', 'segment_identified')) AS o, arg_max(name, version) FILTER (WHERE kind IN ('speaker_created', 'utterance_identified', 'claim_extracted', 'lens_item_generated', 'segment_identified', 'speaker_renamed')) AS name,
max(version) FILTER (WHERE kind = 'speaker_renamed') AS c, max(version) FILTER (WHERE kind = 'lens_item_overridden') AS l, max(version) FILTER (WHERE kind = 'speaker_merged') AS m, max(version) FILTER (WHERE kind IN ('stitch_removed', 'segment_removed')) AS r FROM x WHERE entity IS NOT NULL GROUP BY ALL)
SELECT aggregate_id, entity, entity_id, name, concat_ws(',', CASE WHEN c > o THEN 'confirmed' END, CASE WHEN l > o THEN 'locked' END, CASE WHEN m > o THEN 'merged' END, CASE WHEN r > o THEN 'removed' END) AS flags FROM y WHERE o IS NOT NULL""",
)
def v2_entities(s, d):
    return op.interview_entities(_interview_events(s, d)).withColumn("flags", F.array_join("flags", ","))


_V3 = f"""cl AS (SELECT *, version > coalesce(max(version) FILTER (WHERE kind = 'cleared') OVER (PARTITION BY aggregate_id), -1) AS alive FROM cat),
v3 AS (SELECT aggregate_id, max(version) AS version, count(*) FILTER (WHERE kind = 'edited') AS n_edits, arg_max(value, version) FILTER (WHERE kind = 'edited') AS text_value,
arg_max(value, version) FILTER (WHERE alive AND kind IN ('generated', 'overridden')) AS analysis, coalesce(bool_or(alive AND kind = 'overridden'), false) AS locked,
arg_max(value, version) FILTER (WHERE kind = 'attributed') AS speaker_value FROM cl GROUP BY 1)"""


@query("v3_fragment_state", f"WITH {EVENTS}, {_CAT}, {_V3} SELECT * FROM v3")
def v3(s, d):
    return op.fold_fragments(_cat(s, d))


@query("v5_apply_once", f"WITH {EVENTS}, a AS (SELECT aggregate_id, max(version) // 2 AS applied FROM event_log WHERE aggregate_id % 3 <> 0 GROUP BY 1) SELECT e.aggregate_id, version, commit_position FROM event_log e LEFT JOIN a USING (aggregate_id) WHERE applied IS NULL OR version > applied")
def v5(s, d):
    e = bind.event_log(s, d)
    applied = e.where("aggregate_id % 3 != 0").groupBy("aggregate_id").agg(F.floor(F.max("version") / 2).alias("version"))
    return op.apply_once(e.unionByName(e.where("version % 5 = 0")), applied).select("aggregate_id", "version", "commit_position")


@query("v7_routing_keys", f"WITH {EVENTS}, {_CAT}, k AS (SELECT category, CASE WHEN category = 'Sentence' THEN CASE WHEN commit_position % 9 <> 0 THEN CAST(aggregate_id AS VARCHAR) END ELSE CAST(aggregate_id AS VARCHAR) END AS key FROM cat) SELECT category, key AS routing_key, count(*) AS n_events FROM k GROUP BY ALL")
def v7(s, d):
    """Events of each routing key; those without one are dropped and counted."""
    own = F.col("aggregate_id").cast("string")
    r = op.route(_cat(s, d), "category", own, F.when(F.col("commit_position") % 9 != 0, own))
    return r.groupBy("category", "routing_key").agg(F.count(F.lit(1)).alias("n_events"))


@query("v8_missing_referents", f"WITH {EVENTS}, p AS (SELECT DISTINCT aggregate_id FROM event_log WHERE event_type = 'signup') SELECT aggregate_id IN (SELECT aggregate_id FROM p) AS applicable, event_type, count(*) AS n FROM event_log GROUP BY ALL")
def v8(s, d):
    e = bind.event_log(s, d)
    ok, held = op.missing_referents(e, e.where("event_type = 'signup'"), "aggregate_id")
    both = ok.withColumn("applicable", F.lit(True)).unionByName(held.withColumn("applicable", F.lit(False)))
    return both.groupBy("applicable", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "v9_redrive",
    f"""WITH {EVENTS}, {_CAT}, o AS (SELECT category AS aggregate_type, CASE WHEN event_type = 'error' THEN 'no_handler' WHEN aggregate_id % 5 >= 3 THEN 'still_parked' WHEN commit_position % 17 = 0 THEN 'failed' ELSE 'redriven' END AS outcome FROM cat WHERE version % 4 = 0)
SELECT aggregate_type, count(*) FILTER (WHERE outcome = 'redriven') AS redriven, count(*) FILTER (WHERE outcome = 'still_parked') AS still_parked, count(*) FILTER (WHERE outcome = 'no_handler') AS no_handler, count(*) FILTER (WHERE outcome = 'failed') AS failed FROM o GROUP BY ROLLUP (aggregate_type)""",
)
def v9(s, d):
    c = _cat(s, d)
    parked = c.where("version % 4 = 0").select("commit_position", F.col("category").alias("aggregate_type"), "event_type", F.col("aggregate_id").alias("referent"), (F.col("commit_position") % 17 != 0).alias("valid"))
    handled = c.where("event_type != 'error'").select("event_type")
    return op.redrive(parked, c.where("aggregate_id % 5 < 3").select(F.col("aggregate_id").alias("referent")), handled)


@query("v10_metadata", f"WITH {EVENTS}, l AS (SELECT aggregate_id, event_type AS name, arg_max(CASE WHEN version % 3 = 0 THEN '-' ELSE CAST(version AS VARCHAR) END, version) AS v FROM event_log GROUP BY ALL) SELECT aggregate_id, string_agg(name || '=' || v, ',' ORDER BY name) AS metadata FROM l WHERE v <> '-' GROUP BY 1")
def v10(s, d):
    e = bind.event_log(s, d).select("aggregate_id", "version", F.create_map("event_type", F.when(F.col("version") % 3 != 0, F.col("version").cast("string"))).alias("diff"))
    m = op.merge_metadata(e, "aggregate_id", "version")
    return m.select("aggregate_id", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("metadata"))




@query("v11_merged_speakers", f"WITH {EVENTS} SELECT CASE aggregate_id % 4 WHEN 1 THEN aggregate_id - 1 WHEN 2 THEN CASE WHEN aggregate_id - 1 IN (SELECT aggregate_id FROM event_log) THEN aggregate_id - 2 ELSE aggregate_id - 1 END ELSE aggregate_id END AS speaker_id, count(*) AS n_fragments FROM event_log GROUP BY 1")
def v11(s, d):
    from parlance.plans.closure import connected_components

    e = bind.event_log(s, d)
    merges = e.where("aggregate_id % 4 in (1, 2)").select("aggregate_id", (F.col("aggregate_id") - 1).alias("into")).distinct()
    rows = op.redirect(e.select(F.col("aggregate_id").alias("speaker_id")), connected_components(merges, "aggregate_id", "into"), "speaker_id")
    return rows.groupBy("speaker_id").agg(F.count(F.lit(1)).alias("n_fragments"))


@query(
    "v12_speaker_state",
    f"""WITH {EVENTS}, k AS (SELECT aggregate_id AS speaker_id, version, CASE event_type WHEN 'purchase' THEN 'renamed' WHEN 'signup' THEN 'reattributed' ELSE 'created' END AS kind, 'n' || version AS name, {share_sql("commit_position")} AS confidence FROM event_log)
SELECT speaker_id, arg_max(name, version + CASE WHEN kind <> 'created' THEN 1000000 ELSE 0 END) AS name, NOT bool_or(kind = 'renamed') AS provisional,
arg_max(CASE WHEN kind = 'reattributed' THEN 1.0 ELSE confidence END, version + CASE WHEN kind = 'reattributed' THEN 1000000 ELSE 0 END) AS confidence, bool_or(kind = 'reattributed') AS locked FROM k GROUP BY 1""",
)
def v12(s, d):
    kind = F.when(F.col("event_type") == "purchase", "renamed").when(F.col("event_type") == "signup", "reattributed").otherwise("created")
    e = bind.event_log(s, d).select(F.col("aggregate_id").alias("speaker_id"), "version", kind.alias("kind"), F.concat(F.lit("n"), "version").alias("name"), hashed_share(F.col("commit_position")).alias("confidence"))
    return op.speaker_state(e)


@query(
    "v12_speaker_split",
    f"""WITH {FRAGMENTS}, sp AS (SELECT interview_id, max(seq) AS n, interview_id % 4 = 3 AS refused FROM fragments WHERE interview_id % 2 = 1 GROUP BY 1)
SELECT fragment_id, CASE WHEN moved THEN f.interview_id || '/split' ELSE f.interview_id || '/' || role END AS speaker_id, CASE WHEN moved THEN 1.0 ELSE confidence END AS confidence, CASE WHEN moved THEN 'human' ELSE 'label' END AS method, moved AS locked FROM (SELECT *, coalesce(NOT refused AND seq % 3 = 1, false) AS moved FROM fragments LEFT JOIN sp USING (interview_id)) f""",
)
def v12_split(s, d):
    """In odd interviews every third fragment goes to a new speaker; half of these splits name a fragment that is not there."""
    f = bind.fragments(s, d)
    a = f.select("interview_id", "fragment_id", F.concat_ws("/", "interview_id", "role").alias("speaker_id"), "confidence", F.lit("label").alias("method"), F.lit(False).alias("locked"))
    ids = F.collect_list(F.when(F.col("seq") % 3 == 1, F.col("fragment_id")))
    x = f.where("interview_id % 2 = 1").groupBy("interview_id").agg(ids.alias("ids"))
    x = x.select("interview_id", F.lit("split").alias("handle"), F.lit("Split").alias("display_name"), F.lit(1).alias("version"), F.when(F.col("interview_id") % 4 == 3, F.concat("ids", F.array(F.lit("none")))).otherwise(F.col("ids")).alias("fragment_ids"))
    return op.split_speakers(a, x, lambda *c: F.concat_ws("/", *c))[1].drop("interview_id")


@query("v13_keep_edited", f"WITH {EVENTS}, x AS (SELECT aggregate_id, version % 4 AS dimension, version, value, event_type = 'purchase' AS human FROM event_log), y AS (SELECT aggregate_id, dimension, arg_max(value, version) FILTER (WHERE NOT human) AS g, arg_max(value, version) FILTER (WHERE human) AS e FROM x GROUP BY ALL) SELECT aggregate_id, dimension, coalesce(e, g) AS value, e IS NOT NULL AS is_edited FROM y")
def v13(s, d):
    x = bind.event_log(s, d).withColumn("dimension", F.col("version") % 4)
    return op.keep_edited(x.where("event_type != 'purchase'"), x.where("event_type = 'purchase'"), ["aggregate_id", "dimension"])


@query("v14_override", f"WITH {EVENTS}, c AS (SELECT aggregate_id, bool_or(event_type = 'purchase') AS o, bool_or(event_type = 'click') AS b FROM event_log GROUP BY 1) SELECT aggregate_id, CASE WHEN o THEN 'keep=base,topic=changed' ELSE 'keep=base,topic=base' END AS fields, o AS overridden FROM c WHERE b")
def v14(s, d):
    e = bind.event_log(s, d)
    base = e.where("event_type = 'click'").select("aggregate_id").distinct().withColumn("fields", F.create_map(F.lit("keep"), F.lit("base"), F.lit("topic"), F.lit("base")))
    change = e.where("event_type = 'purchase'").select("aggregate_id").distinct().withColumn("change", F.create_map(F.lit("topic"), F.lit("changed")))
    out = op.override(base, change, "aggregate_id")
    return out.select("aggregate_id", F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("fields"), "overridden")


@query("v15_live_overlays", f"WITH {EVENTS}, g AS (SELECT aggregate_id, arg_max(event_type = 'error', version) AS gone FROM event_log WHERE event_type IN ('error', 'view') GROUP BY 1) SELECT DISTINCT aggregate_id FROM event_log WHERE aggregate_id NOT IN (SELECT aggregate_id FROM g WHERE gone)")
def v15(s, d):
    e = bind.event_log(s, d)
    flags = e.where("event_type in ('error', 'view')").select("aggregate_id", "version", (F.col("event_type") == "error").alias("is_removed"))
    return op.live(e.select("aggregate_id").distinct(), flags, "aggregate_id")


@query("v16_history", f"WITH {EVENTS}, {_CAT} SELECT aggregate_id, version, event_type, 'actor' || (commit_position % 5) AS actor, 'c' || (commit_position // 10) AS correlation_id, bool_or(kind = 'edited') OVER (PARTITION BY aggregate_id ORDER BY version) AS edited_so_far FROM cat")
def v16(s, d):
    e = _cat(s, d).withColumns({"actor": F.concat(F.lit("actor"), F.col("commit_position") % 5), "correlation_id": F.concat(F.lit("c"), F.floor(F.col("commit_position") / 10))})
    return op.history(e)


_SCOPE = f"""sc AS (SELECT commit_position, unnest(list_filter([CASE WHEN category IN ('Interview', 'Sentence') AND aggregate_id % 6 <> 0 THEN 'transcript:' || aggregate_id END,
CASE WHEN category = 'Interview' THEN 'interviews:' || (aggregate_id % 4) END, CASE WHEN category IN ('Interview', 'Project') THEN 'project:' || (aggregate_id % 4) END], lambda x: x IS NOT NULL)) AS scope FROM cat)"""


def _scopes(s, d):
    i = F.when(F.col("aggregate_id") % 6 != 0, F.col("aggregate_id").cast("string"))
    return _cat(s, d).select("commit_position", F.explode(op.scopes_of(F.col("category"), i, (F.col("aggregate_id") % 4).cast("string"))).alias("scope"))


@query("v17_notifications", f"WITH {EVENTS}, {_CAT}, {_SCOPE} SELECT scope, count(*) AS n, max(commit_position) AS newest FROM sc GROUP BY 1")
def v17(s, d):
    return _scopes(s, d).groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.max("commit_position").alias("newest"))


@query("v18_backlog", f"WITH {EVENTS}, {_CAT}, {_SCOPE} SELECT scope, commit_position FROM sc QUALIFY row_number() OVER (PARTITION BY scope ORDER BY commit_position DESC) <= 64")
def v18(s, d):
    return op.backlog(_scopes(s, d), "scope", "commit_position").select("scope", "commit_position")


@query("v19_projection_lag", f"WITH {EVENTS}, e AS (SELECT DISTINCT aggregate_id, version % 40 AS item FROM event_log WHERE event_type = 'view'), p AS (SELECT DISTINCT aggregate_id, version % 40 AS item FROM event_log WHERE event_type = 'signup' OR event_type = 'view' AND commit_position % 3 > 0), x AS (SELECT aggregate_id || '/' || item AS item FROM e), y AS (SELECT aggregate_id || '/' || item AS item FROM p) SELECT coalesce(x.item, y.item) AS item, CASE WHEN y.item IS NULL THEN 'not_projected' ELSE 'not_expected' END AS lag FROM x FULL JOIN y USING (item) WHERE x.item IS NULL OR y.item IS NULL")
def v19(s, d):
    e = bind.event_log(s, d).withColumn("item", F.concat_ws("/", "aggregate_id", F.col("version") % 40))
    return op.lag_between(e.where("event_type = 'view'"), e.where("event_type = 'signup' or event_type = 'view' and commit_position % 3 > 0"), "item")


@query("v20_version_audit", f"WITH {EVENTS}, x AS (SELECT aggregate_id, version FROM event_log WHERE version % 7 <> 5 UNION ALL SELECT aggregate_id, version FROM event_log WHERE version % 11 = 4 AND version % 7 <> 5), y AS (SELECT aggregate_id, version, version - lag(version, 1, -1) OVER (PARTITION BY aggregate_id ORDER BY version) AS step FROM x) SELECT aggregate_id, count(*) FILTER (WHERE step > 1) AS n_gaps, count(*) FILTER (WHERE step = 0) AS n_repeats, max(version) AS last_version FROM y GROUP BY 1")
def v20(s, d):
    e = bind.event_log(s, d).where("version % 7 != 5")
    return op.audit_versions(e.unionByName(e.where("version % 11 = 4")))


@query(
    "v21_metrics",
    f"""WITH {EVENTS}, l AS (SELECT * FROM event_log WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY commit_position DESC) <= 1000), v AS (SELECT event_type, list(value ORDER BY value) AS v, count(*) AS k FROM l GROUP BY 1), a AS (SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM event_log WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, n, total, v[1] AS low, v[-1] AS high, v[CAST(floor(k * 0.5) AS INTEGER) + 1] AS p50, CASE WHEN k > 20 THEN v[CAST(floor(k * 0.95) AS INTEGER) + 1] ELSE v[-1] END AS p95, CASE WHEN k > 100 THEN v[CAST(floor(k * 0.99) AS INTEGER) + 1] ELSE v[-1] END AS p99 FROM v JOIN a USING (event_type)""",
)
def v21(s, d):
    return op.metrics(bind.event_log(s, d).where("value is not null"), "event_type", "value", "commit_position")


@query("v22_status_changes", f"WITH {EVENTS} SELECT refused, event_type, count(*) AS n FROM (SELECT event_type, coalesce(lag(event_type) OVER (PARTITION BY aggregate_id ORDER BY version) = event_type, false) AS refused FROM event_log) GROUP BY ALL")
def v22(s, d):
    return op.status_changes(bind.event_log(s, d), "aggregate_id", "event_type", "version").groupBy("refused", "event_type").agg(F.count(F.lit(1)).alias("n"))


_REPEATS = "SELECT aggregate_id, count(*) FILTER (WHERE refused) AS n FROM (SELECT aggregate_id, coalesce(lag(event_type) OVER (PARTITION BY aggregate_id ORDER BY version) = event_type, false) AS refused FROM event_log) GROUP BY aggregate_id"
_NUM = "CAST(CAST({0} AS DECIMAL(20, 4)) AS VARCHAR)"


def _states_sql(job, query, part, *columns):
    """The rows of a query as (job, aggregate_id, part, state)."""
    state = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns)
    return f"SELECT '{job}' AS job, {'speaker_id' if job == 'speakers' else 'aggregate_id'} AS aggregate_id, {part} AS part, {state or "'-'"} AS state FROM ({query}) q"


#: Every job: the columns of its rows that make up a state, and what tells rows of an aggregate apart; doubles as decimals.
_STATES = {
    "fragments": ("''", "version", "n_edits", "locked", _NUM.format("text_value"), _NUM.format("analysis"), _NUM.format("speaker_value")),
    "headers": ("''", "title", "language", "status", "lens_version", "version"),
    "entities": ("entity || '/' || entity_id", "name", "flags"),
    "metadata": ("''", "metadata"),
    "speakers": ("''", "name", "provisional", "locked", _NUM.format("confidence")),
    "kept_edits": ("CAST(dimension AS VARCHAR)", _NUM.format("value"), "is_edited"),
    "overlays": ("''",),
    "statuses": ("''", "n"),
}
_OF = {"fragments": "v3_fragment_state", "headers": "v2_interview_state", "entities": "v2_interview_entities", "metadata": "v10_metadata", "speakers": "v12_speaker_state", "kept_edits": "v13_keep_edited", "overlays": "v15_live_overlays"}
_V23 = "\nUNION ALL ".join(_states_sql(job, SQL[_OF[job]] if job in _OF else f"WITH {EVENTS} {_REPEATS}", *columns) for job, columns in _STATES.items())


def _wide(s, d):
    """One row per event with what each job reads of it."""
    e, v = _cat(s, d), F.col("version")
    i = {{"kind": "ikind", "name": "iname"}.get(n, n): c for n, c in _interview_columns().items()}
    e = e.select("aggregate_id", "version", "commit_position", "event_type", "kind", "value", hashed_share(F.col("commit_position")).alias("confidence"), *(c.alias(n) for n, c in i.items()))
    return e.withColumn("diff", F.create_map("event_type", F.when(v % 3 != 0, v.cast("string"))))


_READS = {
    "fragments": lambda e: e,
    "headers": lambda e: e.drop("kind").withColumnRenamed("ikind", "kind"),
    "entities": lambda e: e.drop("kind").withColumnRenamed("ikind", "kind").withColumnRenamed("iname", "name"),
    "metadata": lambda e: e,
    "speakers": lambda e: e.select(F.col("aggregate_id").alias("speaker_id"), "version", F.when(F.col("event_type") == "purchase", "renamed").when(F.col("event_type") == "signup", "reattributed").otherwise("created").alias("kind"), F.concat(F.lit("n"), "version").alias("name"), "confidence"),
    "kept_edits": lambda e: e.select("aggregate_id", "version", (F.col("version") % 4).alias("dimension"), "value", (F.col("event_type") == "purchase").alias("human")),
    "overlays": lambda e: e.select("aggregate_id", "version", F.when(F.col("event_type").isin("error", "view"), F.col("event_type") == "error").alias("is_removed")),
    "statuses": lambda e: e.select("aggregate_id", "version", F.col("event_type").alias("status")),
}
_REPLAY = {
    "fragments": op.fold_fragments,
    "headers": op.interview_headers,
    "entities": op.interview_entities,
    "metadata": lambda e: op.merge_metadata(e, "aggregate_id", "version"),
    "speakers": op.speaker_state,
    "kept_edits": lambda e: op.keep_edited(e.where("not human"), e.where("human"), ["aggregate_id", "dimension"]),
    "overlays": lambda e: op.live(e.select("aggregate_id").distinct(), e.where("is_removed is not null"), "aggregate_id"),
    "statuses": lambda e: op.status_changes(e, "aggregate_id", "status", "version").groupBy("aggregate_id").agg(F.count_if("refused").alias("n")),
}


def _shown(job, rows):
    """A job's rows as (job, aggregate_id, part, state), like _states_sql."""
    if job == "metadata":
        rows = rows.withColumn("metadata", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ","))
    if job == "entities":
        rows = rows.withColumn("flags", F.array_join("flags", ","))
    part, *columns = _STATES[job]
    state = " || '|' || ".join(f"coalesce(CAST({c} AS STRING), '-')" for c in columns).replace("VARCHAR", "STRING") or "'-'"
    return rows.select(F.lit(job).alias("job"), F.col("speaker_id" if job == "speakers" else "aggregate_id").alias("aggregate_id"), F.expr(part.replace("VARCHAR", "STRING")).alias("part"), F.expr(state).alias("state"))


def all_states(results):
    out = None
    for job, rows in results.items():
        out = _shown(job, rows) if out is None else out.unionByName(_shown(job, rows))
    return out


@query("v23_rebuild", _V23)
def v23(s, d):
    """The states that one replay gives, by all jobs, of a log in which every event came twice, applied once."""
    e = materialise(_wide(s, d))
    twice = op.dealt(e.unionByName(e), "aggregate_id")
    log = materialise(op.apply_once(twice, e.where("false").select("aggregate_id", "version")))
    return all_states({job: replay(_READS[job](log)) for job, replay in _REPLAY.items()})
