"""Fold the append-only log into state, and audit it.  Keys: aggregate_id, version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def validate_envelopes(events: DataFrame) -> DataFrame:
    """Adds ``fault``: what is wrong with an envelope, or null."""
    fault = F.when(~F.coalesce(F.col("event_uuid").rlike(UUID), F.lit(False)), "event_id").when(F.col("ts").isNull(), "occurred_at").when(F.coalesce(F.col("version") < 0, F.lit(True)), "version")
    return events.withColumn("fault", fault)


def read_stream(events: DataFrame, aggregate: Column | int, from_version: int = 0, limit: int | None = None) -> DataFrame:
    """One aggregate's events in version order."""
    out = events.where((F.col("aggregate_id") == aggregate) & (F.col("version") >= from_version)).orderBy("version")
    return out if limit is None else out.limit(limit)


def subscribe(events: DataFrame, allowed: DataFrame) -> DataFrame:
    """Events of the types that their category lets through; allowed is a small declared list."""
    return events.join(allowed, ["category", "event_type"], "left_semi")


def latest(events: DataFrame, keys: list[str], order: str, *values: str) -> DataFrame:
    """Latest-wins state: values of the highest version of each key."""
    return events.groupBy(*keys).agg(*(F.max_by(v, order).alias(v) for v in values))


#: Which event opens an entity of an interview, which ones set its flag, and what the flag says.
INTERVIEW_ENTITIES = {
    "speaker": ("speaker_created", {"speaker_renamed": "confirmed", "speaker_merged": "merged"}),
    "utterance": ("utterance_identified", {"stitch_removed": "removed"}),
    "claim": ("claim_extracted", {}),
    "lens_item": ("lens_item_generated", {"lens_item_overridden": "locked"}),
    "segment": ("segment_identified", {"segment_removed": "removed"}),
}


def interview_headers(events: DataFrame) -> DataFrame:
    """Title, language, status and lens version of each interview; events: aggregate_id, version, kind, title, language, status, lens_version.

    Titles and languages of created and updated events count where they are given; a created event
    and an archived one set the status too.
    """
    told = F.col("kind").isin("created", "updated")
    status = F.when(F.col("kind") == "created", "created").when(F.col("kind") == "archived", "archived").when(F.col("kind") == "status_changed", F.col("status"))

    def last(value: Column, when: Column) -> Column:
        return F.max_by(value, F.when(when & value.isNotNull(), F.col("version")))

    return events.groupBy("aggregate_id").agg(
        last(F.col("title"), told).alias("title"),
        last(F.col("language"), told).alias("language"),
        last(status, F.lit(True)).alias("status"),
        last(F.col("lens_version"), F.col("kind") == "lens_applied").alias("lens_version"),
        F.max("version").alias("version"),
    )


def interview_entities(events: DataFrame) -> DataFrame:
    """``(aggregate_id, entity, entity_id, name, flags)`` of all entities of each interview.

    events: aggregate_id, version, kind, entity_id, name.  An entity exists from its opening event
    on, which also clears its flags; flags and renames before it are void.  A rename changes the name.
    """
    kind = F.col("kind")
    entity = F.lit(None).cast("string")
    for name, (opened, flags) in INTERVIEW_ENTITIES.items():
        entity = F.when(kind.isin(opened, *flags), name).otherwise(entity)
    e = events.withColumn("entity", entity).where("entity is not null")
    openers = [opened for opened, _ in INTERVIEW_ENTITIES.values()]
    opened_at = F.max(F.when(kind.isin(*openers), F.col("version"))).alias("opened_at")
    names = F.max_by("name", F.when(kind.isin(*openers, "speaker_renamed"), F.col("version"))).alias("name")
    by_flag: dict[str, list[str]] = {}
    for _, flags in INTERVIEW_ENTITIES.values():
        for at, flag in flags.items():
            by_flag.setdefault(flag, []).append(at)
    at = [F.max(F.when(kind.isin(*kinds), F.col("version"))).alias(f"_{flag}") for flag, kinds in by_flag.items()]
    s = e.groupBy("aggregate_id", "entity", "entity_id").agg(opened_at, names, *at).where("opened_at is not null")
    flags = F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"_{flag}") > F.col("opened_at"), flag) for flag in by_flag))))
    return s.select("aggregate_id", "entity", "entity_id", "name", flags.alias("flags"))


def fold_fragments(events: DataFrame) -> DataFrame:
    """Text version, edits, generated/overridden/cleared analysis and lock of each aggregate.

    events: aggregate_id, version, kind in (edited, generated, overridden, cleared, attributed), value.
    Only analysis events after the last clear count; a human override locks.
    """
    kind, v, value = F.col("kind"), F.col("version"), F.col("value")
    made = kind.isin("generated", "overridden")
    s = events.groupBy("aggregate_id").agg(
        F.max("version").alias("version"),
        F.count_if(kind == "edited").alias("n_edits"),
        F.max_by(F.when(kind == "edited", value), F.when(kind == "edited", v)).alias("text_value"),
        F.max_by(F.when(made, value), F.when(made, v)).alias("analysis"),
        F.max_by(F.when(kind == "attributed", value), F.when(kind == "attributed", v)).alias("speaker_value"),
        F.max(F.when(made, v)).alias("_made"),
        F.max(F.when(kind == "overridden", v)).alias("_overridden"),
        F.coalesce(F.max(F.when(kind == "cleared", v)), F.lit(-1)).alias("_cleared"),
    )
    alive = lambda at: F.col(at) > F.col("_cleared")
    return s.select("aggregate_id", "version", "n_edits", "text_value", F.when(alive("_made"), F.col("analysis")).alias("analysis"), F.coalesce(alive("_overridden"), F.lit(False)).alias("locked"), "speaker_value")


#: Events that a task holds to sort them.
TASK_EVENTS = 500_000


def dealt(events: DataFrame, key: str) -> DataFrame:
    """Events dealt by a key to as many tasks as their number asks for: a task's share does not grow with the log."""
    return events.repartition(max(events.sparkSession.sparkContext.defaultParallelism, -(-events.count() // TASK_EVENTS)), key)


def first_of(events: DataFrame, keys: list[str], order: str = "commit_position") -> DataFrame:
    """One event per key: the first by ``order`` if events have it (nulls last), of equal ones the one with the smallest hash of its content."""
    plain = [F.col(f.name) for f in events.schema if f.name not in keys and "map<" not in f.dataType.simpleString()]
    content = F.xxhash64(*plain) if plain else F.lit(0)
    by = [F.col(order).isNull().alias("n"), F.col(order).alias("o")] if order in events.columns else []
    rest = [c for c in events.columns if c not in keys]
    if not rest:
        return events.distinct()
    kept = events.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*by, content.alias("h"))).alias("_first"))
    return kept.select(*keys, "_first.*").select(*events.columns)


def apply_new(incoming: DataFrame, applied: DataFrame, keep: str | None = None) -> DataFrame:
    """Events above the version applied to their aggregate, one per version; ``keep`` names a column for the version applied."""
    a = applied.select("aggregate_id", F.col("version").alias("_at"))
    e = first_of(incoming, ["aggregate_id", "version"]).join(a, "aggregate_id", "left").where(F.col("_at").isNull() | (F.col("version") > F.col("_at")))
    return e.drop("_at") if keep is None else e.withColumnRenamed("_at", keep)


def apply_once(incoming: DataFrame, applied: DataFrame) -> DataFrame:
    """Events to apply: each version once (of two events with one version the first by position), and only those above the version already applied."""
    return apply_new(incoming, applied)


def route(events: DataFrame, category: str, own: Column, parent: Column) -> DataFrame:
    """Adds ``routing_key``, by which events that belong together are partitioned: the aggregate itself, or its interview for sentence events; none is null."""
    return events.withColumn("routing_key", F.when(F.col(category) == "Sentence", parent).otherwise(own))


def missing_referents(events: DataFrame, projected: DataFrame, referent: str) -> tuple[DataFrame, DataFrame]:
    """(applicable, held) by whether the referent has been projected."""
    return events.join(projected.select(referent).distinct(), referent, "left_semi"), events.join(projected.select(referent).distinct(), referent, "left_anti")


def hold_outcome(park_after: int, newest: Column) -> Column:
    """What becomes of an event with a commit_position whose referent opened at ``opened_at`` (null: not yet), once the log has reached ``newest``."""
    limit = F.col("commit_position") + F.lit(park_after)
    return F.when(F.col("opened_at") <= limit, "applied").when(newest > limit, "parked").otherwise("held")


def hold_outcomes(events: DataFrame, referent: str, opens: Column, park_after: int) -> DataFrame:
    """Adds ``outcome``: applied, parked (the referent came more than ``park_after`` positions late, or the log went on so far without it), or held."""
    opened = events.where(opens).groupBy(referent).agg(F.min("commit_position").alias("opened_at"))
    newest = events.agg(F.max("commit_position")).first()[0]
    return events.join(opened, referent, "left").withColumn("outcome", hold_outcome(park_after, F.lit(newest))).drop("opened_at")


def redrive(parked: DataFrame, projected: DataFrame, handled: DataFrame, cap: int | None = None) -> DataFrame:
    """Outcome of parked events per aggregate type, with a total: redriven, still parked, no handler, failed.

    parked: commit_position, aggregate_type, event_type, referent, valid (whether its handler can read it).
    Events with a handler go through missing_referents again; those that it holds stay parked, and of
    the others the ones that are not valid fail, which stops none of the rest.
    """
    p = parked if cap is None else parked.orderBy("commit_position").limit(cap)
    known = handled.select("event_type").distinct()
    ready, held = missing_referents(p.join(known, "event_type", "left_semi"), projected, "referent")
    outcome = F.when(F.coalesce("valid", F.lit(False)), "redriven").otherwise("failed")
    cols = ("aggregate_type", "outcome")
    j = ready.withColumn("outcome", outcome).select(*cols)
    j = j.unionByName(held.select("aggregate_type", F.lit("still_parked").alias("outcome"))).unionByName(p.join(known, "event_type", "left_anti").select("aggregate_type", F.lit("no_handler").alias("outcome")))
    return j.rollup("aggregate_type").agg(*(F.count_if(F.col("outcome") == x).alias(x) for x in ("redriven", "still_parked", "no_handler", "failed")))


def merge_metadata(diffs: DataFrame, key: str, order: str) -> DataFrame:
    """Top-level key merge of metadata diffs (map columns); a null value deletes the name."""
    rows = diffs.select(key, order, F.explode("diff").alias("name", "value"))
    last = rows.groupBy(key, "name").agg(F.max(F.struct(order, "value")).alias("m")).where("m.value is not null")
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.col("m.value").alias("value"))))).alias("metadata"))


def redirect(rows: DataFrame, merged: DataFrame, column: str) -> DataFrame:
    """Point ``column`` at the survivor of its merge; merged: (node, component)."""
    m = merged.select(F.col("node").alias(column), "component")
    return rows.join(m, column, "left").withColumn(column, F.coalesce("component", column)).drop("component")


def speaker_state(events: DataFrame) -> DataFrame:
    """Name, provisional flag, confidence and lock of speakers; a human change wins over any later machine one.

    events: speaker_id, version, kind in (created, renamed, reattributed), name, confidence.
    """
    human = F.col("kind").isin("renamed", "reattributed")
    rank = F.struct(human.cast("int").alias("h"), F.col("version").alias("v"))
    return events.groupBy("speaker_id").agg(
        F.max_by("name", rank).alias("name"),
        (~F.bool_or(F.col("kind") == "renamed")).alias("provisional"),
        F.max_by(F.when(F.col("kind") == "reattributed", F.lit(1.0)).otherwise(F.col("confidence")), F.struct((F.col("kind") == "reattributed").cast("int").alias("h"), F.col("version").alias("v"))).alias("confidence"),
        F.bool_or(F.col("kind") == "reattributed").alias("locked"),
    )


def split_speakers(attributions: DataFrame, splits: DataFrame, speaker_id) -> tuple[DataFrame, DataFrame]:
    """(new speakers, attributions after the splits): the named fragments of a split go to a new speaker, by a person.

    attributions: interview_id, fragment_id, speaker_id, confidence, method, locked; splits: interview_id,
    handle, display_name, version, fragment_ids.  A split that names a missing fragment is refused
    whole; of two splits of one fragment the later one counts.
    """
    new = splits.withColumn("new_id", speaker_id("interview_id", "handle"))
    each = new.select("interview_id", "new_id", "version", F.explode("fragment_ids").alias("fragment_id"))
    lost = each.join(attributions.select("interview_id", "fragment_id"), ["interview_id", "fragment_id"], "left_anti").select("new_id", "version").distinct()
    new, each = (x.join(lost, ["new_id", "version"], "left_anti") for x in (new, each))
    speakers = new.select("interview_id", F.col("new_id").alias("speaker_id"), "handle", "display_name", F.lit(False).alias("provisional"), F.lit(1.0).alias("confidence"), F.lit("human").alias("method")).dropDuplicates(["speaker_id"])
    last = each.groupBy("interview_id", "fragment_id").agg(F.max_by("new_id", "version").alias("new_id"))
    a = attributions.join(last, ["interview_id", "fragment_id"], "left")
    moved = F.col("new_id").isNotNull()
    a = a.withColumns({"speaker_id": F.coalesce("new_id", "speaker_id"), "confidence": F.when(moved, 1.0).otherwise(F.col("confidence")), "method": F.when(moved, "human").otherwise(F.col("method")), "locked": moved | F.col("locked")})
    return speakers, a.drop("new_id")


def history(events: DataFrame, aggregate: Column | int | None = None) -> DataFrame:
    """All events of one aggregate (or of every one) with actor and correlation, and whether its text had been edited by then.

    events: aggregate_id, version, event_type, kind, actor, correlation_id.  In version order for one aggregate.
    """
    e = events if aggregate is None else events.where(F.col("aggregate_id") == aggregate)
    w = Window.partitionBy("aggregate_id").orderBy("version")
    e = e.select("aggregate_id", "version", "event_type", "actor", "correlation_id", F.max(F.col("kind") == "edited").over(w).alias("edited_so_far"))
    return e if aggregate is None else e.orderBy("version")


def keep_edited(generated: DataFrame, edited: DataFrame, keys: list[str]) -> DataFrame:
    """The latest generated value of each dimension, unless a person has edited it."""
    cols = [*keys, "version", "value"]
    rows = generated.select(*cols, F.lit(False).alias("_human")).unionByName(edited.select(*cols, F.lit(True).alias("_human")))
    of = lambda when: F.max_by("value", F.when(when, F.col("version")))
    last = rows.groupBy(*keys).agg(of(~F.col("_human")).alias("generated"), of(F.col("_human")).alias("edited"))
    return last.select(*keys, F.coalesce("edited", "generated").alias("value"), F.col("edited").isNotNull().alias("is_edited"))


def override(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Map columns merged name by name; the change wins."""
    j = base.join(changes, key, "left")
    kept = F.map_filter("fields", lambda k, _: F.col("change").isNull() | ~F.coalesce(F.array_contains(F.map_keys("change"), k), F.lit(False)))
    return j.select(key, F.when(F.col("change").isNull(), F.col("fields")).otherwise(F.map_concat(kept, "change")).alias("fields"), F.col("change").isNotNull().alias("overridden"))


def live(rows: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Overlay rows whose latest flag is not removed; removed: key, version, is_removed."""
    gone = removed.groupBy(key).agg(F.max_by("is_removed", "version").alias("gone")).where("gone")
    return rows.join(gone, key, "left_anti")


def scopes_of(category: Column, interview: Column, project: Column) -> Column:
    """0 to 3 notification tags of an event."""
    i = F.when(interview.isNotNull() & category.isin("Interview", "Sentence"), F.concat(F.lit("transcript:"), interview))
    return F.filter(
        F.array(i, F.when((category == "Interview") & project.isNotNull(), F.concat(F.lit("interviews:"), project)), F.when(category.isin("Interview", "Project") & project.isNotNull(), F.concat(F.lit("project:"), project))),
        lambda x: x.isNotNull(),
    )


def backlog(notices: DataFrame, subscriber: str, order: str, size: int = 64) -> DataFrame:
    """The newest ``size`` notices of each subscriber."""
    return notices.withColumn("_k", F.row_number().over(Window.partitionBy(subscriber).orderBy(F.desc(order)))).where(F.col("_k") <= size).drop("_k")


def lag_between(expected: DataFrame, projected: DataFrame, key: str) -> DataFrame:
    """Keys that only one side holds."""
    j = expected.select(key, F.lit(True).alias("e")).distinct().join(projected.select(key, F.lit(True).alias("p")).distinct(), key, "full_outer")
    return j.where("e is null or p is null").select(key, F.when(F.col("p").isNull(), "not_projected").otherwise("not_expected").alias("lag"))


def audit_versions(events: DataFrame) -> DataFrame:
    """Gaps and repeated versions of each stream."""
    w = Window.partitionBy("aggregate_id").orderBy("version")
    step = F.col("version") - F.lag("version", 1, -1).over(w)
    e = events.select("aggregate_id", "version", step.alias("step"))
    return e.groupBy("aggregate_id").agg(F.count_if(F.col("step") > 1).alias("n_gaps"), F.count_if(F.col("step") == 0).alias("n_repeats"), F.max("version").alias("last_version"))


def metrics(samples: DataFrame, name: str, value: str, order: str, keep: int = 1000) -> DataFrame:
    """Count, sum and index percentiles of the newest ``keep`` samples: p95 above 20 values, p99 above 100, else the maximum."""
    last = samples.withColumn("_k", F.row_number().over(Window.partitionBy(name).orderBy(F.desc(order)))).where(F.col("_k") <= keep)
    all_of = samples.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
    v = last.groupBy(name).agg(F.array_sort(F.collect_list(value)).alias("v")).withColumn("k", F.size("v"))

    def at(q):
        return F.element_at("v", (F.floor(F.col("k") * F.lit(q)) + 1).cast("int"))

    top = F.element_at("v", -1)
    p = v.select(name, F.element_at("v", 1).alias("low"), top.alias("high"), at(0.5).alias("p50"), F.when(F.col("k") > 20, at(0.95)).otherwise(top).alias("p95"), F.when(F.col("k") > 100, at(0.99)).otherwise(top).alias("p99"))
    return all_of.join(p, name)


def status_changes(events: DataFrame, key: str, status: str, order: str) -> DataFrame:
    """Status events; one that repeats the current status is refused."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(order))
    return events.withColumn("refused", F.coalesce(before == F.col(status), F.lit(False)))


def rebuild(events: DataFrame, jobs: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """``(job, aggregate_id, state)``: what each projection job makes of a log; jobs return aggregate_id and their state's columns."""
    out = None
    for name, job in jobs.items():
        rows = job(events)
        state = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in rows.columns if c != "aggregate_id"))
        rows = rows.select(F.lit(name).alias("job"), "aggregate_id", state.alias("state"))
        out = rows if out is None else out.unionByName(rows)
    return out
