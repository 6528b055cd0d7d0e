"""The projections of the event log as mergeable folds: a state per key that grows by the states of more events.

``of`` makes states of events, ``merge`` makes one state per key of several, ``result`` shows states
as the projection's rows.  Whatever way a log is cut, merging the states of its pieces gives the state of the whole, as
long as each version comes once (and, for ``statuses``, pieces follow one another).  The batch operators of
events.py are the replay that they are held against.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.operators.events import INTERVIEW_ENTITIES

_MERGE = {"max": F.max, "min": F.min, "sum": F.sum}


@dataclass(frozen=True)
class Fold:
    keys: list[str]
    #: State columns: what an event adds to it, and how two of them are merged (max, min, sum).
    parts: dict[str, tuple[Column, str]]
    result: Callable[[DataFrame], DataFrame]
    #: Rows that events are folded as.
    prepare: Callable[[DataFrame], DataFrame] = field(default=lambda e: e)
    #: Merging beyond the columns' own, if there is any: states to states.
    merging: Callable[[DataFrame], DataFrame] | None = None

    def of(self, events: DataFrame) -> DataFrame:
        return self.prepare(events).groupBy(*self.keys).agg(*(_MERGE[how](c).alias(n) for n, (c, how) in self.parts.items()))

    def merge(self, states: DataFrame) -> DataFrame:
        if self.merging is not None:
            return self.merging(states)
        return states.groupBy(*self.keys).agg(*(_MERGE[how](n).alias(n) for n, (_, how) in self.parts.items()))


def last(value: Column | str, when: Column, version: str = "version") -> tuple[Column, str]:
    """The value of the highest version that ``when`` holds for."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(when, F.struct(F.col(version).alias("at"), v.alias("is"))), "max"


def fragments() -> Fold:
    """As fold_fragments."""
    kind, made = F.col("kind"), F.col("kind").isin("generated", "overridden")

    def result(s):
        cleared = F.coalesce("cleared", F.lit(-1))
        return s.select("aggregate_id", "version", "n_edits", F.col("text.is").alias("text_value"), F.when(F.col("made.at") > cleared, F.col("made.is")).alias("analysis"), F.coalesce(F.col("overridden") > cleared, F.lit(False)).alias("locked"), F.col("speaker.is").alias("speaker_value"))

    at = lambda k: (F.when(kind == k, F.col("version")), "max")
    parts = {"version": (F.col("version"), "max"), "n_edits": ((kind == "edited").cast("long"), "sum"), "text": last("value", kind == "edited"), "made": last("value", made), "cleared": at("cleared"), "overridden": at("overridden"), "speaker": last("value", kind == "attributed")}
    return Fold(["aggregate_id"], parts, result)


def headers() -> Fold:
    """As interview_headers."""
    kind = F.col("kind")
    told = kind.isin("created", "updated")
    status = F.when(kind == "created", "created").when(kind == "archived", "archived").when(kind == "status_changed", F.col("status"))
    parts = {"title": last("title", told & F.col("title").isNotNull()), "language": last("language", told & F.col("language").isNotNull()), "status": last(status, status.isNotNull()), "lens_version": last("lens_version", (kind == "lens_applied") & F.col("lens_version").isNotNull()), "version": (F.col("version"), "max")}
    return Fold(["aggregate_id"], parts, lambda s: s.select("aggregate_id", *(F.col(f"{c}.is").alias(c) for c in ("title", "language", "status", "lens_version")), "version"))


def entities() -> Fold:
    """As interview_entities."""
    kind = F.col("kind")
    openers = [opened for opened, _ in INTERVIEW_ENTITIES.values()]
    entity = F.lit(None).cast("string")
    by_flag: dict[str, list[str]] = {}
    for name, (opened, flags) in INTERVIEW_ENTITIES.items():
        entity = F.when(kind.isin(opened, *flags), name).otherwise(entity)
        for at, flag in flags.items():
            by_flag.setdefault(flag, []).append(at)
    parts = {"opened": (F.when(kind.isin(*openers), F.col("version")), "max"), "name": last("name", kind.isin(*openers, "speaker_renamed"))}
    parts |= {f"flag_{flag}": (F.when(kind.isin(*kinds), F.col("version")), "max") for flag, kinds in by_flag.items()}

    def result(s):
        flags = F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"flag_{flag}") > F.col("opened"), flag) for flag in by_flag))))
        return s.where("opened is not null").select("aggregate_id", "entity", "entity_id", F.col("name.is").alias("name"), flags.alias("flags"))

    return Fold(["aggregate_id", "entity", "entity_id"], parts, result, lambda e: e.withColumn("entity", entity).where("entity is not null"))


def metadata() -> Fold:
    """As merge_metadata, keyed by aggregate_id; events carry the map column ``diff``."""

    def result(s):
        rows = s.where("value.is is not null").groupBy("aggregate_id")
        return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.col("value.is").alias("value"))))).alias("metadata"))

    return Fold(["aggregate_id", "name"], {"value": last("value", F.lit(True))}, result, lambda e: e.select("aggregate_id", "version", F.explode("diff").alias("name", "value")))


def speakers() -> Fold:
    """As speaker_state."""
    kind, v = F.col("kind"), F.col("version")
    human, moved = kind.isin("renamed", "reattributed"), kind == "reattributed"

    def result(s):
        return s.select("speaker_id", F.coalesce("human.is", "machine.is").alias("name"), (F.col("renamed") == 0).alias("provisional"), F.coalesce("moved.is", "told.is").alias("confidence"), F.col("moved").isNotNull().alias("locked"))

    parts = {"human": last("name", human), "machine": last("name", ~human), "renamed": (F.when(kind == "renamed", 1).otherwise(0), "max"), "moved": (F.when(moved, F.struct(v.alias("at"), F.lit(1.0).alias("is"))), "max"), "told": last("confidence", ~moved)}
    return Fold(["speaker_id"], parts, result)


def kept_edits(keys: list[str]) -> Fold:
    """As keep_edited; events carry ``human``."""
    return Fold(keys, {"generated": last("value", ~F.col("human")), "edited": last("value", F.col("human"))}, lambda s: s.select(*keys, F.coalesce("edited.is", "generated.is").alias("value"), F.col("edited.is").isNotNull().alias("is_edited")))


def overlays() -> Fold:
    """As live: the aggregates whose latest flag is not removed; events carry ``is_removed``, null where they say nothing."""
    return Fold(["aggregate_id"], {"removed": last("is_removed", F.col("is_removed").isNotNull())}, lambda s: s.where("removed is null or not removed.is").select("aggregate_id"))


def statuses() -> Fold:
    """How many status events repeat the one before (status_changes); pieces of a log must follow one another."""
    w = Window.partitionBy("aggregate_id").orderBy("version")

    def prepare(e):
        return e.withColumn("_same", F.coalesce(F.lag("status").over(w) == F.col("status"), F.lit(False)).cast("long"))

    def merging(s):
        runs = F.array_sort(F.collect_list(F.struct("first", "last", "refused")))
        s = s.groupBy("aggregate_id").agg(runs.alias("runs"))
        seams = F.expr("aggregate(sequence(1, size(runs) - 1), 0L, (n, i) -> n + if(runs[i - 1].last.is = runs[i].first.is, 1L, 0L))")
        within = F.expr("aggregate(runs, 0L, (n, r) -> n + r.refused)")
        return s.select("aggregate_id", F.element_at("runs", 1)["first"].alias("first"), F.element_at("runs", -1)["last"].alias("last"), (within + F.when(F.size("runs") > 1, seams).otherwise(F.lit(0).cast("long"))).alias("refused"))

    parts = {"first": (F.struct(F.col("version").alias("at"), F.col("status").alias("is")), "min"), "last": (F.struct(F.col("version").alias("at"), F.col("status").alias("is")), "max"), "refused": (F.col("_same"), "sum")}
    return Fold(["aggregate_id"], parts, lambda s: s.select("aggregate_id", F.col("refused").alias("n")), prepare, merging)
