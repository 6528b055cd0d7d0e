"""Corrections of canonical entities and person links, judged in version order as a project's aggregate would.

Entities of a project that share no surface and no correction cannot influence each other.  A large project is
cut into such independent parts, and each part's events stream in version order through one small
state: its canonicals with their surfaces.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.plans.closure import connected_components
from parlance.plans.scratch import materialise

ENTITY_KINDS = ("canonicalized", "alias_added", "merged", "split")
LINK_KINDS = ("linked", "unlinked")
#: A project with more entity events is cut into its independent parts.
PROJECT_EVENTS = 200_000


class Canonical:
    __slots__ = ("name", "type", "surfaces", "locked", "merged_into")

    def __init__(self, name, kind, surfaces, locked):
        self.name, self.type, self.surfaces, self.locked, self.merged_into = name, kind, Counter(surfaces), locked, None


class Canonicals:
    """The canonicals of one part of a project; ``apply`` returns why an event is refused, or None."""

    def __init__(self):
        self.of, self.holders = {}, {}

    def _hold(self, cid, surfaces, change):
        entry = self.of[cid]
        for s in surfaces:
            held = self.holders.setdefault((entry.type, s), set())
            held.add(cid) if change > 0 else held.discard(cid)

    def _owned(self, kind, surfaces):
        return any(self.holders.get((kind, s)) for s in surfaces)

    def _fault(self, cid):
        entry = self.of.get(cid)
        return "not_found" if entry is None else "merged_away" if entry.merged_into is not None else None

    def apply(self, kind, cid, other, name, entity_type, surfaces, method):
        return getattr(self, f"_{kind}")(cid, other, name, entity_type, surfaces, method)

    def _canonicalized(self, cid, other, name, entity_type, surfaces, method):
        if cid in self.of:
            return "exists"
        if self._owned(entity_type, surfaces):
            return "owned"
        self.of[cid] = Canonical(name, entity_type, surfaces, method == "human")
        self._hold(cid, surfaces, 1)
        return None

    def _alias_added(self, cid, other, name, entity_type, surfaces, method):
        if self._fault(cid):
            return "not_found"
        entry = self.of[cid]
        if entry.locked and method != "human":
            return "locked"
        if self._owned(entry.type, surfaces):
            return "owned"
        entry.surfaces.update(surfaces)
        entry.locked = entry.locked or method == "human"
        self._hold(cid, surfaces, 1)
        return None

    def _merged(self, cid, other, name, entity_type, surfaces, method):
        if cid == other:
            return "itself"
        for x in (cid, other):
            if fault := self._fault(x):
                return fault
        survivor, gone = self.of[cid], self.of[other]
        moved = [s for s in gone.surfaces if s not in survivor.surfaces]
        self._hold(other, gone.surfaces, -1)
        survivor.surfaces.update(moved)
        self._hold(cid, moved, 1)
        survivor.locked = gone.locked = True
        gone.merged_into, gone.surfaces = cid, Counter()
        return None

    def _split(self, cid, other, name, entity_type, surfaces, method):
        if self._fault(cid):
            return "not_found"
        if other in self.of:
            return "exists"
        entry = self.of[cid]
        if any(s not in entry.surfaces for s in surfaces):
            return "not_owned"
        if len(surfaces) >= entry.surfaces.total():
            return "last_surface"
        for s in surfaces:
            entry.surfaces.pop(s, None)
        self._hold(cid, surfaces, -1)
        entry.locked = True
        self.of[other] = Canonical(name, entry.type, surfaces, True)
        self._hold(other, surfaces, 1)
        return None


def _parts(events: DataFrame, project: str, most: int) -> DataFrame:
    """``events`` with ``part``: events of one project and part never touch another part's canonicals or surfaces."""
    largest = events.groupBy(project).count().agg(F.max("count")).first()[0] or 0
    if largest <= most:
        return events.withColumn("part", F.lit(""))
    node = lambda mark, c: F.to_json(F.struct(F.col(project).cast("string").alias("p"), F.lit(mark).alias("m"), c.alias("c")), {"ignoreNullFields": "false"})
    own = events.withColumn("_own", node("c", F.col("canonical_id")))
    named = own.select("_own", node("c", F.col("other_id")).alias("to")).where(F.col("to").isNotNull()).unionByName(own.select("_own", F.explode(F.coalesce("surfaces", F.array().cast("array<string>"))).alias("s"), F.col(project)).select("_own", node("s", F.col("s")).alias("to")))
    parts = connected_components(named.distinct(), "_own", "to").select(F.col("node").alias("_own"), F.col("component").alias("part"))
    return own.join(parts, "_own", "left").withColumn("part", F.coalesce("part", "_own")).drop("_own")


def replay_entities(events: DataFrame, project: str = "project_id", most: int = PROJECT_EVENTS) -> tuple[DataFrame, DataFrame]:
    """(events with ``refused``, canonicals) after a replay of each project's entity events; written once.

    events: project, version, kind, canonical_id, other_id, name, entity_type, surfaces array<string>, method.  A canonicalization needs a
    new id and unowned surfaces; an alias a live canonical (unlocked, if a rule adds it) and an unowned
    surface; a merge two different live canonicals, the other one's surfaces go to the first and both are locked; a
    split a live canonical that holds all named surfaces and keeps one, which go to a new id; both are locked.
    A surface is owned if a live canonical of that type holds it.  Refused events change nothing.
    canonicals: project, canonical_id, name, entity_type, surfaces (sorted), locked, merged_into.
    """
    kinds = {c: events.schema[c].dataType.simpleString() for c in (project, "version")}
    ddl = f"{project} {kinds[project]}, version {kinds['version']}, kind string, refused string, canonical_id string, name string, entity_type string, surfaces array<string>, locked boolean, merged_into string"
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(frames):
        at, state, rows = None, None, []

        def close():
            for cid, c in state.of.items():
                rows.append((at[0], None, None, None, cid, c.name, c.type, sorted(c.surfaces), c.locked, c.merged_into))

        for f in frames:
            for p, part, v, kind, cid, other, name, entity_type, surfaces, method in f.itertuples(index=False):
                if at != (p, part):
                    if state is not None:
                        close()
                    at, state = (p, part), Canonicals()
                why = state.apply(kind, cid, other, name, entity_type, [] if surfaces is None else list(surfaces), method)
                rows.append((p, v, kind, why, cid, None, None, None, None, None))
            yield pd.DataFrame(rows, columns=names, dtype=object)
            rows.clear()
        if state is not None:
            close()
            yield pd.DataFrame(rows, columns=names, dtype=object)

    e = _parts(events.where(F.col("kind").isin(*ENTITY_KINDS)), project, most)
    dealt = e.select(project, "part", "version", "kind", "canonical_id", "other_id", "name", "entity_type", "surfaces", "method").repartition(project, "part").sortWithinPartitions(project, "part", "version")
    out = materialise(dealt.mapInPandas(run, ddl))
    return out.where("kind is not null").select(project, "version", "kind", "canonical_id", "refused"), out.where("kind is null").drop("version", "kind", "refused")


def judge_links(events: DataFrame, project: str = "project_id") -> DataFrame:
    """Adds ``refused`` to the link events of each speaker, one speaker's corrections at a time.

    events: project, version, kind, person, speaker_id, method; kinds: identified (a person begins to exist), linked,
    unlinked (blocks the speaker for rules until a person links it again).  A link needs a person who was identified
    before, a speaker without a link and, by a rule, an unblocked one; only the person that is linked can be unlinked.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        person, blocked, refused = None, False, []
        rows = rows.sort_values("version")
        for kind, who, known, human in zip(rows["kind"], rows["person"], rows["known"], rows["human"], strict=True):
            if kind == "unlinked":
                why = None if person is not None and person == who else "not_linked"
                person, blocked = (None, True) if why is None else (person, blocked)
            else:
                why = "no_person" if not known else "already_linked" if person is not None else "blocked" if blocked and not human else None
                person = who if why is None else person
                blocked = blocked and not (why is None and human)
            refused.append(why)
        return rows.assign(refused=refused)

    first = events.where("kind = 'identified'").groupBy(project, "person").agg(F.min("version").alias("_since"))
    e = events.where(F.col("kind").isin(*LINK_KINDS)).join(first, [project, "person"], "left")
    e = e.select(project, "version", "kind", "person", "speaker_id", F.coalesce(F.col("_since") < F.col("version"), F.lit(False)).alias("known"), F.coalesce(F.col("method") == "human", F.lit(False)).alias("human"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema) + ", refused string"
    return e.groupBy(project, "speaker_id").applyInPandas(walk, schema)


def judge_persons(events: DataFrame, project: str = "project_id") -> DataFrame:
    """Identified events with ``refused``: a person is identified once."""
    e = events.where("kind = 'identified'").select(project, "version", "kind", "person")
    first = e.groupBy(project, "person").agg(F.min("version").alias("_since"))
    return e.join(first, [project, "person"]).withColumn("refused", F.when(F.col("version") > F.col("_since"), "exists")).drop("_since")


def fold_links(events: DataFrame, project: str = "project_id") -> DataFrame:
    """The person and the block of each speaker with an event that counts; the latest decides."""
    p = judge_links(events, project).where("refused is null")
    person = F.max_by(F.when(F.col("kind") == "linked", F.col("person")), "version").alias("person")
    decided = F.when((F.col("kind") == "unlinked") | F.col("human"), F.col("version"))
    return p.groupBy(project, "speaker_id").agg(person, F.coalesce(F.max_by(F.col("kind") == "unlinked", decided), F.lit(False)).alias("blocked"))
