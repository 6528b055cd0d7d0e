"""Corrections against a plain replay of one list of events per project."""

import random

import pytest

from parlance.operators import corrections as C

ENTITY = "project_id int, version int, kind string, canonical_id string, other_id string, name string, entity_type string, surfaces array<string>, method string"


def plain(rows):
    """(refusals, canonicals) by the rules as written down, on lists."""
    refused, world = {}, {}
    for p, v, kind, cid, other, name, etype, surfaces, method in sorted(rows, key=lambda r: (r[0], r[1])):
        entities = world.setdefault(p, {})
        me, it = entities.get(cid), entities.get(other)
        live = me is not None and me["into"] is None

        def owned(t, entities=entities, surfaces=surfaces):
            return any(e["into"] is None and e["type"] == t and s in e["surfaces"] for e in entities.values() for s in surfaces)

        why = None
        if kind == "canonicalized":
            why = "exists" if me else "owned" if owned(etype) else None
            if not why:
                entities[cid] = {"name": name, "type": etype, "surfaces": list(surfaces), "locked": method == "human", "into": None}
        elif kind == "alias_added":
            why = "not_found" if not live else "locked" if me["locked"] and method != "human" else "owned" if owned(me["type"]) else None
            if not why:
                me["surfaces"] += surfaces
                me["locked"] |= method == "human"
        elif kind == "merged":
            why = "itself" if cid == other else "not_found" if me is None else "merged_away" if not live else "not_found" if it is None else "merged_away" if it["into"] else None
            if not why:
                me["surfaces"] += [s for s in it["surfaces"] if s not in me["surfaces"]]
                me["locked"] = it["locked"] = True
                it["into"], it["surfaces"] = cid, []
        elif kind == "split":
            why = "not_found" if not live else "exists" if it else "not_owned" if set(surfaces) - set(me["surfaces"]) else "last_surface" if len(surfaces) >= len(me["surfaces"]) else None
            if not why:
                me["surfaces"] = [s for s in me["surfaces"] if s not in surfaces]
                me["locked"] = True
                entities[other] = {"name": name, "type": me["type"], "surfaces": list(surfaces), "locked": True, "into": None}
        refused[p, v] = why
    return refused, {(p, c): (e["name"], e["type"], sorted(set(e["surfaces"])), e["locked"], e["into"]) for p, es in world.items() for c, e in es.items()}


def chains(seed, projects=4, n=220, ids=12, names=30):
    """Random events; splits name surfaces their canonical once had, so that many are refused for one reason or another."""
    r = random.Random(seed)
    rows = []
    for p in range(projects):
        known = {}
        for v in range(n):
            kind = r.choice(C.ENTITY_KINDS)
            cid, other = f"c{r.randrange(ids)}", f"c{r.randrange(ids + 20 * (kind == 'split'))}"
            surfaces = r.sample([f"s{i}" for i in range(names)], r.randrange(1, 4))
            if kind == "split" and known.get(cid):
                surfaces = r.sample(known[cid], min(len(known[cid]), r.randrange(1, 3)))
            if kind in ("canonicalized", "alias_added"):
                surfaces = surfaces[: 3 if kind == "canonicalized" else 1]
                known.setdefault(cid, []).extend(s for s in surfaces if s not in known.get(cid, []))
            rows.append((p, v, kind, cid, other if kind in ("merged", "split") else None, f"n{v}", f"t{r.randrange(2)}", [] if kind == "merged" else surfaces, r.choice(("human", "rule", None))))
    return rows


@pytest.mark.parametrize("most", [10**6, 0])
def test_entities_equal_a_replay(spark, most):
    """Whole projects, and projects cut into their independent parts."""
    rows = chains(1) + [(p + 50, *r) for p, *r in chains(2, 2, 150, 60, 200)]  # the second kind falls into many parts
    judged, state = C.replay_entities(spark.createDataFrame(random.Random(3).sample(rows, len(rows)), ENTITY).repartition(3), most=most)
    refused, canonicals = plain(rows)
    assert {(x.project_id, x.version): x.refused for x in judged.collect()} == refused
    assert {w for w in refused.values()} == {None, "exists", "owned", "not_found", "locked", "itself", "merged_away", "not_owned", "last_surface"}
    assert {(x.project_id, x.canonical_id): (x.name, x.entity_type, list(x.surfaces), x.locked, x.merged_into) for x in state.collect()} == canonicals


def test_refused_splits_change_nothing(spark):
    """A split that is refused moves no surface, so what comes after it is judged as if it had not been there."""
    rows = [
        (1, 1, "canonicalized", "A", None, "a", "T", ["x"], "rule"),
        (1, 2, "split", "A", "B", "b", "T", ["x"], "human"),  # the last surface
        (1, 3, "alias_added", "A", None, None, None, ["y"], "rule"),
        (1, 4, "split", "A", "B", "b", "T", ["y"], "human"),  # x is still there
        (1, 5, "split", "A", "C", "c", "T", ["x"], "human"),  # now x is the last one
        (1, 6, "merged", "B", "A", None, None, [], "human"),
        (1, 7, "alias_added", "A", None, None, None, ["z"], "human"),  # merged away: no target
        (1, 8, "split", "B", "C", "c", "T", ["x", "y"], "human"),
        (1, 9, "split", "B", "C", "c", "T", ["x"], "human"),
        (1, 10, "alias_added", "C", None, None, None, ["z"], "rule"),  # locked by the split
    ]
    judged, state = C.replay_entities(spark.createDataFrame(rows, ENTITY))
    assert {x.version: x.refused for x in judged.collect() if x.refused} == {2: "last_surface", 5: "last_surface", 7: "not_found", 8: "last_surface", 10: "locked"}
    assert {x.canonical_id: (list(x.surfaces), x.merged_into) for x in state.collect()} == {"A": ([], "B"), "B": (["y"], None), "C": (["x"], None)}


def test_links_equal_a_replay(spark):
    r = random.Random(13)
    rows = [(1, v, r.choice(["linked", "linked", "unlinked", "identified"] if v < 40 else ["linked", "unlinked"]), f"p{r.randrange(4)}", f"k{r.randrange(3)}", r.choice(["human", "rule"])) for v in range(200)]
    known, person, blocked, refused = set(), {}, set(), {}
    for _, v, kind, who, k, method in rows:
        why = None
        if kind == "identified":
            why = "exists" if who in known else None
            known.add(who)
        elif kind == "unlinked":
            why = None if person.get(k) == who else "not_linked"
            if not why:
                del person[k]
                blocked.add(k)
        else:
            why = "no_person" if who not in known else "already_linked" if k in person else "blocked" if k in blocked and method != "human" else None
            if not why:
                person[k] = who
                blocked -= {k} if method == "human" else set()
        refused[v] = why
    e = spark.createDataFrame(rows, "project_id int, version int, kind string, person string, speaker_id string, method string").repartition(3)
    got = C.judge_links(e).select("version", "refused").unionByName(C.judge_persons(e).select("version", "refused"))
    assert {x.version: x.refused for x in got.collect()} == refused
    assert {x.speaker_id: (x.person, x.blocked) for x in C.fold_links(e).collect()} == {k: (person.get(k), k in blocked) for k in ("k0", "k1", "k2")}


def test_no_corrections(spark):
    judged, state = C.replay_entities(spark.createDataFrame([], ENTITY))
    assert judged.count() == state.count() == 0
