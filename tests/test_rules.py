"""Rules on generated rows, each against a plain version of the rule, and small rows for what has no plain version."""

import hashlib
import random
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions import ids, text
from parlance.operators import enrich, events, export, graph, ingest, lens, resolve, retrieve
from parlance.plans import scratch
from parlance.plans.closure import connected_components
from parlance.sources import io
from parlance.streaming import jobs

CITIES = ["Turku", "Oulu", "Lahti", "Kuopio", "Vaasa"]


def test_uuid5_equals_pythons(spark):
    r = random.Random(1)
    names = ["", *("".join(r.choices("abcß中🙂:/ 9", k=r.randrange(1, 80))) for _ in range(60))]
    d = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.uuid5(F.col("n")).alias("u"))
    assert {x.n: x.u for x in d.collect()} == {n: str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names}


def plain_surface(s):
    s = re.sub(r"[ \t\r\n]+", " ", s.lower()).strip()
    for article in ("the ", "an ", "a "):
        if s.startswith(article) and len(s) > len(article):
            s = s[len(article) :]
            break
    for end in ("'s", "’s", "'", "’"):
        if s.endswith(end):
            s = s[: -len(end)]
            break
    return s[:-1] if len(s) > 3 and s.endswith("s") and not s.endswith("ss") else s


def test_surface_keys(spark):
    r = random.Random(2)
    heads, tails = ["", "The ", "the  ", "An ", "a\t", "Theo "], ["", "s", "'s", "’s", "s'", "ss", " "]
    words = [r.choice(heads) + r.choice([*CITIES, "gas", "Ox", "LIME press", "a"]) + r.choice(tails) for _ in range(200)]
    got = spark.createDataFrame([(w,) for w in words], "s string").select("s", text.surface_key(F.col("s")).alias("k")).collect()
    assert {x.s: x.k for x in got} == {w: plain_surface(w) for w in words}


def fragments(spark, speakers, key=1):
    return spark.createDataFrame([(key, k, s) for k, s in enumerate(speakers)], "i int, seq int, who string")


def test_runs_of_one_speaker(spark):
    r = random.Random(3)
    rows, want = [], []
    for i in range(12):
        who = r.choices(["moderator", "guest", None], [5, 4, 1], k=r.randrange(1, 30))
        rows += [(i, k, s) for k, s in enumerate(who)]
        starts = [k for k in range(len(who)) if k == 0 or who[k] != who[k - 1]]
        want += [(i, n, who[a], a, b - 1) for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(who)], strict=True))]
    u = ingest.baseline_utterances(spark.createDataFrame(rows, "i int, seq int, who string"), "i", "who").collect()
    assert sorted((x.i, x.utterance_no, x.speaker or "", x.first_seq, x.last_seq) for x in u) == sorted((i, n, s or "", a, b) for i, n, s, a, b in want)


def plain_merge(who, proposals):
    """(members, proposal) after the valid and disjoint proposals; the rest stays in its runs."""
    taken, out = set(), []
    for n, (speaker, members) in enumerate(proposals):
        ok = members and members == sorted(set(members)) and all(0 <= k < len(who) and who[k] == speaker for k in members)
        if ok and not taken & set(members):
            taken |= set(members)
            out.append((tuple(members), n))
    start = 0
    for k in range(1, len(who) + 1):
        if k == len(who) or who[k] != who[k - 1]:
            left = tuple(x for x in range(start, k) if x not in taken)
            out += [(left, None)] if left else []
            start = k
    return sorted(out)


def test_merge_proposals(spark):
    r = random.Random(4)
    rows, said, want = [], [], {}
    for i in range(40):
        who = r.choices(["ana", "ben"], k=r.randrange(2, 9))
        proposals = []
        for n in range(r.randrange(4)):
            members = r.sample(range(len(who) + 1), r.randrange(0, 4))
            members = sorted(members) if r.random() < 0.8 else members
            proposals.append((r.choice(["ana", "ben"]), members))
            said.append((i, n, *proposals[-1]))
        rows += [(i, k, s) for k, s in enumerate(who)]
        want[i] = plain_merge(who, proposals)
    u = ingest.merge_proposals(spark.createDataFrame(rows, "i int, seq int, who string"), spark.createDataFrame(said, "i int, ordinal int, speaker string, members array<int>"), "i", "who")
    got = defaultdict(list)
    for x in u.collect():
        got[x.i].append((tuple(x.members), x.proposal))
    assert {i: sorted(v, key=str) for i, v in got.items()} == {i: sorted(v, key=str) for i, v in want.items()}


def test_interruptions_follow_their_proposals(spark):
    f = fragments(spark, ["ana", "ben", "ana", "ben", "ana"])
    p = spark.createDataFrame([(1, 0, "ben", [1, 3]), (1, 1, "ana", [0, 2, 4]), (1, 2, "ben", [3])], "i int, ordinal int, speaker string, members array<int>")
    u = ingest.merge_proposals(f, p, "i", "who")
    x = spark.createDataFrame([(1, 0, 1, 3), (1, 1, 0, 2), (1, 2, 1, 3), (1, 0, 1, 5)], "i int, interrupting int, interrupted int, at_index int")
    assert sorted(r.at_index for r in ingest.remap_interruptions(x, u, "i").collect()) == [2, 3]


def plain_windows(rows):
    settled = {}
    for w in sorted({r[0] for r in rows}):
        here = sorted((s, name) for v, s, name in rows if v == w)
        votes = defaultdict(Counter)
        for s, name in here:
            if s in settled:
                votes[name][settled[s]] += 1
        said = {name: c.most_common(1)[0][0] for name, c in votes.items()}
        for s, name in here:
            settled.setdefault(s, said.get(name, name))
    return settled


def test_window_reconciliation(spark):
    r = random.Random(5)
    rows, want = [], {}
    for i in range(20):
        n, mine = r.randrange(6, 25), []
        for w, first in enumerate(range(0, n, 3)):
            mine += [(w, s, r.choice("PQR") + ("" if w == 0 else str(w))) for s in range(first, min(first + 5, n))]
        rows += [(i, *x) for x in mine]
        want[i] = plain_windows(mine)
    got = defaultdict(dict)
    for x in ingest.reconcile_windows(spark.createDataFrame(rows, "i int, window int, seq int, speaker string"), "i").collect():
        got[x.i][x.seq] = x.speaker
    assert got == want


@pytest.mark.parametrize("n", [1, 17, 20, 21, 64])
def test_windows_reach_the_end(spark, n):
    got = [(x.first_seq, x.end_seq) for x in ingest.inference_windows(fragments(spark, ["q"] * n), "i", size=20, overlap=7).orderBy("window").collect()]
    assert got[0][0] == 0 and got[-1][1] == n and all(e < n for _, e in got[:-1])
    assert all(b - a == 13 for (a, _), (b, _) in zip(got, got[1:], strict=False)) and all(e - a <= 20 for a, e in got)


def test_segments_stand_or_fall_together(spark):
    r = random.Random(6)
    rows, sizes, want = [], [], set()
    for i in range(80):
        present = sorted(r.sample(range(14), r.randrange(9, 15)))
        cuts = sorted(r.sample(range(15), 4))
        ranges = [(cuts[0], cuts[1] - 1), (cuts[2], cuts[3] - 1)]
        if r.random() < 0.3:
            a, b = r.choice(ranges)
            ranges.append(r.choice([(b, a), (a, b), (b, b + 1)]))
        r.shuffle(ranges)
        rows += [(i, a, b) for a, b in ranges]
        sizes.append((i, present))
        seen = [k for a, b in ranges for k in range(a, b + 1)]
        if all(a <= b for a, b in ranges) and len(seen) == len(set(seen)) and set(seen) <= set(present):
            want |= {(i, a, b) for a, b in ranges}
    p, s = spark.createDataFrame(rows, "i int, start_index int, end_index int"), spark.createDataFrame(sizes, "i int, present array<int>")
    got = {(x.i, x.start_index, x.end_index) for x in enrich.valid_segments(p, s, "i").collect()}
    assert got == want and 0 < len({i for i, *_ in want}) < 80


def speakers(spark, rows):
    return spark.createDataFrame([(0, *r) for r in rows], "s int, interview_id int, speaker_id string, handle string, display_name string, provisional boolean")


def test_people(spark):
    rows = [
        (1, "u1", "V1", "Mika Oulu", False), (2, "u2", "V4", " mika  OULU ", False), (3, "u3", "V1", "Mika", False),
        (3, "u4", "V2", "Sana Vaasa", False), (4, "u5", "V9", "Lone Lahti", False), (5, "u6", "V1", "V1", False), (5, "u7", "V2", "Ida Turku", True),
        (6, "u8", "turku", "Turku", False), (7, "u9", "x", "TURKU", False), (8, "u0", "x", "   ", False), (9, "ua", "x", None, False),
    ]
    pool = resolve.participant_pool(spark.createDataFrame([(0, 8, "SANA vaasa"), (0, 2, "Sana  VAASA"), (0, 1, "Ida Turku")], "s int, interview_id int, name string"), "s")
    g = resolve.person_groups(speakers(spark, rows), pool, "s")
    got = {x.name_key: (x.n_links, x.auto, x.method, x.name) for x in g.collect()}
    assert got == {
        "mika oulu": (2, True, "exact_name", "Mika Oulu"),
        "mika": (1, False, "exact_name", "Mika"),
        "sana vaasa": (1, True, "front_matter", "Sana  VAASA"),
        "lone lahti": (1, False, "exact_name", "Lone Lahti"),
        "turku": (2, True, "exact_name", "TURKU"),  # a name that differs from its handle only by case takes part
    }
    assert [(x.name_key, x.person) for x in resolve.first_name_suggestions(g, "s").collect()] == [("mika", "mika oulu")]


def test_representatives(spark):
    r = random.Random(7)
    rows = [(p, f"{a}{c}{e}", t, r.randrange(1, 5)) for p in "xy" for a in ("", "the ", "a ") for c in CITIES for e in ("", "s", "'s") for t in ("PLACE", "TEAM") if r.random() < 0.6]
    best = {}
    for p, s, t, m in rows:
        k = (p, t, plain_surface(s))
        best[k] = min(best.get(k, (0, "￿")), (-m, s))
    got = {(x.project_id, x.entity_type, x.norm): x.representative for x in resolve.exact_groups(spark.createDataFrame(rows, "project_id string, surface string, entity_type string, mentions int")).collect()}
    assert got == {k: s for k, (_, s) in best.items()}


def test_pairs_do_not_depend_on_the_tiles(spark):
    r = random.Random(8)
    rows = [(k, r.choice("uv"), [float(x) for x in (r.gauss(0, 1), r.gauss(0, 1), r.gauss(1, 1))] if k % 11 else [0.0] * 3) for k in range(70)]
    d = spark.createDataFrame(rows, "k int, kind string, v array<double>")
    want = set()
    for a, t, x in rows:
        for b, t2, y in rows:
            n = sum(p * p for p in x) * sum(q * q for q in y)
            if a < b and t == t2 and n and round(sum(p * q for p, q in zip(x, y, strict=True)) / n**0.5, 6) >= 0.9:
                want.add((a, b, "auto" if round(sum(p * q for p, q in zip(x, y, strict=True)) / n**0.5, 6) >= 0.97 else "suggest"))
    for size in (1_000, 9):
        assert {(x.a, x.b, x.band) for x in resolve.similar_pairs(d, "k", ["kind"], "v", 0.9, 0.97, tile_rows=size).collect()} == want
    assert resolve.similar_pairs(d.where("false"), "k", ["kind"], "v").count() == 0


def test_far_cells_never_meet(spark):
    """One large block of clusters beside many small ones: all pairs are found, few tiles meet, small blocks are sent once."""
    r = random.Random(9)
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(10)]
    rows = [(k, None if k % 7 == 0 else "big", [c + r.gauss(0, 0.15) for c in centres[k % 10]]) for k in range(420)]
    rows += [(1000 + k, f"small{k % 40}", [r.gauss(0, 1) for _ in range(12)]) for k in range(120)]
    d = spark.createDataFrame(rows, "k int, kind string, v array<double>").repartition(3)
    unit = {k: (kind, np.array(v) / np.linalg.norm(v)) for k, kind, v in rows}
    want = {(a, b) for a in unit for b in unit if a < b and unit[a][0] == unit[b][0] and round(float(unit[a][1] @ unit[b][1]), 6) >= 0.9}
    assert len(want) > 3000
    for pivots in (1, 40):
        assert {(x.a, x.b) for x in resolve.similar_pairs(d, "k", ["kind"], "v", 0.9, 0.97, tile_rows=12, pivots=pivots).collect()} == want
    report = {x.kind: x for x in resolve.tile_report(d, "k", ["kind"], "v", 0.9, tile_rows=12, pivots=40).collect()}
    whole = {x.kind: x for x in resolve.tile_report(d, "k", ["kind"], "v", 0.9, tile_rows=12, pivots=1).collect()}
    assert all((x.n_vectors, x.n_sent, x.n_tile_pairs) == (3, 3, 1) for kind, x in report.items() if kind not in (None, "big"))
    assert 2 * report["big"].n_sent < whole["big"].n_sent and report["big"].n_tile_pairs < whole["big"].n_tile_pairs


def test_vectors_of_two_models_never_meet(spark):
    d = spark.createDataFrame([(1, "p", "m1", [1.0, 0.0]), (2, "p", "m1", [1.0, 0.1]), (3, "p", "m2", [1.0, 0.0]), (4, "q", "m2", [1.0, 0.0])], "k int, area string, model string, v array<double>")
    assert [(x.a, x.b) for x in enrich.comparable_pairs(d, "k", ["area"], "v", 0.5).collect()] == [(1, 2)]
    with pytest.raises(ValueError, match="m2"):
        enrich.comparable_pairs(d.unionByName(spark.createDataFrame([(5, "q", "m2", [1.0])], d.schema)), "k", ["area"], "v", 0.5)


def test_nearest_vectors_equal_a_full_scan(spark, monkeypatch):
    """Clusters, vectors and questions of length 0, ties, fewer vectors than asked for; whatever the cells."""
    r = random.Random(21)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    vectors = [(f"v{k:03d}", "a", [c + r.gauss(0, 0.1) for c in centres[k % 12]]) for k in range(300)]
    vectors += [("z1", "a", [0.0] * 8), ("z2", "b", [0.0] * 8), ("n", "b", [1.0] * 8), ("t1", "a", centres[0]), ("t2", "a", centres[0]), ("x", None, [1.0] * 8)]
    questions = [(1, "a", centres[0]), (2, "a", [r.gauss(0, 1) for _ in range(8)]), (3, "b", centres[1]), (4, "a", [0.0] * 8), (5, "c", centres[2]), (6, "a", [-x for x in centres[3]])]
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    want = {}
    for q, scope, x in questions:
        scores = sorted((-round(float(unit(x) @ unit(v)), 6) + 0.0, i) for i, s, v in vectors if s == scope)
        want |= {(q, i): (-score, k + 1) for k, (score, i) in enumerate(scores[:7])}
    q = spark.createDataFrame(questions, "question_id int, scope string, vector array<double>")
    v = spark.createDataFrame(vectors, "id string, scope string, vector array<double>").repartition(3)
    for rows in (10_000, 20):
        got = {(x.question_id, x.id): (x.score, x.rank) for x in retrieve.vector_top(q, v, 7, rows).collect()}
        assert got == want
    near, u = q.where("question_id = 1"), resolve.unit_vectors(v, "vector").where("scope is not null").select("scope", "id", F.col("unit").alias("u"))
    assert retrieve._nearest(near, *retrieve.vector_cells(u, 20), 7)[1].count() < 100  # of 303
    monkeypatch.setattr(retrieve, "BROADCAST_ROWS", 0)
    assert {(x.question_id, x.id): (x.score, x.rank) for x in retrieve.vector_top(q, v, 7, 20).collect()} == want


def test_ranks_and_fusion(spark):
    r = random.Random(9)
    hits = [(q, r.choice(CITIES)) for q in range(5) for _ in range(12)]
    got = {(x.question_id, x.fragment_id): x.rank for x in retrieve.rank_by_hits(spark.createDataFrame(hits, "question_id int, fragment_id string")).collect()}
    for q in range(5):
        order = sorted(Counter(f for k, f in hits if k == q).items(), key=lambda x: (-x[1], x[0]))
        assert [got[q, f] for f, _ in order] == list(range(1, len(order) + 1))
    ranked = [(q, c, f, k + 1) for q in range(4) for c in ("words", "graph", "near") for k, f in enumerate(r.sample(CITIES, 3))]
    score = defaultdict(float)
    for q, _, f, k in ranked:
        score[q, f] += 1 / (60 + k)
    out = retrieve.fuse(spark.createDataFrame(ranked, "question_id int, channel string, fragment_id string, rank int"), top=3).collect()
    for q in range(4):
        order = sorted(((round(s, 9), f) for (k, f), s in score.items() if k == q), key=lambda x: (-x[0], x[1]))[:3]
        assert [(x.score, x.fragment_id) for x in sorted((x for x in out if x.question_id == q), key=lambda x: x.rank)] == order


def test_names_inside_words_and_with_marks(spark):
    names = [("z", "Oulu", "entity", "1"), ("z", "K.P.", "person", "2"), ("z", "ä", "entity", "3"), ("z", "Vaasa Oy", "entity", "4"), ("y", "Oulu", "entity", "5"), ("z", "", "entity", "6"), ("z", None, "entity", "7")]
    asked = [(1, "z", "What did OULU's k.p. say?"), (2, "z", "the Oululainen of vaasa oy"), (3, "z", "Ä"), (4, "z", ""), (5, "z", "oul u")]
    got = {(x.question_id, x.ref) for x in retrieve.match_names(spark.createDataFrame(asked, "question_id int, scope string, question string"), spark.createDataFrame(names, "scope string, name string, kind string, ref string")).collect()}
    assert got == {(q, ref) for q, s, t in asked for p, n, _, ref in names if p == s and n and n.lower() in t.lower()}


def test_channel_report_flags_what_was_out(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "question_id int")
    out = spark.createDataFrame([(2, "near_a"), (3, "near_a"), (3, "near_b")], "question_id int, side string")
    hits = spark.createDataFrame([(1, "f", 0.5), (2, "f", 0.5), (3, "f", 0.5)], "question_id int, fragment_id string, score double")
    alive = retrieve.without_outages(hits, out, "near_b")
    assert {x.question_id for x in alive.collect()} == {1, 2}
    got = {x.question_id: (x.n_near, x.no_grounding, x.flags) for x in retrieve.channel_report(alive.withColumn("channel", F.lit("near")), q, ["near"], out, {"near": ["near_a", "near_b"]}).collect()}
    assert got == {1: (1, False, ""), 2: (1, False, "near_a_unavailable"), 3: (0, True, "near_a_unavailable,near_b_unavailable,near_unavailable")}


@pytest.mark.parametrize(("category", "interview", "project"), [(c, i, p) for c in ("Sentence", "Interview", "Project") for i in (None, "n7") for p in (None, "k2")])
def test_scopes(spark, category, interview, project):
    d = spark.createDataFrame([(category, interview, project)], "c string, i string, p string")
    tags = [f"transcript:{interview}"] if interview and category != "Project" else []
    tags += [f"interviews:{project}"] if project and category == "Interview" else []
    tags += [f"project:{project}"] if project and category != "Sentence" else []
    assert d.select(events.scopes_of(F.col("c"), F.col("i"), F.col("p"))).first()[0] == tags


def test_percentiles_by_index(spark):
    r = random.Random(10)
    rows = [(f"m{n}", float(r.randrange(10_000)), k) for n in (1, 12, 20, 21, 57, 100, 101, 1300) for k in range(n)]
    got = {x.name: x for x in events.metrics(spark.createDataFrame(rows, "name string, value double, at int"), "name", "value", "at").collect()}
    for name, x in got.items():
        v = sorted(value for m, value, k in rows if m == name and k >= int(name[1:]) - 1000)
        assert (x.low, x.high, x.p50) == (v[0], v[-1], v[int(len(v) * 0.5)])
        assert x.p95 == (v[int(len(v) * 0.95)] if len(v) > 20 else v[-1]) and x.p99 == (v[int(len(v) * 0.99)] if len(v) > 100 else v[-1])


def test_fragment_state_equals_a_replay(spark):
    r = random.Random(11)
    rows, want = [], {}
    for a in range(40):
        state = {"edits": 0, "text": None, "analysis": None, "locked": False}
        for v in range(r.randrange(1, 9)):
            kind, value = r.choice(["edited", "generated", "overridden", "cleared"]), f"w{v}"
            rows.append((a, v, kind, value))
            if kind == "edited":
                state |= {"edits": state["edits"] + 1, "text": value}
            elif kind == "cleared":
                state |= {"analysis": None, "locked": False}
            else:
                state |= {"analysis": value, "locked": state["locked"] or kind == "overridden"}
        want[a] = tuple(state.values())
    got = events.fold_fragments(spark.createDataFrame(rows, "aggregate_id int, version int, kind string, value string").repartition(3)).collect()
    assert {x.aggregate_id: (x.n_edits, x.text_value, x.analysis, x.locked) for x in got} == want


def test_interview_entities_equal_a_replay(spark):
    r = random.Random(12)
    kinds = [k for opened, flags in events.INTERVIEW_ENTITIES.values() for k in (opened, *flags)]
    rows, want = [], {}
    for a in range(15):
        for v in range(60):
            kind, e = r.choice([*kinds, "updated"]), f"e{r.randrange(3)}"
            rows.append((a, v, kind, e, f"n{v}"))
            for entity, (opened, flags) in events.INTERVIEW_ENTITIES.items():
                k = (a, entity, e)
                if kind == opened:
                    want[k] = [f"n{v}", set()]
                elif kind in flags and k in want:
                    want[k][1].add(flags[kind])
                    want[k][0] = f"n{v}" if kind == "speaker_renamed" else want[k][0]
    got = {(x.aggregate_id, x.entity, x.entity_id): (x.name, list(x.flags)) for x in events.interview_entities(spark.createDataFrame(rows, "aggregate_id int, version int, kind string, entity_id string, name string")).collect()}
    assert got == {k: (n, sorted(f)) for k, (n, f) in want.items()}


def test_speaker_split_is_whole_or_refused(spark):
    a = spark.createDataFrame([(1, f"1:{k}", "ana", 0.5, "label", False) for k in range(4)], "interview_id int, fragment_id string, speaker_id string, confidence double, method string, locked boolean")
    x = spark.createDataFrame([(1, "new", "New", 1, ["1:1", "1:2"]), (1, "late", "Late", 2, ["1:2"]), (1, "bad", "Bad", 3, ["1:3", "1:9"])], "interview_id int, handle string, display_name string, version int, fragment_ids array<string>")
    made, after = events.split_speakers(a, x, lambda *c: F.concat_ws("/", *c))
    assert {r.speaker_id for r in made.collect()} == {"1/new", "1/late"}
    got = {r.fragment_id: (r.speaker_id, r.confidence, r.method, r.locked) for r in after.collect()}
    assert got == {"1:0": ("ana", 0.5, "label", False), "1:1": ("1/new", 1.0, "human", True), "1:2": ("1/late", 1.0, "human", True), "1:3": ("ana", 0.5, "label", False)}


def test_requests_without_a_provider_stay(spark):
    rows = [("q1", 1, "unavailable"), ("q1", 2, "error"), ("q1", 3, "ok"), ("q2", 1, "unavailable"), ("q2", 2, "unavailable"), ("q3", 1, "ok"), ("q3", 2, "unavailable")]
    got = enrich.first_provider(spark.createDataFrame(rows, "request_id string, rank int, outcome string")).collect()
    assert {(r.request_id, r.rank, r.outcome, r.served) for r in got} == {("q1", 2, "error", False), ("q2", 2, "unavailable", False), ("q3", 1, "ok", True)}


def test_model_calls_are_batched(spark):
    d = spark.createDataFrame([(str(k), "x", f"p{k}") for k in range(25)], "unit_id string, extractor string, prompt string").repartition(1)
    got = enrich.model_call(d, lambda prompts: [f"{p}/{len(prompts)}" for p in prompts], batch=10).collect()
    assert Counter(r.response.split("/")[1] for r in got) == {"10": 20, "5": 5} and all(r.response.startswith(f"p{r.unit_id}/") for r in got)


def test_end_marks_alone_make_a_label(spark):
    d = spark.createDataFrame([("Is it raining", "declarative"), ("Really? ", "declarative"), ("Stop!", "Exclamatory"), ("Go home.", "imperative"), ("Why?", "")], "t string, label string")
    assert [(r.rule_label, r.disagrees) for r in enrich.cross_check(d, "t", "label").collect()] == [(None, False), ("interrogative", True), ("exclamatory", False), (None, False), ("interrogative", False)]


def test_override_locks(spark):
    i = spark.createDataFrame([("i1", {"due": "may", "who": "ana"}, False), ("i2", {"due": "may"}, False)], "item_id string, fields map<string,string>, locked boolean")
    o = spark.createDataFrame([("i1", 4, {"due": "june"}), ("i1", 3, {"due": "july", "tag": "x"})], "item_id string, version int, fields map<string,string>")
    got = {r.item_id: (r.fields, r.locked) for r in lens.apply_overrides(i, o).collect()}
    assert got == {"i1": ({"due": "june", "who": "ana", "tag": "x"}, True), "i2": ({"due": "may"}, False)}


def test_slugs_equal_a_registry(spark):
    """Names whose slugs run into each other's suffixes, in several orders and bundles."""
    r = random.Random(14)
    names = [[*"aa", "a-2", "a-2-x2", "a-2-2", "a-2", "!!", "!!", "a 2 2", "A", "a-02", "a-3-", "2", "2-2", "2"], ["a-2-2", "a-2", "a", "a", "a-2", "a", "a-3"], ["same"] * 40]
    names += [["".join(r.choices("ab -?23", k=r.randrange(0, 7))) for _ in range(200)] for _ in range(4)]
    want, rows = {}, []
    for b, of in enumerate(names):
        taken = set()
        for n, name in enumerate(of):
            base = re.sub("[^a-z0-9]+", "-", name.lower()).strip("-") or "x-" + hashlib.sha1(name.encode()).hexdigest()[:8]
            tries = (base if k == 1 else f"{base}-{k}" for k in range(1, 1000))
            want[b, n] = next(t for t in tries if t not in taken)
            taken.add(want[b, n])
            rows.append((b, n, name))
    r.shuffle(rows)
    got = export.unique_slugs(spark.createDataFrame(rows, "bundle int, n int, name string").repartition(3), "bundle", "name", "n")
    assert got.columns == ["bundle", "n", "name", "slug"]
    assert {(x.bundle, x.n): x.slug for x in got.collect()} == want


def test_titles_are_cut_before_they_are_escaped(spark):
    r = random.Random(15)
    texts = ["".join(r.choices("ab[]\\ \n\t", k=r.randrange(0, 120))) for _ in range(80)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", export.safe_title(F.col("t"), 30).alias("s")).collect()
    for x in got:
        want = re.sub(r"\s+", " ", x.t).strip(" ")[:30].replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]")
        assert x.s == want


def test_pages_list_all_aliases_and_mentions(spark):
    m = [(f"f{k}", 0, f"name {k % 9}|", 0.5) for k in range(30)]
    d = spark.createDataFrame(m, "fragment_id string, pos int, surface string, confidence double")
    al = spark.createDataFrame([(f"name {k}|", "page") for k in range(8)], "surface string, canonical_id string")
    got = export.entity_pages(d, al).orderBy("page", "place").collect()
    assert [(x.page, x.alias, x.place) for x in got] == [("page", f"name {k}|", k + 1) for k in range(8)] + [("surface:name 8|", "name 8|", 1)]
    assert all((x.n_mentions, x.n_surfaces) == (27, 8) for x in got[:8]) and sum(x.n_alias_mentions for x in got) == 30
    an = spark.createDataFrame([(f"f{k}", 1, k, f"u-{k}") for k in range(29)], "fragment_id string, interview_id int, seq int, anchor string")
    rows = export.mention_tables(d, al, an).collect()
    assert len(rows) == 30 and {x.text for x in rows} == {f"name {k}\\|" for k in range(9)} and sum(x.location == "" for x in rows) == 1


def test_documents_hold_front_matter_and_grounding(spark):
    i = spark.createDataFrame([("i1", "b", "notes", "risk", "s-1", "late [again]", 0.5, "ana"), ("i2", "b", "notes", "risk", "s-2", "fine", 0.7, None)], "item_id string, bundle string, lens string, type string, slug string, text string, confidence double, speaker string")
    q = spark.createDataFrame([("i1", "> it slips\n> — ana, [u-1](/transcript.md#u-1)")], "item_id string, quotes string")
    got = {r.path: r.content for r in export.item_documents(i, q).collect()}
    assert got["risks/s-1.md"] == "---\ntype: risk\ntitle: late \\[again\\]\nitem_id: i1\nlens: notes\nconfidence: 0.5\ntags: [lens:notes]\n---\nlate [again]\n\n## Relationships\nOWNER: ana\n\n## Grounding\n> it slips\n> — ana, [u-1](/transcript.md#u-1)"
    assert got["risks/s-2.md"].endswith("fine\n\n## Relationships\n\n## Grounding\n")


def test_log_is_whole_and_newest_first(spark):
    rows = [(k, f"2023-0{1 + k % 4}-01 00:00:{k:02d}", f"m{k}") for k in range(40)]
    got = export.export_log(spark.createDataFrame(rows, "entry_id int, ts string, message string").withColumn("ts", F.to_timestamp("ts"))).collect()
    assert [x.entry_id for x in got] == [k for k, *_ in sorted(rows, key=lambda r: r[1], reverse=True)] and len({x.day for x in got}) == 4


def test_components(spark):
    r = random.Random(16)
    edges = [(k, k + 1) for k in range(200, 260)] + [(500, 500 + k) for k in range(1, 40)] + [(r.randrange(100), r.randrange(100)) for _ in range(60)] + [(None, 3)]
    root = {n: n for e in edges for n in e if None not in e}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    want = {n: top(n) for n in root if any(n in e and e[0] != e[1] for e in edges)}
    assert {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()} == want
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_walks_have_no_limit(spark):
    chain = [(f"n{k}", f"n{k + 1}") for k in range(70)] + [("n70", "n3"), ("far", "n0")]
    e = spark.createDataFrame(chain, "src string, dst string")
    n = spark.createDataFrame([(f"n{k}", "start" if k == 0 else "x") for k in range(71)] + [("far", "x"), ("alone", "x")], "node string, type string")
    assert {x.node for x in graph.unreachable(e, n, ["start"]).collect()} == {"far", "alone"}
    start = spark.createDataFrame([("q", "n68")], "entry string, node string")
    assert {x.node: x.depth for x in graph.reach(e, start, 4).collect()} == {"n68": 0, "n69": 1, "n70": 2, "n3": 3, "n4": 4}


def test_walks_write_what_they_find(spark, monkeypatch):
    """On a chain every hop finds one node: what is written grows with the nodes, not with their square."""
    written, real = [], graph.materialise

    def counted(df):
        out = real(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "materialise", counted)
    n = 30
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)], "src int, dst int")
    got = graph.reach(edges, spark.createDataFrame([(0, 0)], "entry int, node int")).collect()
    assert sorted((x.node, x.depth) for x in got) == [(k, k) for k in range(n + 1)]
    assert sum(written[1:]) <= 2 * (n + 1)  # written[0] is the edge table
    seen = graph.Seen(2)
    for k in range(9):
        seen.add(spark.createDataFrame([(k,)], "node int"))
        assert sorted(x.node for x in seen.rows().collect()) == list(range(k + 1)) and sum(map(len, seen.sizes)) <= 4


def test_inherited_values(spark):
    r = random.Random(17)
    parent = {k: k - 1 if k < 90 else r.choice([None, *range(90, 140), 999]) for k in range(140)}
    parent[0] = None
    value = {k: f"v{k}" if k == 0 or k >= 90 and r.random() < 0.15 else None for k in range(140)}

    def find(k):
        seen = set()
        while k in value and k not in seen:
            if value[k] is not None:
                return value[k]
            seen.add(k)
            k = parent[k]
        return None

    d = spark.createDataFrame([(k, parent[k], value[k]) for k in range(140)], "node int, parent int, value string")
    assert {x.node: x.value for x in graph.inherited(d).collect()} == {k: find(k) for k in range(140)}


def test_segments_are_grounded_in_any_order_of_input(spark):
    r = random.Random(18)
    rows = [(i, t, "".join(r.choices("ab .!?\n", k=r.randrange(0, 50))) if r.random() < 0.9 else None) for i in range(6) for t in range(4)]
    d, src = spark.createDataFrame(rows, "i int, t int, s string"), {(i, t): s for i, t, s in rows}
    want = sorted((i, t, p.strip(" \t\r\n")) for i, t, s in rows for p in re.findall(r"[^.!?]+(?:[.!?]+[ \t\r\n]*|\Z)|[.!?]+[ \t\r\n]*", s or "") if p.strip(" \t\r\n"))
    for n in (1, 4):
        got = ingest.segment(d.repartition(n), ["i", "t"], "s").collect()
        assert all(src[x.i, x.t][x.start_char : x.end_char] == x.text for x in got)
        assert sorted((x.i, x.t, x.text) for x in got) == want


def test_bad_files_are_set_apart(spark, tmp_path):
    for name, data in (("a.txt", b"good"), ("b.txt", b"\xff\xfe"), ("c.txt", b""), ("d.md", b"other")):
        (tmp_path / name).write_bytes(data)
    good, bad = io.scan_texts(spark, str(tmp_path))
    assert {(x.path[-5:], x.text) for x in good.collect()} == {("a.txt", "good")}
    assert [(x.path[-5:], x.error) for x in bad.collect()] == [("b.txt", "not UTF-8")]


def test_appended_versions_count_once(spark, tmp_path):
    e = lambda *rows: spark.createDataFrame(rows, "aggregate_id int, version int, what string")
    io.append_events(e((1, 0, "a"), (1, 1, "b"), (1, 1, "b")), f"{tmp_path}/log", first=True)
    io.append_events(e((1, 1, "x"), (1, 2, "c"), (2, 0, "d")), f"{tmp_path}/log")
    assert sorted(tuple(x) for x in spark.read.parquet(f"{tmp_path}/log").collect()) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "d")]


def test_redrive_outcomes(spark):
    parked = spark.createDataFrame([(1, "T", "known", "r1", True), (2, "T", "known", "r2", True), (3, "T", "odd", "r1", True), (4, "U", "known", "r1", False), (5, "U", "known", "r1", None)], "commit_position int, aggregate_type string, event_type string, referent string, valid boolean")
    got = events.redrive(parked, spark.createDataFrame([("r1",)], "referent string"), spark.createDataFrame([("known",)], "event_type string")).collect()
    assert {x.aggregate_type: (x.redriven, x.still_parked, x.no_handler, x.failed) for x in got} == {"T": (1, 1, 1, 0), "U": (0, 0, 0, 2), None: (1, 1, 1, 2)}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getConf():  # noqa: N802
            return {}

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.scratch_dir(Session())
    Context.master = "local[4]"
    assert scratch.scratch_dir(Session()).startswith("file:///")


def test_old_scratch_expires(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "_root", lambda _: f"file://{tmp_path}/s")
    assert scratch.expire(spark) == 0
    d = scratch.materialise(spark.range(3))
    (tmp_path / "s" / "other").mkdir()
    assert scratch.expire(spark, 1) == 0 and d.count() == 3
    assert scratch.expire(spark, -1) == 1 and [p.name for p in (tmp_path / "s").iterdir()] == ["other"]


def test_fields_of_any_shape_become_text(spark):
    d = spark.createDataFrame([(1, '{"text": "a", "lens": {"x": [1, 2]}, "n": 1.5, "ok": true, "none": null, "tags": ["p", "q"], "locked": []}'), (2, "no json"), (3, None), (4, "{}")], "k int, fields string")
    got = {x.k: x.f for x in d.select("k", lens.flatten_fields(F.col("fields")).alias("f")).collect()}
    assert got[1] == {"text": "a", "field_lens": '{"x":[1,2]}', "n": "1.5", "ok": "true", "none": None, "tags": '["p","q"]', "field_locked": "[]"}
    assert got[4] == {} and not got[2] and got[3] is None


def test_replayed_log_is_dealt_by_its_size(spark, monkeypatch):
    """The wide log is cut once, without a join with itself; more events are more tasks, and a fold keeps no window of them."""
    from parlance.bindings import events as bound

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(bound._wide(spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(events, "TASK_EVENTS", 10)
    rows = [(k % 7, k, "edited" if k % 3 else "cleared", f"x{k}") for k in range(200)]
    log = spark.createDataFrame(rows, "aggregate_id int, version int, kind string, value string")
    assert events.dealt(log, "aggregate_id").rdd.getNumPartitions() == 20
    assert "Window" not in plan(events.fold_fragments(log))
    one = events.keep_edited(log.where("kind = 'cleared'"), log.where("kind = 'edited' and aggregate_id < 3"), ["aggregate_id"])
    assert "Join" not in plan(one)
    assert sorted((x.aggregate_id, x.value, x.is_edited) for x in one.collect()) == [(0, "x196", True), (1, "x197", True), (2, "x191", True), (3, "x192", False), (4, "x186", False), (5, "x180", False), (6, "x195", False)]


def test_walk_from_nodes_that_many_entries_reach(spark, monkeypatch):
    """Hops through a hot node are dealt to several tasks; depths and induced edges are those of plain walks."""
    monkeypatch.setattr(graph, "HOT", 3)
    pairs = {(f"e{k}", f"a{k % 5}") for k in range(20)} | {(f"a{k}", "hub") for k in range(5)} | {("hub", f"b{k}") for k in range(9)} | {("b0", "e1"), ("b1", "b1"), ("b2", "a2")}
    e = spark.createDataFrame(sorted(pairs), "src string, dst string")
    start = spark.createDataFrame([(f"e{k}", f"e{k}") for k in range(20)], "entry string, node string")
    assert graph._onward(start.select("entry", F.lit("hub").alias("node")), 20, e.toDF("node", "next")).count() == 180
    for depth in (2, 3, None):
        want = {}
        for k in range(20):
            at, now = {f"e{k}": 0}, {f"e{k}"}
            for n in range(1, (depth or 99) + 1):
                now = {y for x, y in pairs if x in now} - set(at)
                at |= dict.fromkeys(now, n)
            want |= {(f"e{k}", x): n for x, n in at.items()}
        reached = graph.reach(e, start, depth)
        rows = reached.collect()
        assert len(rows) == len(want) and {(x.entry, x.node): x.depth for x in rows} == want
        got = [(x.entry, x.src, x.dst) for x in graph.induced(e, reached).collect()]
        entries = {x for x, _ in want}
        assert len(got) == len(set(got)) and set(got) == {(i, x, y) for i in entries for x, y in pairs if (i, x) in want and (i, y) in want}


def test_induced_edges_start_from_the_lighter_end(spark):
    e = spark.createDataFrame([("hub", f"b{k}") for k in range(9)] + [("b1", "hub"), ("b2", "gone")], "src string, dst string")
    reached = spark.createDataFrame([(k, "hub") for k in range(20)] + [(k, f"b{k}") for k in range(9)] + [(None, "hub"), (None, "b0")], "entry int, node string")
    assert graph._lighter_ends(e, reached.where("entry is not null")).count() == 10
    assert sorted(tuple(x) for x in graph.induced(e, reached).select("entry", "src", "dst").collect()) == sorted([(k, "hub", f"b{k}") for k in range(9)] + [(1, "b1", "hub")])


def test_slugs_read_their_names_once(spark):
    """However many branches number them, names are computed once."""
    seen = spark.sparkContext.accumulator(0)

    def told(name):
        seen.add(1)
        return name

    raw = [(1, "a"), (2, "a"), (3, "a 2"), (4, "b"), (5, "b"), (6, "c")]
    names = spark.createDataFrame(raw, "id int, raw string").select("id", F.lit(0).alias("bundle"), F.udf(told, "string")("raw").alias("name"))
    got = {x.id: x.slug for x in export.unique_slugs(names, "bundle", "name", "id").collect()}
    assert got == {1: "a", 2: "a-2", 3: "a-2-2", 4: "b", 5: "b-2", 6: "c"} and seen.value == len(raw)
