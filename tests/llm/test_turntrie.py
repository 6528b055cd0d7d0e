"""The trie of conversations against plain dictionaries of prefixes, and its double arrays against sets."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parlance.llm import turntrie as T

DDL = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role or "", text or ""))
    lists = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in lists.items():
        h = zlib.crc32(str(c).encode()) % 6
        built = tuple(lists.get(c - c % 100, [])[:h] + own[h:])
        for d in range(len(built) + 1):
            members[built[:d]].append(c)
        ends[built].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids[p])
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def rows_of():
    r = random.Random(4)
    say = lambda k: ("user" if k % 2 else "assistant", f"wörd {k} " * (k % 4))
    rows = []
    for c in range(240):
        if c == 100:
            continue  # its hundred has no first conversation
        for t in range(r.choice((1, 2, 3, 5, 8))):
            rows.append((c, t, *say(r.randrange(3))))
    rows += [(c, t, *say(7)) for c in range(1000, 1030) for t in range(4)]  # copies
    rows += [(c, t, *say(t)) for c in (1200, 1201, 1203) for t in range(60)]  # long shared prefixes
    rows += [(c, 60 + t, *say(c + t)) for c in (1201, 1203) for t in range(9)]
    rows += [(2001, t, *say(t)) for t in range(150)]  # long and alone
    rows += [(5, None, None, "null turn"), (5, None, None, "null turn"), (6, 3, None, None), (None, 1, "user", "no id"), (300, None, None, None), (3001, 0, "user", "x" * 100_000)]
    rows += [(c, 0, "user", "only") for c in range(3001, 3020)]  # some lose their one turn
    return rows


@pytest.fixture(scope="module")
def convs(spark):
    return spark.createDataFrame(rows_of(), DDL).repartition(3).withColumns({c: F.lit("clash") for c in ("key", "place", "depth", "n", "end", "head", "h")})


@pytest.mark.parametrize("sizes", [(64, 100_000), (4, 30), (2, 1)])
def test_trie_equals_plain_prefixes(convs, sizes):
    """Also with many layers and with runs so short that most nodes are shared."""
    rows = T.prefix_trie(convs, *sizes).collect()
    got = sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows)
    assert got == plain_trie(rows_of())
    assert rows[0].asDict().keys() == dict.fromkeys(["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]).keys()


def test_joins_of_many_upper_nodes(convs, monkeypatch):
    monkeypatch.setattr(T, "BROADCAST_NODES", 0)
    got = sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in T.prefix_trie(convs).collect())
    assert got == plain_trie(rows_of())


def test_no_and_one_conversation(spark):
    assert T.prefix_trie(spark.createDataFrame([], DDL)).count() == 0
    one = [(100, 1, "user", "a"), (100, 0, "user", "b")]
    assert sorted(r.depth for r in T.prefix_trie(spark.createDataFrame(one, DDL)).collect()) == [0, 1, 2]


def test_double_arrays():
    """Every prefix has its own slot, other labels have none, and slots know their parents."""
    r = random.Random(9)
    for _ in range(200):
        seqs = sorted({tuple(r.randrange(r.choice((2, 5, 40))) for _ in range(r.randrange(7))) for _ in range(r.randrange(1, 60))})
        trie, made = T.pack([list(s) for s in seqs])
        prefixes = {s[:d] for s in seqs for d in range(len(s) + 1)}
        slots = {}
        for p in sorted(prefixes, key=len):
            s = 0
            for c in p:
                s = trie.child(s, c)
                assert s > 0
            slots[p] = s
            assert {c for c in range(45) if trie.child(s, c) > 0} == {q[len(p)] for q in prefixes if len(q) == len(p) + 1 and q[: len(p)] == p}
        assert len(set(slots.values())) == len(prefixes) == len(made) and set(made) == set(slots.values())
        assert all(made.index(trie.check[s]) < made.index(s) for s in made[1:])
