"""The manifest against plain trees, its log against a plain postorder."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parlance.llm import manifest as M


def H(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*map(part, (doc_id, source, lang, n_chars, text)))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([H(*x[i : i + 3]) for i in range(0, len(x), 3)])
    return levels


def plain_path(levels, i):
    out = []
    for x in levels[:-1]:
        run = range(i // 3 * 3, min(i // 3 * 3 + 3, len(x)))
        out.append(("".join(x[k] for k in run if k < i), "".join(x[k] for k in run if k > i)))
        i //= 3
    return out


def plain_table(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    top = plain_levels([trees[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for k, s in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = plain_path(trees[s], i) + plain_path(top, k)
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                node = leaf_of(r[0], r[1].replace("\n", ""), *r[2:])
            for p, q in path:
                node = H(p, node, q)
            out.append((r[0], leaf, trees[s][-1][0], root, H(*(p + q for p, q in path)), node, node == root))
    return out


@pytest.mark.parametrize("leaves", [1, 2, 3, 4, 8, 9, 10, 26, 27])
def test_positions_are_those_of_the_log(leaves):
    for block in (0, 5):
        height = M.height_of(leaves, block, 3)
        builder = M.Builder(height)
        for i in range(leaves):
            builder.append(f"{i:064x}")
        log = builder.close()
        page = M.Page(bytes.fromhex("".join(log)), leaves, block, 3)
        level = [f"{i:064x}" for i in range(leaves)]
        seen = []
        for h in range(height + 1):
            assert [page.node(h, i) for i in range(len(level))] == level
            seen += level
            level = [H(*level[i : i + 3]) for i in range(0, len(level), 3)]
        assert len(log) == len(seen) and page.node(height, 0) == log[-1]


def rows_of():
    rows = [(i * 3 % 101, f"text {i}\nmore" if i % 3 else f"plain {i}", "en" if i % 4 else None, "hot", i) for i in range(70)]
    rows += [(i, None if i % 2 else "", None, f"s{i % 7}", None) for i in range(9)]
    rows += [(None, "no\nid", "de", "hot", 5), (None, "no\nid", "de", None, 5), (3, "one\nid", "en", "hot", 1), (3, "one\nid", "en", "hot", 1), (12, "é" * 300 + "\n", "fr", "", 301), (10**12, "x" * 200_000, "fr", "é", 2), (-4, "\n\n", "fr", "zz", 2)]
    return rows


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_equals_plain_trees(spark, levels):
    """With small pages trees take several rounds; order and partitions of the input do not matter."""
    docs = spark.createDataFrame(rows_of(), "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.repartition(3).withColumns({c: F.lit("clash") for c in ("tree", "at", "node", "block", "all", "leaf", "_n")})
    got = M.manifest_table(docs, levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_table(rows_of()), key=key)


def test_one_source_one_row_and_none(spark):
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    one = [(7, "a\nb", "en", "s", 3)]
    assert [tuple(r) for r in M.manifest_table(spark.createDataFrame(one, ddl)).collect()] == plain_table(one)
    assert M.manifest_table(spark.createDataFrame([], ddl)).count() == 0


def test_log_pages_are_aligned_in_global_postorder(spark):
    """Pages of a source start where the plain postorder of its whole tree has their first leaf."""
    rows = [(i, f"t{i}", "en", "s", i) for i in range(31)]
    rounds, _, sources, root = M.manifest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), levels=1)
    levels = plain_levels([leaf_of(*r) for r in rows])
    assert root == levels[-1][0] == sources.first().subroot.hex() and [p.count() for p in rounds] == [11, 4, 2, 1]
    for p in rounds[0].collect():
        assert p.start == M.position(0, p.block * 3, 31, len(levels) - 1)
        assert p.log.hex()[-64:] == levels[1][p.block]
