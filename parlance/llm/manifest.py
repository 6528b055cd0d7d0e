"""Merkle manifest of a table: a postorder append log, written by aligned builders.

Every row is a leaf; leaves of one source, by doc_id, are the leaves of a tree whose runs of three become
their parent; the subroots of all sources are the leaves of one more tree.  A tree's leaves are cut at
multiples of 3 ** levels, and one builder a piece appends the nodes of its subtree to a page of the log in the order in
which they are completed.  The tops of the pages are the leaves of the next round, until each tree has one page.

Where a node stands follows from sizes alone.  When node ``index`` of ``level`` is completed, every level below holds
the whole nodes under it and before it, and every level above those that ended before it, so its position is a
sum of one term a level (``position``).  Proofs read siblings at these positions: pages of the last round first, and
each page hands its children the path above them; no node is looked for.

Defined cases: null values are leaves' ``-``; a null doc_id comes first in its source and is never
tampered with; rows that repeat an id stand in the order of their leaves; a null source is a tree of its own, first;
a source with one row is its own subroot, one source alone gives the root; an empty table gives no
rows.  Texts of any length are hashed in the scan and do not move; a source of any size is split over
builders; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import arrow_stream, groups_of
from parlance.llm.numbering import numbered
from parlance.plans.scratch import materialise

ARITY = 3
#: Levels of a page: a builder holds ARITY ** LEVELS leaves.
LEVELS = 7
#: The tree over the sources; trees of sources are named by a letter and the source.
TOP = ""


def digest(hexes: str) -> str:
    return sha256(hexes.encode()).hexdigest()


def row_leaf(text=None):
    """H of a row's columns as an expression; ``text`` replaces the column text."""

    def part(c):
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*(part(F.col(c) if c != "text" or text is None else text) for c in ("doc_id", "source", "lang", "n_chars", "text"))), 256)


def width(leaves: int, level: int) -> int:
    """Nodes of a level."""
    return -(-leaves // ARITY**level)


def height_of(leaves: int, block: int, levels: int = LEVELS) -> int:
    """Levels above a page's leaves: a first page that is not full is a whole tree, any other is part of a larger one."""
    if block:
        return levels
    return next(h for h in range(levels + 1) if ARITY**h >= leaves)


def position(level: int, index: int, leaves: int, height: int) -> int:
    """Place of a node in the postorder of a tree (or page) of so many leaves."""
    done = sum(min((index + 1) * ARITY ** (level - m), width(leaves, m)) for m in range(level + 1))
    return done + sum(index // ARITY ** (m - level) for m in range(level + 1, height + 1)) - 1


class Builder:
    """Appends digests to a log as their subtrees are completed."""

    def __init__(self, height: int):
        self.height, self.log, self.waiting = height, [], [[] for _ in range(height + 1)]

    def append(self, node: str, level: int = 0) -> None:
        self.log.append(node)
        if level < self.height:
            run = self.waiting[level]
            run.append(node)
            if len(run) == ARITY:
                self._complete(level)

    def _complete(self, level: int) -> None:
        node = digest("".join(self.waiting[level]))
        self.waiting[level].clear()
        self.append(node, level + 1)

    def close(self) -> list[str]:
        for level in range(self.height):
            if self.waiting[level]:
                self._complete(level)
        return self.log


class Page:
    """Reads siblings out of one page by their positions."""

    def __init__(self, log: bytes, leaves: int, block: int, levels: int = LEVELS):
        self.leaves, self.height = leaves, height_of(leaves, block, levels)
        self.log, self.above = log.hex(), [{} for _ in range(self.height + 1)]

    def node(self, level: int, index: int) -> str:
        at = 64 * position(level, index, self.leaves, self.height)
        return self.log[at : at + 64]

    def beside(self, level: int, index: int) -> tuple[str, str]:
        """The siblings before and after a node, each joined."""
        first = index // ARITY * ARITY
        run = range(first, min(first + ARITY, width(self.leaves, level)))
        return "".join(self.node(level, i) for i in run if i < index), "".join(self.node(level, i) for i in run if i > index)

    def path(self, level: int, index: int) -> tuple[tuple[str, str], ...]:
        """``beside`` of a node and of all nodes over it in this page; parents' paths are read once."""
        if level == self.height:
            return ()
        known = self.above[level + 1]
        over = index // ARITY
        if over not in known:
            known[over] = self.path(level + 1, over)
        return self.beside(level, index), *known[over]


def _pages(rows: DataFrame, ids: bool, levels: int) -> DataFrame:
    """One page of the log for each piece of each tree, written: ``(tree, block, start, leaves, log, top[, ids, forged])``.

    rows: ``(tree, at, node binary[, doc_id, forged])``.  ``start`` is the position of the page's first node in the tree's own log.
    """

    def run(parts):
        for (tree, block), group in groups_of(parts, 2):
            builder = Builder(height_of(len(group), block, levels))
            for _, node, *_ in group:
                builder.append(node.hex())
            log, first = builder.close(), block * ARITY**levels
            out = {"tree": [tree], "block": [block], "start": [sum(first // ARITY**m for m in range(64) if ARITY**m <= first)], "leaves": [len(group)], "log": [bytes.fromhex("".join(log))], "top": [bytes.fromhex(log[-1])]}
            yield out | ({"ids": [[r[2] for r in group]], "forged": [[r[3] for r in group]]} if ids else {})

    more = ["doc_id", "forged"] if ids else []
    dealt = rows.select("tree", F.expr(f"at div {ARITY**levels}").alias("block"), "at", "node", *more).repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
    ddl = "tree string, block long, start long, leaves int, log binary, top binary" + ", ids array<long>, forged array<binary>" * ids
    return materialise(arrow_stream(dealt, ddl, run, "tree", "block", "at", "node", *more))


def _rounds(rows: DataFrame, ids: bool, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The pages of all rounds, and ``(tree, subroot, round)`` for every tree. A round has 1 / 3 ** levels of the rows of the one before."""
    rounds, done = [], None
    while True:
        pages = _pages(rows, ids and not rounds, levels)
        tops, r = pages.select("tree", "block", "top"), len(rounds)
        rounds.append(pages)
        split = tops.where("block > 0").select("tree").distinct()
        whole = tops.join(split, "tree", "left_anti").select("tree", F.col("top").alias("subroot"), F.lit(r).alias("round"))
        done = whole if done is None else done.unionByName(whole)
        if split.isEmpty():
            return rounds, materialise(done)
        rows = tops.join(split, "tree", "left_semi").select("tree", F.col("block").alias("at"), F.col("top").alias("node"))


_PATH = "array<struct<before: string, after: string>>"


def _children(pages: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """``(tree, at, above, subroot)``: for every leaf of the pages, the path over it; ``above`` has the path over each page."""

    def run(parts):
        for b in parts:
            for row in b.to_pylist():
                page, over = Page(row["log"], row["leaves"], row["block"], levels), [(x["before"], x["after"]) for x in row["above"]]
                paths = [[{"before": p, "after": q} for p, q in (*page.path(0, i), *over)] for i in range(row["leaves"])]
                first, n = row["block"] * ARITY**levels, row["leaves"]
                yield {"tree": [row["tree"]] * n, "at": list(range(first, first + n)), "above": paths, "subroot": [row["subroot"]] * n}

    joined = pages.select("tree", "block", "leaves", "log").join(above, ["tree", "block"])
    return arrow_stream(joined, f"tree string, at long, above {_PATH}, subroot string", run, "tree", "block", "leaves", "log", "above", "subroot")


def _descend(rounds: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """The path over each page of the first round; ``tops`` has ``(tree, round, above, subroot)`` for each tree's last page."""
    down = None
    for r in range(len(rounds) - 1, -1, -1):
        above = tops.where(F.col("round") == r).select("tree", F.lit(0).cast("long").alias("block"), "above", "subroot")
        if down is not None:
            above = above.unionByName(down)
        if r == 0:
            return above
        down = _children(rounds[r], above, levels).withColumnRenamed("at", "block")
    raise ValueError("no rounds")


def manifest(docs: DataFrame, leaf=None, forged=None, levels: int = LEVELS) -> tuple[list[DataFrame], list[DataFrame], DataFrame, str | None]:
    """The log of a table: pages of the sources' trees and of the top tree by round, ``(at, tree, subroot, round)`` of the sources in order, and the root.

    leaf, forged: expressions of a row's leaf and of what it is checked with instead (null: the leaf), as hex.
    """
    leaf = row_leaf() if leaf is None else leaf
    rows = docs.select(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf).alias("node"), F.unhex(F.lit(None).cast("string") if forged is None else forged).alias("forged"))
    rounds, done = _rounds(numbered(rows, "tree", ["doc_id", "node"], "at"), True, levels)
    sources = materialise(numbered(done.withColumn("all", F.lit(TOP)), "all", ["tree"], "at").drop("all"))
    tops, root = _rounds(sources.select(F.lit(TOP).alias("tree"), "at", F.col("subroot").alias("node")), False, levels)
    last = root.select(F.lower(F.hex("subroot")).alias("root")).first()
    return rounds, tops, sources, last and last.root


def manifest_table(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The query's columns: every leaf, its proof, and whether what tampering left folds to the root."""
    tampered = F.when((F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n")), row_leaf(F.regexp_replace("text", "\n", "")))
    rounds, tops, sources, root = manifest(docs, forged=tampered, levels=levels)
    start = sources.sparkSession.createDataFrame([(TOP, len(tops) - 1, [], None)], f"tree string, round int, above {_PATH}, subroot string")
    over = _children(tops[0], _descend(tops, start, levels), levels).select("at", "above")
    trees = sources.join(over, "at").select("tree", "round", "above", F.lower(F.hex("subroot")).alias("subroot"))
    above = _descend(rounds, materialise(trees), levels)

    def run(parts):
        for b in parts:
            for row in b.to_pylist():
                page, over = Page(row["log"], row["leaves"], row["block"], levels), [(x["before"], x["after"]) for x in row["above"]]
                shared = {k: "".join(p + q for p, q in (*page.path(1, k), *over)) for k in range(width(row["leaves"], 1))} if page.height else {0: "".join(p + q for p, q in over)}
                out = {"doc_id": row["ids"], "leaf": [], "subroot": [row["subroot"]] * row["leaves"], "root": [root] * row["leaves"], "proof_sha256": [], "folded_root": [], "verified": []}
                for i, forged in enumerate(row["forged"]):
                    leaf, path = page.node(0, i), page.path(0, i)
                    node = forged.hex() if forged else leaf
                    for p, q in (*path, *over):
                        node = digest(p + node + q)
                    out["leaf"].append(leaf)
                    out["proof_sha256"].append(digest(("".join(path[0]) if path else "") + shared[i // ARITY if path else 0]))
                    out["folded_root"].append(node)
                    out["verified"].append(node == root)
                yield out

    pages = rounds[0].select("tree", "block", "leaves", "log", "ids", "forged").join(above, ["tree", "block"])
    ddl = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return arrow_stream(pages, ddl, run, "tree", "block", "leaves", "log", "ids", "forged", "above", "subroot")


#: The same by recursion over levels; ``b`` are a tree's sources and rows in one numbering, ``steps`` the siblings on the way up.
SQL = """
WITH RECURSIVE
enc AS (SELECT doc_id, source, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM documents),
crc AS (SELECT doc_id, list_reduce(list_concat([4294967295::BIGINT], list_transform(list_filter(regexp_split_to_array(CAST(doc_id AS VARCHAR), ''), lambda x: x <> ''), lambda x: ascii(x)::BIGINT)),
        lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)) AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
leafs AS (SELECT e.doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN xor(c, 4294967295) % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS forged FROM enc e LEFT JOIN crc USING (doc_id)),
rows0 AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS ix FROM leafs),
lv AS (
  SELECT tree, 0 AS level, ix, leaf AS d, count(*) OVER (PARTITION BY tree) AS n FROM rows0
  UNION ALL
  SELECT tree, level, ix, d, count(*) OVER (PARTITION BY tree) FROM (SELECT tree, level + 1 AS level, ix // 3 AS ix, sha256(string_agg(d, '' ORDER BY ix)) AS d FROM lv WHERE n > 1 GROUP BY tree, level, ix // 3) x),
tp AS (
  SELECT 0 AS level, tree AS ix, d, count(*) OVER () AS n FROM lv WHERE n = 1
  UNION ALL
  SELECT level, ix, d, count(*) OVER () FROM (SELECT level + 1 AS level, ix // 3 AS ix, sha256(string_agg(d, '' ORDER BY ix)) AS d FROM tp WHERE n > 1 GROUP BY level, ix // 3) x),
up AS (
  SELECT tree, ix AS leaf_at, 0 AS level, ix FROM rows0
  UNION ALL
  SELECT u.tree, leaf_at, u.level + 1, u.ix // 3 FROM up u WHERE EXISTS (SELECT 1 FROM lv WHERE lv.tree = u.tree AND lv.level = u.level AND lv.n > 1)),
ov AS (
  SELECT ix AS tree, 0 AS level, ix FROM tp WHERE level = 0
  UNION ALL
  SELECT o.tree, o.level + 1, o.ix // 3 FROM ov o WHERE EXISTS (SELECT 1 FROM tp WHERE tp.level = o.level AND tp.n > 1)),
steps AS (
  SELECT u.tree, leaf_at, u.level AS k, coalesce(string_agg(s.d, '' ORDER BY s.ix) FILTER (WHERE s.ix < u.ix), '') AS l, coalesce(string_agg(s.d, '' ORDER BY s.ix) FILTER (WHERE s.ix > u.ix), '') AS r
  FROM up u JOIN lv s ON s.tree = u.tree AND s.level = u.level AND s.ix // 3 = u.ix // 3 AND s.n > 1 GROUP BY u.tree, leaf_at, u.level, u.ix
  UNION ALL
  SELECT p.tree, p.ix, 1000 + o.level, o.l, o.r FROM rows0 p JOIN (
    SELECT o.tree, o.level, coalesce(string_agg(s.d, '' ORDER BY s.ix) FILTER (WHERE s.ix < o.ix), '') AS l, coalesce(string_agg(s.d, '' ORDER BY s.ix) FILTER (WHERE s.ix > o.ix), '') AS r
    FROM ov o JOIN tp s ON s.level = o.level AND s.ix // 3 = o.ix // 3 AND s.n > 1 GROUP BY o.tree, o.level, o.ix) o USING (tree)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tree, leaf_at ORDER BY k) - 1 AS i FROM steps),
fold AS (
  SELECT tree, ix AS leaf_at, 0::BIGINT AS i, coalesce(forged, leaf) AS d FROM rows0
  UNION ALL
  SELECT f.tree, f.leaf_at, f.i + 1, sha256(l || d || r) FROM fold f JOIN numbered s ON s.tree = f.tree AND s.leaf_at = f.leaf_at AND s.i = f.i),
folded AS (SELECT tree, leaf_at, arg_max(d, i) AS d FROM fold GROUP BY tree, leaf_at),
proofs AS (SELECT tree, leaf_at, sha256(string_agg(l || r, '' ORDER BY i)) AS proof FROM numbered GROUP BY tree, leaf_at)
SELECT p.doc_id, p.leaf, t.d AS subroot, root.d AS root, coalesce(proof, sha256('')) AS proof_sha256, f.d AS folded_root, f.d = root.d AS verified
FROM rows0 p JOIN lv t ON t.tree = p.tree AND t.n = 1 JOIN folded f ON f.tree = p.tree AND f.leaf_at = p.ix
LEFT JOIN proofs q ON q.tree = p.tree AND q.leaf_at = p.ix, (SELECT d FROM tp WHERE n = 1) root
"""
