"""Near-duplicates by a chosen-path set similarity join.

Every document is a set of word shingles.  TREES independent trees branch the documents by
their minwise tokens: a node's documents go, level by level, to the child of the token that
is smallest under that level's hash.  A node that is small enough is compared exhaustively;
a node that is still large after LEVELS tokens is compared exhaustively too, in blocks.
Two sets of similarity J meet in a leaf of one tree with a probability of at least J^LEVELS,
and in some tree with 1 - (1 - J^LEVELS)^TREES: 0.999 at J = 0.85 at the deepest level, more
where leaves are reached earlier.

Equal sets are one node.  A first round links each leaf's documents to its pivot only, so
that large groups of copies become one component with few comparisons; the exhaustive round
then compares documents of different components.  Sketches rule pairs out (4.5 standard
deviations below the limit), full sets confirm every link.

Defined cases: null texts and texts without words have an empty set and are linked with
nothing; texts of fewer words than a shingle are one shingle; rows with one id are one
document (each of its texts is compared, and the components that hold one of them are one); a row without an id takes the component of an equal set, else none, and is kept;
repeated rows give repeated results; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import arrow_map, arrow_stream, groups_of
from parlance.llm.numbering import numbered
from parlance.plans.closure import connected_components
from parlance.plans.scratch import materialise

SHINGLE, PERCENT = 5, 85
TREES, LEVELS, NODE_LIMIT = 16, 6, 48
SLOTS = TREES * LEVELS
#: Rows of ids up to which their documents are found by a broadcast.
BROADCAST_IDS = 1_000_000
#: Words that a partition keeps with their hashes, and the longest of them in bytes.
CACHE_WORDS, CACHED_LENGTH = 50_000, 40

_rng = np.random.default_rng(85)
_A = _rng.integers(1, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, k: int = SHINGLE, seen: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; ``seen``: a cache of words that the caller owns."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    seen = {} if seen is None else seen
    get, known = seen.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = xxhash.xxh3_64_intdigest(w)
            if len(w) <= CACHED_LENGTH:
                if len(seen) >= CACHE_WORDS:
                    seen.clear()
                seen[w] = h
        known.append(h)
    h = np.array(known, np.uint64)
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        out = out + h[i : len(h) - n + 1 + i] * _PLACE[i]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The smallest 32-bit value of a set under each of SLOTS hash functions."""
    best = np.full(SLOTS, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 2048):
        best = np.minimum(best, ((shingles[i : i + 2048] * _A[:, None] + _B[:, None]) >> np.uint64(32)).min(1))
    return best.astype(np.uint32)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _may_be(n: np.ndarray, sketch: np.ndarray, n_other, sketch_other, percent: int) -> np.ndarray:
    """Which of many are not ruled out against one (or one each) by size and sketch."""
    j = percent / 100
    least = j - 4.5 * math.sqrt(j * (1 - j) / SLOTS)
    same = (sketch == sketch_other).mean(-1)
    return ((same - 1 / 256) / (1 - 1 / 256) >= least) & (100 * np.minimum(n, n_other) >= percent * np.maximum(n, n_other))


def signatures(docs: DataFrame) -> DataFrame:
    """``(doc_id, n, set_id, mins, sketch)`` of each row; set_id is null for the empty set."""

    def run(parts):
        seen: dict[bytes, int] = {}
        for b in parts:
            out = {"doc_id": b.column(0)} | {k: [] for k in ("n", "set_id", "mins", "sketch")}
            for t in b.column(1).to_pylist():
                s = shingle_set(t, seen=seen)
                m = minwise(s)
                out["n"].append(len(s))
                out["set_id"].append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                out["mins"].append(m.view(np.int32))
                out["sketch"].append((m & np.uint32(255)).astype(np.uint8).tobytes())
            yield out

    return arrow_stream(docs, "doc_id long, n long, set_id string, mins array<int>, sketch binary", run, F.col("doc_id").cast("long").alias("doc_id"), "text")


def leaves_of(sets: DataFrame) -> DataFrame:
    """``(tree, path, lead, pivot, size)``: the leaves of all trees that hold two sets or more; sets: ``(lead, mins)``."""
    trees = F.array(*(F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.get("mins", F.lit(t * LEVELS))).alias("path"), F.slice("mins", t * LEVELS + 2, LEVELS - 1).alias("rest")) for t in range(TREES)))
    rows = sets.select("lead", F.explode(trees).alias("t")).select("t.tree", "t.path", "lead", "t.rest")
    done = []
    for level in range(LEVELS):
        # the sizes are written first, so that a path with many rows can be split in the join
        size = materialise(rows.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("lead").alias("pivot")).where("size > 1"))
        node = materialise(rows.join(size, "path"))
        large = F.col("size") > NODE_LIMIT
        last = level == LEVELS - 1 or node.where(large).isEmpty()
        done.append((node if last else node.where(~large)).select("tree", "path", "lead", "pivot", "size"))
        if last:
            break
        rows = node.where(large).select("tree", F.xxhash64("path", F.get("rest", F.lit(level))).alias("path"), "lead", "rest")
    return reduce(DataFrame.unionByName, done)


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, s)``: the shingle set of each wanted document; few ids are sent to the documents, many are joined by a shuffle."""
    ids = materialise(ids.distinct())
    few = ids.count() <= BROADCAST_IDS
    needed = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def run(parts):
        seen: dict[bytes, int] = {}
        for b in parts:
            yield {"id": b.column(0), "s": [shingle_set(t, seen=seen).tobytes() for t in b.column(1).to_pylist()]}

    return materialise(arrow_stream(needed, "id long, s binary", run, "id", "text").dropDuplicates(["id"]))


def confirm(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar."""
    pairs = materialise(pairs)
    sets = full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))

    def check(c):
        ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(c["sa"], c["sb"], strict=True)]
        return {"a": [x for x, k in zip(c["a"], ok, strict=True) if k], "b": [x for x, k in zip(c["b"], ok, strict=True) if k]}

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return materialise(arrow_map(both, "a long, b long", check, "a", "b", "sa", "sb"))


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a few sets, by products of 0/1 matrices over slices of their shingles."""
    out = np.zeros((len(sets), len(sets)))
    shingles, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    for i in range(0, len(shingles), 16_384):
        a, b = np.searchsorted(at, (i, i + 16_384))
        m = np.zeros((len(sets), min(16_384, len(shingles) - i)), np.float32)
        m[row[a:b], at[a:b] - i] = 1
        out += m @ m.T
    return out


def pivot_links(leaves: DataFrame, sets: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Confirmed links of documents to the likeliest pivot of their leaves: one candidate each."""
    pairs = leaves.where("lead != pivot").select("lead", "pivot").distinct()
    s = sets.select("lead", "n", "sketch")
    p = pairs.join(s, "lead").join(s.toDF("pivot", "pivot_n", "pivot_sketch"), "pivot")

    def rank(c):
        a, b = (np.frombuffer(b"".join(c[k]), np.uint8).reshape(-1, SLOTS) for k in ("sketch", "pivot_sketch"))
        ok = _may_be(np.array(c["n"]), a, np.array(c["pivot_n"]), b, percent).tolist()
        near = (a == b).sum(1).tolist()
        return {k: [x for x, y in zip(v, ok, strict=True) if y] for k, v in (("a", c["lead"]), ("b", c["pivot"]), ("near", near))}

    likely = arrow_map(p, "a long, b long, near int", rank, "lead", "pivot", "n", "sketch", "pivot_n", "pivot_sketch")
    best = likely.groupBy("a").agg(F.max(F.struct("near", (-F.col("b")).alias("b"))).alias("m")).select("a", (-F.col("m.b")).alias("b"))
    return confirm(best, docs, percent)


def _pairs_to_compare(part: np.ndarray, leaf: np.ndarray, block: np.ndarray, is_main: np.ndarray, i: int, j: int, tree: int) -> np.ndarray:
    """Which pairs of a group are this group's to compare: of two components, over its two blocks, and in no leaf of an earlier tree."""
    wanted = part[:, None] != part[None, :]
    if i >= 0:
        wanted &= is_main[:, None] != is_main[None, :]
    elif -i - 1 != j:
        wanted &= block[:, None] != block[None, :]
    for t in range(tree):
        wanted &= leaf[:, None, t] != leaf[None, :, t]
    return np.triu(wanted, 1)


def cross_links(leaves: DataFrame, parts: DataFrame, sets: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Confirmed links between documents of one leaf but different components.

    A leaf's largest component is cut into blocks of NODE_LIMIT, and so are its other
    documents; every two blocks that hold pairs to compare meet in one group.  Members
    without a likely partner leave the group; the full sets of the others are compared, and
    a group gives a spanning forest of the links that it finds.
    """
    rows = leaves.join(parts.select(F.col("node").alias("lead"), "component"), "lead", "left").withColumn("part", F.coalesce("component", "lead"))
    count = rows.groupBy("path", "part").agg(F.count(F.lit(1)).alias("n"))
    main = count.groupBy("path").agg(F.max(F.struct("n", "part")).alias("m"), F.sum("n").alias("size")).where("size > m.n").select("path", F.col("m.part").alias("main"), F.ceil(F.col("m.n") / NODE_LIMIT).cast("int").alias("mains"), F.ceil((F.col("size") - F.col("m.n")) / NODE_LIMIT).cast("int").alias("others"))
    rows = materialise(rows.select("tree", "path", "lead", "part").join(main, "path"))
    own = rows.groupBy("lead").agg(F.map_from_entries(F.collect_list(F.struct("tree", "path"))).alias("m"))
    own = own.select("lead", F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.coalesce(F.try_element_at("m", t), F.xxhash64("lead", t))).alias("leaf"))
    rows = rows.join(sets.select("lead", "n", "sketch").join(own, "lead"), "lead")
    is_main = F.col("part") == F.col("main")
    block = F.pmod(F.xxhash64("lead", "path"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    # groups: (block of the main component, block of others), or (-1 - block, block) of others
    first = F.sequence(F.lit(0), F.col("mains") - 1)
    second = F.sequence(F.lit(0), F.col("others") - 1)
    groups = F.when(is_main, F.transform(second, lambda j: F.struct(block.alias("i"), j.alias("j")))).otherwise(F.concat(F.transform(first, lambda i: F.struct(i.alias("i"), block.alias("j"))), F.transform(second, lambda j: F.struct((-F.least(j, block) - 1).alias("i"), F.greatest(j, block).alias("j")))))
    group, own = ("tree", "path", "i", "j"), ("lead", "part", "leaf", "block", "is_main")
    dealt = rows.select("tree", "path", "lead", "part", "n", "sketch", "leaf", block.alias("block"), is_main.alias("is_main"), F.explode(groups).alias("g")).select("tree", "path", "g.i", "g.j", *own, "n", "sketch")

    def likely(parts):
        out: dict[str, list] = {k: [] for k in group + own}
        for key, members in groups_of(parts, 4):
            if len(members) > 1:
                lead, part, leaf, block, is_main, n, sketch = zip(*members, strict=True)
                x, y = np.nonzero(_pairs_to_compare(*map(np.array, (part, leaf, block, is_main)), key[2], key[3], key[0]))
                if len(x):
                    n, sketch = np.array(n), np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, SLOTS)
                    ok = _may_be(n[x], sketch[x], n[y], sketch[y], percent)
                    for k in np.union1d(x[ok], y[ok]):
                        for name, v in zip(out, (*key, *members[k][:5]), strict=True):
                            out[name].append(v)
            if len(out["lead"]) >= 2_048:
                yield out
                out = {k: [] for k in out}
        yield out

    met = dealt.repartition(*group).sortWithinPartitions(*group)
    ddl = "tree int, path long, i int, j int, lead long, part long, leaf array<long>, block int, is_main boolean"
    found = materialise(arrow_stream(met, ddl, likely, *group, *own, "n", "sketch"))
    known = full_sets(docs, found.select(F.col("lead").alias("id")))
    again = found.join(known.withColumnRenamed("id", "lead"), "lead").repartition(*group).sortWithinPartitions(*group)

    def link(parts):
        out: dict[str, list] = {"a": [], "b": []}
        for (tree, _, i, j), members in groups_of(parts, 4):
            if len(members) < 2:
                continue
            lead, part, leaf, block, is_main, s = zip(*members, strict=True)
            s = [np.frombuffer(x, np.uint64) for x in s]
            both, n = common_counts(s), np.array([len(x) for x in s])
            ok = _pairs_to_compare(*map(np.array, (part, leaf, block, is_main)), i, j, tree) & (100 * both >= percent * (n[:, None] + n[None, :] - both))
            root = {p: p for p in part}

            def top(p, root=root):
                while root[p] != p:
                    p = root[p]
                return p

            for x, y in zip(*np.nonzero(ok), strict=True):
                a, b = top(part[x]), top(part[y])
                if a != b:
                    root[a] = b
                    out["a"].append(lead[x])
                    out["b"].append(lead[y])
        yield out

    return materialise(arrow_stream(again, "a long, b long", link, *group, *own, "s").distinct())


def near_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row."""
    sig = materialise(signatures(docs.select("doc_id", "text")))
    texts = F.coalesce("set_id", F.lit(""))
    if not sig.where("doc_id is not null").groupBy("doc_id").agg((F.min(texts) != F.max(texts)).alias("clash")).where("clash").isEmpty():
        return _components_of_clashing(docs, percent)
    lead = sig.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("lead"))
    lead = materialise(lead)
    sets = materialise(sig.join(lead, "set_id").where("doc_id = lead").select("lead", "n", "mins", "sketch").dropDuplicates(["lead"]))
    leaves = materialise(leaves_of(sets))
    links = pivot_links(leaves, sets, docs, percent)
    links = links.unionByName(cross_links(leaves, connected_components(links, "a", "b"), sets, docs, percent))
    parts = connected_components(links, "a", "b")
    named = lead.join(parts, F.col("lead") == F.col("node"), "left").select("set_id", F.coalesce("component", "lead").alias("component_id"))
    out = sig.select("doc_id", F.col("n").alias("n_shingles"), "set_id").join(named, "set_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _components_of_clashing(docs: DataFrame, percent: int) -> DataFrame:
    """near_components where ids have several texts: each text of an id is a node, and the components that hold a text of one id are one."""
    text = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    nodes = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), *text).distinct().withColumn("all", F.lit(0))
    nodes = materialise(numbered(nodes, "all", ["id", "h1", "h2"], "node").drop("all"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text", *text).join(nodes, ["id", "h1", "h2"], "left")
    found = materialise(near_components(materialise(rows.select(F.col("node").alias("doc_id"), "text")), percent))
    parts = found.where("doc_id is not null").select(F.col("doc_id").alias("node"), F.col("component_id").alias("part")).distinct().join(nodes, "node")
    same = parts.groupBy("id").agg(F.min("part").alias("low"))
    joined = connected_components(parts.join(same, "id").where("part != low").select("part", "low"), "part", "low").toDF("part", "root")
    # nodes ascend with their ids, so the least node of a component has the least id
    ids = nodes.select(F.col("node").alias("root"), F.col("id").alias("component_id"))
    of = joined.join(ids, "root").select("part", F.col("component_id").alias("by_id"))
    out = found.withColumnsRenamed({"doc_id": "node", "component_id": "part"}).drop("kept").join(nodes.select("node", "id"), "node", "left")
    own = nodes.select(F.col("node").alias("part"), F.col("id").alias("own_id"))
    out = out.join(of, "part", "left").join(own, "part", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("by_id", "own_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id; rows without an id stay."""
    gone = near_components(docs, percent).where("not kept").select(F.col("doc_id").alias("gone"))
    return docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(5, len(w)) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(s, '|' ORDER BY s)) AS h FROM s GROUP BY doc_id),
lead AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS lead FROM sets),
r AS (SELECT s.* FROM s JOIN lead USING (doc_id) WHERE doc_id = lead),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM r a JOIN r b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
c(node, low) AS (SELECT doc_id, doc_id FROM lead WHERE doc_id = lead UNION SELECT e.b, c.low FROM c JOIN e ON e.a = c.node WHERE c.low < e.b),
m AS (SELECT node, min(low) AS low FROM c GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.low, w.doc_id) AS component_id, coalesce(m.low, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN lead USING (doc_id) LEFT JOIN m ON m.node = lead.lead
"""
