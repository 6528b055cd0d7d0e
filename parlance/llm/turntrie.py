"""Prefix trie of conversations, packed into double arrays shard by shard.

1. *Turns.* A turn is the digest of its role and text; texts do not move beyond the scan.  Rows are numbered in their
   conversation's order over range partitions, so a conversation of any length is split.  Rebuilt
   conversations take up to HEAD_TURNS - 1 turns of the first conversation of their hundred.
2. *Blocks.* A rebuilt conversation is cut into blocks of BLOCK turns.  A block's *prefix shard* is named by a
   fingerprint of all turns before it: four sums of hashes of (turn, depth), which add up over blocks.  Equal
   blocks of a shard are counted as one row, so copies of a conversation cost one row from here on.
3. *Tries.* Distinct blocks are range-partitioned and sorted by shard and turns.  A partition packs each run of them (a shard, or
   CHUNK_TURNS turns of one) into BASE and CHECK arrays over dense ids of its turns, and traverses the
   arrays for the nodes, their members and what lies under them.
4. *Merging.* Sorted runs share only nodes on the paths of their first and last blocks.  Those upper nodes leave a task
   as parts, which are merged by their fingerprints: members are added, and what lies under a node is summed
   over the shared nodes below it.
5. *Layers.* A block followed by others takes what lies under its end from the shards below, so layers
   with such blocks are packed from the deepest up.  What a single conversation goes on with alone
   is known (one leaf, nothing saved), so there are rounds only for *shared* prefixes of more than BLOCK turns.

Defined cases: rows without a conv_id are left out (a node is named by a member); null roles and texts are
empty; a null turn comes first, rows of one turn are ordered by role (null first) and then by digest; a rebuilt
conversation without turns is a member of the root only; repeated rows are turns of their own; one conversation alone is a chain;
an empty table gives no rows; other columns are ignored.  The ids that end at one node are hashed as they
stream by in order: one task a node, without holding them.
"""

from __future__ import annotations

from array import array
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.common import arrow_stream
from parlance.llm.numbering import numbered
from parlance.plans.scratch import materialise

#: The remainder that fixes how many turns are taken from the first conversation of a hundred.
HEAD_TURNS, HUNDRED = 6, 100
#: Turns of a block, and of the blocks that one trie holds at most (or one block).
BLOCK, CHUNK_TURNS = 64, 100_000
#: Free slots that are tried for a node's children before they go to the end of the arrays.
TRIES = 64
#: A table of upper nodes with more rows is joined by a shuffle.
BROADCAST_NODES = 100_000
WORDS = ("a", "b", "c", "d")


class DoubleArray:
    """A trie over dense labels: the child of state s by label c is slot BASE[s] + c, if CHECK there is s. The root is slot 0."""

    def __init__(self):
        self.base, self.check, self._free = array("q", [0]), array("q", [0]), 1

    def _extend(self, size: int) -> None:
        more = size - len(self.check)
        if more > 0:
            self.base.extend([0] * more)
            self.check.extend([-1] * more)

    def put(self, state: int, labels: list[int]) -> list[int]:
        """Give ``state`` its children, all at once; their slots, in the order of ``labels`` (ascending)."""
        check, size = self.check, len(self.check)
        while self._free < size and check[self._free] >= 0:
            self._free += 1
        low, base = labels[0], size - labels[0]
        for at in range(self._free, min(self._free + TRIES, size)):
            if all(at - low + c >= size or check[at - low + c] < 0 for c in labels):
                base = at - low
                break
        self._extend(base + labels[-1] + 1)
        self.base[state] = base
        slots = [base + c for c in labels]
        for t in slots:
            check[t] = state
        return slots

    def child(self, state: int, label: int) -> int:
        """The child's slot, or -1."""
        t = self.base[state] + label
        return t if 0 < t < len(self.check) and self.check[t] == state else -1


def pack(sequences: list[list[int]]) -> tuple[DoubleArray, list[int]]:
    """The arrays of sorted sequences (equal prefixes side by side), and all slots with parents before children."""
    trie, made, todo = DoubleArray(), [0], [(0, 0, len(sequences), 0)]
    while todo:
        state, lo, hi, depth = todo.pop()
        while lo < hi and len(sequences[lo]) == depth:
            lo += 1
        runs, i = [], lo
        while i < hi:
            label, first = sequences[i][depth], i
            while i < hi and sequences[i][depth] == label:
                i += 1
            runs.append((label, first, i))
        if runs:
            runs.sort()
            for slot, (_, first, last) in zip(trie.put(state, [r[0] for r in runs]), runs, strict=True):
                made.append(slot)
                todo.append((slot, first, last, depth + 1))
    return trie, made


class Chunk:
    """Sorted blocks of one shard, or a run of them."""

    def __init__(self, shard: str, depth: int, cut_before: bool):
        self.shard, self.depth, self.cut_before = shard, depth, cut_before
        self.dense, self.chars, self.sequences, self.hashes, self.rows, self.turns = {}, [], [], [], [], 0

    def add(self, keys: list[bytes], chars: list[int], h1: list[int], h2: list[int], row: tuple) -> None:
        """row: members, smallest member, members that go on below, and the leaves, savings and children there."""
        ids = []
        for k, n in zip(keys, chars, strict=True):
            i = self.dense.get(k)
            if i is None:
                i = self.dense[k] = len(self.chars)
                self.chars.append(n)
            ids.append(i)
        self.sequences.append(ids)
        self.hashes.append((array("q", h1), array("q", h2)))
        self.rows.append(row)
        self.turns += len(ids)

    def nodes(self, cut_after: bool) -> dict[str, list]:
        """A row a node: whole, or a part of an upper node that other runs may share."""
        trie, made = pack(self.sequences)
        size = len(trie.check)
        n, lo, under_leaves, under_saved, children, goes_on = ([0] * size for _ in range(6))
        chars, sums, upper = [0] * size, {0: tuple(map(int, self.shard.split(":")))}, {0}
        last = len(self.sequences) - 1
        for k, (ids, (h1, h2), row) in enumerate(zip(self.sequences, self.hashes, self.rows, strict=True)):
            members, least, below, *totals = row
            shared = k == 0 and self.cut_before or k == last and cut_after
            s = 0
            for d in range(-1, len(ids)):
                if d >= 0:
                    t = trie.child(s, ids[d])
                    if t not in sums:
                        a, b, c, e = sums[s]
                        x, y = h1[d], h2[d]
                        sums[t] = (a + (x & 0xFFFFFFFF), b + (x >> 32 & 0xFFFFFFFF), c + (y & 0xFFFFFFFF), e + (y >> 32 & 0xFFFFFFFF))
                        chars[t] = self.chars[ids[d]]
                    s = t
                lo[s] = least if n[s] == 0 else min(lo[s], least)
                n[s] += members
                if shared:
                    upper.add(s)
            if below:
                under_leaves[s] += totals[0]
                under_saved[s] += totals[1]
                children[s] += totals[2]
                goes_on[s] = 1
        key = {s: ":".join(map(str, x)) for s, x in sums.items()}
        key[0] = "^" + self.shard
        depth = {0: self.depth}
        for s in made[1:]:
            depth[s] = depth[trie.check[s]] + 1
        for s in reversed(made[1:]):
            p = trie.check[s]
            goes_on[p] = 1
            if s not in upper:
                under_leaves[s] += not goes_on[s]
                under_saved[s] += (n[s] - 1) * chars[s]
                under_leaves[p] += under_leaves[s]
                under_saved[p] += under_saved[s]
                children[p] += 1
        out = {c: [] for c in NODE_COLUMNS}
        for s in made:
            p = trie.check[s]
            over = []
            if s in upper and s:
                q = p
                while q:
                    over.append(key[q])
                    q = trie.check[q]
                over.append(key[0])
            row = (key[s], key[p] if s else None, depth[s], n[s], lo[s], None if not s or p in upper else lo[p], children[s], under_leaves[s], under_saved[s], goes_on[s], chars[s], s in upper, over)
            for c, v in zip(NODE_COLUMNS, row, strict=True):
                out[c].append(v)
        return out


NODE_DDL = "key string, parent string, depth long, n_convs long, conv_id long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long, goes_on int, chars long, upper boolean, over array<string>"
NODE_COLUMNS = [c.split()[0] for c in NODE_DDL.replace("array<string>", "array").split(", ")]


def _names(prefix: str) -> list[str]:
    return [f"{prefix}{w}" for w in WORDS]


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, depth, key, chars, total)`` for every turn of every rebuilt conversation, and ``(conv_id, total)`` of those without turns."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key"), F.length(text).cast("long").alias("chars"))
    turns = materialise(numbered(turns, "conv_id", ["turn", "role", "key"], "place").drop("turn", "role"))
    heads = turns.where((F.col("conv_id") % HUNDRED == 0) & (F.col("place") < HEAD_TURNS - 1)).groupBy(F.col("conv_id").alias("first")).agg(F.array_sort(F.collect_list(F.struct("place", "key", "chars"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % HEAD_TURNS, "first": F.col("conv_id") - F.col("conv_id") % HUNDRED})
    convs = convs.join(heads, "first", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<place: long, key: binary, chars: long>>")), F.lit(1), F.col("h").cast("int")))
    convs = convs.withColumn("taken", F.size("head").cast("long")).withColumn("total", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = materialise(convs.select("conv_id", "h", "head", "taken", "total"))
    own = turns.join(convs.drop("head"), "conv_id").where("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "key", "chars", "total")
    taken = convs.select("conv_id", "total", F.inline("head")).select("conv_id", (F.col("place") + 1).alias("depth"), "key", "chars", "total")
    return own.unionByName(taken), convs.where("total = 0").select("conv_id", "total")


def conversation_blocks(turns: DataFrame, turnless: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(conv_id, layer, shard, end, turns, last)``: fingerprints of all turns before a block, and up to its end."""
    h = turns.withColumns({"layer": F.expr(f"(depth - 1) div {block}"), "h1": F.xxhash64("key", "depth"), "h2": F.xxhash64(F.lit(7), "depth", "key")})
    half = F.lit(0xFFFFFFFF)
    parts = (F.col("h1").bitwiseAND(half), F.shiftrightunsigned("h1", 32), F.col("h2").bitwiseAND(half), F.shiftrightunsigned("h2", 32))
    blocks = h.groupBy("conv_id", "layer").agg(F.array_sort(F.collect_list(F.struct("depth", "key", "chars", "h1", "h2"))).alias("turns"), F.first("total").alias("total"), *(F.sum(x).alias(w) for x, w in zip(parts, WORDS, strict=True)))
    before = Window.partitionBy("conv_id").orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({f"p{w}": F.coalesce(F.sum(w).over(before), F.lit(0)) for w in WORDS})
    blocks = blocks.select("conv_id", "layer", F.concat_ws(":", *_names("p")).alias("shard"), F.concat_ws(":", *(F.col(f"p{w}") + F.col(w) for w in WORDS)).alias("end"), "turns", (F.col("layer") == F.expr(f"(total - 1) div {block}")).alias("last"))
    zero = F.lit(":".join("0" * len(WORDS)))
    none = turnless.select("conv_id", F.lit(0).cast("long").alias("layer"), zero.alias("shard"), zero.alias("end"), F.array().cast(blocks.schema["turns"].dataType).alias("turns"), F.lit(True).alias("last"))
    return blocks.unionByName(none)


def _tries(blocks: DataFrame, block: int, chunk_turns: int) -> DataFrame:
    """NODE_DDL rows of the tries of distinct blocks, with the leaves, savings and children that lie under blocks that go on."""

    def run(parts):
        chunk = None
        for b in parts:
            cols = [b.column(i).to_pylist() for i in range(8)]
            turns = b.column(8)
            offsets, flat = turns.offsets.to_pylist(), turns.values
            keys, chars, h1, h2 = (flat.field(f).to_pylist() for f in ("key", "chars", "h1", "h2"))
            for i, (layer, shard, *row) in enumerate(zip(*cols, strict=True)):
                x, y = offsets[i], offsets[i + 1]
                if chunk is not None:
                    same = (chunk.depth, chunk.shard) == (layer * block, shard)
                    if not same or chunk.turns + y - x > chunk_turns:
                        yield chunk.nodes(same)
                        chunk = Chunk(shard, layer * block, same)
                else:
                    chunk = Chunk(shard, layer * block, True)
                chunk.add(keys[x:y], chars[x:y], h1[x:y], h2[x:y], (row[0], row[1], row[2], *(v or 0 for v in row[3:])))
        if chunk is not None:
            yield chunk.nodes(True)

    order = ["layer", "shard", F.transform("turns", lambda t: t["key"])]
    dealt = blocks.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(arrow_stream(dealt, NODE_DDL, run, "layer", "shard", "n", "least", "below", "leaves", "saved", "kids", "turns"))


def _merged(parts: DataFrame) -> DataFrame:
    """Upper nodes whole: parts added up, and what lies under each summed over the upper nodes below it; written."""
    up = parts.where("upper").groupBy("key").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("goes_on").alias("goes_on"), F.first("chars").alias("chars"), F.first("over").alias("over"))
    up = materialise(up)
    given = up.select(F.explode(F.concat(F.array("key"), "over")).alias("key"), (F.col("n_leaves") + 1 - F.col("goes_on")).alias("l"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).alias("s"))
    sums = given.groupBy("key").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    kids = up.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("kids"))
    out = up.drop("n_leaves", "saved_tokens").join(sums, "key").join(kids, "key", "left")
    return materialise(out.withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).drop("kids", "over", "goes_on", "chars"))


def _pass(blocks: DataFrame, tops: DataFrame, *sizes: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of some layers, whose shards hang from ``tops``, and ``(shard, leaves, saved, kids)`` for what lies under each shard's prefix."""
    parts = _tries(blocks, *sizes)
    up = _merged(parts)
    names = up.where("parent is not null or depth = 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("named")).unionByName(tops)
    small = names.count() <= BROADCAST_NODES
    columns = ["key", "parent", "depth", "n_convs", "conv_id", "parent_conv_id", "n_children", "n_leaves", "saved_tokens"]
    nodes = parts.where("not upper").select(*columns).unionByName(up.where("parent is not null or depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns))
    nodes = nodes.join(F.broadcast(names) if small else names, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "named")).drop("named", "parent")
    totals = up.where("parent is null and depth > 0").select(F.substring("key", 2, 1 << 20).alias("shard"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.col("n_children").alias("kids"))
    return nodes, totals


def trie_nodes(blocks: DataFrame, *sizes: int) -> DataFrame:
    """All nodes, keyed by the fingerprints of their prefixes; ``blocks`` as given by conversation_blocks, written."""
    distinct = blocks.groupBy("layer", "shard", "end").agg(F.first("turns").alias("turns"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.sum((~F.col("last")).cast("long")).alias("below"))
    distinct = materialise(distinct)
    tops = distinct.where("below > 0").select(F.concat(F.lit("^"), "end").alias("parent"), F.col("least").alias("named"))  # with those that end there
    alone = F.when(F.col("below") == 1, 1)
    known = lambda df: df.withColumns({"leaves": alone.cast("long"), "saved": (alone - 1).cast("long"), "kids": alone.cast("long")})
    deepest = distinct.where("below > 1").agg(F.max("layer")).first()[0]
    if deepest is None:
        return _pass(known(distinct), tops, *sizes)[0]
    found, totals = _pass(known(distinct.where(F.col("layer") > deepest)), tops, *sizes)
    for layer in range(deepest, -1, -1):
        here, below = known(distinct.where(F.col("layer") == layer)), totals.toDF("end", "l", "s", "k")
        here = here.join(below, "end", "left").withColumns({c: F.when(F.col("below") > 0, F.coalesce(c, d)) for c, d in (("leaves", "l"), ("saved", "s"), ("kids", "k"))}).drop("l", "s", "k")
        nodes, totals = _pass(here, tops, *sizes)
        found = found.unionByName(nodes)
    return found


def end_hashes(blocks: DataFrame) -> DataFrame:
    """``(key, ends_sha256)``: the digest of the ids of the conversations that end at a node, streamed in order."""

    def run(parts):
        key, state = None, None
        for b in parts:
            done = {"key": [], "ends_sha256": []}
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key:
                    if state is not None:
                        done["key"].append(key)
                        done["ends_sha256"].append(state.hexdigest())
                    key, state = k, sha256(str(c).encode())
                else:
                    state.update(b",%d" % c)
            yield done
        if state is not None:
            yield {"key": [key], "ends_sha256": [state.hexdigest()]}

    ends = blocks.where("last").select(F.col("end").alias("key"), "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    return arrow_stream(ends, "key string, ends_sha256 string", run, "key", "conv_id")


def prefix_trie(conversations: DataFrame, block: int = BLOCK, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """The query's columns: a row per node of the trie of rebuilt conversations."""
    blocks = materialise(conversation_blocks(*rebuilt_turns(conversations), block))
    nodes = trie_nodes(blocks, block, chunk_turns).withColumn("key", F.ltrim(F.col("key"), F.lit("^")))
    out = nodes.join(end_hashes(blocks), "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"))


#: The same over lists of turns; the members of each node, its descendants by their lists' beginnings.
SQL = """
WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(list_filter(regexp_split_to_array(CAST(conv_id AS VARCHAR), ''), lambda x: x <> ''), lambda x: ascii(x)::BIGINT)),
        lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 6 AS h FROM ids),
lists AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
built AS (SELECT l.conv_id, list_concat(coalesce(b.turns[1:h], []), l.turns[h + 1:]) AS turns FROM lists l JOIN crc USING (conv_id) LEFT JOIN lists b ON b.conv_id = l.conv_id - l.conv_id % 100),
prefixes AS (SELECT conv_id, len(turns) AS total, unnest(range(len(turns) + 1)) AS depth, turns FROM built),
nodes AS (SELECT depth, turns[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(length(any_value(turns[1:depth])[depth].t), 0) AS own,
          sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE total = depth), '')) AS ends_sha256 FROM prefixes GROUP BY depth, turns[1:depth]),
kids AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
below AS (SELECT n.depth, n.path, n.own, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf, unnest(range(n.depth + 1)) AS top FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path),
sums AS (SELECT top AS depth, path[1:top] AS path, sum(leaf) AS n_leaves, sum(own) AS saved FROM below GROUP BY 1, 2)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.path = n.path LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""
