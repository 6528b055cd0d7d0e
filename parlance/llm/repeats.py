"""Suffix-array dedup by bucket refinement: remove bytes of strings that start twice.

A string of LENGTH bytes is removed wherever it starts if it also starts anywhere else.

The dealt method is bucket-pointer refinement: suffixes lie in buckets of an initial q-gram,
and buckets are refined by sorting on the bucket identifiers of later offsets, round after
round.  Run over every byte that would shuffle each position in each round (24 bytes and
more per byte of text and round), so the suffixes are sampled first, and the identifiers of
later offsets are those of a bucket's own sorted contexts:

1. The q-grams used are minimizers: every string of LENGTH bytes picks the q-gram of GRAM bytes
   with the smallest hash among those inside it, so equal strings pick the same one at the same
   place.  Each pick is responsible for a short range of starts.  A bucket with one member is unique.
2. The others are split by the bytes before and after the q-gram that their starts reach.
   Members with the same bytes are one class; all starts of a class of two are repeated.
3. Inside a bucket, classes are sorted by what follows the q-gram and by what precedes it.
   Common lengths of sorted neighbours give an identifier for every reach on either side, and
   a start is repeated if its pair of identifiers occurs twice.  A bucket of too many classes
   is first cut into narrower ranges of starts, bucketed anew by the bytes that all starts of
   the range share, and so on: at a width of one start all classes of a bucket are equal.

Copies of a whole text are treated once: only one of them sends its picks on.  Text is read
twice more, for the documents that need it only.

Defined cases: null text counts as empty; a text shorter than LENGTH keeps all its bytes;
rows with one id and text are one document, rows without an id are one each; overlapping
strings of one document count; rows of one document give equal results; other columns are
ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import arrow_map, arrow_stream
from parlance.plans.scratch import materialise

LENGTH, GRAM = 400, 250
REACH = LENGTH - GRAM
#: Classes of a bucket that are compared together; ids up to which documents are found by a broadcast.
GROUP_LIMIT, BROADCAST_IDS = 512, 300_000
_BLOCK = 1 << 22
_P = np.uint64(0xD6E8FEB86659FD93)
_P_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_LOW = np.uint64((1 << 24) - 1)


def _gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram."""
    part = data.astype(np.uint64) + np.uint64(1)
    total = np.concatenate(([np.uint64(0)], np.cumsum(part * np.cumprod(np.full(len(part), _P)))))
    h = (total[q:] - total[:-q]) * np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(part) - q, _P_INV))))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, position, first start)`` of the minimizers of all strings of ``length`` bytes, in order."""
    out = []
    width = length - gram + 1
    for s in range(0, len(data) - length + 1, _BLOCK):
        part = np.frombuffer(data, np.uint8)[s : s + _BLOCK + length - 1]
        h = _gram_hashes(part, gram)
        key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while step * 2 <= width:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        if width > step:
            key = np.minimum(key[: len(key) - (width - step)], key[width - step :])
        at = (key & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        out.append((h[at[first]].view(np.int64), at[first] + s, first + s))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, a, lo = (np.concatenate(x) for x in zip(*out, strict=True))
    new = np.concatenate(([True], a[1:] != a[:-1]))  # a pick may go on in the next block
    return h[new], a[new], lo[new]


def _key_of(sha: bytes) -> bytes:
    return sha[:16]


def picks(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, sha, n_bytes, h, a, lo)`` of each row; key: of its text; arrays: its minimizers."""

    def run(cols):
        out = {k: [] for k in ("doc_id", "key", "sha", "n_bytes", "h", "a", "lo")}
        for i, t in zip(cols["doc_id"], cols["text"], strict=True):
            data = (t or "").encode("utf-8", "surrogatepass")
            sha = hashlib.sha256(data).digest()
            h, a, lo = anchors(data)
            for k, v in zip(out, (i, _key_of(sha), sha.hex(), len(data), h, a, lo), strict=True):
                out[k].append(v)
        return out

    return arrow_map(docs, "doc_id long, key binary, sha string, n_bytes long, h array<long>, a array<long>, lo array<long>", run, F.col("doc_id").cast("long").alias("doc_id"), "text")


def _texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (with ``id``) joined with the text of each id; documents without a row are dropped before the shuffle if few remain."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), "text")
    ids = rows.select("id").distinct()
    if ids.count() <= BROADCAST_IDS:
        d = d.join(F.broadcast(ids), "id", "left_semi")
    return d.join(rows, "id")


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per wanted minimizer: its exact bucket g, its class c, and the bytes its starts reach.

    wanted: ``(id, key, at array<struct<a, lo, hi>>)``.  before/after: at most REACH bytes on
    either side of the q-gram; o_min..o_max: distances of its starts.
    """

    def run(cols):
        names = ("g", "c", "key", "a", "before", "after", "o_min", "o_max")
        out = {k: [] for k in names}
        for t, key, at in zip(cols["text"], cols["key"], cols["at"], strict=True):
            data = (t or "").encode("utf-8", "surrogatepass")
            if _key_of(hashlib.sha256(data).digest()) != key:
                continue  # another text under the same id
            for x in at:
                a, lo, hi = x["a"], x["lo"], x["hi"]
                before, after = data[lo:a], data[a + GRAM : hi + LENGTH]
                g = xxhash.xxh3_128_digest(data[a : a + GRAM])
                c = xxhash.xxh3_128_digest(g + bytes([a - hi, a - lo]) + before + after)
                for k, v in zip(names, (g, c, key, a, before, after, a - hi, a - lo), strict=True):
                    out[k].append(v)
        return out

    return arrow_map(_texts_of(docs, wanted), "g binary, c binary, key binary, a long, before binary, after binary, o_min int, o_max int", run, "text", "key", "at")


def repeated_starts(group: np.ndarray, before: list[bytes], after: list[bytes], o_min: np.ndarray, o_max: np.ndarray) -> np.ndarray:
    """For each class and distance 0..REACH: does that start's string occur in another class of its group?

    group: number of each class's bucket.  Rows of any number of buckets are sorted together.
    """
    n = len(group)

    def ids(parts: list[bytes]) -> np.ndarray:
        """ids[row, r]: equal for two rows of a group exactly if their first r bytes are equal."""
        m = np.frombuffer(b"".join(p.ljust(REACH, b"\0") for p in parts), np.uint8).reshape(n, REACH)
        order = np.lexsort((np.ascontiguousarray(m).view(f"S{REACH}").ravel(), group))
        s, g = m[order], group[order]
        differ = s[1:] != s[:-1]
        common = np.where(differ.any(1), differ.argmax(1), REACH)
        common = np.concatenate(([-1], np.where(g[1:] != g[:-1], -1, common)))
        out = np.empty((n, REACH + 1), np.int64)
        out[order] = np.cumsum(common[:, None] < np.arange(REACH + 1)[None, :], 0)
        return out

    o = np.arange(REACH + 1)
    pair = ids([b[::-1] for b in before])[:, o] * (n + 1) + ids(after)[:, REACH - o]
    held = (o >= o_min[:, None]) & (o <= o_max[:, None])
    pair[~held] = -1 - np.broadcast_to(np.arange(n)[:, None], pair.shape)[~held]
    order = np.argsort(pair, 0, kind="stable")
    s = np.take_along_axis(pair, order, 0)
    same = np.zeros((n + 1, REACH + 1), bool)
    same[1:n] = s[1:] == s[:-1]
    found = np.zeros((n, REACH + 1), bool)
    np.put_along_axis(found, order, same[:-1] | same[1:], 0)
    return found & held


def _intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [(int(x), int(y) - 1) for x, y in zip(edge[::2], edge[1::2], strict=True)]


def compare_classes(classes: DataFrame) -> DataFrame:
    """``(root, o_from, o_to)``: repeated distances of classes in buckets of at most GROUP_LIMIT classes."""

    def run(batches):
        held: list = []
        n_groups, last = 0, None

        def flush():
            group = np.array([r[0] for r in held])
            found = repeated_starts(group, [r[2] for r in held], [r[3] for r in held], np.array([r[4] for r in held]), np.array([r[5] for r in held]))
            out = {"root": [], "o_from": [], "o_to": []}
            for i in np.flatnonzero(found.any(1)):
                for x, y in _intervals(found[i]):
                    out["root"].append(held[i][1])
                    out["o_from"].append(x)
                    out["o_to"].append(y)
            return out

        for b in batches:
            for g, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != last:
                    if len(held) >= 2048:
                        yield flush()
                        held = []
                    n_groups, last = n_groups + 1, g
                held.append((n_groups, *rest))
        if held:
            yield flush()

    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = classes.select("g", "root", "before", "after", "o_min", "o_max").repartition(n, "g").sortWithinPartitions("g")
    return arrow_stream(dealt, "root binary, o_from int, o_to int", run, "g", "root", "before", "after", "o_min", "o_max")


def narrower(classes: DataFrame, width: int) -> DataFrame:
    """Classes over ranges of ``width`` distances, bucketed by the bytes that all starts of a range share."""

    def run(cols):
        out = {k: [] for k in ("g", "c", "root", "before", "after", "o_min", "o_max")}
        for g, root, before, after, low, high in zip(*(cols[k] for k in ("g", "root", "before", "after", "o_min", "o_max")), strict=True):
            for k in range(low // width, high // width + 1):
                a, b = k * width, min((k + 1) * width - 1, REACH)  # the range; this class holds lo..hi of it
                lo, hi = max(a, low), min(b, high)
                shared = xxhash.xxh3_128_digest(g + bytes([a]) + before[len(before) - a :] * (a > 0) + b"\0" + after[: REACH - b])
                left, right = before[max(0, len(before) - hi) :] if hi else b"", after[: REACH - lo]
                c = xxhash.xxh3_128_digest(shared + bytes([lo, hi]) + left + right)
                for name, v in zip(out, (shared, c, root, left, right, lo, hi), strict=True):
                    out[name].append(v)
        return out

    return arrow_map(classes, "g binary, c binary, root binary, before binary, after binary, o_min int, o_max int", run, "g", "root", "before", "after", "o_min", "o_max")


def _classes(rows: DataFrame, member: str) -> DataFrame:
    """One row per class, and whether two different members have it; ``member`` is a long that tells them apart."""
    x = F.first(F.struct("g", "root", "before", "after", "o_min", "o_max")).alias("x")
    return rows.groupBy("c").agg((F.min(member) != F.max(member)).alias("twice"), x).select("c", "twice", "x.*")


def repeated_classes(found: DataFrame) -> DataFrame:
    """``(root, o_from, o_to)`` of all classes of the minimizers ``found``."""
    done = []
    classes = materialise(_classes(found.withColumn("member", F.xxhash64("key", "a")).withColumn("root", F.col("c")), "member"))
    done.append(classes.where("twice").select("root", F.col("o_min").alias("o_from"), F.col("o_max").alias("o_to")))
    width = REACH + 1
    while True:
        size = materialise(classes.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        sized = materialise(classes.join(size, "g"))
        done.append(compare_classes(sized.where(F.col("size") <= GROUP_LIMIT)))
        large = sized.where(F.col("size") > GROUP_LIMIT)
        if width == 1 or large.isEmpty():
            return reduce(DataFrame.unionByName, done)
        width = (width + 1) // 2
        rows = materialise(narrower(large, width))
        classes = materialise(_classes(rows.withColumn("member", F.xxhash64("root")), "member"))
        twice = classes.where("twice").select("c")
        done.append(rows.join(twice, "c", "left_semi").select("root", F.col("o_min").alias("o_from"), F.col("o_max").alias("o_to")))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeats_table(docs: DataFrame) -> DataFrame:
    """The query's columns: what is removed from each document, and the hash of what stays."""
    rows = materialise(picks(docs.select("doc_id", "text")).withColumns({"id": F.coalesce("doc_id", F.lit(-(2**63))), "row": F.monotonically_increasing_id()}))
    twice = (F.min("id") != F.max("id")) | (F.count_if(F.col("doc_id").isNull()) > 1)
    texts = rows.groupBy("key").agg(F.min(F.struct("id", "row")).alias("m"), twice.alias("copied"))
    texts = materialise(texts.select("key", F.col("m.id").alias("lead"), F.col("m.row").alias("row"), "copied"))
    last = F.concat(F.slice("lo", 2, F.greatest(F.size("lo") - 1, F.lit(0))), F.array(F.col("n_bytes") - LENGTH + 1))
    leads = materialise(rows.where(F.size("a") > 0).join(texts.select("row"), "row", "left_semi").select("key", "n_bytes", "h", "a", "lo"))
    pick = leads.select("key", F.explode(F.arrays_zip("h", "a", "lo", last.alias("end"))).alias("p")).select("key", "p.h", "p.a", "p.lo", (F.col("p.end") - 1).alias("hi"))
    member = F.xxhash64("key", "a")
    # written first, so that the picks of a hash with many rows can be split in the join
    shared = materialise(pick.groupBy("h").agg(F.min(member).alias("x"), F.max(member).alias("y")).where("x != y").select("h"))
    wanted = pick.join(shared, "h", "left_semi").groupBy("key").agg(F.collect_list(F.struct("a", "lo", "hi")).alias("at"))
    wanted = materialise(wanted.join(texts, "key").select(F.col("lead").alias("id"), "key", "at"))
    found = materialise(contexts(docs, wanted))
    again = repeated_classes(found)
    spans = found.select("key", "a", "c").join(again, F.col("c") == F.col("root")).select("key", F.struct((F.col("a") - F.col("o_to")).alias("s"), (F.col("a") - F.col("o_from") + LENGTH).alias("e")).alias("span")).distinct()
    spans = materialise(spans.groupBy("key").agg(F.collect_list("span").alias("spans")))
    # one row a text, written first, so that the rows of a text with many copies can be split in the join
    marks = materialise(texts.select("key", "copied").join(spans.select("key", F.lit(True).alias("part")), "key", "left"))
    base = rows.select("id", "doc_id", "key", "sha", "n_bytes").join(marks, "key")
    base = base.withColumn("all", F.col("copied") & (F.col("n_bytes") >= LENGTH)).withColumn("part", F.coalesce("part", F.lit(False)) & ~F.col("all"))
    base = materialise(base)
    n = F.when(F.col("all"), F.col("n_bytes")).otherwise(F.lit(0))
    whole = base.where("not part").select("doc_id", "n_bytes", n.alias("n_removed"), F.col("all").cast("long").alias("n_spans"), F.when(F.col("all"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("sha")).alias("kept_sha256"))

    def cut(cols):
        out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for i, t, key, spans in zip(cols["doc_id"], cols["text"], cols["key"], cols["spans"], strict=True):
            data = (t or "").encode("utf-8", "surrogatepass")
            if _key_of(hashlib.sha256(data).digest()) != key:
                continue  # another text under the same id
            gone = merged([(x["s"], x["e"]) for x in spans])
            kept, at = hashlib.sha256(), 0
            for a, b in gone:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            for k, v in zip(out, (i, len(data), sum(b - a for a, b in gone), len(gone), kept.hexdigest()), strict=True):
                out[k].append(v)
        return out

    part = base.where("part").select("id", "doc_id", "key").distinct().join(spans, "key")
    cuts = arrow_map(_texts_of(docs, part), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", cut, "doc_id", "text", "key", "spans")
    return whole.unionByName(cuts)
