"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact check.

Native: DataFrame functions only.

1. Words are lower-cased runs of letters and digits.  A shingle is five words (an item of
   fewer words is one shingle of all of them).
2. Windows have the size of an item.  A window without a shared shingle has similarity 0, and
   one that starts before its first shared shingle can move on to it and lose none, so the
   best window starts at a shared shingle, or is the last of the document; all these are laid,
   and those where a shared shingle aligns with the item.  Windows with too few shared shingles
   to reach the threshold are left out.  (Fingerprints of every window of every item's size,
   in this native form, cost far beyond the limits; the README has the figures.)
3. Each window and item gets a 64-bit SimHash of its weighted shingles (weight: how often it
   occurs).  The bits are cut into RADIUS + 1 blocks: two fingerprints within RADIUS agree
   in one block at least, so a join on (window size, block, its bits) finds all of them.
4. Candidates within RADIUS are kept if the exact weighted Jaccard similarity of their
   shingles reaches the threshold.

Item shingles are broadcast only up to BROADCAST_SHINGLES, window places only up to
BROADCAST_PLACES rows (both are counted first); beyond that the same joins are shuffled.

Defined cases: null and empty texts match nothing; a document shorter than an item is one
window for it; repeated items give a row each; repeated documents (one id) give the best
window of all their rows (of equal ones an aligned one, then the first); of rows without an id each
text is a document of its own; no rows give no rows; other
columns are ignored.  Rows of one id with different texts are judged apart: drop_leaks drops the row that
holds the item and leaves the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.plans.scratch import materialise

SHINGLE, THRESHOLD, RADIUS, BITS = 5, 0.8, 20, 64
BROADCAST_SHINGLES, BROADCAST_PLACES = 1_000_000, 200_000
NOT_WORD = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def _shingle_hash(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*(F.get(words, i + j) for j in range(k)))


def _places(words: Column, k: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0)))


def _hashes(words: Column, k: int) -> Column:
    """Hashes of the shingles of at least k words, in order."""
    return F.transform(_places(words, k), lambda i: _shingle_hash(words, i, k))


def shingles_of(words: Column, k: Column) -> Column:
    """All shingles of k words, as text; repeated ones stay."""
    return F.when(F.size(words) < k, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " ")))


def shingle_hashes(shingles: Column) -> Column:
    return F.transform(shingles, lambda s: F.xxhash64(s))


def simhash(hashes: Column) -> Column:
    """Bit b is set when the weights of shingles with that bit outweigh the others; hashes: of all shingles, as a column of its own."""

    def bit(b):
        one = F.aggregate(hashes, F.lit(0), lambda a, h: a + (F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1)) * 2 - 1).cast("int"))
        return F.when(one > 0, F.expr("1L")).otherwise(F.expr("0L"))

    out = F.lit(0).cast("long")
    for b in range(BITS):
        out = out.bitwiseOR(F.shiftleft(bit(b), b))
    return out


def blocks_of(fingerprint: Column, radius: int = RADIUS) -> Column:
    """RADIUS + 1 blocks of nearly equal width: array of (block, its bits)."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("bits")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two bags of shingles."""
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, s: n + F.least(F.size(F.filter(a, lambda x: x == s)), F.size(F.filter(b, lambda x: x == s))))
    return both / (F.size(a) + F.size(b) - both)


def items_of(benchmark: DataFrame) -> DataFrame:
    """``(item_no, item_id, item_words, item_len, k)`` of the items that have words."""
    b = benchmark.select("item_id", words_of(F.col("text")).alias("item_words")).where(F.size("item_words") > 0)
    b = b.withColumn("item_len", F.size("item_words")).withColumn("k", F.least(F.lit(SHINGLE), F.col("item_len")))
    return b.withColumn("item_no", F.xxhash64("item_id", F.array_join("item_words", " ")))


def _needed(m: Column, n: Column, threshold: float) -> Column:
    """Shared shingles without which bags of m and n have a similarity that rounds to less than the threshold."""
    t = threshold - 1e-6
    return F.greatest(F.lit(1), F.ceil((m + n) * t / (1 + t)).cast("int"))


def _starts(threshold: float) -> Column:
    """``(start, aligned)`` of the windows worth comparing, of one item's hits in one document.

    hits: places of shared shingles, sorted; aligned: starts where one of them aligns with the item.
    """
    last, p = F.greatest(F.col("n") - F.col("item_len"), F.lit(0)), F.col("hits")
    size = F.least(F.col("n"), F.col("item_len")) - F.col("k") + 1
    need = _needed(size, F.col("item_len") - F.col("k") + 1, threshold)
    # a window that starts at the hit of rank r holds enough hits if the one of rank r + need - 1 lies in it
    first = F.filter(p, lambda x, r: (x <= last) & (F.coalesce(F.get(p, r + need - 1), F.lit(2**31 - 1)) < x + size))
    end = F.when(F.size(F.filter(p, lambda x: x >= last)) >= need, F.array(last)).otherwise(F.array().cast("array<int>"))
    other = F.array_except(F.array_union(first, end), F.col("aligned"))
    aligned = F.when(F.size(p) >= need, F.col("aligned")).otherwise(F.array().cast("array<int>"))
    return F.concat(F.transform(aligned, lambda x: F.struct(x.alias("start"), F.lit(1).alias("aligned"))), F.transform(other, lambda x: F.struct(x.alias("start"), F.lit(0).alias("aligned"))))


def candidate_windows(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, text_no, start, aligned, item_len, k, window)``: distinct windows that can reach the threshold by their shared shingles; text_no: hash of the row's text."""
    spark = docs.sparkSession
    d = docs.select("doc_id", F.xxhash64("text").alias("text_no"), words_of(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    places = None
    for k in sorted(r.k for r in items.select("k").distinct().collect()):  # at most SHINGLE values
        item_text = F.xxhash64(F.array_join("item_words", " ")).alias("item_text")
        placed = items.where(F.col("k") == k).select(item_text, "item_len", F.posexplode(_hashes(F.col("item_words"), k)).alias("at", "h")).distinct()
        side = F.broadcast(placed) if placed.count() <= BROADCAST_SHINGLES else placed
        shingles = d.select("doc_id", "text_no", "n", F.when(F.size("words") >= k, _hashes(F.col("words"), k)).alias("hashes"))
        hit = shingles.select("doc_id", "text_no", "n", F.posexplode_outer("hashes").alias("i", "h")).join(side, "h")
        start = F.greatest(F.lit(0), F.least(F.col("i") - F.col("at"), F.col("n") - F.col("item_len")))
        # a group is at most as long as its document
        hit = hit.groupBy("doc_id", "text_no", "n", "item_len", "item_text").agg(F.array_sort(F.collect_set("i")).alias("hits"), F.collect_set(start).alias("aligned")).withColumn("k", F.lit(k))
        hit = hit.select("doc_id", "text_no", "n", "item_len", "k", F.inline(_starts(threshold)))
        hit = hit.groupBy("doc_id", "text_no", "n", "item_len", "k", "start").agg(F.max("aligned").alias("aligned"))
        places = hit if places is None else places.unionByName(hit)
    if places is None:
        places = spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_no long, n int, item_len int, k int, start int, aligned int")
    places = materialise(places).withColumnsRenamed({"doc_id": "placed_id", "text_no": "placed_text", "n": "placed_n"})
    if places.count() <= BROADCAST_PLACES:
        places = F.broadcast(places)
    w = d.join(places, F.col("doc_id").eqNullSafe(F.col("placed_id")) & (F.col("text_no") == F.col("placed_text")) & (F.col("n") == F.col("placed_n")))
    return w.select("doc_id", "text_no", "start", "aligned", "item_len", "k", F.array_join(F.slice("words", F.col("start") + 1, F.col("item_len")), " ").alias("window"))


def leaking_windows(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, text_no, start, aligned, window, item_id, item_no, similarity)``: the windows that reach the threshold."""
    items = items_of(benchmark.select("item_id", "text"))
    w = candidate_windows(docs.select("doc_id", "text"), items, threshold).withColumn("shingles", shingles_of(F.split("window", " "), F.col("k")))
    w = w.withColumn("hashes", shingle_hashes(F.col("shingles"))).withColumn("print", simhash(F.col("hashes"))).drop("hashes").withColumn("at", F.explode(blocks_of(F.col("print"), radius)))
    i = items.withColumn("item_shingles", shingles_of(F.col("item_words"), F.col("k"))).withColumn("hashes", shingle_hashes(F.col("item_shingles"))).withColumn("item_print", simhash(F.col("hashes"))).withColumn("at", F.explode(blocks_of(F.col("item_print"), radius)))
    i = i.select("item_id", "item_no", "item_len", "item_shingles", "item_print", "at")
    small = items.agg(F.sum("item_len")).first()[0] or 0
    if small <= BROADCAST_SHINGLES // 10:
        i = F.broadcast(i)
    near = w.join(i, ["item_len", "at"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    # a pair meets once for every block it agrees in: only the first of them goes on
    same = F.array_position(F.zip_with(blocks_of(F.col("print"), radius), blocks_of(F.col("item_print"), radius), lambda x, y: x == y), F.lit(True)) - 1
    near = near.where(F.col("at")["block"] == same).withColumn("similarity", F.round(weighted_jaccard(F.col("shingles"), F.col("item_shingles")), 6))
    return near.where(F.col("similarity") >= threshold).select("doc_id", "text_no", "start", "aligned", "window", "item_id", "item_no", "similarity")


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, item_id, similarity, start_word, n_words)``: the best window of each document for each item it holds."""
    near = leaking_windows(docs, benchmark, threshold, radius)
    best = near.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_no")).alias("own"), "item_id", "item_no").agg(F.max(F.struct("similarity", "aligned", (-F.col("start")).alias("s"), F.size(F.split("window", " ")).alias("n_words"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.s")).alias("start_word"), F.col("b.n_words").alias("n_words"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds an item; other rows stay, whatever their id."""
    hit = leaking_windows(docs, benchmark).select(F.col("doc_id").alias("leak_id"), F.col("text_no").alias("leak_text")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("leak_id")) & (F.xxhash64("text") == F.col("leak_text")), "left_anti")


#: Every item-sized window that shares a shingle with the item; start_word is chosen as the query chooses it.
SQL = rf"""
WITH iw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT item_id, w, len(w) AS n, least({SHINGLE}, len(w)) AS k FROM iw WHERE len(w) > 0),
ish AS (SELECT item_id, n, k, j, array_to_string(w[j:j + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, n - k + 2)) AS j FROM i)),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
dsh AS (SELECT doc_id, len(w) AS size, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i))),
hit AS (SELECT DISTINCT doc_id, item_id, n, ish.k, p, j, greatest(0, size - n) AS final FROM dsh JOIN ish ON dsh.s = ish.s AND dsh.k = ish.k),
c AS (SELECT DISTINCT doc_id, item_id, n, k, unnest(range(greatest(0, least(final, p + k - 1 - n)), greatest(0, least(final, p - 1)) + 1)) AS start FROM hit),
al AS (SELECT DISTINCT doc_id, item_id, greatest(0, least(p - j, final)) AS start, true AS aligned FROM hit),
fi AS (SELECT doc_id, item_id, p - 1 AS start, true AS laid FROM hit WHERE p - 1 <= final UNION SELECT doc_id, item_id, final, true FROM hit),
win AS (SELECT doc_id, item_id, n, k, start, w[start + 1:start + n] AS w FROM c JOIN d USING (doc_id)),
wsh AS (SELECT doc_id, item_id, start, len(w) AS n, len(w) - k + 1 AS wt, array_to_string(w[q:q + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS q FROM win)),
wc AS (SELECT doc_id, item_id, start, n, wt, s, count(*) AS m FROM wsh GROUP BY ALL),
ic AS (SELECT item_id, s, count(*) AS m FROM ish GROUP BY ALL),
tot AS (SELECT item_id, sum(m) AS t FROM ic GROUP BY ALL),
sim AS (SELECT doc_id, item_id, start, n, CAST(sum(least(wc.m, ic.m)) AS DOUBLE) AS shared, any_value(t) AS t, any_value(wt) AS wt FROM wc JOIN ic USING (item_id, s) JOIN tot USING (item_id) GROUP BY ALL),
r AS (SELECT doc_id, item_id, start, n, round(shared / (t + wt - shared), 6) AS similarity, coalesce(aligned, false) AS aligned, coalesce(laid, false) AS laid FROM sim LEFT JOIN al USING (doc_id, item_id, start) LEFT JOIN fi USING (doc_id, item_id, start))
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_max(start, (similarity, aligned, laid, -start)) AS INTEGER) AS start_word, CAST(arg_max(n, (similarity, aligned, laid, -start)) AS INTEGER) AS n_words
FROM r WHERE similarity >= {THRESHOLD} GROUP BY doc_id, item_id
"""
