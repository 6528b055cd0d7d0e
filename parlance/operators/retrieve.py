"""Answer many questions in one plan: vector, full-text and graph channels, fused and grounded."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parlance.functions.text import query_text
from parlance.operators.resolve import PIVOTS, dot, split_cells, unit_vectors
from parlance.plans.scratch import materialise

RRF_K, TOP_CHANNEL, TOP_CONTEXT = 60, 20, 12
#: Vectors of a cell, about.
CELL_ROWS = 50_000
#: Questions and names up to which their table is broadcast.
BROADCAST_ROWS = 50_000
#: Questions up to which all of them are held by every task that scores rows, their numbers by terms, and bytes of scores made at once.
HELD_QUESTIONS, HELD_WEIGHTS, SCORE_BYTES = 1_000, 4_000_000, 1 << 24


def small(df: DataFrame) -> DataFrame:
    """Broadcast a table only if a count shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


#: Letters of a name that are looked up in a question before the whole name is.
NAME_START = 4


def match_names(questions: DataFrame, names: DataFrame) -> DataFrame:
    """Names that occur anywhere in a question of their scope (any case), inside words too; names: scope, name, kind, ref.

    The first letters of a name meet the n-grams of the questions in an equi-join; the whole name is then tested.
    """
    n = names.where("name is not null and name != ''").withColumn("k", F.substr(F.lower("name"), F.lit(1), F.lit(NAME_START)))
    q = questions.select("question_id", "scope", F.lower("question").alias("low"))

    def grams(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("low") - (size - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substr("low", i, F.lit(size)))

    q = q.select("question_id", "scope", "low", F.explode(F.array_distinct(F.flatten(F.array(*map(grams, range(1, NAME_START + 1)))))).alias("k"))
    return q.join(n, ["scope", "k"]).where(F.contains("low", F.lower("name"))).select("question_id", "kind", "ref", "name").distinct()


def rank_by(rows: DataFrame, key: str, *order: Column, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def _score() -> Column:
    return F.round(F.coalesce(dot(F.col("q"), F.col("u")), F.lit(0.0)), 6).alias("score")


def best_of(scores: DataFrame, k: int, slices: int = 16) -> DataFrame:
    """The k best ids of each question; each slice keeps its own first, so no question's candidates meet in one task."""
    part = scores.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(slices))).withColumn("_k", F.row_number().over(Window.partitionBy("question_id", "_s").orderBy(F.desc("score"), "id"))).where(F.col("_k") <= k)
    return rank_by(part.drop("_k", "_s"), "question_id", F.desc("score"), F.col("id")).where(F.col("rank") <= k)


def vector_cells(vectors: DataFrame, cell_rows: int = CELL_ROWS, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(scope, id, u, cell, angle) of every unit vector ``(scope, id, u)``, and ``(scope, cell, n, near, far, at)`` of the cells: how far its vectors are from its pivot; both written.

    Vectors of length 0 are a cell of their own (-1), without a pivot.
    """
    placed, at = split_cells(vectors.where("u is not null").withColumnRenamed("u", "unit"), "id", ["scope"], cell_rows, pivots)
    placed = placed.select("scope", "id", F.col("unit").alias("u"), "cell", "angle").unionByName(vectors.where("u is null").select("scope", "id", "u", F.lit(-1).alias("cell"), F.lit(0.0).alias("angle")))
    placed = materialise(placed)
    cells = placed.groupBy("scope", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"))
    return placed, materialise(cells.join(at, ["scope", "cell"], "left"))


def _limits(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """``(question_id, scope, q, cell, n, apart, best)``: how far a question is from a cell's pivot, and the best score that the cell can hold."""
    j = cells.join(small(questions), "scope").withColumn("apart", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("q"), F.col("at"))))))
    # no vector of the cell is nearer than this angle
    least = F.greatest(F.lit(0.0), F.col("apart") - F.col("far"), F.col("near") - F.col("apart"))
    unknown = F.when((F.col("cell") < 0) | F.col("q").isNull(), F.lit(0.0)).otherwise(F.lit(1.0))
    return j.select("question_id", "scope", "q", "cell", "n", "apart", F.when(F.col("apart").isNull(), unknown).otherwise(F.cos(least)).alias("best"))


def vector_top(questions: DataFrame, vectors: DataFrame, k: int = TOP_CHANNEL, cell_rows: int = CELL_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """The k nearest vectors of each question inside its scope, exact: cosine, rounded, ties by id.

    Few questions (HELD_QUESTIONS) are scored against every vector as matrices, in one pass that grows with the vectors.  For more,
    vectors are cut into cells around pivots of their scope.  The cells that can be nearest are scored first, until they
    hold k vectors; a cell, or a vector at an angle to its pivot, that cannot reach the k-th best of these scores
    is left out, which loses nothing.
    """
    held = min(HELD_QUESTIONS, BROADCAST_ROWS)
    few = questions.select("question_id", "scope", _numbers("vector")).where("scope is not null").limit(held + 1).collect()
    if len(few) <= held:
        return _held_vectors(questions, few, vectors, k)
    v = materialise(unit_vectors(vectors, "vector").where("scope is not null").select("scope", "id", F.col("unit").alias("u")))
    if v.groupBy("scope").count().where(F.col("count") > cell_rows).isEmpty():
        # one cell a scope: nothing to leave out
        q = unit_vectors(questions, "vector").select("question_id", "scope", F.col("unit").alias("q"))
        return best_of(v.join(small(q), "scope").select("question_id", "id", _score()), k)
    return _nearest(questions, *vector_cells(v, cell_rows, pivots), k)[0]


def _nearest(questions: DataFrame, placed: DataFrame, cells: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(top k, the scored pairs that they were taken from)."""
    q = materialise(unit_vectors(questions, "vector").select("question_id", "scope", F.col("unit").alias("q")))
    limits = materialise(_limits(q, cells))
    so_far = F.sum("n").over(Window.partitionBy("question_id").orderBy(F.desc("best"), "cell").rowsBetween(Window.unboundedPreceding, -1))
    first = materialise(limits.withColumn("_n", F.coalesce(so_far, F.lit(0))).where(F.col("_n") < k).drop("_n"))

    def scored(pairs: DataFrame) -> DataFrame:
        j = placed.join(small(pairs), ["scope", "cell"])
        if "limit" in pairs.columns:
            reach = F.col("limit") - 1e-6
            j = j.where(F.col("limit").isNull() | F.col("apart").isNull() | F.col("u").isNull() | (F.cos(F.abs(F.col("apart") - F.col("angle"))) >= reach))
        return j.select("question_id", "id", _score())

    limit = best_of(scored(first), k).where(F.col("rank") == k).select("question_id", F.col("score").alias("limit"))
    kept = limits.join(limit, "question_id", "left").where(F.col("limit").isNull() | (F.col("best") >= F.col("limit") - 1e-6))
    rows = scored(materialise(kept))
    return best_of(rows, k), rows


def _numbers(vector: str) -> Column:
    """A vector as doubles; one with a null in it has no direction, as if it were null."""
    return F.when(F.forall(vector, lambda x: x.isNotNull()), F.transform(vector, lambda x: x.cast("double"))).alias("vector")


def _best_by_batch(rows: DataFrame, column: str, questions: DataFrame, places: dict, scores: Callable, k: int, digits: int) -> DataFrame:
    """The k best ``(question_id, id, score, rank)`` of questions that every task holds: rows (scope, id, column) are scored batch by batch, in one pass.

    places: the questions of a scope, as numbers; questions: place, question_id; ``scores(scope, values)``: a matrix of rows by
    these questions.  A batch keeps what can be among a question's k best by score, rounded to ``digits``, and id.
    """
    width, unit = max((len(p) for p in places.values()), default=1), 10.0**digits

    def best_rows(s: np.ndarray, ids: list) -> np.ndarray:
        # a score at the edge of rounding counts as either value, so nothing depends on how halves are rounded; NaN is above all, as in Spark
        if len(s) <= k:
            return np.arange(len(s))
        x = np.abs(s) * unit
        either = np.abs(x - np.floor(x) - 0.5) <= 1e-4
        down, up = np.where(either, np.floor(x), np.floor(x + 0.5)), np.where(either, np.ceil(x), np.floor(x + 0.5))
        low, high = (np.where(np.isnan(s), np.inf, v) for v in (np.where(s < 0, -up, down), np.where(s < 0, -down, up)))
        kth = np.partition(low, len(low) - k)[len(low) - k]
        ties = np.flatnonzero((high == kth) & ~either)
        if len(ties) > k:
            ties = np.array(sorted(ties, key=lambda i: ids[i])[:k])
        return np.concatenate([np.flatnonzero((high > kth) | ((high == kth) & either)), ties])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        step = max(1, SCORE_BYTES // (8 * width))
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                at, found, points = [], [], []
                scope = batch.column("scope").dictionary_encode()
                codes = scope.indices.to_numpy(zero_copy_only=False)
                for code, name in enumerate(scope.dictionary.to_pylist()):
                    if name not in places:
                        continue
                    part = batch.take(pa.array(np.flatnonzero(codes == code)))
                    s, ids = scores(name, part.column(column)), part.column("id").to_pylist()
                    for j, p in enumerate(places[name]):
                        some = np.arange(len(ids)) if s.any_score is None else np.flatnonzero(s.any_score[:, j])
                        kept = some[best_rows(s.values[some, j], [ids[i] for i in some] if len(some) < len(ids) else ids)]
                        at += [p] * len(kept)
                        found += [ids[i] for i in kept]
                        points += s.values[kept, j].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found, batch.column("id").type), pa.array(points, pa.float64())], ["place", "id", "score"])

    schema = T.StructType([T.StructField("place", T.IntegerType()), rows.schema["id"], T.StructField("score", T.DoubleType())])
    out = rows.select("scope", "id", column).mapInArrow(score, schema)
    return best_of(out.join(F.broadcast(questions), "place").select("question_id", "id", F.round("score", digits).alias("score")), k)


def _places(questions: DataFrame, few: list) -> tuple[dict, DataFrame]:
    """The numbers of the questions by scope, and the questions by number."""
    places: dict = {}
    for place, row in enumerate(few):
        places.setdefault(row.scope, []).append(place)
    named = T.StructType([T.StructField("place", T.IntegerType()), questions.schema["question_id"]])
    return places, questions.sparkSession.createDataFrame([(p, r.question_id) for p, r in enumerate(few)], named)


def _held_vectors(questions: DataFrame, few: list, vectors: DataFrame, k: int) -> DataFrame:
    """vector_top for few questions: matrices of every vector by all questions of its scope."""
    places, named = _places(questions, few)
    asked: dict = {}
    for scope, at in places.items():
        by_size: dict = {}
        for column, place in enumerate(at):
            by_size.setdefault(len(few[place].vector or []), []).append((column, few[place].vector or []))
        asked[scope] = len(at), {d: ([c for c, _ in part], np.array([x for _, x in part], dtype=np.float64)) for d, part in by_size.items()}

    def scores(scope, lists: pa.Array):
        n, (width, by_size) = len(lists), asked[scope]
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat, start = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
        out = np.zeros((n, width))
        for d, (columns, q) in by_size.items():
            at = np.flatnonzero(size == d)
            if d and len(at):
                m = flat[start[at][:, None] + np.arange(d)]
                # whole numbers stay exact until the one division
                norm = np.outer(*(np.sqrt((x * x).sum(axis=1)) for x in (m, q)))
                out[np.ix_(at, columns)] = np.divide(m @ q.T, norm, out=np.zeros_like(norm), where=norm != 0)
        return SimpleNamespace(values=out, any_score=None)

    rows = vectors.where("scope is not null").select("scope", "id", _numbers("vector"))
    return _best_by_batch(rows, "vector", named, places, scores, k, 6)


def _held_terms(questions: DataFrame, few: list, asked: list, docs: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """bm25_top for few questions; docs: scope, id, ts (the words of a text); asked: question, term, its weight, and the mean length of texts in its scope."""
    places, named = _places(questions, few)
    column = {few[p].question_id: (scope, j) for scope, at in places.items() for j, p in enumerate(at)}
    code: dict = {scope: {} for scope in places}
    for row in asked:
        code[row.scope].setdefault(row.term, len(code[row.scope]))
    weights = {scope: np.zeros((len(code[scope]), len(at))) for scope, at in places.items()}
    mean = {}
    for row in asked:
        weights[row.scope][code[row.scope][row.term], column[row.question_id][1]] = row.idf
        mean[row.scope] = row.avg_len

    def scores(scope, lists: pa.Array):
        n, known, weight = len(lists), code[scope], weights[scope]
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        words = lists.flatten().dictionary_encode()
        of = np.array([known.get(w, -1) for w in words.dictionary.to_pylist()], dtype=np.int64)
        out, found = np.zeros((n, weight.shape[1])), np.zeros((n, weight.shape[1]), dtype=bool)
        if len(words) and len(known):
            term, text = of[words.indices.to_numpy(zero_copy_only=False)], np.repeat(np.arange(n), size)
            pairs, tf = np.unique(text[term >= 0] * len(known) + term[term >= 0], return_counts=True)
            text, term = np.divmod(pairs, len(known))
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[text] / mean[scope])) if len(pairs) else np.zeros(0)
            step = max(1, SCORE_BYTES // (8 * weight.shape[1]))
            for begin in range(0, len(pairs), step):
                cut = slice(begin, begin + step)
                first = np.flatnonzero(np.r_[True, text[cut][1:] != text[cut][:-1]])
                gains = part[cut, None] * weight[term[cut]]
                out[text[cut][first]] += np.add.reduceat(gains, first, axis=0)
                found[text[cut][first]] |= np.logical_or.reduceat(weight[term[cut]] != 0, first, axis=0)
        return SimpleNamespace(values=out, any_score=found)

    top = _best_by_batch(docs, "ts", named, places, scores, k, 5)
    return top.withColumnRenamed("id", "fragment_id")


def expand_to_members(hits: DataFrame, members: DataFrame, k: int = TOP_CHANNEL) -> DataFrame:
    """Utterance hits as their fragments, which inherit the score; members: id, fragment_id."""
    m = hits.join(members, "id").groupBy("question_id", "fragment_id").agg(F.max("score").alias("score"))
    return rank_by(m, "question_id", F.desc("score"), F.col("fragment_id")).where(F.col("rank") <= k)


def merge_channels(*hits: DataFrame) -> DataFrame:
    """Best score per fragment over several hit lists."""
    out = hits[0].select("question_id", "fragment_id", "score")
    for h in hits[1:]:
        out = out.unionByName(h.select("question_id", "fragment_id", "score"))
    return rank_by(out.groupBy("question_id", "fragment_id").agg(F.max("score").alias("score")), "question_id", F.desc("score"), F.col("fragment_id"))


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(query_text(text)), " "), lambda w: w != "")


def postings(docs: DataFrame, key: str, scope: str, text: str, wanted: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """(scope, term, id, length, tf) of a text column; wanted: (scope, term) that are of interest; tasks: how many share the words."""
    d = docs.select(F.col(scope).alias("scope"), F.col(key).alias("id"), terms(F.col(text)).alias("ts"))
    d = d.select("scope", "id", F.size("ts").alias("length"), F.explode("ts").alias("term"))
    if wanted is not None:
        # dealt by text: what a question's terms add up to in a text is then summed where the text is
        d = d.join(small(wanted.select("scope", "term").distinct()), ["scope", "term"], "left_semi").repartition("id")
    elif tasks is not None:
        d = d.repartition(tasks, "id")
    return d.groupBy("scope", "term", "id", "length").agg(F.count(F.lit(1)).alias("tf"))


def bm25_top(questions: DataFrame, docs: DataFrame, key: str, scope: str, text: str, k: int = TOP_CHANNEL, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 (any of the terms) inside a question's scope; empty questions find nothing.

    docs: one row per text.  Few questions are held by every task and texts scored where they are; for more, postings are joined.
    """
    q = questions.select("question_id", "scope", F.explode(F.array_distinct(terms(F.col("question")))).alias("term"))
    held, words = min(HELD_QUESTIONS, BROADCAST_ROWS), docs.select(F.col(scope).alias("scope"), F.col(key).alias("id"), terms(F.col(text)).alias("ts")).where("scope is not null")
    few = questions.select("question_id", "scope").where("scope is not null").limit(held + 1).collect()
    if len(few) <= held and len({r.question_id for r in few}) == len(few) and q.select("scope", "term").distinct().count() * len(few) <= HELD_WEIGHTS:
        each = words.select("scope", F.explode(F.array_distinct("ts")).alias("term")).join(small(q.select("scope", "term").distinct()), ["scope", "term"], "left_semi")
        df = each.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"))
        sizes = words.groupBy("scope").agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("ts")).alias("avg_len"))
        idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
        asked = q.join(df, ["scope", "term"]).join(sizes, "scope").select("question_id", "scope", "term", idf, "avg_len").collect()
        return _held_terms(questions, few, asked, words, k, k1, b)
    p = postings(docs, key, scope, text, q)
    sizes = docs.select(F.col(scope).alias("scope"), F.size(terms(F.col(text))).alias("n")).groupBy("scope").agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("avg_len"))
    df = p.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"))
    asked = materialise(q.join(df, ["scope", "term"]).join(sizes, "scope"))
    hit = p.join(small(asked), ["scope", "term"])
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_len")))
    s = hit.groupBy("question_id", F.col("id").alias("fragment_id")).agg(F.round(F.sum(w), 5).alias("score"))
    return rank_by(s, "question_id", F.desc("score"), F.col("fragment_id")).where(F.col("rank") <= k)


def graph_hits(matches: DataFrame, mentions: DataFrame, spoken: DataFrame) -> DataFrame:
    """Fragments that mention a matched entity or are spoken by a matched person; repeats stay.

    mentions: ref, fragment_id of entities (over their aliases); spoken: ref, fragment_id of persons.
    """
    rows = mentions.select("ref", "fragment_id", F.lit("entity").alias("kind")).unionByName(spoken.select("ref", "fragment_id", F.lit("person").alias("kind")))
    # dealt by fragment: its hits are then counted where they are found
    return rows.repartition("fragment_id").join(small(matches.select("question_id", "kind", "ref")), ["kind", "ref"]).select("question_id", "fragment_id")


def rank_by_hits(hits: DataFrame) -> DataFrame:
    n = hits.groupBy("question_id", "fragment_id").agg(F.count(F.lit(1)).alias("hits"))
    return rank_by(n, "question_id", F.desc("hits"), F.col("fragment_id"))


def within_reach(ranked: DataFrame, others: DataFrame, top: int, k: int = RRF_K) -> DataFrame:
    """The rows of a channel that fusion can put among a question's ``top``: its first ones, and those that another channel has as well.

    A row further down that no other channel has scores less than ``top`` rows of its own channel.
    """
    found = others.select("question_id", "fragment_id", F.lit(True).alias("_also")).distinct()
    far = F.round(1.0 / (k + F.col("rank")), 9) < F.round(1.0 / (k + F.lit(top)), 9)
    return ranked.join(small(found), ["question_id", "fragment_id"], "left").where(~far | F.col("_also")).drop("_also")


def fuse(ranked: DataFrame, k: int = RRF_K, top: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of (question_id, channel, fragment_id, rank); ties by id."""
    s = ranked.groupBy("question_id", "fragment_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
    out = rank_by(s, "question_id", F.desc("score"), F.col("fragment_id"))
    return out if top is None else out.where(F.col("rank") <= top)


def context_rows(fused: DataFrame, fragments: DataFrame, siblings: DataFrame, entities: DataFrame, persons: DataFrame, topics: DataFrame) -> DataFrame:
    """What a retrieved fragment is shown with: speaker and person, utterance text in order, topics, entities; each branch aggregated before its join.

    fragments: fragment_id, speaker_id, speaker, text; siblings: utterance_id, fragment_id, seq, text;
    entities: fragment_id, name; persons: speaker_id, person; topics: fragment_id, topic.
    """
    ids = small(fused.select("fragment_id").distinct())
    e = entities.join(ids, "fragment_id", "left_semi").groupBy("fragment_id").agg(F.array_sort(F.collect_set("name")).alias("entities"))
    t = topics.join(ids, "fragment_id", "left_semi").groupBy("fragment_id").agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    own = materialise(siblings.join(ids, "fragment_id", "left_semi").select("fragment_id", "utterance_id"))
    text = siblings.join(small(own.select("utterance_id").distinct()), "utterance_id", "left_semi").groupBy("utterance_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("block_text"))
    f = fragments.join(ids, "fragment_id", "left_semi").join(own, "fragment_id", "left").join(text, "utterance_id", "left")
    f = f.withColumn("block_text", F.coalesce("block_text", "text")).join(persons.groupBy("speaker_id").agg(F.min("person").alias("person")), "speaker_id", "left")
    return fused.join(f, "fragment_id").join(e, "fragment_id", "left").join(t, "fragment_id", "left")


def context_blocks(rows: DataFrame) -> DataFrame:
    """Context rows as blocks: one line of who spoke (with the person) and of topics and entities, over the utterance's text."""
    speaker = F.concat(F.coalesce("speaker", F.lit("Unknown speaker")), F.coalesce(F.concat(F.lit(" ("), "person", F.lit(")")), F.lit("")))
    listed = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("-"))
    head = F.concat(F.lit("["), "fragment_id", F.lit("] "), speaker, F.lit(" (topics: "), listed("topics"), F.lit("; entities: "), listed("entities"), F.lit(")"))
    return rows.withColumns({"speaker_line": speaker, "block": F.concat_ws("\n", head, "block_text")})


def prompts(blocks: DataFrame, questions: DataFrame, template: str = "Question: {question}\n\n{blocks}") -> DataFrame:
    """One prompt per question: its blocks in rank order."""
    b = blocks.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("blocks"))
    return questions.join(b, "question_id", "left").select("question_id", F.replace(F.replace(F.lit(template), F.lit("{question}"), F.col("question")), F.lit("{blocks}"), F.coalesce("blocks", F.lit("(no grounding)"))).alias("prompt"))


def ground_citations(cited: DataFrame, blocks: DataFrame) -> DataFrame:
    """Cited ids that were retrieved, with their verbatim text, in block order."""
    return cited.select("question_id", "fragment_id").distinct().join(blocks.select("question_id", "fragment_id", "rank", F.col("text").alias("quote")), ["question_id", "fragment_id"])


def without_outages(hits: DataFrame, outages: DataFrame, side: str) -> DataFrame:
    """Hits of one side, without the questions for which it could not be asked; outages: question_id, side."""
    return hits.join(outages.where(F.col("side") == side).select("question_id"), "question_id", "left_anti")


def channel_report(ranked: DataFrame, questions: DataFrame, channels: list[str], outages: DataFrame | None = None, of: dict[str, list[str]] | None = None) -> DataFrame:
    """Hits per channel of every question, ``no_grounding`` if there are none, and ``flags``: what could not be asked.

    outages: question_id, side; of: the sides of a channel, which is flagged itself when all of them are out.
    """
    n = ranked.groupBy("question_id").agg(*(F.count_if(F.col("channel") == c).alias(f"n_{c}") for c in channels))
    out = questions.select("question_id").join(n, "question_id", "left").fillna(0)
    total = sum((F.col(f"n_{c}") for c in channels), F.lit(0))
    out = out.withColumn("no_grounding", total == 0)
    if outages is None:
        return out.withColumn("flags", F.lit(""))
    sides = F.collect_set("side")
    whole = [F.when(F.size(F.array_except(F.array(*map(F.lit, names)), sides)) == 0, F.lit(c)) for c, names in (of or {}).items()]
    said = outages.groupBy("question_id").agg(F.array_join(F.array_sort(F.transform(F.array_compact(F.concat(sides, F.array(*whole))), lambda x: F.concat(x, F.lit("_unavailable")))), ",").alias("flags"))
    return out.join(said, "question_id", "left").fillna("", ["flags"])


def retrieval_quality(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """Recall, precision, over-fetch and missing per scenario; gold: scenario, category, id."""
    r = retrieved.select("scenario", "id").distinct().withColumn("_r", F.lit(1))
    g = gold.select("scenario", "category", "id").distinct().withColumn("_g", F.lit(1))
    cat = gold.select("scenario", "category").distinct()
    j = g.drop("category").join(r, ["scenario", "id"], "full_outer").groupBy("scenario").agg(F.count("_g").alias("n_gold"), F.count("_r").alias("n_retrieved"), F.count_if(F.col("_g").isNotNull() & F.col("_r").isNotNull()).alias("n_hit"))
    j = cat.join(j, "scenario")
    return j.select("scenario", "category", F.round(F.when(F.col("n_gold") > 0, F.col("n_hit") / F.col("n_gold")), 6).alias("recall"), F.round(F.when(F.col("n_retrieved") > 0, F.col("n_hit") / F.col("n_retrieved")), 6).alias("precision"), (F.col("n_retrieved") - F.col("n_hit")).alias("over_fetch"), (F.col("n_gold") - F.col("n_hit")).alias("missing"))
