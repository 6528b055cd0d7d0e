"""Few questions are held by the tasks that score: one pass over what is searched, whatever the batches."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from parlance.operators import enrich, retrieve


@pytest.fixture
def small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def refuse(*_args, **_kw):
    raise AssertionError("not for few questions")


def test_vectors_are_scored_in_one_pass(spark, monkeypatch, small_batches):
    """Ties beyond k, other sizes, nulls, halves at the sixth digit (1/128); no cells for few questions."""
    r = random.Random(4)
    rows = [(f"v{k:03d}", r.choice("ab"), [float(r.randrange(3)) for _ in range(4)]) for k in range(200)]
    rows += [("h1", "a", [1.0, 127.9960936904, 0.0, 0.0]), ("s", "a", [1.0]), ("n", "a", None), ("m", "a", [1.0, None, 0.0, 0.0]), ("x", None, [1.0] * 4)]
    asked = [(1, "a", [1.0, 0.0, 0.0, 0.0]), (2, "b", [1.0, 2.0, 0.0, 1.0]), (3, "a", [2.0]), (4, "c", [1.0] * 4), (5, "a", None)]
    v = spark.createDataFrame(rows, "id string, scope string, vector array<double>").repartition(3)
    q = spark.createDataFrame(asked, "question_id int, scope string, vector array<double>")
    found = lambda rows: {(x.question_id, x.rank): (x.id, x.score) for x in retrieve.vector_top(q, v, 6, rows).collect()}
    with monkeypatch.context() as m:
        m.setattr(retrieve, "HELD_QUESTIONS", 0)
        want = found(10_000)
    monkeypatch.setattr(retrieve, "vector_cells", refuse)
    assert found(20) == want and len(want) == 24


def test_texts_are_scored_in_one_pass(spark, monkeypatch, small_batches):
    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    rows = [(f"f{k:03d}", r.choice("ab"), " ".join(r.choices(words, k=r.randrange(0, 12)))) for k in range(200)] + [("n", "a", None), ("x", None, "w1")]
    asked = [(1, "a", "w0 w7 w29 w0"), (2, "b", "w1, w2?"), (3, "a", ""), (4, "c", "w1"), (5, "b", "nothing")]
    docs = spark.createDataFrame(rows, "id string, scope string, text string").repartition(3)
    q = spark.createDataFrame(asked, "question_id int, scope string, question string")
    found = lambda: {(x.question_id, x.rank): (x.fragment_id, x.score) for x in retrieve.bm25_top(q, docs, "id", "scope", "text", 7).collect()}
    with monkeypatch.context() as m:
        m.setattr(retrieve, "HELD_QUESTIONS", 0)
        want = found()
    monkeypatch.setattr(retrieve, "postings", refuse)
    assert found() == want and {k for k, _ in want} == {1, 2}


def test_fusion_of_what_is_within_reach(spark):
    """Long channels lose only rows that no other channel has and that cannot be among the first."""
    r = random.Random(6)
    rows = []
    for k in range(20):
        rows += [(k, "long", f"f{i:03d}", n + 1) for n, i in enumerate(r.sample(range(300), 200))]
        rows += [(k, "short", f"f{i:03d}", n + 1) for n, i in enumerate(r.sample(range(300), r.choice((0, 3, 20))))]
    ranked = spark.createDataFrame(rows, "question_id int, channel string, fragment_id string, rank int")
    long, short = ranked.where("channel = 'long'"), ranked.where("channel = 'short'")
    kept = retrieve.within_reach(long, short, 5)
    top = lambda x: sorted(map(tuple, retrieve.fuse(x, top=5).collect()))
    assert top(kept.unionByName(short)) == top(ranked) and kept.count() < long.count() / 4


def test_counts_of_joined_texts_are_sums(spark):
    rows = [("u1", 0, "Ab ab, ΟΔΟΣ"), ("u1", 1, "x'y"), ("u2", 0, None), ("u2", 1, "z")]
    t = spark.createDataFrame(rows, "u string, n int, text string")
    got = {x.u: x.vector for x in enrich.summed_vectors(t.withColumn("vector", enrich.hashed_counts(F.col("text"))), ["u"], "vector").collect()}
    texts = defaultdict(list)
    for u, _, x in rows:
        texts[u] += [x] if x else []
    whole = spark.createDataFrame([(u, " ".join(x)) for u, x in texts.items()], "u string, text string")
    assert got == {x.u: x.v for x in whole.select("u", enrich.hashed_counts(F.col("text")).alias("v")).collect()}
    assert Counter(sum(v) for v in got.values()) == {5.0: 1, 1.0: 1}
