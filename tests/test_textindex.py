"""The stored index against the plain scoring of all texts."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import retrieve, textindex

DDL = "fragment_id string, scope string, text string"


def texts(seed, n, first=0):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [(f"f{first + i:04d}", r.choice("ab"), " ".join(r.choices(words, weights=[1 / (k + 1) for k in range(60)], k=r.randrange(1, 40)))) for i in range(n)]


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(1, "a", "w0 w7 w30"), (2, "b", "w1, w2? w59"), (3, "a", "w0 w0 w0"), (4, "b", "nothing here"), (5, "c", "w1"), (6, "a", ""), (7, "b", " ".join(f"w{k}" for k in range(20)))]
    return spark.createDataFrame(rows, "question_id int, scope string, question string")


def rows_of(df):
    return sorted((x.question_id, x.rank, x.fragment_id, round(x.score, 4)) for x in df.collect())


def test_search_equals_scoring_all_texts(spark, tmp_path, asked):
    """With one and with three segments, blocks of four postings and the usual ones; repeated words, empty texts."""
    rows = [*texts(1, 300), ("x1", "a", ""), ("x2", "b", None), ("x3", "a", "w0 " * 500)]
    docs = spark.createDataFrame(rows, DDL)
    want = rows_of(retrieve.bm25_top(asked, docs, "fragment_id", "scope", "text", k=5))
    assert {w[0] for w in want} == {1, 2, 3, 7}
    for name, segments, size in (("one", 1, 4), ("three", 3, 4), ("whole", 1, 128)):
        path = f"{tmp_path}/{name}"
        for k in range(segments):
            part = docs.where(F.pmod(F.xxhash64("fragment_id"), F.lit(segments)) == k)
            for _ in range(2 if k == 1 else 1):  # written again after a failure
                textindex.add_segment(part, path, k, "fragment_id", "scope", "text", size)
        assert rows_of(textindex.search(spark, path, asked, k=5)) == want


def test_blocks_are_skipped_and_segments_touch_their_terms(spark, tmp_path, asked):
    path = f"{tmp_path}/index"
    textindex.add_segment(spark.createDataFrame(texts(2, 900), DDL), path, 0, "fragment_id", "scope", "text", 4)
    q = asked.where("question_id = 3")
    assert textindex.wanted_blocks(spark, path, q, 3).count() < textindex.asked_blocks(spark, path, q).count() / 2
    textindex.add_segment(spark.createDataFrame([("y", "a", "w0 rare")], DDL), path, 1, "fragment_id", "scope", "text")
    new = spark.read.parquet(f"{path}/postings").where("segment = 1")
    assert sorted(x.term for x in new.select("term").collect()) == ["rare", "w0"] and len(list((tmp_path / "index" / "postings" / "segment=1").glob("part=*"))) <= 2
    got = textindex.search(spark, path, spark.createDataFrame([(1, "a", "rare")], asked.schema)).collect()
    assert [x.fragment_id for x in got] == ["y"]


def test_tasks_follow_the_words(spark, tmp_path, asked, monkeypatch):
    """More words to index, or postings to add up, are more tasks; results are the same, held questions or not."""
    docs = spark.createDataFrame(texts(3, 300), DDL)
    want = rows_of(retrieve.bm25_top(asked, docs, "fragment_id", "scope", "text", k=5))
    monkeypatch.setattr(textindex, "TASK_ROWS", 200)
    path = f"{tmp_path}/index"
    textindex.add_segment(docs, path, 0, "fragment_id", "scope", "text", 4)
    words = spark.read.parquet(f"{path}/sizes").agg(F.sum("words")).first()[0]
    tasks = {f.name.split("-")[1] for f in (tmp_path / "index" / "postings").rglob("part-*.parquet")}
    assert words / 200 / 2 < len(tasks) <= words / 200 + 1
    blocks = textindex.asked_blocks(spark, path, asked)
    assert textindex._scored(spark, path, blocks).rdd.getNumPartitions() >= blocks.agg(F.sum("n")).first()[0] / 200
    for held in (50_000, 0):
        monkeypatch.setattr(textindex, "BROADCAST_ROWS", held)
        assert rows_of(textindex.search(spark, path, asked, k=5)) == want
