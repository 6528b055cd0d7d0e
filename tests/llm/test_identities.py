"""Documents without ids, and ids with several texts: one answer whatever the order and the partitions, and no clean row lost."""

import random

import pytest

from parlance.llm import decontaminate, language, nearcopies, quality

DDL = "doc_id long, text string"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "so") for b in ("na", "pe", "ri", "to", "vu", "x")]


def prose(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def plain_components(rows):
    """All pairs of nodes (id, text); the texts of one id are one document."""
    nodes = sorted({(i, t) for i, t in rows if i is not None}, key=str)
    sets = {}
    for i, t in nodes:
        w = (t or "").split()
        sets[i, t] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for x in nodes:
        for y in nodes:
            both = sets[x] & sets[y]
            if x[0] == y[0] or (both and 100 * len(both) >= 85 * len(sets[x] | sets[y])):
                root[top(x)] = top(y)
    low = {}
    for n in nodes:
        low[top(n)] = min(low.get(top(n), n[0]), n[0])
    return {n: (len(sets[n]), low[top(n)]) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_one_id_with_several_texts(spark, seed):
    a, b = prose(1, 120), prose(2, 120)
    rows = [(1, a), (1, b), (2, b + " word"), (4, prose(3, 90)), (5, a + " word"), (6, None), (6, prose(4, 80)), (7, prose(4, 80)), (8, ""), (8, "other words"), (9, b), (9, "short one"), (3, "short one"), (3, a), (2, b + " word")]
    want = plain_components(rows)
    none = [(None, a), (None, prose(9, 50))]
    shuffled = random.Random(seed).sample(rows + none, len(rows) + 2)
    d = spark.createDataFrame(shuffled, DDL).repartition(3)
    got = nearcopies.near_components(d).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None) == sorted((i, want[i, t][0], want[i, t][1], want[i, t][1] == i) for i, t in rows)
    assert sorted((r.component_id or 0, r.kept) for r in got if r.doc_id is None) == [(0, True), (1, True)]
    kept = nearcopies.drop_near_copies(d).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted((i or 0, t or "") for i, t in shuffled if i is None or want[i, t][1] == i)


@pytest.mark.parametrize("few", [10**6, 0])
def test_leaks_without_ids_and_with_one_id(spark, monkeypatch, few):
    monkeypatch.setattr(decontaminate, "BROADCAST_PLACES", few)
    item, other = prose(5, 40), prose(6, 40)
    clean = [prose(k, 60) for k in (10, 11, 12)]
    rows = [(None, clean[0]), (None, clean[1]), (None, f"{clean[2]} {item}"), (None, f"{item} {clean[0]}"), (7, clean[2]), (7, item), (8, None), (None, None), (9, f"{other} {prose(13, 9000)}")]
    bench = spark.createDataFrame([("i", item), ("o", other), (None, None)], "item_id string, text string")
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, DDL).repartition(3)
        found = decontaminate.find_leaks(d, bench).collect()
        assert sorted((r.doc_id or 0, r.item_id, r.similarity) for r in found) == [(0, "i", 1.0), (0, "i", 1.0), (7, "i", 1.0), (9, "o", 1.0)]
        kept = {(r.doc_id, r.text) for r in decontaminate.drop_leaks(d, bench).collect()}
        assert kept == {(None, clean[0]), (None, clean[1]), (7, clean[2]), (8, None), (None, None)}


def test_rows_without_ids_are_scored_and_never_learnt(spark):
    rows = [(i, prose(i, 30) if i % 2 else "zzq " + prose(i, 5).upper(), "en" if i % 2 else "de") for i in range(40)] + [(None, prose(50, 30), "xx"), (None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [r for r in language.language_table(d).collect() if r.doc_id is None]
    assert len(got) == 2 and all(r.held_out for r in got) and {r.lang_pred for r in got} == {"en", "und"}
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1)], "doc_id long, quality int")
    got = [r for r in quality.quality_table(d, labels).collect() if r.doc_id is None]
    assert len(got) == 2 and all(r.held_out and 0 <= r.score <= 1 for r in got)


def test_long_texts_keep_their_language(spark):
    """All words decide the language, however long the text; the score stays a probability."""
    rows = [(i, t, g) for i, (t, g) in enumerate([("uno dos tres", "es"), ("one two three", "en")] * 20)]
    m = language.fit(language.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert m.predict("one " * 4000 + "uno " * 6000)[0] == "es" and m.predict("one " * 6000 + "uno " * 4000)[0] == "en"
    for text in ("one", "one " * 100_000, "uno " * 100_000 + "one"):
        assert 0.5 <= m.predict(text)[1] <= 1


def test_fingerprints_of_rows_without_ids(spark):
    """They come first, each with the next as its neighbour; the last of all has the first."""
    from parlance.llm import phrases

    rows = [(None, "bbb " * 30), (None, "aaa " * 30), (2, "ccc " * 30), (1, None)]
    got = phrases.phrase_table(spark.createDataFrame(rows, DDL).repartition(2)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 120), (0, 120), (1, 0), (2, 120)]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_pipeline_stages_keep_clean_rows_without_ids(spark, tmp_path):
    """A benchmark with and without rows; clean rows without ids stay, a leaking one goes alone."""
    import corpus_pipeline as pipeline

    item = prose(5, 40)
    rows = [(None, prose(20, 60)), (None, prose(21, 60)), (None, f"{item} {prose(22, 60)}"), (3, prose(23, 60)), (3, prose(23, 60)), (4, prose(23, 60) + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for n, (items, left) in enumerate((([("i", item)], 2), ([], 3))):
        spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/{n}/benchmark.parquet")
        kept = pipeline.drop_benchmark_leaks(spark, docs, f"{tmp_path}/{n}").collect()
        assert sum(r.doc_id is None for r in kept) == left and sum(r.doc_id is not None for r in kept) == 3
    near = pipeline.drop_near_copies(spark, docs, "").collect()
    assert sum(r.doc_id is None for r in near) == 3 and {r.doc_id for r in near} == {None, 3}
