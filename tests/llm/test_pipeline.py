"""The pipeline over a small table: what each stage drops or changes, and an empty table."""

import hashlib
import random

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

EN, DE = ["house", "and", "not", "street", "nice", "window", "green"], ["haus", "und", "nicht", "strasse", "fenster", "gruen", "wetter"]


def prose(seed, words, n=80):
    return " ".join(random.Random(seed).choices(words, k=n))


def write(spark, folder, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline(spark, tmp_path):
    import sentencepiece
    import public_tokenizers

    texts = [prose(i, EN if i % 2 else DE) for i in range(40)]
    item = prose(99, EN, 30)
    extra = [None, "12 34", texts[1], texts[2] + " extra", prose(77, EN) + " " + item + " " + prose(78, EN), prose(55, EN) + " password=abcdef123456 " + prose(56, EN)]
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(texts + extra)]
    path = write(spark, tmp_path, rows, [(1, item), (2, None)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert set(range(46)) - set(seen["language"]) == {40, 41}
    assert set(seen["language"]) - set(seen["near_copies"]) == {42, 43}
    assert set(seen["near_copies"]) - set(seen["decontaminate"]) == {44}
    assert "[SECRET]" in seen["secrets"][45].text and seen["secrets"][45].n_chars == len(seen["secrets"][45].text)
    assert seen["secrets"][0].text == texts[0]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(out) == set(seen["secrets"])
    for i, r in out.items():
        ids = lib.encode(seen["secrets"][i].text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_pipeline_of_long_and_repeated_texts_and_extra_columns(spark, tmp_path):
    texts = [prose(i, EN if i % 2 else DE) for i in range(20)] + [prose(50, EN, 60_000)]
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t), "clash", 1.0) for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, lang string, source string, n_chars long, found string, lang_score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(99, EN, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted([*range(21), 3])  # rows of one id are one document


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [], [])).count() == 0
