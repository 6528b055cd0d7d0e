"""Token counts against the library itself."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.llm import tokencounts as K

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\r\n", "\t", "a", "Zeta", "'s", "'ll", "'", "1", "2024", "é", "ß", "Ж", "漢字", "😀", "\xa0", " ", "!", "...", "<|endoftext|>", "<|endo", "՘", "\x85", "\x1c", "᠎", "é", "﻿", "٣", "½", "​", "　", "\U0001246f"]


def texts():
    r = random.Random(5)
    made = ["".join(r.choices(PARTS, k=r.randrange(40))) for _ in range(400)]
    return [*made, None, "", " ", "x" * 200_000, "word " * 60_000, made[0], "<|endoftext|>" * 3, "a" * 300 + " b" * 1024]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 7 else i // 2 if i % 9 == 0 else i, t) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("t", "n_bytes", "n_tokens", "word", "times", "size")})


def test_counts_equal_the_library(docs, spark):
    model = tokenizers.Tokenizer.from_file(PATH)
    want = sorted((-1 if i == 7 else i // 2 if i % 9 == 0 else i, len((t or "").encode()), n := len(model.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in enumerate(texts()))
    out = K.token_counts(docs, PATH)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()) == want
    assert K.token_counts(docs.where("false"), PATH).count() == 0
    assert sum(r.over_limit for r in K.token_counts(docs, PATH, limit=10).collect()) == sum(w[2] > 10 for w in want)


def test_tiers_do_not_change_counts(monkeypatch):
    """With an empty, a small and a full first tier, and with a second that holds three words."""
    model = K.tokenizer(PATH)
    some = [t for t in texts() if t]
    want = [model.whole(t) for t in some]
    words = sorted({w for t in some for w in (model.words_of(t) if model.parts(t) else ()) if len(w) <= K.CACHED_LENGTH})
    for share in ([], words[::3], words):
        packed = K.PackedLengths.of([(w, model.length(w)) for w in share])
        assert list(packed.pairs()) == [(w, model.length(w)) for w in share]
        for cache in (3, 10**6):
            monkeypatch.setattr(K, "CACHE_WORDS", cache)
            lengths = K.Lengths(packed, model)
            assert [lengths.count(t) for t in some] == want
            assert len(lengths.young) <= cache and len(lengths.old) <= cache
    assert K.Lengths(K.PackedLengths.of([(w, model.length(w)) for w in words]), model).encoded == 0


def test_first_tier_is_bounded_and_most_frequent(spark, monkeypatch):
    monkeypatch.setattr(K, "FREQUENT_WORDS", 2)
    docs = spark.createDataFrame([(i, "cat cat dog" if i % 2 else "cat bird") for i in range(50)], "doc_id long, text string")
    found = dict(K.fit_lengths(docs, PATH).pairs())
    assert len(found) == 2 and "cat" in found


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        K.ByteTokenizer(P.path("word_bpe_49k.json"))
