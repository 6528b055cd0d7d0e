"""The local parts of the operators, against the library they equal or a brute-force version."""

import math
import random
import unicodedata
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parlance.llm import language, nearcopies, pieces, phrases, quality, repeats, secrets, urls, warc

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = P.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"aberthin .,!\n\t\r_é中🙂▁=01\x00\xa0", "  ", "the", " the", "ing"]), max_size=60).map("".join))
def test_pieces_equal_the_library(text):
    m = pieces.model(PATH)
    ids = m.encode(text)
    assert ids == LIB.encode(text)
    assert m.decode(ids) == LIB.decode(ids)


@pytest.mark.parametrize("text", ["", " ", "\n", "a" * 5000, " " * 70 + "x", "ab " * 2000, "▁▁x", "E!! É.com x.com"])
def test_pieces_odd_texts(text):
    m = pieces.model(PATH)
    assert m.encode(text) == LIB.encode(text)
    assert m.decode(m.encode(text)) == LIB.decode(LIB.encode(text))
    joined = [pieces.KnownWords(m).word(w) for w in m.words_of(text)]
    assert [int(i) for j in joined for i in j[1].split(",")] == LIB.encode(text)


def _base(text):
    out = []
    for k, (pattern, size) in enumerate(((secrets.ASSIGN, 6), ("AKIA[A-Z0-9]+", 20), ("[0-9a-f]+", 24))):
        for m in re.finditer(pattern, text, re.ASCII | (re.IGNORECASE if k == 0 else 0)):
            if len(m[2] if k == 0 else m[0]) >= size:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "API_KEY", "apikey", "toKen", "ſecret", "İ", ":", "=", " ", '"', "'", "abc", "0123456789abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "z", "\n", "+/"]), max_size=14).map("".join))
def test_rule_spans(text):
    assert secrets.base_spans(text) == _base(text)


def test_markov_tells_random_from_words():
    llr = np.zeros((secrets.SIZE, secrets.SIZE))
    rng = random.Random(5)
    words = ["internationalisation", "getElementByIdentifier", "some-long-path-name", "configuration_value"]
    seen = np.full((2, secrets.SIZE, secrets.SIZE), 0.05)
    for w in words * 50:
        c = secrets._CODE[np.frombuffer(w.encode(), np.uint8)]
        np.add.at(seen[0], (c[:-1], c[1:]), 1)
    for _ in range(2000):
        c = secrets._CODE[np.frombuffer("".join(rng.choices(secrets.ALPHABET[:62], k=24)).encode(), np.uint8)]
        np.add.at(seen[1], (c[:-1], c[1:]), 1)
    p = np.log(seen / seen.sum(2, keepdims=True))
    llr = p[1] - p[0]
    key = "".join(rng.choices(secrets.ALPHABET[:62], k=32))
    text = f"see getElementByIdentifier and {key} or internationalisation"
    at = text.index(key)
    assert secrets.spans_of(text, llr) == [(at, 3, at + 32)]
    assert secrets.spans_of(None, llr) == []


def test_what_rule_spans_leave_of_a_run_is_scored():
    llr = np.ones((secrets.SIZE, secrets.SIZE))  # every run of 16 characters is a secret
    access, key = "AKIA" + "Q7" * 8, "k3Jx" * 10
    assert secrets.spans_of(f"{access}/{key}", llr) == [(0, 1, 20), (20, 3, 61)]
    assert secrets.spans_of(f"{key}_token=abcdef", llr) == [(0, 3, 41), (41, 0, 53)]
    assert secrets.spans_of(f"{access}/short", llr) == [(0, 1, 20)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcé ", max_size=200), st.text(alphabet="abcé ", max_size=80), st.integers(0, 200))
def test_phrase_fork_equals_a_fresh_parse(text, tail, cut):
    cut = min(cut, len(text))
    edited = text[:cut] + tail
    a, b = phrases.both(text, edited, cut)
    assert (a == phrases.fingerprint(text)).all() and (b == phrases.fingerprint(edited)).all()


def plain_fingerprint(text):
    """Independent version: phrases as byte strings, hashes and minima in Python integers."""
    known, phrase, found = {b""}, b"", set()
    for c in text.encode():
        phrase += bytes([c])
        if phrase not in known:
            known.add(phrase)
            found.add(phrase)
            phrase = b""
    m, out = 2**64 - 1, []
    hashes = []
    for x in found:
        h = sum((c + 1) * pow(int(phrases._P), k, 2**64) for k, c in enumerate(x)) + len(x) & m
        h = (h ^ h >> 32) * 0xBF58476D1CE4E5B9 & m
        hashes.append(h ^ h >> 29)
    for a, b in zip(phrases._A.tolist(), phrases._B.tolist(), strict=True):
        low = min(((h * a + b) & m for h in hashes), default=m)
        out.append(0xFFFF if low == m else min((low ^ low >> 31) * 0x9FB21C651E98DF25 % 2**64 >> 48, 0xFFFE))
    return out


@pytest.mark.parametrize("limit", [3, 50, 1 << 20])
def test_fingerprint_equals_a_plain_version_and_does_not_depend_on_the_split(monkeypatch, limit):
    """Nor on where the dictionary becomes a table."""
    monkeypatch.setattr(phrases, "DICT_PHRASES", limit)
    monkeypatch.setattr(phrases, "_CHUNK", 64)
    r = random.Random(limit)
    for n in (0, 1, 30, 400, 4000):
        text, tail = ("".join(r.choices("abcdé ", k=k)) for k in (n, n // 3))
        cut = r.randrange(n + 1)
        a, b = phrases.both(text, text[:cut] + tail, cut)
        assert a.tolist() == phrases.fingerprint(text).tolist() == plain_fingerprint(text)
        assert b.tolist() == phrases.fingerprint(text[:cut] + tail).tolist()
    assert phrases.likeness(phrases.fingerprint("abc"), phrases.fingerprint("")) == 0 and phrases.likeness(phrases.fingerprint(None), phrases.fingerprint("")) == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=8).map(sorted), max_size=9))
def test_loser_tree(runs):
    assert list(warc.LoserTree(runs, lambda r: r)) == sorted(x for r in runs for x in r)


def test_archive_of_hostile_payloads():
    import gzip

    body = b"HTTP/1.1 200 OK\r\nContent-Length: 30\r\n\r\nx\r\n\r\nWARC/1.1\r\nWARC-Type: bogus"
    raw = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: \r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    got = list(warc.parse_archive(gzip.compress(raw) + gzip.compress(raw)))
    assert len(got) == 2 and all(bytes(b) == body for _, _, b in got)


def test_sweep_takes_the_longest_rule():
    key = lambda h: ".".join(reversed(h.split("."))) + "." if h else ""
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "", "/bad/")]
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "xexample.com", "net", "a.net", "", "org"]
    rows = [(0, key(h), 0, None, h, p, a) for a, h, p in rules] + [(0, key(h), 1, i, h, p, None) for i, h in enumerate(hosts) for p in ("", "/", "/en/x", "/es/", "/bad/x", "/en")]
    rows.sort(key=lambda r: (r[0], r[1], r[2], r[5]))
    n = 0
    for row, said, verdict in urls.sweep(iter(rows)):
        host, path = row[4], row[5]
        fit = [(len(h + p), h + p, a) for a, h, p in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (said, verdict) == (max(fit)[1:] if fit else (None, "allow"))
        n += 1
    assert n == len(hosts) * 6


def test_shingle_sets():
    f = nearcopies.shingle_set
    assert len(f(None)) == len(f(" \t\n")) == 0
    assert len(f("a b")) == 1 and (f("A b") == f("a\x0bb ")).all() and len(f("a b c d e f")) == 2
    assert len(f("x " * 50)) == 1
    assert (f("é É") != f("é é")).any()  # only A-Z are lower-cased
    words = " ".join(map(str, range(100)))
    assert nearcopies.similar(f(words), f(words + " x")) and not nearcopies.similar(f(words), f(words.replace("50", "x").replace("70", "y").replace("20", "z")))
    s = [f(words), f(words + " x"), f("other words here are not the same"), f("a")]
    both = nearcopies.common_counts(s)
    assert all(both[i, j] == len(np.intersect1d(s[i], s[j])) for i in range(4) for j in range(4))


def test_anchors_are_the_same_in_equal_strings():
    rng = random.Random(3)
    shared = bytes(rng.choices(range(97, 123), k=900))
    a, b = (bytes(rng.choices(range(97, 123), k=k)) + shared + bytes(rng.choices(range(97, 123), k=333)) for k in (500, 777))
    ha, pa, la = repeats.anchors(a)
    hb, pb, lb = repeats.anchors(b)
    inside_a = {int(p) - 500 for p, lo in zip(pa, la, strict=True) if 500 < lo < 500 + 500}
    inside_b = {int(p) - 777 for p, lo in zip(pb, lb, strict=True) if 777 < lo < 777 + 500}
    assert inside_a and inside_a == inside_b
    assert len(repeats.anchors(b"x" * 399)[0]) == 0 and len(repeats.anchors(b"x" * 400)[0]) == 1


def test_anchor_blocks(monkeypatch):
    data = bytes(random.Random(4).choices(range(97, 110), k=5000))
    whole = repeats.anchors(data)
    monkeypatch.setattr(repeats, "_BLOCK", 700)
    assert all((x == y).all() for x, y in zip(whole, repeats.anchors(data), strict=True))


def plain_language(counts, prior, text):
    """Independent version: dictionaries of floats, words found character by character."""
    words, word = [], ""
    for c in text.lower() + " ":
        kind = unicodedata.category(c)[0]
        if kind == "L" or kind == "M" and word:
            word += c
        elif word:
            words.append(word)
            word = ""
    if not words:
        return "und", 0.0
    langs = sorted(prior)
    tables = [{}]
    for g in langs:
        for w, n in counts[g].items():
            tables[0].setdefault(w, dict.fromkeys(langs, 0.1))[g] += n
    for size in (1, 2, 3, 4):
        grams = {}
        for g in langs:
            for w, n in counts[g].items():
                for k in range(len(w) + 3 - size):
                    grams.setdefault(f"<{w}>"[k : k + size], dict.fromkeys(langs, 0.1))[g] += n
        tables.append(grams)
    total = {g: math.log(prior[g] / sum(prior.values())) for g in langs}
    for w in words:
        found = [w] if w in tables[0] else []
        size = 0
        if not found:
            for size in (4, 3, 2, 1):
                if found := [x for k in range(len(w) + 3 - size) if (x := f"<{w}>"[k : k + size]) in tables[size]]:
                    break
        for g in langs:
            mass = sum(v[g] for v in tables[size].values())
            total[g] += sum(math.log(tables[size][x][g] / mass) for x in found) / max(1, len(found)) * min(1, 60 / len(words))
    best = max(langs, key=lambda g: (total[g], [-ord(c) for c in g]))
    return best, 1 / sum(math.exp(v - total[best]) for v in total.values())


def test_language_equals_a_plain_version(monkeypatch):
    monkeypatch.setattr(language, "CACHE_WORDS", 7)
    monkeypatch.setattr(language, "CACHED_LENGTH", 6)
    counts = {"de": {"haus": 5, "und": 9, "schön": 2}, "en": {"house": 5, "and": 9, "nice": 3}, "hi": {"नमस्ते": 4, "है": 6}}
    prior = {"de": 3, "en": 4, "hi": 1}
    m = language.LanguageModel(counts, prior)
    r = random.Random(4)
    letters = "abdehnosuÜéहैनमस्ते½²Ⅷ0_- !"
    for k in range(300):
        text = "".join(r.choices(letters, k=r.randrange(60))) + r.choice(["", " und Haus", " house" * 80, " नमस्ते"])
        got, want = m.predict(text), plain_language(counts, prior, text)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1], rel=1e-3), text


def test_language_of_no_letters_and_of_marks():
    m = language.LanguageModel({"de": {"haus": 5, "und": 9}, "en": {"house": 5, "and": 9}}, {"de": 2, "en": 2})
    assert m.predict("und Haus")[0] == "de" and m.predict("hausen")[0] == "de" and m.predict("houses")[0] == "en"
    assert {m.predict(t) for t in (None, "", "12 !?", "½²", "Ⅷ", "\u0301\u0940", "٣", "_")} == {("und", 0.0)}
    assert language.words_of("नमस्ते दुनिया, x2y ÀB") == ["नमस्ते", "दुनिया", "x", "y", "àb"]
    assert m.predict("zzzz qqqq")[0] in ("de", "en") and language.LanguageModel({}, {}).predict("word") == ("und", 0.0)
    same = language.LanguageModel({"b": {"x": 1}, "a": {"x": 1}}, {"a": 1, "b": 1})
    assert same.predict("x") == ("a", 0.5)


def test_quality_without_enough_labels():
    assert quality.scores(["a", None], quality.fit([]), []) == [0.5, 0.5]
    only = quality.fit([("good text", 1)] * 50)
    assert quality.scores(["a", None], only, []) == [1.0, 1.0]
    few = quality.fit([("good words in here", 1)] * 2 + [("BAD ### $$$", 0)] * 2)  # too little to train on: raw dictionaries
    s = quality.scores(["good words in here", "BAD ### $$$"], few, few.compressors())
    assert s[0] > 0.5 > s[1]


def test_quality_equals_a_plain_version():
    import zstandard

    rng = random.Random(9)
    good = [" ".join(rng.choices(["the", "report", "explains", "findings", "carefully", "and", "results"], k=rng.randrange(20, 900))) for _ in range(80)]
    bad = [" ".join(rng.choices(["BUY!!", "NOW###", "$$$", "CLICK", "zzz@@"], k=rng.randrange(20, 900))) for _ in range(80)]
    m = quality.fit([(t, 1) for t in good] + [(t, 0) for t in bad])
    texts = [*good[:5], *bad[:5], "é" * 5000, "", None]
    s = quality.scores(texts, m, m.compressors())
    assert min(s[:5]) >= 0.7 > max(s[5:10]) and s[11] == s[12] == m.base == 0.5
    assert m.good[0] != m.bad[0]
    for t, got in zip(texts[:11], s, strict=False):
        size = []
        for d, kind in (m.good, m.bad):
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind), write_checksum=False, write_content_size=False, write_dict_id=False)
            data, n = t.encode(), 0
            while data:
                n, data = n + len(c.compress(data[:1024])), data[1024:]
            size.append(n)
        z = m.curve[0] + m.curve[1] * (size[1] - size[0]) / len(t.encode())
        assert got == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))
    # the curve is a calibration: on balanced random texts it says nothing, and it never gets surer than its labels allow
    noise = [("".join(rng.choices("abcdefgh ", k=300)), y) for y in (0, 1) for _ in range(60)]
    m = quality.fit(noise)
    assert all(0.2 < x < 0.8 for x in quality.scores([t for t, _ in noise[1::2]], m, m.compressors()))


def test_slices_are_bounded():
    import pyarrow as pa

    from parlance.llm import common

    b = pa.RecordBatch.from_pydict({"t": ["x" * 3_000_000] * 3 + ["y"] * 5 + ["z" * 9_000_000, None]})
    parts = list(common.slices(iter([b, b.slice(0, 0)])))
    assert [x for p in parts for x in p.column(0).to_pylist()] == b.column(0).to_pylist()
    assert all(p.num_rows == 1 or p.nbytes <= common.BATCH_BYTES for p in parts)
    keyed = pa.RecordBatch.from_pydict({"k": [1, 1, 2, 2, 3], "v": list("abcde")})
    assert list(common.groups_of(iter([keyed.slice(0, 1), keyed.slice(1)]), 1)) == [((1,), [("a",), ("b",)]), ((2,), [("c",), ("d",)]), ((3,), [("e",)])]
    assert list(common.groups_of(iter([]), 1)) == []


def test_free_runs_equal_a_plain_version():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choices("abcdefgh12 ", k=200))
        taken = sorted((a, 0, a + r.randrange(1, 30)) for a in r.sample(range(190), r.randrange(6)))
        want = [m.span() for m in secrets._WORD.finditer(text) if not any(a < m.end() and m.start() < b for a, _, b in taken)]
        assert secrets._free(text, taken, secrets._WORD) == want
