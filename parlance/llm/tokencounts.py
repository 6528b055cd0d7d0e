"""Token counts of whole texts from a two-tier table of pre-token lengths; no shuffle of pre-tokens.

A byte-level tokenizer cuts a text into pre-tokens and encodes each alone, so a text's count
is the sum of its pre-tokens' lengths in tokens.  Tier one is a hash table of the
FREQUENT_WORDS most frequent pre-tokens of a bounded sample, counted and encoded on the executors
and broadcast in packed form (one block of UTF-8, one of line ends, one byte a length).  Tier two
is a cache of each partition's misses in two generations; what neither tier knows is merged by the
library.  The sample decides only how often tier one is hit, never a count.

Texts are cut by the tokenizer's published pattern.  Unicode classes of late additions differ
between libraries, so a text with a character outside STABLE is counted by the library as a whole.
Strings of special tokens are one token each, wherever they stand, as is the library's default.

Defined cases: null text counts as empty, an empty text has no bytes and no tokens; a null id is
kept as null; repeated rows give repeated results; one word of any length is one pre-token; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import arrow_stream, bounded_sample

#: Rows of the sample that tier one is counted on, the bytes of it that one partition may read, its partitions, and the entries of tier one.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_PARTITIONS, FREQUENT_WORDS = 2_000, 4 << 20, 4, 32_768
#: Words in each generation of a partition's cache, and the longest of them.
CACHE_WORDS, CACHED_LENGTH = 200_000, 40
#: More tokens than this are over the limit.
LIMIT = 1024
# The published pattern of the vocabulary's pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class no library disputes: old blocks of Latin, Greek, Cyrillic, punctuation, symbols, CJK, Hangul, full width.
STABLE = regex.compile("[\\x00-՗ -⁤₠-₿℀-↋←-⏿─-➿　-䶵一-龥가-힣＀-￯\U0001f300-\U0001f64f]*")
_TOKENIZERS: dict[str, ByteTokenizer] = {}


class ByteTokenizer:
    """One worker's copy of a byte-level tokenizer, with its pre-token pattern and its added strings."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]):
            raise ValueError("only plain byte-level tokenizers encode their pre-tokens one by one")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added)) or r"(?!)")
        self.words_of = regex.compile(PATTERN).findall
        self.merge, self.letters = self.library.model.tokenize, byte_letters()

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def length(self, word: str) -> int:
        """Tokens of one pre-token, by the library's merges alone."""
        return len(self.merge(word.encode().decode("latin-1").translate(self.letters)))

    def parts(self, text: str) -> tuple[int, list[str]] | None:
        """The added strings' number and the texts between them; None if the library has to count the whole."""
        if not STABLE.fullmatch(text):
            return None
        found = self.added.split(text)
        return len(found) - 1, found


def tokenizer(path: str) -> ByteTokenizer:
    """The worker's tokenizer at ``path``, read once."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteTokenizer(path)
    return _TOKENIZERS[path]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in prints else next(others)) for b in range(256)}


@dataclass(frozen=True)
class PackedLengths:
    """Words and their lengths in three blocks: bounded by FREQUENT_WORDS words of CACHED_LENGTH characters."""

    words: bytes
    ends: bytes
    sizes: bytes

    @classmethod
    def of(cls, pairs: list[tuple[str, int]]) -> PackedLengths:
        coded = [w.encode() for w, _ in pairs]
        return cls(b"".join(coded), np.cumsum([len(c) for c in coded], dtype=np.uint32).tobytes(), np.array([n for _, n in pairs], dtype=np.uint8).tobytes())

    def pairs(self):
        ends = np.frombuffer(self.ends, dtype=np.uint32).tolist()
        return zip((self.words[a:b].decode() for a, b in zip([0, *ends], ends)), self.sizes, strict=True)


class Lengths(dict):
    """Tier one as a dict; a miss is looked for in tier two, then encoded."""

    def __init__(self, packed: PackedLengths, model: ByteTokenizer):
        super().__init__(packed.pairs())
        self.model, self.young, self.old, self.encoded = model, {}, {}, 0

    def __missing__(self, word: str) -> int:
        n = self.young.get(word)
        if n is None:
            n = self.old.get(word)
            if n is None:
                n, self.encoded = self.model.length(word), self.encoded + 1
            self.keep(word, n)
        return n

    def keep(self, word: str, n: int) -> None:
        if len(word) <= CACHED_LENGTH:
            if len(self.young) >= CACHE_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = n

    def count(self, text: str) -> int:
        parts = self.model.parts(text)
        if parts is None:
            return self.model.whole(text)
        specials, rest = parts
        return specials + sum(sum(map(self.__getitem__, self.model.words_of(x))) for x in rest)


def fit_lengths(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> PackedLengths:
    """The most frequent pre-tokens of a bounded sample with their lengths.

    Each of SAMPLE_PARTITIONS partitions counts whole texts of the sample until it has read SAMPLE_BYTES and
    sends at most FREQUENT_WORDS words, so the driver merges a bounded table.
    """

    def run(parts):
        model, counts, read = tokenizer(path), Counter(), 0
        for b in parts:
            for t in b.column(0).to_pylist():
                if t and read < SAMPLE_BYTES and (cut := model.parts(t)):
                    read += len(t.encode())
                    for x in cut[1]:
                        counts.update(w for w in model.words_of(x) if len(w) <= CACHED_LENGTH)
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT_WORDS]
        yield {"word": [w for w, _ in top], "times": [n for _, n in top], "size": [model.length(w) for w, _ in top]}

    rows = bounded_sample(docs.select(key, text), SAMPLE_ROWS, key).repartition(SAMPLE_PARTITIONS)
    times, size = Counter(), {}
    for r in arrow_stream(rows, "word string, times long, size int", run, F.col(text).alias("t")).collect():
        times[r.word] += r.times
        size[r.word] = r.size
    top = sorted(times.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT_WORDS]
    return PackedLengths.of([(w, size[w]) for w, _ in top])


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``: one row per row of ``docs``, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_lengths(docs, path, key, text))

    def run(parts):
        lengths = Lengths(shared.value, tokenizer(path))
        for b in parts:
            found = [lengths.count(t) if t else 0 for t in b.column(2).to_pylist()]
            yield {"doc_id": b.column(0), "n_bytes": b.column(1), "n_tokens": found}

    out = arrow_stream(docs, "doc_id long, n_bytes long, n_tokens long", run, F.col(key).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("t"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
