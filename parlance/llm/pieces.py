"""SentencePiece (merge type) encoding with a prefix table.

For every prefix of a word the merge process leaves exactly one token at its end.  An
automaton lists the pieces that end at a position; the one that can stand beside the
last token of the prefix before it (a pair-compatibility test) is stored in the table,
and the ids are recovered backwards from the end of the word.

Two tokens are compatible when merging their joined text would not cross their border.
Each piece has one merge tree, so it is enough to look at the right spine of the left
token and the left spine of the right one: a crossing merge happens when it ranks before
the merges that use up both of its sides (on the left side strictly, as equal merges are
done from left to right).

A text is first cut before each run of spaces, around line ends and between a letter and
``. , !``: no piece spans such a cut (checked for the model), so the words are encoded alone
and their results are kept in a bounded cache.

Defined cases: null text counts as empty; an empty text has no tokens and decodes to the
empty text; characters without a piece become byte pieces; words of any length are
handled in one pass; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import arrow_map, arrow_stream, sha256_hex

SPACE = "▁"
#: Words kept in each of a partition's two generations of cached words, the longest of them; pairs kept by a worker.
CACHE_WORDS, CACHED_LENGTH, CACHE_PAIRS = 100_000, 40, 200_000
_WORDS = re.compile(f"{SPACE}*[A-Za-zÀ-ɏ]+(?=[.,!{SPACE}\n]|$)|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_MODELS: dict[str, PieceTable] = {}


class PieceTable:
    """Encoder and decoder of one model; holds its pieces, merge trees and automaton."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        odd = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.byte_id = {int(self.piece[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.id_of = {p: i for i, p in enumerate(self.piece) if not odd[i]}
        score = sorted({sp.get_score(i) for i in self.id_of.values()}, reverse=True)
        place = {s: k for k, s in enumerate(score)}
        self.rank = {i: place[sp.get_score(i)] for i in self.id_of.values()}
        self.tree: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        whole = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p, i in self.id_of.items():
            parts = self._by_merging(p)
            if parts is None:
                continue  # never left by the merge process
            if parts:
                self.tree[i] = parts
                self.merge[parts] = i
            whole.add_word(p, i)
        #: pieces that do not rank after their own parts (runs of spaces share one rank): their pairs are merged out
        self.level = {i for i, parts in self.tree.items() if any(x in self.tree and self.rank[x] >= self.rank[i] for x in parts)}
        self.level |= {x for i in self.level for x in self.tree[i]}
        whole.make_automaton()
        self.length = list(map(len, self.piece))
        self.said = list(map(str, range(n)))
        self.ending_at = whole
        if any(SPACE in p.strip(SPACE) or p.strip(SPACE) != p.lstrip(SPACE) or "\n" in p or re.search("[A-Za-zÀ-ɏ][.,!]", p) for p in self.id_of):
            raise ValueError("this model has pieces over several words")
        self.spine: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.text_of = [bytes([int(self.piece[i][3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else self.piece[i].replace(SPACE, " ").encode() for i in range(n)]

    def _merged(self, text: str) -> list[list[str]]:
        """What merging the letters of a short text leaves, with the state before the last merge in front."""
        parts, before = list(text), []
        while len(parts) > 1:
            found = [(self.rank[i], k) for k in range(len(parts) - 1) if (i := self.id_of.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                break
            k = min(found)[1]
            before = parts.copy()
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [before, parts]

    def _by_merging(self, text: str) -> tuple[int, int] | tuple[()] | None:
        """The last two parts that merge to the piece ``text``; () for a letter, None if merging leaves more."""
        before, left = self._merged(text)
        if len(left) > 1 or before and not all(x in self.id_of for x in before):
            return None
        return (self.id_of[before[0]], self.id_of[before[1]]) if before else ()

    def _spine(self, i: int, right: bool) -> list[tuple[int, int]]:
        """``(part, rank of the merge that uses it up)`` down one side of a merge tree."""
        out, used = [], len(self.piece) + 1
        while True:
            out.append((i, used))
            if i not in self.tree:
                return out
            used, i = self.rank[i], self.tree[i][int(right)]

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get(left << 20 | right)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            a = self.spine.get((left, True)) or self.spine.setdefault((left, True), self._spine(left, True))
            b = self.spine.get((right, False)) or self.spine.setdefault((right, False), self._spine(right, False))
            known = True
            if left in self.level and right in self.level:
                known = self._merged(self.piece[left] + self.piece[right])[1] == [self.piece[left], self.piece[right]]
                a = []
            for x, x_used in a:
                for y, y_used in b:
                    z = self.merge.get((x, y))
                    if z is not None and self.rank[z] < x_used and self.rank[z] <= y_used:
                        known = False
            self.pairs[left << 20 | right] = known
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word (spaces written as the space mark), by the prefix table."""
        n = len(word)
        last = [-1] * (n + 1)  # id of the last token of each prefix; stays -1 after a letter without a piece
        pairs, length = self.pairs, self.length
        for end, i in self.ending_at.iter(word):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - length[i]]
            if before < 0:
                last[end] = i
            else:
                ok = pairs.get(before << 20 | i)
                if ok is None:
                    ok = self.compatible(before, i)
                if ok:
                    last[end] = i
        ids = []
        while n:
            i = last[n]
            if i < 0:
                n -= 1
                ids += [self.byte_id[x] for x in reversed(word[n].encode("utf-8", "surrogatepass"))]
            else:
                ids.append(i)
                n -= length[i]
        ids.reverse()
        return ids

    def words_of(self, text: str) -> list[str]:
        return _WORDS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> list[int]:
        """All ids of a whole text, without begin or end ids."""
        return [i for w in self.words_of(text or "") for i in self.encode_word(w)]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.text_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, byte pieces as UTF-8, the one leading space dropped."""
        text = self.decode_bytes(ids).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class KnownWords:
    """A partition's words with what encoding and decoding gave; two generations, so that frequent words stay."""

    def __init__(self, table: PieceTable):
        self.table = table
        self.words: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def word(self, word: str) -> tuple[int, str, str]:
        """``(number of ids, ids as text, decoded text)`` of one word."""
        got = self.older.get(word)
        if got is None:
            ids = self.table.encode_word(word)
            got = (len(ids), ",".join(map(self.table.said.__getitem__, ids)), self.table.decode_bytes(ids).decode("utf-8", "replace"))
        if len(word) <= CACHED_LENGTH:
            if len(self.words) >= CACHE_WORDS:
                self.older = self.words.copy()
                self.words.clear()  # callers hold its get
            self.words[word] = got
        return got


def model(path: str) -> PieceTable:
    """The worker's table of the model at ``path``, built once."""
    if path not in _MODELS:
        _MODELS[path] = PieceTable(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``ids array<int>``, ``decoded string``."""

    def run(cols):
        m = model(path)
        ids = [m.encode(t) for t in cols["t"]]
        return {"k": cols["k"], "ids": ids, "decoded": [m.decode(i) for i in ids]}

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs, f"k {kind}, ids array<int>, decoded string", run, F.col(key).alias("k"), F.col(text).alias("t")).withColumnRenamed("k", key)


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """The query's columns; each word's ids and decoded text come from the partition's cache of words."""

    def run(parts):
        m = model(path)
        known = KnownWords(m)
        get, miss = known.words.get, known.word
        for b in parts:
            out = {"doc_id": b.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in b.column(1).to_pylist():
                found = [get(w) or miss(w) for w in m.words_of(t or "")]
                decoded = "".join([p[2] for p in found])
                out["n_tokens"].append(sum([p[0] for p in found]))
                out["ids_sha256"].append(sha256_hex(",".join([p[1] for p in found])))
                out["decoded_sha256"].append(sha256_hex(decoded[1:] if decoded.startswith(" ") else decoded))
            yield out

    return arrow_stream(docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", run, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"))
