"""Lempel-Ziv phrase fingerprints.

A text (as UTF-8) is parsed into dictionary phrases: each phrase is the longest one known
so far, plus one byte.  The set of phrase hashes is summarised by its minimum under
SLOTS hash functions; two fingerprints are as alike as their share of equal slots.

A text and its edited form share their first part, so they are parsed together up to there.
Documents are dealt into ranges of ascending id by borders from a bounded sample of ids;
the first document of a range is also sent to the range before, as its last neighbour.

Defined cases: null text counts as empty; an empty text has no phrase (all slots are the
``ffff`` mark; alike only to another empty text); with one document the next document is
itself; documents with one id follow each other by text; rows without an id come first;
repeated rows give repeated results; other columns are ignored.  One dictionary serves a whole
text of any length: beyond DICT_PHRASES phrases it moves, as it is, into a table of about 30 bytes a phrase.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import arrow_stream, bounded_sample, sha256_hex

SLOTS, DICT_PHRASES, SAMPLE_IDS = 64, 1 << 20, 50_000
_rng = np.random.default_rng(20_240_601)
_A = _rng.integers(1, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
_NONE = np.full(SLOTS, np.iinfo(np.uint64).max)
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


#: Base of the hash of a byte string, and its inverse modulo 2^64.
_P = np.uint64(0xD6E8FEB86659FD93)
_P_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_CHUNK = 1 << 16


class PhraseTable:
    """An open-addressing table from keys to the numbers 1, 2, 3 ..., in the order in which they are put; the last can be taken out again."""

    def __init__(self, keys):
        self.keys = array("Q")
        self._grow(4 << max(8, len(keys).bit_length()), list(keys))

    def __len__(self) -> int:
        return len(self.keys)

    def _grow(self, slots: int, keys) -> None:
        self.mask, self.slots = slots - 1, array("I", bytes(4 * slots))
        self.keys = array("Q")
        for k in keys:
            self[k] = len(self.keys) + 1

    def _slot(self, key: int) -> int:
        """Where a key is, or would be put."""
        slots, keys, mask = self.slots, self.keys, self.mask
        at = (key * 0x9E3779B97F4A7C15 >> 29) & mask
        while (n := slots[at]) and keys[n - 1] != key:
            at = at + 1 & mask
        return at

    def get(self, key: int, default: int = 0) -> int:
        return self.slots[self._slot(key)] or default

    def __setitem__(self, key: int, n: int) -> None:
        if 2 * n > self.mask:
            self._grow(2 * self.mask + 2, self.keys)
        self.slots[self._slot(key)] = n
        self.keys.append(key)

    def popitem(self) -> None:
        # no other key was put past this slot while it was taken: the last one leaves no gap
        self.slots[self._slot(self.keys[-1])] = 0
        self.keys.pop()


class Parse:
    """The state of a parse: children by (node, byte), numbered in the order of their phrases, and the node of the open phrase."""

    def __init__(self):
        self.child: dict[int, int] | PhraseTable = {}
        self.node = 0

    def feed(self, data: bytes, start: int = 0) -> list[int]:
        """Where the phrases completed by ``data[start:]`` end."""
        node, ends = self.node, []
        add = ends.append
        for at in range(start, len(data), _CHUNK):
            child = self.child
            if len(child) > DICT_PHRASES and isinstance(child, dict):
                child = self.child = PhraseTable(child)
            get, n = child.get, len(child)
            for i, c in enumerate(data[at : at + _CHUNK], at + 1):
                k = node << 8 | c
                node = get(k, 0)
                if not node:
                    n += 1
                    child[k] = n
                    add(i)
        self.node = node
        return ends

    def fork(self, data: bytes, start: int) -> list[int]:
        """Like feed, but the state stays as it was."""
        size, node = len(self.child), self.node
        ends = self.feed(data, start)
        for _ in range(len(self.child) - size):
            self.child.popitem()
        self.node = node
        return ends


def phrase_hashes(data: bytes, ends: list[int], first: int = 0) -> np.ndarray:
    """Hashes of the phrases that end at ``ends``; the first of them starts at ``first``."""
    stop = np.array(ends, np.int64)
    if not len(stop):
        return np.zeros(0, np.uint64)
    start = np.concatenate(([first], stop[:-1]))
    part = np.frombuffer(data, np.uint8, int(stop[-1]) - first, first).astype(np.uint64) + np.uint64(1)
    up = np.cumprod(np.full(len(part), _P))
    total = np.concatenate(([np.uint64(0)], np.cumsum(part * up)))
    down = np.cumprod(np.full(len(part) + 1, _P_INV))
    h = (total[stop - first] - total[start - first]) * down[start - first] + (stop - start).astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def minima(h: np.ndarray) -> np.ndarray:
    """The smallest value of the phrase set under each hash function."""
    best = _NONE.copy()
    for i in range(0, len(h), 2048):
        best = np.minimum(best, (h[i : i + 2048] * _A[:, None] + _B[:, None]).min(1))
    return best


def _slots(best: np.ndarray) -> np.ndarray:
    mixed = ((best ^ (best >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(48)
    return np.where(best == _NONE, np.uint64(0xFFFF), np.minimum(mixed, np.uint64(0xFFFE))).astype(np.uint16)


def fingerprint(text: str | None) -> np.ndarray:
    """SLOTS 16-bit values of a whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return _slots(minima(phrase_hashes(data, Parse().feed(data))))


def both(text: str, edited: str, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of two texts that agree in their first ``shared`` characters."""
    p = Parse()
    head, data, other = (x.encode("utf-8", "surrogatepass") for x in (text[:shared], text, edited))
    ends = p.feed(head)
    first = ends[-1] if ends else 0
    best = minima(phrase_hashes(head, ends))
    other_best = minima(phrase_hashes(other, p.fork(other, len(head)), first))
    own_best = minima(phrase_hashes(data, p.feed(data, len(head)), first))
    return _slots(np.minimum(best, own_best)), _slots(np.minimum(best, other_best))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited_text(text: str, following: str) -> tuple[str, int]:
    """The last quarter replaced by the start of the next document; how many characters stay."""
    n = len(text) // 4
    keep = len(text) - n
    return text[:keep] + following[:n], keep


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """``(range, tail, doc_id, text)`` by range and ascending id; a tail row holds the first document after its range."""
    n = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = -(2**63)
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("o"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = sorted(r.o for r in bounded_sample(d.select("o"), SAMPLE_IDS, "o").collect())
    borders = sorted({ids[len(ids) * i // n] for i in range(1, n)}) if ids else []

    @F.pandas_udf("int")
    def place(o: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(borders, np.int64), o.to_numpy(), side="right").astype(np.int32))

    # one row per range
    firsts = sorted((r.p, r.o) for r in d.select("o", place("o").alias("p")).groupBy("p").agg(F.min("o").alias("o")).collect())
    used = [p for p, _ in firsts]
    before = {o: used[(i - 1) % len(used)] for i, (_, o) in enumerate(firsts)}

    @F.pandas_udf("array<struct<range:int,tail:int>>")
    def places(o: pd.Series) -> pd.Series:
        return pd.Series([[{"range": bisect_right(borders, x), "tail": 0}] + ([{"range": before[x], "tail": 1}] if x in before else []) for x in o])

    placed = d.select(F.explode(places("o")).alias("at"), "o", "doc_id", "text").select("at.range", "at.tail", "o", "doc_id", "text")
    return placed.repartitionById(n, F.col("range")).sortWithinPartitions("range", "tail", "o", "text").drop("o")


def phrase_table(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    names = [x.split()[0] for x in DDL.split(", ")]

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        out = {k: [] for k in names}
        held = None  # the document before, waiting for its neighbour
        done = None  # the range whose tail has been used

        def finish(held, text, print_of_next):
            _, doc_id, own = held
            edited, keep = edited_text(own, text)
            a, b = both(own, edited, keep)
            for k, v in zip(names, (doc_id, len(own), sha256_hex(edited), a.astype(">u2").tobytes().hex(), b.astype(">u2").tobytes().hex(), likeness(a, b), print_of_next), strict=True):
                out[k].append(v)
            return a

        waiting = None  # a row whose near_next needs the print of the row after it
        for where, tail, doc_id, text in rows():
            if tail and done == where:
                continue
            if held is not None and held[0] == where:
                a = finish(held, text, None)
                if waiting is not None:
                    out["near_next"][waiting[0]] = likeness(waiting[1], a)
                waiting = (len(out["doc_id"]) - 1, a)
            if tail:
                done = where
                if waiting is not None:
                    out["near_next"][waiting[0]] = likeness(waiting[1], fingerprint(text))
                held = waiting = None
                if len(out["doc_id"]) >= 256:
                    yield out
                    out = {k: [] for k in names}
            else:
                held = (where, doc_id, text)
                if len(out["doc_id"]) >= 1024 and waiting is not None:  # keep only the waiting row
                    ready = {k: v[:-1] for k, v in out.items()}
                    out = {k: v[-1:] for k, v in out.items()}
                    waiting = (0, waiting[1])
                    yield ready
        yield out

    return arrow_stream(with_next(docs.select("doc_id", "text")), DDL, run, "range", "tail", "doc_id", "text")
