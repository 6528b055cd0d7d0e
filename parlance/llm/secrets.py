"""Secret scans: two character Markov models, compared by log-likelihood ratio.

One first-order model is trained on random strings, one on ordinary identifiers and
words.  A run of key characters whose log-likelihood ratio is high is reported as a
``markov`` span; spans of the three rule kinds are always reported as well.

Defined cases: null text counts as empty; an empty text has no spans; repeated rows
give repeated results; a table without rows gives none; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import arrow_map, arrow_stream, arrow_with, bounded_sample

# The rule patterns of the contract.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]+")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_WORD = re.compile(r"[A-Za-z0-9+/_=-]{4,}")

#: Letters of the models; index 0 stands for any other character.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SIZE = len(ALPHABET) + 1
_CODE = np.zeros(256, np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i + 1

#: Documents whose tokens train the models.
SAMPLE_DOCS = 4_000
#: A run is a secret from this log-likelihood ratio on (nats), in sum and per transition.
MIN_LLR, MIN_MEAN = 14.0, 0.6


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind index, end)`` of the rule kinds, leftmost non-overlapping per kind."""
    out = []
    low = text.lower()
    if len(low) != len(text) or any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    for run in _RUN.finditer(text):
        a, b = run.span()
        if b - a >= 20:
            if "AKIA" in run[0]:
                out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text, a, b) if m.end() - m.start() >= 20]
            if b - a >= 24:
                out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text, a, b) if m.end() - m.start() >= 24]
    return sorted(out)


def _free(text: str, taken: list[tuple[int, int, int]], runs: re.Pattern) -> list[tuple[int, int]]:
    """Runs that touch no span in ``taken`` (sorted): what stands beside a secret has no sure label."""
    out, k, reach = [], 0, 0  # reach: the end of all spans that start before the run ends
    for m in runs.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][2])
            k += 1
        if reach <= m.start():
            out.append(m.span())
    return out


def _left(text: str, taken: list[tuple[int, int, int]], runs: re.Pattern) -> list[tuple[int, int]]:
    """Runs in what the spans in ``taken`` leave of the text."""
    out, at = [], 0
    for a, _, b in [*sorted(taken), (len(text), 0, len(text))]:
        if a > at:
            out += [m.span() for m in runs.finditer(text, at, a)]
        at = max(at, b)
    return out


def labelled(text: str | None) -> list[tuple[str, int]]:
    """Values of rule secrets (1), and all other distinct runs of key characters (0)."""
    text = text or ""
    taken = base_spans(text)
    out = [(_ASSIGN.match(text, a)[2] if kind == 0 else text[a:b], 1) for a, kind, b in taken]
    return out + [(w, 0) for w in {text[a:b] for a, b in _free(text, taken, _WORD)}]


def weak_labels(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(value, label)`` rows of all texts."""

    def label(cols):
        rows = [x for t in cols["t"] for x in labelled(t)]
        return {"value": [v for v, _ in rows], "label": [y for _, y in rows]}

    return arrow_map(docs, "value string, label int", label, F.col(text).alias("t"))


def _ratios(rows: DataFrame, samples) -> np.ndarray:
    """Log-likelihood ratio of each transition; samples: ``(value, label)`` pairs of a piece of a partition of ``rows``.

    Executors count transitions; the driver gets at most 2 x SIZE^2 sums.  With no
    sample of a class, its model is uniform.
    """

    def count(parts):
        total = np.zeros((2, SIZE * SIZE), np.int64)
        for b in parts:
            for v, y in samples(b):
                if v and y is not None:
                    c = _CODE[np.frombuffer(v.encode("latin-1", "replace"), np.uint8)]
                    np.add.at(total[int(y > 0)], c[:-1] * SIZE + c[1:], 1)
        y, pair = np.nonzero(total)
        yield {"label": y.tolist(), "pair": pair.tolist(), "n": total[y, pair].tolist()}

    counts = arrow_stream(rows, "label int, pair int, n long", count, *rows.columns).groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    seen = np.full((2, SIZE, SIZE), 0.05)
    for r in counts:
        seen[r.label, r.pair // SIZE, r.pair % SIZE] += r.n
    # the random class also gets a flat share: its strings have no preferred transitions
    seen[1] += seen[1].sum(1, keepdims=True) / SIZE + 1
    p = np.log(seen / seen.sum(2, keepdims=True))
    return p[1] - p[0]


def train(samples: DataFrame) -> np.ndarray:
    """The models from labelled samples, ``(value, label)`` rows; label 1 is random."""
    return _ratios(samples.select("value", "label"), lambda b: zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))


def markov_spans(text: str, taken: list[tuple[int, int, int]], llr: np.ndarray, min_llr: float = MIN_LLR, min_mean: float = MIN_MEAN) -> list[tuple[int, int, int]]:
    """Runs, or what ``taken`` leaves of them, that the random model explains better."""
    out = []
    for a, b in _left(text, taken, _RUN):
        c = _CODE[np.frombuffer(text[a:b].encode("latin-1"), np.uint8)]
        score = float(llr[c[:-1], c[1:]].sum())
        if score >= min_llr and score >= min_mean * (b - a - 1):
            out.append((a, 3, b))
    return out


def spans_of(text: str | None, llr: np.ndarray) -> list[tuple[int, int, int]]:
    """All spans of a whole text, by start, then kind."""
    text = text or ""
    base = base_spans(text)
    return sorted(base + markov_spans(text, base, llr))


def scan_secrets(docs: DataFrame, llr: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, array of spans ``(kind, start, end)`` in code points."""

    def scan(cols):
        found = [spans_of(t, llr) for t in cols["t"]]
        return {"k": cols["k"], "spans": [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in s] for s in found]}

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs, f"k {kind}, spans array<struct<kind:string,start:long,end:long>>", scan, F.col(key).alias("k"), F.col(text).alias("t")).withColumnRenamed("k", key)


def redact_secrets(docs: DataFrame, llr: np.ndarray, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; all columns stay; null text stays null."""

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        out, at = [], 0
        for a, _, b in spans_of(t, llr):
            if b > at:
                out += [t[at:a], mark] if a >= at else []
                at = b
        return "".join([*out, t[at:]])

    return arrow_with(docs, f"{text} string", lambda parts: ({text: list(map(clean, b.column(text).to_pylist()))} for b in parts)).select(*docs.columns)


def fit(docs: DataFrame, key: str = "doc_id", sample_docs: int = SAMPLE_DOCS, text: str = "text") -> np.ndarray:
    """Train on the tokens of a bounded sample of documents, labelled by the rule kinds where they are counted."""
    rows = bounded_sample(docs, sample_docs, key).select(F.col(text).alias("t"))
    return _ratios(rows, lambda b: (x for t in b.column(0).to_pylist() for x in labelled(t)))


def secret_digests(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The query's columns, from the spans of scan_secrets: counts of rule kinds, digest of rule spans, all spans."""
    spans = scan_secrets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, sample_docs=sample_docs))
    said = lambda rows: F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "markov")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select("doc_id", *map(count, KINDS[:3]), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
