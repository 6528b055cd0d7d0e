"""Language identification: known words first, then shorter and shorter character n-grams.

Every word adds its log frequency in each language.  A word that training never saw adds
the mean log frequency of its longest character n-grams that training did see.

A word is a letter and the letters and combining marks after it, by their Unicode categories.

Defined cases: a text that is null or has no letter (digits, fractions, numerals and marks
alone are none) is ``und`` with score 0, and so is any text when no labelled row exists;
equal languages go to the first by name; texts of any length are summed in parts; rows with a null label or null text train nothing;
repeated rows count and give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.common import arrow_stream, arrow_with, bounded_sample, fold_of

#: Labelled documents used for the fit, bytes of their texts in each language (all words of these are kept), longest n-gram.
SAMPLE_DOCS, SAMPLE_BYTES, MAX_GRAM = 8_000, 2 << 20, 4
#: The score of a longer text is that of so many of its average words: words of a text are not independent. The language is chosen by all of them.
SCORE_WORDS = 60
#: Words that a partition keeps with their evidence, and the longest of them.
CACHE_WORDS, CACHED_LENGTH = 50_000, 40
_ASCII_WORD, _WORD = re.compile("[a-z]+"), regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str) -> list[str]:
    """The lower-cased words of a text."""
    low = text.lower()
    return (_ASCII_WORD if low.isascii() else _WORD).findall(low)


class LanguageModel:
    """Log frequencies of words and n-grams; built on the driver from a bounded word table."""

    def __init__(self, counts: dict[str, dict[str, int]], prior: dict[str, int]):
        self.langs = sorted(prior)
        k = len(self.langs)
        words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
        grams: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(k)) for _ in range(MAX_GRAM + 1)]
        for j, lang in enumerate(self.langs):
            for w, n in counts.get(lang, {}).items():
                words[w][j] += n
                for size in range(1, MAX_GRAM + 1):
                    for g in self.grams(w, size):
                        grams[size][g][j] += n
        #: rows of the table of log frequencies, by word and by n-gram of each size
        self.words: dict[str, int] = {}
        self.by_size: list[dict[str, int]] = [{} for _ in grams]
        tables = [self._logs(words, self.words, 0)]
        for known, index in zip(grams, self.by_size, strict=True):
            tables.append(self._logs(known, index, sum(map(len, tables))))
        self.table = np.concatenate([*tables, np.zeros((1, k), np.float32)])  # the last row: no evidence
        total = np.array([prior[x] for x in self.langs], float)
        self.prior = np.log(total / total.sum()) if k else total

    @staticmethod
    def grams(word: str, size: int) -> list[str]:
        marked = f"<{word}>"
        return [marked[i : i + size] for i in range(len(marked) - size + 1)]

    def _logs(self, known: dict[str, np.ndarray], index: dict[str, int], first: int) -> np.ndarray:
        """Log frequencies of what is known, and its rows from ``first`` on in ``index``."""
        index.update(zip(known, range(first, first + len(known)), strict=True))
        m = np.array(list(known.values())).reshape(len(known), len(self.langs)) + 0.1
        return np.log(m / m.sum(0)).astype(np.float32)

    def evidence(self, words: list[str]) -> np.ndarray:
        """A row for each word: its own log frequencies, else the mean of its longest known n-grams, else zeros."""
        rows, starts = [], []
        for w in words:
            starts.append(len(rows))
            known = self.words.get(w)
            if known is not None:
                rows.append(known)
                continue
            marked = f"<{w}>"
            for size in range(MAX_GRAM, 0, -1):
                get = self.by_size[size].get
                if found := [i for k in range(len(marked) - size + 1) if (i := get(marked[k : k + size])) is not None]:
                    rows += found
                    break
            else:
                rows.append(-1)
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        sums = np.add.reduceat(self.table[rows], starts)
        return sums / np.diff([*starts, len(rows)])[:, None]

    def predict(self, text: str | None, seen: SeenWords | None = None) -> tuple[str, float]:
        """``(language, posterior)`` of a whole text."""
        words = words_of(text) if text else []
        if not words or not self.langs:
            return "und", 0.0
        total = (seen or SeenWords(self)).total(words)
        best = int((total + self.prior).argmax())
        sure = total * min(1, SCORE_WORDS / len(words)) + self.prior
        return self.langs[best], float(1 / np.exp(np.clip(sure - sure[best], -700, 700)).sum())


class SeenWords:
    """A partition's words that training has not seen, with their evidence as rows of one table of a fixed size; emptied when full."""

    def __init__(self, model: LanguageModel):
        self.model, self.row, self.table = model, {}, np.zeros((CACHE_WORDS, len(model.langs)), np.float32)

    def total(self, words: list[str]) -> np.ndarray:
        """Summed evidence of all words of a text."""
        known, row = self.model.words.get, self.row
        own, at, new, long = [], [], [], []
        out = np.zeros(len(self.model.langs))

        def settle():
            self.table[len(row) - len(new) : len(row)] = self.model.evidence(new)
            return self.table[at].sum(0, dtype=np.float64)

        for w in words:
            i = known(w)
            if i is not None:
                own.append(i)
                continue
            i = row.get(w)
            if i is None:
                if len(w) > CACHED_LENGTH:
                    long.append(w)
                    continue
                if len(row) == CACHE_WORDS:
                    out += settle()
                    at, new = [], []
                    row.clear()
                i = row[w] = len(row)
                new.append(w)
            at.append(i)
        out += settle()
        return out + self.model.table[own].sum(0, dtype=np.float64) + self.model.evidence(long).sum(0, dtype=np.float64)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Word counts per language on the executors; the driver gets those of all words of the bounded sample ``labelled``."""

    def count(batches):
        found: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[g].update(words_of(t))
                found[g][""] += 1  # documents
            if sum(map(len, found.values())) > 400_000:
                yield from out(found)
                found.clear()
        yield from out(found)

    def out(found):
        for g, words in found.items():
            yield {"lang": [g] * len(words), "word": list(words), "n": list(words.values())}

    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = arrow_stream(rows.select(F.col(text).alias("t"), F.col(lang).alias("g")), "lang string, word string, n long", count, "t", "g").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    table: dict[str, dict[str, int]] = defaultdict(dict)
    for r in counts.collect():
        table[r.lang][r.word] = r.n
    prior = {g: table[g].pop("") for g in sorted(table)}
    table = {g: dict(sorted(words.items())) for g, words in table.items()}
    return LanguageModel(table, prior)


def predict_languages(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``lang_pred``, ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        m = shared.value
        seen = SeenWords(m)
        for b in parts:
            got = [m.predict(t, seen) for t in b.column(1).to_pylist()]
            yield {"k": b.column(0), "lang_pred": [g for g, _ in got], "score": [s for _, s in got]}

    kind = docs.schema[key].dataType.simpleString()
    return arrow_stream(docs, f"k {kind}, lang_pred string, score double", run, F.col(key).alias("k"), F.col(text).alias("t")).withColumnRenamed("k", key)


def label_documents(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang`` replaced by the prediction and ``lang_score`` added; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        m = shared.value
        seen = SeenWords(m)
        for b in parts:
            got = [m.predict(t, seen) for t in b.column(text).to_pylist()]
            yield {"lang": [g for g, _ in got], "lang_score": [s for _, s in got]}

    return arrow_with(docs, "lang string, lang_score double", run)


def training_rows(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``(text, lang)`` of labelled documents outside the held-out split, bounded in number and in each language's bytes.

    Documents are chosen by hashes of their ids from rows without texts; a text longer than the bound is not chosen.
    """
    rows = docs.where((fold_of(F.col("doc_id")) != 2) & F.col("lang").isNotNull()).select("doc_id", "text", "lang", F.octet_length("text").alias("size"))
    some = bounded_sample(rows.where(F.col("size") <= max_bytes).select("doc_id", "lang", "size"), sample_docs, "doc_id").distinct()
    upto = F.sum("size").over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "size"))
    chosen = some.withColumn("upto", upto).where(F.col("upto") <= max_bytes).drop("upto")  # sample_docs rows at most
    return rows.join(F.broadcast(chosen), ["doc_id", "lang", "size"]).select("text", "lang")


def language_table(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    model = fit(training_rows(docs))
    out = predict_languages(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")
