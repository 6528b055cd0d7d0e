"""Compression classifier: which of two zstandard dictionaries packs a text better.

One dictionary is built from good and one from bad labelled text.  A text is cut into
blocks, every block is compressed with both, and the difference of the packed sizes, divided
by the size of the text, is the only feature.  A logistic curve fitted on labelled texts that
built no dictionary (with smoothed targets, as Platt proposed) turns it into a score.

Defined cases: null text counts as empty; an empty text gets the share of good texts in
the labels; without two usable texts of either class every score is that share, and 0.5
without any label; a class whose text is too short to train a dictionary on has a dictionary
of its raw text; null labels are ignored and a document labelled more than once counts once
(its highest label); repeated documents give repeated results; texts of any length are
scored whole; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.common import arrow_stream, bounded_sample, fold_of

#: Bounds of the fit, for each class: labelled texts (every other one builds the dictionary, the rest calibrate), and their bytes.
SAMPLE_PER_CLASS, SAMPLE_BYTES = 2_400, 12 << 20
DICT_BYTES, BLOCK, LEVEL = 65_536, 1_024, 3
THRESHOLD = 0.7


@dataclass
class CompressionModel:
    """Two dictionaries (of a kind that zstandard knows), the curve over their difference, and the share of good texts."""

    good: tuple[bytes, int] | None
    bad: tuple[bytes, int] | None
    curve: tuple[float, float]
    base: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind), write_checksum=False, write_content_size=False, write_dict_id=False) for d, kind in (self.good, self.bad)]


def blocks_of(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def difference(text: str, pair: list[zstandard.ZstdCompressor]) -> float:
    """How many bytes less the good dictionary needs than the bad one, a byte of a text that is not empty."""
    parts = blocks_of(text)
    good, bad = (sum(len(c.compress(p)) for p in parts) for c in pair)
    return (bad - good) / sum(map(len, parts))


def _dictionary(parts: list[bytes]) -> tuple[bytes, int]:
    size = min(DICT_BYTES, max(1_024, sum(map(len, parts)) // 8))
    try:
        return zstandard.train_dictionary(size, parts).as_bytes(), zstandard.DICT_TYPE_FULLDICT
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(parts)[-DICT_BYTES:], zstandard.DICT_TYPE_RAWCONTENT


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of the weighted logistic curve with the smoothed targets of Platt, by Newton steps."""
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = float(x.std()) or 1.0
    m, w = np.stack([np.ones(len(x)), x / scale], 1), np.zeros(2)
    ridge = np.diag([1e-6, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve((m * (weight * p * (1 - p))[:, None]).T @ m + ridge, m.T @ (weight * (target - p)) - ridge @ w)
        w += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1] / scale)


def fit(texts: list[tuple[str, int]], shares: tuple[float, float] | None = None) -> CompressionModel:
    """Dictionaries and calibration from bounded labelled texts.

    shares: how common the classes 0 and 1 are among all labels (as in ``texts`` if not given).
    """
    by = {y: [t for t, v in texts if v == y and t] for y in (0, 1)}
    n0, n1 = shares or (len(by[0]), len(by[1]))
    base = n1 / (n0 + n1) if n0 + n1 else 0.5
    if min(map(len, by.values())) < 2:
        return CompressionModel(None, None, (0.0, 0.0), base)
    good, bad = (_dictionary([p for t in by[y][::2] for p in blocks_of(t)]) for y in (1, 0))
    model = CompressionModel(good, bad, (0.0, 0.0), base)
    pair = model.compressors()
    x = np.array([difference(t, pair) for y in (0, 1) for t in by[y][1::2]])
    y = np.array([y for y in (0, 1) for t in by[y][1::2]], float)
    weight = np.where(y == 1, n1 / y.sum(), n0 / (1 - y).sum())
    model.curve = _curve(x, y, weight / weight.mean())
    return model


def scores(texts: list[str | None], model: CompressionModel, pair: list[zstandard.ZstdCompressor]) -> list[float]:
    """Calibrated scores of whole texts."""
    out = np.full(len(texts), model.base)
    at = [i for i, t in enumerate(texts) if t and pair]
    if at:
        z = model.curve[0] + model.curve[1] * np.array([difference(texts[i], pair) for i in at])
        out[at] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out.tolist()


def training_texts(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, max_bytes: int = SAMPLE_BYTES) -> tuple[list[tuple[str, int]], tuple[float, float] | None]:
    """Labelled texts outside the held-out split, bounded in number and in bytes, and the sizes of the classes."""
    known = labels.where(F.col("quality").isin(0, 1) & (fold_of(F.col("doc_id")) != 2)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sizes = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    ids = bounded_sample(known.where("quality = 0"), per_class, "doc_id").unionByName(bounded_sample(known.where("quality = 1"), per_class, "doc_id"))
    # at most 2 x per_class ids; repeated documents count once
    sized = docs.select("doc_id", "text", F.octet_length("text").alias("size")).where(F.col("size").between(1, max_bytes))
    found = sized.select("doc_id", "size").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id"))  # ids and sizes, no texts
    chosen = found.withColumn("upto", upto).where(F.col("upto") <= max_bytes).drop("upto")
    rows = sized.join(F.broadcast(chosen), ["doc_id", "size"]).groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return [(r.text, r.quality) for r in rows], (sizes.get(0, 0), sizes.get(1, 0)) if sizes else None


def score_quality(docs: DataFrame, model: CompressionModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``score`` (0 to 1; higher: better)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        pair = shared.value.compressors() if shared.value.good else []
        for b in parts:
            yield {"k": b.column(0), "score": scores(b.column(1).to_pylist(), shared.value, pair)}

    kind = docs.schema[key].dataType.simpleString()
    return arrow_stream(docs, f"k {kind}, score double", run, F.col(key).alias("k"), F.col(text).alias("t")).withColumnRenamed("k", key)


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns."""
    texts, sizes = training_texts(docs, labels)
    out = score_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(texts, sizes))
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
