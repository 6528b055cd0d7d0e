"""The corpus pipeline: five stages, each one of the operators of parlance.llm.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's documents.

1. language: documents that are ``und``, or whose best language is unsure, go; ``lang`` becomes the prediction.
2. near_copies: one document of each near-duplicate component stays.
3. decontaminate: documents that hold a benchmark item go.
4. secrets: spans of secrets are replaced by a mark, ``n_chars`` follows.
5. tokens: the ids of each text, and what decoding them gives, as counts and digests.

Defined cases are those of the operators; an empty table goes through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import decontaminate, language, nearcopies, pieces, secrets
from parlance.llm.common import spread, table
from parlance.plans.scratch import materialise

#: A document whose best language has a lower posterior is rejected.
MIN_LANGUAGE_SCORE = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a sure language; ``lang`` is the predicted one."""
    model = language.fit(language.training_rows(docs))
    kept = language.label_documents(docs.select(*COLUMNS), model)
    return kept.where((F.col("lang") != "und") & (F.col("lang_score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.drop_near_copies(docs.select(*COLUMNS))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact_secrets(docs.select(*COLUMNS), secrets.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("tokens", encode_pieces),
]

#: SQL cannot express the fitted stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; the rows of the last."""
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
