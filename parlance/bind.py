"""The driver's tables as interviews, fragments, events and vectors; and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.ids import hashed_share
from parlance.operators import ingest
from parlance.plans.scratch import materialise

#: Fragments and utterances that the query at work has written, by session and folder.
_WRITTEN: dict[tuple[SparkSession, str, str], DataFrame] = {}


def reads_fragments(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose branches read fragments or utterances several times: each is cut and written once for it."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if (spark, sf_dir, "fragments") in _WRITTEN:
            return query(spark, sf_dir)
        try:
            for name, make in (("fragments", fragments), ("utterances", utterances)):
                _WRITTEN[spark, sf_dir, name] = materialise(make(spark, sf_dir))
            return query(spark, sf_dir)
        finally:
            for name in ("fragments", "utterances"):
                _WRITTEN.pop((spark, sf_dir, name), None)

    return run


@contextmanager
def written(spark: SparkSession, sf_dir: str, fragments: DataFrame) -> Iterator[None]:
    """Inside, what asks for fragments reads those already written."""
    before = _WRITTEN.get((spark, sf_dir, "fragments"))
    _WRITTEN[spark, sf_dir, "fragments"] = fragments
    try:
        yield
    finally:
        if before is None:
            _WRITTEN.pop((spark, sf_dir, "fragments"), None)
        else:
            _WRITTEN[spark, sf_dir, "fragments"] = before


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(interview_id, project_id, turn, piece, role, seq, text, start_char, end_char, fragment_id, confidence)``."""
    if (spark, sf_dir, "fragments") in _WRITTEN:
        return _WRITTEN[spark, sf_dir, "fragments"]
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "interview_id")
    f = ingest.number_fragments(ingest.segment(c, ["interview_id", "turn", "role"], "text"), "interview_id", "turn", "piece")
    f = f.withColumn("fragment_id", F.concat_ws(":", F.col("interview_id"), F.col("seq")))
    return f.withColumns({"project_id": F.concat(F.lit("p"), F.col("interview_id") % 4), "confidence": hashed_share(F.col("fragment_id"))})


def utterance_id() -> Column:
    return F.concat_ws(":", F.col("interview_id"), F.lit("u"), F.col("utterance_no"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    if (spark, sf_dir, "utterances") in _WRITTEN:
        return _WRITTEN[spark, sf_dir, "utterances"]
    u = ingest.baseline_utterances(fragments(spark, sf_dir), "interview_id", "role")
    return u.withColumn("utterance_id", utterance_id())


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled transcripts: ``Role: text`` per turn, inner line breaks as blanks."""
    c = table(spark, sf_dir, "conversations")
    line = F.concat(F.initcap("role"), F.lit(": "), F.regexp_replace("text", "[\r\n]+", " "))
    return c.groupBy(F.col("conv_id").alias("interview_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of aggregates (users) with versions: ``(commit_position, aggregate_id, version, event_type, ts, value, props)``."""
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events")
    v = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("event_id").alias("commit_position"), F.col("user_id").alias("aggregate_id"), v.alias("version"), "event_type", "ts", F.round("value", 4).alias("value"), "props")


def share_sql(key: str) -> str:
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 6))::BIGINT % 1000 / 1000.0)"


#: Common table expressions of the SQL twins.
FRAGMENTS = rf"""
b_ps AS (SELECT conv_id AS interview_id, turn, role, text AS source_text, regexp_extract_all(text, '[^.!?]+(?:[.!?]+[ \t\r\n]*|\z)|[.!?]+[ \t\r\n]*') AS ps FROM conversations),
b_ex AS (SELECT interview_id, turn, role, source_text, unnest(ps) AS raw, generate_subscripts(ps, 1) - 1 AS piece FROM b_ps),
b_off AS (SELECT *, coalesce(sum(length(raw)) OVER (PARTITION BY interview_id, turn, role ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM b_ex),
b_st AS (SELECT *, trim(raw, E' \t\r\n') AS text, CAST(base + length(raw) - length(ltrim(raw, E' \t\r\n')) AS INTEGER) AS start_char FROM b_off WHERE trim(raw, E' \t\r\n') <> ''),
b_n AS (SELECT interview_id, turn, role, piece, text, source_text, start_char, CAST(start_char + length(text) AS INTEGER) AS end_char,
        CAST(row_number() OVER (PARTITION BY interview_id ORDER BY turn, piece) - 1 AS INTEGER) AS seq FROM b_st),
fragments AS (SELECT *, interview_id || ':' || seq AS fragment_id, 'p' || (interview_id % 4) AS project_id, {share_sql("interview_id || ':' || seq")} AS confidence FROM b_n)"""

UTTERANCES = (
    FRAGMENTS
    + """,
b_un AS (SELECT *, CASE WHEN seq = 0 OR role IS DISTINCT FROM lag(role) OVER (PARTITION BY interview_id ORDER BY seq) THEN 1 ELSE 0 END AS is_new FROM fragments),
members AS (SELECT *, CAST(sum(is_new) OVER (PARTITION BY interview_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS utterance_no FROM b_un),
utterances AS (SELECT interview_id, utterance_no, min(role) AS speaker, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_fragments, interview_id || ':u:' || utterance_no AS utterance_id FROM members GROUP BY interview_id, utterance_no)"""
)

TRANSCRIPTS = """
transcripts AS (SELECT conv_id AS interview_id, string_agg(upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ': ' || regexp_replace(text, '[\\r\\n]+', ' ', 'g'), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""

EVENTS = """
event_log AS (SELECT event_id AS commit_position, user_id AS aggregate_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS version, event_type, ts, round(value, 4) AS value, props FROM events)"""
