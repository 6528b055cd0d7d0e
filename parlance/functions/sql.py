"""Functions that a session can call from its own SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from parlance.functions.text import SENTENCE

_BLANKS = r"' \t\r\n'"
_SEGMENT = rf"""
CREATE OR REPLACE TEMPORARY FUNCTION segment_text(source STRING)
RETURNS TABLE (piece INT, text STRING, start_char INT, end_char INT)
RETURN SELECT piece, btrim(raw, {_BLANKS}), from_ + length(raw) - length(ltrim({_BLANKS}, raw)), from_ + length(raw) - length(ltrim({_BLANKS}, raw)) + length(btrim(raw, {_BLANKS}))
FROM (SELECT piece, raw, aggregate(slice(raws, 1, piece), 0, (n, x) -> n + length(x)) AS from_
      FROM (SELECT regexp_extract_all(source, '{{SENTENCE}}', 0) AS raws) LATERAL VIEW posexplode(raws) AS piece, raw)
WHERE btrim(raw, {_BLANKS}) != ''
"""


def register(spark: SparkSession) -> None:
    """Temporary functions of the session.

    ``segment_text(source)``: the sentence pieces of a text with exact offsets, as a table to join laterally.
    """
    spark.sql(_SEGMENT.replace("{SENTENCE}", SENTENCE.replace("\\", "\\\\")))
