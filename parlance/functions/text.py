"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"
#: Pieces concatenate back to the source: a sentence keeps its end marks and the blanks after them.
SENTENCE = r"[^.!?]+(?:[.!?]+[ \t\r\n]*|\z)|[.!?]+[ \t\r\n]*"
#: A speaker label: a capital, then letters, digits, blanks, dots, apostrophes or dashes, up to ": ".
LABEL = r"^(\p{Lu}[\p{L}\p{N}_ .'-]{0,40}): (.*)$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    """Lower-cased, blanks collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\r\n]+", " "))


def slug(c: Column) -> Column:
    """Lower-case letters and digits joined by dashes; ``x-`` and a hash prefix when nothing is left."""
    s = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", F.concat(F.lit("x-"), F.substring(F.sha1(c), 1, 8))).otherwise(s)


def query_text(c: Column) -> Column:
    """A question without anything but letters, digits and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_ ]+", " "), " +", " "))


def surface_key(c: Column) -> Column:
    """Entity surface: collapsed, one leading article off, possessive off, plural s off (not ss, longer than 3)."""
    s = F.regexp_replace(collapse(c), "^(the|an|a) (.+)$", "$2")
    s = F.regexp_replace(s, "('s|’s|'|’)$", "")
    return F.when((F.length(s) > 3) & s.endswith("s") & ~s.endswith("ss"), F.substr(s, F.lit(1), F.length(s) - 1)).otherwise(s)
