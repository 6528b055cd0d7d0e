"""Declared extractions with grounding: items, speakers, supersession, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Lenses, their item types and the scope each is extracted from.
DECLARED = (
    ("meeting_minutes", 1, "action_item", "utterance"),
    ("meeting_minutes", 1, "decision", "utterance"),
    ("meeting_minutes", 1, "risk", "utterance"),
    ("meeting_minutes", 1, "open_question", "fragment"),
    ("persona", 1, "goal", "utterance"),
    ("persona", 1, "pain_point", "utterance"),
    ("persona", 1, "workaround", "fragment"),
    ("persona", 1, "quote", "document"),
)
# Names that an item's own properties take.
RESERVED = ("item_id", "lens", "lens_version", "node_type", "confidence", "model", "provider", "interview_id", "locked")


def source_units(fragments: DataFrame, utterances: DataFrame, documents: DataFrame, declared: DataFrame) -> DataFrame:
    """Units of all three scopes (unit_id, interview_id, speaker, text) x the item types declared for their scope."""
    units = fragments.withColumn("scope", F.lit("fragment")).unionByName(utterances.withColumn("scope", F.lit("utterance"))).unionByName(documents.withColumn("scope", F.lit("document")))
    return units.join(F.broadcast(declared), "scope")


def explode_items(responses: DataFrame, item_id) -> DataFrame:
    """One row per response item, with its ordinal and deterministic id."""
    r = responses.select("interview_id", "lens", "type", "unit_id", "unit_speaker", F.posexplode("items").alias("ordinal", "item"))
    return r.withColumn("item_id", item_id("interview_id", "lens", "type", "unit_id", "ordinal")).select("item_id", "interview_id", "lens", "type", "unit_id", "unit_speaker", "ordinal", "item.*")


def resolve_speakers(items: DataFrame, speakers: DataFrame, field: str) -> DataFrame:
    """``<field>_speaker`` of a named field: SELF is the unit's speaker, else the first registered live speaker of that handle or name; ``<field>_unresolved`` when none."""
    names = speakers.where("merged_into is null").select("interview_id", "speaker_id", "ordinal", F.explode(F.array(F.lower("handle"), F.lower("display_name"))).alias("_name")).where("_name is not null")
    first = names.groupBy("interview_id", "_name").agg(F.min_by("speaker_id", "ordinal").alias("_found"))
    j = items.withColumn("_name", F.lower(F.trim(F.col(field)))).join(first, ["interview_id", "_name"], "left")
    own = F.upper(F.trim(F.col(field))) == "SELF"
    found = F.when(own, F.col("unit_speaker")).otherwise(F.col("_found"))
    return j.withColumn(f"{field}_speaker", found).withColumn(f"{field}_unresolved", F.when(F.col(field).isNotNull() & found.isNull(), F.col(field))).drop("_name", "_found")


def classify_items(items: DataFrame, current: DataFrame) -> DataFrame:
    """Adds ``outcome``: extracted (new), existing, or locked."""
    c = current.select("item_id", F.col("locked").alias("_locked"))
    return items.join(c, "item_id", "left").withColumn("outcome", F.when(F.col("_locked").isNull(), "extracted").when(F.col("_locked"), "locked").otherwise("existing")).drop("_locked")


def supersede(items: DataFrame, keys: list[str], version: str = "lens_version") -> DataFrame:
    """Items that stay: those of the newest version of their lens, and locked ones."""
    newest = F.max(version).over(Window.partitionBy(*keys))
    return items.withColumn("_new", newest).where(F.col("locked") | (F.col(version) >= F.col("_new"))).drop("_new")


def apply_overrides(items: DataFrame, overrides: DataFrame) -> DataFrame:
    """Human fields merged name by name, the latest version winning; an override locks."""
    rows = overrides.select("item_id", "version", F.explode("fields").alias("name", "value"))
    last = rows.groupBy("item_id", "name").agg(F.max_by("value", "version").alias("value"))
    changed = last.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_new"))
    j = items.join(changed, "item_id", "left")
    kept = F.map_filter("fields", lambda k, _: F.col("_new").isNull() | ~F.coalesce(F.array_contains(F.map_keys("_new"), k), F.lit(False)))
    merged = F.when(F.col("_new").isNull(), F.col("fields")).otherwise(F.map_concat(kept, "_new"))
    return j.withColumn("fields", merged).withColumn("locked", F.col("locked") | F.col("_new").isNotNull()).drop("_new")


def flatten_fields(fields: Column) -> Column:
    """A JSON object of extracted fields as a map of strings: scalars as their text, lists and objects as JSON text, null as null.

    Reserved names get a ``field_`` prefix.  What is no JSON object gives null.
    """
    flat = F.from_json(fields, "map<string,string>")
    return F.transform_keys(flat, lambda k, _: F.when(k.isin(*RESERVED), F.concat(F.lit("field_"), k)).otherwise(k))


def ground_items(items: DataFrame, supports: DataFrame, fragments: DataFrame, speakers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(support links, speaker links, refused links): links to rows that do not exist are refused."""
    s = items.join(supports, "unit_id").select("item_id", "fragment_id")
    good = s.join(fragments.select("fragment_id"), "fragment_id", "left_semi")
    links = items.where("speaker_id is not null").select("item_id", "speaker_id", "role")
    linked = links.join(speakers.select("speaker_id"), "speaker_id", "left_semi")
    refused = s.join(fragments.select("fragment_id"), "fragment_id", "left_anti").select("item_id", F.col("fragment_id").alias("referent"), F.lit("fragment").alias("kind"))
    refused = refused.unionByName(links.join(speakers.select("speaker_id"), "speaker_id", "left_anti").select("item_id", F.col("speaker_id").alias("referent"), F.lit("speaker").alias("kind")))
    return good, linked, refused
