"""Read-model queries over the projected tables; every branch is aggregated before it is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def transcript(fragments: DataFrame, attributions: DataFrame, members: DataFrame) -> DataFrame:
    """Fragments in order with speaker and utterance; either may be missing."""
    return fragments.join(attributions, "fragment_id", "left").join(members, "fragment_id", "left")


def segment_rows(members: DataFrame) -> DataFrame:
    return members.groupBy("segment_id", "topic").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n_fragments"))


def live_speakers(speakers: DataFrame) -> DataFrame:
    return speakers.where("merged_into is null")


def lens_items(items: DataFrame, links: DataFrame, supports: DataFrame, item_type: str | None = None, floor: float | None = None) -> DataFrame:
    """Items with links and supports as arrays; filters only where asked for."""
    i = items if item_type is None else items.where(F.col("type") == item_type)
    i = i if floor is None else i.where(F.col("confidence") >= floor)
    a = links.groupBy("item_id").agg(F.array_sort(F.collect_set(F.concat_ws("=", "role", "speaker_id"))).alias("links"))
    b = supports.groupBy("item_id").agg(F.array_sort(F.collect_set("fragment_id")).alias("supports"))
    return i.join(a, "item_id", "left").join(b, "item_id", "left")


def claim_rows(claims: DataFrame, supports: DataFrame) -> DataFrame:
    s = supports.groupBy("claim_id").agg(F.array_sort(F.collect_set("fragment_id")).alias("supports"))
    return claims.join(s, "claim_id", "left")


def entity_rows(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    m = mentions.groupBy("interview_id", "surface", "entity_type").agg(F.array_sort(F.collect_list("fragment_id")).alias("mentions"))
    return m.join(aliases, "surface", "left")


def persons_of(speakers: DataFrame, links: DataFrame) -> DataFrame:
    """Persons behind the speakers of an interview."""
    return speakers.select("interview_id", "speaker_id").join(links, "speaker_id").select("interview_id", "person").distinct()


def worklist(items: DataFrame, claims: DataFrame, threshold: float) -> DataFrame:
    """What needs a person: items under the threshold or with an unresolved field, claims under the threshold."""
    unresolved = F.exists(F.map_keys("fields"), lambda k: k.endswith("_unresolved"))
    i = items.where((F.col("confidence") < threshold) | unresolved).select("interview_id", F.col("item_id").alias("id"), F.lit("item").alias("kind"), "confidence", F.when(unresolved, "unresolved").otherwise("low_confidence").alias("reason"))
    c = claims.where(F.col("confidence") < threshold).select("interview_id", F.col("claim_id").alias("id"), F.lit("claim").alias("kind"), "confidence", F.lit("low_confidence").alias("reason"))
    return i.unionByName(c)


def speaker_rollup(speakers: DataFrame, links: DataFrame, items: DataFrame, claims: DataFrame) -> DataFrame:
    """One row per person (or lower-cased name) over all interviews, with what they said."""
    key = F.coalesce(F.concat(F.lit("person:"), "person"), F.concat(F.lit("name:"), F.lower("display_name")))
    s = speakers.join(links, "speaker_id", "left").select("speaker_id", "interview_id", key.alias("who"))
    n = s.groupBy("who").agg(F.count_distinct("interview_id").alias("n_interviews"), F.count_distinct("speaker_id").alias("n_speakers"))

    def count(rows, name):
        return rows.groupBy("speaker_id").agg(F.count(F.lit(1)).alias("c")).join(s.select("speaker_id", "who"), "speaker_id").groupBy("who").agg(F.sum("c").alias(name))

    return n.join(count(items, "n_items"), "who", "left").join(count(claims, "n_claims"), "who", "left").fillna(0, ["n_items", "n_claims"])


def latest_analysis(analyses: DataFrame) -> DataFrame:
    w = Window.partitionBy("fragment_id").orderBy(F.desc("created_at"), F.desc("version"))
    return analyses.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def projects(interviews: DataFrame, all_projects: DataFrame) -> DataFrame:
    return all_projects.join(interviews.groupBy("project_id").agg(F.count_distinct("interview_id").alias("n_interviews")), "project_id", "left").fillna(0, ["n_interviews"])


def interview_sizes(interviews: DataFrame, fragments: DataFrame) -> DataFrame:
    return interviews.join(fragments.groupBy("interview_id").agg(F.count(F.lit(1)).alias("n_fragments")), "interview_id", "left").fillna(0, ["n_fragments"])


def headers(interviews: DataFrame, column: str = "metadata_json") -> DataFrame:
    """Metadata as a map; malformed JSON is an empty map."""
    m = F.from_json(F.when(F.try_parse_json(column).isNotNull(), F.col(column)), "map<string,string>")
    return interviews.withColumn("metadata", F.coalesce(m, F.create_map().cast("map<string,string>")))


def transcript_lines(fragments: DataFrame, speakers: DataFrame, persons: DataFrame, members: DataFrame, segments: DataFrame, entities: DataFrame, items: DataFrame) -> DataFrame:
    """Lines with speaker, person, utterance, segment topics, entities and items (as arrays); merged speakers and their persons are hidden.

    fragments: fragment_id, speaker_id; speakers: speaker_id, display_name, merged_into; persons: speaker_id, person.
    """
    sp = live_speakers(speakers).select("speaker_id", F.col("display_name").alias("speaker"))
    p = persons.groupBy("speaker_id").agg(F.min("person").alias("person"))
    t = segments.groupBy("fragment_id").agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    e = entities.groupBy("fragment_id").agg(F.array_sort(F.collect_set("surface")).alias("entities"))
    i = items.groupBy("fragment_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    f = fragments.join(sp.join(p, "speaker_id", "left"), "speaker_id", "left").join(members, "fragment_id", "left")
    return f.join(t, "fragment_id", "left").join(e, "fragment_id", "left").join(i, "fragment_id", "left")


def persona_cards(items: DataFrame) -> DataFrame:
    """Items of a persona lens per speaker: distinct counts of the four types, the surest quote, interviews."""
    return items.groupBy("who").agg(
        *(F.count_distinct(F.when(F.col("type") == t, F.col("item_id"))).alias(f"n_{t}") for t in ("goal", "pain_point", "workaround", "quote")),
        F.max_by(F.when(F.col("type") == "quote", F.col("text")), F.when(F.col("type") == "quote", F.struct("confidence", "item_id"))).alias("best_quote"),
        F.count_distinct("interview_id").alias("n_interviews"),
    )


def persona_detail(items: DataFrame) -> DataFrame:
    """Distinct texts of each type per speaker, sorted."""
    return items.select("who", "type", "text").distinct().groupBy("who", "type").agg(F.array_sort(F.collect_list("text")).alias("texts"))


def person_cards(links: DataFrame, speakers: DataFrame) -> DataFrame:
    return links.join(speakers.select("speaker_id", "interview_id"), "speaker_id").groupBy("person").agg(F.count_distinct("speaker_id").alias("n_speakers"), F.count_distinct("interview_id").alias("n_interviews"))


def flags(keys: DataFrame, key: str, **sides: DataFrame) -> DataFrame:
    """For each key, whether each side holds it."""
    out = keys.select(key).distinct()
    for name, rows in sides.items():
        out = out.join(rows.select(key).distinct().withColumn(name, F.lit(True)), key, "left").fillna(False, [name])
    return out


def unmerged(speakers: DataFrame) -> DataFrame:
    return live_speakers(speakers).withColumn("provisional", F.coalesce("provisional", F.lit(False)))


def tags(c: Column) -> Column:
    return F.array_join(c, ",")
