"""Read-model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance import bind
from parlance.bind import FRAGMENTS, UTTERANCES, share_sql, table
from parlance.bindings.enrich import _ITEMS, _SEG, _UNITS, _items, _segments
from parlance.bindings.resolve import _M, _SPEAKERS, _linked, _mentions, _speakers
from parlance.functions.ids import hashed_share
from parlance.operators import read as op

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _members(s, d):
    u = bind.utterances(s, d).select("interview_id", "utterance_id", "utterance_no", F.explode(F.sequence("first_seq", "last_seq")).alias("seq"))
    return u.select(F.concat_ws(":", "interview_id", "seq").alias("fragment_id"), "utterance_id")


def _segment_members(s, d):
    g = _segments(s, d).where("interview_id % 5 != 1")
    return g.select("interview_id", F.concat_ws("/", "interview_id", "start_index").alias("segment_id"), "topic", F.explode(F.sequence("start_index", "end_index")).alias("seq")).withColumn("fragment_id", F.concat_ws(":", "interview_id", "seq"))


_SM = f"{_SEG}, sm AS (SELECT interview_id, interview_id || '/' || start_index AS segment_id, topic, seq, fragment_id FROM sg JOIN fragments USING (interview_id) WHERE interview_id % 5 <> 1 AND seq BETWEEN start_index AND end_index)"


@query("q2_segments", f"WITH {FRAGMENTS}, {_SM} SELECT segment_id, topic, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_fragments FROM sm GROUP BY ALL")
def q2(s, d):
    return op.segment_rows(_segment_members(s, d))


@query("q3_live_speakers", f"WITH {_SPEAKERS} SELECT interview_id, speaker_id, display_name FROM speakers WHERE interview_id % 6 <> 2")
def q3(s, d):
    sp = _speakers(s, d).withColumn("merged_into", F.when(F.col("interview_id") % 6 == 2, F.lit("other")))
    return op.live_speakers(sp).select("interview_id", "speaker_id", "display_name")


def _supports(s, d, items=None):
    i = _items(s, d) if items is None else items
    m = _members(s, d)
    a = i.select("item_id", "unit_id").join(m.select(F.col("utterance_id").alias("unit_id"), "fragment_id"), "unit_id").select("item_id", "fragment_id")
    b = i.where("unit_id like '%:%' and unit_id not like '%u%'").select("item_id", F.col("unit_id").alias("fragment_id"))
    return a.unionByName(b)


_SUP = "sup AS (SELECT item_id, fragment_id FROM items JOIN utterances ON utterance_id = unit_id JOIN members USING (interview_id, utterance_no) UNION ALL SELECT item_id, unit_id FROM items WHERE unit_id LIKE '%:%' AND unit_id NOT LIKE '%u%')"


_SUP_IN = _SUP.replace("JOIN members USING (interview_id, utterance_no)", "JOIN members ON members.interview_id = utterances.interview_id AND members.utterance_no = utterances.utterance_no")


@query(
    "q4_lens_items",
    f"WITH {UTTERANCES}, {_UNITS}, {_ITEMS}, {_SUP_IN}, sa AS (SELECT item_id, string_agg(DISTINCT fragment_id, ',' ORDER BY fragment_id) AS supports FROM sup GROUP BY 1) SELECT item_id, confidence, 'spoken=' || unit_speaker AS links, supports FROM items LEFT JOIN sa USING (item_id) WHERE type = 'decision' AND confidence >= 0.1 ORDER BY confidence DESC, item_id LIMIT 20 OFFSET 5",
)
@bind.reads_fragments
def q4(s, d):
    i = _items(s, d)
    links = i.where("unit_speaker is not null").select("item_id", F.lit("spoken").alias("role"), F.col("unit_speaker").alias("speaker_id"))
    r = op.lens_items(i, links, _supports(s, d), "decision", 0.1)
    return op.page(r, [F.desc("confidence"), "item_id"], 5, 20).select("item_id", "confidence", op.tags(F.col("links")).alias("links"), op.tags(F.col("supports")).alias("supports"))


def _claims(s, d):
    u = bind.utterances(s, d)
    return u.select("interview_id", F.concat(F.col("utterance_id"), F.lit("/0")).alias("claim_id"), "utterance_id", F.concat_ws("/", "interview_id", "speaker").alias("speaker_id"), hashed_share(F.col("utterance_id")).alias("confidence"))


_CLAIMS = f"claims AS (SELECT interview_id, utterance_id || '/0' AS claim_id, utterance_id, utterance_no, interview_id || '/' || speaker AS speaker_id, {share_sql('utterance_id')} AS confidence FROM utterances)"


@query("q5_claims", f"WITH {UTTERANCES}, {_CLAIMS} SELECT claim_id, speaker_id, string_agg(fragment_id, ',' ORDER BY fragment_id) AS supports FROM claims JOIN members USING (interview_id, utterance_no) GROUP BY ALL")
@bind.reads_fragments
def q5(s, d):
    c = _claims(s, d)
    sup = c.select("claim_id", "utterance_id").join(_members(s, d), "utterance_id")
    return op.claim_rows(c, sup).select("claim_id", "speaker_id", op.tags(F.col("supports")).alias("supports"))


@query("q6_entities", f"WITH {_M} SELECT interview_id, surface, entity_type, string_agg(fragment_id, ',' ORDER BY fragment_id) AS mentions, CASE WHEN length(surface) % 3 = 0 THEN 'c-' || lower(surface) END AS canonical_id FROM mentions GROUP BY ALL")
def q6(s, d):
    m = _mentions(s, d)
    al = m.where(F.length("surface") % 3 == 0).select("surface", F.concat(F.lit("c-"), F.lower("surface")).alias("canonical_id")).distinct()
    return op.entity_rows(m, al).withColumn("mentions", op.tags(F.col("mentions")))


_PLINKS = f"""plinks AS (SELECT groups.name_key AS person, speaker_id FROM groups JOIN nm USING (project, name_key) WHERE auto AND {share_sql("speaker_id")} >= 0.1)"""


def _plinks(s, d):
    return _linked(s, d).where("outcome != 'blocked'").select("person", "speaker_id")


@query("q7_persons", f"WITH {_SPEAKERS}, {_PLINKS} SELECT DISTINCT interview_id, person FROM speakers JOIN plinks USING (speaker_id)")
def q7(s, d):
    return op.persons_of(_speakers(s, d), _plinks(s, d))


@query("q8_worklist", f"WITH {UTTERANCES}, {_UNITS}, {_ITEMS}, {_CLAIMS}, w AS (SELECT interview_id, item_id AS id, 'item' AS kind, confidence, CASE WHEN owner = 'nobody' THEN 'unresolved' ELSE 'low_confidence' END AS reason FROM items WHERE confidence < 0.05 OR owner = 'nobody' UNION ALL SELECT interview_id, claim_id, 'claim', confidence, 'low_confidence' FROM claims WHERE confidence < 0.05) SELECT id, kind, confidence, reason FROM w WHERE interview_id % 4 = 1 ORDER BY confidence, id LIMIT 50")
def q8(s, d):
    i = _items(s, d).withColumn("fields", F.create_map(F.when(F.col("owner") == "nobody", "owner_unresolved").otherwise("owner"), F.col("owner")))
    w = op.worklist(i, _claims(s, d), 0.05).where("interview_id % 4 = 1")
    return op.page(w, ["confidence", "id"], 0, 50).select("id", "kind", "confidence", "reason")


@query(
    "q9_speaker_rollup",
    f"""WITH {UTTERANCES}, {_CLAIMS}, {_SPEAKERS}, {_PLINKS}, s1 AS (SELECT speaker_id, interview_id, coalesce('person:' || person, 'name:' || lower(display_name)) AS who FROM speakers LEFT JOIN plinks USING (speaker_id))
SELECT who, count(DISTINCT s1.interview_id) AS n_interviews, count(DISTINCT s1.speaker_id) AS n_speakers, count(DISTINCT claim_id) FILTER (WHERE confidence < 0.5) AS n_items, count(DISTINCT claim_id) AS n_claims FROM s1 LEFT JOIN claims ON claims.speaker_id = s1.speaker_id GROUP BY 1""",
)
@bind.reads_fragments
def q9(s, d):
    c = _claims(s, d)
    return op.speaker_rollup(_speakers(s, d), _plinks(s, d), c.where("confidence < 0.5"), c)


@query("q10_latest_analysis", "SELECT user_id AS fragment_id, arg_max(event_id, (ts, event_id)) AS version FROM events GROUP BY 1")
def q10(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("fragment_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("version"))
    return op.latest_analysis(e).select("fragment_id", "version")


@query("q11_projects", "WITH p AS (SELECT DISTINCT 'p' || (conv_id % 4) AS project_id FROM conversations UNION SELECT 'p9') SELECT p.project_id, count(DISTINCT conv_id) AS n_interviews FROM p LEFT JOIN conversations ON 'p' || (conv_id % 4) = p.project_id GROUP BY 1")
def q11(s, d):
    i = table(s, d, "conversations").select(F.col("conv_id").alias("interview_id"), F.concat(F.lit("p"), F.col("conv_id") % 4).alias("project_id"))
    every = i.select("project_id").distinct().unionByName(s.createDataFrame([("p9",)], "project_id string"))
    return op.projects(i, every)


@query("q12_interviews", f"WITH {FRAGMENTS} SELECT c.conv_id AS interview_id, count(fragment_id) AS n_fragments FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN fragments f ON f.interview_id = c.conv_id GROUP BY 1")
def q12(s, d):
    i = table(s, d, "conversations").select(F.col("conv_id").alias("interview_id")).distinct()
    return op.interview_sizes(i, bind.fragments(s, d))


@query("q13_headers", "SELECT DISTINCT conv_id AS interview_id, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'language=en,title=Interview ' || conv_id END AS metadata FROM conversations")
def q13(s, d):
    i = table(s, d, "conversations").select(F.col("conv_id").alias("interview_id")).distinct()
    good = F.to_json(F.struct(F.concat(F.lit("Interview "), "interview_id").alias("title"), F.lit("en").alias("language")))
    h = op.headers(i.withColumn("metadata_json", F.when(F.col("interview_id") % 3 == 0, "{broken").otherwise(good)))
    return h.select("interview_id", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("metadata"))


@query(
    "q14_lines",
    f"""WITH {_M}, {UTTERANCES[len(FRAGMENTS) + 1 :]}, {_SM}, {_UNITS}, {_ITEMS}, {_SUP_IN}, {_SPEAKERS}, {_PLINKS}, en AS (SELECT fragment_id, string_agg(DISTINCT surface, ',' ORDER BY surface) AS entities FROM mentions GROUP BY 1), tp AS (SELECT fragment_id, string_agg(DISTINCT topic, ',') AS topics FROM sm GROUP BY 1),
fi AS (SELECT fragment_id, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM sup GROUP BY 1), lsp AS (SELECT speaker_id, display_name AS speaker, person FROM speakers LEFT JOIN plinks USING (speaker_id) WHERE interview_id % 6 <> 2)
SELECT m.fragment_id, speaker, person, m.interview_id || ':u:' || utterance_no AS utterance_id, topics, entities, items FROM members m LEFT JOIN lsp ON lsp.speaker_id = m.interview_id || '/' || m.role LEFT JOIN en USING (fragment_id) LEFT JOIN tp USING (fragment_id) LEFT JOIN fi USING (fragment_id)""",
)
@bind.reads_fragments
def q14(s, d):
    f = bind.fragments(s, d).select("fragment_id", F.concat_ws("/", "interview_id", "role").alias("speaker_id"))
    sp = _speakers(s, d).withColumn("merged_into", F.when(F.col("interview_id") % 6 == 2, F.lit("other")))
    t = op.transcript_lines(f, sp, _plinks(s, d), _members(s, d), _segment_members(s, d), _mentions(s, d).select("fragment_id", "surface"), _supports(s, d))
    return t.select("fragment_id", "speaker", "person", "utterance_id", op.tags(F.col("topics")).alias("topics"), op.tags(F.col("entities")).alias("entities"), op.tags(F.col("items")).alias("items"))


def _persona(s, d):
    return _items(s, d).where("lens = 'persona'").withColumn("who", F.coalesce("unit_speaker", F.lit("all")))


_PERSONA = "persona AS (SELECT *, coalesce(unit_speaker, 'all') AS who FROM items WHERE lens = 'persona')"


@query("q15_persona_cards", f"WITH {UTTERANCES}, {_UNITS}, {_ITEMS}, {_PERSONA} SELECT who, count(DISTINCT item_id) FILTER (WHERE type = 'goal') AS n_goal, count(DISTINCT item_id) FILTER (WHERE type = 'pain_point') AS n_pain_point, count(DISTINCT item_id) FILTER (WHERE type = 'workaround') AS n_workaround, count(DISTINCT item_id) FILTER (WHERE type = 'quote') AS n_quote, arg_max(text, (confidence, item_id)) FILTER (WHERE type = 'quote') AS best_quote, count(DISTINCT interview_id) AS n_interviews FROM persona GROUP BY 1")
def q15(s, d):
    return op.persona_cards(_persona(s, d))


@query("q16_persona_detail", f"WITH {UTTERANCES}, {_UNITS}, {_ITEMS}, {_PERSONA} SELECT who, type, string_agg(DISTINCT text, ',' ORDER BY text) AS texts FROM persona GROUP BY ALL")
def q16(s, d):
    return op.persona_detail(_persona(s, d)).withColumn("texts", op.tags(F.col("texts")))


@query("q17_person_cards", f"WITH {_SPEAKERS}, {_PLINKS} SELECT person, count(DISTINCT speaker_id) AS n_speakers, count(DISTINCT interview_id) AS n_interviews FROM plinks JOIN speakers USING (speaker_id) GROUP BY 1")
def q17(s, d):
    return op.person_cards(_plinks(s, d), _speakers(s, d))


@query("q18_person_detail", f"WITH {_SPEAKERS}, {_PLINKS} SELECT DISTINCT person, interview_id, display_name FROM plinks JOIN speakers USING (speaker_id)")
def q18(s, d):
    return _plinks(s, d).join(_speakers(s, d), "speaker_id").select("person", "interview_id", "display_name").distinct()


@query("q19_flags", f"WITH {UTTERANCES}, {_CLAIMS} SELECT i AS interview_id, i IN (SELECT interview_id FROM fragments) AS has_fragments, i IN (SELECT interview_id FROM claims WHERE confidence > 0.8) AS has_claims FROM (SELECT DISTINCT conv_id AS i FROM conversations UNION SELECT -1)")
def q19(s, d):
    k = table(s, d, "conversations").select(F.col("conv_id").alias("interview_id")).distinct().unionByName(s.createDataFrame([(-1,)], "interview_id long"))
    return op.flags(k, "interview_id", has_fragments=bind.fragments(s, d), has_claims=_claims(s, d).where("confidence > 0.8"))


@query("q20_unmerged", f"WITH {_SPEAKERS} SELECT project, speaker_id, coalesce(CASE WHEN provisional THEN true END, false) AS provisional FROM speakers WHERE interview_id % 6 <> 2")
def q20(s, d):
    sp = _speakers(s, d).withColumn("merged_into", F.when(F.col("interview_id") % 6 == 2, F.lit("other"))).withColumn("provisional", F.when(F.col("provisional"), F.lit(True)))
    return op.unmerged(sp).select("project", "speaker_id", "provisional")
