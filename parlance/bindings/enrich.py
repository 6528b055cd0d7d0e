"""Enrichment and lens queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance import bind
from parlance.bind import FRAGMENTS, UTTERANCES, share_sql, table
from parlance.functions.ids import hashed_share
from parlance.operators import enrich as op
from parlance.operators import lens as lens_op

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query(
    "e1_context",
    f"""WITH {FRAGMENTS} SELECT a.interview_id, a.seq, string_agg(CASE WHEN b.seq = a.seq THEN '>>> [' || b.role || ']: ' || b.text || ' <<<' ELSE '[' || b.role || ']: ' || b.text END, chr(10) ORDER BY b.seq) AS context
FROM fragments a JOIN fragments b ON a.interview_id = b.interview_id AND b.seq BETWEEN a.seq - 2 AND a.seq + 2 GROUP BY ALL""",
)
def e1(s, d):
    return op.context_windows(bind.fragments(s, d), "interview_id", "role", op.CONTEXTS["immediate"])


@query("e2_utterance_text", f"WITH {UTTERANCES} SELECT interview_id, utterance_no, string_agg(text, ' ' ORDER BY seq) AS text FROM members WHERE utterance_no % 5 <> 4 GROUP BY ALL")
def e2(s, d):
    f = bind.fragments(s, d)
    u = bind.utterances(s, d).where("utterance_no % 5 != 4").select("interview_id", "utterance_no", F.explode(F.sequence("first_seq", "last_seq")).alias("seq"))
    return op.joined_text(f.join(u, ["interview_id", "seq"]), ["interview_id", "utterance_no"], "seq", F.col("text"), " ")


@query("e3_document_text", f"WITH {FRAGMENTS} SELECT interview_id, string_agg('[' || seq || '] [' || role || ']: ' || text, chr(10) ORDER BY seq) AS text FROM fragments GROUP BY 1")
def e3(s, d):
    line = F.concat(F.lit("["), "seq", F.lit("] ["), "role", F.lit("]: "), "text")
    return op.joined_text(bind.fragments(s, d), ["interview_id"], "seq", line, "\n")


#: Declared extractors: name, scope, enabled, template.
EXTRACTORS = (("function", "fragment", True, "Function of: {text}"), ("purpose", "fragment", True, "Purpose of: {text} in {context}"), ("keywords", "fragment", False, "{text}"), ("claims", "utterance", True, "Claims in: {text}"))


def _units(s, d):
    f = bind.fragments(s, d).select(F.col("fragment_id").alias("unit_id"), F.lit("fragment").alias("scope"), "text", F.col("role").alias("context"))
    u = bind.utterances(s, d).select(F.col("utterance_id").alias("unit_id"), F.lit("utterance").alias("scope"), F.col("speaker").alias("text"), F.lit(None).cast("string").alias("context"))
    return f.unionByName(u)


@query("e4_request_plan", f"WITH {UTTERANCES} SELECT fragment_id AS unit_id, 'fragment' AS scope, x AS extractor, CASE x WHEN 'function' THEN 'Function of: ' || text ELSE 'Purpose of: ' || text || ' in ' || role END AS prompt FROM fragments, (VALUES ('function'), ('purpose')) v(x) UNION ALL SELECT utterance_id, 'utterance', 'claims', 'Claims in: ' || speaker FROM utterances")
def e4(s, d):
    return op.request_plan(_units(s, d), s.createDataFrame(list(EXTRACTORS), "extractor string, scope string, enabled boolean, template string"))


def _responses(s, d):
    """Responses as a model might give them: every tenth malformed, with an extra key, or out of range."""
    f = bind.fragments(s, d)
    k = (F.col("confidence") * 1000).cast("int") % 10
    label = F.coalesce(op.rule_label(F.col("text")), F.lit("declarative"))
    good = F.concat(F.lit('{"label":"'), label, F.lit('","confidence":'), F.col("confidence"), F.lit("}"))
    return f.withColumn("label", label).withColumn("response", F.when(k == 0, "not json").when(k == 1, F.concat(F.lit('{"label":"'), label, F.lit('","confidence":0.5,"extra":1}'))).when(k == 2, F.concat(F.lit('{"label":"'), label, F.lit('","confidence":1.5}'))).when(k == 3, '{"confidence":0.5}').otherwise(good))


_RULE = "CASE WHEN rtrim(text) LIKE '%?' THEN 'interrogative' WHEN rtrim(text) LIKE '%!' THEN 'exclamatory' END"
_LABEL = f"coalesce({_RULE}, 'declarative')"
_E5 = f"e5 AS (SELECT fragment_id, text, {_LABEL} AS label, confidence, CAST(round(confidence * 1000) AS INTEGER) % 10 AS k FROM fragments)"
_SCHEMA = T.StructType([T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType())])


@query("e5_validation", f"WITH {FRAGMENTS}, {_E5} SELECT fragment_id, CASE k WHEN 0 THEN 'malformed' WHEN 1 THEN 'extra_keys' WHEN 2 THEN 'confidence_range' WHEN 3 THEN 'missing_label' END AS flag, CASE WHEN k > 3 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN k > 3 THEN label END AS label FROM e5")
def e5(s, d):
    r = op.validate_responses(_responses(s, d).select("fragment_id", "response"), _SCHEMA, {"confidence_range": F.col("_d.confidence").between(0, 1)})
    return r.select("fragment_id", "flag", "status", F.col("data.label").alias("label"))


_ATT = f"""att AS (SELECT fragment_id AS request_id, unnest([1, 2, 3]) AS rank FROM fragments), at2 AS (SELECT *, CASE WHEN {share_sql("request_id || '/' || rank")} < 0.4 THEN 'unavailable' WHEN {share_sql("request_id || '/' || rank")} < 0.6 THEN 'error' ELSE 'ok' END AS outcome, 'p' || rank AS provider FROM att)"""


@query("e6_fallback", f"WITH {FRAGMENTS}, {_ATT} SELECT request_id, rank, outcome, provider, outcome = 'ok' AS served FROM at2 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY outcome = 'unavailable', CASE outcome WHEN 'unavailable' THEN -rank ELSE rank END) = 1")
def e6(s, d):
    a = bind.fragments(s, d).select(F.col("fragment_id").alias("request_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rank"))
    h = hashed_share(F.concat_ws("/", "request_id", "rank"))
    a = a.withColumn("outcome", F.when(h < 0.4, "unavailable").when(h < 0.6, "error").otherwise("ok")).withColumn("provider", F.concat(F.lit("p"), "rank"))
    return op.first_provider(a)


def count_words(prompts: list[str]) -> list[str]:
    """The shipped default model: how many words each prompt has."""
    return ['{"words":%d}' % len([x for x in re.split("[ \t\r\n]+", p) if x]) for p in prompts]


@query("e7_model_call", f"WITH {FRAGMENTS} SELECT fragment_id AS unit_id, 'function' AS extractor, '{{\"words\":' || len(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '')) || '}}' AS response FROM fragments")
def e7(s, d):
    """Any function of a list of prompts can take the default's place."""
    r = bind.fragments(s, d).select(F.col("fragment_id").alias("unit_id"), F.lit("function").alias("extractor"), F.col("text").alias("prompt"))
    return op.model_call(r, count_words)


_OUT = f"""oc AS (SELECT fragment_id, x AS ordinal, 'd' || x AS dimension, {share_sql("fragment_id || '#' || x")} AS confidence FROM fragments, (VALUES (0), (1), (2)) v(x)),
outcomes AS (SELECT *, 'l' || CAST(floor(confidence * 5) AS INTEGER) AS label, CASE WHEN confidence < 0.45 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN confidence > 0.7 THEN 'b' ELSE 'a' END AS provider FROM oc)"""


def _outcomes(s, d):
    o = bind.fragments(s, d).select("fragment_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ordinal"))
    c = hashed_share(F.concat_ws("#", "fragment_id", "ordinal"))
    o = o.withColumn("dimension", F.concat(F.lit("d"), "ordinal")).withColumn("confidence", c)
    return o.withColumns({"label": F.concat(F.lit("l"), F.floor(F.col("confidence") * 5)), "status": F.when(F.col("confidence") < 0.45, "failed").otherwise("ok"), "provider": F.when(F.col("confidence") > 0.7, "b").otherwise("a")})


@query(
    "e8_fold",
    f"""WITH {FRAGMENTS}, {_OUT} SELECT fragment_id, string_agg(dimension || '=' || label, ',' ORDER BY dimension) FILTER (WHERE status = 'ok') AS labels, round(avg(confidence) FILTER (WHERE status = 'ok'), 6) AS mean_confidence,
arg_max(provider, ordinal) FILTER (WHERE status = 'ok') AS last_provider, count(*) FILTER (WHERE status = 'ok') AS n_ok FROM outcomes GROUP BY 1""",
)
def e8(s, d):
    f = op.fold_outcomes(_outcomes(s, d), "fragment_id")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return f.select("fragment_id", F.when(F.col("n_ok") > 0, text).alias("labels"), "mean_confidence", "last_provider", "n_ok")


@query("e9_mixed_providers", f"WITH {FRAGMENTS}, {_OUT} SELECT fragment_id, string_agg(DISTINCT provider, ',' ORDER BY provider) AS mixed_providers FROM outcomes WHERE status = 'ok' GROUP BY 1 HAVING count(DISTINCT provider) > 1")
def e9(s, d):
    return op.fold_outcomes(_outcomes(s, d), "fragment_id").where("mixed_providers is not null").select("fragment_id", "mixed_providers")


@query("e10_cross_check", f"WITH {FRAGMENTS}, {_E5}, x AS (SELECT fragment_id, {_RULE} AS rule_label, CASE k WHEN 0 THEN '' WHEN 1 THEN 'Declarative ' WHEN 2 THEN 'imperative' ELSE label END AS said FROM e5) SELECT fragment_id, rule_label, coalesce(trim(said) <> '' AND lower(trim(said)) <> rule_label, false) AS disagrees FROM x")
def e10(s, d):
    k = F.round(F.col("confidence") * 1000).cast("int") % 10
    f = bind.fragments(s, d).withColumn("said", F.when(k == 0, "").when(k == 1, "Declarative ").when(k == 2, "imperative").otherwise(F.coalesce(op.rule_label(F.col("text")), F.lit("declarative"))))
    return op.cross_check(f, "text", "said").select("fragment_id", "rule_label", "disagrees")


_WORDS = r"wd AS (SELECT fragment_id, interview_id, project_id, seq, unnest(regexp_extract_all(text, '\p{Lu}\p{L}+')) AS word, generate_subscripts(regexp_extract_all(text, '\p{Lu}\p{L}+'), 1) - 1 AS pos FROM fragments)"


def _words(s, d):
    return bind.fragments(s, d).select("fragment_id", "interview_id", "project_id", "seq", F.posexplode(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{L}+"), F.lit(0))).alias("pos", "word"))


@query("e11_mentions", f'WITH {FRAGMENTS}, {_WORDS} SELECT fragment_id, lower(word) AS surface, CAST(pos * 10 AS INTEGER) AS "start", CAST(pos * 10 + length(word) AS INTEGER) AS "end" FROM wd WHERE seq % 3 <> 0 OR pos < 1')
def e11(s, d):
    """Two extractions of some fragments: the later one (which found less) replaces the earlier."""
    w = _words(s, d)
    e = F.struct(F.col("word").alias("text"), F.lit("NAME").alias("entity_type"), (F.col("pos") * 10).alias("start"), (F.col("pos") * 10 + F.length("word")).alias("end"), F.lit(0.9).alias("confidence"))
    first = w.groupBy("fragment_id").agg(F.collect_list(e).alias("entities")).withColumn("version", F.lit(1))
    second = w.where("seq % 3 = 0 and pos < 1").groupBy("fragment_id").agg(F.collect_list(e).alias("entities")).withColumn("version", F.lit(2))
    return op.latest_mentions(first.unionByName(second), "fragment_id").select("fragment_id", "surface", "start", "end")


def _claim_id(*parts):
    return F.concat_ws("/", *parts)


@query("e12_claims", f"WITH {UTTERANCES}, c AS (SELECT utterance_id || '/' || o AS claim_id, utterance_id, speaker, n_fragments, o FROM utterances, (VALUES (0), (1)) v(o)) SELECT claim_id, speaker, CASE o WHEN 0 THEN 'assertion' ELSE 'request' END AS kind, n_fragments AS n_supports FROM c WHERE NOT (o = 1 AND n_fragments % 2 = 0)")
def e12(s, d):
    u = bind.utterances(s, d)
    claims = F.array(F.struct(F.lit("first").alias("text"), F.lit("assertion").alias("kind"), F.lit(0.9).alias("confidence")), F.struct(F.lit("second").alias("text"), F.lit("request").alias("kind"), F.lit(0.6).alias("confidence")))
    known = u.where("n_fragments % 2 = 0").select(F.concat(F.col("utterance_id"), F.lit("/1")).alias("claim_id"))
    members = u.select("utterance_id", F.explode(F.sequence("first_seq", "last_seq")).alias("fragment_id"))
    new, supports = op.record_claims(u.withColumn("claims", claims), members, known, _claim_id)
    n = supports.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_supports"))
    return new.join(n, "claim_id").select("claim_id", "speaker", "kind", "n_supports")


@query("e13_resume", f"WITH {FRAGMENTS} SELECT fragment_id FROM fragments WHERE confidence >= 0.5")
def e13(s, d):
    f = bind.fragments(s, d)
    return op.pending(f, f.where("confidence < 0.5"), "fragment_id").select("fragment_id")


@query("e14_retry", f"WITH {FRAGMENTS}, {_OUT} SELECT fragment_id FROM outcomes GROUP BY 1 HAVING count(*) FILTER (WHERE status = 'ok') = 0")
def e14(s, d):
    return op.retry_set(_outcomes(s, d), "fragment_id")


_SEG = """sg AS (SELECT interview_id, CAST(5 * g AS INTEGER) AS start_index, CAST(least(5 * g + 4, m) + CASE WHEN interview_id % 5 = 1 THEN 1 ELSE 0 END AS INTEGER) AS end_index, 'topic' || g AS topic
FROM (SELECT interview_id, max(seq) AS m FROM fragments GROUP BY 1) n, range(0, 1000) r(g) WHERE 5 * g <= m)"""


def _segments(s, d):
    n = bind.fragments(s, d).groupBy("interview_id").agg(F.max("seq").alias("m"))
    g = n.select("interview_id", "m", F.explode(F.sequence(F.lit(0), F.floor(F.col("m") / 5).cast("int"))).alias("g"))
    end = F.least(F.col("g") * 5 + 4, F.col("m")) + F.when(F.col("interview_id") % 5 == 1, 1).otherwise(0)
    return g.select("interview_id", (F.col("g") * 5).alias("start_index"), end.alias("end_index"), F.concat(F.lit("topic"), "g").alias("topic"))


@query("e15_segments", f"WITH {FRAGMENTS}, {_SEG} SELECT interview_id, start_index, end_index, topic FROM sg WHERE interview_id % 5 <> 1")
def e15(s, d):
    present = bind.fragments(s, d).groupBy("interview_id").agg(F.array_sort(F.collect_list("seq")).alias("present"))
    return op.valid_segments(_segments(s, d), present, "interview_id")


def _ids(p):
    return p.withColumn("segment_id", F.concat_ws("/", "interview_id", "start_index", "end_index"))


@query("e16_conflicts", f"WITH {FRAGMENTS}, {_SEG}, bad AS (SELECT DISTINCT a.interview_id FROM sg a JOIN sg b ON a.interview_id = b.interview_id WHERE b.interview_id % 3 = 0 AND b.start_index >= 5 AND a.start_index <= b.end_index - 1 AND b.start_index <= a.end_index) SELECT interview_id, start_index, topic FROM sg WHERE interview_id NOT IN (SELECT interview_id FROM bad)")
def e16(s, d):
    new = _ids(_segments(s, d))
    live = new.where("interview_id % 3 = 0 and start_index >= 5").withColumn("end_index", F.col("end_index") - 1).withColumn("segment_id", F.concat(F.lit("old"), "segment_id"))
    return op.without_conflicts(new, live, "interview_id").select("interview_id", "start_index", "topic")


@query("e17_record_segments", f"WITH {FRAGMENTS}, {_SEG} SELECT interview_id, start_index, start_index % 4 = 1 AS again FROM sg WHERE start_index % 4 <> 0")
def e17(s, d):
    new = _ids(_segments(s, d))
    state = new.where("start_index % 4 < 2").select("segment_id", (F.col("start_index") % 4 == 1).alias("removed"))
    return op.record_segments(new, state).select("interview_id", "start_index", "again")


def hashed_sql(rows, key, text, more=""):
    """Common table expressions ``hc`` (key, slot, c) and ``hn`` (key, norm) of the hashed word counts of ``rows``."""
    words = f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return f"""hw AS (SELECT {key}{more}, unnest({words}) AS w FROM {rows}), hc AS (SELECT {key}{more}, ('0x' || substr(md5(w), 1, 6))::BIGINT % 32 AS slot, count(*) AS c FROM hw GROUP BY ALL), hn AS (SELECT {key}, sqrt(sum(c * c)) AS norm FROM hc GROUP BY 1)"""


@query("e18_embeddings", f"WITH {FRAGMENTS}, {hashed_sql('fragments', 'fragment_id', 'text')}, v AS (SELECT fragment_id, slot, CAST(round(c / norm * 1000) AS BIGINT) AS x FROM hc JOIN hn USING (fragment_id)), h AS (SELECT fragment_id, i, max(x) AS x FROM (SELECT fragment_id, unnest(range(0, 32)) AS i, 0 AS x FROM fragments UNION ALL SELECT fragment_id, slot, x FROM v) GROUP BY ALL) SELECT fragment_id, 'hashed-words-1' AS model, string_agg(x, ',' ORDER BY i) AS vector FROM h GROUP BY 1")
def e18(s, d):
    """Every component of every vector, in thousandths; vectors of a wrong size are left out (there are none)."""
    v = op.hashed_vectors(bind.fragments(s, d), "fragment_id", "text")
    ok = v.join(op.wrong_dimension(v, {"hashed-words-1": 32}).select("fragment_id"), "fragment_id", "left_anti")
    return ok.select("fragment_id", "model", F.array_join(F.transform("vector", lambda x: F.round(x * 1000).cast("long").cast("string")), ",").alias("vector"))


@query("e19_model_isolation", "WITH v AS (SELECT vec_id, label, CASE WHEN vec_id % 2 = 0 THEN 'm0' ELSE 'm1' END AS model, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT x.model, x.label, x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.e, y.e), 6) AS score FROM v x JOIN v y ON x.model = y.model AND x.label = y.label AND x.vec_id < y.vec_id) SELECT model, label, a, b, round(score, 4) AS score FROM p WHERE score >= 0.25")
def e19(s, d):
    v = table(s, d, "embeddings").withColumn("model", F.when(F.col("vec_id") % 2 == 0, "m0").otherwise("m1"))
    return op.comparable_pairs(v, "vec_id", ["label"], "embedding", 0.25).select("model", "label", "a", "b", F.round("score", 4).alias("score"))


@query("e20_summary", f"WITH {FRAGMENTS}, {_OUT}, n AS (SELECT fragment_id, count(*) FILTER (WHERE status = 'ok') AS ok, count(DISTINCT provider) FILTER (WHERE status = 'ok') AS p FROM outcomes GROUP BY 1) SELECT count(*) AS n_fragments, count(*) FILTER (WHERE ok > 0) AS n_analysed, count(*) FILTER (WHERE ok = 0) AS n_failed, count(*) FILTER (WHERE p > 1) AS n_mixed FROM n")
def e20(s, d):
    f = op.fold_outcomes(_outcomes(s, d), "fragment_id")
    return f.agg(F.count(F.lit(1)).alias("n_fragments"), F.count_if(F.col("n_ok") > 0).alias("n_analysed"), F.count_if(F.col("n_ok") == 0).alias("n_failed"), F.count_if(F.col("mixed_providers").isNotNull()).alias("n_mixed"))


# ------------------------------------------------------------------ lenses

_DECL = "decl(lens, lens_version, type, scope) AS (VALUES " + ", ".join(map(str, lens_op.DECLARED)) + ")"


def _declared(s):
    return s.createDataFrame(list(lens_op.DECLARED), "lens string, lens_version int, type string, scope string")


def _source_units(s, d):
    cols = ("unit_id", "interview_id", "speaker")
    f = bind.fragments(s, d).select(F.col("fragment_id").alias("unit_id"), "interview_id", F.col("role").alias("speaker"))
    u = bind.utterances(s, d).select(F.col("utterance_id").alias("unit_id"), "interview_id", "speaker")
    doc = f.select(F.col("interview_id").cast("string").alias("unit_id"), "interview_id", F.lit(None).cast("string").alias("speaker")).distinct()
    return lens_op.source_units(f.select(*cols), u.select(*cols), doc, _declared(s))


_UNITS = f"""{_DECL}, un AS (SELECT fragment_id AS unit_id, interview_id, role AS speaker, 'fragment' AS scope FROM fragments UNION ALL SELECT utterance_id, interview_id, speaker, 'utterance' FROM utterances UNION ALL SELECT DISTINCT CAST(interview_id AS VARCHAR), interview_id, NULL, 'document' FROM fragments),
lu AS (SELECT * FROM un JOIN decl USING (scope))"""


@query("l1_source_units", f"WITH {UTTERANCES}, {_UNITS} SELECT lens, type, scope, count(*) AS n_units, count(speaker) AS n_spoken FROM lu GROUP BY ALL")
def l1(s, d):
    return _source_units(s, d).groupBy("lens", "type", "scope").agg(F.count(F.lit(1)).alias("n_units"), F.count("speaker").alias("n_spoken"))


def _items(s, d):
    """Items as a lens might return them: one or two per third unit, named speakers in some."""
    u = _source_units(s, d).withColumn("h", hashed_share(F.concat_ws("|", "lens", "type", "unit_id"))).where("h < 0.3")
    who = F.when(F.col("h") < 0.1, "self").when(F.col("h") < 0.2, "USER").otherwise("nobody")
    item = F.struct(F.concat(F.lit("about "), "unit_id").alias("text"), F.col("h").alias("confidence"), who.alias("owner"))
    r = u.select("interview_id", "lens", "type", "unit_id", F.col("speaker").alias("unit_speaker"), F.when(F.col("h") < 0.05, F.array(item, item)).otherwise(F.array(item)).alias("items"))
    return lens_op.explode_items(r, lambda *c: F.concat_ws("|", *c))


_ITEMS = f"""it0 AS (SELECT *, {share_sql("lens || '|' || type || '|' || unit_id")} AS h FROM lu), it1 AS (SELECT *, unnest(range(0, CASE WHEN h < 0.05 THEN 2 ELSE 1 END)) AS ordinal FROM it0 WHERE h < 0.3),
items AS (SELECT interview_id || '|' || lens || '|' || type || '|' || unit_id || '|' || ordinal AS item_id, interview_id, lens, type, unit_id, speaker AS unit_speaker, ordinal, 'about ' || unit_id AS text, h AS confidence,
CASE WHEN h < 0.1 THEN 'self' WHEN h < 0.2 THEN 'USER' ELSE 'nobody' END AS owner FROM it1)"""


@query("l2_items", f"WITH {UTTERANCES}, {_UNITS}, {_ITEMS} SELECT item_id, type, unit_id, text, confidence FROM items")
def l2(s, d):
    return _items(s, d).select("item_id", "type", "unit_id", "text", "confidence")


def _speakers(s, d):
    r = bind.fragments(s, d).groupBy("interview_id", F.col("role").alias("handle")).agg(F.min("seq").alias("ordinal"))
    return r.select("interview_id", F.concat_ws("/", "interview_id", "handle").alias("speaker_id"), "handle", F.initcap("handle").alias("display_name"), "ordinal", F.lit(None).cast("string").alias("merged_into"))


_SPK = "spk AS (SELECT interview_id, role AS handle, interview_id || '/' || role AS speaker_id, min(seq) AS ordinal FROM fragments GROUP BY ALL)"
_RES = "res AS (SELECT i.*, CASE WHEN owner = 'self' THEN unit_speaker ELSE s.speaker_id END AS owner_speaker FROM items i LEFT JOIN spk s ON s.interview_id = i.interview_id AND s.handle = lower(owner))"


@query("l3_item_speakers", f"WITH {UTTERANCES}, {_UNITS}, {_ITEMS}, {_SPK}, {_RES} SELECT item_id, owner, owner_speaker FROM res")
@bind.reads_fragments
def l3(s, d):
    return lens_op.resolve_speakers(_items(s, d), _speakers(s, d), "owner").select("item_id", "owner", "owner_speaker")


@query("l4_unresolved", f"WITH {UTTERANCES}, {_UNITS}, {_ITEMS}, {_SPK}, {_RES} SELECT item_id, owner AS owner_unresolved FROM res WHERE owner_speaker IS NULL")
def l4(s, d):
    return lens_op.resolve_speakers(_items(s, d), _speakers(s, d), "owner").where("owner_unresolved is not null").select("item_id", "owner_unresolved")


@query("l5_idempotent", f"WITH {UTTERANCES}, {_UNITS}, {_ITEMS} SELECT lens, count(*) FILTER (WHERE confidence >= 0.2) AS extracted, count(*) FILTER (WHERE confidence < 0.2 AND ordinal = 0) AS existing, count(*) FILTER (WHERE confidence < 0.2 AND ordinal = 1) AS locked FROM items GROUP BY 1")
def l5(s, d):
    i = _items(s, d)
    c = lens_op.classify_items(i, i.where("confidence < 0.2").select("item_id", (F.col("ordinal") == 1).alias("locked")))
    return c.groupBy("lens").agg(*(F.count_if(F.col("outcome") == x).alias(x) for x in ("extracted", "existing", "locked")))


@query("l6_supersede", f"WITH {UTTERANCES}, {_UNITS}, {_ITEMS}, v AS (SELECT *, CASE WHEN confidence < 0.15 THEN 1 ELSE 2 END AS ver, confidence < 0.03 AS locked FROM items) SELECT item_id, ver AS lens_version, locked FROM v QUALIFY locked OR ver >= max(ver) OVER (PARTITION BY interview_id, lens)")
def l6(s, d):
    i = _items(s, d).withColumn("lens_version", F.when(F.col("confidence") < 0.15, 1).otherwise(2)).withColumn("locked", F.col("confidence") < 0.03)
    return lens_op.supersede(i, ["interview_id", "lens"]).select("item_id", "lens_version", "locked")


@query("l7_override", f"WITH {UTTERANCES}, {_UNITS}, {_ITEMS} SELECT item_id, CASE WHEN confidence < 0.1 THEN 'status=v2,text=' || text ELSE 'status=open,text=' || text END AS fields, confidence < 0.1 AS locked FROM items")
def l7(s, d):
    i = _items(s, d).withColumn("fields", F.create_map(F.lit("text"), F.col("text"), F.lit("status"), F.lit("open"))).withColumn("locked", F.lit(False))
    o = i.where("confidence < 0.1").select("item_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("version")).withColumn("fields", F.create_map(F.lit("status"), F.concat(F.lit("v"), "version")))
    out = lens_op.apply_overrides(i.select("item_id", "fields", "locked"), o)
    return out.select("item_id", F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("fields"), "locked")


@query("l8_flatten", f"""WITH {UTTERANCES}, {_UNITS}, {_ITEMS} SELECT item_id, 'due=' || type || ',field_lens=' || lens || ',n=' || length(text) || ',of={{"lens":"' || lens || '","marks":[1,' || length(type) || ']}},tags=["' || lens || '"],text=' || text AS fields FROM items""")
def l8(s, d):
    made = F.to_json(F.struct("text", "lens", F.col("type").alias("due"), F.array("lens").alias("tags"), F.length("text").alias("n"), F.struct("lens", F.array(F.lit(1), F.length("type")).alias("marks")).alias("of")))
    i = _items(s, d).select("item_id", lens_op.flatten_fields(made).alias("fields"))
    return i.select("item_id", F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("fields"))


@query(
    "l9_grounding",
    f"""WITH {UTTERANCES}, {_UNITS}, {_ITEMS}, sup AS (SELECT utterance_id AS unit_id, fragment_id FROM members JOIN utterances USING (interview_id, utterance_no) UNION ALL SELECT fragment_id, fragment_id FROM fragments UNION ALL SELECT CAST(interview_id AS VARCHAR), interview_id || ':-1' FROM fragments WHERE seq = 0),
x AS (SELECT item_id, CASE WHEN fragment_id LIKE '%:-1' THEN 'refused' ELSE 'support' END AS link FROM items JOIN sup USING (unit_id)) SELECT item_id, link, count(*) AS n FROM x GROUP BY ALL""",
)
def l9(s, d):
    f = bind.fragments(s, d)
    u = bind.utterances(s, d)
    sup = u.select(F.col("utterance_id").alias("unit_id"), "interview_id", F.explode(F.sequence("first_seq", "last_seq")).alias("seq")).select("unit_id", F.concat_ws(":", "interview_id", "seq").alias("fragment_id"))
    sup = sup.unionByName(f.select(F.col("fragment_id").alias("unit_id"), "fragment_id")).unionByName(f.where("seq = 0").select(F.col("interview_id").cast("string").alias("unit_id"), F.concat(F.col("interview_id"), F.lit(":-1")).alias("fragment_id")))
    items = _items(s, d).select("item_id", "unit_id", F.lit(None).cast("string").alias("speaker_id"), F.lit("owner").alias("role"))
    good, _, refused = lens_op.ground_items(items, sup, f, _speakers(s, d))
    both = good.select("item_id", F.lit("support").alias("link")).unionByName(refused.select("item_id", F.lit("refused").alias("link")))
    return both.groupBy("item_id", "link").agg(F.count(F.lit(1)).alias("n"))
