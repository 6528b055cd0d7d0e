"""Export and source/sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance import bind
from parlance.bind import FRAGMENTS, TRANSCRIPTS, UTTERANCES, share_sql, table
from parlance.bindings.enrich import _ITEMS, _RES, _SPK, _UNITS, _items
from parlance.bindings.enrich import _speakers as _lens_speakers
from parlance.bindings.read import _CLAIMS, _SUP_IN, _claims, _members, _supports
from parlance.bindings.resolve import _M, _mentions
from parlance.functions.ids import hashed_share
from parlance.operators import export as op
from parlance.operators import lens as lens_op
from parlance.plans.scratch import materialise, scratch_dir
from parlance.sources import io

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_AN = """mm AS (SELECT *, CASE WHEN utterance_no % 4 <> 3 THEN utterance_no END AS un FROM members), fu AS (SELECT interview_id, un, row_number() OVER (PARTITION BY interview_id ORDER BY min(seq)) AS n FROM mm WHERE un IS NOT NULL GROUP BY ALL),
anch AS (SELECT mm.*, CASE WHEN n IS NOT NULL THEN 'u-' || n ELSE 'f-' || seq END AS anchor FROM mm LEFT JOIN fu ON fu.interview_id = mm.interview_id AND fu.un = mm.un)""".replace("GROUP BY ALL", "GROUP BY interview_id, un")


def _anchored(s, d):
    f = bind.fragments(s, d).select("interview_id", "fragment_id", "seq", "text", F.col("role").alias("speaker"))
    u = bind.utterances(s, d).select("interview_id", F.when(F.col("utterance_no") % 4 != 3, F.col("utterance_id")).alias("utterance_id"), F.explode(F.sequence("first_seq", "last_seq")).alias("seq"))
    return op.anchors(f.join(u, ["interview_id", "seq"]))


@query("x1_anchors", f"WITH {UTTERANCES}, {_AN} SELECT fragment_id, anchor FROM anch")
def x1(s, d):
    return _anchored(s, d).select("fragment_id", "anchor")


_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"


@query(
    "x3_slugs",
    f"""WITH RECURSIVE nm AS (SELECT p_partkey, p_partkey % 3 AS bundle, CASE WHEN p_partkey % 17 = 0 THEN '!?' WHEN p_partkey % 13 = 0 THEN p_type || ' 2' WHEN p_partkey % 11 = 0 THEN p_type || ' 2-2' WHEN p_partkey % 7 = 0 THEN p_type || ' (3)' ELSE p_type END AS name FROM part),
b AS (SELECT *, CASE WHEN {_SLUG.format('name')} = '' THEN 'x-' || substr(sha1(name), 1, 8) ELSE {_SLUG.format('name')} END AS base FROM nm),
o AS (SELECT *, row_number() OVER (PARTITION BY bundle, regexp_replace(base, '(-[0-9]+)+$', '') ORDER BY p_partkey) AS k, regexp_replace(base, '(-[0-9]+)+$', '') AS stem FROM b),
reg(bundle, stem, k, p_partkey, slug, taken) AS (SELECT DISTINCT bundle, stem, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, []::VARCHAR[] FROM o
UNION ALL SELECT bundle, stem, k, p_partkey, slug, list_append(taken, slug) FROM (SELECT o.bundle, o.stem, o.k, o.p_partkey, taken, CASE WHEN list_contains(taken, base) THEN base || '-' || list_filter(range(2, len(taken) + 3), lambda n: NOT list_contains(taken, base || '-' || n))[1] ELSE base END AS slug
FROM reg JOIN o ON o.bundle = reg.bundle AND o.stem = reg.stem AND o.k = reg.k + 1) x)
SELECT p_partkey, bundle, slug FROM reg WHERE k > 0""",
)
def x3(s, d):
    """Names of parts, some ending in numbers that others' suffixes run into, as a registry would give them."""
    k, t = F.col("p_partkey"), F.col("p_type")
    name = F.when(k % 17 == 0, "!?").when(k % 13 == 0, F.concat(t, F.lit(" 2"))).when(k % 11 == 0, F.concat(t, F.lit(" 2-2"))).when(k % 7 == 0, F.concat(t, F.lit(" (3)"))).otherwise(t)
    p = table(s, d, "part").select("p_partkey", (k % 3).alias("bundle"), name.alias("name"))
    return op.unique_slugs(p, "bundle", "name", "p_partkey").select("p_partkey", "bundle", "slug")


@query("x4_tallies", f"WITH {FRAGMENTS}, w AS (SELECT interview_id, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS value FROM fragments), n AS (SELECT interview_id, value, count(*) AS n FROM w GROUP BY ALL) SELECT interview_id, value, n, CAST(row_number() OVER (PARTITION BY interview_id ORDER BY n DESC, value) AS INTEGER) AS place FROM n")
def x4(s, d):
    f = bind.fragments(s, d).withColumn("words", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    return op.tallies(f, "interview_id", "words")


@query(
    "x5_transcript_documents",
    f"""WITH {UTTERANCES}, {_AN}, t AS (SELECT *, CASE WHEN interview_id % 2 = 0 THEN 'topic ' || (seq // 7) END AS topic FROM anch), l AS (SELECT *, lag(topic) OVER w AS lt, lag(anchor) OVER w AS la FROM t WINDOW w AS (PARTITION BY interview_id ORDER BY seq))
SELECT interview_id, string_agg(CASE WHEN topic IS NOT NULL AND topic IS DISTINCT FROM lt THEN '## ' || topic || chr(10) ELSE '' END || CASE WHEN anchor IS DISTINCT FROM la THEN '**' || role || '** {{#' || anchor || '}}' || chr(10) ELSE '' END || text, chr(10) ORDER BY seq) AS content FROM l GROUP BY 1""",
)
@bind.reads_fragments
def x5(s, d):
    topic = F.when(F.col("interview_id") % 2 == 0, F.concat(F.lit("topic "), F.floor(F.col("seq") / 7)))
    return op.transcript_documents(_anchored(s, d).withColumn("topic", topic))


_QUOTE = "'> ' || text || chr(10) || '> — ' || role || ', [' || anchor || '](/transcript.md#' || anchor || ')'"


@query("x6_quotes", f"WITH {UTTERANCES}, {_AN}, {_CLAIMS} SELECT claim_id, string_agg({_QUOTE}, chr(10) ORDER BY seq) AS quotes FROM claims JOIN anch USING (interview_id, utterance_no) GROUP BY 1")
@bind.reads_fragments
def x6(s, d):
    sup = _claims(s, d).select("claim_id", "utterance_id").join(_members(s, d), "utterance_id").select("claim_id", "fragment_id")
    return op.quotes(sup, _anchored(s, d), "claim_id")


@query("x7_back_links", f"WITH {UTTERANCES}, {_UNITS}, {_ITEMS}, {_CLAIMS}, l AS (SELECT interview_id || '/' || unit_speaker AS speaker_id, 'item:' || type AS t FROM items WHERE unit_speaker IS NOT NULL UNION ALL SELECT speaker_id, 'claim:' || CAST(utterance_no % 3 AS VARCHAR) FROM claims) SELECT speaker_id, string_agg(DISTINCT t, ',' ORDER BY t) AS back_links, count(*) AS n_links FROM l GROUP BY 1")
@bind.reads_fragments
def x7(s, d):
    i = _items(s, d).where("unit_speaker is not null").select(F.concat_ws("/", "interview_id", "unit_speaker").alias("speaker_id"), F.lit("item").alias("kind"), F.col("type").alias("target"))
    c = bind.utterances(s, d).select(F.concat_ws("/", "interview_id", "speaker").alias("speaker_id"), F.lit("claim").alias("kind"), (F.col("utterance_no") % 3).cast("string").alias("target"))
    return op.back_links(i.unionByName(c), "speaker_id")


_PAGED = "pg AS (SELECT CASE WHEN length(surface) % 3 = 0 THEN 'c-' || lower(left(surface, 2)) ELSE 'surface:' || surface END AS page, * FROM mentions)"


def _aliases(s, d):
    return _aliases_of(_mentions(s, d))


def _aliases_of(mentions):
    return mentions.where(F.length("surface") % 3 == 0).select("surface", F.concat(F.lit("c-"), F.lower(F.substring("surface", 1, 2))).alias("canonical_id")).distinct()


@query("x8_entity_pages", f"WITH {_M}, {_PAGED}, a AS (SELECT page, surface AS alias, count(*) AS n_alias_mentions FROM pg GROUP BY ALL) SELECT page, alias, CAST(row_number() OVER (PARTITION BY page ORDER BY alias) AS INTEGER) AS place, n_alias_mentions, CAST(sum(n_alias_mentions) OVER (PARTITION BY page) AS BIGINT) AS n_mentions, count(*) OVER (PARTITION BY page) AS n_surfaces FROM a")
@bind.reads_fragments
def x8(s, d):
    return op.entity_pages(_mentions(s, d), _aliases(s, d))


_MROWS = rf"""mr AS (SELECT fragment_id, surface, generate_subscripts(ms, 1) - 1 AS pos FROM (SELECT fragment_id, ms, unnest(ms) AS surface FROM (SELECT fragment_id, regexp_extract_all(text, '\p{{Lu}}[\p{{L}}'']+') AS ms FROM fragments)))"""


@query(
    "x8_mention_tables",
    rf"""WITH {UTTERANCES}, {_AN}, {_MROWS} SELECT CASE WHEN length(surface) % 3 = 0 THEN 'c-' || lower(left(surface, 2)) ELSE 'surface:' || surface END AS page, interview_id, seq, CAST(pos AS INTEGER) AS pos,
replace(surface, '|', '\|') AS "text", {share_sql("fragment_id || '@' || pos")} AS confidence, '[' || anchor || '](/transcript.md#' || anchor || ')' AS location FROM mr JOIN anch USING (fragment_id)""",
)
@bind.reads_fragments
def x8_mentions(s, d):
    m = bind.fragments(s, d).select("fragment_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\p{Lu}[\p{L}']+"), F.lit(0))).alias("pos", "surface"))
    m = m.withColumn("confidence", hashed_share(F.concat_ws("@", "fragment_id", "pos")))
    return op.mention_tables(m, _aliases(s, d), _anchored(s, d))


def _documents(s, d):
    """Items and claims of each bundle as documents, with the quotes they rest on."""
    an, items = materialise(_anchored(s, d)), materialise(_items(s, d))
    bundle = F.concat(F.lit("b"), F.col("interview_id") % 5).alias("bundle")
    owner = lens_op.resolve_speakers(items, _lens_speakers(s, d), "owner")
    i = op.unique_slugs(owner.select("item_id", bundle, "lens", "type", "text", "confidence", F.col("owner_speaker").alias("speaker")), "bundle", "item_id", "item_id")
    c = _claims(s, d).select("claim_id", bundle, F.concat(F.lit("said [in] "), "utterance_id", F.lit("\\")).alias("text"), F.lit("assertion").alias("claim_kind"), "confidence", F.col("speaker_id").alias("speaker"), "utterance_id")
    of_claims = c.select("claim_id", "utterance_id").join(_members(s, d), "utterance_id").select("claim_id", "fragment_id")
    c = op.unique_slugs(c.drop("utterance_id"), "bundle", "claim_id", "claim_id")
    return op.item_documents(i, op.quotes(_supports(s, d, items), an, "item_id")).unionByName(op.claim_documents(c, op.quotes(of_claims, an, "claim_id")))


def _slugged(key):
    k = f"row_number() OVER (PARTITION BY bundle, base ORDER BY {key})"
    return f"base || CASE WHEN {k} > 1 THEN '-' || {k} ELSE '' END"


def _title(text):
    return rf"regexp_replace(left(trim(regexp_replace({text}, '\s+', ' ', 'g')), 80), '([\[\]\\])', '\\\1', 'g')"


_DOCS = f"""{_AN}, {_SUP_IN}, {_SPK}, {_RES}, {_CLAIMS},
iq AS (SELECT item_id, string_agg({_QUOTE}, chr(10) ORDER BY interview_id, seq) AS quotes FROM sup JOIN anch USING (fragment_id) GROUP BY 1),
cq AS (SELECT claim_id, string_agg({_QUOTE}, chr(10) ORDER BY seq) AS quotes FROM claims JOIN anch USING (interview_id, utterance_no) GROUP BY 1),
dk AS (SELECT *, 'b' || (interview_id % 5) AS bundle, {_SLUG.format("item_id")} AS base FROM res), ck AS (SELECT *, 'b' || (interview_id % 5) AS bundle, 'said [in] ' || utterance_id || '\\' AS text, {_SLUG.format("claim_id")} AS base FROM claims),
ds AS (SELECT *, {_slugged("item_id")} AS slug FROM dk), cs AS (SELECT *, {_slugged("claim_id")} AS slug FROM ck),
docs AS (SELECT bundle, 'item' AS kind, type || 's/' || slug || '.md' AS path, '---' || chr(10) || 'type: ' || type || chr(10) || 'title: ' || {_title("text")} || chr(10) || 'item_id: ' || item_id || chr(10) || 'lens: ' || lens || chr(10) || 'confidence: ' || CAST(confidence AS DOUBLE) || chr(10) || 'tags: [lens:' || lens || ']' || chr(10) || '---' || chr(10)
|| text || chr(10) || chr(10) || '## Relationships' || chr(10) || coalesce('OWNER: ' || {_title("owner_speaker")} || chr(10), '') || chr(10) || '## Grounding' || chr(10) || coalesce(quotes, '') AS content FROM ds LEFT JOIN iq USING (item_id)
UNION ALL SELECT bundle, 'claim', 'claims/' || slug || '.md', '---' || chr(10) || 'type: Claim' || chr(10) || 'title: ' || {_title("text")} || chr(10) || 'item_id: ' || claim_id || chr(10) || 'kind: assertion' || chr(10) || 'confidence: ' || CAST(confidence AS DOUBLE) || chr(10) || '---' || chr(10)
|| text || chr(10) || chr(10) || '## Relationships' || chr(10) || 'MADE_BY: ' || {_title("speaker_id")} || chr(10) || chr(10) || '## Grounding' || chr(10) || coalesce(quotes, '') FROM cs LEFT JOIN cq USING (claim_id))"""


@query("x9_item_documents", f"WITH {UTTERANCES}, {_UNITS}, {_ITEMS}, {_DOCS} SELECT * FROM docs")
@bind.reads_fragments
def x9(s, d):
    return _documents(s, d)


@query("x10_index", f"WITH {UTTERANCES}, {_UNITS}, {_ITEMS}, {_DOCS}, l AS (SELECT bundle, split_part(path, '/', 1) AS section, string_agg('- [page](' || path || ')', chr(10) ORDER BY path) AS lines FROM docs GROUP BY ALL) SELECT bundle, string_agg('## ' || section || chr(10) || lines, chr(10) || chr(10) ORDER BY section) AS content FROM l GROUP BY 1")
@bind.reads_fragments
def x10(s, d):
    return op.index_documents(_documents(s, d).select("bundle", F.split("path", "/")[0].alias("section"), F.lit("page").alias("title"), "path"))


_FILES = f"""{_PAGED.replace("FROM mentions", "FROM mr JOIN fragments USING (fragment_id)")}, ef AS (SELECT 'b' || (interview_id % 5) AS bundle, page, string_agg(DISTINCT surface, ', ' ORDER BY surface) AS names FROM pg GROUP BY ALL),
files AS (SELECT * FROM docs UNION ALL SELECT bundle, 'entity', 'entities/' || page, names FROM ef),
hd AS (SELECT 'b' || (interview_id % 5) AS bundle, count(DISTINCT interview_id) AS n_interviews, count(DISTINCT interview_id || '/' || role) AS n_speakers, count(*) AS n_fragments, count(DISTINCT interview_id || ':' || utterance_no) AS n_utterances FROM members GROUP BY 1)"""


@query(
    "x11_manifest",
    f"""WITH {UTTERANCES}, {_UNITS}, {_ITEMS}, {_DOCS}, {_MROWS}, {_FILES}, n AS (SELECT bundle, count(*) AS n_files, count(*) FILTER (WHERE kind = 'item') AS n_items, count(*) FILTER (WHERE kind = 'claim') AS n_claims, count(*) FILTER (WHERE kind = 'entity') AS n_entities,
CAST(sum(length(content)) AS BIGINT) AS n_chars, CAST(sum(('0x' || substr(sha256(path || chr(10) || content), 1, 7))::BIGINT) AS BIGINT) AS content_digest FROM files GROUP BY 1) SELECT * FROM n LEFT JOIN hd USING (bundle)""",
)
@bind.reads_fragments
def x11(s, d):
    m = materialise(_mentions(s, d).select("surface", F.concat(F.lit("b"), F.col("interview_id") % 5).alias("bundle")).distinct())
    e = op.paged(m, _aliases_of(m)).groupBy("bundle", "page").agg(F.array_join(F.array_sort(F.collect_set("surface")), ", ").alias("content"))
    files = _documents(s, d).unionByName(e.select("bundle", F.lit("entity").alias("kind"), F.concat(F.lit("entities/"), "page").alias("path"), "content"))
    u = bind.utterances(s, d).withColumn("bundle", F.concat(F.lit("b"), F.col("interview_id") % 5))
    h = u.groupBy("bundle").agg(F.count_distinct("interview_id").alias("n_interviews"), F.count_distinct("interview_id", "speaker").alias("n_speakers"), F.sum("n_fragments").alias("n_fragments"), F.count(F.lit(1)).alias("n_utterances"))
    return op.manifest(files, h)


@query("x12_export_log", "SELECT CAST(ts AS DATE) AS day, event_id AS entry_id, event_type || event_id AS message FROM events ORDER BY ts DESC, event_id DESC")
def x12(s, d):
    return op.export_log(table(s, d, "events").select("ts", F.col("event_id").alias("entry_id"), F.concat("event_type", "event_id").alias("message"))).select("day", "entry_id", "message")


# ------------------------------------------------------------------ sources and sinks


@query("s1_scan_texts", f"WITH {TRANSCRIPTS} SELECT interview_id, CASE WHEN interview_id % 7 <> 3 THEN sha256(text || chr(10)) END AS content_sha256, CASE WHEN interview_id % 7 = 3 THEN 'not UTF-8' END AS error FROM transcripts")
def s1(s, d):
    """Transcripts written as files and scanned back, one text per file; every seventh has a byte that is no UTF-8."""
    path = scratch_dir(s)
    bad = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF"))).cast("string")
    io.write_texts(bind.transcripts(s, d).withColumn("text", F.when(F.col("interview_id") % 7 == 3, bad).otherwise(F.col("text"))), path, "interview_id", "text")
    good, quarantine = io.scan_texts(s, path)
    both = good.select("path", F.sha2("text", 256).alias("content_sha256"), F.lit(None).cast("string").alias("error")).unionByName(quarantine.select("path", F.lit(None).cast("string").alias("content_sha256"), "error"))
    return both.select(F.regexp_extract("path", r"interview_id=(-?\d+)", 1).cast("long").alias("interview_id"), "content_sha256", "error")


@query("s2_maps", f"WITH {FRAGMENTS} SELECT project_id AS source, count(*) AS n, CAST(sum(end_char - start_char) AS BIGINT) AS n_chars FROM fragments WHERE project_id <> 'p1' OR seq < 2 GROUP BY 1")
def s2(s, d):
    """Map rows per source; the second write replaces one source only."""
    path = scratch_dir(s)
    f = bind.fragments(s, d).select("fragment_id", "seq", "text", "start_char", "end_char", F.col("project_id").alias("source"))
    io.write_maps(f, path, "source")
    io.write_maps(f.where("source = 'p1' and seq < 2"), path, "source")
    back = s.read.schema("fragment_id string, seq int, text string, start_char int, end_char int, source string").json(path)
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_char") - F.col("start_char")).alias("n_chars"))


@query("s3_result_lines", f"WITH {FRAGMENTS}, k AS (SELECT CAST(round(confidence * 1000) AS INTEGER) % 10 AS k FROM fragments) SELECT CASE WHEN k IN (0, 1) THEN 'bad' ELSE 'good' END AS kind, count(*) AS n FROM k WHERE k <> 2 GROUP BY 1")
def s3(s, d):
    path = scratch_dir(s)
    k = F.round(F.col("confidence") * 1000).cast("int") % 10
    whole = F.to_json(F.struct(F.col("fragment_id").alias("id"), F.col("role").alias("label")))
    bind.fragments(s, d).select(F.when(k == 0, "{broken").when(k == 1, '{"label":"x"}').when(k == 2, "  ").otherwise(whole).alias("value")).write.text(path)
    good, bad = io.read_result_lines(s, path, T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.StringType())]), ["id", "label"])
    both = good.select(F.lit("good").alias("kind")).unionByName(bad.select(F.lit("bad").alias("kind")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("s5_first_row", "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1")
def s5(s, d):
    return io.first_rows(table(s, d, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("s6_csv", "SELECT conv_id, turn, role, text FROM conversations")
def s6(s, d):
    path = scratch_dir(s)
    io.write_csv(table(s, d, "conversations").select("conv_id", "turn", "role", "text"), path)
    return io.read_csv(s, path, "conv_id long, turn long, role string, text string")


@query("s9_parked", f"SELECT event_type, count(*) AS n, CAST(sum(event_id % 5) AS BIGINT) AS retries FROM events WHERE {share_sql('event_id')} < 0.1 GROUP BY 1")
def s9(s, d):
    path = scratch_dir(s)
    e = table(s, d, "events").where(hashed_share(F.col("event_id")) < 0.1).select("event_id", "event_type", F.lit("no referent").alias("error_message"), (F.col("event_id") % 5).alias("retries"), F.lit(1).alias("lane"))
    io.park(e, path, "MissingReferent")
    return io.read_parked(s, path, "event_id long, event_type string").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("retries").alias("retries"))


@query("s10_bundles", f"WITH {UTTERANCES}, {_UNITS}, {_ITEMS}, {_DOCS} SELECT bundle, path, length(content) AS n_chars FROM docs")
def s10(s, d):
    path = scratch_dir(s)
    io.write_bundle(_documents(s, d).select("bundle", "path", "content"), path)
    return s.read.parquet(path).select("bundle", "path", F.length("content").cast("long").alias("n_chars"))
