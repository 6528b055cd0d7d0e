"""Resolution and edge-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance import bind
from parlance.bind import FRAGMENTS, share_sql, table
from parlance.functions.ids import hashed_share
from parlance.functions.text import collapse, surface_key
from parlance.operators import corrections
from parlance.operators import graph as g_op
from parlance.operators import resolve as op
from parlance.plans.scratch import materialise

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _mentions(s, d):
    w = F.explode(F.regexp_extract_all("text", F.lit(r"\p{Lu}[\p{L}']+"), F.lit(0)))
    m = bind.fragments(s, d).select("project_id", "fragment_id", "interview_id", w.alias("surface"))
    return m.withColumn("entity_type", F.when(F.length("surface") % 2 == 0, "ORG").otherwise("PERSON"))


def _surfaces(s, d):
    return op.surface_counts(_mentions(s, d))


_M = FRAGMENTS + r""", mentions AS (SELECT project_id, fragment_id, interview_id, surface, CASE WHEN length(surface) % 2 = 0 THEN 'ORG' ELSE 'PERSON' END AS entity_type
FROM (SELECT project_id, fragment_id, interview_id, unnest(regexp_extract_all(text, '\p{Lu}[\p{L}'']+')) AS surface FROM fragments)),
surfaces AS (SELECT project_id, surface, entity_type, count(*) AS mentions FROM mentions GROUP BY ALL)"""


def surface_sql(c):
    n = rf"regexp_replace(regexp_replace(trim(regexp_replace(lower({c}), '[ \t\r\n]+', ' ', 'g')), '^(the|an|a) (.+)$', '\2'), '(''s|’s|''|’)$', '')"
    return f"CASE WHEN length({n}) > 3 AND {n} LIKE '%s' AND {n} NOT LIKE '%ss' THEN left({n}, length({n}) - 1) ELSE {n} END"


@query("r1_surfaces", f"WITH {_M} SELECT * FROM surfaces")
def r1(s, d):
    return _surfaces(s, d)


@query("r2_surface_keys", f"""WITH x AS (SELECT p_partkey, unnest([p_name, 'The  ' || p_name, p_name || '''s', upper(p_type) || 's']) AS surface, generate_subscripts([1, 2, 3, 4], 1) AS form FROM part) SELECT p_partkey, form, {surface_sql("surface")} AS surface_key FROM x""")
def r2(s, d):
    p = table(s, d, "part").select("p_partkey", F.posexplode(F.array("p_name", F.concat(F.lit("The  "), "p_name"), F.concat("p_name", F.lit("'s")), F.concat(F.upper("p_type"), F.lit("s")))).alias("form", "surface"))
    return p.select("p_partkey", (F.col("form") + 1).cast("long").alias("form"), surface_key(F.col("surface")).alias("surface_key"))


@query("r3_name_keys", r"SELECT p_partkey, trim(regexp_replace(lower('  ' || p_name || '  ' || p_type), '[ \t\r\n]+', ' ', 'g')) AS name_key FROM part")
def r3(s, d):
    return table(s, d, "part").select("p_partkey", collapse(F.concat(F.lit("  "), "p_name", F.lit("  "), "p_type")).alias("name_key"))


_G = f"""gr AS (SELECT project_id, entity_type, {surface_sql("surface")} AS norm, surface, mentions FROM surfaces)"""


@query("r4_exact_groups", f"WITH {_M}, {_G} SELECT project_id, entity_type, norm, count(*) AS n_surfaces, CAST(sum(mentions) AS BIGINT) AS mentions FROM gr GROUP BY ALL")
def r4(s, d):
    return op.exact_groups(_surfaces(s, d)).drop("representative")


@query("r5_representatives", f"WITH {_M}, {_G} SELECT project_id, entity_type, norm, surface AS representative FROM gr QUALIFY row_number() OVER (PARTITION BY project_id, entity_type, norm ORDER BY mentions DESC, surface) = 1")
def r5(s, d):
    return op.exact_groups(_surfaces(s, d)).select("project_id", "entity_type", "norm", "representative")


_LOW, _HIGH = 0.30, 0.40
_PAIRS = f"""pr AS (SELECT x.label, x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS score FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id),
pairs AS (SELECT *, CASE WHEN score >= {_HIGH} THEN 'auto' ELSE 'suggest' END AS band FROM pr WHERE score >= {_LOW})"""


def _pairs(s, d):
    return op.similar_pairs(table(s, d, "embeddings"), "vec_id", ["label"], "embedding", _LOW, _HIGH)


@query("r6_similar_pairs", f"WITH {_PAIRS} SELECT label, a, b, band, round(score, 4) AS score FROM pairs")
def r6(s, d):
    return _pairs(s, d).withColumn("score", F.round("score", 4))


_CLUSTERS = """e AS (SELECT a, b FROM pairs WHERE band = 'auto' UNION SELECT b, a FROM pairs WHERE band = 'auto'), c(node, low) AS (SELECT a, a FROM e UNION SELECT e.b, c.low FROM c JOIN e ON e.a = c.node WHERE c.low < e.b),
clusters AS (SELECT node, min(low) AS component FROM c GROUP BY node)"""


@query("r7_clusters", f"WITH RECURSIVE {_PAIRS}, {_CLUSTERS} SELECT * FROM clusters")
def r7(s, d):
    return op.clusters(_pairs(s, d))


_ALIAS = "al AS (SELECT node, CASE WHEN node % 3 = 0 THEN 'c' || (node % 2) END AS canonical_id, node % 9 = 0 AS locked FROM clusters)"


def _assigned(s, d):
    m = op.clusters(_pairs(s, d)).withColumnRenamed("node", "surface")
    al = m.where("surface % 3 = 0").select("surface", F.concat(F.lit("c"), F.col("surface") % 2).alias("canonical_id"), (F.col("surface") % 9 == 0).alias("locked"))
    return op.assign_canonicals(m, al, lambda c: F.concat(F.lit("new"), c))


_ASSIGN = """asg AS (SELECT component, count(DISTINCT canonical_id) AS n, min(canonical_id) AS owner, count(*) FILTER (WHERE canonical_id IS NULL) AS n_new, coalesce(bool_or(locked) FILTER (WHERE canonical_id IS NOT NULL), false) AS locked FROM clusters JOIN al USING (node) GROUP BY 1),
assigned AS (SELECT component, CASE WHEN n > 1 THEN 'suggest' WHEN n = 1 AND locked AND n_new > 0 THEN 'skipped_locked' WHEN n = 1 THEN 'extend' ELSE 'create' END AS decision, CASE WHEN n = 1 THEN owner WHEN n = 0 THEN 'new' || component END AS canonical_id, n_new FROM asg)"""


@query("r8_canonicals", f"WITH RECURSIVE {_PAIRS}, {_CLUSTERS}, {_ALIAS}, {_ASSIGN} SELECT * FROM assigned")
def r8(s, d):
    return _assigned(s, d)


@query("r9_locked_skips", f"WITH RECURSIVE {_PAIRS}, {_CLUSTERS}, {_ALIAS}, {_ASSIGN} SELECT count(*) FILTER (WHERE decision = 'skipped_locked') AS n_clusters, CAST(coalesce(sum(n_new) FILTER (WHERE decision = 'skipped_locked'), 0) AS BIGINT) AS n_surfaces FROM assigned")
def r9(s, d):
    skipped = F.col("decision") == "skipped_locked"
    return _assigned(s, d).agg(F.count_if(skipped).alias("n_clusters"), F.coalesce(F.sum(F.when(skipped, F.col("n_new"))), F.lit(0)).alias("n_surfaces"))


#: First and last names that make up people of the driver's tables.
_FIRST, _LAST = ("Ann", "Bea", "Cem", "Dov", "Eva"), ("Adler", "Berg", "Cole")


def _speakers(s, d):
    c = table(s, d, "conversations").select(F.col("conv_id").alias("interview_id"), "role").distinct()
    h = hashed_share(F.concat_ws("/", "interview_id", "role"))
    first = F.element_at(F.array(*map(F.lit, _FIRST)), (F.floor(h * 5) + 1).cast("int"))
    last = F.element_at(F.array(*map(F.lit, _LAST)), (F.pmod(F.col("interview_id"), F.lit(3)) + 1).cast("int"))
    name = F.when(h < 0.05, F.upper("role")).when(h < 0.08, "  ").when(h < 0.15, F.col("role")).when(h < 0.5, F.concat(first, F.lit(" "), last)).when(h < 0.7, F.upper(F.concat(first, F.lit("  "), last))).otherwise(first)
    return c.select((F.col("interview_id") % 4).alias("project"), "interview_id", F.concat_ws("/", "interview_id", "role").alias("speaker_id"), F.col("role").alias("handle"), name.alias("display_name"), (h > 0.95).alias("provisional"))


def _pool(s, d):
    p = _speakers(s, d).where("interview_id % 5 = 0 and not provisional").select("project", "interview_id", F.col("display_name").alias("name"))
    return op.participant_pool(p, "project")


def _list(names):
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


_SPEAKERS = rf"""sp0 AS (SELECT DISTINCT conv_id AS interview_id, role, {share_sql("conv_id || '/' || role")} AS h FROM conversations),
sp1 AS (SELECT *, {_list(_FIRST)}[CAST(floor(h * 5) AS INTEGER) + 1] AS f, {_list(_LAST)}[interview_id % 3 + 1] AS l FROM sp0),
speakers AS (SELECT interview_id % 4 AS project, interview_id, interview_id || '/' || role AS speaker_id, role AS handle, CASE WHEN h < 0.05 THEN upper(role) WHEN h < 0.08 THEN '  ' WHEN h < 0.15 THEN role WHEN h < 0.5 THEN f || ' ' || l WHEN h < 0.7 THEN upper(f || '  ' || l) ELSE f END AS display_name, h > 0.95 AS provisional FROM sp1),
nk AS (SELECT *, trim(regexp_replace(lower(display_name), '[ \t\r\n]+', ' ', 'g')) AS name_key FROM speakers WHERE NOT provisional),
pool AS (SELECT project, name_key, trim(display_name) AS spelling FROM nk WHERE interview_id % 5 = 0 QUALIFY row_number() OVER (PARTITION BY project, name_key ORDER BY interview_id, display_name) = 1),
nm AS (SELECT * REPLACE (trim(display_name) AS display_name) FROM nk WHERE trim(display_name) NOT IN ('', handle)), cnt AS (SELECT project, name_key, display_name, count(*) AS n FROM nm GROUP BY ALL),
cm AS (SELECT project, name_key, display_name AS common, CAST(sum(n) OVER (PARTITION BY project, name_key) AS BIGINT) AS n_links FROM cnt QUALIFY row_number() OVER (PARTITION BY project, name_key ORDER BY n DESC, display_name) = 1),
groups AS (SELECT project, name_key, coalesce(spelling, common) AS name, n_links, n_links >= 2 OR spelling IS NOT NULL AS auto, CASE WHEN spelling IS NOT NULL THEN 'front_matter' ELSE 'exact_name' END AS method FROM cm LEFT JOIN pool USING (project, name_key)),
sug AS (SELECT a.project, a.name_key, b.name_key AS person, 'first_name_match' AS method FROM groups a JOIN groups b ON a.project = b.project AND NOT a.auto AND b.auto AND split_part(a.name_key, ' ', 1) = split_part(b.name_key, ' ', 1) AND a.name_key <> b.name_key)"""


@query("r10_person_groups", f"WITH {_SPEAKERS} SELECT * FROM groups")
def r10(s, d):
    return op.person_groups(_speakers(s, d), _pool(s, d), "project").drop("speaker_ids")


@query("r11_participant_pool", f"WITH {_SPEAKERS} SELECT * FROM pool")
def r11(s, d):
    return _pool(s, d)


@query("r12_first_names", f"WITH {_SPEAKERS} SELECT * FROM sug")
def r12(s, d):
    return op.first_name_suggestions(op.person_groups(_speakers(s, d), _pool(s, d), "project"), "project")


_LINKS = f"""lk AS (SELECT groups.project, name_key AS person, speaker_id, {share_sql("speaker_id")} AS h FROM groups JOIN nm USING (project, name_key) WHERE auto),
links AS (SELECT person, speaker_id, CASE WHEN h < 0.1 THEN 'blocked' WHEN h < 0.25 THEN 'existing' ELSE 'linked' END AS outcome FROM lk)"""


def _linked(s, d):
    g = op.person_groups(_speakers(s, d), _pool(s, d), "project").where("auto")
    p = g.select(F.col("name_key").alias("person"), F.explode("speaker_ids").alias("speaker_id")).withColumn("h", hashed_share(F.col("speaker_id")))
    return op.new_links(p, p.where("h < 0.25"), p.where("h < 0.1")).drop("h")


@query("r13_links", f"WITH {_SPEAKERS}, {_LINKS} SELECT * FROM links")
def r13(s, d):
    return _linked(s, d)


@query("r14_review", f"WITH {_PAIRS}, k AS (SELECT vec_id, 'c' || (vec_id // 2) AS id, vec_id % 7 = 0 AS locked, vec_id % 11 = 0 AS merged FROM embeddings WHERE vec_id % 3 <> 0) SELECT coalesce(x.id, 'new:' || a) AS left_id, coalesce(y.id, 'new:' || b) AS right_id, a, b, band, round(score, 4) AS score FROM pairs LEFT JOIN k x ON x.vec_id = a LEFT JOIN k y ON y.vec_id = b WHERE (band = 'suggest' OR coalesce(NOT x.locked AND NOT y.locked AND NOT x.merged AND NOT y.merged, false)) AND coalesce(x.id, 'new:' || a) <> coalesce(y.id, 'new:' || b)")
def r14(s, d):
    k = table(s, d, "embeddings").where("vec_id % 3 != 0").select(F.col("vec_id").alias("surface"), F.concat(F.lit("c"), F.floor(F.col("vec_id") / 2)).alias("canonical_id"), (F.col("vec_id") % 7 == 0).alias("locked"), (F.col("vec_id") % 11 == 0).alias("merged"))
    return op.review_suggestions(_pairs(s, d), k)


@query("r15_person_suggestions", f"WITH {_SPEAKERS} SELECT project, name_key, person FROM sug WHERE {share_sql('name_key || person')} >= 0.3")
def r15(s, d):
    x = op.first_name_suggestions(op.person_groups(_speakers(s, d), _pool(s, d), "project"), "project")
    blocked = x.where(hashed_share(F.concat("name_key", "person")) < 0.3).select("project", "name_key", "person")
    return x.join(blocked, ["project", "name_key", "person"], "left_anti").select("project", "name_key", "person")


_V4 = """ce AS (SELECT user_id % 20 AS project_id, event_id AS version, event_id % 41 AS n, event_type, CASE event_type WHEN 'view' THEN CASE WHEN event_id % 5 = 0 THEN 'identified' ELSE 'canonicalized' END WHEN 'click' THEN 'alias_added' WHEN 'purchase' THEN CASE event_id % 2 WHEN 0 THEN 'merged' ELSE 'split' END WHEN 'error' THEN 'unlinked' ELSE 'linked' END AS kind,
'p' || (event_id % 3) AS person, 'k' || (event_id % 7) AS speaker_id, CASE WHEN event_id % 3 = 0 THEN 'human' ELSE 'rule' END AS method FROM events),
cf AS (SELECT *, 'c' || n AS cid, CASE WHEN kind = 'merged' THEN 'c' || (event_id_k % 43) WHEN kind = 'split' THEN 'c' || (41 + event_id_k % 60) END AS oid, 't' || (n % 2) AS entity_type,
CASE kind WHEN 'canonicalized' THEN ['s' || 3 * n, 's' || (3 * n + 1), 's' || (3 * n + 2)] WHEN 'alias_added' THEN ['s' || (event_id_k % 150)] WHEN 'split' THEN list_slice(['s' || 3 * n, 's' || (3 * n + 1), 's' || (3 * n + 2)], 1, 1 + event_id_k % 3) ELSE [] END AS surfaces FROM (SELECT *, version // 7 AS event_id_k FROM ce)),
eo AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY version) AS k FROM cf WHERE kind IN ('canonicalized', 'alias_added', 'merged', 'split')),
ef(project_id, k, version, kind, cid, refused, cs) AS (
SELECT DISTINCT project_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, []::STRUCT(id VARCHAR, typ VARCHAR, surfaces VARCHAR[], locked BOOLEAN, into_id VARCHAR)[] FROM eo
UNION ALL SELECT project_id, k, version, kind, cid, refused, CASE WHEN refused IS NOT NULL THEN cs
WHEN kind = 'canonicalized' THEN list_append(cs, {'id': cid, 'typ': entity_type, 'surfaces': surfaces, 'locked': method = 'human', 'into_id': NULL::VARCHAR})
WHEN kind = 'alias_added' THEN list_transform(cs, lambda c: CASE WHEN c.id = cid THEN {'id': c.id, 'typ': c.typ, 'surfaces': list_concat(c.surfaces, surfaces), 'locked': c.locked OR method = 'human', 'into_id': c.into_id} ELSE c END)
WHEN kind = 'merged' THEN list_transform(cs, lambda c: CASE WHEN c.id = cid THEN {'id': c.id, 'typ': c.typ, 'surfaces': list_concat(c.surfaces, list_filter(ot.surfaces, lambda s: NOT list_contains(c.surfaces, s))), 'locked': true, 'into_id': c.into_id} WHEN c.id = oid THEN {'id': c.id, 'typ': c.typ, 'surfaces': []::VARCHAR[], 'locked': true, 'into_id': cid} ELSE c END)
ELSE list_append(list_transform(cs, lambda c: CASE WHEN c.id = cid THEN {'id': c.id, 'typ': c.typ, 'surfaces': list_filter(c.surfaces, lambda s: NOT list_contains(surfaces, s)), 'locked': true, 'into_id': c.into_id} ELSE c END), {'id': oid, 'typ': me.typ, 'surfaces': surfaces, 'locked': true, 'into_id': NULL::VARCHAR}) END FROM (
SELECT *, CASE kind WHEN 'canonicalized' THEN CASE WHEN me IS NOT NULL THEN 'exists' WHEN owned THEN 'owned' END
WHEN 'alias_added' THEN CASE WHEN me IS NULL OR me.into_id IS NOT NULL THEN 'not_found' WHEN me.locked AND method <> 'human' THEN 'locked' WHEN owned THEN 'owned' END
WHEN 'merged' THEN CASE WHEN cid = oid THEN 'itself' WHEN me IS NULL THEN 'not_found' WHEN me.into_id IS NOT NULL THEN 'merged_away' WHEN ot IS NULL THEN 'not_found' WHEN ot.into_id IS NOT NULL THEN 'merged_away' END
ELSE CASE WHEN me IS NULL OR me.into_id IS NOT NULL THEN 'not_found' WHEN ot IS NOT NULL THEN 'exists' WHEN len(list_filter(surfaces, lambda s: NOT list_contains(me.surfaces, s))) > 0 THEN 'not_owned' WHEN len(surfaces) >= len(me.surfaces) THEN 'last_surface' END END AS refused FROM (
SELECT *, len(list_filter(cs, lambda c: c.into_id IS NULL AND c.typ = coalesce(CASE WHEN kind = 'alias_added' THEN me.typ END, entity_type) AND list_has_any(c.surfaces, surfaces))) > 0 AS owned FROM (
SELECT o.*, cs, list_filter(cs, lambda c: c.id = o.cid)[1] AS me, list_filter(cs, lambda c: c.id = o.oid)[1] AS ot FROM ef JOIN eo o ON o.project_id = ef.project_id AND o.k = ef.k + 1) a) b) x),
since AS (SELECT project_id, person, min(version) AS v FROM ce WHERE kind = 'identified' GROUP BY ALL),
lo AS (SELECT c.*, coalesce(s.v < c.version, false) AS known, row_number() OVER (PARTITION BY project_id, speaker_id ORDER BY version) AS k FROM ce c LEFT JOIN since s USING (project_id, person) WHERE kind IN ('linked', 'unlinked')),
lf(project_id, speaker_id, k, version, kind, refused, held, blocked) AS (SELECT project_id, speaker_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, false FROM lo WHERE k = 1
UNION ALL SELECT project_id, speaker_id, k, version, kind, refused, CASE WHEN refused IS NOT NULL THEN held WHEN kind = 'linked' THEN person END, CASE WHEN refused IS NOT NULL THEN blocked WHEN kind = 'unlinked' THEN true ELSE blocked AND method <> 'human' END FROM (
SELECT o.*, held, blocked, CASE WHEN o.kind = 'unlinked' THEN CASE WHEN held IS DISTINCT FROM o.person THEN 'not_linked' END WHEN NOT o.known THEN 'no_person' WHEN held IS NOT NULL THEN 'already_linked' WHEN blocked AND o.method <> 'human' THEN 'blocked' END AS refused
FROM lf JOIN lo o ON o.project_id = lf.project_id AND o.speaker_id = lf.speaker_id AND o.k = lf.k + 1) x)"""


def _corrections(s, d):
    e, k = table(s, d, "events"), F.col("event_id")
    t, n, m = F.col("event_type"), F.col("event_id") % 41, F.expr("event_id div 7")
    kind = F.when(t == "view", F.when(k % 5 == 0, "identified").otherwise("canonicalized")).when(t == "click", "alias_added").when(t == "purchase", F.when(k % 2 == 0, "merged").otherwise("split")).when(t == "error", "unlinked").otherwise("linked")
    name = lambda mark, x: F.concat(F.lit(mark), x)
    three = F.array(name("s", 3 * n), name("s", 3 * n + 1), name("s", 3 * n + 2))
    other = F.when(F.col("kind") == "merged", name("c", m % 43)).when(F.col("kind") == "split", name("c", 41 + m % 60))
    surfaces = F.when(F.col("kind") == "canonicalized", three).when(F.col("kind") == "alias_added", F.array(name("s", m % 150))).when(F.col("kind") == "split", F.slice(three, F.lit(1), (1 + m % 3).cast("int")))
    return e.withColumn("kind", kind).select((F.col("user_id") % 20).alias("project_id"), k.alias("version"), "kind", name("c", n).alias("canonical_id"), other.alias("other_id"), name("n", k).alias("name"), name("t", n % 2).alias("entity_type"), surfaces.alias("surfaces"), name("p", k % 3).alias("person"), name("k", k % 7).alias("speaker_id"), F.when(k % 3 == 0, "human").otherwise("rule").alias("method"))


@query("v4_project_state", f"WITH RECURSIVE {_V4} SELECT project_id, c.id AS canonical_id, c.typ AS entity_type, list_aggregate(list_sort(list_distinct(c.surfaces)), 'string_agg', ',') AS surfaces, c.locked AS locked, c.into_id AS merged_into FROM (SELECT project_id, unnest(cs) AS c FROM ef QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY k DESC) = 1)")
def v4(s, d):
    """The canonicals of each project after all corrections, with their surfaces, locks and redirects."""
    state = corrections.replay_entities(_corrections(s, d))[1]
    return state.select("project_id", "canonical_id", "entity_type", F.when(F.size("surfaces") > 0, F.array_join("surfaces", ",")).alias("surfaces"), "locked", "merged_into")


@query("v4_person_links", f"WITH RECURSIVE {_V4} SELECT project_id, speaker_id, held AS person, blocked FROM (SELECT *, bool_or(k > 0 AND refused IS NULL) OVER (PARTITION BY project_id, speaker_id) AS any_counts FROM lf) WHERE any_counts QUALIFY row_number() OVER (PARTITION BY project_id, speaker_id ORDER BY k DESC) = 1")
def v4_links(s, d):
    return corrections.fold_links(_corrections(s, d))


@query("r16_corrections", f"WITH RECURSIVE {_V4} SELECT project_id, version, kind, refused FROM ef WHERE k > 0 UNION ALL SELECT project_id, version, kind, refused FROM lf WHERE k > 0 UNION ALL SELECT project_id, version, kind, CASE WHEN version > since.v THEN 'exists' END FROM ce JOIN since USING (project_id, person) WHERE kind = 'identified'")
def r16(s, d):
    e = _corrections(s, d)
    cols = ("project_id", "version", "kind", "refused")
    return corrections.replay_entities(e)[0].select(*cols).unionByName(corrections.judge_links(e).select(*cols)).unionByName(corrections.judge_persons(e).select(*cols))


@query("r17_summary", f"WITH {_SPEAKERS}, {_LINKS} SELECT outcome, count(*) AS n, count(DISTINCT person) AS n_people FROM links GROUP BY 1")
def r17(s, d):
    return _linked(s, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("person").alias("n_people"))


# ------------------------------------------------------------------ edge tables

_EDGES = """edges AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT DISTINCT 'p' || p_partkey, 's' || (p_partkey % 11 + 1) FROM part),
nodes AS (SELECT 's' || s_suppkey AS node, CASE WHEN s_suppkey % 5 = 0 THEN 'hub' ELSE 'supplier' END AS type FROM supplier UNION ALL SELECT 'p' || p_partkey, 'part' FROM part WHERE p_partkey % 13 <> 0)"""


def _edges(s, d):
    li = table(s, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    p = table(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("src"), F.concat(F.lit("s"), F.col("p_partkey") % 11 + 1).alias("dst"))
    return li.unionByName(p).distinct()


def _nodes(s, d):
    a = table(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.when(F.col("s_suppkey") % 5 == 0, "hub").otherwise("supplier").alias("type"))
    b = table(s, d, "part").where("p_partkey % 13 != 0").select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.lit("part").alias("type"))
    return a.unionByName(b)


def _start(s, d):
    return _nodes(s, d).where("type = 'hub'").select(F.col("node").alias("entry"), "node")


@query("g1_neighbourhood", f"WITH RECURSIVE {_EDGES}, w(entry, node, depth) AS (SELECT node, node, 0 FROM nodes WHERE type = 'hub' UNION SELECT entry, dst, depth + 1 FROM w JOIN edges ON src = w.node WHERE depth < 3) SELECT entry, node, min(depth) AS depth FROM w GROUP BY ALL")
def g1(s, d):
    return g_op.reach(_edges(s, d), _start(s, d), 3)


@query("g1_induced_edges", f"WITH RECURSIVE {_EDGES}, w(entry, node, depth) AS (SELECT node, node, 0 FROM nodes WHERE type = 'hub' UNION SELECT entry, dst, depth + 1 FROM w JOIN edges ON src = w.node WHERE depth < 2), r AS (SELECT DISTINCT entry, node FROM w) SELECT a.entry, src, dst FROM edges JOIN r a ON a.node = src JOIN r b ON b.entry = a.entry AND b.node = dst")
def g1_induced(s, d):
    e = materialise(_edges(s, d))
    return g_op.induced(e, materialise(g_op.reach(e, _start(s, d), 2, ready=True))).select("entry", "src", "dst")


@query("g2_dangling", f"WITH {_EDGES} SELECT dst AS missing, 'dst' AS side, count(*) AS n_edges FROM edges WHERE dst NOT IN (SELECT node FROM nodes) GROUP BY 1 UNION ALL SELECT src, 'src', count(*) FROM edges WHERE src NOT IN (SELECT node FROM nodes) GROUP BY 1")
def g2(s, d):
    return g_op.dangling(_edges(s, d), _nodes(s, d))


@query(
    "g3_minimal_context",
    f"""WITH RECURSIVE {_EDGES}, w(entry, node, depth) AS (SELECT node, node, 0 FROM nodes WHERE type = 'hub' UNION SELECT entry, src, depth + 1 FROM w JOIN edges ON dst = w.node WHERE depth < 3),
u AS (SELECT entry, node, min(depth) AS depth FROM w GROUP BY ALL), h AS (SELECT entry, min(depth) AS enough FROM u JOIN nodes USING (node) WHERE depth > 0 AND type = 'supplier' GROUP BY 1)
SELECT entry, node FROM u JOIN h USING (entry) WHERE depth <= enough UNION SELECT n.node, dst FROM nodes n JOIN edges ON src = n.node WHERE type = 'hub'""",
)
def g3(s, d):
    return g_op.minimal_context(_edges(s, d), _start(s, d), _nodes(s, d), "supplier", 3)


@query("g4_coverage", "WITH o AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'full' WHEN 'O' THEN 'none' ELSE 'partial' END AS state FROM orders), c AS (SELECT o_custkey, CASE WHEN bool_and(state = 'full') THEN 'full' WHEN bool_and(state = 'none') THEN 'none' ELSE 'partial' END AS coverage FROM o GROUP BY 1) SELECT c_nationkey, CASE WHEN bool_and(coverage = 'full') THEN 'full' WHEN bool_and(coverage = 'none') THEN 'none' ELSE 'partial' END AS coverage, count(*) AS n_children FROM c JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def g4(s, d):
    state = F.when(F.col("o_orderstatus") == "F", "full").when(F.col("o_orderstatus") == "O", "none").otherwise("partial")
    c = g_op.coverage(table(s, d, "orders").withColumn("state", state), "o_custkey", "state")
    c = c.join(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return g_op.coverage(c.drop("n_children"), "c_nationkey", "coverage")


_TREE = "tree AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 1 THEN p_partkey // 3 END AS parent, CASE WHEN p_partkey % 10 = 0 OR p_partkey = 1 THEN p_brand END AS value FROM part)"


@query("g5_inherited", f"WITH RECURSIVE {_TREE}, w(node, up_to, value, depth) AS (SELECT node, parent, value, 0 FROM tree UNION ALL SELECT w.node, t.parent, t.value, depth + 1 FROM w JOIN tree t ON t.node = w.up_to WHERE w.value IS NULL) SELECT tree.node, x.value FROM tree LEFT JOIN (SELECT node, value FROM w WHERE value IS NOT NULL) x USING (node)")
def g5(s, d):
    k = F.col("p_partkey")
    t = table(s, d, "part").select(k.alias("node"), F.when(k > 1, F.floor(k / 3)).alias("parent"), F.when((k % 10 == 0) | (k == 1), F.col("p_brand")).alias("value"))
    return g_op.inherited(t)


@query("g6_unreachable", f"WITH RECURSIVE {_EDGES}, w(node) AS (SELECT node FROM nodes WHERE type = 'hub' UNION SELECT dst FROM w JOIN edges ON src = w.node) SELECT node, type FROM nodes WHERE node NOT IN (SELECT node FROM w)")
def g6(s, d):
    return g_op.unreachable(_edges(s, d), _nodes(s, d), ["hub"])
