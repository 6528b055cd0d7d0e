"""Ingestion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance import bind
from parlance.bind import FRAGMENTS, TRANSCRIPTS, UTTERANCES, table
from parlance.functions.ids import uuid5
from parlance.functions import sql as sql_functions
from parlance.operators import ingest as op
from parlance.operators import modelpass

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("q1_transcript", f"WITH {UTTERANCES} SELECT interview_id, seq, turn, role AS speaker, utterance_no, text, start_char, end_char FROM members")
def q1_transcript(s, d):
    f = bind.fragments(s, d)
    u = op.baseline_utterances(f, "interview_id", "role")
    spans = u.select("interview_id", "utterance_no", F.explode(F.sequence("first_seq", "last_seq")).alias("seq"))
    return f.join(spans, ["interview_id", "seq"]).select("interview_id", "seq", "turn", F.col("role").alias("speaker"), "utterance_no", "text", "start_char", "end_char")


@query("n1_content_hash", "SELECT doc_id, sha256(text) AS content_sha256, count(*) OVER (PARTITION BY sha256(text)) AS n_copies FROM documents")
def n1(s, d):
    return op.content_hashes(table(s, d, "documents"), "doc_id", "text")


_LABEL = r"^(\p{Lu}[\p{L}\p{N}_ .''-]{0,40}): (.*)$"
_LINES = rf"""lines AS (SELECT interview_id, unnest(string_split_regex(text, '\r\n|\r|\n')) AS line, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) - 1 AS line_no FROM t),
labeled AS (SELECT *, nullif(regexp_extract(line, '{_LABEL}', 1), '') AS own FROM lines WHERE trim(line, E' \t\r\n') <> '')"""
_BOTH = TRANSCRIPTS + ", t AS (SELECT interview_id, text FROM transcripts UNION ALL SELECT -1 - doc_id, text FROM documents)"


def _both(s, d):
    return bind.transcripts(s, d).unionByName(table(s, d, "documents").select((-1 - F.col("doc_id")).alias("interview_id"), "text"))


@query(
    "n2_format",
    f"""WITH {_BOTH}, {_LINES}, p AS (SELECT interview_id, count(*) AS n_lines, count(own) AS n_labeled, count(DISTINCT own) AS n_labels FROM labeled GROUP BY 1)
SELECT interview_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_labeled, 0) AS n_labeled, coalesce(n_labels, 0) AS n_labels,
CASE WHEN n_lines > 0 AND n_labeled >= 0.3 * n_lines AND n_labels >= 2 THEN 'LABELED' ELSE 'FLAT' END AS format FROM t LEFT JOIN p USING (interview_id)""",
)
def n2(s, d):
    return op.detect_format(_both(s, d), "interview_id", "text")


@query(
    "n3_labeled_lines",
    f"""WITH {TRANSCRIPTS}, t AS (SELECT * FROM transcripts), {_LINES}
SELECT interview_id, CAST(line_no AS INTEGER) AS line_no, last_value(own IGNORE NULLS) OVER (PARTITION BY interview_id ORDER BY line_no) AS label,
CASE WHEN own IS NULL THEN line ELSE regexp_extract(line, '{_LABEL}', 2) END AS speech FROM labeled""",
)
def n3(s, d):
    return op.parse_labeled(bind.transcripts(s, d), "interview_id", "text")


@query("n4_segments", f"WITH {FRAGMENTS} SELECT interview_id, turn, role, CAST(piece AS INTEGER) AS piece, text, start_char, end_char FROM fragments")
def n4(s, d):
    c = table(s, d, "conversations").withColumnRenamed("conv_id", "interview_id")
    return op.segment(c, ["interview_id", "turn", "role"], "text")


@query("n4_segment_text", f"WITH {FRAGMENTS} SELECT interview_id, turn, CAST(piece AS INTEGER) AS piece, text, start_char, end_char FROM fragments")
def n4_sql(s, d):
    """The same segments through the session's SQL function."""
    sql_functions.register(s)
    return s.sql("SELECT conv_id AS interview_id, turn, p.* FROM {c}, LATERAL segment_text({c}.text) AS p", c=table(s, d, "conversations"))


@query(
    "n5_grounding",
    f"WITH {FRAGMENTS} SELECT count(*) AS n_fragments, count(*) FILTER (WHERE substr(source_text, start_char + 1, end_char - start_char) IS DISTINCT FROM text) AS n_violations FROM fragments",
)
def n5(s, d):
    f = bind.fragments(s, d)
    src = table(s, d, "conversations").select(F.col("conv_id").alias("interview_id"), "turn", "role", F.col("text").alias("source"))
    bad = op.grounding_violations(f, src, ["interview_id", "turn", "role"], "source")
    both = f.select(F.lit(1).alias("f"), F.lit(0).alias("v")).unionByName(bad.select(F.lit(0).alias("f"), F.lit(1).alias("v")))
    return both.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("n_fragments"), F.coalesce(F.sum("v"), F.lit(0)).alias("n_violations"))


@query("n6_sequence", f"WITH {FRAGMENTS} SELECT interview_id, min(seq) AS lo, max(seq) AS hi, count(DISTINCT seq) AS n FROM fragments GROUP BY 1")
def n6(s, d):
    return bind.fragments(s, d).groupBy("interview_id").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count_distinct("seq").alias("n"))


@query(
    "n7_front_matter",
    f"""WITH {TRANSCRIPTS} SELECT interview_id, interview_id % 5 <> 4 AS has_front_matter, interview_id % 5 = 4 AS quarantined,
CASE WHEN interview_id % 5 <> 4 THEN 'Interview ' || interview_id END AS title,
CASE WHEN interview_id % 5 NOT IN (3, 4) THEN DATE '2024-01-01' + CAST(interview_id % 300 AS INTEGER) END AS held_on,
CASE WHEN interview_id % 5 <> 4 THEN ['User', 'Assistant'] END AS participants,
CASE WHEN interview_id % 5 <> 4 THEN length('---' || chr(10) || 'title: Interview ' || interview_id || chr(10) || 'date: ' || CASE WHEN interview_id % 5 = 3 THEN 'soon' ELSE strftime(DATE '2024-01-01' + CAST(interview_id % 300 AS INTEGER), '%Y-%m-%d') END || chr(10) || 'participants: [User, Assistant]' || chr(10) || '---' || chr(10)) ELSE 0 END AS body_offset FROM transcripts""",
)
def n7(s, d):
    i = F.col("interview_id")
    when = F.when(i % 5 == 3, "soon").otherwise(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 300).cast("int")), "yyyy-MM-dd"))
    people = F.when(i % 5 == 4, "people: {User: 1}").otherwise("participants: [User, Assistant]")
    head = F.concat(F.lit("---\ntitle: Interview "), i, F.lit("\ndate: "), when, F.lit("\n"), people, F.lit("\n---\n"))
    return op.front_matter(bind.transcripts(s, d).select("interview_id", F.concat(head, "text").alias("text")), "interview_id", "text")


@query(
    "n8_roster",
    f"""WITH {FRAGMENTS}, f AS (SELECT *, CASE WHEN confidence < 0.1 THEN 'S?' ELSE role END AS handle FROM fragments)
SELECT interview_id, CAST(row_number() OVER (PARTITION BY interview_id ORDER BY min(seq), handle) AS INTEGER) AS ordinal, handle, min(seq) AS first_seq, count(*) AS n_fragments, round(avg(confidence), 6) AS confidence,
CASE WHEN handle = 'S?' THEN 'unknown' ELSE 'label' END AS method, handle = 'S?' OR round(avg(confidence), 6) < 0.5 AS provisional FROM f GROUP BY interview_id, handle""",
)
def n8(s, d):
    f = bind.fragments(s, d).withColumn("said", F.when(F.col("confidence") >= 0.1, F.col("role")))
    return op.roster(f, "interview_id", "said", "confidence", threshold=0.5).drop("speaker_id")


@query(
    "n9_uuid5",
    rf"""WITH {FRAGMENTS}, h AS (SELECT interview_id, seq, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('fragment:' || fragment_id)) AS h FROM fragments)
SELECT interview_id, seq, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1))::BIGINT % 4 + 1 AS INTEGER), 1) || substr(h, 18, 1) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS fragment_uuid FROM h""",
)
def n9(s, d):
    return bind.fragments(s, d).select("interview_id", "seq", uuid5(F.concat_ws(":", F.lit("fragment"), "fragment_id")).alias("fragment_uuid"))


@query(
    "n10_participants",
    """WITH h AS (SELECT DISTINCT conv_id % 7 AS scope, role || CASE WHEN turn % 3 = 0 THEN '' ELSE ' ' || (turn % 2) END AS handle FROM conversations),
p AS (SELECT DISTINCT conv_id % 7 AS scope, upper(role) || ' ' || (turn % 2) AS name FROM conversations),
e AS (SELECT scope, lower(trim(name)) AS k, count(*) AS n, min(name) AS name FROM p GROUP BY 1, 2),
f AS (SELECT scope, string_split(lower(trim(name)), ' ')[1] AS k, count(*) AS n, min(name) AS name FROM p GROUP BY 1, 2)
SELECT h.scope, handle, coalesce(e.name, f.name) AS participant FROM h LEFT JOIN e ON e.scope = h.scope AND e.k = lower(trim(handle)) AND e.n = 1 LEFT JOIN f ON f.scope = h.scope AND f.k = lower(trim(handle)) AND f.n = 1""",
)
def n10(s, d):
    c = table(s, d, "conversations").withColumn("scope", F.col("conv_id") % 7)
    h = c.select("scope", F.concat("role", F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.col("turn") % 2))).alias("handle")).distinct()
    people = c.select("scope", F.concat(F.upper("role"), F.lit(" "), F.col("turn") % 2).alias("name")).distinct()
    return op.match_participants(h, people, "scope")


_WINDOWS = """n AS (SELECT interview_id, max(seq) + 1 AS n FROM fragments GROUP BY 1),
windows AS (SELECT interview_id, n, CAST(unnest(range(0, CAST(greatest(0, ceil((n - 40) / 30.0)) AS BIGINT) + 1)) AS INTEGER) AS window_no FROM n)"""


@query("n12_windows", f'WITH {FRAGMENTS}, {_WINDOWS} SELECT interview_id, window_no AS "window", window_no * 30 AS first_seq, CAST(least(window_no * 30 + 40, n) AS INTEGER) AS end_seq FROM windows')
def n12(s, d):
    return op.inference_windows(bind.fragments(s, d), "interview_id")


@query(
    "n13_reconcile",
    f"""WITH RECURSIVE {FRAGMENTS}, rl AS (SELECT interview_id, list(role ORDER BY seq) AS roles, count(*) AS n FROM fragments GROUP BY 1),
ch(interview_id, w, names) AS (SELECT interview_id, 0, roles[1:8] FROM rl UNION ALL
SELECT interview_id, w + 1, names || list_transform(roles[2 * w + 9:2 * w + 10], lambda r: coalesce(list_sort(list_transform(list_filter(range(2 * w + 3, 2 * w + 9), lambda i: roles[i] = r), lambda i: {{'c': -len(list_filter(range(2 * w + 3, 2 * w + 9), lambda j: roles[j] = r AND names[j] = names[i])), 'p': i, 'n': names[i]}}))[1].n, r || '-' || (w + 1)))
FROM ch JOIN rl USING (interview_id) WHERE n > 2 * w + 8),
fin AS (SELECT interview_id, names FROM ch QUALIFY row_number() OVER (PARTITION BY interview_id ORDER BY w DESC) = 1)
SELECT interview_id, CAST(generate_subscripts(names, 1) - 1 AS INTEGER) AS seq, unnest(names) AS speaker FROM fin""",
)
def n13(s, d):
    """Windows that relabel their speakers locally (later ones by a suffix) settle on the first window's names."""
    f = bind.fragments(s, d)
    w = op.inference_windows(f, "interview_id", size=8, overlap=6)
    said = f.join(w, "interview_id").where("seq >= first_seq and seq < end_seq").select("interview_id", "window", "seq", F.concat("role", F.when(F.col("window") == 0, "").otherwise(F.concat(F.lit("-"), "window"))).alias("speaker"))
    return op.reconcile_windows(said, "interview_id")


@query("n14_fill", f"WITH {FRAGMENTS} SELECT interview_id, seq, CASE WHEN confidence < 0.2 THEN 'S?' ELSE role END AS speaker, CASE WHEN confidence < 0.2 THEN 0.0 ELSE confidence END AS confidence FROM fragments")
def n14(s, d):
    f = bind.fragments(s, d)
    said = f.where("confidence >= 0.2").select("interview_id", "seq", F.col("role").alias("speaker"), "confidence")
    return op.fill_assignments(f, said, "interview_id")


@query("n15_utterances", f"WITH {UTTERANCES} SELECT interview_id, utterance_no, speaker, first_seq, last_seq, n_fragments FROM utterances")
def n15(s, d):
    return op.baseline_utterances(bind.fragments(s, d), "interview_id", "role")


_PROPOSALS = """sq AS (SELECT interview_id, role, seq, row_number() OVER (PARTITION BY interview_id, role ORDER BY seq) AS k FROM fragments),
p0 AS (SELECT interview_id, role, k // 3 AS part, list(seq ORDER BY seq) AS members FROM sq GROUP BY ALL),
proposals AS (SELECT interview_id, CAST(row_number() OVER (PARTITION BY interview_id ORDER BY members[1], role) - 1 AS INTEGER) AS ordinal, CASE WHEN part % 4 = 3 THEN 'nobody' ELSE role END AS speaker, members FROM p0),
kept AS (SELECT * FROM proposals WHERE speaker <> 'nobody'),
covered AS (SELECT interview_id, unnest(members) AS seq FROM kept),
runs AS (SELECT interview_id, utterance_no, role, seq FROM members WHERE (interview_id, seq) NOT IN (SELECT interview_id, seq FROM covered)),
finals AS (SELECT interview_id, speaker, members, ordinal AS proposal FROM kept UNION ALL SELECT interview_id, min(role), list(seq ORDER BY seq), NULL FROM runs GROUP BY interview_id, utterance_no),
stitched AS (SELECT *, CAST(row_number() OVER (PARTITION BY interview_id ORDER BY members[1]) - 1 AS INTEGER) AS utterance_no FROM finals)"""


def _proposals(f):
    from pyspark.sql.window import Window

    k = F.row_number().over(Window.partitionBy("interview_id", "role").orderBy("seq"))
    p = f.select("interview_id", "role", "seq", k.alias("k")).groupBy("interview_id", "role", F.floor(F.col("k") / 3).alias("part")).agg(F.array_sort(F.collect_list("seq")).alias("members"))
    ordinal = F.row_number().over(Window.partitionBy("interview_id").orderBy(F.element_at("members", 1), "role")) - 1
    return p.select("interview_id", ordinal.alias("ordinal"), F.when(F.col("part") % 4 == 3, "nobody").otherwise(F.col("role")).alias("speaker"), "members")


@query("n16_stitch", f"WITH {UTTERANCES}, {_PROPOSALS} SELECT interview_id, speaker, members, proposal, utterance_no FROM stitched")
def n16(s, d):
    f = bind.fragments(s, d)
    return op.merge_proposals(f, _proposals(f), "interview_id", "role")


@query(
    "n17_interruptions",
    f"""WITH {UTTERANCES}, {_PROPOSALS}, x AS (SELECT interview_id, ordinal + 1 AS interrupting, ordinal AS interrupted, members[1] + 1 AS at_index FROM proposals)
SELECT x.interview_id, a.utterance_no AS by_utterance, b.utterance_no AS utterance, x.at_index FROM x JOIN stitched a ON a.interview_id = x.interview_id AND a.proposal = interrupting
JOIN stitched b ON b.interview_id = x.interview_id AND b.proposal = interrupted WHERE at_index BETWEEN b.members[1] AND b.members[-1]""",
)
def n17(s, d):
    f = bind.fragments(s, d)
    p = _proposals(f)
    x = p.select("interview_id", (F.col("ordinal") + 1).alias("interrupting"), F.col("ordinal").alias("interrupted"), (F.element_at("members", 1) + 1).alias("at_index"))
    return op.remap_interruptions(x, op.merge_proposals(f, p, "interview_id", "role"), "interview_id")


@query(
    "n18_summary",
    f"WITH {UTTERANCES} SELECT f.interview_id, count(*) AS n_fragments, count(DISTINCT role) AS n_speakers, count(*) FILTER (WHERE confidence < 0.7) AS n_low_confidence, any_value(u.n) AS n_utterances FROM fragments f JOIN (SELECT interview_id, count(*) AS n FROM utterances GROUP BY 1) u USING (interview_id) GROUP BY 1",
)
def n18(s, d):
    f = bind.fragments(s, d)
    return op.ingestion_summary(f, op.baseline_utterances(f, "interview_id", "role"), "interview_id", "role")


#: Fragments of a stitch window and of a speaker window, and the latter's overlap, small enough for several in an interview.
_STITCH, _SPEAK, _OVER = 16, 8, 2


def _stitch_model(prompts):
    """A stand-in for a model: three fragments of one speaker at a time; it fails on every third window and answers nonsense on another."""
    import json
    import re

    out = []
    for prompt in prompts:
        lines = [(int(seq), who) for seq, who in re.findall(r"^(\d+): \[(.*?)\] ", prompt, re.M)]
        window = lines[0][0] // _STITCH
        if window % 3 == 1:
            raise TimeoutError("no answer")
        of: dict[str, list[int]] = {}
        for seq, who in lines:
            of.setdefault(who, []).append(seq)
        # the k-th fragment of a speaker, counted from 1, goes to part k // 3
        parts = [(seqs[max(0, 3 * p - 1) : 3 * p + 2], who if p % 4 != 3 else "nobody") for who, seqs in of.items() for p in range(len(seqs) // 3 + 1) if seqs[max(0, 3 * p - 1) : 3 * p + 2]]
        parts.sort(key=lambda x: (x[0][0], x[1]))
        said = json.dumps({"utterances": [{"speaker": who, "fragment_indices": seqs, "confidence": 0.5} for seqs, who in parts], "interruptions": []})
        out.append(said[:-2] if window % 3 == 2 else said)
    return out


_WINDOWED = _PROPOSALS.replace("PARTITION BY interview_id, role ORDER BY seq) AS k FROM fragments", f"PARTITION BY interview_id, role, seq // {_STITCH} ORDER BY seq) AS k, seq // {_STITCH} AS w FROM fragments WHERE (seq // {_STITCH}) % 3 = 0").replace("SELECT interview_id, role, k // 3 AS part", "SELECT interview_id, role, w, k // 3 AS part")


@query("n19_model_or_baseline", f"WITH {UTTERANCES}, {_WINDOWED} SELECT interview_id, speaker, members, utterance_no FROM stitched")
def n19(s, d):
    """Stitched by a model that fails on some windows and answers nonsense on others: these keep their baseline runs."""
    return modelpass.stitch_utterances(bind.fragments(s, d), "interview_id", "role", _stitch_model, _STITCH)[0].drop("proposal")


def _speaker_model(prompts):
    """A stand-in for a model that goes by the parity of a text's length; the first text of a window decides whether it fails."""
    import json
    import re

    out = []
    for prompt in prompts:
        texts = re.split(r"^\d+: ", prompt, flags=re.M)[1:]
        texts = [t[:-1] if k < len(texts) - 1 else t for k, t in enumerate(texts)]
        if len(texts[0]) % 5 == 0:
            raise ConnectionError("away")
        said = json.dumps({"assignments": [{"index": i, "speaker": "AB"[len(t) % 2], "confidence": 0.75} for i, t in enumerate(texts)] + [{"index": 99, "speaker": "C", "confidence": 0.5}]})
        out.append(said.replace("0.75", "7.5") if len(texts[0]) % 5 == 1 else said)
    return out


_ASKED = f"""wn AS (SELECT interview_id, max(seq) + 1 AS n FROM fragments GROUP BY 1), ww AS (SELECT interview_id, CAST(unnest(range(0, CAST(greatest(0, ceil((n - {_SPEAK}) / {_SPEAK - _OVER}.0)) AS BIGINT) + 1)) AS INTEGER) AS w FROM wn),
wo AS (SELECT ww.interview_id, w, length(f.text) % 5 AS five FROM ww JOIN fragments f ON f.interview_id = ww.interview_id AND f.seq = w * {_SPEAK - _OVER})"""


@query(
    "n19_speaker_pass",
    f"""WITH {FRAGMENTS}, {_ASKED} SELECT f.interview_id, f.seq, CASE WHEN bool_or(five > 1) THEN CASE WHEN any_value(length(f.text)) % 2 = 0 THEN 'A' ELSE 'B' END ELSE 'S?' END AS speaker, CASE WHEN bool_or(five > 1) THEN 0.75 ELSE 0.0 END AS confidence
FROM fragments f JOIN wo ON wo.interview_id = f.interview_id AND f.seq >= w * {_SPEAK - _OVER} AND f.seq < w * {_SPEAK - _OVER} + {_SPEAK} GROUP BY f.interview_id, f.seq""",
)
def n19_speakers(s, d):
    """Speakers by window; what only failed windows cover is unknown."""
    return modelpass.infer_speakers(bind.fragments(s, d), "interview_id", _speaker_model, _SPEAK, _OVER)[0]


@query("n19_window_outcomes", f"WITH {FRAGMENTS}, {_ASKED} SELECT interview_id, w AS \"window\", CASE WHEN five > 1 THEN 'ok' ELSE 'failed' END AS status, CASE five WHEN 0 THEN 'unanswered' WHEN 1 THEN 'bad_assignment' END AS flag FROM wo")
def n19_outcomes(s, d):
    return modelpass.infer_speakers(bind.fragments(s, d), "interview_id", _speaker_model, _SPEAK, _OVER)[1].drop("error")
