"""Normalise, attribute and stitch transcripts: DataFrame in, DataFrame out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.functions.ids import uuid5
from parlance.functions.text import LABEL, SENTENCE, collapse, strip


def content_hashes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """SHA-256 of each source and how many sources share it."""
    d = docs.select(key, F.sha2(F.col(text), 256).alias("content_sha256"))
    n = d.groupBy("content_sha256").agg(F.count(F.lit(1)).alias("n_copies"))
    return d.join(n, "content_sha256").select(key, "content_sha256", "n_copies")


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line: key, line number from 0, line, offset of its start."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\r\n|\r|\n")).alias("line_no", "line"))
    return lines


def detect_format(docs: DataFrame, key: str, text: str, share: float = 0.3, labels: int = 2) -> DataFrame:
    """LABELED when enough non-blank lines carry a label and enough labels differ, else FLAT."""
    lines = lines_of(docs, key, text).where(strip(F.col("line")) != "")
    label = F.regexp_extract("line", LABEL, 1)
    per = lines.groupBy(key).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(label != "").alias("n_labeled"), F.count_distinct(F.when(label != "", label)).alias("n_labels"))
    rows = docs.select(key).join(per, key, "left").fillna(0, ["n_lines", "n_labeled", "n_labels"])
    is_labeled = (F.col("n_lines") > 0) & (F.col("n_labeled") >= share * F.col("n_lines")) & (F.col("n_labels") >= labels)
    return rows.select(key, "n_lines", "n_labeled", "n_labels", F.when(is_labeled, "LABELED").otherwise("FLAT").alias("format"))


def parse_labeled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines with the label they are spoken under; continuation lines inherit the last label."""
    label, rest = F.regexp_extract("line", LABEL, 1), F.regexp_extract("line", LABEL, 2)
    d = lines_of(docs, key, text).where(strip(F.col("line")) != "")
    d = d.withColumn("own", F.when(label != "", label)).withColumn("speech", F.when(label != "", rest).otherwise(F.col("line")))
    return d.select(key, "line_no", F.last("own", ignorenulls=True).over(Window.partitionBy(key).orderBy("line_no")).alias("label"), "speech")


def segment(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Sentence pieces with exact offsets into the source, ends stripped, empty ones dropped."""
    d = docs.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(SENTENCE), F.lit(0))).alias("piece", "raw"))
    before = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("base", F.coalesce(F.sum(F.length("raw")).over(before), F.lit(0)))
    d = d.withColumn("fragment", strip(F.col("raw"))).where("fragment != ''")
    start = (F.col("base") + F.length("raw") - F.length(F.ltrim(F.col("raw"), F.lit(" \t\r\n")))).cast("int")
    return d.select(*keys, "piece", F.col("fragment").alias("text"), start.alias("start_char"), (start + F.length("fragment")).alias("end_char"))


def number_fragments(fragments: DataFrame, key: str, *order: str) -> DataFrame:
    """Contiguous sequence_order from 0 inside each interview."""
    return fragments.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def grounding_violations(fragments: DataFrame, sources: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Fragments whose text is not what the source holds at their offsets."""
    f = fragments.join(sources.select(*keys, F.col(source).alias("source_text")), keys)
    held = F.substr(F.col("source_text"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    return f.where(~held.eqNullSafe(F.col("text"))).drop("source_text")


FRONT = r"\A---\r?\n((?s:.*?))\r?\n---\r?\n"


def front_matter(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Leading ``---`` block of flat ``name: value`` lines: title, date, participants, body offset; anything else is quarantined."""
    block = F.regexp_extract(text, FRONT, 1)
    whole = F.regexp_extract(text, FRONT, 0)
    lines = F.filter(F.split(block, "\r?\n"), lambda x: F.trim(x) != "")
    flat = F.forall(lines, lambda x: x.rlike(r"^[A-Za-z_]+: *[^{}]*$"))
    entry = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, "^([A-Za-z_]+):", 1)).alias("k"), F.trim(F.regexp_extract(x, "^[A-Za-z_]+:(.*)$", 1)).alias("v")))
    d = docs.select(key, F.col(text).alias("_t"), block.alias("block"), whole.alias("whole"), flat.alias("flat"), entry.alias("entries"))
    has = (F.col("whole") != "") & F.col("flat")

    def value(name):
        return F.try_element_at(F.filter("entries", lambda e: has & (e["k"] == name)), F.lit(1))["v"]

    people = F.filter(F.transform(F.split(F.regexp_replace(value("participants"), r"[\[\]]", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    return d.select(
        key,
        F.coalesce(has, F.lit(False)).alias("has_front_matter"),
        ((F.col("whole") != "") & ~F.col("flat")).alias("quarantined"),
        value("title").alias("title"),
        F.try_to_timestamp(value("date"), F.lit("yyyy-MM-dd")).cast("date").alias("held_on"),
        people.alias("participants"),
        F.when(has, F.length("whole")).otherwise(0).alias("body_offset"),
    )


def roster(fragments: DataFrame, key: str, handle: str, confidence: str, threshold: float = 0.7) -> DataFrame:
    """Speakers of each interview in order of first appearance; fragments without a label make ``S?``."""
    f = fragments.withColumn("handle", F.coalesce(handle, F.lit("S?")))
    per = f.groupBy(key, "handle").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n_fragments"), F.round(F.avg(confidence), 6).alias("confidence"))
    order = F.row_number().over(Window.partitionBy(key).orderBy("first_seq", "handle"))
    method = F.when(F.col("handle") == "S?", "unknown").otherwise("label")
    return per.select(key, order.alias("ordinal"), "handle", "first_seq", "n_fragments", "confidence", method.alias("method"), ((F.col("handle") == "S?") | (F.col("confidence") < threshold)).alias("provisional"), uuid5(F.concat_ws(":", F.col(key).cast("string"), F.lit("speaker"), "handle")).alias("speaker_id"))


def match_participants(handles: DataFrame, people: DataFrame, scope: str) -> DataFrame:
    """Full name of a handle: the exact participant if unique, else the only one with that first name, else null."""
    p = people.select(scope, F.col("name"), F.lower(F.trim("name")).alias("full")).withColumn("first", F.split("full", " ")[0])
    exact = p.groupBy(scope, F.col("full").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("exact_name")).where("n = 1").drop("n")
    first = p.groupBy(scope, F.col("first").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name")).where("n = 1").drop("n")
    h = handles.withColumn("k", F.lower(F.trim("handle")))
    return h.join(exact, [scope, "k"], "left").join(first, [scope, "k"], "left").select(scope, "handle", F.coalesce("exact_name", "first_name").alias("participant"))


def inference_windows(fragments: DataFrame, key: str, size: int = 40, overlap: int = 10) -> DataFrame:
    """Windows of ``size`` fragments that overlap, the last one reaching the end."""
    step = size - overlap
    n = fragments.groupBy(key).agg((F.max("seq") + 1).alias("n"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / F.lit(float(step))).cast("int"))
    return n.select(key, F.col("n"), F.explode(F.sequence(F.lit(0), last)).alias("window")).select(key, "window", (F.col("window") * step).alias("first_seq"), F.least(F.col("window") * step + size, F.col("n")).alias("end_seq"))


def reconcile_windows(said: DataFrame, key: str) -> DataFrame:
    """Global speaker of every fragment from window-local ones.

    said: key, window, seq, speaker, ordinal within the window.  Windows are chained: a
    window's local names map to global ones by majority on the overlap with what is already
    settled (ties by first appearance), unmatched names stay, the earlier window wins.
    One interview at a time, interviews in parallel; an interview is one transcript.
    """
    schema = f"{key} {said.schema[key].dataType.simpleString()}, seq int, speaker string"

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        settled: dict[int, str] = {}
        for _, w in rows.sort_values(["window", "seq"]).groupby("window", sort=True):
            votes: dict[str, dict[str, int]] = {}
            for s, name in zip(w["seq"], w["speaker"], strict=True):
                if s in settled:
                    votes.setdefault(name, {})
                    votes[name][settled[s]] = votes[name].get(settled[s], 0) + 1
            as_global = {name: max(v, key=v.get) for name, v in votes.items()}
            for s, name in zip(w["seq"], w["speaker"], strict=True):
                settled.setdefault(s, as_global.get(name, name))
        return pd.DataFrame({key: rows[key].iloc[0], "seq": list(settled), "speaker": list(settled.values())})

    return said.groupBy(key).applyInPandas(chain, schema)


def fill_assignments(fragments: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """Exactly one assignment per fragment; missing ones are ``S?`` with confidence 0."""
    a = assigned.withColumn("_k", F.row_number().over(Window.partitionBy(key, "seq").orderBy(F.desc("confidence"), "speaker"))).where("_k = 1").drop("_k")
    return fragments.select(key, "seq").join(a.select(key, "seq", "speaker", "confidence"), [key, "seq"], "left").fillna({"speaker": "S?", "confidence": 0.0})


def numbered_runs(fragments: DataFrame, key: str, speaker: str) -> DataFrame:
    """Fragments with ``utterance_no``, the number of their maximal run of one speaker in sequence order."""
    w = Window.partitionBy(key).orderBy("seq")
    new = (~F.col(speaker).eqNullSafe(F.lag(speaker).over(w)) | (F.col("seq") == 0)).cast("int")
    return fragments.withColumn("_new", new).withColumn("utterance_no", F.sum("_new").over(w) - 1).drop("_new")


def baseline_utterances(fragments: DataFrame, key: str, speaker: str) -> DataFrame:
    """Maximal runs of one speaker in sequence order."""
    runs = numbered_runs(fragments, key, speaker)
    return runs.groupBy(key, "utterance_no").agg(F.min(speaker).alias("speaker"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n_fragments"))


def merge_proposals(fragments: DataFrame, proposals: DataFrame, key: str, speaker: str) -> DataFrame:
    """Utterances after stitching: valid proposals first, then what is left of the baseline runs.

    proposals: key, ordinal, speaker, members array<int>.  Kept: sorted, in range, of one
    speaker (the proposed one), and disjoint from earlier kept ones.
    """
    f = fragments.select(key, "seq", F.col(speaker).alias("own"))
    members = proposals.select(key, "ordinal", "speaker", "members", F.posexplode("members").alias("pos", "seq"))
    ok = members.join(f, [key, "seq"], "left").groupBy(key, "ordinal").agg(F.bool_and(F.coalesce(F.col("own") == F.col("speaker"), F.lit(False))).alias("fits"))
    valid = proposals.join(ok, [key, "ordinal"]).where(F.col("fits") & (F.col("members") == F.array_sort(F.array_distinct("members"))) & (F.size("members") > 0))
    ordered = valid.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "speaker", "members"))).alias("all"))
    none = F.array().cast(valid.select(F.array(F.struct("ordinal", "speaker", "members")).alias("x")).schema["x"].dataType)
    kept = F.aggregate("all", none, lambda acc, x: F.when(F.size(F.array_intersect(F.flatten(F.transform(acc, lambda y: y["members"])), x["members"])) == 0, F.array_append(acc, x)).otherwise(acc))
    chosen = ordered.select(key, F.explode(kept).alias("p")).select(key, F.col("p.ordinal").alias("ordinal"), F.col("p.speaker").alias("speaker"), F.col("p.members").alias("members"))
    covered = chosen.select(key, F.explode("members").alias("seq"))
    w = Window.partitionBy(key).orderBy("seq")
    runs = f.withColumn("_n", (~F.col("own").eqNullSafe(F.lag("own").over(w)) | (F.col("seq") == 0)).cast("int")).withColumn("run", F.sum("_n").over(w))
    rest = runs.join(covered, [key, "seq"], "left_anti").groupBy(key, "run").agg(F.min("own").alias("speaker"), F.array_sort(F.collect_list("seq")).alias("members"))
    out = chosen.select(key, "speaker", "members", F.col("ordinal").alias("proposal")).unionByName(rest.select(key, "speaker", "members", F.lit(None).cast("int").alias("proposal")))
    return out.withColumn("utterance_no", F.row_number().over(Window.partitionBy(key).orderBy(F.element_at("members", 1))) - 1)


def remap_interruptions(interruptions: DataFrame, utterances: DataFrame, key: str) -> DataFrame:
    """Interruptions between proposals as ones between final utterances; the point lies inside the interrupted span."""
    u = utterances.where("proposal is not null").select(key, "proposal", "utterance_no", F.element_at("members", 1).alias("lo"), F.element_at("members", -1).alias("hi"))
    a = u.select(key, F.col("proposal").alias("interrupting"), F.col("utterance_no").alias("by_utterance"))
    b = u.select(key, F.col("proposal").alias("interrupted"), F.col("utterance_no").alias("utterance"), "lo", "hi")
    return interruptions.join(a, [key, "interrupting"]).join(b, [key, "interrupted"]).where(F.col("at_index").between(F.col("lo"), F.col("hi"))).select(key, "by_utterance", "utterance", "at_index")


def ingestion_summary(fragments: DataFrame, utterances: DataFrame, key: str, speaker: str, threshold: float = 0.7) -> DataFrame:
    f = fragments.groupBy(key).agg(F.count(F.lit(1)).alias("n_fragments"), F.count_distinct(speaker).alias("n_speakers"), F.count_if(F.col("confidence") < threshold).alias("n_low_confidence"))
    u = utterances.groupBy(key).agg(F.count(F.lit(1)).alias("n_utterances"))
    return f.join(u, key, "left")
