"""Assemble exportable documents as rows (bundle, path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parlance.functions.text import slug
from parlance.plans.scratch import materialise


def anchors(members: DataFrame) -> DataFrame:
    """``u-n`` by first appearance of a fragment's utterance, else ``f-seq``; members: interview_id, fragment_id, seq, utterance_id (or null)."""
    first = members.where("utterance_id is not null").groupBy("interview_id", "utterance_id").agg(F.min("seq").alias("first_seq"))
    n = first.withColumn("n", F.row_number().over(Window.partitionBy("interview_id").orderBy("first_seq", "utterance_id"))).drop("first_seq")
    j = members.join(n, ["interview_id", "utterance_id"], "left")
    return j.withColumn("anchor", F.when(F.col("n").isNotNull(), F.concat(F.lit("u-"), "n")).otherwise(F.concat(F.lit("f-"), "seq"))).drop("n")


def unique_slugs(names: DataFrame, bundle: str, name: str, order: str) -> DataFrame:
    """Adds ``slug``, unique inside a bundle: in order, each name gets its own slug if that is free, else the first free ``-2``, ``-3`` and so on.

    A slug can only meet slugs that extend it by numbers, and only where a slug before it is wanted twice.  What no
    such slug leads to keeps its own; a wanted slug that no other leads to is numbered by a window; the
    rest is walked in order, one set of slugs that lead to each other at a time.  Names and what is wanted twice are
    written, as each is read several times.
    """
    s = materialise(names.withColumn("_base", slug(F.col(name))))
    n = materialise(s.groupBy(bundle, "_base").agg(F.count(F.lit(1)).alias("_n")))
    ends = F.length(F.regexp_extract("_base", "((?:-[0-9]+)*)$", 1)) - F.length(F.regexp_replace(F.regexp_extract("_base", "((?:-[0-9]+)*)$", 1), "-", ""))
    words = F.split("_base", "-")
    stems = n.select(bundle, "_base", F.explode(F.transform(F.sequence(F.lit(0), ends), lambda k: F.array_join(F.slice(words, F.lit(1), F.size(words) - k), "-"))).alias("_stem"))
    wanted = n.where("_n > 1").select(bundle, F.col("_base").alias("_stem"))
    tops = stems.join(wanted, [bundle, "_stem"]).groupBy(bundle, "_base").agg(F.min_by("_stem", F.length("_stem")).alias("_top"))
    tops = materialise(tops)
    mixed = tops.groupBy(bundle, "_top").agg((F.count(F.lit(1)) > 1).alias("_mixed"))
    s = s.join(materialise(tops.join(mixed, [bundle, "_top"])), [bundle, "_base"], "left")
    k = F.row_number().over(Window.partitionBy(bundle, "_base").orderBy(order)).cast("string")
    free = s.where("_top is null").withColumn("slug", F.col("_base"))
    plain = s.where("not _mixed").withColumn("_k", k).withColumn("slug", F.when(F.col("_k") == "1", F.col("_base")).otherwise(F.concat("_base", F.lit("-"), "_k"))).drop("_k")
    schema = T.StructType([*s.schema.fields, T.StructField("slug", T.StringType())])

    def walk(frames):
        at, taken, after = None, set(), {}
        for f in frames:
            found = []
            for key in zip(f[bundle], f["_top"], f["_base"], strict=True):
                if at != key[:2]:
                    at, taken, after = key[:2], set(), {}
                base = got = key[2]
                while got in taken:
                    after[base] = after.get(base, 1) + 1
                    got = f"{base}-{after[base]}"
                taken.add(got)
                found.append(got)
            yield f.assign(slug=found)

    walked = s.where("_mixed").repartition(bundle, "_top").sortWithinPartitions(bundle, "_top", order).mapInPandas(walk, schema)
    return free.unionByName(plain).unionByName(walked).drop("_base", "_top", "_mixed")


def tallies(rows: DataFrame, key: str, values: str) -> DataFrame:
    """How often each value occurs, with its place: most frequent first, then by name."""
    n = rows.select(key, F.explode(values).alias("value")).groupBy(key, "value").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "value")))


def transcript_documents(fragments: DataFrame) -> DataFrame:
    """Markdown per interview: a heading where a topic starts, an anchored header where an utterance starts.

    fragments: interview_id, seq, text, speaker, anchor, topic (or null).
    """
    w = Window.partitionBy("interview_id").orderBy("seq")
    topic = F.when(F.col("topic").isNotNull() & ~F.col("topic").eqNullSafe(F.lag("topic").over(w)), F.concat(F.lit("## "), "topic"))
    header = F.when(~F.col("anchor").eqNullSafe(F.lag("anchor").over(w)), F.concat(F.lit("**"), "speaker", F.lit("** {#"), "anchor", F.lit("}")))
    f = fragments.withColumn("block", F.concat_ws("\n", topic, header, F.col("text")))
    rows = F.array_sort(F.collect_list(F.struct("seq", "block")))
    return f.groupBy("interview_id").agg(F.array_join(F.transform(rows, lambda x: x["block"]), "\n").alias("content"))


def quotes(supports: DataFrame, fragments: DataFrame, key: str) -> DataFrame:
    """Verbatim grounding of items or claims in transcript order: each text, then who said it and where.

    fragments: fragment_id, interview_id, seq, text, speaker, anchor.
    """
    j = supports.join(fragments.select("fragment_id", "interview_id", "seq", "text", "speaker", "anchor"), "fragment_id")
    line = F.concat(F.lit("> "), "text", F.lit("\n> — "), F.coalesce("speaker", F.lit("Unknown")), F.lit(", ["), "anchor", F.lit("](/transcript.md#"), "anchor", F.lit(")"))
    return j.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("interview_id", "seq", line.alias("line")))), lambda x: x["line"]), "\n").alias("quotes"))


def back_links(links: DataFrame, key: str) -> DataFrame:
    """What points at each page; links: key, kind, target."""
    return links.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "target"))), ",").alias("back_links"), F.count(F.lit(1)).alias("n_links"))


def paged(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions with their page: the canonical entity of the surface, or the surface alone."""
    return mentions.join(aliases, "surface", "left").withColumn("page", F.coalesce("canonical_id", F.concat(F.lit("surface:"), "surface")))


def entity_pages(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per page and alias: all surfaces of the page in order, with the mentions of the alias and of the page."""
    a = paged(mentions, aliases).groupBy("page", "surface").agg(F.count(F.lit(1)).alias("n"))
    by_page = Window.partitionBy("page")
    place = F.row_number().over(by_page.orderBy("surface"))
    return a.select("page", F.col("surface").alias("alias"), place.alias("place"), F.col("n").alias("n_alias_mentions"), F.sum("n").over(by_page).alias("n_mentions"), F.count(F.lit(1)).over(by_page).alias("n_surfaces"))


def mention_tables(mentions: DataFrame, aliases: DataFrame, anchored: DataFrame) -> DataFrame:
    """The mention table of each page as rows ordered by interview, seq and pos; cells on one line, pipes escaped.

    mentions: fragment_id, pos, surface, confidence; anchored: fragment_id, interview_id, seq, anchor.
    """
    cell = F.replace(F.trim(F.regexp_replace("surface", r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    where = F.coalesce(F.concat(F.lit("["), "anchor", F.lit("](/transcript.md#"), "anchor", F.lit(")")), F.lit(""))
    j = paged(mentions, aliases).join(anchored.select("fragment_id", "interview_id", "seq", "anchor"), "fragment_id", "left")
    return j.select("page", "interview_id", "seq", "pos", cell.alias("text"), "confidence", where.alias("location"))


def safe_title(text: Column, size: int = 80) -> Column:
    """One line of at most ``size`` characters, cut first, then backslashes and brackets escaped."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.regexp_replace(F.substr(one, F.lit(1), F.lit(size)), r"([\[\]\\])", r"\\$1")


def document(front: dict[str, Column], text: Column, relations: Column, grounding: Column) -> Column:
    """Front matter (null values left out), the text, what it relates to, and its grounding."""
    head = F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in front.items()))
    return F.concat(F.lit("---\n"), head, F.lit("\n---\n"), F.coalesce(F.concat(text, F.lit("\n\n")), F.lit("")), F.lit("## Relationships\n"), F.coalesce(F.concat(relations, F.lit("\n")), F.lit("")), F.lit("\n## Grounding\n"), F.coalesce(grounding, F.lit("")))


def item_documents(items: DataFrame, quotes_of: DataFrame) -> DataFrame:
    """(bundle, kind, path, content) of each item; items: item_id, bundle, lens, type, slug, text, confidence, speaker (linked, or null)."""
    j = items.join(quotes_of, "item_id", "left")
    front = {"type": F.col("type"), "title": F.coalesce(safe_title(F.col("text")), F.col("item_id")), "item_id": F.col("item_id"), "lens": F.col("lens"), "confidence": F.col("confidence"), "tags": F.concat(F.lit("[lens:"), "lens", F.lit("]"))}
    return j.select("bundle", F.lit("item").alias("kind"), F.concat(F.col("type"), F.lit("s/"), F.col("slug"), F.lit(".md")).alias("path"), document(front, F.col("text"), F.concat(F.lit("OWNER: "), safe_title(F.col("speaker"))), F.col("quotes")).alias("content"))


def claim_documents(claims: DataFrame, quotes_of: DataFrame) -> DataFrame:
    """(bundle, kind, path, content) of each claim; claims: claim_id, bundle, slug, text, claim_kind, confidence, speaker."""
    j = claims.join(quotes_of, "claim_id", "left")
    front = {"type": F.lit("Claim"), "title": F.coalesce(safe_title(F.col("text")), F.col("claim_id")), "item_id": F.col("claim_id"), "kind": F.col("claim_kind"), "confidence": F.col("confidence")}
    return j.select("bundle", F.lit("claim").alias("kind"), F.concat(F.lit("claims/"), F.col("slug"), F.lit(".md")).alias("path"), document(front, F.col("text"), F.concat(F.lit("MADE_BY: "), safe_title(F.col("speaker"))), F.col("quotes")).alias("content"))


def index_documents(pages: DataFrame) -> DataFrame:
    """One index per bundle: pages listed by section; pages: bundle, section, title, path."""
    line = F.concat(F.lit("- ["), "title", F.lit("]("), "path", F.lit(")"))
    s = pages.groupBy("bundle", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    part = F.concat(F.lit("## "), "section", F.lit("\n"), "lines")
    return s.groupBy("bundle").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("content"))


def manifest(files: DataFrame, headers: DataFrame) -> DataFrame:
    """Counts per bundle and kind, a digest of all paths and contents that does not depend on their order, and the header counts.

    files: bundle, kind, path, content; headers: bundle, and a count a column.
    """
    part = F.conv(F.substring(F.sha2(F.concat_ws("\n", "path", "content"), 256), 1, 7), 16, 10).cast("long")
    n = files.groupBy("bundle").agg(F.count(F.lit(1)).alias("n_files"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}s") for k in ("item", "claim")), F.count_if(F.col("kind") == "entity").alias("n_entities"), F.sum(F.length("content")).alias("n_chars"), F.sum(part).alias("content_digest"))
    return n.join(headers, "bundle", "left")


def export_log(entries: DataFrame) -> DataFrame:
    """All entries with their day, newest first; entries: ts, entry_id, message."""
    return entries.withColumn("day", F.to_date("ts")).orderBy(F.desc("ts"), F.desc("entry_id"))
