"""Batch extraction over units: contexts, request plan, validation, folding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parlance.operators.resolve import similar_pairs

# Neighbours on either side, by the name of the context.
CONTEXTS = {"none": 0, "immediate": 2, "observer": 4, "broader": 6, "overall": 10}


def context_windows(fragments: DataFrame, key: str, handle: str, k: int) -> DataFrame:
    """``[handle]: text`` lines of k neighbours on either side, the target between marks."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(-k, k)
    line = F.concat(F.lit("["), handle, F.lit("]: "), "text")
    rows = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))).over(w))
    marked = F.transform(rows, lambda x: F.when(x["seq"] == F.col("seq"), F.concat(F.lit(">>> "), x["line"], F.lit(" <<<"))).otherwise(x["line"]))
    return fragments.select(key, "seq", F.array_join(marked, "\n").alias("context"))


def joined_text(members: DataFrame, keys: list[str], order: str, text: Column, separator: str) -> DataFrame:
    """Member texts joined in member order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return members.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x["t"]), separator).alias("text"))


def request_plan(units: DataFrame, extractors: DataFrame) -> DataFrame:
    """Every unit x every enabled extractor of its scope, prompt rendered; extractors is a small declared table."""
    x = F.broadcast(extractors.where("enabled").select("extractor", "scope", "template"))
    prompt = F.replace(F.replace(F.col("template"), F.lit("{text}"), F.col("text")), F.lit("{context}"), F.coalesce("context", F.lit("")))
    return units.join(x, "scope").select("unit_id", "scope", "extractor", prompt.alias("prompt"))


def validate_responses(responses: DataFrame, schema: T.StructType, checks: dict[str, Column]) -> DataFrame:
    """Parsed ``data``, ``status`` and ``flag``: not JSON, a key outside the schema, a missing field or a failed check gives null data."""
    names = schema.fieldNames()
    data = F.from_json("response", schema)
    keys = F.json_object_keys("response")
    r = responses.withColumn("_d", data).withColumn("_k", keys)
    flag = F.when(F.col("_k").isNull(), "malformed").when(F.size(F.array_except("_k", F.array(*map(F.lit, names)))) > 0, "extra_keys")
    for n in names:
        flag = flag.when(F.col(f"_d.{n}").isNull(), f"missing_{n}")
    for name, ok in checks.items():
        flag = flag.when(~ok, name)
    r = r.withColumn("flag", flag)
    return r.withColumn("data", F.when(F.col("flag").isNull(), F.col("_d"))).withColumn("status", F.when(F.col("flag").isNull(), "ok").otherwise("failed")).drop("_d", "_k")


def first_provider(attempts: DataFrame) -> DataFrame:
    """The attempt that counts: the first in chain order that is not an availability error.

    A request whose every provider was unavailable is not served: its last attempt, with its error, stands for it.
    """
    away = F.col("outcome") == "unavailable"
    w = Window.partitionBy("request_id").orderBy(away, F.when(away, -F.col("rank")).otherwise(F.col("rank")))
    return attempts.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k").withColumn("served", F.col("outcome") == "ok")


def model_call(requests: DataFrame, fn: Callable[[list[str]], list[str]], batch: int = 64, schema: str = "unit_id string, extractor string, response string") -> DataFrame:
    """Calls ``fn`` on lists of at most ``batch`` prompts, on the executors; it returns a response for each.

    A task has one call open at a time, so the number of partitions bounds the concurrency.
    """

    def run(frames):
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                said = fn(part["prompt"].tolist())
                if len(said) != len(part):
                    raise ValueError(f"{len(said)} responses to {len(part)} prompts")
                yield part[["unit_id", "extractor"]].assign(response=said)

    return requests.select("unit_id", "extractor", "prompt").mapInPandas(run, schema)


def fold_outcomes(outcomes: DataFrame, unit: str) -> DataFrame:
    """Per unit: label and confidence by dimension, mean confidence, last provider, mixed-provider flag."""
    ok = F.col("status") == "ok"
    entries = F.array_sort(F.collect_list(F.when(ok, F.struct("dimension", "label", "confidence"))))
    providers = F.array_sort(F.collect_set(F.when(ok, F.col("provider"))))
    f = outcomes.groupBy(unit).agg(entries.alias("e"), F.round(F.avg(F.when(ok, F.col("confidence"))), 6).alias("mean_confidence"), F.max_by(F.when(ok, F.col("provider")), F.when(ok, F.col("ordinal"))).alias("last_provider"), providers.alias("p"), F.count_if(ok).alias("n_ok"))
    return f.select(unit, F.map_from_entries(F.transform("e", lambda x: F.struct(x["dimension"], x["label"]))).alias("labels"), F.map_from_entries(F.transform("e", lambda x: F.struct(x["dimension"], x["confidence"]))).alias("confidences"), "mean_confidence", "last_provider", F.when(F.size("p") > 1, F.array_join("p", ",")).alias("mixed_providers"), "n_ok")


def rule_label(text: Column) -> Column:
    """What the end mark alone says of a sentence; null where it says nothing (telling a command needs a parse)."""
    t = F.rtrim(text)
    return F.when(t.endswith("?"), "interrogative").when(t.endswith("!"), "exclamatory")


def cross_check(rows: DataFrame, text: str, label: str) -> DataFrame:
    """Adds rule_label and whether it disagrees; empty labels, and texts without a rule label, are never flagged."""
    r = rows.withColumn("rule_label", rule_label(F.col(text)))
    return r.withColumn("disagrees", F.coalesce((F.trim(label) != "") & (F.lower(F.trim(label)) != F.col("rule_label")), F.lit(False)))


def latest_mentions(extractions: DataFrame, fragment: str) -> DataFrame:
    """Mentions of the latest extraction of each fragment; surface lower-cased, spans checked.

    extractions: fragment, version, entities array<struct<text, entity_type, start, end, confidence>>.
    """
    last = extractions.groupBy(fragment).agg(F.max_by("entities", "version").alias("entities"))
    return last.select(fragment, F.inline("entities")).where(F.col("end") > F.col("start")).withColumn("surface", F.lower("text"))


def record_claims(responses: DataFrame, members: DataFrame, known: DataFrame, claim_id: Callable[..., Column]) -> tuple[DataFrame, DataFrame]:
    """(new claims, their supports): ordinal ids, known ids skipped, speaker and supports from the utterance."""
    c = responses.select("utterance_id", "speaker", F.posexplode("claims").alias("ordinal", "claim"))
    c = c.withColumn("claim_id", claim_id("utterance_id", "ordinal")).join(known.select("claim_id"), "claim_id", "left_anti")
    claims = c.select("claim_id", "utterance_id", "ordinal", "speaker", F.col("claim.text").alias("text"), F.col("claim.kind").alias("kind"), F.col("claim.confidence").alias("confidence"))
    return claims, claims.select("claim_id", "utterance_id").join(members, "utterance_id").select("claim_id", "fragment_id")


def pending(units: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Units still to be processed; all when forced."""
    return units if force else units.join(done.select(key).distinct(), key, "left_anti")


def retry_set(outcomes: DataFrame, unit: str) -> DataFrame:
    """Units whose every call failed."""
    return outcomes.groupBy(unit).agg(F.count_if(F.col("status") == "ok").alias("n")).where("n = 0").select(unit)


def valid_segments(proposals: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Proposals of the interviews whose ranges are all right: not inverted, inside, without overlap.

    sizes: key, present array<int> of the indexes that exist.
    """
    w = Window.partitionBy(key).orderBy("start_index", "end_index")
    p = proposals.withColumn("_last", F.max("end_index").over(w.rowsBetween(Window.unboundedPreceding, -1))).join(sizes, key, "left")
    wanted = F.when(F.col("start_index") <= F.col("end_index"), F.sequence("start_index", "end_index"))
    ok = F.coalesce((F.size(F.array_except(wanted, F.coalesce("present", F.array().cast("array<int>")))) == 0) & F.coalesce(F.col("_last") < F.col("start_index"), F.lit(True)), F.lit(False))
    return p.withColumn("_ok", F.bool_and(ok).over(Window.partitionBy(key))).where("_ok").drop("_ok", "_last", "present")


def without_conflicts(proposals: DataFrame, alive: DataFrame, key: str) -> DataFrame:
    """Proposals of interviews in which no new range meets a live one of another id."""
    n = proposals.select(key, F.col("segment_id").alias("n_id"), F.col("start_index").alias("n_lo"), F.col("end_index").alias("n_hi"))
    hit = n.join(alive.select(key, "segment_id", "start_index", "end_index"), key).where("n_id != segment_id and n_lo <= end_index and start_index <= n_hi").select(key).distinct()
    return proposals.join(hit, key, "left_anti")


def record_segments(proposals: DataFrame, state: DataFrame) -> DataFrame:
    """Segments to record: unknown ids, and removed ones that come back."""
    return proposals.join(state.select("segment_id", "removed"), "segment_id", "left").where("removed is null or removed").withColumn("again", F.coalesce("removed", F.lit(False))).drop("removed")


def hashed_counts(text: Column, dim: int = 32) -> Column:
    """Counts of a text's words hashed to ``dim`` slots; those of texts joined by blanks are the sums of theirs."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("long") % dim).cast("int"))
    count = lambda s: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(s, lambda x: x == i)).cast("double"))
    return F.element_at(F.transform(F.array(slots), count), 1)


def summed_vectors(members: DataFrame, keys: list[str], vector: str, dim: int = 32) -> DataFrame:
    """The sum of the members' vectors of ``dim`` numbers; null ones add nothing."""
    sums = F.array(*(F.coalesce(F.sum(F.get(vector, F.lit(i))), F.lit(0.0)) for i in range(dim)))
    return members.groupBy(*keys).agg(sums.alias("vector"))


def hashed_vectors(units: DataFrame, unit: str, text: str, dim: int = 32, model: str = "hashed-words-1") -> DataFrame:
    """Default embedder: counts of words hashed to ``dim`` slots, unit length; native, so no model call is needed."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("long") % dim).cast("int"))

    def let(value: Column, use) -> Column:  # evaluated once, however often it is used
        return F.element_at(F.transform(F.array(value), use), 1)

    def counts(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(s, lambda x: x == i)).cast("double"))

    def scaled(c: Column) -> Column:
        return let(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0)))

    return units.select(unit, F.lit(model).alias("model"), let(slots, lambda s: let(counts(s), scaled)).alias("vector"))


def wrong_dimension(vectors: DataFrame, dims: dict[str, int]) -> DataFrame:
    """Vectors whose size is not what their model declares."""
    want = F.create_map(*(F.lit(x) for kv in dims.items() for x in kv))
    return vectors.where(~F.coalesce(F.size("vector") == F.try_element_at(want, F.col("model")), F.lit(False)))


def comparable_pairs(vectors: DataFrame, key: str, block: list[str], column: str, low: float, model: str = "model") -> DataFrame:
    """Similar pairs inside a block and one model: vectors of different models never meet; a model of two sizes is refused."""
    mixed = vectors.groupBy(model).agg(F.min(F.size(column)).alias("x"), F.max(F.size(column)).alias("y")).where("x != y").select(model).limit(5).collect()
    if mixed:
        raise ValueError(f"vectors of several sizes: {[r[0] for r in mixed]}")
    return similar_pairs(vectors, key, [model, *block], column, low)
