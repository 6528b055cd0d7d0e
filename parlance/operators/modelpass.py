"""Model passes over windows of an interview: request, call, validate, reconcile; a window that fails falls back alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators.enrich import validate_responses
from parlance.operators.ingest import fill_assignments, merge_proposals, reconcile_windows, remap_interruptions
from parlance.plans.scratch import materialise

#: Fragments of a window of each pass, and how many of them the next one repeats.
SPEAKER_WINDOW, SPEAKER_OVERLAP, STITCH_WINDOW = 40, 10, 400
_SPEAKERS = "assignments array<struct<index: int, speaker: string, confidence: double>>"
_UTTERANCES = "utterances array<struct<speaker: string, fragment_indices: array<int>, confidence: double>>, interruptions array<struct<interrupting: int, interrupted: int, at_index: int>>"


def ask(requests: DataFrame, fn: Callable[[list[str]], list[str]], batch: int = 8) -> DataFrame:
    """Adds ``response`` and ``error`` to requests with a ``prompt``; written once.

    ``fn`` gets lists of at most ``batch`` prompts.  If a list fails, its prompts are asked one by one, so that only those
    that fail themselves have no response.
    """
    schema = T.StructType([*requests.schema.fields, T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])

    def one(prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            said = fn(prompts)
            if len(said) != len(prompts):
                raise ValueError(f"{len(said)} responses to {len(prompts)} prompts")
            return [(x, None) for x in said]
        except Exception as e:  # whatever a plug-in raises; it is kept as the window's error
            if len(prompts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            return [one([p])[0] for p in prompts]

    def run(frames):
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                said = one(part["prompt"].tolist())
                yield part.assign(response=[r for r, _ in said], error=[e for _, e in said]).astype({"response": object, "error": object})

    return materialise(requests.mapInPandas(run, schema))


def _lines(rows: DataFrame, keys: list[str], line: Column, head: str) -> DataFrame:
    """One prompt per window; a window's lines are bounded by its size."""
    p = rows.groupBy(*keys).agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("lines"))
    return p.select(*keys, "first_seq", "n_lines", F.concat(F.lit(head), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("prompt"))


def _judged(answers: DataFrame, schema: str, checks: dict[str, Column]) -> DataFrame:
    """Validated answers; one that never came is ``unanswered``."""
    v = validate_responses(answers, T.StructType.fromDDL(schema), checks)
    return v.withColumn("flag", F.when(F.col("response").isNull(), "unanswered").otherwise(F.col("flag")))


def infer_speakers(fragments: DataFrame, key: str, fn: Callable[[list[str]], list[str]], size: int = SPEAKER_WINDOW, overlap: int = SPEAKER_OVERLAP, head: str = "") -> tuple[DataFrame, DataFrame]:
    """(``key, seq, speaker, confidence`` of every fragment, outcome of every window).

    fragments: key, seq, text.  A window's prompt numbers its texts from 0; the answer assigns speakers to numbers.  Answers
    that fail or break the schema leave their window without assignments; numbers out of range are dropped.  Names of later
    windows become those of earlier ones by majority on the overlap; a fragment that no window assigns is ``S?``.
    """
    step = size - overlap
    n = fragments.groupBy(key).agg((F.max("seq") + 1).alias("n"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step)).cast("int")
    low = F.greatest(F.lit(0), F.ceil((F.col("seq") - size + 1) / step)).cast("int")
    high = F.least(last, F.floor(F.col("seq") / step).cast("int"))
    in_window = fragments.select(key, "seq", "text").join(n, key).withColumn("window", F.explode(F.sequence(F.least(low, high), high)))
    line = F.concat((F.col("seq") - F.col("window") * step).cast("string"), F.lit(": "), F.col("text"))
    answers = ask(_lines(in_window, [key, "window"], line, head), fn)
    a = F.col("_d.assignments")
    whole = F.forall(a, lambda x: x["index"].isNotNull() & x["speaker"].isNotNull() & F.coalesce(x["confidence"].between(0, 1), F.lit(False)))
    judged = _judged(answers, _SPEAKERS, {"bad_assignment": whole})
    said = judged.where("status = 'ok'").select(key, "window", "first_seq", "n_lines", F.posexplode("data.assignments").alias("ordinal", "x")).where((F.col("x.index") >= 0) & (F.col("x.index") < F.col("n_lines")))
    # of two assignments of one number the later counts, as in a mapping
    said = said.groupBy(key, "window", (F.col("first_seq") + F.col("x.index")).alias("seq")).agg(F.max_by(F.struct("x.speaker", "x.confidence", "ordinal"), "ordinal").alias("x")).select(key, "window", "seq", F.col("x.speaker").alias("speaker"), F.col("x.confidence").alias("confidence"), F.col("x.ordinal").alias("ordinal"))
    said = materialise(said)
    sure = said.groupBy(key, "seq").agg(F.min_by("confidence", "window").alias("confidence"))
    settled = reconcile_windows(said.select(key, "window", "seq", "speaker", "ordinal"), key).join(sure, [key, "seq"])
    return fill_assignments(fragments, settled, key), judged.select(key, "window", "status", "flag", "error")


def stitch_utterances(fragments: DataFrame, key: str, speaker: str, fn: Callable[[list[str]], list[str]], size: int = STITCH_WINDOW, head: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(utterances, interruptions, outcome of every window): a model's proposals where they hold, runs of one speaker elsewhere.

    fragments: key, seq, text, speaker.  Windows of ``size`` fragments do not overlap; a prompt has a line ``seq: [speaker] text`` per
    fragment.  What an answer proposes is judged by merge_proposals; a window without a valid answer proposes nothing, so its
    fragments keep their runs, and its neighbours keep their proposals.
    """
    rows = fragments.withColumn("window", F.floor(F.col("seq") / size).cast("int"))
    line = F.concat(F.col("seq").cast("string"), F.lit(": ["), F.coalesce(speaker, F.lit("S?")), F.lit("] "), F.col("text"))
    answers = ask(_lines(rows, [key, "window"], line, head), fn)
    u, i = F.col("_d.utterances"), F.col("_d.interruptions")
    whole = F.forall(u, lambda x: x["speaker"].isNotNull() & x["fragment_indices"].isNotNull() & F.coalesce(x["confidence"].between(0, 1), F.lit(False)))
    points = F.forall(i, lambda x: x["interrupting"].isNotNull() & x["interrupted"].isNotNull() & x["at_index"].isNotNull())
    judged = _judged(answers, _UTTERANCES, {"bad_utterance": whole, "bad_interruption": points})
    # a window has fewer proposals than this: ordinals of an interview follow its windows
    ordinal = lambda k: (F.col("window") * F.lit(1_000_000) + k).cast("int")
    ok = judged.where("status = 'ok'")
    proposals = ok.select(key, "window", F.posexplode("data.utterances").alias("k", "x")).select(key, ordinal(F.col("k")).alias("ordinal"), F.col("x.speaker").alias("speaker"), F.col("x.fragment_indices").alias("members"))
    points = ok.select(key, "window", F.inline("data.interruptions")).select(key, ordinal(F.col("interrupting")).alias("interrupting"), ordinal(F.col("interrupted")).alias("interrupted"), "at_index")
    utterances = merge_proposals(fragments, materialise(proposals), key, speaker)
    return utterances, remap_interruptions(points, utterances, key), judged.select(key, "window", "status", "flag", "error")
