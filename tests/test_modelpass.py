"""Model passes: each window stands or falls alone."""

import json
import re
import sys

import pytest
from pyspark import cloudpickle

from parlance.operators import ingest, modelpass

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file


def fragments(spark, n=30):
    rows = [(i, s, f"text {i} {s}", "ann" if s % 4 < 2 else "bob") for i in (1, 2) for s in range(n)]
    return spark.createDataFrame(rows, "interview_id int, seq int, text string, speaker string").repartition(3)


def speaker_model(prompts):
    out = []
    for p in prompts:
        lines = re.findall(r"^(\d+): text (\d+) (\d+)$", p, re.M)
        interview, first = int(lines[0][1]), int(lines[0][2])
        if interview == 2 and first == 8:
            raise TimeoutError("window 1")
        # local names: the first speaker of a window is S1
        names = {}
        said = [{"index": int(k), "speaker": names.setdefault("ann" if int(s) % 4 < 2 else "bob", f"S{len(names) + 1}"), "confidence": 0.5 + first / 100} for k, _, s in lines]
        if interview == 2 and first == 16:
            said[0]["confidence"] = 3.0
        out.append(json.dumps({"assignments": said + [{"index": 99, "speaker": "x", "confidence": 0.1}, {"index": -1, "speaker": "x", "confidence": 0.1}]}))
    return out


def test_speakers_of_failed_windows_are_unknown(spark):
    """Windows of 10 with 2 repeated; one is never answered, one breaks the schema, and names go on through the others."""
    got, outcomes = modelpass.infer_speakers(fragments(spark), "interview_id", speaker_model, 10, 2)
    flags = {(x.interview_id, x.window): (x.status, x.flag, x.error) for x in outcomes.collect()}
    assert {k: v[1] for k, v in flags.items() if v[0] == "failed"} == {(2, 1): "unanswered", (2, 2): "bad_assignment"} and flags[2, 1][2] == "TimeoutError: window 1"
    assert len(flags) == 8
    rows = {(x.interview_id, x.seq): (x.speaker, x.confidence) for x in got.collect()}
    assert len(rows) == 60
    for s in range(30):
        who = "S1" if s % 4 < 2 else "S2"
        assert rows[1, s] == (who, 0.5 + (0 if s < 10 else 8 if s < 18 else 16 if s < 26 else 24) / 100)
        if s < 10:
            assert rows[2, s] == (who, 0.5)
        elif s < 24:
            assert rows[2, s] == ("S?", 0.0)
        else:
            assert rows[2, s][1] == 0.74


def stitch_model(prompts):
    out = []
    for p in prompts:
        lines = re.findall(r"^(\d+): \[(.*?)\] text (\d+) \d+$", p, re.M)
        first, interview = int(lines[0][0]), int(lines[0][2])
        if interview == 1 and first == 10:
            raise ValueError("window 1")
        if interview == 2 and first == 10:
            out.append('{"utterances": "none"}')
            continue
        ann = [int(s) for s, who, _ in lines if who == "ann"][:4]
        bob = [int(s) for s, who, _ in lines if who == "bob"][:2]
        out.append(json.dumps({"utterances": [{"speaker": "ann", "fragment_indices": ann, "confidence": 0.9}, {"speaker": "bob", "fragment_indices": bob, "confidence": 0.9}], "interruptions": [{"interrupting": 1, "interrupted": 0, "at_index": bob[0]}, {"interrupting": 1, "interrupted": 7, "at_index": 0}]}))
    return out


@pytest.mark.parametrize("batch", [1, 50])
def test_stitching_falls_back_window_by_window(spark, batch, monkeypatch):
    real = modelpass.ask
    monkeypatch.setattr(modelpass, "ask", lambda r, fn: real(r, fn, batch))
    f = fragments(spark)
    utterances, interruptions, outcomes = modelpass.stitch_utterances(f, "interview_id", "speaker", stitch_model, 10)
    assert {(x.interview_id, x.window): x.flag for x in outcomes.collect() if x.flag} == {(1, 1): "unanswered", (2, 1): "missing_utterances"}
    got = {i: sorted((list(x.members), x.speaker, x.proposal is not None) for x in utterances.where(f"interview_id = {i}").collect()) for i in (1, 2)}
    assert got[1] == got[2]  # both lost the same window, for different reasons
    assert sorted(s for m, _, _ in got[1] for s in m) == list(range(30))
    proposed = [m for m, _, p in got[1] if p]
    assert proposed == [[0, 1, 4, 5], [2, 3], [20, 21, 24, 25], [22, 23]]
    runs = {tuple(range(x.first_seq, x.last_seq + 1)) for x in ingest.baseline_utterances(f.where("interview_id = 1"), "interview_id", "speaker").collect()}
    covered = {s for m in proposed for s in m}
    assert {tuple(m) for m, _, p in got[1] if not p} == {r for run in runs if (r := tuple(s for s in run if s not in covered))}
    number = {tuple(x.members): x.utterance_no for x in utterances.where("interview_id = 1").collect()}
    assert {(x.by_utterance, x.utterance, x.at_index) for x in interruptions.where("interview_id = 1").collect()} == {(number[2, 3], number[0, 1, 4, 5], 2), (number[22, 23], number[20, 21, 24, 25], 22)}


def test_wrong_number_of_answers(spark):
    d = spark.createDataFrame([(k, f"p{k}") for k in range(5)], "k int, prompt string").coalesce(1)
    got = {x.k: (x.response, x.error) for x in modelpass.ask(d, lambda ps: ps if len(ps) == 1 else ps[:-1], 3).collect()}
    assert got == {k: (f"p{k}", None) for k in range(5)}
    assert modelpass.ask(d.where("false"), lambda ps: ps).count() == 0
