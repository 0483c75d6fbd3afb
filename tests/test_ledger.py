"""Model calls through a ledger: killed and repeated jobs, failures, shared prompts; failures made up for; stored detail."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ragspark.operators import model_calls
from ragspark.plans import curation as plans

PROMPTS = "k int, model string, system string, prompt string"


def counting_model(folder, stop_at=None, fail=()):
    """A model that leaves a file for every call, and may end its process or fail on a prompt."""
    def model(name, system, prompt):
        fd = os.open(f"{folder}/{prompt}", os.O_CREAT | os.O_APPEND | os.O_WRONLY)
        os.write(fd, b"x")
        os.close(fd)
        if prompt == stop_at:
            os._exit(3)
        if prompt in fail:
            raise RuntimeError("down")
        return {"text": f"{name} says {prompt}", "input_tokens": 1, "output_tokens": 2, "total_tokens": 3}
    return model


def calls(folder):
    return {p.name: len(p.read_text()) for p in folder.iterdir()}


def test_killed_and_repeated_job_asks_no_answered_prompt_again(spark, tmp_path):
    seen, ledger = tmp_path / "seen", str(tmp_path / "ledger")
    seen.mkdir()
    prompts = spark.createDataFrame([(i, "m", "s", f"p{i % 30:02d}") for i in range(90)], PROMPTS).coalesce(1)
    with pytest.raises(Exception):  # noqa: B017 - the worker's process ends, and the job with it
        model_calls.call_model(prompts, ["k"], counting_model(seen, stop_at="p17"), ledger, overlap=1)
    answered = {r.raw for r in model_calls.read_ledger(spark, ledger).collect()}
    assert answered == {f"m says {p}" for p in calls(seen) if p != "p17"}
    first = calls(seen)
    got = model_calls.call_model(prompts, ["k"], counting_model(seen), ledger)
    assert {(r.k, r.raw, r.total_tokens, r.error) for r in got.collect()} == {(i, f"m says p{i % 30:02d}", 3, None) for i in range(90)}
    # Every prompt was answered by one call; only the one that killed the job was tried before.
    assert calls(seen) == {f"p{i:02d}": 1 for i in range(30)} | {"p17": first["p17"] + 1}
    again = model_calls.call_model(prompts, ["k"], counting_model(seen), ledger)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect())) and sum(calls(seen).values()) == 30 + first["p17"]
    # Single files end up in the table.
    assert not list((tmp_path / "ledger" / "calls").rglob("*.json")) and model_calls.read_ledger(spark, ledger).count() == 30


def test_failures_are_asked_again_and_parts_do_not_mix(spark, tmp_path):
    seen, ledger = tmp_path / "seen", str(tmp_path / "ledger")
    seen.mkdir()
    prompts = spark.createDataFrame([(0, "m", "ab", "c"), (1, "m", "a", "bc"), (2, "m", None, "c"), (3, "m", "", "c"), (4, "n", "", "c"), (5, "m", "", "bad")], PROMPTS)
    got = {r.k: r for r in model_calls.call_model(prompts, ["k"], counting_model(seen, fail=("bad",)), ledger).collect()}
    assert got[5].error == "down" and got[5].raw == "" and got[4].raw == "n says c"
    assert calls(seen) == {"c": 4, "bc": 1, "bad": 1}
    got = {r.k: r for r in model_calls.call_model(prompts, ["k"], counting_model(seen), ledger).collect()}
    assert got[5].error is None and calls(seen) == {"c": 4, "bc": 1, "bad": 2}
    assert model_calls.call_model(prompts.limit(0), ["k"], counting_model(seen), ledger).isEmpty()


def question_model(bad):
    def model(name, system, prompt):
        number = int(prompt.rsplit(" ", 1)[1])
        if number in bad:
            raise RuntimeError("down")
        return {"text": "no question" if number in (4, 5) else json.dumps({"question": f"q{number}", "answer": "a"})}
    return model


def test_failed_questions_are_made_up_for(spark, rows):
    plan = spark.createDataFrame(
        [("policy-regulation", i, ["s"], f"material {i}") for i in range(1, 13)] + [("single-module", i, ["s"], f"material {i}") for i in range(13, 16)],
        "type string, position long, sections array<string>, material string")
    got = plans.generate_questions(plan, question_model({1, 2, 14}), targets={"policy-regulation": 4})
    # Of the policies 1 and 2 fail and 4 and 5 are unreadable, so the first four others stand; 10 and later are never asked for.
    assert rows(got, "ord", "question") == [(3, "q3"), (6, "q6"), (7, "q7"), (8, "q8"), (13, "q13"), (15, "q15")]
    short = plans.generate_questions(plan, question_model({1, 2}), targets={"policy-regulation": 50, "cross-module": 2})
    assert [o for o, in rows(short, "ord")] == [3, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
    assert len(rows(plans.generate_questions(plan, question_model(())), "ord")) == 13
