"""A job moves its own answers into the ledger's table without reading their files back."""

from ragspark.operators import model_calls


def test_own_answers_are_not_read_from_files(spark, tmp_path, monkeypatch):
    ledger, left = tmp_path / "ledger", []
    read = model_calls._read

    def spying(session, path, form):
        if form == "json":
            left.append(len(list((ledger / "calls").rglob("*.json"))))
        return read(session, path, form)

    monkeypatch.setattr(model_calls, "_read", spying)
    prompts = spark.createDataFrame([(i, "m", "s", f"p{i % 30}") for i in range(60)], "k int, model string, system string, prompt string")
    answer = lambda model, system, prompt: {"text": prompt * 2}
    got = model_calls.call_model(prompts, ["k"], answer, str(ledger))
    assert {(r.k, r.raw) for r in got.collect()} == {(i, f"p{i % 30}" * 2) for i in range(60)}
    assert left and set(left) == {0}
    assert model_calls.read_ledger(spark, str(ledger)).count() == 30
