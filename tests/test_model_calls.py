"""Injected model caller with retries over the batched feedback."""

import pytest

from small_data import SF_SMALL
from feedmine.operators import model as md
from feedmine.plans import analysis as an
from feedmine.plans.catalog import valid_fake_model
from feedmine.sources import replay_fixture as rf
from feedmine.sources import testdata as fx


def test_caller_notes_and_failure_after_three_attempts(spark):
    def short_for_some(system, prompt):
        """Valid answers, except one item short for prompts with a fourth comment.
        (Defined here so that it is shipped to the workers by value.)"""
        import json
        raw = json.loads(valid_fake_model(system, prompt))
        if "--- Comment 3 ---" in prompt:
            text = json.loads(raw["output"][0]["content"][0]["text"])
            text["items"] = text["items"][:-1]
            raw["output"][0]["content"][0]["text"] = json.dumps(text)
        return json.dumps(raw)

    batched = rf.batched_roots(spark, SF_SMALL)
    notes = an.analyze_with_caller(batched, fx.pr_diffs(spark, SF_SMALL), valid_fake_model, "system")
    assert notes.count() == batched.count()
    with pytest.raises(RuntimeError, match="no valid answer after 3 attempts"):
        an.analyze_with_caller(batched, fx.pr_diffs(spark, SF_SMALL), short_for_some, "system")


def test_prompts_reach_a_task_in_small_batches(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    prompts = spark.createDataFrame([("a", "x"), ("b", "y")], "prompt_id string, prompt string")
    seen, checkpoint, before = [], DataFrame.checkpoint, spark.conf.get(md.BATCH_CONF)
    monkeypatch.setattr(DataFrame, "checkpoint", lambda df, eager=True: seen.append(spark.conf.get(md.BATCH_CONF)) or checkpoint(df, eager))
    assert md.annotate(prompts, lambda system, prompt: prompt, "s").count() == 2
    assert seen == [md.BATCH_BYTES] and spark.conf.get(md.BATCH_CONF) == before


def test_answers_go_back_in_few_frames(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    prompts = spark.range(1000).selectExpr("cast(id as string) as prompt_id", "concat('p', id) as prompt")
    seen = []
    monkeypatch.setattr(DataFrame, "mapInPandas", lambda df, run, schema: seen.append(run) or df.selectExpr(
        "prompt_id", "1 as attempt", "prompt as raw", "cast(null as string) as call_error"))

    def odd(system, prompt):
        if prompt.endswith("7"):
            raise ValueError(prompt)
        return system + prompt
    md.annotate(prompts, odd, "s")
    frames = list(seen[0](iter([prompts.toPandas(), prompts.limit(3).toPandas(), prompts.limit(0).toPandas()])))
    assert [len(f) for f in frames if len(f)] == [1000, 3]
    first = frames[0].set_index("prompt_id")
    assert first.loc["12", "raw"] == "sp12" and first.loc["12", "call_error"] is None
    assert first.loc["17", "raw"] is None and first.loc["17", "call_error"] == "model call failed: p17"
    monkeypatch.setattr(md, "ANSWER_CHARS", 100)  # long answers don't wait for the end of the batch
    frames = list(seen[0](iter([prompts.toPandas()])))
    assert max(map(len, frames)) < 40 and sum(map(len, frames)) == 1000
