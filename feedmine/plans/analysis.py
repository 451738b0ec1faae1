"""The analysis job: batched feedback → prompts → model responses → validated notes.

Model responses come either from recorded responses (J2) or from an injected
caller (J1); both go through the same H12 → C3 → H10 → E4 chain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmine.operators import model as md
from feedmine.operators import validate as va
from feedmine.operators.batching import batch_prompts, prompt_id
from feedmine.schemas import ANALYSIS_MAX_ATTEMPTS
from feedmine.session import materialize


def prompts_for(batched: DataFrame, diffs: DataFrame) -> DataFrame:
    p = batch_prompts(batched, diffs)
    return p.withColumn("prompt_id", prompt_id(F.col("prompt")))


def parsed(responses: DataFrame, mode: str = "responses") -> DataFrame:
    """H12 over a response table, materialised once (see ``session.materialize``)."""
    obj, err = md.response_object(F.col("raw"), mode)
    if "call_error" in responses.columns:
        err = F.coalesce("call_error", err)
    return materialize(responses.select("batch_id", "attempt", obj.alias("obj"), err.alias("error")))


def analyze_recorded(batched: DataFrame, diffs: DataFrame, recorded: DataFrame,
                     max_attempts: int = ANALYSIS_MAX_ATTEMPTS, strict: bool = True,
                     mode: str = "responses"):
    """Returns (notes, status, failed) from recorded responses (prompt_id, attempt, raw)."""
    prompts = prompts_for(batched, diffs)
    responses = md.replay(prompts.select("batch_id", "n_items", "prompt_id"),
                          recorded.select("prompt_id", "attempt", "raw"))
    items, rejects = va.pair_items(prompts, parsed(responses, mode))
    status = va.attempt_status(items, rejects)
    accepted, failed = va.accept_attempts(status, max_attempts, prompts)
    if strict:
        va.require_all(failed)
    notes = va.analysis_notes(batched, items, accepted)
    return notes, status, failed


def analyze_batches(batched: DataFrame, diffs: DataFrame, caller: Callable[[str, str], str],
                    system: str, max_attempts: int = ANALYSIS_MAX_ATTEMPTS,
                    mode: str = "responses", partitions: int | None = None,
                    strict: bool = True, journal: str | None = None) -> tuple[DataFrame, DataFrame]:
    """J1 with retries: attempt k calls the model only for batches still without a valid
    attempt. Each pass is checkpointed (model output is not recomputable).

    Returns (notes, failed (batch_id, attempts, reason)). In strict mode a failed batch raises. Else only calls that
    raised in the last attempt do: they may succeed another time, an invalid answer is the batch's own fault."""
    if max_attempts < 1:
        raise ValueError("max_attempts must be at least 1")
    prompts = prompts_for(batched, diffs).checkpoint(eager=True)
    pending = prompts
    all_items, all_status = None, None
    for attempt in range(1, max_attempts + 1):
        raw = md.annotate(pending, caller, system, attempt=attempt, partitions=partitions, journal=journal)
        responses = raw.join(prompts.select("prompt_id", "batch_id"), "prompt_id")
        items, rejects = va.pair_items(prompts, parsed(responses, mode))
        status = va.attempt_status(items, rejects).checkpoint(eager=True)
        all_items = items if all_items is None else all_items.unionByName(items)
        all_status = status if all_status is None else all_status.unionByName(status)
        done = all_status.where(F.col("valid")).select("batch_id").distinct()
        pending = prompts.join(done, "batch_id", "left_anti")
        if pending.limit(1).count() == 0:
            break
    accepted, failed = va.accept_attempts(all_status, max_attempts, prompts)
    if strict:
        va.require_all(failed)
    elif lost := raw.where("call_error is not null").join(pending, "prompt_id", "left_semi").limit(1).collect():
        raise RuntimeError(f"the model could not be called: {lost[0]['call_error']}")
    return va.analysis_notes(batched, all_items, accepted), failed


def analyze_with_caller(batched: DataFrame, diffs: DataFrame, caller: Callable[[str, str], str],
                        system: str, max_attempts: int = ANALYSIS_MAX_ATTEMPTS,
                        mode: str = "responses", partitions: int | None = None) -> DataFrame:
    """The notes of ``analyze_batches`` in strict mode."""
    return analyze_batches(batched, diffs, caller, system, max_attempts, mode, partitions)[0]
