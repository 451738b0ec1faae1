"""Model calls: the injected caller (J1), recorded responses (J2), and the
response text / object extraction (H12).

The model's judgement is an input. ``annotate`` runs a user-supplied
``caller(system, prompt) -> raw response JSON`` inside ``mapInPandas``, one call
per distinct prompt, with parallelism = ``partitions`` (the rate limit). Every pass is checkpointed right away: model output is costly and not
reproducible, so it must never be recomputed after an executor is lost; a journal of answers also spares the calls of
a task that is lost midway.
``replay`` is the same contract from a table of recorded responses.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedmine.functions.text import is_blank
from feedmine.operators import journal as jn
from feedmine.session import checkpoint_dir

#: Prompts are long, so a task holds fewer bytes of them at once than Spark's default of 64 MB, each several times.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
#: Answers go back to Spark when they have as many characters, or when their batch of prompts is done: a frame for every group is slow.
ANSWER_CHARS = 4 << 20

RESPONSES_ENVELOPE = T.StructType([
    T.StructField("output", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("content", T.ArrayType(T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("text", T.StringType()),
        ]))),
    ]))),
])
CHAT_ENVELOPE = T.StructType([
    T.StructField("choices", T.ArrayType(T.StructType([
        T.StructField("message", T.StructType([T.StructField("content", T.StringType())])),
    ]))),
])


def response_text(raw: Column, mode: str = "responses") -> Column:
    """H12 (text): responses mode joins the ``output_text`` parts of ``message`` items;
    chat mode takes the first choice's content."""
    if mode == "responses":
        env = F.from_json(raw, RESPONSES_ENVELOPE)
        msgs = F.filter(F.coalesce(env["output"], F.array()), lambda it: it["type"] == "message")
        parts = F.flatten(F.transform(msgs, lambda it: F.coalesce(it["content"], F.array())))
        texts = F.transform(F.filter(parts, lambda p: p["type"] == "output_text"), lambda p: p["text"])
        return F.array_join(texts, "")
    env = F.from_json(raw, CHAT_ENVELOPE)
    return F.element_at(env["choices"], 1)["message"]["content"]


def response_object(raw: Column, mode: str = "responses") -> tuple[Column, Column]:
    """(variant object, error). Blank text, invalid JSON and a non-object are errors."""
    text = response_text(raw, mode)
    v = F.try_parse_json(text)
    err = (F.when(is_blank(text), F.lit("empty model answer"))
           .when(v.isNull(), F.lit("model answer is not JSON"))
           .when(~F.schema_of_variant(v).startswith("OBJECT"),
                 F.lit("model answer is no JSON object")))
    return F.when(err.isNull(), v), err


def replay(prompts: DataFrame, responses: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Attach recorded responses (prompt_id, attempt, raw) to prompts.

    Every prompt stays: one without a recorded response gets attempt 1 with a null ``raw``,
    which H12 turns into an error. A response recorded more than once for an attempt (equal
    prompts) counts once.
    """
    once = responses.groupBy(key, "attempt").agg(F.min("raw").alias("raw"))
    return prompts.join(once, key, "left").withColumn("attempt", F.coalesce("attempt", F.lit(1)))


def annotate(prompts: DataFrame, caller: Callable[[str, str], str], system: str,
             attempt: int = 1, partitions: int | None = None, journal: str | None = None,
             in_flight: int = 1, group: int = 8) -> DataFrame:
    """One model call per distinct prompt → (prompt_id, attempt, raw, call_error).

    ``caller`` must be picklable; it runs on executors, in ``partitions`` tasks (the shuffle
    partitions by default) with ``in_flight`` calls at once in each, so at most their product runs at any time. A call
    that raises is a failed attempt with a null ``raw``: it neither ends the task nor repeats the calls of its
    neighbours. The result is checkpointed.

    With ``journal``, a shared folder, a task notes its answers after every ``group`` calls: restarted, it repeats at most
    one group, and a job started again on that folder asks only what no task has noted. Calls that
    raised aren't noted. An invalid answer is: to have it asked anew under the same attempt, take another folder.
    """
    if in_flight < 1 or group < 1:
        raise ValueError("in_flight and group must be at least 1")
    spark = prompts.sparkSession
    checkpoint_dir(spark)
    tasks = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = prompts.select("prompt_id", "prompt").dropDuplicates(["prompt_id"])
    known = None
    if journal:
        journal = jn.qualified(spark, journal)
        # Kept as it is now: the tasks below add to the folder.
        known = jn.answers(spark, journal, system, attempt).join(src.select("prompt_id"), "prompt_id", "left_semi").checkpoint(eager=True)
        src = src.join(known, "prompt_id", "left_anti")
    src = src.repartition(tasks, "prompt_id")
    run_id = uuid.uuid4().hex

    def call(prompt: str) -> tuple[str | None, str | None]:
        try:
            return caller(system, prompt), None
        except Exception as exc:  # noqa: BLE001 - any failure of the model counts as an attempt
            return None, f"model call failed: {exc}"

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["prompt_id", "attempt", "raw", "call_error"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        notes = jn.TaskJournal(journal, run_id, TaskContext.get().partitionId(), system, attempt) if journal else None
        noted = notes.read() if notes else {}
        with ThreadPoolExecutor(in_flight) as pool:
            for pdf in batches:
                old = pdf["prompt_id"].isin(list(noted))
                if old.any():
                    ids = pdf.loc[old, "prompt_id"]
                    yield pd.DataFrame({"prompt_id": ids, "attempt": attempt, "raw": ids.map(noted), "call_error": None})
                ids, texts = (pdf.loc[~old, c].tolist() for c in ("prompt_id", "prompt"))
                held, chars = [], 0
                for start in range(0, len(ids), group):
                    got = [(key, attempt, *answer) for key, answer in
                           zip(ids[start:start + group], pool.map(call, texts[start:start + group]))]
                    if notes:
                        notes.append(frame([row for row in got if row[3] is None]))
                    held += got
                    chars += sum(len(raw or error or "") for _, _, raw, error in got)
                    if chars >= ANSWER_CHARS or start + group >= len(ids):
                        yield frame(held)
                        held, chars = [], 0

    out = src.mapInPandas(run, "prompt_id string, attempt int, raw string, call_error string")
    if known is not None:
        out = out.unionByName(known.withColumn("call_error", F.lit(None).cast("string")))
    conf = spark.conf
    before = conf.get(BATCH_CONF)
    conf.set(BATCH_CONF, BATCH_BYTES)
    try:
        return out.checkpoint(eager=True)
    finally:
        conf.set(BATCH_CONF, before)
