"""The two jobs that keep a review history: the batch job, which builds it, and the mining step, which
adds merged PRs to it.

Both end in one committed snapshot (A8) of the tables ``raw_comments``, ``notes_all`` (batch job only),
``notes`` (the active ones), ``vectors`` and ``pending_prs``; a run that fails before its commit leaves the last
one as it was. The model and the embedder are injected (``Model``): functions that Spark calls on
the executors, so both jobs only arrange joins, unions and writes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmine.functions.notes import note_content, note_id
from feedmine.operators import batching as bt
from feedmine.operators import curate as cu
from feedmine.operators import feedback as fb
from feedmine.operators import model as md
from feedmine.operators import rollup as ru
from feedmine.operators import validate as va
from feedmine.operators import vectors as vx
from feedmine.operators.ordering import assign_batches, with_ordinal
from feedmine.plans.analysis import analyze_batches, parsed
from feedmine.plans.mining import mine
from feedmine.schemas import MAX_FEEDBACK_PER_PR, PENDING, VECTOR
from feedmine.session import materialize
from feedmine.sources import snapshot as snap
from feedmine.sources.tables import check_evidence

BATCH_SIZE = 8


@dataclass
class Model:
    """What a user injects: ``annotate`` and ``assess`` (system, prompt) -> response, ``embed`` texts -> vectors; ``journal``: a
    shared folder for the answers of the first two, so that a job started again doesn't ask twice."""
    annotate: Callable[[str, str], str]
    assess: Callable[[str, str], str]
    embed: Callable[[list[str]], list[list[float]]]
    annotate_system: str = "system"
    assess_system: str = "system"
    journal: str | None = None


def assess_with_caller(evidence: DataFrame, caller: Callable[[str, str], str], system: str,
                       strict: bool = True, journal: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One call per merged PR, not tried again. Returns (notes, rejects (repo, pr_number, reason)).

    In strict mode any PR without a valid assessment fails the job. Else only a call that raised does."""
    prompts = materialize(bt.architecture_prompts(evidence).withColumn("prompt_id", bt.prompt_id(F.col("prompt"))))
    unasked = prompts.where("reason is not null").select("repo", "pr_number", "reason")
    if strict and (bad := unasked.limit(1).collect()):
        raise ValueError(f"pull request {bad[0]['pr_number']}: {bad[0]['reason']}")
    asked = prompts.where("reason is null")
    raw = md.annotate(asked, caller, system, journal=journal)
    if not strict and (lost := raw.where("call_error is not null").limit(1).collect()):
        raise RuntimeError(f"the model could not be called: {lost[0]['call_error']}")
    obj, err = md.response_object(F.col("raw"))
    responses = materialize(raw.join(asked.select("prompt_id", "repo", "pr_number"), "prompt_id")
                            .select("repo", "pr_number", obj.alias("obj"), F.coalesce("call_error", err).alias("error")))
    # The kept prompts have all of the evidence, which would else be joined again for the notes and for the rejects.
    notes, rejects = va.architecture_notes(prompts.select(*(c for c in evidence.columns if c != "final_diff")), responses)
    rejects = rejects.select("repo", "pr_number", "reason")
    if strict and (bad := rejects.limit(1).collect()):
        raise RuntimeError(f"{bad[0]['repo']}#{bad[0]['pr_number']}: {bad[0]['reason']}")
    return notes, rejects.unionByName(unasked)


def embedded(notes: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """``notes`` with ``embedding``: each distinct content goes to ``embed`` once, in Arrow batches."""
    keyed = notes.withColumn("_text", note_content()).withColumn("_text_id", F.sha2("_text", 256))
    if blank := keyed.where(F.trim("_text") == "").limit(1).collect():
        raise ValueError(f"note {blank[0]['github_comment_id']} has no text to embed")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = embed(pdf["_text"].tolist())
            if len(vectors) != len(pdf):
                raise ValueError(f"expected {len(pdf)} vectors, got {len(vectors)}")
            yield pd.DataFrame({"_text_id": pdf["_text_id"], "embedding": vectors})
    tasks = int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed.select("_text_id", "_text").dropDuplicates(["_text_id"]).repartition(tasks, "_text_id")
    vectors = materialize(texts.mapInPandas(run, "_text_id string, embedding array<float>"))
    return keyed.join(vectors, "_text_id").drop("_text", "_text_id")


def analysed(feedback: DataFrame, evidence: DataFrame, model: Model, first_ordinal: int = 0,
             strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(notes, rejects (repo, pr_number, reason)): the notes on all feedback (with ``ordinal``), then those on the merged
    PRs; ordinals go on from the first.

    A merged PR with a missing, blank or oversize diff (B7) raises before any call of the model, and any answer that isn't
    valid raises too. Unless ``strict``: then such PRs are rejects, and so is every PR with a comment in a prompt without a
    valid answer; ``notes`` may still hold notes of rejected PRs."""
    evidence, rejects = check_evidence(evidence, strict)
    rejects = rejects.select("repo", "pr_number", "reason")
    diffs = evidence.select("repo", "pr_number", "final_diff")
    # Batches need ordinals without gaps; only numbers are sorted for that.
    dense = with_ordinal(feedback.select(F.col("ordinal").alias("_given")), ["_given"])
    feedback = feedback.withColumnRenamed("ordinal", "_given").join(dense, "_given").drop("_given")
    batched = materialize(assign_batches(feedback, BATCH_SIZE))
    if n := batched.count():
        comments, failed = analyze_batches(batched, diffs, model.annotate, model.annotate_system, strict=strict,
                                           journal=model.journal)
        comments = va.note_columns(comments)
        rejects = rejects.unionByName(batched.join(failed, "batch_id").select("repo", "pr_number", "reason"))
    order = with_ordinal(evidence.select("merged_at", "repo", "pr_number"), ["merged_at", "repo", "pr_number"])
    evidence = evidence.drop("ordinal").join(order.drop("merged_at"), ["repo", "pr_number"])
    arch, unfit = assess_with_caller(evidence, model.assess, model.assess_system, strict, model.journal)
    arch = va.note_columns(arch).withColumn("ordinal", F.col("ordinal") + n)
    both = cu.all_notes(comments, arch).drop("_kind") if n else arch
    notes = materialize(both.withColumn("ordinal", (F.col("ordinal") + first_ordinal).cast("long")))
    return notes, rejects.unionByName(unfit).groupBy("repo", "pr_number").agg(F.min("reason").alias("reason"))


def following_ordinal(notes: DataFrame, first: int = 0) -> int:
    """The ordinal after all of ``notes``."""
    last = notes.agg(F.max("ordinal")).first()[0]
    return first if last is None else max(first, int(last) + 1)


def checklist(active: DataFrame) -> DataFrame:
    """The lines of the checklist document in order: one per band (D3)."""
    one_line = F.trim(F.regexp_replace("instruction", r"(?U)\s+", " "))
    return ru.skill_bands(active).orderBy("category", "first_ordinal").select(
        F.concat(F.lit("- ["), F.col("category"), F.lit("] "), one_line, F.lit(" (support "),
                 F.col("support").cast("string"), F.lit(")")).alias("text"))


def batch_job(spark: SparkSession, root: str, feedback: DataFrame, evidence: DataFrame, model: Model,
              repos: list[str], resume: bool = False, writer: str | None = None) -> int:
    """Feedback of merged PRs (with a unique ``ordinal``) and merged-PR evidence -> the history, indexed and summed up.

    Analyse, curate, replace the index rows of ``repos`` (K3), write the report of all notes and the
    checklist of the active ones, commit. ``resume`` takes the notes of the committed snapshot instead of
    analysing again (A9). A named ``writer`` claims the version (A8). The run's counters (D5: comments, notes, selected, active, indexed) are
    committed with it (``snapshot.read_counters``). Returns the committed version.
    """
    snap.require_evidence(feedback, evidence)
    notes = snap.run_stage(spark, root, ["notes_all"], lambda: {"notes_all": analysed(feedback, evidence, model)[0]}, resume)["notes_all"]
    active = materialize(cu.curate(notes))
    stored = (snap.read_snapshot(spark, root, "vectors") if snap.latest_version(spark, root) is not None
              else spark.createDataFrame([], VECTOR))
    index = materialize(vx.replace_vectors(stored, embedded(active, model.embed), repos))
    version = (snap.latest_version(spark, root) or 0) + 1
    ru.write_report(ru.notes_report(notes), f"{root}/report/version={version}")
    snap.write_skill(checklist(active), f"{root}/skill/version={version}")
    return snap.publish_snapshot(spark, root, {
        "raw_comments": feedback, "notes_all": notes, "notes": active, "vectors": index,
        "pending_prs": spark.createDataFrame([], PENDING)}, version=version, next_ordinal=following_ordinal(notes), writer=writer,
        counters={"notes_all": {"selected": F.count_if(cu.is_selected())}})


def mine_step(spark: SparkSession, root: str, keys: DataFrame, version: int, feedback: DataFrame, evidence: DataFrame,
              model: Model, feedback_cap: int = MAX_FEEDBACK_PER_PR, writer: str | None = None) -> DataFrame:
    """One step of I5: the merged PRs of ``keys`` (repo, pr_number) are analysed and enter the history as ``version``.

    ``feedback`` (with ``ordinal``) and ``evidence`` are those of the keys' PRs. The state is read and written for the
    keys' repos only. PRs are refused one by one and change nothing, while the others go on: those with more than
    ``feedback_cap`` items, with a missing, blank or oversize diff, or with an answer of the model that stays invalid. A call of the
    model that raises fails the step, which can be run again.
    New notes take ordinals after all that the history ever gave out, whatever its repos; the commit holds the next one.
    A replay with the same ``version`` reads the same input and writes the same output. Several PRs are curated
    together, and their comments may share a prompt. Returns the refused (repo, pr_number, reason).
    """
    on = ["repo", "pr_number"]
    wanted = materialize(keys.select(*on).distinct())  # read by every step below
    feedback, evidence = (x.join(wanted, on, "left_semi") for x in (feedback, evidence))
    many = fb.check_feedback_cap(feedback, feedback_cap).select(
        *on, F.concat(F.col("n").cast("string"), F.lit(f" feedback items; at most {feedback_cap} are taken")).alias("reason"))
    _, unusable = check_evidence(evidence, strict=False)
    refused = materialize(many.unionByName(unusable.select(*on, "reason")))
    asked = materialize(wanted.join(refused, on, "left_anti"))
    before = version - 1
    first = snap.committed_ordinal(spark, root, before)
    if first is None:  # committed before commits held it
        first = following_ordinal(snap.read_snapshot(spark, root, "notes", before))
    found, unfit = analysed(feedback.join(asked, on, "left_semi"), evidence.join(asked, on, "left_semi"), model, first, strict=False)
    refused = materialize(refused.unionByName(unfit).groupBy(*on).agg(F.min("reason").alias("reason")))
    keys = materialize(wanted.join(refused, on, "left_anti"))
    repos = materialize(keys.select("repo").distinct())

    def state(name: str) -> DataFrame:
        return snap.read_snapshot(spark, root, name, before, repos=repos)
    current = feedback.join(keys, on, "left_semi")
    notes = found.join(keys, on, "left_semi")
    result = mine(state("notes"), notes, keys)
    index = vx.delete_vectors(state("vectors"), result.removed)
    index = vx.save_vectors(index, embedded(result.current, model.embed))
    tables = {"raw_comments": cu.replace_slice(state("raw_comments"), current, keys), "notes": result.active, "vectors": index,
              "pending_prs": state("pending_prs").join(keys, on, "left_anti")}
    snap.publish_snapshot(spark, root, tables, version=version, touched=dict.fromkeys(tables, repos),
                          next_ordinal=following_ordinal(found, first), writer=writer)
    # Like the model's summary, the checklist is made from all active notes.
    snap.write_skill(checklist(snap.read_snapshot(spark, root, "notes", version)), f"{root}/skill/version={version}")
    return refused
