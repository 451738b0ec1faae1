"""Prompt assembly: thread text (H3), distinct PR diffs per batch (D1), batch
prompt (H4) and architecture prompt (H5).

Batches hold at most ``ANALYSIS_BATCH_SIZE`` rows, so the ``collect_list`` per
batch is bounded. Diffs never ride along in the feedback rows: D1 picks the
distinct (repo, PR) pairs per batch and only those join the diff table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def thread_prompt(idx: str = "pos") -> Column:
    """H3: the text of one feedback item at 0-based position ``idx`` of its batch."""
    state = F.when(_known(F.col("review_state")),
                   F.concat(F.lit("  (review_state: "), F.col("review_state"), F.lit(")"))
                   ).otherwise(F.lit(""))
    head = F.array(
        F.concat(F.lit("--- Comment "), F.col(idx).cast("string"), F.lit(" ---")),
        F.concat(F.lit("Repo: "), F.col("repo"), F.lit("  PR #"), F.col("pr_number").cast("string"),
                 F.lit(": "), F.coalesce("pr_title", F.lit(""))),
        F.concat(F.lit("Type: "), F.col("comment_type"), state),
        F.when(_known(F.col("file_path")), F.concat(F.lit("File: "), F.col("file_path"))),
        F.when(_known(F.col("diff_hunk")), F.concat(F.lit("Diff hunk:\n"), F.col("diff_hunk"))),
        F.concat(F.lit("Trusted reviewer: "), F.coalesce("reviewer", F.lit(""))),
        F.concat(F.lit("Root comment: "), F.coalesce("body", F.lit(""))),
    )
    replies = F.transform(F.coalesce("replies", F.array()), lambda r: F.concat(
        F.lit("Reply by "), F.coalesce(r["author"], F.lit("")), F.lit(": "),
        F.coalesce(r["body"], F.lit(""))))
    return F.array_join(F.concat(head, replies), "\n")  # array_join skips the null lines


def distinct_pr_diffs(batched: DataFrame, diffs: DataFrame) -> DataFrame:
    """Each (repo, PR) of a batch once, at its first position, with its diff.

    Unmerged PRs carry an empty diff (their section is still emitted).
    """
    firsts = batched.groupBy("batch_id", "repo", "pr_number").agg(F.min("pos").alias("first_pos"))
    d = diffs.select("repo", "pr_number", "final_diff")
    out = firsts.join(d, ["repo", "pr_number"], "left")
    return out.withColumn("final_diff", F.coalesce("final_diff", F.lit("")))


def batch_prompts(batched: DataFrame, diffs: DataFrame) -> DataFrame:
    """H4: one prompt per batch: thread texts, then one diff section per distinct PR
    in first-appearance order, blank-line separated, then the count sentence.

    ``batched`` has (batch_id, pos, feedback fields); ``diffs`` (repo, pr_number,
    final_diff), already '' for unmerged PRs. Returns (batch_id, n_items, prompt).
    """
    texts = batched.select("batch_id", "pos", thread_prompt("pos").alias("text")) \
        .groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_t"))
    secs = distinct_pr_diffs(batched, diffs).select(
        "batch_id", "first_pos",
        F.concat(F.lit("--- Final merged diff for "), F.col("repo"), F.lit(" PR #"),
                 F.col("pr_number").cast("string"), F.lit(" ---\n"), F.col("final_diff")).alias("sec")) \
        .groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("first_pos", "sec"))).alias("_d"))
    j = texts.join(secs, "batch_id")
    n = F.size("_t")
    body = F.array_join(F.concat(F.transform("_t", lambda x: x["text"]),
                                 F.transform("_d", lambda x: x["sec"])), "\n\n")
    prompt = F.concat(body, F.lit("\n\nThere are "), n.cast("string"), F.lit(" comments above. Return exactly "),
                      n.cast("string"), F.lit(" items in order."))
    return j.select("batch_id", n.cast("long").alias("n_items"), prompt.alias("prompt"))


def architecture_prompts(evidence: DataFrame, repo: Column | None = None) -> DataFrame:
    """H5: one prompt per merged PR; the repo comes from the argument column, else from
    the PR document's base repository, else the row is rejected (``reason``)."""
    r = repo if repo is not None else F.col("repo")
    if "base_repo" in evidence.columns:
        r = F.coalesce(r, F.col("base_repo"))
    prompt = F.concat(
        F.lit("Repository: "), r, F.lit("\nPR #"), F.col("pr_number").cast("string"), F.lit(": "),
        F.coalesce("title", F.lit("")), F.lit("\nDescription:\n"), F.coalesce("body", F.lit("")),
        F.lit("\n\nFinal merged diff:\n"), F.coalesce("final_diff", F.lit("")))
    return evidence.select(
        "*", F.when(r.isNull() | (r == ""), F.lit(None)).otherwise(prompt).alias("prompt"),
        F.when(r.isNull() | (r == ""), F.lit("no repository for the assessment"))
        .alias("reason"))


def prompt_id(prompt: Column) -> Column:
    """Key of a recorded response (J2): SHA-256 of the prompt text."""
    return F.sha2(prompt, 256)
