"""Curation: selection (B8), supersession (C8), merge order (F1), compact
projection (B9), removal set (C7), slice replacement (G2), pending set (G3) and
history union (G4).

Supersession looks sequential in the reference (a fold in merge order), but it
has a closed form: an architecture note with a known merge time is dropped iff
some selected note of the same repo with ``supersedes_prior_architecture`` and a
known merge time is strictly later. So one per-repo ``max`` replaces the fold;
the per-repo table has one row per repo; it is counted and broadcast back under a
limit, else joined with salting (no window, no skew even when one repo holds a third
of all notes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmine.functions.notes import comment_key
from feedmine.operators.joins import broadcast_if_small, join_small


def is_selected() -> Column:
    """Implemented and include_in_vector_store, both defaulting to true when absent."""
    return F.coalesce(F.col("implemented"), F.lit(True)) & F.coalesce(F.col("include_in_vector_store"), F.lit(True))


def selected_notes(notes: DataFrame) -> DataFrame:
    """The notes that ``is_selected`` holds for."""
    return notes.where(is_selected())


def _known(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit("")) != ""


def supersession_cutoffs(selected: DataFrame) -> DataFrame:
    """Per repo, the latest merge time of a superseding note (one row per repo)."""
    return (selected
            .where(F.coalesce(F.col("supersedes_prior_architecture"), F.lit(False)) & _known("merged_at"))
            .groupBy("repo").agg(F.max("merged_at").alias("_cutoff")))


def supersede(selected: DataFrame, repo_count_bound: int | None = None) -> DataFrame:
    """C8 on already selected notes: drop superseded architecture notes."""
    cutoffs = supersession_cutoffs(selected)
    if repo_count_bound is not None:
        joined = selected.join(broadcast_if_small(cutoffs, repo_count_bound), "repo", "left")
    else:
        joined = join_small(selected, cutoffs, ["repo"], "left")
    dropped = ((F.col("category") == "architecture") & _known("merged_at")
               & F.col("_cutoff").isNotNull() & (F.col("merged_at") < F.col("_cutoff")))
    return joined.where(~dropped).drop("_cutoff")


def curate(notes: DataFrame, repo_count_bound: int | None = None) -> DataFrame:
    """B8 then C8: the active notes (order is given by ``curated_order``)."""
    return supersede(selected_notes(notes), repo_count_bound)


def merge_order_key(ordinal: str = "ordinal") -> list[Column]:
    """order by (merged_at or '', input ordinal)."""
    return [F.coalesce(F.col("merged_at"), F.lit("")), F.col(ordinal)]


def curated_order(notes: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """F1 as a total sort (a range-partitioned sort, no single partition)."""
    return notes.orderBy(*merge_order_key(ordinal))


def compact_notes(notes: DataFrame) -> DataFrame:
    """The six fields synthesis sees; a missing example becomes ''."""
    return notes.select(
        "category", "severity", "original_issue", "requested_change", "rationale",
        F.coalesce(F.col("implementation_example"), F.lit("")).alias("implementation_example"),
    )


def with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("_key", comment_key())


def removed_notes(prior: DataFrame, active: DataFrame, scope: DataFrame) -> DataFrame:
    """Prior notes of the mined PRs plus prior architecture notes of their repos,
    whose key is no longer active; once per key.

    ``scope`` holds the mined (repo, pr_number) keys.
    """
    of_pr = prior.join(scope.select("repo", "pr_number").distinct(), ["repo", "pr_number"], "left_semi")
    arch = join_small(prior.where(F.col("category") == "architecture"), scope.select("repo").distinct(),
                      ["repo"], "left_semi", salt_col="github_comment_id")
    cand = with_key(of_pr.unionByName(arch))
    act = with_key(active).select("_key").distinct()
    # Keep the first candidate per key (PR notes precede architecture notes).
    gone = cand.join(act, "_key", "left_anti")
    return gone.dropDuplicates(["_key"]).drop("_key")


def replace_slice(table: DataFrame, new: DataFrame, keys: DataFrame,
                  key_cols: tuple[str, ...] = ("repo", "pr_number")) -> DataFrame:
    """Every row of the mined keys leaves, the new rows enter; others untouched."""
    kept = table.join(keys.select(*key_cols).distinct(), list(key_cols), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def update_pending(pending: DataFrame, observations: DataFrame) -> DataFrame:
    """Fold PR observations (repo, pr_number, seq, state, merged_at) into the
    pending set (repo, pr_number, last_seq).

    The latest observation per PR decides: merged → leaves the set and is mined;
    closed unmerged → leaves the set; open → stays or joins. Returns (repo,
    pr_number, last_seq, status) with status 'pending' or 'mine'. Deviation from the
    reference (a named quirk there): the set has no list order, so "changed" is
    decided by membership, not by position.
    """
    latest = observations.groupBy("repo", "pr_number").agg(
        F.max_by(F.struct("state", "merged_at"), "seq").alias("s"), F.max("seq").alias("last_seq"))
    status = (F.when(_known_col(F.col("s.merged_at")), F.lit("mine"))
              .when(F.coalesce(F.col("s.state"), F.lit("open")) == "closed", F.lit(None))
              .otherwise(F.lit("pending")))
    decided = latest.select("repo", "pr_number", F.col("last_seq").cast("long").alias("last_seq"),
                            status.alias("status")).where(F.col("status").isNotNull())
    kept = pending.join(latest.select("repo", "pr_number"), ["repo", "pr_number"], "left_anti").select(
        "repo", "pr_number", F.col("last_seq").cast("long").alias("last_seq"), F.lit("pending").alias("status"))
    return kept.unionByName(decided)


def _known_col(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def all_notes(comment_notes: DataFrame, architecture_notes: DataFrame) -> DataFrame:
    """Comment notes, then architecture notes (kind ordinal 0, then 1)."""
    a = comment_notes.withColumn("_kind", F.lit(0))
    b = architecture_notes.withColumn("_kind", F.lit(1))
    return a.unionByName(b, allowMissingColumns=True)
