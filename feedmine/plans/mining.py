"""Incremental mining (I5) as one DataFrame step, usable from ``foreachBatch``.

State keeps only the active notes. For the mined (repo, PR) slices: slice replacement
(G2), curation of the union with the unchanged notes (B8, C8), the removal set (C7) and
the notes to save. ``streaming.pipeline.mine_batch`` publishes them, state last (A8).
Curation of several PRs in one step happens together; the reference does
them one after another, which differs only when a supersession is withdrawn.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmine.functions.notes import comment_key
from feedmine.operators import curate as cu
from feedmine.session import materialize


@dataclass
class MiningResult:
    active: DataFrame      # the new state notes
    removed: DataFrame     # prior notes whose key is no longer active (delete from the index)
    current: DataFrame     # mined notes that are active (save to the index)


def mine(state_notes: DataFrame, incoming: DataFrame, mined_keys: DataFrame) -> MiningResult:
    keys = mined_keys.select("repo", "pr_number").distinct()
    unchanged = state_notes.join(keys, ["repo", "pr_number"], "left_anti")
    combined = unchanged.unionByName(incoming, allowMissingColumns=True)
    active = materialize(cu.curate(combined))  # read by all three results
    removed = cu.removed_notes(state_notes, active, keys)
    act_keys = active.select(comment_key().alias("_k")).distinct()
    current = incoming.withColumn("_k", comment_key()).join(act_keys, "_k", "left_semi").drop("_k")
    return MiningResult(active, removed, current)
