"""The flagship job: which guidance is active per repository?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmine.functions.notes import note_content, note_id
from feedmine.operators.curate import curate
from feedmine.sources import testdata as fx


def active_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = curate(fx.notes(spark, sf_dir))
    return active.select(
        note_id().alias("id"), "repo", "pr_number", "github_comment_id", "category",
        "severity", "reviewer", F.coalesce("merged_at", F.lit("")).alias("merged_at"),
        note_content().alias("content"))
