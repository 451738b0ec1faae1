"""Landed tables: raw feedback (A2), merged-PR evidence (A3), notes (A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedmine.operators.feedback import guard_diffs
from feedmine.schemas import FEEDBACK, NOTE


def merged_evidence(prs: DataFrame, diffs: DataFrame) -> DataFrame:
    """A3: one row per merged PR with its final diff, whether or not it has feedback. A PR without
    a diff row stays, with a null diff, which ``checked_evidence`` refuses."""
    merged = prs.where(F.coalesce(F.col("merged_at"), F.lit("")) != "")
    return merged.join(diffs.select("repo", "pr_number", "final_diff"), ["repo", "pr_number"], "left")


def checked_evidence(prs: DataFrame, diffs: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """A3 behind B7: (evidence, rejects(repo, pr_number, reason)). A missing, blank or oversize diff is
    a reject; in strict mode the first one raises."""
    return check_evidence(merged_evidence(prs, diffs), strict)


def check_evidence(evidence: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """B7 on evidence that is at hand: the pair of ``checked_evidence``."""
    checked = guard_diffs(evidence)
    rejects = checked.where(F.col("reason").isNotNull()).select("repo", "pr_number", "reason")
    if strict and (first := rejects.limit(1).collect()):
        raise ValueError(f"{first[0]['repo']}#{first[0]['pr_number']}: {first[0]['reason']}")
    return checked.where(F.col("reason").isNull()).drop("reason"), rejects


def write_feedback(feedback: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A2: all 17 fields, nested replies included, partitioned by repo."""
    (feedback.select(*[f.name for f in FEEDBACK.fields], "ordinal")
     .write.mode(mode).partitionBy("repo").parquet(path))


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType(list(FEEDBACK.fields) + [T.StructField("ordinal", T.LongType())])
    return spark.read.schema(schema).parquet(path)


def write_notes(notes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A4: 21 fields plus the input ordinal, partitioned by repo.

    Two tables are kept: ``notes_all`` (the batch run stores every note, before
    curation) and ``notes_active`` (what curation keeps).
    """
    (notes.select(*[f.name for f in NOTE.fields], "ordinal")
     .write.mode(mode).partitionBy("repo").parquet(path))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType(list(NOTE.fields) + [T.StructField("ordinal", T.LongType())])
    return spark.read.schema(schema).parquet(path)
