"""Recorded model responses for the analysis path (the `replay` fixture).

Built from all three kinds of feedback in E1 order, batched by 8.
Per batch b: attempt 1 is one item short when b mod 5 = 0 and carries severity
'critical' when b mod 5 = 2, attempt 2 is then valid; when b mod 8 = 6 no attempt
of three is valid (short, critical, blank). Architecture assessments are built
per merged PR. Everything is derived from the tables, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedmine.operators import feedback as fb
from feedmine.operators.batching import batch_prompts, prompt_id
from feedmine.operators.ordering import assign_batches, with_ordinal
from feedmine.schemas import CATEGORIES, SEVERITIES
from feedmine.sources import testdata as fx


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def batched_roots(spark: SparkSession, d: str) -> DataFrame:
    reviewers = fb.normalize_reviewers(fx.TRUSTED_REVIEWERS, spark)[0]
    f = fb.normalize_feedback(fx.threads(spark, d), fx.reviews(spark, d), fx.issue_comments(spark, d),
                              fx.prs(spark, d), reviewers)
    f = f.withColumn("repo_ord", F.substring("repo", 6, 10).cast("int"))
    return assign_batches(with_ordinal(f, fb.feedback_order()), 8)


def envelope(text: Column) -> Column:
    """A responses-mode envelope: a reasoning item, then a message whose text is split
    into two ``output_text`` parts around a refusal part."""
    part = lambda t, s: F.struct(F.lit(t).alias("type"), s.alias("text"))
    msg = F.struct(F.lit("message").alias("type"), F.array(
        part("output_text", F.substring(text, 1, 10)),
        part("refusal", F.lit("ignored")),
        part("output_text", F.expr("substring(_text, 11)"))).alias("content"))
    reasoning = F.struct(F.lit("reasoning").alias("type"),
                         F.array().cast("array<struct<type:string,text:string>>").alias("content"))
    return F.to_json(F.struct(F.array(reasoning, msg).alias("output")))


def item_struct(kind: Column) -> Column:
    o, g = F.col("ordinal"), F.col("github_comment_id").cast("string")
    cat = _pick(CATEGORIES, o % 13)
    inc = (o % 4 != 0) & (o % 5 != 0)
    sev = F.when((kind == "critical") & (F.col("pos") == 0), F.lit("critical")).otherwise(
        _pick(SEVERITIES, o % 3))
    return F.struct(
        cat.alias("category"),
        F.concat(F.lit("issue "), g).alias("original_issue"),
        F.concat(F.lit("change "), g).alias("requested_change"),
        F.concat(F.lit("rationale "), g).alias("rationale"),
        sev.alias("severity"),
        (o % 4 != 0).alias("implemented"),
        inc.alias("include_in_vector_store"),
        F.concat(F.lit("selection "), g).alias("selection_rationale"),
        F.when(inc, F.concat(F.lit("example "), g)).otherwise(F.lit("")).alias("implementation_example"),
        (cat == "architecture").alias("architecture_change"),
        ((cat == "architecture") & (o % 2 == 0)).alias("supersedes_prior_architecture"),
    )


def recorded_responses(spark: SparkSession, d: str, batched: DataFrame | None = None) -> DataFrame:
    """(prompt_id, batch_id, attempt, raw) for every attempt the run makes."""
    batched = batched if batched is not None else batched_roots(spark, d)
    b = F.col("batch_id")
    n_att = F.when(b % 8 == 6, 3).when((b % 5 == 0) | (b % 5 == 2), 2).otherwise(1)
    rows = batched.withColumn("attempt", F.explode(F.sequence(F.lit(1), n_att)))
    a = F.col("attempt")
    kind = (F.when(b % 8 == 6, F.when(a == 1, "short").when(a == 2, "critical").otherwise("blank"))
            .when((b % 5 == 0) & (a == 1), "short")
            .when((b % 5 == 2) & (a == 1), "critical").otherwise("ok"))
    rows = rows.withColumn("kind", kind)
    last = F.max("pos").over(Window.partitionBy("batch_id"))  # a batch holds at most 8 rows
    rows = rows.withColumn("_last", last).where(~((F.col("kind") == "short") & (F.col("pos") == F.col("_last"))))
    per = rows.groupBy("batch_id", "attempt", "kind").agg(
        F.array_sort(F.collect_list(F.struct("pos", item_struct(F.col("kind")).alias("item")))).alias("_i"))
    text = F.when(F.col("kind") == "blank", F.lit("   ")).otherwise(
        F.to_json(F.struct(F.transform("_i", lambda x: x["item"]).alias("items"))))
    per = per.withColumn("_text", text)
    prompts = batch_prompts(batched, fx.pr_diffs(spark, d)).select("batch_id", prompt_id(F.col("prompt")).alias("prompt_id"))
    return per.join(prompts, "batch_id").select("prompt_id", "batch_id", "attempt",
                                                envelope(F.col("_text")).alias("raw"))


def architecture_responses(spark: SparkSession, d: str) -> DataFrame:
    """One recorded assessment per merged PR: (repo, pr_number, raw)."""
    p = fx.prs(spark, d).where(F.coalesce(F.col("merged_at"), F.lit("")) != "")
    n = F.col("pr_number")
    change = n % 3 == 0
    imp = n % 4 != 1
    inc = F.when(n % 11 == 3, F.lit(True)).otherwise(change & imp & (n % 5 != 0))
    obj = F.struct(
        change.alias("architecture_change"), imp.alias("implemented"),
        (change & (n % 7 == 0)).alias("supersedes_prior_architecture"),
        inc.alias("include_in_vector_store"),
        F.concat(F.lit("summary "), n.cast("string")).alias("summary"),
        F.when(n % 13 == 4, F.lit("  ")).otherwise(
            F.concat(F.lit("arch rationale "), n.cast("string"))).alias("rationale"))
    return p.select("repo", "pr_number", F.to_json(obj).alias("_text")).select(
        "repo", "pr_number", envelope(F.col("_text")).alias("raw"))
