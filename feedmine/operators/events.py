"""Webhook deliveries as table operators: envelope decoding (H8), signature check
(H7), payload fields (H9), routing (C5), job predicate (B12), completed receipts
(C6), queue sink (A10) and the transient-failure classifier (B13).

Routing is an equi join with a 15-row rule table (a fixed literal, so broadcast
is safe). All checks are native expressions; nothing leaves the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmine.functions.hmac import verify_signature
from feedmine.functions.text import is_blank
from feedmine.schemas import TRANSIENT_ERROR_MARKERS

# ---- fixed values: routing rules -------------------------------------------------
REVIEW_ACTIONS = ["opened", "reopened", "synchronize", "ready_for_review"]
MINING_PULL_REQUEST_ACTIONS = ["closed", "edited"]
HISTORY_EVENTS = {
    "pull_request_review": ["submitted", "edited", "dismissed"],
    "pull_request_review_comment": ["created", "edited", "deleted"],
    "issue_comment": ["created", "edited", "deleted"],
}
WORK_TYPES = ["review", "mining"]


def route_rules(spark: SparkSession) -> DataFrame:
    """(event, action, work_type, needs_pr_link): 15 rows."""
    rows = [("pull_request", a, "review", False) for a in REVIEW_ACTIONS]
    rows += [("pull_request", a, "mining", False) for a in MINING_PULL_REQUEST_ACTIONS]
    for ev, actions in HISTORY_EVENTS.items():
        rows += [(ev, a, "mining", ev == "issue_comment") for a in actions]
    return spark.createDataFrame(rows, "event string, action string, work_type string, needs_pr_link boolean")


# ---- variant helpers ------------------------------------------------------------------
def vget(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def truthy(v: Column, t: Column | None = None) -> Column:
    """Python truthiness of a JSON value; a missing value is false.

    ``t`` is the value's ``schema_of_variant`` when already computed as a column.
    """
    t = t if t is not None else F.schema_of_variant(v)
    numeric = t.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)")
    return F.coalesce(
        F.when(v.isNull() | (t == "VOID"), F.lit(False))
         .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
         .when(numeric, F.try_variant_get(v, "$", "double") != 0)
         .when(t == "STRING", F.try_variant_get(v, "$", "string") != "")
         .when(t.startswith("OBJECT"), t != "OBJECT<>")
         .when(t.startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>")) > 0),
        F.lit(False))


def first_truthy(*vs: Column) -> Column:
    """Python's ``a or b or c``: the first truthy value, else the last one as is."""
    expr = vs[-1]
    for v in reversed(vs[:-1]):
        expr = F.when(truthy(v), v).otherwise(expr)
    return expr


# ---- H8 ------------------------------------------------------------------------------
def decode_envelope(envelopes: DataFrame) -> DataFrame:
    """Lower-case header names (a later duplicate wins: needs
    ``spark.sql.mapKeyDedupPolicy=LAST_WIN``), decode the body to bytes."""
    headers = F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")),
                               lambda k, v: F.lower(k))
    body = F.coalesce(F.col("body"), F.lit(""))
    raw = F.when(F.coalesce("isBase64Encoded", F.lit(False)),
                 F.try_to_binary(body, F.lit("base64"))).otherwise(F.encode(body, "UTF-8"))
    return envelopes.withColumn("h", headers).withColumn("body_bytes", raw)


# ---- H9 + C5 -------------------------------------------------------------------------
def extract_job(decoded: DataFrame, secret: str | None, rules: DataFrame | None = None) -> DataFrame:
    """Signature (401), then delivery id, JSON, rule, repository and number (400),
    else 202 with a job when a rule matched.

    Adds: status, error, work_type, event, action, repo, pr_number, delivery_id.
    """
    spark = decoded.sparkSession
    rules = F.broadcast(rules if rules is not None else route_rules(spark))
    h = F.col("h")
    delivery = F.coalesce(h["x-github-delivery"], F.lit(""))
    event = F.coalesce(h["x-github-event"], F.lit(""))
    sig_ok = verify_signature(secret, F.col("body_bytes"), h["x-hub-signature-256"])
    payload = F.try_parse_json(F.try_validate_utf8(F.col("body_bytes").cast("string")))
    staged = decoded.select(
        "*", delivery.alias("delivery_id"), event.alias("event"), sig_ok.alias("_sig"),
        payload.alias("_p"))
    staged = staged.withColumn("action", F.try_variant_get("_p", "$.action", "string"))
    j = staged.join(rules.withColumnRenamed("event", "_re").withColumnRenamed("action", "_ra"),
                    (F.col("event") == F.col("_re")) & (F.col("action") == F.col("_ra")), "left")
    # Staged projections: each variant lookup is computed once per row (the optimizer
    # does not merge projections whose expensive columns are referenced twice).
    p = F.col("_p")
    base = [c for c in j.columns if c not in ("_re", "_ra")]
    j = j.select(*base,
                 vget(p, "$.pull_request.number").alias("_n1"), vget(p, "$.issue.number").alias("_n2"),
                 vget(p, "$.number").alias("_n3"), vget(p, "$.issue.pull_request").alias("_link"),
                 F.try_variant_get(p, "$.repository.full_name", "string").alias("_repo"),
                 F.coalesce(F.schema_of_variant(p).startswith("OBJECT"), F.lit(False)).alias("_is_obj"))
    j = j.select("*", *[F.schema_of_variant(F.col(c)).alias(f"_s{c}") for c in ("_n1", "_n2", "_n3", "_link")])
    t1, t2 = truthy(F.col("_n1"), F.col("_s_n1")), truthy(F.col("_n2"), F.col("_s_n2"))
    j = j.select("*", t1.alias("_t1"), t2.alias("_t2"),
                 truthy(F.col("_link"), F.col("_s_link")).alias("_tl"))
    num_t = F.when(F.col("_t1"), F.col("_s_n1")).when(F.col("_t2"), F.col("_s_n2")).otherwise(F.col("_s_n3"))
    num = F.when(F.col("_t1"), F.col("_n1")).when(F.col("_t2"), F.col("_n2")).otherwise(F.col("_n3"))
    link_ok = ~F.coalesce(F.col("needs_pr_link"), F.lit(False)) | F.col("_tl")
    j = j.select("*", (F.col("work_type").isNotNull() & link_ok).alias("_routed"),
                 F.coalesce(num_t == "BIGINT", F.lit(False)).alias("_is_int"),
                 F.try_variant_get(num, "$", "bigint").alias("_num"))
    error = (F.when(~F.col("_sig"), F.lit("invalid webhook signature"))
             .when(F.col("delivery_id") == "", F.lit("GitHub delivery ID is required"))
             .when(p.isNull() | ~F.col("_is_obj"), F.lit("invalid JSON payload"))
             .when(~F.col("_routed"), F.lit(None))
             .when(is_blank(F.col("_repo")) | ~F.col("_is_int"),
                   F.lit("webhook repository and pull request number are required")))
    j = j.select("*", error.alias("_error"))
    status = F.when(~F.col("_sig"), F.lit(401)).when(F.col("_error").isNotNull(), F.lit(400)).otherwise(F.lit(202))
    j = j.select("*", status.alias("_status"))
    job_ok = (F.col("_status") == 202) & F.col("_routed")
    return j.select(
        *[c for c in decoded.columns if c not in ("h", "body_bytes", "delivery_id", "event", "action",
                                                   "status", "error", "work_type", "repo", "pr_number",
                                                   "version")],
        "delivery_id", "event", "action", F.col("_status").alias("status"), F.col("_error").alias("error"),
        F.when(job_ok, F.col("work_type")).alias("work_type"),
        F.when(job_ok, F.col("_repo")).alias("repo"),
        F.when(job_ok, F.col("_num")).alias("pr_number"),
        F.when(job_ok, F.lit(1)).alias("version"))


def route_deliveries(envelopes: DataFrame, secret: str | None) -> DataFrame:
    """I1's batch body: envelopes → (status rows, with a job where one was routed)."""
    return extract_job(decode_envelope(envelopes), secret)


def jobs_of(results: DataFrame) -> DataFrame:
    return results.where(F.col("work_type").isNotNull()).select(
        "version", "delivery_id", "work_type", "event", "action", "repo", "pr_number")


# ---- C6 ------------------------------------------------------------------------------
def pending_jobs(jobs: DataFrame, receipts: DataFrame) -> DataFrame:
    """Jobs whose delivery id has no completed receipt (receipts never expire)."""
    done = receipts.where(F.col("state") == "COMPLETED").select("delivery_id").distinct()
    return jobs.join(done, "delivery_id", "left_anti")


# ---- B12 -----------------------------------------------------------------------------
def valid_jobs(jobs: DataFrame, repo: str, work_types: list[str] | None, receipts: DataFrame) -> DataFrame:
    """Adds ``decision`` (dispatch / skip / fail) and ``reason``, in the reference's order:
    version, delivery id, repository, completed receipt, then work type."""
    allowed = work_types or WORK_TYPES
    done = receipts.where(F.col("state") == "COMPLETED").select(
        "delivery_id", F.lit(True).alias("_done")).distinct()
    j = jobs.join(done, "delivery_id", "left")
    reason = (F.when(~F.coalesce(F.col("version") == 1, F.lit(False)), F.lit("unsupported webhook job version"))
              .when(is_blank(F.col("delivery_id")), F.lit("webhook job delivery ID is required"))
              .when(F.lower(F.coalesce("repo", F.lit(""))) != repo.lower(),
                    F.lit("webhook repository is not configured for this deployment"))
              .when(F.coalesce("_done", F.lit(False)), F.lit(None))
              .when(~F.coalesce(F.col("work_type").isin(allowed), F.lit(False)),
                    F.concat(F.lit("work type '"), F.coalesce("work_type", F.lit("")),
                             F.lit("' is not allowed in this worker"))))
    decision = (F.when(reason.isNotNull(), F.lit("fail"))
                .when(F.coalesce("_done", F.lit(False)), F.lit("skip")).otherwise(F.lit("dispatch")))
    return j.withColumn("decision", decision).withColumn("reason", reason).drop("_done")


# ---- A10 -----------------------------------------------------------------------------
def write_jobs(jobs: DataFrame, root: str, batch_id: int = 0, strict: bool = True) -> DataFrame:
    """One queue (directory) per work type; an unknown type is an error, not dropped.

    A queue holds one folder per batch, which a replay of the batch overwrites. Returns the rejected rows (empty when
    all types are known).
    """
    known = F.col("work_type").isin(WORK_TYPES)
    rejects = jobs.where(~F.coalesce(known, F.lit(False)))
    if strict and rejects.limit(1).count():
        raise ValueError("unsupported webhook work type")
    (jobs.where(known).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("work_type", "batch_id").parquet(root))
    return rejects


# ---- B13 -----------------------------------------------------------------------------
def is_transient(error: Column) -> Column:
    """Retryable iff the lower-cased text contains a marker (note ``eof`` inside words)."""
    pattern = "|".join(re.escape(m) for m in TRANSIENT_ERROR_MARKERS)
    return F.coalesce(F.lower(error).rlike(pattern), F.lit(False))
