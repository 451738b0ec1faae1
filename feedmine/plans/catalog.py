"""Registered queries: one per operator of the inventory, each (spark, sf_dir) -> DataFrame.

Each query reads the driver's tables through the adapters of
``feedmine.sources.testdata`` and runs the operator over the whole table.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmine.functions.notes import note_content, note_id
from feedmine.operators import curate as cu
from feedmine.operators.ordering import with_ordinal
from feedmine.schemas import CATEGORIES, SEVERITIES
from feedmine.sources import testdata as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# ---- curation slice -------------------------------------------------------------
@query("b8_selected_notes")
def b8_selected_notes(spark, d):
    return cu.selected_notes(fx.notes(spark, d)).select(
        "repo", "github_comment_id", "category", "implemented", "include_in_vector_store")


@query("c8_supersede")
def c8_supersede(spark, d):
    return cu.curate(fx.notes(spark, d)).select(
        "repo", "github_comment_id", "category", "merged_at", "supersedes_prior_architecture")


@query("f1_curated_order")
def f1_curated_order(spark, d):
    active = cu.curate(fx.notes(spark, d))
    ranked = with_ordinal(active, cu.merge_order_key(), name="merge_rank")
    return ranked.select("repo", "github_comment_id", "merged_at", "merge_rank")


@query("h1_note_id")
def h1_note_id(spark, d):
    return fx.notes(spark, d).select("github_comment_id", note_id().alias("note_id"))


@query("h2_note_content")
def h2_note_content(spark, d):
    return fx.notes(spark, d).select("github_comment_id", note_content().alias("content"))


@query("b9_compact_notes")
def b9_compact_notes(spark, d):
    active = cu.curate(fx.notes(spark, d))
    return active.select("github_comment_id", *cu.compact_notes(active).columns) \
        .withColumn("implementation_example", F.coalesce("implementation_example", F.lit("")))


# ---- vectors --------------------------------------------------------------------------
from feedmine.operators import vectors as vx  # noqa: E402


def _index_out(df: DataFrame) -> DataFrame:
    return df.select("id", "repo", "github_comment_id", "category", "content",
                     F.date_format("merged_at", "yyyy-MM-dd").alias("merged_at"))


def _empty_index(spark):
    from feedmine.schemas import VECTOR
    return spark.createDataFrame([], VECTOR)


@query("k1_save_vectors")
def k1_save_vectors(spark, d):
    existing = fx.vector_notes(spark, d).where(F.col("pr_number") % 2 == 0)
    index = vx.save_vectors(_empty_index(spark), existing)
    return _index_out(vx.save_vectors(index, fx.incoming_vector_notes(spark, d)))


@query("k2_delete_vectors")
def k2_delete_vectors(spark, d):
    notes = fx.vector_notes(spark, d)
    index = vx.save_vectors(_empty_index(spark), notes)
    gone = notes.where(F.col("pr_number") % 5 == 0)
    missing = gone.withColumn("github_comment_id", F.col("github_comment_id") + 1_000_000)
    return _index_out(vx.delete_vectors(index, gone.unionByName(missing)))


@query("k3_replace_vectors")
def k3_replace_vectors(spark, d):
    notes = fx.vector_notes(spark, d)
    index = vx.save_vectors(_empty_index(spark), notes.where(F.col("pr_number") % 2 == 0))
    new = notes.where(F.col("pr_number") % 3 == 0)
    return _index_out(vx.replace_vectors(index, new, ["org/r1", "org/r2"]))


@query("k3_delta_index")
def k3_delta_index(spark, d):
    """The index as a merge-on-read table: a base, then rows saved, ids deleted, two repos replaced, and a new base."""
    from feedmine.sources import deltas as dl
    notes = fx.vector_notes(spark, d)
    rows = vx.save_vectors(_empty_index(spark), notes)
    third = rows.where(F.col("pr_number") % 3 == 0)
    root = _scratch(spark, "k3")
    dl.create(spark, root, rows.where(F.col("pr_number") % 2 == 0), ["id"])
    dl.apply(spark, root, "save", third)
    dl.apply(spark, root, "delete", gone=[rows.where(F.col("pr_number") % 5 == 0).select("id")])
    repos = spark.createDataFrame([("org/r1",), ("org/r2",)], "repo string")
    dl.apply(spark, root, "replace", third, [repos])
    dl.compact(spark, root, "compact", ["repo"])
    return _index_out(dl.read(spark, root))


@query("k4_search")
def k4_search(spark, d):
    notes = fx.vector_notes(spark, d)
    index = vx.save_vectors(_empty_index(spark), notes)
    q = fx.vector_queries(spark, d).where(F.col("query_id") == 0).first()  # one query row
    res = vx.search(index, q["query_vector"], q["repo"], limit=5, reviewers=["u0", "u1"],
                    query_text=q["query_text"])
    return res.select("id", "repo", "pr_number", "category", "severity", "rank")


@query("k5_search_many")
def k5_search_many(spark, d):
    index = vx.save_vectors(_empty_index(spark), fx.vector_notes(spark, d))
    res = vx.search_many(index, fx.vector_queries(spark, d), k=8)
    return res.select("query_id", "id", "github_comment_id", "rank")


@query("k5_search_many_salted")
def k5_search_many_salted(spark, d):
    index = vx.save_vectors(_empty_index(spark), fx.vector_notes(spark, d))
    res = vx.search_many(index, fx.vector_queries(spark, d), k=8, salt_buckets=16, broadcast_bytes=0)
    return res.select("query_id", "id", "github_comment_id", "rank")


@query("k6_search_approx")
def k6_search_approx(spark, d):
    index = vx.save_vectors(_empty_index(spark), fx.vector_notes(spark, d))
    return vx.search_approx(index, fx.vector_queries(spark, d), k=8, cells=10, probe=8)


@query("k5_search_stored_cells")
def k5_search_stored_cells(spark, d):
    """K5 over the stored cell index: exact, cells skipped by bounds. A third of the notes is appended, and some are
    written twice, after the build."""
    from feedmine.operators import cells
    index = vx.save_vectors(_empty_index(spark), fx.vector_notes(spark, d))
    root = _scratch(spark, "k5")
    cells.build(index.where("pr_number % 3 <> 0"), root, cells=10)
    cells.upsert(index.where("pr_number % 3 = 0 OR pr_number % 7 = 0"), root, seq=1)
    return cells.search_exact(spark, root, fx.vector_queries(spark, d), k=8).select("query_id", "id", "github_comment_id", "rank")


@query("k6_search_cells")
def k6_search_cells(spark, d):
    """K6 over the stored cell index; approximate. tests/test_cells.py measures its recall at these parameters."""
    from feedmine.operators import cells
    index = vx.save_vectors(_empty_index(spark), fx.vector_notes(spark, d))
    root = _scratch(spark, "k6")
    cells.build(index, root, cells=10)
    return cells.search_cells(spark, root, fx.vector_queries(spark, d), k=8, probe=8).select("query_id", "id", "rank", "repo", "github_comment_id")


@query("c4_align_embeddings")
def c4_align_embeddings(spark, d):
    notes = fx.vector_notes(spark, d)
    inputs = notes.select((F.col("pr_number") / 16).cast("long").alias("request_id"),
                          (F.col("pr_number") % 16).alias("pos"), "github_comment_id",
                          note_content().alias("text"))
    e = fx.read(spark, d, "embeddings")
    response = e.where(~(((F.col("vec_id") / 16).cast("long") % 11 == 5) & (F.col("vec_id") % 16 == 0))) \
        .select((F.col("vec_id") / 16).cast("long").alias("request_id"),
                (F.col("vec_id") % 16).alias("index"), "embedding", F.col("vec_id").alias("src_vec_id"))
    aligned, rejects = vx.align_embeddings(inputs, response)
    a = aligned.select("request_id", "pos", "github_comment_id", "src_vec_id",
                       F.lit(None).cast("string").alias("reason"))
    r = rejects.select("request_id", F.lit(None).cast("long").alias("pos"),
                       F.lit(None).cast("long").alias("github_comment_id"),
                       F.lit(None).cast("long").alias("src_vec_id"), "reason")
    return a.unionByName(r)


# ---- feedback -------------------------------------------------------------------------
from feedmine.operators import feedback as fb  # noqa: E402
from feedmine.operators.ordering import assign_batches  # noqa: E402


def _reviewers(spark):
    return fb.normalize_reviewers(fx.TRUSTED_REVIEWERS, spark)[0]


def feedback_table(spark, d, with_replies=True, diffs=None):
    return fb.normalize_feedback(fx.threads(spark, d), fx.reviews(spark, d),
                                 fx.issue_comments(spark, d), fx.prs(spark, d),
                                 _reviewers(spark), diffs=diffs, with_replies=with_replies)


def repo_ord() -> "F.Column":
    """Fixture convention: the configured repo order is the number after 'org/r'."""
    return F.substring("repo", 6, 10).cast("int")


def ordered_feedback(spark, d, with_replies=True, diffs=None):
    f = feedback_table(spark, d, with_replies, diffs).withColumn("repo_ord", repo_ord())
    return with_ordinal(f, fb.feedback_order())


@query("b1_merged_prs")
def b1_merged_prs(spark, d):
    return fb.merged_prs(fx.prs(spark, d), updated_after="1995-06-01").select(
        "repo", "pr_number", "merged_at", "updated_at")


@query("b2_normalize_reviewers")
def b2_normalize_reviewers(spark, d):
    t = fx.threads(spark, d)
    spelled = (F.when(F.col("pr_number") % 3 == 0, F.upper("login"))
               .when(F.col("pr_number") % 3 == 1, F.concat(F.lit("  "), F.col("login"), F.lit(" ")))
               .otherwise(F.col("login")))
    names = t.select(spelled.alias("name"), F.col("id").alias("ordinal"))
    out, _ = fb.normalize_reviewers(names)
    return out


@query("b3_trusted_only")
def b3_trusted_only(spark, d):
    return fb.trusted_only(fx.threads(spark, d), _reviewers(spark)).select("id", "login")


@query("b4_eligible_reviews")
def b4_eligible_reviews(spark, d):
    r = fb.trusted_only(fb.eligible_reviews(fx.reviews(spark, d)), _reviewers(spark))
    return r.select("id", "state", "login")


@query("b5_normalize_feedback")
def b5_normalize_feedback(spark, d):
    f = feedback_table(spark, d)
    return f.select("repo", "pr_number", "github_comment_id", "comment_type", "pr_title", "pr_url",
                    "pr_state", "file_path", "diff_hunk", "review_state", "created_at", "html_url",
                    "reviewer", "body", "merged_at", F.size("replies").cast("long").alias("n_replies"))


@query("b6_pr_state")
def b6_pr_state(spark, d):
    p = fx.prs(spark, d)
    return p.select("repo", "pr_number", fb.pr_state(p).alias("pr_state"))


@query("b7_guard_diffs")
def b7_guard_diffs(spark, d):
    return fb.guard_diffs(fx.diffs(spark, d), fx.DIFF_CAP).select("repo", "pr_number", "reason")


@query("c1_pr_attributes")
def c1_pr_attributes(spark, d):
    f = feedback_table(spark, d, with_replies=False, diffs=fx.pr_diffs(spark, d))
    return f.select("comment_type", "github_comment_id", "pr_title", "pr_url", "pr_state",
                    "merged_at", "final_diff")


@query("c2_attach_replies")
def c2_attach_replies(spark, d):
    t = fx.threads(spark, d)
    roots = fb.trusted_only(t.where(F.col("in_reply_to_id").isNull()), _reviewers(spark))
    rep = fb.attach_replies(t, roots.select("repo", "pr_number", "id"))
    return rep.select("root_id", F.posexplode("replies").alias("reply_pos", "r")).select(
        "root_id", F.col("reply_pos").cast("long").alias("reply_pos"),
        F.col("r.github_comment_id").alias("reply_id"), F.col("r.author").alias("author"))


@query("g1_feedback_union")
def g1_feedback_union(spark, d):
    f = feedback_table(spark, d, with_replies=False)
    return f.groupBy("repo", "pr_number", "comment_type").agg(F.count(F.lit(1)).alias("n"))


@query("e1_with_ordinal")
def e1_with_ordinal(spark, d):
    return ordered_feedback(spark, d, with_replies=False).select(
        "comment_type", "github_comment_id", "ordinal")


@query("e2_assign_batches")
def e2_assign_batches(spark, d):
    b = assign_batches(ordered_feedback(spark, d, with_replies=False), 8)
    return b.select("comment_type", "github_comment_id", "batch_id", "pos")


@query("d2_check_feedback_cap")
def d2_check_feedback_cap(spark, d):
    return fb.check_feedback_cap(feedback_table(spark, d, with_replies=False), fx.REVIEW_FEEDBACK_CAP)


@query("a3_merged_evidence")
def a3_merged_evidence(spark, d):
    from feedmine.sources.tables import merged_evidence
    ev = merged_evidence(fx.prs(spark, d), fx.pr_diffs(spark, d))
    return ev.select("repo", "pr_number", "title", "merged_at",
                     F.length("final_diff").cast("long").alias("diff_chars"))


# ---- annotation -------------------------------------------------------------------------
from feedmine.operators import batching as bt  # noqa: E402
from feedmine.operators import model as md  # noqa: E402
from feedmine.operators import validate as va  # noqa: E402
from feedmine.plans import analysis as an  # noqa: E402
from feedmine.sources import replay_fixture as rf  # noqa: E402


def _replay_state(spark, d):
    batched = rf.batched_roots(spark, d)
    recorded = rf.recorded_responses(spark, d, batched)
    prompts = an.prompts_for(batched, fx.pr_diffs(spark, d))
    responses = md.replay(prompts.select("batch_id", "n_items", "prompt_id"),
                          recorded.select("prompt_id", "attempt", "raw"))
    return batched, prompts, responses


@query("h3_thread_prompt")
def h3_thread_prompt(spark, d):
    b = rf.batched_roots(spark, d)
    return b.select("github_comment_id", "batch_id", "pos", bt.thread_prompt("pos").alias("text"))


@query("d1_distinct_pr_diffs")
def d1_distinct_pr_diffs(spark, d):
    b = rf.batched_roots(spark, d)
    return bt.distinct_pr_diffs(b, fx.pr_diffs(spark, d)).select(
        "batch_id", "repo", "pr_number", "first_pos",
        F.length("final_diff").cast("long").alias("diff_chars"))


@query("h4_batch_prompts")
def h4_batch_prompts(spark, d):
    p = an.prompts_for(rf.batched_roots(spark, d), fx.pr_diffs(spark, d))
    return p.select("batch_id", "n_items", F.col("prompt_id").alias("prompt_sha"),
                    F.length("prompt").cast("long").alias("prompt_chars"))


@query("h5_architecture_prompts")
def h5_architecture_prompts(spark, d):
    from feedmine.sources.tables import checked_evidence
    ev, _ = checked_evidence(fx.prs(spark, d), fx.pr_diffs(spark, d))
    p = bt.architecture_prompts(ev)
    return p.select("repo", "pr_number", bt.prompt_id(F.col("prompt")).alias("prompt_sha"))


@query("j2_replay")
def j2_replay(spark, d):
    _, _, responses = _replay_state(spark, d)
    return responses.select("batch_id", "attempt")


@query("h12_response_object")
def h12_response_object(spark, d):
    _, _, responses = _replay_state(spark, d)
    obj, err = md.response_object(F.col("raw"))
    return responses.select("batch_id", "attempt", obj.isNotNull().alias("is_object"), err.alias("error"))


@query("c3_pair_items")
def c3_pair_items(spark, d):
    _, prompts, responses = _replay_state(spark, d)
    items, rejects = va.pair_items(prompts, an.parsed(responses))
    paired = items.groupBy("batch_id", "attempt").agg(F.count(F.lit(1)).alias("n_paired")) \
        .withColumn("reason", F.lit(None).cast("string"))
    return paired.unionByName(rejects.withColumn("n_paired", F.lit(0).cast("long")))


@query("h10_validate_items")
def h10_validate_items(spark, d):
    _, prompts, responses = _replay_state(spark, d)
    items, _ = va.pair_items(prompts, an.parsed(responses))
    return items.select("batch_id", "attempt", "pos",
                        F.array_join(va.item_errors(F.col("item")), "; ").alias("errors"))


@query("e4_accept_attempts")
def e4_accept_attempts(spark, d):
    _, prompts, responses = _replay_state(spark, d)
    items, rejects = va.pair_items(prompts, an.parsed(responses))
    accepted, failed = va.accept_attempts(va.attempt_status(items, rejects), 3)
    return accepted.select("batch_id", F.col("attempt").cast("int").alias("attempt")).unionByName(
        failed.select("batch_id", F.lit(None).cast("int").alias("attempt")))


@query("j2_replay_notes")
def j2_replay_notes(spark, d):
    batched = rf.batched_roots(spark, d)
    notes, _, _ = an.analyze_recorded(batched, fx.pr_diffs(spark, d),
                                      rf.recorded_responses(spark, d, batched), strict=False)
    return va.note_columns(notes).drop("ordinal")


@query("h11_architecture_notes")
def h11_architecture_notes(spark, d):
    from feedmine.sources.tables import checked_evidence
    ev, _ = checked_evidence(fx.prs(spark, d), fx.pr_diffs(spark, d))
    resp = rf.architecture_responses(spark, d)
    obj, err = md.response_object(F.col("raw"))
    from feedmine.session import materialize
    notes, rejects = va.architecture_notes(
        ev, materialize(resp.select("repo", "pr_number", obj.alias("obj"), err.alias("error"))))
    return notes.select("pr_number", "github_comment_id", "original_body", "original_issue",
                        "rationale", "supersedes_prior_architecture", "merged_at") \
        .withColumn("reason", F.lit(None).cast("string")).unionByName(
        rejects.select("pr_number", F.lit(None).cast("long").alias("github_comment_id"),
                       F.lit(None).cast("string").alias("original_body"),
                       F.lit(None).cast("string").alias("original_issue"),
                       F.lit(None).cast("string").alias("rationale"),
                       F.lit(None).cast("boolean").alias("supersedes_prior_architecture"),
                       F.lit(None).cast("string").alias("merged_at"), "reason"))


# ---- events ----------------------------------------------------------------------------
from feedmine.operators import events as ev  # noqa: E402


def _routed(spark, d):
    return ev.route_deliveries(fx.deliveries(spark, d), fx.WEBHOOK_SECRET)


@query("h8_decode_envelope")
def h8_decode_envelope(spark, d):
    dec = ev.decode_envelope(fx.deliveries(spark, d))
    return dec.select("event_id", "copy", F.col("h")["x-github-delivery"].alias("delivery_id"),
                      F.col("h")["x-github-event"].alias("event"),
                      F.octet_length("body_bytes").cast("long").alias("body_bytes"))


@query("h7_verify_hmac")
def h7_verify_hmac(spark, d):
    from feedmine.functions.hmac import verify_signature
    dec = ev.decode_envelope(fx.deliveries(spark, d))
    return dec.select("event_id", "copy", verify_signature(
        fx.WEBHOOK_SECRET, F.col("body_bytes"), F.col("h")["x-hub-signature-256"]).alias("valid"))


@query("h9_extract_job")
def h9_extract_job(spark, d):
    return _routed(spark, d).select("event_id", "copy", "status", "work_type", "repo", "pr_number")


@query("c5_route_deliveries")
def c5_route_deliveries(spark, d):
    return ev.jobs_of(_routed(spark, d))


@query("c6_pending_jobs")
def c6_pending_jobs(spark, d):
    return ev.pending_jobs(ev.jobs_of(_routed(spark, d)), fx.receipts(spark, d)).select(
        "delivery_id", "work_type", "pr_number")


@query("b12_valid_jobs")
def b12_valid_jobs(spark, d):
    r = _routed(spark, d)
    jobs = ev.jobs_of(r.withColumn("version", F.when(F.col("k") == 99, F.lit(2)).otherwise(F.col("version"))))
    return ev.valid_jobs(jobs, fx.FIXTURE_REPO, ["mining"], fx.receipts(spark, d)).select(
        "delivery_id", "work_type", "repo", "decision", "reason")


@query("a10_write_jobs")
def a10_write_jobs(spark, d):
    import uuid
    from feedmine.session import checkpoint_dir
    root = f"{checkpoint_dir(spark).rstrip('/')}/queues-{uuid.uuid4().hex}"
    jobs = ev.jobs_of(_routed(spark, d))
    for _ in range(2):  # a replay of the same batch adds nothing
        ev.write_jobs(jobs, root, batch_id=3)
    return spark.read.parquet(root).select("work_type", "delivery_id", "event", "action", "repo", "pr_number")


@query("b13_classify_failures")
def b13_classify_failures(spark, d):
    log = fx.failure_log(spark, d)
    return log.select("event_id", "error", ev.is_transient(F.col("error")).alias("retryable"))


# ---- incremental ------------------------------------------------------------------------
from feedmine.plans import mining as mn  # noqa: E402


def _wave1(spark, d):
    return mn.mine(fx.wave_state(spark, d), fx.wave_incoming(spark, d, 1), fx.wave_keys(spark, d))


@query("g2_replace_slice")
def g2_replace_slice(spark, d):
    out = cu.replace_slice(fx.wave_state(spark, d), fx.wave_incoming(spark, d, 1), fx.wave_keys(spark, d))
    return out.select("repo", "pr_number", "github_comment_id")


@query("g2_delta_slices")
def g2_delta_slices(spark, d):
    """G2 on a merge-on-read table: the mined slices leave by (repo, pr_number), the new notes enter."""
    from feedmine.sources import deltas as dl
    root = _scratch(spark, "g2")
    dl.create(spark, root, fx.wave_state(spark, d), ["repo", "pr_number", "comment_type", "github_comment_id"])
    dl.apply(spark, root, "wave 1", fx.wave_incoming(spark, d, 1), [fx.wave_keys(spark, d)])
    return dl.read(spark, root).select("repo", "pr_number", "github_comment_id")


@query("c7_removed_notes")
def c7_removed_notes(spark, d):
    return _wave1(spark, d).removed.select("repo", "pr_number", "github_comment_id", "category")


@query("i5_mine")
def i5_mine(spark, d):
    return _wave1(spark, d).active.select("repo", "pr_number", "github_comment_id")


@query("i5_mine_current")
def i5_mine_current(spark, d):
    return _wave1(spark, d).current.select("repo", "pr_number", "github_comment_id")


@query("i5_mine_withdrawal")
def i5_mine_withdrawal(spark, d):
    first = _wave1(spark, d).active
    second = mn.mine(first, fx.wave_incoming(spark, d, 2), fx.wave_keys(spark, d))
    return second.active.select("repo", "pr_number", "github_comment_id")


@query("g3_update_pending")
def g3_update_pending(spark, d):
    empty = spark.createDataFrame([], "repo string, pr_number long, last_seq long")
    return cu.update_pending(empty, fx.snapshots(spark, d)).select("repo", "pr_number", "status")


@query("g4_all_notes")
def g4_all_notes(spark, d):
    batched = rf.batched_roots(spark, d)
    comment_notes, _, _ = an.analyze_recorded(batched, fx.pr_diffs(spark, d),
                                              rf.recorded_responses(spark, d, batched), strict=False)
    from feedmine.sources.tables import merged_evidence
    from feedmine.session import materialize
    ev_ = merged_evidence(fx.prs(spark, d), fx.pr_diffs(spark, d))
    resp = rf.architecture_responses(spark, d)
    obj, err = md.response_object(F.col("raw"))
    arch, _ = va.architecture_notes(ev_, materialize(resp.select("repo", "pr_number", obj.alias("obj"),
                                                                  err.alias("error"))))
    allx = cu.all_notes(comment_notes.drop("ordinal"), arch)
    return allx.select("repo", "pr_number", "github_comment_id", "comment_type", "category", F.col("_kind").alias("kind"))


# ---- streaming --------------------------------------------------------------------------
from feedmine.streaming import pipeline as sp  # noqa: E402


def _scratch(spark, name):
    import uuid
    from feedmine.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _land_deliveries(spark, d, where=None):
    env = fx.deliveries(spark, d).select("body", "isBase64Encoded", "headers", "event_id", "copy", "k")
    return env if where is None else env.where(where)


@query("i1_delivery_stream")
def i1_delivery_stream(spark, d):
    root = _scratch(spark, "i1")
    _land_deliveries(spark, d).write.json(f"{root}/landing")
    stream = sp.delivery_stream(spark, f"{root}/landing", fx.WEBHOOK_SECRET)
    sp.run_available(stream.select("event_id", "copy", "status", "work_type", "repo", "pr_number"),
                     f"{root}/out", f"{root}/ckpt")
    return spark.read.parquet(f"{root}/out")


def _handler(jobs):
    """A stand-in worker: fails for k mod 9 = 4 (delivery ids carry the event id)."""
    return jobs.select("delivery_id", "work_type", "repo", "pr_number",
                       (F.col("delivery_id").try_cast("long") % 9 != 4).alias("ok"))


@query("i2_dispatch")
def i2_dispatch(spark, d):
    root = _scratch(spark, "i2")
    sp.write_receipts(fx.receipts(spark, d), f"{root}/receipts", -1)
    for copy in (0, 1):  # the repeated deliveries arrive later, in a second run
        _land_deliveries(spark, d, F.col("copy") == copy).write.mode("append").json(f"{root}/landing")
        stream = sp.delivery_stream(spark, f"{root}/landing", fx.WEBHOOK_SECRET)
        sp.dispatch(stream, _handler, f"{root}/receipts", f"{root}/results", f"{root}/ckpt")
    return spark.read.parquet(f"{root}/results").select("delivery_id", "ok", "batch_id")


@query("i3_split_failures")
def i3_split_failures(spark, d):
    jobs = ev.jobs_of(_routed(spark, d)).dropDuplicates(["delivery_id"])
    k = F.col("delivery_id").try_cast("long") % 9
    n = F.when(k == 4, 5).when(k == 5, 3).otherwise(1)
    log = jobs.select("delivery_id", F.explode(F.sequence(F.lit(1), n)).alias("receive"), k.alias("_k"))
    log = log.select("delivery_id", "receive",
                     (~((F.col("_k") == 4) | ((F.col("_k") == 5) & (F.col("receive") < 3)))).alias("ok"),
                     F.lit("2024-06-01 00:00:00").cast("timestamp").alias("at"))
    return sp.split_failures(log).select("delivery_id", "receives", "status")


def _flaky_worker(job):
    """A stand-in worker: jobs of k mod 9 = 4 always fail, those of k mod 9 = 5 twice."""
    k = int(job["delivery_id"]) % 9
    if k == 4 or (k == 5 and job["receive"] < 3):
        raise RuntimeError(f"receive {job['receive']} failed")


@query("i3_retry_stream")
def i3_retry_stream(spark, d):
    """Landed deliveries (every one twice) through the keyed retry stream until none waits: receives, status, dead letters."""
    from feedmine.streaming import retry as rt
    root = _scratch(spark, "i3")
    _land_deliveries(spark, d).write.json(f"{root}/landing")
    jobs = ev.jobs_of(sp.delivery_stream(spark, f"{root}/landing", fx.WEBHOOK_SECRET))
    stream = rt.start(rt.receives(jobs, _flaky_worker, visibility_ms=100), root, f"{root}/ckpt", "200 milliseconds")
    rt.run_until_settled(stream, spark, root)
    dead = rt.read_dead(spark, root).select("delivery_id", "error")
    return rt.last_status(spark, root).join(dead, "delivery_id", "left")


@query("i4_pending_until_merged")
def i4_pending_until_merged(spark, d):
    root = _scratch(spark, "i4")
    snaps = fx.snapshots(spark, d)
    schema = snaps.schema
    for seq in (0, 1, 2):  # one landing and one run per snapshot
        snaps.where(F.col("seq") == seq).write.mode("append").parquet(f"{root}/landing")
        stream = spark.readStream.schema(schema).parquet(f"{root}/landing")
        sp.run_available(sp.pending_until_merged(stream), f"{root}/out", f"{root}/ckpt")
    return spark.read.parquet(f"{root}/out")


# ---- review context ---------------------------------------------------------------------
from feedmine.operators import review as rv  # noqa: E402


def _manifest(spark, d):
    blobs, _ = rv.tree_blobs(fx.tree(spark, d))
    return rv.selectable(blobs, max_file=fx.TREE_FILE_CAP, max_manifest=fx.TREE_TOTAL_CAP)


@query("b10_tree_blobs")
def b10_tree_blobs(spark, d):
    blobs, rejects = rv.tree_blobs(fx.tree(spark, d))
    return blobs.select("repo", "path", "size", F.lit(None).cast("string").alias("reason")).unionByName(
        rejects.select("repo", F.lit(None).cast("string").alias("path"),
                       F.lit(None).cast("long").alias("size"), "reason"))


@query("b11_selectable")
def b11_selectable(spark, d):
    manifest, rejects = _manifest(spark, d)
    return manifest.select("repo", "path", "size", F.lit(None).cast("string").alias("reason")).unionByName(
        rejects.select("repo", F.lit(None).cast("string").alias("path"),
                       F.lit(None).cast("long").alias("size"), "reason"))


@query("h13_validate_selection")
def h13_validate_selection(spark, d):
    manifest, _ = _manifest(spark, d)
    _, checks = rv.validate_selection(fx.selections(spark, d), manifest)
    return checks.select("repo", "pr_number", "reason")


@query("h14_decode_blobs")
def h14_decode_blobs(spark, d):
    out = rv.decode_blobs(fx.blobs(spark, d), max_bytes=fx.TREE_FILE_CAP)
    return out.select("sha", "status", F.length("text").cast("long").alias("text_chars"))


def _context(spark, d):
    manifest, _ = _manifest(spark, d)
    selected, _ = rv.validate_selection(fx.selections(spark, d), manifest)
    return rv.selected_context(selected, rv.decode_blobs(fx.blobs(spark, d), max_bytes=fx.TREE_FILE_CAP), fx.CONTEXT_BUDGET)


@query("e3_within_budget")
def e3_within_budget(spark, d):
    ctx, rejects = _context(spark, d)
    return ctx.select("repo", "pr_number", "context_chars", F.lit(None).cast("string").alias("reason")) \
        .unionByName(rejects.select("repo", "pr_number", F.lit(None).cast("long").alias("context_chars"), "reason"))


@query("h15_review_query")
def h15_review_query(spark, d):
    q = rv.review_query(fx.prs(spark, d), fx.changed_files(spark, d))
    return q.select("repo", "pr_number", F.sha2("query_text", 256).alias("query_sha"),
                    F.length("query_text").cast("long").alias("query_chars"))


@query("h17_with_marker")
def h17_with_marker(spark, d):
    p = fx.prs(spark, d)
    return p.select("pr_number", F.sha2(rv.with_marker(F.coalesce("body", F.lit("")), F.col("head_sha")), 256)
                    .alias("published_sha"))


@query("c9_plan_review_posts")
def c9_plan_review_posts(spark, d):
    drafts, current = fx.review_drafts(spark, d)
    plan = rv.plan_review_posts(fx.posted_reviews(spark, d), drafts, current)
    return plan.select("repo", "pr_number", "action", "review_id", "url")


from feedmine.plans import review as rplan  # noqa: E402


def _vector_index(spark, d):
    return vx.save_vectors(_empty_index(spark), fx.vector_notes(spark, d))


@query("i6_review_evidence")
def i6_review_evidence(spark, d):
    ev_ = rplan.review_evidence(fx.review_heads(spark, d), fx.review_query_vectors(spark, d),
                                _vector_index(spark, d), fx.TRUSTED_REVIEWERS)
    return ev_.select("query_id", "github_comment_id", "rank")


@query("i6_review_context")
def i6_review_context(spark, d):
    heads = fx.review_heads(spark, d)
    out = rplan.review_context(
        heads, fx.changed_files(spark, d), fx.open_diffs(spark, d), fx.review_query_vectors(spark, d),
        _vector_index(spark, d), fx.tree(spark, d), fx.selections(spark, d), fx.blobs(spark, d),
        fx.TRUSTED_REVIEWERS, file_cap=fx.TREE_FILE_CAP, manifest_cap=fx.TREE_TOTAL_CAP,
        budget=fx.CONTEXT_BUDGET)
    return out.select("repo", "pr_number", "n_evidence", "context_chars", "prompt_chars", "reason")


def _response(text: str) -> str:
    return json.dumps({"output": [{"type": "message", "content": [{"type": "output_text", "text": text}]}]})


def fake_selector(system: str, prompt: str) -> str:
    """A stand-in model: the two smallest files offered (ties by path), none if nothing is known of the repo's past."""
    asked = json.loads(prompt)
    files = sorted(asked["repository_paths"], key=lambda f: (f["size"], f["path"]))
    return _response(json.dumps({"paths": [f["path"] for f in files[:2]] if asked["historical_evidence"] else []}))


def fake_reviewer(system: str, prompt: str) -> str:
    """A stand-in model: a draft that follows from the prompt."""
    import hashlib
    return _response("review " + hashlib.sha256(prompt.encode()).hexdigest())


@query("i6_selection_prompts")
def i6_selection_prompts(spark, d):
    """The file-selection prompt of every open PR whose tree passed its checks."""
    heads = fx.review_heads(spark, d)
    manifest, rejects = rplan.manifests(fx.tree(spark, d), fx.TREE_FILE_CAP, fx.TREE_TOTAL_CAP)
    asked = heads.join(rejects.select("repo", "head_sha"), ["repo", "head_sha"], "left_anti")
    evidence = rplan.evidence_lists(rplan.heads_to_search(heads, rejects), fx.review_query_vectors(spark, d), _vector_index(spark, d), fx.TRUSTED_REVIEWERS)
    out = rplan.selection_prompts(asked, fx.changed_files(spark, d), fx.open_diffs(spark, d), evidence, manifest)
    return out.select("repo", "pr_number", F.sha2("prompt", 256).alias("prompt_sha"),
                      F.length("prompt").cast("long").alias("prompt_chars"), "reason")


@query("i6_review_job")
def i6_review_job(spark, d):
    """Reviews of all open PRs, from evidence to the publish plan."""
    posted, now = fx.open_reviews(spark, d)
    reviews, plan = rplan.review_job(
        fx.review_heads(spark, d), fx.changed_files(spark, d), fx.open_diffs(spark, d), fx.review_query_vectors(spark, d),
        _vector_index(spark, d), fx.tree(spark, d), fx.blobs(spark, d), now, posted,
        rplan.ReviewModel(fake_selector, fake_reviewer), fx.TRUSTED_REVIEWERS, file_cap=fx.TREE_FILE_CAP,
        manifest_cap=fx.TREE_TOTAL_CAP, budget=fx.CONTEXT_BUDGET)
    steps = plan.groupBy("repo", "pr_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("step", "action"))), lambda x: x["action"]), ",").alias("steps"))
    return reviews.join(steps, ["repo", "pr_number"], "left").select(
        "repo", "pr_number", F.sha2("review", 256).alias("review_sha"), "reason", "steps")


@query("h6_json_prompts")
def h6_json_prompts(spark, d):
    p = fx.prs(spark, d)
    out = rv.json_prompts(p, F.struct(F.col("repo").alias("repository"), F.col("pr_number").alias("pull_request"),
                                      F.coalesce("title", F.lit("")).alias("title"),
                                      F.coalesce("body", F.lit("")).alias("description")), cap=120)
    return out.select("pr_number", F.length("prompt").cast("long").alias("prompt_chars"), "reason")


# ---- roll-ups and sources -----------------------------------------------------------------
from feedmine.operators import rollup as ru  # noqa: E402
from feedmine.sources import snapshot as snap  # noqa: E402


def _active_ordered(spark, d):
    return cu.curate(fx.notes(spark, d))


@query("a5_notes_report")
def a5_notes_report(spark, d):
    b = ru.report_blocks(_active_ordered(spark, d))
    return b.select("repo", "pr_number", F.sha2("block", 256).alias("block_sha"),
                    F.length("block").cast("long").alias("block_chars"), "repo_ord", "pr_ord")


@query("d3_skill_bands")
def d3_skill_bands(spark, d):
    return ru.skill_bands(_active_ordered(spark, d)).select(
        "category", F.sha2("item", 256).alias("item_sha"), "instruction", "support", "blocking")


def _doc_items(spark, d):
    return fx.read(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), F.col("lang").alias("category"),
                                                  "text")


@query("d4_exact_duplicates")
def d4_exact_duplicates(spark, d):
    return ru.exact_groups(_doc_items(spark, d)).withColumnRenamed("ordinal", "doc_id")


@query("d4_merge_similar")
def d4_merge_similar(spark, d):
    return ru.merge_similar(_doc_items(spark, d), threshold=0.7).withColumnRenamed("ordinal", "doc_id")


@query("d5_run_summary")
def d5_run_summary(spark, d):
    notes = fx.notes(spark, d)
    return ru.run_summary(feedback=feedback_table(spark, d, with_replies=False), notes_all=notes,
                          selected=cu.selected_notes(notes), active=cu.curate(notes),
                          indexed=fx.vector_notes(spark, d))


@query("d5_committed_counters")
def d5_committed_counters(spark, d):
    """The counters of a run, taken while it writes its tables and committed with them."""
    root = _scratch(spark, "d5")
    notes = fx.notes(spark, d)
    snap.publish_snapshot(spark, root, {
        "raw_comments": feedback_table(spark, d, with_replies=False), "notes_all": notes, "notes": cu.curate(notes),
        "vectors": fx.vector_notes(spark, d)},
        counters={"notes_all": {"selected": F.count_if(cu.is_selected())}})
    return snap.read_counters(spark, root)


@query("h16_synthesis_prompts")
def h16_synthesis_prompts(spark, d):
    act = with_ordinal(_active_ordered(spark, d).drop("ordinal").withColumn("_o", F.col("github_comment_id")),
                       [F.coalesce("merged_at", F.lit("")), F.col("_o")])
    p = ru.synthesis_prompts(act, fx.TRUSTED_REVIEWERS, chunk=400)
    return p.select("chunk_id", "n_notes", F.sha2("prompt", 256).alias("prompt_sha"))


def fake_model(system: str, prompt: str) -> str:
    """A stand-in model for J1/J3 runs: a deterministic text derived from the prompt."""
    import hashlib
    return "summary " + hashlib.sha256((system + prompt).encode()).hexdigest()[:16]


@query("j3_synthesize")
def j3_synthesize(spark, d):
    act = with_ordinal(_active_ordered(spark, d).drop("ordinal").withColumn("_o", F.col("github_comment_id")),
                       [F.coalesce("merged_at", F.lit("")), F.col("_o")])
    text, calls = ru.synthesize(act, fake_model, "system", fx.TRUSTED_REVIEWERS, chunk=400)
    return text.select(F.lit(calls).cast("long").alias("calls"), "text")


@query("a1_read_pages")
def a1_read_pages(spark, d):
    from pyspark.sql import types as T
    from feedmine.sources.pages import read_pages
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("path", T.StringType()),
                           T.StructField("size", T.LongType())])
    items, _ = read_pages(fx.landed_pages(spark, d), schema)
    return items


@query("a2_feedback_roundtrip")
def a2_feedback_roundtrip(spark, d):
    from feedmine.sources.tables import read_feedback, write_feedback
    path = _scratch(spark, "a2")
    write_feedback(ordered_feedback(spark, d, diffs=fx.pr_diffs(spark, d)), path)
    back = read_feedback(spark, path)
    return back.select("repo", "pr_number", "github_comment_id", "comment_type", "reviewer", "final_diff",
                       F.size("replies").cast("long").alias("n_replies"), "ordinal")


@query("a4_notes_tables")
def a4_notes_tables(spark, d):
    from feedmine.sources.tables import read_notes, write_notes
    root = _scratch(spark, "a4")
    notes = fx.notes(spark, d)
    write_notes(notes, f"{root}/notes_all")
    write_notes(cu.curate(notes), f"{root}/notes_active")
    a = read_notes(spark, f"{root}/notes_all").select(F.lit("notes_all").alias("table"), "github_comment_id")
    b = read_notes(spark, f"{root}/notes_active").select(F.lit("notes_active").alias("table"), "github_comment_id")
    return a.unionByName(b)


@query("a8_publish_snapshot")
def a8_publish_snapshot(spark, d):
    root = _scratch(spark, "a8")
    state = fx.wave_state(spark, d)
    snap.publish_snapshot(spark, root, {"notes": state.select("repo", "pr_number", "github_comment_id"),
                                        "pending_prs": spark.createDataFrame([], "repo string, pr_number long")})
    w1 = _wave1(spark, d).active
    try:  # a run that fails after writing the notes must stay invisible
        snap.publish_snapshot(spark, root, {"notes": w1.select("repo", "pr_number", "github_comment_id"),
                                            "pending_prs": spark.createDataFrame([], "repo string, pr_number long")},
                              fail_after="notes")
    except RuntimeError:
        pass
    return snap.read_snapshot(spark, root, "notes")


@query("a9_run_stage")
def a9_run_stage(spark, d):
    root = _scratch(spark, "a9")
    calls = []

    def compute():
        calls.append(1)
        return {"notes": fx.wave_state(spark, d).select("repo", "pr_number", "github_comment_id")}
    first = compute()
    snap.publish_snapshot(spark, root, first)
    again = snap.run_stage(spark, root, ["notes"], compute, resume=True)
    assert len(calls) == 1, "a committed stage must be reused"
    return again["notes"]


# ---- remaining sinks, model calls and the mining stream --------------------------------------
@query("a6_write_skill")
def a6_write_skill(spark, d):
    bands = ru.skill_bands(_active_ordered(spark, d))
    one_line = F.trim(F.regexp_replace("instruction", r"(?U)\s+", " "))  # an item is one line of the document
    lines = bands.select(F.concat(F.lit("- ["), F.col("category"), F.lit("] "), one_line,
                                  F.lit(" (support "), F.col("support").cast("string"), F.lit(")"),
                                  F.when(F.col("blocking"), F.lit(" blocking")).otherwise(F.lit(""))).alias("text"),
                         "category", "first_ordinal")
    path = _scratch(spark, "a6")
    snap.write_skill(lines.orderBy("category", "first_ordinal"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("a7_read_state")
def a7_read_state(spark, d):
    root = _scratch(spark, "a7")
    fb_ = ordered_feedback(spark, d, with_replies=False)
    snap.publish_snapshot(spark, root, {
        "raw_comments": fb_.select("repo", "pr_number", "github_comment_id", "comment_type"),
        "notes": fx.wave_state(spark, d).select("repo", "pr_number", "github_comment_id"),
        "pending_prs": cu.update_pending(spark.createDataFrame([], "repo string, pr_number long, last_seq long"),
                                         fx.snapshots(spark, d)).where(F.col("status") == "pending")
        .select("repo", "pr_number")})
    st_ = snap.read_state(spark, root)
    return (st_["raw_comments"].groupBy().count().select(F.lit("raw_comments").alias("table"), "count")
            .unionByName(st_["notes"].groupBy().count().select(F.lit("notes").alias("table"), "count"))
            .unionByName(st_["pending_prs"].groupBy().count().select(F.lit("pending_prs").alias("table"), "count")))


def valid_fake_model(system: str, prompt: str) -> str:
    """A stand-in model for J1: answers every analysis prompt with valid items that follow from
    the text of each comment in it."""
    import hashlib
    import re
    comments, _, _ = prompt.partition("\n\n--- Final merged diff for ")
    starts = [m.start() for m in re.finditer(r"^--- Comment \d+ ---$", comments, re.MULTILINE)]
    items = []
    for start, end in zip(starts, [*(s - 2 for s in starts[1:]), len(comments)], strict=True):
        thread = comments[start:end]
        items.append({
            "category": CATEGORIES[len(thread) % len(CATEGORIES)], "severity": SEVERITIES[len(thread) % len(SEVERITIES)],
            "original_issue": hashlib.sha256(thread.encode()).hexdigest(), "requested_change": thread, "rationale": "why",
            "implemented": True, "include_in_vector_store": True, "selection_rationale": "kept",
            "implementation_example": "example", "architecture_change": False, "supersedes_prior_architecture": False})
    return _response(json.dumps({"items": items}))


@query("j1_annotate")
def j1_annotate(spark, d):
    batched = rf.batched_roots(spark, d)
    notes = an.analyze_with_caller(batched, fx.pr_diffs(spark, d), valid_fake_model, "system")
    return notes.select("repo", "pr_number", "github_comment_id", "comment_type", "category", "severity", "original_issue")


@query("i5_stream_mine")
def i5_stream_mine(spark, d):
    root = _scratch(spark, "i5")
    snap.publish_snapshot(spark, root, {"notes": fx.wave_state(spark, d)}, version=1)
    keys = fx.wave_keys(spark, d)
    incoming = fx.wave_incoming(spark, d, 1)
    for half in (0, 1):  # the mined PRs arrive in two landings, one stream run each
        keys.where(F.col("pr_number") % 2 == half).write.mode("append").parquet(f"{root}/keys")
        stream = spark.readStream.schema(keys.schema).parquet(f"{root}/keys")
        sp.mining_stream(stream, root, 1, lambda k: incoming.join(k, ["repo", "pr_number"], "left_semi"),
                         f"{root}/ckpt")
    return snap.read_snapshot(spark, root, "notes").select("repo", "pr_number", "github_comment_id")


# ---- the whole jobs --------------------------------------------------------------------------
from feedmine.plans import history as hi  # noqa: E402


def fake_assessor(system: str, prompt: str) -> str:
    """A stand-in model for assessments: what it decides follows from the prompt's length."""
    import hashlib
    import json
    change = len(prompt) % 2 == 0
    text = json.dumps({"architecture_change": change, "implemented": True, "include_in_vector_store": change,
                       "supersedes_prior_architecture": change and len(prompt) % 7 == 0,
                       "summary": hashlib.sha256(prompt.encode()).hexdigest(), "rationale": "why"})
    return json.dumps({"output": [{"type": "message", "content": [{"type": "output_text", "text": text}]}]})


def fake_embedder(texts: list[str]) -> list[list[float]]:
    return [[1.0, float(len(t) % 97), float(len(t) % 89)] for t in texts]


def _history_inputs(spark, d):
    from feedmine.sources.tables import merged_evidence
    feedback = ordered_feedback(spark, d).where(F.col("merged_at") != "")
    return feedback, merged_evidence(fx.prs(spark, d), fx.pr_diffs(spark, d)), hi.Model(valid_fake_model, fake_assessor, fake_embedder)


def _history_rows(spark, root):
    """All state tables of the newest version as (tbl, repo, pr_number, item) rows."""
    note = F.concat_ws(":", "comment_type", "github_comment_id", "category")
    items = {"raw_comments": F.concat_ws(":", "comment_type", "github_comment_id"), "notes": note,
             "vectors": F.col("id"), "pending_prs": F.lit("pending")}
    out = None
    for name, item in items.items():
        rows = snap.read_snapshot(spark, root, name).select(F.lit(name).alias("tbl"), "repo", "pr_number", item.alias("item"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("batch_job")
def batch_job(spark, d):
    root = _scratch(spark, "batch")
    feedback, evidence, model = _history_inputs(spark, d)
    hi.batch_job(spark, root, feedback, evidence, model, [f"org/r{i}" for i in range(8)])
    return _history_rows(spark, root)


@query("i5_mine_full")
def i5_mine_full(spark, d):
    root = _scratch(spark, "i5full")
    feedback, evidence, model = _history_inputs(spark, d)
    odd = F.col("pr_number") % 2 == 1  # these PRs are merged after the batch job
    hi.batch_job(spark, root, feedback.where(~odd), evidence.where(~odd), model, [f"org/r{i}" for i in range(8)])
    waiting = fx.prs(spark, d).where(odd & (F.col("merged_at").isNotNull() | (F.col("state") == "open")))
    names = ("raw_comments", "notes", "vectors")
    snap.publish_snapshot(spark, root, {**{n: snap.read_snapshot(spark, root, n) for n in names},
                                        "pending_prs": waiting.select("repo", "pr_number")})
    hi.mine_step(spark, root, evidence.where(odd), 3, feedback.where(odd), evidence.where(odd), model,
                 feedback_cap=fx.REVIEW_FEEDBACK_CAP)
    return _history_rows(spark, root)
