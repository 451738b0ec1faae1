"""Feedback collection as DataFrame operators: merged-PR filter (B1), reviewer
list (B2), trusted filter (B3), eligible summaries (B4), the three-shape
projection (B5, with G1 and C1), PR state (B6), diff guard (B7), reply threads
(C2), the feedback cap (D2) and the stable result order (E1 keys).

Provider rows arrive as landed tables: ``comments`` (line comments with
``in_reply_to_id``), ``reviews`` (summaries) and ``issue_comments``
(conversation), each with (repo, pr_number, id, login, body, ..., item_ord),
where ``item_ord`` is the provider's listing order within the PR.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmine.functions.text import is_blank, strip
from feedmine.operators.joins import broadcast_if_small
from feedmine.schemas import FEEDBACK_FIELDS, MAX_FINAL_DIFF_CHARS, REPLY
from feedmine.session import materialize

KIND_ORDER = {"review_comment": 0, "review_summary": 1, "issue_comment": 2}


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


# ---- B1 -------------------------------------------------------------------------
def merged_prs(prs: DataFrame, updated_after: str | None = None) -> DataFrame:
    """Merged PRs only; ``updated_at >= updated_after`` compared as strings, if set."""
    out = prs.where(_known(F.col("merged_at")))
    if updated_after:
        out = out.where(F.col("updated_at") >= F.lit(updated_after))
    return out


# ---- B2 -------------------------------------------------------------------------
def normalize_reviewers(names: DataFrame | list | str, spark: SparkSession | None = None,
                        strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Trim, reject blanks, de-duplicate ignoring case keeping the first spelling.

    ``names``: a table (name, ordinal), or a list / single string from configuration.
    Returns (reviewers(name, ordinal), rejects). Strict mode raises on any reject or
    on an empty result, like the reference.
    """
    if not isinstance(names, DataFrame):
        values = [names] if isinstance(names, str) else names
        if not isinstance(values, list):
            raise ValueError("reviewer names must be a list of logins")
        if any(not isinstance(v, str) or not v.strip() for v in values):
            raise ValueError("trusted reviewer names must be non-empty strings")
        spark = spark or SparkSession.getActiveSession()
        names = spark.createDataFrame([(v, i) for i, v in enumerate(values)],
                                      "name string, ordinal long")
    blank = is_blank(F.col("name"))
    rejects = names.where(blank).select(
        F.lit("B2").alias("operator"), F.col("ordinal").cast("string").alias("key"),
        F.lit("reviewer name must be a non-empty string").alias("reason"))
    good = names.where(~blank).select(strip(F.col("name")).alias("name"), "ordinal")
    out = good.groupBy(F.lower("name").alias("_lc")).agg(
        F.min_by("name", "ordinal").alias("name"), F.min("ordinal").alias("ordinal")).drop("_lc")
    if strict:
        if rejects.limit(1).count():
            raise ValueError("trusted reviewer names must be non-empty strings")
        if out.limit(1).count() == 0:
            raise ValueError("at least one trusted reviewer is required")
    return out, rejects


# ---- B3 -------------------------------------------------------------------------
def trusted_only(df: DataFrame, reviewers: DataFrame, login_col: str = "login",
                 reviewer_bound: int = 10_000) -> DataFrame:
    """Keep rows whose login is a trusted reviewer, ignoring case.

    The reviewer list is configuration, so it is broadcast for a left-semi join if it has
    no more than ``reviewer_bound`` rows: the feedback side is never shuffled then. A missing author is ''
    and never matches (the reference crashes on a null user; here it is untrusted).
    """
    trusted = reviewers.select(F.lower(strip(F.col("name"))).alias("_lc")).distinct()
    trusted = broadcast_if_small(trusted, reviewer_bound)
    lc = F.lower(F.coalesce(F.col(login_col), F.lit("")))
    return df.join(trusted, lc == F.col("_lc"), "left_semi")


# ---- B4 -------------------------------------------------------------------------
def eligible_reviews(reviews: DataFrame) -> DataFrame:
    """Drop DISMISSED (exact case, null-safe) and null or empty bodies; PENDING stays."""
    return reviews.where(~F.col("state").eqNullSafe(F.lit("DISMISSED")) & _known(F.col("body")))


# ---- B6 -------------------------------------------------------------------------
def pr_state(prs: DataFrame) -> Column:
    return F.when(_known(F.col("merged_at")), F.lit("merged")).otherwise(
        F.coalesce(F.col("state"), F.lit("open")))


# ---- B7 -------------------------------------------------------------------------
def guard_diffs(diffs: DataFrame, max_chars: int = MAX_FINAL_DIFF_CHARS) -> DataFrame:
    """Adds ``reason``: blank diff or longer than ``max_chars`` (exactly the cap is fine).

    Never truncates. ``strict_guard`` raises on the first reject.
    """
    reason = (F.when(is_blank(F.col("final_diff")), F.lit("empty final diff"))
              .when(F.length("final_diff") > max_chars,
                    F.concat(F.lit("final diff is "), F.length("final_diff").cast("string"),
                             F.lit(f" characters; maximum supported is {max_chars}"))))
    return diffs.withColumn("reason", reason)


def strict_guard(diffs: DataFrame, max_chars: int = MAX_FINAL_DIFF_CHARS) -> DataFrame:
    checked = guard_diffs(diffs, max_chars)
    bad = checked.where(F.col("reason").isNotNull()).limit(1).collect()
    if bad:
        raise ValueError(bad[0]["reason"])
    return checked.drop("reason")


# ---- C2 -------------------------------------------------------------------------
def attach_replies(comments: DataFrame, roots: DataFrame) -> DataFrame:
    """All descendants of each root by any author, breadth-first, siblings in input order.

    ``comments``: (repo, pr_number, id, in_reply_to_id, login, body, created_at,
    html_url, item_ord). ``roots``: (repo, pr_number, id), comments that answer none. Returns (repo, pr_number,
    root_id, replies ARRAY<REPLY>) for roots with at least one reply.

    Breadth-first order is the order of (depth, path of sibling ordinals), so each reply needs its root and its
    path (``reply_paths``). Texts are joined to the paths at the end. Replies under untrusted roots, orphans and
    cycles reach no root and are left out.
    """
    replies = (comments.where(F.col("in_reply_to_id").isNotNull())
               .dropDuplicates(["repo", "pr_number", "id"])
               .join(roots.select("repo", "pr_number").distinct(), ["repo", "pr_number"], "left_semi"))
    paths = reply_paths(replies.select("repo", "pr_number", "id", F.col("in_reply_to_id").alias("parent"), F.col("item_ord").cast("long")))
    reply = F.struct(F.col("id").alias("github_comment_id"),
                     F.coalesce("login", F.lit("")).alias("author"),
                     F.coalesce("body", F.lit("")).alias("body"),
                     F.coalesce("created_at", F.lit("")).alias("created_at"),
                     F.coalesce("html_url", F.lit("")).alias("html_url")).alias("reply")
    reached = paths.join(roots.select("repo", "pr_number", F.col("id").alias("top")).distinct(), ["repo", "pr_number", "top"], "left_semi")
    grouped = (reached.join(replies.select("repo", "pr_number", "id", reply), ["repo", "pr_number", "id"])
               .groupBy("repo", "pr_number", F.col("top").alias("root_id"))
               .agg(F.array_sort(F.collect_list(F.struct(F.size("path").alias("depth"), "path", "reply"))).alias("_r")))
    return grouped.select("repo", "pr_number", "root_id", F.transform("_r", lambda x: x["reply"]).alias("replies"))


def reply_paths(replies: DataFrame) -> DataFrame:
    """(repo, pr_number, id, top, path) of every reply: the comment at the top of its thread and the sibling ordinals from
    below it down to the reply. ``replies``: (repo, pr_number, id, parent, item_ord), ids unique in their PR.

    Pointer doubling: each reply knows an ancestor and the path from it. A round joins that ancestor's own
    ancestor and puts the paths together, so the distance doubles: a thread of n levels takes about log2(n) rounds. A
    reply whose ancestor is no reply is done. One whose path has grown longer than its PR has replies is on a
    cycle, or below one, and is dropped. Each round is written to the shared folder.
    """
    sizes = replies.groupBy("repo", "pr_number").agg(F.count(F.lit(1)).alias("most"))
    known = replies.select("repo", "pr_number", "id", F.col("parent").alias("top"), F.array("item_ord").alias("path"))
    answers = replies.select("repo", "pr_number", F.col("id").alias("top"), F.lit(True).alias("open"))

    def marked(rows: DataFrame) -> DataFrame:
        return rows.join(answers, ["repo", "pr_number", "top"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    # The first mark also settles the common case, a thread of one level, without a further round.
    known = materialize(marked(known))
    done = [known.where(~F.col("open"))]
    while True:
        waiting = known.where("open")
        if waiting.isEmpty():
            break
        above = known.select("repo", "pr_number", F.col("id").alias("top"), F.col("top").alias("_top"), F.col("path").alias("_path"), F.col("open").alias("_open"))
        for rows in done[:-1]:  # done in earlier rounds, still ancestors of others
            above = above.unionByName(rows.select("repo", "pr_number", F.col("id").alias("top"), F.col("top").alias("_top"),
                                                  F.col("path").alias("_path"), F.col("open").alias("_open")))
        doubled = (waiting.drop("open").join(above, ["repo", "pr_number", "top"])
                   .select("repo", "pr_number", "id", F.col("_top").alias("top"), F.concat("_path", "path").alias("path"), F.col("_open").alias("open"))
                   .join(sizes, ["repo", "pr_number"]).where(F.size("path") <= F.col("most")).drop("most"))
        known = materialize(doubled)
        done.append(known.where(~F.col("open")))
    found = done[0]
    for rows in done[1:]:
        found = found.unionByName(rows)
    return found.select("repo", "pr_number", "id", "top", "path")


# ---- B5 (+ G1, C1) ------------------------------------------------------------------
def normalize_feedback(comments: DataFrame, reviews: DataFrame, issue_comments: DataFrame,
                       prs: DataFrame, reviewers: DataFrame, diffs: DataFrame | None = None,
                       with_replies: bool = True) -> DataFrame:
    """The three feedback shapes on one 17-field schema, plus ordering keys.

    Line comments: trusted roots only, path and hunk kept, empty bodies kept, with
    their reply threads. Summaries: eligible ones, ``submitted_at`` → ``created_at``,
    state kept. Conversation comments: no state. PR attributes come from ``prs`` by an
    equi join on (repo, pr_number). The final diff is attached only when ``diffs`` is
    given: diffs are up to 500 kB each and are otherwise joined once per prompt.
    """
    roots = trusted_only(comments.where(F.col("in_reply_to_id").isNull()), reviewers)
    empty_replies = F.array().cast(f"array<{REPLY.simpleString()}>")
    line = roots.select(
        "repo", "pr_number", F.col("id").alias("github_comment_id"),
        F.lit("review_comment").alias("comment_type"),
        F.col("path").alias("file_path"), "diff_hunk", F.coalesce("body", F.lit("")).alias("body"),
        F.lit(None).cast("string").alias("review_state"),
        F.coalesce("created_at", F.lit("")).alias("created_at"),
        F.coalesce("html_url", F.lit("")).alias("html_url"),
        F.col("login").alias("reviewer"), F.lit(0).alias("kind_ord"), "item_ord")
    if with_replies:
        rep = attach_replies(comments, roots.select("repo", "pr_number", "id")).select(
            F.col("repo").alias("_rrepo"), F.col("pr_number").alias("_rpr"), "root_id", "replies")
        line = (line.join(rep, (F.col("repo") == F.col("_rrepo")) & (F.col("pr_number") == F.col("_rpr"))
                          & (F.col("github_comment_id") == F.col("root_id")), "left")
                .withColumn("replies", F.coalesce("replies", empty_replies))
                .drop("_rrepo", "_rpr", "root_id"))
    else:
        line = line.withColumn("replies", empty_replies)
    summ = trusted_only(eligible_reviews(reviews), reviewers).select(
        "repo", "pr_number", F.col("id").alias("github_comment_id"),
        F.lit("review_summary").alias("comment_type"),
        F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("string").alias("diff_hunk"),
        F.coalesce("body", F.lit("")).alias("body"), F.col("state").alias("review_state"),
        F.coalesce("submitted_at", F.lit("")).alias("created_at"),
        F.coalesce("html_url", F.lit("")).alias("html_url"),
        F.col("login").alias("reviewer"), F.lit(1).alias("kind_ord"), "item_ord",
        empty_replies.alias("replies"))
    conv = trusted_only(issue_comments, reviewers).select(
        "repo", "pr_number", F.col("id").alias("github_comment_id"),
        F.lit("issue_comment").alias("comment_type"),
        F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("string").alias("diff_hunk"),
        F.coalesce("body", F.lit("")).alias("body"), F.lit(None).cast("string").alias("review_state"),
        F.coalesce("created_at", F.lit("")).alias("created_at"),
        F.coalesce("html_url", F.lit("")).alias("html_url"),
        F.col("login").alias("reviewer"), F.lit(2).alias("kind_ord"), "item_ord",
        empty_replies.alias("replies"))
    union = line.unionByName(summ).unionByName(conv)
    attrs = prs.select(
        "repo", "pr_number", F.coalesce("title", F.lit("")).alias("pr_title"),
        F.coalesce("html_url", F.lit("")).alias("pr_url"), pr_state(prs).alias("pr_state"),
        F.coalesce("merged_at", F.lit("")).alias("merged_at"),
        F.coalesce("updated_at", F.lit("")).alias("pr_updated_at"))
    out = union.join(attrs, ["repo", "pr_number"])
    if diffs is not None:
        d = diffs.select("repo", "pr_number", "final_diff")
        out = out.join(d, ["repo", "pr_number"], "left").withColumn(
            "final_diff", F.when(F.col("pr_state") == "merged", F.coalesce("final_diff", F.lit("")))
            .otherwise(F.lit("")))
    else:
        out = out.withColumn("final_diff", F.lit(None).cast("string"))
    return out.select(*FEEDBACK_FIELDS, "kind_ord", "item_ord", "pr_updated_at")


def feedback_order(repo_ord: Column | None = None) -> list[Column]:
    """E1 keys: repo config order, PR listing order (updated desc), kind, item order."""
    ro = repo_ord if repo_ord is not None else F.col("repo_ord")
    return [ro, F.col("pr_updated_at").desc(), F.col("pr_number"), F.col("kind_ord"),
            F.col("item_ord"), F.col("github_comment_id")]


# ---- D2 -------------------------------------------------------------------------
def check_feedback_cap(feedback: DataFrame, cap: int) -> DataFrame:
    """PRs with more than ``cap`` feedback items (equal is fine): (repo, pr_number, n)."""
    counts = feedback.groupBy("repo", "pr_number").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > cap)


def enforce_feedback_cap(feedback: DataFrame, cap: int) -> DataFrame:
    over = check_feedback_cap(feedback, cap).limit(1).collect()
    if over:
        r = over[0]
        raise ValueError(f"pull request {r['repo']}#{r['pr_number']} has {r['n']} review items; "
                         f"limit is {cap}")
    return feedback
