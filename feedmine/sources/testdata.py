"""Adapters from the driver's generated tables to the feedback data model.

Each adapter is a pure DataFrame reshaping, deterministic and expressible in
plain SQL; ``feedmine.plans.oracle`` holds the same reshapings as DuckDB CTEs.
All keys are integer formulas on the source ids, so the adapters grow with the
tables and keep their partitioning (no global ordering, no driver data).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmine.functions.hmac import hmac_sha256_hex
from feedmine.schemas import CATEGORIES, SEVERITIES

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# ---- fixed values of the fixtures ---------------------------------------------
TRUSTED_REVIEWERS = ["U0", "u1", "u2"]
WEBHOOK_SECRET = "fixture-webhook-secret"
WRONG_SECRET = "not-the-secret"
FIXTURE_REPO = "org/r0"
DIFF_CAP = 5_000               # lowered diff cap for the documents fixture
TREE_FILE_CAP = 5_000          # lowered per-file cap for the tree fixture
TREE_TOTAL_CAP = 7_000         # lowered manifest cap for the tree fixture
REVIEW_FEEDBACK_CAP = 8        # lowered feedback cap for the reviews fixture
NOTE_BASE_DATE = "2024-01-01"
REVIEW_STATES = ["APPROVED", "CHANGES_REQUESTED", "COMMENTED", "DISMISSED"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repo_of(col: Column, n: int = 8) -> Column:
    return F.concat(F.lit("org/r"), (col % n).cast("string"))


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def pr_url(repo: Column, number: Column) -> Column:
    return F.concat(F.lit("https://example.test/"), repo, F.lit("/pull/"), number.cast("string"))


# ---- prs: orders -------------------------------------------------------------
def prs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    day = F.date_format(F.col("o_orderdate"), "yyyy-MM-dd")
    repo = repo_of(F.col("o_orderkey"))
    return o.select(
        repo.alias("repo"),
        F.col("o_orderkey").alias("pr_number"),
        F.col("o_orderpriority").alias("title"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Change set "), F.col("o_orderkey").cast("string")))
         .alias("body"),
        pr_url(repo, F.col("o_orderkey")).alias("html_url"),
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("state"),
        F.when(F.col("o_orderstatus") == "F", day).alias("merged_at"),
        day.alias("updated_at"),
        F.sha2(F.concat(F.lit("head-"), F.col("o_orderkey").cast("string")), 256).alias("head_sha"),
        F.col("o_custkey").alias("author_id"),
    )


def pr_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final diff per PR: a small synthetic patch (the big-text branch is `documents`)."""
    p = prs(spark, sf_dir)
    return p.select(
        "repo", "pr_number",
        F.when(F.col("merged_at").isNull(), F.lit("")).otherwise(
            F.concat(F.lit("diff --git a/f b/f\n+"), F.col("title"),
                     F.lit(" "), F.col("pr_number").cast("string"))).alias("final_diff"),
    )


# ---- threads: conversations ----------------------------------------------------
def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    cid, turn = F.col("conv_id"), F.col("turn")
    repo = repo_of(cid)
    cid100 = cid * 100
    return c.select(
        repo.alias("repo"),
        cid.alias("pr_number"),
        (cid100 + turn + 1).alias("id"),
        F.when(turn == 0, F.lit(None).cast("long"))
         .when(turn % 2 == 1, cid100 + 1)
         .otherwise(cid100 + turn).alias("in_reply_to_id"),
        F.when(turn == 0, F.concat(F.lit("u"), (cid % 5).cast("string")))
         .otherwise(F.col("role")).alias("login"),
        F.col("text").alias("body"),
        F.concat(F.lit("src/c"), cid.cast("string"), F.lit(".py")).alias("path"),
        F.concat(F.lit("@@ -1 +1 @@ turn "), turn.cast("string")).alias("diff_hunk"),
        F.concat(F.lit("2024-02-01T00:00:"), F.lpad(turn.cast("string"), 2, "0"),
                 F.lit("Z")).alias("created_at"),
        F.concat(pr_url(repo, cid), F.lit("#c"), (cid100 + turn + 1).cast("string")).alias("html_url"),
        turn.alias("item_ord"),
    )


# ---- reviews: documents ---------------------------------------------------------
def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    did = F.col("doc_id")
    conv = did % 100
    repo = repo_of(conv)
    return d.select(
        repo.alias("repo"),
        conv.alias("pr_number"),
        did.alias("id"),
        F.concat(F.lit("u"), (did % 5).cast("string")).alias("login"),
        F.when(did % 9 == 0, F.lit(None).cast("string"))
         .otherwise(_pick(REVIEW_STATES, did % 4)).alias("state"),
        F.when(did % 11 == 0, F.lit(None).cast("string"))
         .when(did % 6 == 0, F.lit("")).otherwise(F.col("text")).alias("body"),
        F.concat(F.lit("2024-03-01T00:00:00Z#"), did.cast("string")).alias("submitted_at"),
        F.concat(pr_url(repo, conv), F.lit("#r"), did.cast("string")).alias("html_url"),
        did.alias("item_ord"),
    )


# ---- issue_comments: benchmark ----------------------------------------------------
def issue_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    iid = F.col("item_id")
    conv = iid % 100
    repo = repo_of(conv)
    return b.select(
        repo.alias("repo"),
        conv.alias("pr_number"),
        iid.alias("id"),
        F.concat(F.lit("u"), (iid % 5).cast("string")).alias("login"),
        F.when(iid % 7 == 0, F.lit("")).otherwise(F.col("text")).alias("body"),
        F.concat(F.lit("2024-04-01T00:00:00Z#"), iid.cast("string")).alias("created_at"),
        F.concat(pr_url(repo, conv), F.lit("#i"), iid.cast("string")).alias("html_url"),
        iid.alias("item_ord"),
    )


def reviewer_list(spark: SparkSession) -> DataFrame:
    """The configured reviewer list as a table (name, ordinal)."""
    return spark.createDataFrame(
        [(n, i) for i, n in enumerate(TRUSTED_REVIEWERS)], "name string, ordinal long")


# ---- notes: documents left join labels ------------------------------------------------
def merged_at_of(doc_id: Column) -> Column:
    days = (doc_id * 7919 % 700).cast("int")
    return F.when(doc_id % 10 == 0, F.lit("")).otherwise(
        F.date_format(F.date_add(F.lit(NOTE_BASE_DATE).cast("date"), days), "yyyy-MM-dd"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    lab = read(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left")
    did = F.col("doc_id")
    category = _pick(CATEGORIES, did % 13)
    return j.select(
        F.col("source").alias("repo"),
        F.expr("doc_id div 100").alias("pr_number"),
        did.alias("github_comment_id"),
        F.concat(F.lit("PR "), F.expr("cast(doc_id div 100 as string)")).alias("pr_title"),
        pr_url(F.col("source"), F.expr("doc_id div 100")).alias("pr_url"),
        F.lit("review_comment").alias("comment_type"),
        F.when(did % 4 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("src/f"), (did % 17).cast("string"), F.lit(".py"))).alias("file_path"),
        F.col("text").alias("original_body"),
        category.alias("category"),
        F.expr("substring(text, 1, length(text) div 2)").alias("original_issue"),
        F.expr("substring(text, length(text) div 2 + 1)").alias("requested_change"),
        F.concat(F.lit("lang="), F.col("lang")).alias("rationale"),
        _pick(SEVERITIES, did % 3).alias("severity"),
        F.concat(F.lit("u"), (did % 5).cast("string")).alias("reviewer"),
        (F.col("quality") == 1).alias("implemented"),
        (F.col("toxic") == 0).alias("include_in_vector_store"),
        F.lit("fixture").alias("selection_rationale"),
        F.when(did % 5 == 0, F.lit("")).otherwise(F.col("text")).alias("implementation_example"),
        (category == "architecture").alias("architecture_change"),
        (did % 37 == 5).alias("supersedes_prior_architecture"),
        merged_at_of(did).alias("merged_at"),
        did.alias("ordinal"),
    )


# ---- documents as diffs ------------------------------------------------------------
def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    conv = F.col("doc_id")
    return d.select(
        repo_of(conv).alias("repo"), conv.alias("pr_number"),
        F.when(conv % 50 == 7, F.lit("  \n ")).otherwise(F.col("text")).alias("final_diff"),
    )


# ---- vectors: embeddings -------------------------------------------------------------
def vector_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    vid = F.col("vec_id")
    repo = F.concat(F.lit("org/r"), F.col("label").cast("string"))
    return e.select(
        repo.alias("repo"),
        vid.alias("pr_number"),
        vid.alias("github_comment_id"),
        pr_url(repo, vid).alias("pr_url"),
        F.lit("review_comment").alias("comment_type"),
        F.when(vid % 4 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("lib/m"), (vid % 7).cast("string"), F.lit(".py"))).alias("file_path"),
        F.concat(F.lit("body "), vid.cast("string")).alias("original_body"),
        _pick(CATEGORIES, vid % 13).alias("category"),
        _pick(SEVERITIES, vid % 3).alias("severity"),
        F.concat(F.lit("issue "), vid.cast("string")).alias("original_issue"),
        F.concat(F.lit("change "), vid.cast("string")).alias("requested_change"),
        F.lit("why").alias("rationale"),
        F.when(vid % 6 == 0, F.lit("")).otherwise(F.lit("example")).alias("implementation_example"),
        F.concat(F.lit("u"), (vid % 3).cast("string")).alias("reviewer"),
        F.when(vid % 10 == 0, F.lit("")).otherwise(
            F.date_format(F.date_add(F.lit(NOTE_BASE_DATE).cast("date"), (vid % 300).cast("int")),
                          "yyyy-MM-dd")).alias("merged_at"),
        F.col("embedding").alias("embedding"),
        vid.alias("ordinal"),
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors: every embedding, searched in its own repo."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("query_id"),
        F.concat(F.lit("org/r"), F.col("label").cast("string")).alias("repo"),
        F.concat(F.lit("query "), F.col("vec_id").cast("string")).alias("query_text"),
        F.col("embedding").alias("query_vector"),
    )


def incoming_vector_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id mod 3 = 0, twice: ordinal 2v then 2v+1; the second copy wins."""
    base = vector_notes(spark, sf_dir).where(F.col("pr_number") % 3 == 0)
    first = base.withColumn("ordinal", F.col("ordinal") * 2).withColumn(
        "category", F.lit("other"))
    second = base.withColumn("ordinal", F.col("ordinal") * 2 + 1)
    return first.unionByName(second)


# ---- tree: pages ------------------------------------------------------------------
def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    pid = F.col("page_id")
    repo = repo_of(pid)
    return p.select(
        repo.alias("repo"),
        F.sha2(repo, 256).alias("head_sha"),
        F.concat(F.col("url"), F.lit("~"), pid.cast("string")).alias("path"),
        F.when(pid % 13 == 12, F.lit("tree")).otherwise(F.lit("blob")).alias("type"),
        F.sha2(F.col("html"), 256).alias("sha"),
        F.octet_length("html").cast("long").alias("size"),
        (pid == 7).alias("truncated"),
        pid.alias("item_ord"),
    )


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blob responses: base64 of the page, broken into 60-character lines."""
    p = read(spark, sf_dir, "pages")
    pid = F.col("page_id")
    b64 = F.base64(F.encode("html", "UTF-8"))
    wrapped = F.regexp_replace(b64, "(.{60})", "$1\n")
    return p.select(
        F.sha2(F.col("html"), 256).alias("sha"),
        F.when(pid % 29 == 3, F.lit("utf-8")).otherwise(F.lit("base64")).alias("encoding"),
        F.when(pid % 31 == 4, F.lit("@@not-base64@@")).otherwise(wrapped).alias("content"),
    )


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per open PR: three blob paths of its repo, starting at place (pr_number div 8) of the tree and going round; r1
    adds an unknown path, r2 repeats one. (repo, pr_number, head_sha, selection)."""
    from pyspark.sql import Window as W
    # Ranks within one repo: bounded by the repo's tree, which B11 caps at 20,000.
    t = tree(spark, sf_dir).where((F.col("type") == "blob") & (F.col("size") <= TREE_FILE_CAP))
    w = W.partitionBy("repo", "head_sha")
    ranked = t.select("repo", "path", (F.row_number().over(w.orderBy("item_ord")) - 1).alias("rk"), F.count(F.lit(1)).over(w).alias("n"))
    sizes = ranked.select("repo", "n").distinct()
    picks = review_heads(spark, sf_dir).select("repo", "pr_number", "head_sha").join(sizes, "repo") \
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.least(F.lit(3), F.col("n")).cast("int") - 1))) \
        .withColumn("rk", F.expr("(pr_number div 8 + j) % n"))
    sel = picks.join(ranked.select("repo", "rk", "path"), ["repo", "rk"]).groupBy("repo", "pr_number", "head_sha").agg(
        F.array_sort(F.collect_list(F.struct("j", "path"))).alias("s"))
    paths = F.transform("s", lambda x: x["path"])
    paths = (F.when(F.col("repo") == "org/r1", F.concat(paths, F.array(F.lit("missing/file.py"))))
             .when(F.col("repo") == "org/r2", F.concat(paths, F.slice(paths, 1, 1)))
             .otherwise(paths))
    return sel.select("repo", "pr_number", "head_sha", F.to_json(F.struct(paths.alias("paths"))).alias("selection"))


# ---- deliveries: events ---------------------------------------------------------------
def _k(col: str = "props") -> Column:
    return F.get_json_object(F.col(col), "$.k").cast("int")


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed webhook envelopes, one per event; event_id mod 10 = 0 is delivered twice."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    e = e.withColumn("k", _k())
    uid = F.col("user_id")
    repo = repo_of(uid)
    et = F.col("event_type")
    k = F.col("k")
    event = (F.when(et.isin("signup", "purchase", "error"), "pull_request")
             .when(et == "click", "pull_request_review_comment")
             .when(et == "view", "issue_comment"))
    action = (F.when(et == "signup", "opened").when(et == "purchase", "closed")
              .when(et == "error", "labeled").otherwise("created"))
    num = uid.cast("string")
    pr_num = F.when(k == 98, F.concat(num, F.lit(".0"))).otherwise(num)
    repo_json = F.concat(F.lit('"repository":{"full_name":"'), repo, F.lit('"}'))
    return _envelopes(e, event, action, repo, num, pr_num, repo_json)


def _envelopes(e, event, action, repo, num, pr_num, repo_json):
    k = F.col("k")
    raw = (
        F.when(event == "pull_request", F.concat(
            F.lit('{"action":"'), action, F.lit('","number":'), num,
            F.lit(',"pull_request":{"number":'), pr_num, F.lit("},"), repo_json, F.lit("}")))
        .when(event == "pull_request_review_comment", F.concat(
            F.lit('{"action":"created","pull_request":{"number":'), pr_num, F.lit("},"),
            repo_json, F.lit("}")))
        .otherwise(F.concat(
            F.lit('{"action":"created","issue":{"number":'), pr_num,
            F.when(k % 2 == 0, F.concat(F.lit(',"pull_request":{"url":"'),
                                        pr_url(repo, F.col("user_id")), F.lit('"}')))
             .otherwise(F.lit("")),
            F.lit("},"), repo_json, F.lit("}")))
    )
    staged = e.select(
        F.col("event_id"), F.col("user_id"), F.col("event_type"), k,
        event.alias("event"), action.alias("action"), repo.alias("repo"), raw.alias("raw"))
    payload = F.when(F.col("k") == 97, F.expr("substring(raw, 1, length(raw) - 1)")).otherwise(F.col("raw"))
    staged = staged.withColumn("payload", payload)
    bytes_ = F.encode(F.col("payload"), "UTF-8")
    k = F.col("k")
    # signature and body computed once per row, in their own projection
    signed = staged.select(
        "event_id", "user_id", "event_type", "k", "event", "payload",
        F.concat(F.lit("sha256="), F.when(k % 25 == 7, hmac_sha256_hex(WRONG_SECRET, bytes_))
                 .otherwise(hmac_sha256_hex(WEBHOOK_SECRET, bytes_))).alias("sig"))
    delivery = F.when(k == 96, F.lit("")).otherwise(F.col("event_id").cast("string"))
    event_hdr = F.when(k % 10 == 3, F.lit("ping")).otherwise(F.col("event"))
    no_sig, dup = k % 25 == 8, k % 10 == 3
    keys = F.array_compact(F.array(
        F.lit("X-GitHub-Delivery"), F.lit("X-GitHub-Event"),
        F.when(~no_sig, F.lit("X-Hub-Signature-256")), F.when(dup, F.lit("x-github-event"))))
    vals = F.array_compact(F.array(
        delivery, event_hdr, F.when(~no_sig, F.col("sig")), F.when(dup, F.col("event"))))
    is_b64 = k % 4 == 1
    env = signed.select(
        "event_id", "user_id", "event_type", "k",
        F.when(is_b64, F.base64(F.encode(F.col("payload"), "UTF-8"))).otherwise(F.col("payload")).alias("body"),
        is_b64.alias("isBase64Encoded"),
        F.map_from_arrays(keys, vals).alias("headers"),
        F.lit(0).alias("copy"),
    )
    again = env.where(F.col("event_id") % 10 == 0).withColumn("copy", F.lit(1))
    return env.unionByName(again)


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed receipts: every delivery with event_id mod 7 = 0 was already done."""
    e = read(spark, sf_dir, "events").where(F.col("event_id") % 7 == 0)
    return e.select(F.col("event_id").cast("string").alias("delivery_id"),
                    F.lit("COMPLETED").alias("state"),
                    F.col("ts").alias("completed_at"))


# ---- snapshots: prs over time ------------------------------------------------------
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prs(spark, sf_dir).select("repo", "pr_number", "state", "merged_at")
    s0 = p.select("repo", "pr_number", F.lit(0).alias("seq"), F.lit("open").alias("state"),
                  F.lit(None).cast("string").alias("merged_at"))
    s1 = p.select("repo", "pr_number", F.lit(1).alias("seq"), "state", "merged_at")
    s2 = p.where(F.col("merged_at").isNotNull() & (F.col("pr_number") % 10 == 0)).select(
        "repo", "pr_number", F.lit(2).alias("seq"), "state", "merged_at")
    return s0.unionByName(s1).unionByName(s2)


# ---- failure log: events ---------------------------------------------------------------
FAILURE_MESSAGES = [
    "unexpected EOF while reading response", "Connection reset by peer", "HTTP 404: Not Found",
    "read TIMEOUT after 60s", "gh: status 503 Service Unavailable", "Validation Failed",
    "GEOFENCE rejected", "authentication required",
]


def failure_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as failed calls: (event_id, error) with a message by k mod 8."""
    e = read(spark, sf_dir, "events").where(F.col("event_type") == "error").withColumn("k", _k())
    return e.select("event_id", _pick(FAILURE_MESSAGES, F.col("k") % 8).alias("error"))


# ---- waves: incremental mining over the notes ------------------------------------------
def wave_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing state: notes with doc_id mod 3 <> 0, curated."""
    from feedmine.operators.curate import curate
    return curate(notes(spark, sf_dir).where(F.col("github_comment_id") % 3 != 0))


def wave_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mined slices: (repo, pr_number) with pr_number mod 4 = 1."""
    return notes(spark, sf_dir).where(F.col("pr_number") % 4 == 1).select("repo", "pr_number").distinct()


def wave_incoming(spark: SparkSession, sf_dir: str, wave: int) -> DataFrame:
    """Wave 1 re-mines the slices without doc_id mod 7 = 2 (deleted feedback) and moves
    the merge time of superseding notes 700 days later; wave 2 is the same with the
    superseding notes unselected (a withdrawal)."""
    n = notes(spark, sf_dir).where((F.col("pr_number") % 4 == 1) & (F.col("github_comment_id") % 7 != 2))
    sup = F.col("supersedes_prior_architecture") & (F.col("merged_at") != "")
    n = n.withColumn("merged_at", F.when(sup, F.date_format(
        F.date_add(F.to_date("merged_at"), 700), "yyyy-MM-dd")).otherwise(F.col("merged_at")))
    n = n.withColumn("ordinal", F.col("ordinal") + 1_000_000 * wave)
    if wave == 2:
        n = n.withColumn("include_in_vector_store", F.when(
            F.col("supersedes_prior_architecture"), F.lit(False)).otherwise(F.col("include_in_vector_store")))
    return n


# ---- review context fixtures -----------------------------------------------------------
CONTEXT_BUDGET = 5_000        # lowered context budget for the tree fixture


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files per PR from lineitem: (repo, pr_number, pos, filename)."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(repo_of(F.col("l_orderkey")).alias("repo"), F.col("l_orderkey").alias("pr_number"),
                     (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("pos"),
                     F.concat(F.lit("src/p"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("filename"))


def review_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every open PR, reviewed at its repo's head (one tree per repo)."""
    p = prs(spark, sf_dir).where(F.col("state") == "open")
    t = tree(spark, sf_dir).select("repo", "head_sha").distinct()
    return p.drop("head_sha").join(t, "repo")


def posted_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing reviews on the PRs of the reviews fixture; doc_id mod 13 = 0 carries the
    marker of the PR's head (PENDING when doc_id mod 26 = 0)."""
    from feedmine.operators.review import marker
    r = reviews(spark, sf_dir)
    heads = prs(spark, sf_dir).select("repo", "pr_number", "head_sha")
    j = r.join(heads, ["repo", "pr_number"])
    did = F.col("id")
    body = F.when(did % 13 == 0, F.concat(F.coalesce("body", F.lit("")), F.lit("\n\n"), marker(F.col("head_sha")))) \
        .otherwise(F.col("body"))
    state = F.when(did % 26 == 0, F.lit("PENDING")).otherwise(F.col("state"))
    return j.select("repo", "pr_number", "id", body.alias("body"), state.alias("state"), "html_url", "item_ord")


def review_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft for every PR that has reviews, at its head; the head moved when pr mod 7 = 3."""
    ids = reviews(spark, sf_dir).select("repo", "pr_number").distinct()
    p = prs(spark, sf_dir).join(ids, ["repo", "pr_number"], "left_semi")
    drafts = p.select("repo", "pr_number", "head_sha")
    current = p.select("repo", "pr_number", F.when(F.col("pr_number") % 7 == 3, F.sha2(F.col("head_sha"), 256))
                       .otherwise(F.col("head_sha")).alias("head_sha"))
    return drafts, current


def review_query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding of each open PR's query: the embedding with vec_id = pr_number mod the
    number of embeddings, so every PR has a vector."""
    heads = review_heads(spark, sf_dir).select("repo", "pr_number")
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("query_vector"))
    n = e.count()  # one number
    keyed = heads.select("repo", "pr_number", (F.col("pr_number") % F.lit(n)).alias("vec_id"))
    return keyed.join(e, "vec_id").drop("vec_id")


def open_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current diff of an open PR: its changed files as a patch header list."""
    f = changed_files(spark, sf_dir)
    return f.groupBy("repo", "pr_number").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "filename"))),
        lambda x: F.concat(F.lit("+++ b/"), x["filename"])), "\n").alias("final_diff"))


def open_reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(reviews on open PRs, their heads now): every 11th PR has a review with the head's marker, PENDING on every
    22nd; the head has moved when pr mod 7 = 3."""
    h = review_heads(spark, sf_dir).select("repo", "pr_number", "head_sha")
    n = F.col("pr_number")
    state = F.when(n % 22 == 0, F.lit("PENDING")).otherwise(F.lit("COMMENTED"))
    posted = h.where(n % 11 == 0).select(
        "repo", "pr_number", n.alias("id"), F.concat(F.lit("seen\n\n<!-- feedmine:"), "head_sha", F.lit(" -->")).alias("body"),
        state.alias("state"), F.concat(pr_url(F.col("repo"), n), F.lit("#r")).alias("html_url"), n.alias("item_ord"))
    now = h.select("repo", "pr_number", F.when(n % 7 == 3, F.sha2("head_sha", 256)).otherwise(F.col("head_sha")).alias("head_sha"))
    return posted, now


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree listings landed as pages of 25 items: (request_id, page_no, page JSON text)."""
    p = read(spark, sf_dir, "pages")
    pid = F.col("page_id")
    item = F.struct(pid.alias("page_id"), F.concat(F.col("url"), F.lit("~"), pid.cast("string")).alias("path"),
                    F.octet_length("html").cast("long").alias("size"))
    rows = p.select(repo_of(pid).alias("request_id"), (F.expr("(page_id div 8) div 25") + 1).alias("page_no"),
                    item.alias("item"))
    return rows.groupBy("request_id", "page_no").agg(
        F.to_json(F.array_sort(F.collect_list("item"))).alias("page"))
