"""Oracle SQL (DuckDB) for the registered queries, keyed like ``catalog.QUERIES``."""

from __future__ import annotations

from feedmine.operators.rollup import CHUNK_NOTE, MERGE_NOTE
from feedmine.plans import oracle_fixtures as ofx
from feedmine.sources.testdata import TRUSTED_REVIEWERS

ORACLE: dict[str, str] = {}


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


CURATED = (ofx.NOTES, ofx.SELECTED, ofx.CUTOFFS, ofx.ACTIVE)

ORACLE["b8_selected_notes"] = _with(ofx.NOTES, ofx.SELECTED) + """
SELECT repo, github_comment_id, category, implemented, include_in_vector_store FROM selected_fx"""

ORACLE["c8_supersede"] = _with(*CURATED) + """
SELECT repo, github_comment_id, category, merged_at, supersedes_prior_architecture FROM active_fx"""

ORACLE["f1_curated_order"] = _with(*CURATED) + """
SELECT repo, github_comment_id, merged_at,
       row_number() OVER (ORDER BY coalesce(merged_at, ''), ordinal) - 1 AS merge_rank
FROM active_fx"""

ORACLE["h1_note_id"] = _with(ofx.NOTES) + f"""
SELECT github_comment_id, {ofx.NOTE_ID} AS note_id FROM notes_fx"""

ORACLE["h2_note_content"] = _with(ofx.NOTES) + f"""
SELECT github_comment_id, {ofx.NOTE_CONTENT} AS content FROM notes_fx"""

ORACLE["b9_compact_notes"] = _with(*CURATED) + """
SELECT github_comment_id, category, severity, original_issue, requested_change, rationale,
       coalesce(implementation_example, '') AS implementation_example
FROM active_fx"""

# ---- vectors --------------------------------------------------------------------------
VX = (ofx.VNOTES, ofx.VINDEX)
_IDX_OUT = "id, repo, github_comment_id, category, content, nullif(merged_at, '') AS merged_at"

ORACLE["k1_save_vectors"] = _with(*VX) + f"""
SELECT {_IDX_OUT} FROM vindex_fx WHERE pr_number % 2 = 0 AND pr_number % 3 <> 0
UNION ALL SELECT {_IDX_OUT} FROM vindex_fx WHERE pr_number % 3 = 0"""

ORACLE["k2_delete_vectors"] = _with(*VX) + f"""
SELECT {_IDX_OUT} FROM vindex_fx WHERE pr_number % 5 <> 0"""

ORACLE["k3_replace_vectors"] = _with(*VX) + f"""
SELECT {_IDX_OUT} FROM vindex_fx
WHERE (pr_number % 2 = 0 AND pr_number % 3 <> 0 AND repo NOT IN ('org/r1', 'org/r2'))
   OR pr_number % 3 = 0"""

ORACLE["k3_delta_index"] = _with(*VX) + f"""
SELECT {_IDX_OUT} FROM vindex_fx
WHERE (pr_number % 2 = 0 AND pr_number % 5 <> 0 AND repo NOT IN ('org/r1', 'org/r2')) OR pr_number % 3 = 0"""

ORACLE["k4_search"] = _with(*VX) + """,
q AS (SELECT 'org/r' || CAST(label AS VARCHAR) AS qrepo, CAST(embedding AS DOUBLE[]) AS qv
      FROM embeddings WHERE vec_id = 0),
s AS (SELECT v.*, list_cosine_similarity(v.embedding, q.qv) AS score FROM vindex_fx v, q
      WHERE v.repo = q.qrepo AND v.reviewer IN ('u0', 'u1'))
SELECT id, repo, pr_number, category, severity,
       row_number() OVER (ORDER BY score DESC, id) AS rank
FROM s QUALIFY rank <= 5"""

_K5 = _with(*VX) + """,
q AS (SELECT vec_id AS query_id, 'org/r' || CAST(label AS VARCHAR) AS qrepo,
             CAST(embedding AS DOUBLE[]) AS qv FROM embeddings),
s AS (SELECT q.query_id, v.id, v.github_comment_id,
             list_cosine_similarity(v.embedding, q.qv) AS score
      FROM vindex_fx v JOIN q ON v.repo = q.qrepo)
SELECT query_id, id, github_comment_id,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
FROM s QUALIFY rank <= 8"""
ORACLE["k5_search_many"] = _K5
ORACLE["k5_search_many_salted"] = _K5
ORACLE["k5_search_stored_cells"] = _K5

ORACLE["c4_align_embeddings"] = _with(*VX) + """,
inp AS (SELECT vec_id // 16 AS request_id, vec_id % 16 AS pos, vec_id AS github_comment_id FROM embeddings),
resp AS (SELECT vec_id // 16 AS request_id, vec_id % 16 AS idx, vec_id AS src_vec_id FROM embeddings
         WHERE NOT ((vec_id // 16) % 11 = 5 AND vec_id % 16 = 0)),
cnt AS (SELECT i.request_id, count(*) AS n_in,
               (SELECT count(*) FROM resp r WHERE r.request_id = i.request_id) AS n_out
        FROM inp i GROUP BY i.request_id)
SELECT i.request_id, i.pos, i.github_comment_id, r.src_vec_id, CAST(NULL AS VARCHAR) AS reason
FROM inp i JOIN cnt c ON c.request_id = i.request_id AND c.n_in = c.n_out
LEFT JOIN resp r ON r.request_id = i.request_id AND r.idx = i.pos
UNION ALL
SELECT request_id, NULL, NULL, NULL,
       'expected ' || CAST(n_in AS VARCHAR) || ' vectors, got ' || CAST(n_out AS VARCHAR)
FROM cnt WHERE n_in <> n_out"""

# ---- feedback -------------------------------------------------------------------------
FBX = (ofx.PRS, ofx.THREADS, ofx.REVIEWS, ofx.ISSUE_COMMENTS, ofx.FEEDBACK)

ORACLE["b1_merged_prs"] = _with(ofx.PRS) + """
SELECT repo, pr_number, merged_at, updated_at FROM prs_fx
WHERE coalesce(merged_at, '') <> '' AND updated_at >= '1995-06-01'"""

ORACLE["b2_normalize_reviewers"] = _with(ofx.THREADS) + """,
n AS (SELECT regexp_replace(CASE WHEN pr_number % 3 = 0 THEN upper(login)
                       WHEN pr_number % 3 = 1 THEN '  ' || login || ' ' ELSE login END, '^\\s+|\\s+$', '', 'g') AS name,
             id AS ordinal FROM threads_fx)
SELECT arg_min(name, ordinal) AS name, min(ordinal) AS ordinal FROM n
WHERE coalesce(name, '') <> '' GROUP BY lower(name)"""

ORACLE["b3_trusted_only"] = _with(ofx.THREADS) + f"""
SELECT id, login FROM threads_fx WHERE lower(coalesce(login, '')) IN {ofx.TRUSTED_IN}"""

ORACLE["b4_eligible_reviews"] = _with(ofx.REVIEWS) + f"""
SELECT id, state, login FROM reviews_fx
WHERE state IS DISTINCT FROM 'DISMISSED' AND coalesce(body, '') <> '' AND lower(login) IN {ofx.TRUSTED_IN}"""

ORACLE["b5_normalize_feedback"] = "WITH RECURSIVE " + ",".join(FBX + (ofx.WALK,)) + """
SELECT f.repo, f.pr_number, f.github_comment_id, f.comment_type, f.pr_title, f.pr_url, f.pr_state,
       f.file_path, f.diff_hunk, f.review_state, f.created_at, f.html_url, f.reviewer, f.body, f.merged_at,
       CASE WHEN f.comment_type = 'review_comment'
            THEN (SELECT count(*) FROM walk w WHERE w.root_id = f.github_comment_id) ELSE 0 END AS n_replies
FROM feedback_fx f"""

ORACLE["b6_pr_state"] = _with(ofx.PRS) + """
SELECT repo, pr_number,
       CASE WHEN coalesce(merged_at, '') <> '' THEN 'merged' ELSE coalesce(state, 'open') END AS pr_state
FROM prs_fx"""

ORACLE["b7_guard_diffs"] = """
SELECT 'org/r' || CAST(doc_id % 8 AS VARCHAR) AS repo, doc_id AS pr_number,
       CASE WHEN doc_id % 50 = 7 THEN 'empty final diff'
            WHEN length(text) > 5000
            THEN 'final diff is ' || CAST(length(text) AS VARCHAR) || ' characters; maximum supported is 5000'
       END AS reason
FROM documents"""

ORACLE["c1_pr_attributes"] = _with(*FBX, ofx.PR_DIFFS) + """
SELECT f.comment_type, f.github_comment_id, f.pr_title, f.pr_url, f.pr_state, f.merged_at,
       CASE WHEN f.pr_state = 'merged' THEN coalesce(d.final_diff, '') ELSE '' END AS final_diff
FROM feedback_fx f LEFT JOIN pr_diffs_fx d ON d.repo = f.repo AND d.pr_number = f.pr_number"""

ORACLE["c2_attach_replies"] = "WITH RECURSIVE " + ",".join((ofx.THREADS, """
roots_fx AS (SELECT * FROM threads_fx
             WHERE in_reply_to_id IS NULL AND lower(coalesce(login, '')) IN ('u0', 'u1', 'u2'))""",
                                                          ofx.WALK)) + """
SELECT root_id, row_number() OVER (PARTITION BY root_id ORDER BY depth, path) - 1 AS reply_pos,
       node AS reply_id, author
FROM walk"""

ORACLE["g1_feedback_union"] = _with(*FBX) + """
SELECT repo, pr_number, comment_type, count(*) AS n FROM feedback_fx GROUP BY ALL"""

ORACLE["e1_with_ordinal"] = _with(*FBX) + """
SELECT comment_type, github_comment_id, ordinal FROM ordered_fx"""

ORACLE["e2_assign_batches"] = _with(*FBX) + """
SELECT comment_type, github_comment_id, ordinal // 8 AS batch_id, ordinal % 8 AS pos FROM ordered_fx"""

ORACLE["d2_check_feedback_cap"] = _with(*FBX) + """
SELECT repo, pr_number, count(*) AS n FROM feedback_fx GROUP BY ALL HAVING count(*) > 8"""

ORACLE["a3_merged_evidence"] = _with(ofx.PRS, ofx.PR_DIFFS) + """
SELECT p.repo, p.pr_number, p.title, p.merged_at, CAST(length(d.final_diff) AS BIGINT) AS diff_chars
FROM prs_fx p JOIN pr_diffs_fx d ON d.repo = p.repo AND d.pr_number = p.pr_number
WHERE coalesce(p.merged_at, '') <> ''"""

# ---- annotation -------------------------------------------------------------------------
ANX = "WITH RECURSIVE " + ",".join(FBX + (ofx.PR_DIFFS, ofx.WALK_BODY, ofx.ROOT_BATCHES)) + "\n"

ORACLE["h3_thread_prompt"] = ANX + "SELECT github_comment_id, batch_id, pos, text FROM rtext_fx"

ORACLE["d1_distinct_pr_diffs"] = ANX + """
SELECT batch_id, repo, pr_number, first_pos, CAST(length(final_diff) AS BIGINT) AS diff_chars FROM d1_fx"""

ORACLE["h4_batch_prompts"] = ANX + """
SELECT batch_id, n_items, sha256(prompt) AS prompt_sha, CAST(length(prompt) AS BIGINT) AS prompt_chars
FROM prompt_fx"""

ORACLE["h5_architecture_prompts"] = _with(ofx.PRS, ofx.PR_DIFFS) + """
SELECT p.repo, p.pr_number,
       sha256('Repository: ' || p.repo || chr(10) || 'PR #' || CAST(p.pr_number AS VARCHAR) || ': ' || p.title
              || chr(10) || 'Description:' || chr(10) || coalesce(p.body, '') || chr(10) || chr(10)
              || 'Final merged diff:' || chr(10) || d.final_diff) AS prompt_sha
FROM prs_fx p JOIN pr_diffs_fx d ON d.repo = p.repo AND d.pr_number = p.pr_number
WHERE coalesce(p.merged_at, '') <> ''"""

ORACLE["h12_response_object"] = ANX + """
SELECT batch_id, attempt, kind <> 'blank' AS is_object,
       CASE WHEN kind = 'blank' THEN 'empty model answer' END AS error
FROM attempts_fx"""

ORACLE["j2_replay"] = ANX + """
SELECT batch_id, attempt FROM attempts_fx"""

ORACLE["c3_pair_items"] = ANX + """
SELECT batch_id, attempt,
       CASE WHEN kind IN ('ok', 'critical') THEN n_items ELSE 0 END AS n_paired,
       CASE WHEN kind = 'short' THEN 'got ' || CAST(n_items - 1 AS VARCHAR) || ' items, expected '
                                     || CAST(n_items AS VARCHAR)
            WHEN kind = 'blank' THEN 'empty model answer' END AS reason
FROM attempts_fx"""

ORACLE["h10_validate_items"] = ANX + """
SELECT a.batch_id, a.attempt, b.pos,
       CASE WHEN a.kind = 'critical' AND b.pos = 0 THEN 'unknown severity ''critical''' ELSE '' END AS errors
FROM attempts_fx a JOIN rb_fx b ON b.batch_id = a.batch_id
WHERE a.kind IN ('ok', 'critical')"""

ORACLE["e4_accept_attempts"] = ANX + """
SELECT batch_id, CAST(min(CASE WHEN kind = 'ok' THEN attempt END) AS INTEGER) AS attempt
FROM attempts_fx GROUP BY batch_id"""

ORACLE["j2_replay_notes"] = ANX + f"""
SELECT b.repo, b.pr_number, b.github_comment_id, b.pr_title, b.pr_url, b.comment_type, b.file_path,
       b.body AS original_body,
       ({ofx.CATS})[b.ordinal % 13 + 1] AS category,
       'issue ' || CAST(b.github_comment_id AS VARCHAR) AS original_issue,
       'change ' || CAST(b.github_comment_id AS VARCHAR) AS requested_change,
       'rationale ' || CAST(b.github_comment_id AS VARCHAR) AS rationale,
       ({ofx.SEVS})[b.ordinal % 3 + 1] AS severity,
       b.reviewer,
       b.ordinal % 4 <> 0 AS implemented,
       b.ordinal % 4 <> 0 AND b.ordinal % 5 <> 0 AS include_in_vector_store,
       'selection ' || CAST(b.github_comment_id AS VARCHAR) AS selection_rationale,
       CASE WHEN b.ordinal % 4 <> 0 AND b.ordinal % 5 <> 0 THEN 'example ' || CAST(b.github_comment_id AS VARCHAR)
            ELSE '' END AS implementation_example,
       b.ordinal % 13 = 1 AS architecture_change,
       b.ordinal % 13 = 1 AND b.ordinal % 2 = 0 AS supersedes_prior_architecture,
       b.merged_at
FROM rb_fx b WHERE b.batch_id % 8 <> 6"""

ORACLE["h11_architecture_notes"] = _with(ofx.PRS) + """,
m AS (SELECT *, pr_number % 3 = 0 AS chg, pr_number % 4 <> 1 AS imp,
             CASE WHEN pr_number % 11 = 3 THEN true
                  ELSE pr_number % 3 = 0 AND pr_number % 4 <> 1 AND pr_number % 5 <> 0 END AS inc
      FROM prs_fx WHERE coalesce(merged_at, '') <> ''),
v AS (SELECT *, concat_ws('; ',
          CASE WHEN pr_number % 13 = 4 THEN 'assessment rationale: text expected' END,
          CASE WHEN inc AND NOT (chg AND imp)
               THEN 'assessment keeps a decision that is not implemented' END) AS reason
      FROM m)
SELECT pr_number, -pr_number AS github_comment_id,
       coalesce(nullif(body, ''), 'summary ' || CAST(pr_number AS VARCHAR)) AS original_body,
       'summary ' || CAST(pr_number AS VARCHAR) AS original_issue,
       'arch rationale ' || CAST(pr_number AS VARCHAR) AS rationale,
       chg AND pr_number % 7 = 0 AS supersedes_prior_architecture,
       merged_at, CAST(NULL AS VARCHAR) AS reason
FROM v WHERE reason = '' AND inc
UNION ALL
SELECT pr_number, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM v WHERE reason <> ''"""

# ---- events ----------------------------------------------------------------------------
ORACLE["h8_decode_envelope"] = _with(ofx.DELIVERIES) + """
SELECT event_id, copy, CASE WHEN k = 96 THEN '' ELSE CAST(event_id AS VARCHAR) END AS delivery_id, event,
       CAST(octet_length(encode(
         CASE WHEN event = 'pull_request' THEN '{"action":"' || action || '","number":' || CAST(user_id AS VARCHAR)
                || ',"pull_request":{"number":' || CAST(user_id AS VARCHAR) || CASE WHEN k = 98 THEN '.0' ELSE '' END
                || '},"repository":{"full_name":"' || repo || '"}}'
              WHEN event = 'pull_request_review_comment' THEN '{"action":"created","pull_request":{"number":'
                || CAST(user_id AS VARCHAR) || CASE WHEN k = 98 THEN '.0' ELSE '' END
                || '},"repository":{"full_name":"' || repo || '"}}'
              ELSE '{"action":"created","issue":{"number":' || CAST(user_id AS VARCHAR)
                || CASE WHEN k = 98 THEN '.0' ELSE '' END
                || CASE WHEN k % 2 = 0 THEN ',"pull_request":{"url":"https://example.test/' || repo || '/pull/'
                                            || CAST(user_id AS VARCHAR) || '"}' ELSE '' END
                || '},"repository":{"full_name":"' || repo || '"}}' END)) - CASE WHEN k = 97 THEN 1 ELSE 0 END
         AS BIGINT) AS body_bytes
FROM out_fx"""

ORACLE["h7_verify_hmac"] = _with(ofx.DELIVERIES) + """
SELECT event_id, copy, k % 25 NOT IN (7, 8) AS valid FROM out_fx"""

ORACLE["h9_extract_job"] = _with(ofx.DELIVERIES) + """
SELECT event_id, copy, status,
       CASE WHEN status = 202 AND routed THEN CASE WHEN event_type = 'signup' THEN 'review' ELSE 'mining' END END AS work_type,
       CASE WHEN status = 202 AND routed THEN repo END AS repo,
       CASE WHEN status = 202 AND routed THEN user_id END AS pr_number
FROM out_fx"""

ORACLE["c5_route_deliveries"] = _with(ofx.DELIVERIES) + """
SELECT version, delivery_id, work_type, event, action, repo, pr_number FROM jobs_fx"""

ORACLE["c6_pending_jobs"] = _with(ofx.DELIVERIES) + """
SELECT delivery_id, work_type, pr_number FROM jobs_fx WHERE CAST(delivery_id AS BIGINT) % 7 <> 0"""

ORACLE["b12_valid_jobs"] = _with(ofx.DELIVERIES) + """
SELECT delivery_id, work_type, repo,
       CASE WHEN k = 99 OR repo <> 'org/r0' THEN 'fail'
            WHEN CAST(delivery_id AS BIGINT) % 7 = 0 THEN 'skip'
            WHEN work_type <> 'mining' THEN 'fail' ELSE 'dispatch' END AS decision,
       CASE WHEN k = 99 THEN 'unsupported webhook job version'
            WHEN repo <> 'org/r0' THEN 'webhook repository is not configured for this deployment'
            WHEN CAST(delivery_id AS BIGINT) % 7 = 0 THEN NULL
            WHEN work_type <> 'mining' THEN 'work type ''' || work_type || ''' is not allowed in this worker'
       END AS reason
FROM jobs_fx"""

ORACLE["a10_write_jobs"] = _with(ofx.DELIVERIES) + """
SELECT work_type, delivery_id, event, action, repo, pr_number FROM jobs_fx"""

ORACLE["b13_classify_failures"] = """
SELECT event_id,
       (['unexpected EOF while reading response', 'Connection reset by peer', 'HTTP 404: Not Found',
         'read TIMEOUT after 60s', 'gh: status 503 Service Unavailable', 'Validation Failed',
         'GEOFENCE rejected', 'authentication required'])[CAST(json_extract_string(props, '$.k') AS INTEGER) % 8 + 1] AS error,
       CAST(json_extract_string(props, '$.k') AS INTEGER) % 8 IN (0, 1, 3, 4, 6) AS retryable
FROM events WHERE event_type = 'error'"""

# ---- incremental ------------------------------------------------------------------------
WV = _with(ofx.NOTES, ofx.WAVES)

ORACLE["g2_replace_slice"] = WV + """
SELECT repo, pr_number, github_comment_id FROM state_fx
WHERE (repo, pr_number) NOT IN (SELECT (repo, pr_number) FROM keys_fx)
UNION ALL SELECT repo, pr_number, github_comment_id FROM inc1_fx"""

ORACLE["g2_delta_slices"] = ORACLE["g2_replace_slice"]

ORACLE["c7_removed_notes"] = WV + """
SELECT DISTINCT repo, pr_number, github_comment_id, category FROM state_fx s
WHERE ((repo, pr_number) IN (SELECT (repo, pr_number) FROM keys_fx)
       OR (category = 'architecture' AND repo IN (SELECT repo FROM keys_fx)))
  AND (repo, github_comment_id) NOT IN (SELECT (repo, github_comment_id) FROM act1_fx)"""

ORACLE["i5_mine"] = WV + "SELECT repo, pr_number, github_comment_id FROM act1_fx"

ORACLE["i5_mine_current"] = WV + """
SELECT repo, pr_number, github_comment_id FROM inc1_fx
WHERE (repo, github_comment_id) IN (SELECT (repo, github_comment_id) FROM act1_fx)"""

ORACLE["i5_mine_withdrawal"] = WV + "SELECT repo, pr_number, github_comment_id FROM act2_fx"

ORACLE["g3_update_pending"] = _with(ofx.PRS) + """
SELECT repo, pr_number, CASE WHEN merged_at IS NOT NULL THEN 'mine' ELSE 'pending' END AS status
FROM prs_fx WHERE merged_at IS NOT NULL OR state = 'open'"""

_ARCH_V = """
m AS (SELECT *, pr_number % 3 = 0 AS chg, pr_number % 4 <> 1 AS imp,
             CASE WHEN pr_number % 11 = 3 THEN true
                  ELSE pr_number % 3 = 0 AND pr_number % 4 <> 1 AND pr_number % 5 <> 0 END AS inc
      FROM prs_fx WHERE coalesce(merged_at, '') <> ''),
v AS (SELECT *, pr_number % 13 <> 4 AND NOT (inc AND NOT (chg AND imp)) AS ok FROM m)"""

ORACLE["g4_all_notes"] = ANX.rstrip("\n") + "," + _ARCH_V + f"""
SELECT repo, pr_number, github_comment_id, comment_type, ({ofx.CATS})[ordinal % 13 + 1] AS category, 0 AS kind
FROM rb_fx WHERE batch_id % 8 <> 6
UNION ALL
SELECT repo, pr_number, -pr_number, 'pull_request_architecture', 'architecture', 1 FROM v WHERE ok AND inc"""

ORACLE["j1_annotate"] = ANX + f"""
SELECT repo, pr_number, github_comment_id, comment_type, ({ofx.CATS})[length(text) % 13 + 1] AS category,
       ({ofx.SEVS})[length(text) % 3 + 1] AS severity, sha256(text) AS original_issue
FROM rtext_fx"""

# ---- streaming --------------------------------------------------------------------------
ORACLE["i1_delivery_stream"] = ORACLE["h9_extract_job"]

ORACLE["i2_dispatch"] = _with(ofx.DELIVERIES) + """
SELECT delivery_id, CAST(delivery_id AS BIGINT) % 9 <> 4 AS ok, CAST(copy AS BIGINT) AS batch_id
FROM (SELECT DISTINCT delivery_id, copy FROM jobs_fx) j
WHERE CAST(delivery_id AS BIGINT) % 7 <> 0
  AND (copy = 0 OR CAST(delivery_id AS BIGINT) % 9 = 4)"""

ORACLE["i3_split_failures"] = _with(ofx.DELIVERIES) + """
SELECT delivery_id,
       CAST(CASE CAST(delivery_id AS BIGINT) % 9 WHEN 4 THEN 5 WHEN 5 THEN 3 ELSE 1 END AS BIGINT) AS receives,
       CASE WHEN CAST(delivery_id AS BIGINT) % 9 = 4 THEN 'dead' ELSE 'done' END AS status
FROM (SELECT DISTINCT delivery_id FROM jobs_fx)"""

ORACLE["i3_retry_stream"] = _with(ofx.DELIVERIES) + """
SELECT delivery_id,
       CAST(CASE CAST(delivery_id AS BIGINT) % 9 WHEN 4 THEN 5 WHEN 5 THEN 3 ELSE 1 END AS BIGINT) AS receives,
       CASE WHEN CAST(delivery_id AS BIGINT) % 9 = 4 THEN 'dead' ELSE 'done' END AS status,
       CASE WHEN CAST(delivery_id AS BIGINT) % 9 = 4 THEN 'RuntimeError: receive 5 failed' END AS error
FROM (SELECT DISTINCT delivery_id FROM jobs_fx)"""

ORACLE["i4_pending_until_merged"] = _with(ofx.PRS) + """
SELECT repo, pr_number, CAST(0 AS BIGINT) AS seq, 'pending' AS action FROM prs_fx
UNION ALL
SELECT repo, pr_number, 1, CASE WHEN merged_at IS NOT NULL THEN 'mine' ELSE 'forget' END
FROM prs_fx WHERE merged_at IS NOT NULL OR state = 'closed'
UNION ALL
SELECT repo, pr_number, 2, 'mine' FROM prs_fx WHERE merged_at IS NOT NULL AND pr_number % 10 = 0"""

# ---- review context ---------------------------------------------------------------------
ORACLE["b10_tree_blobs"] = _with(ofx.TREE) + """
SELECT repo, path, size, CAST(NULL AS VARCHAR) AS reason FROM blobs_fx
UNION ALL SELECT repo, NULL, NULL, 'repository tree was truncated' FROM bad_heads"""

ORACLE["b11_selectable"] = _with(ofx.TREE) + """
SELECT repo, path, size, CAST(NULL AS VARCHAR) AS reason FROM manifest_fx
UNION ALL
SELECT repo, NULL, NULL,
       CASE WHEN n > 20000 THEN 'repository tree has ' || CAST(n AS VARCHAR) || ' files; maximum supported is 20000'
            ELSE 'repository tree is ' || CAST(chars AS VARCHAR) || ' characters; maximum supported is 7000' END
FROM head_stats WHERE n > 20000 OR chars > 7000"""

ORACLE["h13_validate_selection"] = _with(ofx.PRS, ofx.TREE, ofx.OPEN, ofx.SELECTIONS, ofx.BLOBS, ofx.CONTEXT) + \
    "SELECT repo, pr_number, reason FROM checks_fx"

ORACLE["h15_review_query"] = _with(ofx.PRS) + """,
names AS (SELECT 'org/r' || CAST(l_orderkey % 8 AS VARCHAR) AS repo, l_orderkey AS pr_number,
                 string_agg('src/p' || CAST(l_partkey AS VARCHAR) || '.py', ' '
                            ORDER BY l_linenumber * 1000000 + l_partkey) AS names
          FROM lineitem GROUP BY ALL),
q AS (SELECT p.repo, p.pr_number,
             coalesce(p.title, '') || chr(10) || coalesce(p.body, '') || chr(10) || coalesce(n.names, '') AS t
      FROM prs_fx p LEFT JOIN names n ON n.repo = p.repo AND n.pr_number = p.pr_number)
SELECT repo, pr_number, sha256(t) AS query_sha, CAST(length(t) AS BIGINT) AS query_chars FROM q"""

ORACLE["h17_with_marker"] = _with(ofx.PRS) + """
SELECT pr_number, sha256(coalesce(body, '') || chr(10) || chr(10) || '<!-- feedmine:' || head_sha || ' -->')
       AS published_sha FROM prs_fx"""

ORACLE["c9_plan_review_posts"] = _with(ofx.PRS, ofx.REVIEWS) + """,
pr_ids AS (SELECT DISTINCT repo, pr_number FROM reviews_fx),
drafts AS (SELECT p.repo, p.pr_number, p.head_sha,
                  CASE WHEN p.pr_number % 7 = 3 THEN sha256(p.head_sha) ELSE p.head_sha END AS cur
           FROM prs_fx p JOIN pr_ids USING (repo, pr_number)),
marked AS (SELECT r.repo, r.pr_number, r.id, r.html_url, r.item_ord,
                  CASE WHEN r.id % 26 = 0 THEN 'PENDING' ELSE r.state END AS state
           FROM reviews_fx r WHERE r.id % 13 = 0),
fp AS (SELECT repo, pr_number, arg_min(html_url, item_ord) AS url, min(item_ord) AS ord
       FROM marked WHERE coalesce(state, '') <> 'PENDING' GROUP BY ALL)
SELECT m.repo, m.pr_number, 'delete' AS action, m.id AS review_id, CAST(NULL AS VARCHAR) AS url
FROM marked m LEFT JOIN fp ON fp.repo = m.repo AND fp.pr_number = m.pr_number
WHERE m.state = 'PENDING' AND (fp.ord IS NULL OR m.item_ord < fp.ord)
UNION ALL
SELECT d.repo, d.pr_number, 'skip', NULL, fp.url FROM drafts d JOIN fp USING (repo, pr_number)
UNION ALL
SELECT d.repo, d.pr_number, 'create', NULL, NULL FROM drafts d
WHERE (d.repo, d.pr_number) NOT IN (SELECT (repo, pr_number) FROM fp)
UNION ALL
SELECT d.repo, d.pr_number, CASE WHEN d.cur = d.head_sha THEN 'submit' ELSE 'delete_created_and_fail' END, NULL, NULL
FROM drafts d WHERE (d.repo, d.pr_number) NOT IN (SELECT (repo, pr_number) FROM fp)"""

ORACLE["h14_decode_blobs"] = _with(ofx.BLOBS) + """
SELECT sha, status, CASE WHEN status = 'ok' THEN CAST(length(html) AS BIGINT) END AS text_chars FROM blobdec_fx"""

ORACLE["e3_within_budget"] = _with(ofx.PRS, ofx.TREE, ofx.OPEN, ofx.SELECTIONS, ofx.BLOBS, ofx.CONTEXT) + """
SELECT repo, pr_number, CAST(length(context) AS BIGINT) AS context_chars, reason FROM context_fx"""

ORACLE["i6_review_context"] = _with(ofx.PRS, *VX, ofx.TREE, ofx.OPEN, ofx.SELECTIONS, ofx.BLOBS, ofx.CONTEXT, ofx.EVIDENCE,
                                    ofx.REVIEW_INPUT) + """
SELECT repo, pr_number, n_evidence, CAST(context_chars AS BIGINT) AS context_chars,
       CAST(length(prompt) AS BIGINT) AS prompt_chars, reason FROM input_fx"""

ORACLE["i6_selection_prompts"] = _with(ofx.PRS, *VX, ofx.TREE, ofx.OPEN, ofx.EVIDENCE, ofx.SELECTION_PROMPT) + """
SELECT repo, pr_number, sha256(prompt) AS prompt_sha, CAST(length(prompt) AS BIGINT) AS prompt_chars,
       CAST(NULL AS VARCHAR) AS reason FROM ask_fx"""

ORACLE["i6_review_job"] = _with(ofx.PRS, *VX, ofx.TREE, ofx.OPEN, ofx.EVIDENCE, ofx.MODEL_SELECTIONS, ofx.BLOBS, ofx.CONTEXT,
                                ofx.REVIEW_INPUT) + """,
drafts AS (
  SELECT repo, pr_number, head_sha, sha256(prompt) AS draft,
         coalesce(reason, CASE WHEN pr_number % 7 = 3 THEN 'the head moved during the review' END) AS reason
  FROM input_fx
)
SELECT repo, pr_number,
       CASE WHEN reason IS NULL
            THEN sha256('review ' || draft || chr(10) || chr(10) || '<!-- feedmine:' || head_sha || ' -->') END AS review_sha,
       reason,
       CASE WHEN reason IS NOT NULL THEN NULL WHEN pr_number % 22 = 0 THEN 'delete,create,submit'
            WHEN pr_number % 11 = 0 THEN 'skip' ELSE 'create,submit' END AS steps
FROM drafts"""

ORACLE["i6_review_evidence"] = _with(ofx.PRS, *VX) + """,
heads AS (SELECT repo, pr_number FROM prs_fx WHERE state = 'open' AND repo IN (SELECT DISTINCT 'org/r' || CAST(page_id % 8 AS VARCHAR) FROM pages)),
q AS (SELECT h.repo || '#' || CAST(h.pr_number AS VARCHAR) AS query_id, h.repo AS qrepo,
             CAST(e.embedding AS DOUBLE[]) AS qv
      FROM heads h JOIN embeddings e ON e.vec_id = h.pr_number % (SELECT count(*) FROM embeddings)),
s AS (SELECT q.query_id, v.id, v.github_comment_id, list_cosine_similarity(v.embedding, q.qv) AS score
      FROM vindex_fx v JOIN q ON v.repo = q.qrepo
      WHERE v.reviewer IN ('U0', 'u1', 'u2', '__merged_pr__'))
SELECT query_id, github_comment_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
FROM s QUALIFY rank <= 8"""

ORACLE["h6_json_prompts"] = _with(ofx.PRS) + """,
j AS (SELECT pr_number, '{"repository":"' || repo || '","pull_request":' || CAST(pr_number AS VARCHAR)
             || ',"title":"' || title || '","description":"' || coalesce(body, '') || '"}' AS t FROM prs_fx)
SELECT pr_number, CAST(length(t) AS BIGINT) AS prompt_chars,
       CASE WHEN length(t) > 120 THEN 'review model input is ' || CAST(length(t) AS VARCHAR)
            || ' characters; maximum supported is 120' END AS reason
FROM j"""

# ---- roll-ups and sources -----------------------------------------------------------------
ORACLE["a5_notes_report"] = _with(*CURATED) + """,
lines AS (SELECT *, '- **[' || category || ' / ' || severity || ']** ' || coalesce(nullif(file_path, ''), '(general)')
                    || chr(10) || '  - Original: ' || original_issue || chr(10) || '  - Requested: ' || requested_change
                    || chr(10) || '  - Why: ' || rationale || chr(10) AS line FROM active_fx),
blocks AS (SELECT repo, pr_number, min(ordinal) AS pr_ord,
                  '### PR #' || CAST(pr_number AS VARCHAR) || ': ' || arg_min(pr_title, ordinal) || chr(10) || chr(10)
                  || string_agg(line, chr(10) ORDER BY ordinal) || chr(10) AS block
           FROM lines GROUP BY repo, pr_number),
ro AS (SELECT repo, min(ordinal) AS repo_ord FROM active_fx GROUP BY repo)
SELECT b.repo, b.pr_number, sha256(b.block) AS block_sha, CAST(length(b.block) AS BIGINT) AS block_chars,
       ro.repo_ord, b.pr_ord
FROM blocks b JOIN ro USING (repo)"""

ORACLE["d3_skill_bands"] = _with(*CURATED) + """
SELECT category, sha256(trim(regexp_replace(lower(requested_change), '\\s+', ' ', 'g'))) AS item_sha,
       arg_min(requested_change, ordinal) AS instruction, count(*) AS support,
       bool_or(severity = 'blocking') AS blocking
FROM active_fx GROUP BY category, trim(regexp_replace(lower(requested_change), '\\s+', ' ', 'g'))"""

ORACLE["a6_write_skill"] = _with(*CURATED) + """,
bands AS (
  SELECT category, arg_min(requested_change, ordinal) AS instruction, count(*) AS support, bool_or(severity = 'blocking') AS blocking
  FROM active_fx GROUP BY category, trim(regexp_replace(lower(requested_change), '\\s+', ' ', 'g')))
SELECT '- [' || category || '] ' || trim(regexp_replace(instruction, '\\s+', ' ', 'g')) || ' (support ' || support || ')'
       || CASE WHEN blocking THEN ' blocking' ELSE '' END AS line
FROM bands"""

_SYNTHESIS = _with(*CURATED) + """,
o AS (SELECT *, row_number() OVER (ORDER BY coalesce(merged_at, ''), github_comment_id) - 1 AS n FROM active_fx),
c AS (
  SELECT n // 400 AS chunk_id, count(*) AS n_notes,
         string_agg(to_json({'category': category, 'severity': severity, 'original_issue': original_issue,
                             'requested_change': requested_change, 'rationale': rationale,
                             'implementation_example': coalesce(implementation_example, '')}), ',' ORDER BY n) AS notes
  FROM o GROUP BY n // 400),
p AS (
  SELECT chunk_id, n_notes, 'Trusted reviewer GitHub usernames: REVIEWERS' || chr(10) || 'Total review notes: ' || n_notes
         || chr(10) || chr(10) || 'Notes (JSON array):' || chr(10) || '[' || notes || ']' AS prompt
  FROM c)""".replace("REVIEWERS", ", ".join(TRUSTED_REVIEWERS))

ORACLE["h16_synthesis_prompts"] = _SYNTHESIS + """
SELECT chunk_id, n_notes, sha256(prompt) AS prompt_sha FROM p"""

# The stand-in model answers with a hash of what it is given. Up to 50 chunks meet in one merge call.
ORACLE["j3_synthesize"] = _SYNTHESIS + f""",
t AS (SELECT chunk_id, 'summary ' || substr(sha256('system' || CASE WHEN (SELECT count(*) FROM p) > 1 THEN '{CHUNK_NOTE}' ELSE '' END
                                                   || prompt), 1, 16) AS text FROM p),
m AS (SELECT count(*) AS n, min(text) AS one, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_id) AS texts FROM t)
SELECT CASE WHEN n > 1 THEN n + 1 ELSE n END AS calls,
       CASE WHEN n = 1 THEN one ELSE 'summary ' || substr(sha256('system' || 'Trusted reviewer GitHub usernames: {", ".join(TRUSTED_REVIEWERS)}'
            || chr(10) || chr(10) || '{MERGE_NOTE}' || chr(10) || chr(10) || texts), 1, 16) END AS text
FROM m"""

ORACLE["d4_exact_duplicates"] = """
WITH n AS (SELECT doc_id, lang, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, h) AS rep FROM n"""

ORACLE["d4_merge_similar"] = """
WITH RECURSIVE n AS (
  SELECT doc_id, lang, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents),
e AS (SELECT doc_id, lang, t, min(doc_id) OVER (PARTITION BY lang, sha256(t)) AS rep FROM n),
w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(t, '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w
      FROM e WHERE doc_id = rep),
g AS (SELECT doc_id, lang, list_distinct(list_transform(range(1, len(w) - 1),
             lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 3),
x AS (SELECT doc_id, lang, len(s) AS size, unnest(s) AS tok FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.size) AS sa, any_value(b.size) AS sb
      FROM x a JOIN x b ON a.lang = b.lang AND a.tok = b.tok AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE shared / (sa + sb - shared) >= CAST(0.7 AS DOUBLE)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM w UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT node, min(reach) AS least FROM r GROUP BY 1)
SELECT e.doc_id, c.least AS rep FROM e JOIN c ON c.node = e.rep"""

ORACLE["d5_run_summary"] = _with(*FBX, *CURATED) + """
SELECT 'feedback' AS name, count(*) AS value FROM feedback_fx
UNION ALL SELECT 'notes_all', count(*) FROM notes_fx
UNION ALL SELECT 'selected', count(*) FROM selected_fx
UNION ALL SELECT 'active', count(*) FROM active_fx
UNION ALL SELECT 'indexed', count(*) FROM embeddings"""

ORACLE["d5_committed_counters"] = _with(*FBX, *CURATED) + """
SELECT 'raw_comments.rows' AS name, count(*) AS value FROM feedback_fx
UNION ALL SELECT 'notes_all.rows', count(*) FROM notes_fx
UNION ALL SELECT 'notes_all.selected', count(*) FROM selected_fx
UNION ALL SELECT 'notes.rows', count(*) FROM active_fx
UNION ALL SELECT 'vectors.rows', count(*) FROM embeddings"""

ORACLE["a1_read_pages"] = """
SELECT 'org/r' || CAST(page_id % 8 AS VARCHAR) AS request_id, (page_id // 8) // 25 + 1 AS page_no,
       row_number() OVER (PARTITION BY page_id % 8, (page_id // 8) // 25 ORDER BY page_id) - 1 AS item_pos,
       page_id, url || '~' || CAST(page_id AS VARCHAR) AS path, CAST(octet_length(encode(html)) AS BIGINT) AS size
FROM pages"""

ORACLE["a2_feedback_roundtrip"] = "WITH RECURSIVE " + ",".join(FBX + (ofx.PR_DIFFS, ofx.WALK)) + """
SELECT f.repo, f.pr_number, f.github_comment_id, f.comment_type, f.reviewer,
       CASE WHEN f.pr_state = 'merged' THEN coalesce(d.final_diff, '') ELSE '' END AS final_diff,
       CASE WHEN f.comment_type = 'review_comment'
            THEN (SELECT count(*) FROM walk w WHERE w.root_id = f.github_comment_id) ELSE 0 END AS n_replies,
       o.ordinal
FROM feedback_fx f JOIN ordered_fx o ON o.comment_type = f.comment_type AND o.github_comment_id = f.github_comment_id
LEFT JOIN pr_diffs_fx d ON d.repo = f.repo AND d.pr_number = f.pr_number"""

ORACLE["a4_notes_tables"] = _with(*CURATED) + """
SELECT 'notes_all' AS "table", github_comment_id FROM notes_fx
UNION ALL SELECT 'notes_active', github_comment_id FROM active_fx"""

ORACLE["a8_publish_snapshot"] = _with(ofx.NOTES, ofx.WAVES) + """
SELECT repo, pr_number, github_comment_id FROM state_fx"""

ORACLE["a9_run_stage"] = ORACLE["a8_publish_snapshot"]

ORACLE["i5_stream_mine"] = ORACLE["i5_mine"]

ORACLE["a7_read_state"] = _with(*FBX, ofx.NOTES, ofx.WAVES) + """
SELECT 'raw_comments' AS "table", count(*) AS count FROM feedback_fx
UNION ALL SELECT 'notes', count(*) FROM state_fx
UNION ALL SELECT 'pending_prs', count(*) FROM prs_fx WHERE merged_at IS NULL AND state = 'open'"""

# ---- the whole jobs -----------------------------------------------------------------------------
def _history(kept: str, pending: str) -> str:
    """All state tables after PRs with ``kept`` were analysed."""
    return ANX.rstrip("\n") + f""",
over_fx AS (SELECT repo, pr_number FROM feedback_fx GROUP BY ALL HAVING count(*) > 8),
ev_fx AS (
  SELECT p.repo, p.pr_number, p.merged_at, o.pr_number IS NOT NULL AS over,
         length('Repository: ' || p.repo || chr(10) || 'PR #' || CAST(p.pr_number AS VARCHAR) || ': ' || p.title
                || chr(10) || 'Description:' || chr(10) || coalesce(p.body, '') || chr(10) || chr(10)
                || 'Final merged diff:' || chr(10) || d.final_diff) AS n
  FROM prs_fx p JOIN pr_diffs_fx d ON d.repo = p.repo AND d.pr_number = p.pr_number
  LEFT JOIN over_fx o ON o.repo = p.repo AND o.pr_number = p.pr_number
  WHERE coalesce(p.merged_at, '') <> ''),
in_fx AS (SELECT * FROM ev_fx WHERE {kept}),
raw_fx AS (SELECT r.repo, r.pr_number, r.github_comment_id, r.comment_type, i.merged_at, r.text,
                  r.file_path, r.body AS original_body
           FROM rtext_fx r JOIN in_fx i ON i.repo = r.repo AND i.pr_number = r.pr_number),
every_fx AS (
  SELECT repo, pr_number, github_comment_id, comment_type, ({ofx.CATS})[length(text) % 13 + 1] AS category,
         merged_at, false AS sup, file_path, original_body FROM raw_fx
  UNION ALL
  SELECT repo, pr_number, -pr_number, 'pull_request_architecture', 'architecture', merged_at, n % 7 = 0, NULL, ''
  FROM in_fx WHERE n % 2 = 0),
cut_fx AS (SELECT repo, max(merged_at) AS cutoff FROM every_fx WHERE sup GROUP BY repo),
left_fx AS (SELECT e.* FROM every_fx e LEFT JOIN cut_fx c ON c.repo = e.repo
            WHERE NOT coalesce(e.category = 'architecture' AND e.merged_at < c.cutoff, false))
SELECT 'raw_comments' AS tbl, repo, pr_number, comment_type || ':' || CAST(github_comment_id AS VARCHAR) AS item FROM raw_fx
UNION ALL
SELECT 'notes', repo, pr_number, comment_type || ':' || CAST(github_comment_id AS VARCHAR) || ':' || category FROM left_fx
UNION ALL
SELECT 'vectors', repo, pr_number, {ofx.NOTE_ID} FROM left_fx
UNION ALL
SELECT 'pending_prs', p.repo, p.pr_number, 'pending' FROM prs_fx p
WHERE {pending}"""


ORACLE["batch_job"] = _history("true", "false")
ORACLE["i5_mine_full"] = _history("pr_number % 2 = 0 OR NOT over", """pr_number % 2 = 1 AND (merged_at IS NOT NULL OR state = 'open')
  AND (repo, pr_number) NOT IN (SELECT (repo, pr_number) FROM in_fx)""")
