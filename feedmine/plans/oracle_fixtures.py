"""The test-data adapters of ``feedmine.sources.testdata`` as DuckDB CTEs.

Written independently from the Spark side, from the same formulas, so that an
oracle query checks the Spark operator and not a copy of it.
"""

from feedmine.schemas import CATEGORIES, SEVERITIES


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


CATS = _list(CATEGORIES)
SEVS = _list(SEVERITIES)

NOTES = f"""
notes_fx AS (
  SELECT d.source AS repo,
         d.doc_id // 100 AS pr_number,
         d.doc_id AS github_comment_id,
         'PR ' || CAST(d.doc_id // 100 AS VARCHAR) AS pr_title,
         'https://example.test/' || d.source || '/pull/' || CAST(d.doc_id // 100 AS VARCHAR) AS pr_url,
         'review_comment' AS comment_type,
         CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE 'src/f' || CAST(d.doc_id % 17 AS VARCHAR) || '.py' END AS file_path,
         d.text AS original_body,
         ({CATS})[d.doc_id % 13 + 1] AS category,
         substr(d.text, 1, length(d.text) // 2) AS original_issue,
         substr(d.text, length(d.text) // 2 + 1) AS requested_change,
         'lang=' || d.lang AS rationale,
         ({SEVS})[d.doc_id % 3 + 1] AS severity,
         'u' || CAST(d.doc_id % 5 AS VARCHAR) AS reviewer,
         l.quality = 1 AS implemented,
         l.toxic = 0 AS include_in_vector_store,
         'fixture' AS selection_rationale,
         CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE d.text END AS implementation_example,
         d.doc_id % 13 = 1 AS architecture_change,
         d.doc_id % 37 = 5 AS supersedes_prior_architecture,
         CASE WHEN d.doc_id % 10 = 0 THEN ''
              ELSE strftime(DATE '2024-01-01' + CAST(d.doc_id * 7919 % 700 AS INTEGER), '%Y-%m-%d') END AS merged_at,
         d.doc_id AS ordinal
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""

# B8 then C8, in closed form.
SELECTED = """
selected_fx AS (
  SELECT * FROM notes_fx
  WHERE coalesce(implemented, true) AND coalesce(include_in_vector_store, true)
)"""

CUTOFFS = """
cutoffs_fx AS (
  SELECT repo, max(merged_at) AS cutoff FROM selected_fx
  WHERE supersedes_prior_architecture AND coalesce(merged_at, '') <> ''
  GROUP BY repo
)"""

ACTIVE = """
active_fx AS (
  SELECT s.* FROM selected_fx s LEFT JOIN cutoffs_fx c ON c.repo = s.repo
  WHERE NOT (s.category = 'architecture' AND coalesce(s.merged_at, '') <> ''
             AND c.cutoff IS NOT NULL AND s.merged_at < c.cutoff)
)"""

NOTE_ID = """sha256(repo || '|' || comment_type || '|' ||
       CASE WHEN coalesce(github_comment_id, 0) <> 0 THEN CAST(github_comment_id AS VARCHAR)
            ELSE CAST(pr_number AS VARCHAR) || '|' || coalesce(file_path, '') || '|' || original_body END)"""

NOTE_CONTENT = """concat_ws(chr(10), nullif(original_issue, ''), nullif(requested_change, ''),
       nullif(rationale, ''), nullif(original_body, ''), nullif(implementation_example, ''))"""

# prs from orders
PRS = """
prs_fx AS (
  SELECT 'org/r' || CAST(o_orderkey % 8 AS VARCHAR) AS repo,
         o_orderkey AS pr_number,
         o_orderpriority AS title,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Change set ' || CAST(o_orderkey AS VARCHAR) END AS body,
         'https://example.test/org/r' || CAST(o_orderkey % 8 AS VARCHAR) || '/pull/' || CAST(o_orderkey AS VARCHAR) AS html_url,
         CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state,
         CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS merged_at,
         strftime(o_orderdate, '%Y-%m-%d') AS updated_at,
         sha256('head-' || CAST(o_orderkey AS VARCHAR)) AS head_sha
  FROM orders
)"""

PR_DIFFS = """
pr_diffs_fx AS (
  SELECT repo, pr_number,
         CASE WHEN merged_at IS NULL THEN ''
              ELSE 'diff --git a/f b/f' || chr(10) || '+' || title || ' ' || CAST(pr_number AS VARCHAR) END AS final_diff
  FROM prs_fx
)"""

THREADS = """
threads_fx AS (
  SELECT 'org/r' || CAST(conv_id % 8 AS VARCHAR) AS repo,
         conv_id AS pr_number,
         conv_id * 100 + turn + 1 AS id,
         CASE WHEN turn = 0 THEN NULL WHEN turn % 2 = 1 THEN conv_id * 100 + 1
              ELSE conv_id * 100 + turn END AS in_reply_to_id,
         CASE WHEN turn = 0 THEN 'u' || CAST(conv_id % 5 AS VARCHAR) ELSE role END AS login,
         text AS body,
         'src/c' || CAST(conv_id AS VARCHAR) || '.py' AS path,
         '@@ -1 +1 @@ turn ' || CAST(turn AS VARCHAR) AS diff_hunk,
         '2024-02-01T00:00:' || lpad(CAST(turn AS VARCHAR), 2, '0') || 'Z' AS created_at,
         'https://example.test/org/r' || CAST(conv_id % 8 AS VARCHAR) || '/pull/' || CAST(conv_id AS VARCHAR)
           || '#c' || CAST(conv_id * 100 + turn + 1 AS VARCHAR) AS html_url,
         turn AS item_ord
  FROM conversations
)"""

REVIEWS = """
reviews_fx AS (
  SELECT 'org/r' || CAST((doc_id % 100) % 8 AS VARCHAR) AS repo,
         doc_id % 100 AS pr_number,
         doc_id AS id,
         'u' || CAST(doc_id % 5 AS VARCHAR) AS login,
         CASE WHEN doc_id % 9 = 0 THEN NULL
              ELSE (['APPROVED', 'CHANGES_REQUESTED', 'COMMENTED', 'DISMISSED'])[doc_id % 4 + 1] END AS state,
         CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 6 = 0 THEN '' ELSE text END AS body,
         '2024-03-01T00:00:00Z#' || CAST(doc_id AS VARCHAR) AS submitted_at,
         'https://example.test/org/r' || CAST((doc_id % 100) % 8 AS VARCHAR) || '/pull/'
           || CAST(doc_id % 100 AS VARCHAR) || '#r' || CAST(doc_id AS VARCHAR) AS html_url,
         doc_id AS item_ord
  FROM documents
)"""

ISSUE_COMMENTS = """
issue_comments_fx AS (
  SELECT 'org/r' || CAST((item_id % 100) % 8 AS VARCHAR) AS repo,
         item_id % 100 AS pr_number,
         item_id AS id,
         'u' || CAST(item_id % 5 AS VARCHAR) AS login,
         CASE WHEN item_id % 7 = 0 THEN '' ELSE text END AS body,
         '2024-04-01T00:00:00Z#' || CAST(item_id AS VARCHAR) AS created_at,
         'https://example.test/org/r' || CAST((item_id % 100) % 8 AS VARCHAR) || '/pull/'
           || CAST(item_id % 100 AS VARCHAR) || '#i' || CAST(item_id AS VARCHAR) AS html_url,
         item_id AS item_ord
  FROM benchmark
)"""

TRUSTED = """
trusted_fx AS (SELECT * FROM (VALUES ('u0'), ('u1'), ('u2')) t(login_lc))"""

VNOTES = f"""
vnotes_fx AS (
  SELECT 'org/r' || CAST(label AS VARCHAR) AS repo, vec_id AS pr_number, vec_id AS github_comment_id,
         'https://example.test/org/r' || CAST(label AS VARCHAR) || '/pull/' || CAST(vec_id AS VARCHAR) AS pr_url,
         'review_comment' AS comment_type,
         CASE WHEN vec_id % 4 = 0 THEN NULL ELSE 'lib/m' || CAST(vec_id % 7 AS VARCHAR) || '.py' END AS file_path,
         'body ' || CAST(vec_id AS VARCHAR) AS original_body,
         ({CATS})[vec_id % 13 + 1] AS category,
         ({SEVS})[vec_id % 3 + 1] AS severity,
         'issue ' || CAST(vec_id AS VARCHAR) AS original_issue,
         'change ' || CAST(vec_id AS VARCHAR) AS requested_change,
         'why' AS rationale,
         CASE WHEN vec_id % 6 = 0 THEN '' ELSE 'example' END AS implementation_example,
         'u' || CAST(vec_id % 3 AS VARCHAR) AS reviewer,
         CASE WHEN vec_id % 10 = 0 THEN ''
              ELSE strftime(DATE '2024-01-01' + CAST(vec_id % 300 AS INTEGER), '%Y-%m-%d') END AS merged_at,
         CAST(embedding AS DOUBLE[]) AS embedding,
         vec_id AS ordinal
  FROM embeddings
)"""

VINDEX = f"""
vindex_fx AS (
  SELECT {NOTE_ID} AS id, {NOTE_CONTENT} AS content, * FROM vnotes_fx
)"""

TRUSTED_IN = "('u0', 'u1', 'u2')"

FEEDBACK = f"""
roots_fx AS (
  SELECT * FROM threads_fx
  WHERE in_reply_to_id IS NULL AND lower(coalesce(login, '')) IN {TRUSTED_IN}
),
fb_fx AS (
  SELECT repo, pr_number, id AS github_comment_id, 'review_comment' AS comment_type,
         path AS file_path, diff_hunk, coalesce(body, '') AS body, CAST(NULL AS VARCHAR) AS review_state,
         created_at, html_url, login AS reviewer, 0 AS kind_ord, item_ord
  FROM roots_fx
  UNION ALL
  SELECT repo, pr_number, id, 'review_summary', NULL, NULL, body, state, submitted_at, html_url, login, 1, item_ord
  FROM reviews_fx
  WHERE state IS DISTINCT FROM 'DISMISSED' AND coalesce(body, '') <> ''
    AND lower(login) IN {TRUSTED_IN}
  UNION ALL
  SELECT repo, pr_number, id, 'issue_comment', NULL, NULL, coalesce(body, ''), NULL, created_at, html_url,
         login, 2, item_ord
  FROM issue_comments_fx WHERE lower(login) IN {TRUSTED_IN}
),
feedback_fx AS (
  SELECT f.*, coalesce(p.title, '') AS pr_title, p.html_url AS pr_url,
         CASE WHEN coalesce(p.merged_at, '') <> '' THEN 'merged' ELSE coalesce(p.state, 'open') END AS pr_state,
         coalesce(p.merged_at, '') AS merged_at, p.updated_at AS pr_updated_at
  FROM fb_fx f JOIN prs_fx p ON p.repo = f.repo AND p.pr_number = f.pr_number
),
ordered_fx AS (
  SELECT *, row_number() OVER (ORDER BY CAST(substr(repo, 6) AS INTEGER), pr_updated_at DESC, pr_number,
                                        kind_ord, item_ord, github_comment_id) - 1 AS ordinal
  FROM feedback_fx
)"""

WALK = f"""
walk(repo, pr_number, root_id, node, depth, path, author) AS (
  SELECT t.repo, t.pr_number, r.id, t.id, 1, [t.item_ord], t.login
  FROM threads_fx t JOIN roots_fx r ON t.repo = r.repo AND t.pr_number = r.pr_number AND t.in_reply_to_id = r.id
  UNION ALL
  SELECT t.repo, t.pr_number, w.root_id, t.id, w.depth + 1, list_append(w.path, t.item_ord), t.login
  FROM walk w JOIN threads_fx t ON t.repo = w.repo AND t.pr_number = w.pr_number AND t.in_reply_to_id = w.node
)"""

WALK_BODY = """
walkb(repo, pr_number, root_id, node, depth, path, author, body) AS (
  SELECT t.repo, t.pr_number, r.id, t.id, 1, [t.item_ord], t.login, t.body
  FROM threads_fx t JOIN roots_fx r ON t.repo = r.repo AND t.pr_number = r.pr_number AND t.in_reply_to_id = r.id
  UNION ALL
  SELECT t.repo, t.pr_number, w.root_id, t.id, w.depth + 1, list_append(w.path, t.item_ord), t.login, t.body
  FROM walkb w JOIN threads_fx t ON t.repo = w.repo AND t.pr_number = w.pr_number AND t.in_reply_to_id = w.node
)"""

# All feedback in E1 order, batched by 8, with its thread text (H3).
ROOT_BATCHES = """
rord_fx AS (
  SELECT *, row_number() OVER (ORDER BY CAST(substr(repo, 6) AS INTEGER), pr_updated_at DESC, pr_number,
                                        kind_ord, item_ord, github_comment_id) - 1 AS ordinal
  FROM feedback_fx
),
rb_fx AS (SELECT *, ordinal // 8 AS batch_id, ordinal % 8 AS pos FROM rord_fx),
rep_fx AS (
  SELECT root_id, string_agg('Reply by ' || coalesce(author, '') || ': ' || coalesce(body, ''), chr(10)
                             ORDER BY depth, path) AS lines
  FROM walkb GROUP BY root_id
),
rtext_fx AS (
  SELECT b.*, concat_ws(chr(10),
      '--- Comment ' || CAST(b.pos AS VARCHAR) || ' ---',
      'Repo: ' || b.repo || '  PR #' || CAST(b.pr_number AS VARCHAR) || ': ' || b.pr_title,
      'Type: ' || b.comment_type || CASE WHEN coalesce(b.review_state, '') <> ''
                                         THEN '  (review_state: ' || b.review_state || ')' ELSE '' END,
      CASE WHEN coalesce(b.file_path, '') <> '' THEN 'File: ' || b.file_path END,
      CASE WHEN coalesce(b.diff_hunk, '') <> '' THEN 'Diff hunk:' || chr(10) || b.diff_hunk END,
      'Trusted reviewer: ' || coalesce(b.reviewer, ''),
      'Root comment: ' || b.body,
      r.lines) AS text
  FROM rb_fx b LEFT JOIN rep_fx r ON r.root_id = b.github_comment_id AND b.comment_type = 'review_comment'
),
d1_fx AS (
  SELECT f.batch_id, f.repo, f.pr_number, f.first_pos, coalesce(d.final_diff, '') AS final_diff
  FROM (SELECT batch_id, repo, pr_number, min(pos) AS first_pos FROM rb_fx GROUP BY ALL) f
  LEFT JOIN pr_diffs_fx d ON d.repo = f.repo AND d.pr_number = f.pr_number
),
prompt_fx AS (
  SELECT t.batch_id, t.n_items,
         t.texts || chr(10) || chr(10) || s.secs || chr(10) || chr(10) || 'There are ' || CAST(t.n_items AS VARCHAR)
           || ' comments above. Return exactly ' || CAST(t.n_items AS VARCHAR) || ' items in order.' AS prompt
  FROM (SELECT batch_id, count(*) AS n_items, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS texts
        FROM rtext_fx GROUP BY batch_id) t
  JOIN (SELECT batch_id, string_agg('--- Final merged diff for ' || repo || ' PR #' || CAST(pr_number AS VARCHAR)
                                    || ' ---' || chr(10) || final_diff, chr(10) || chr(10) ORDER BY first_pos) AS secs
        FROM d1_fx GROUP BY batch_id) s ON s.batch_id = t.batch_id
),
attempts_fx AS (
  SELECT b.batch_id, b.n_items, a.attempt,
         CASE WHEN b.batch_id % 8 = 6 THEN (CASE a.attempt WHEN 1 THEN 'short' WHEN 2 THEN 'critical' ELSE 'blank' END)
              WHEN b.batch_id % 5 = 0 AND a.attempt = 1 THEN 'short'
              WHEN b.batch_id % 5 = 2 AND a.attempt = 1 THEN 'critical'
              ELSE 'ok' END AS kind
  FROM (SELECT batch_id, count(*) AS n_items FROM rb_fx GROUP BY batch_id) b,
       range(1, 4) a(attempt)
  WHERE a.attempt <= CASE WHEN b.batch_id % 8 = 6 THEN 3
                          WHEN b.batch_id % 5 IN (0, 2) THEN 2 ELSE 1 END
)"""

# deliveries: one envelope per event, event_id mod 10 = 0 twice; expected outcome per rule.
DELIVERIES = """
ev_fx AS (
  SELECT event_id, user_id, event_type, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
),
dl_fx AS (
  SELECT *, 0 AS copy FROM ev_fx UNION ALL SELECT *, 1 AS copy FROM ev_fx WHERE event_id % 10 = 0
),
out_fx AS (
  SELECT *,
    CASE WHEN event_type IN ('signup', 'purchase', 'error') THEN 'pull_request'
         WHEN event_type = 'click' THEN 'pull_request_review_comment' ELSE 'issue_comment' END AS event,
    CASE event_type WHEN 'signup' THEN 'opened' WHEN 'purchase' THEN 'closed' WHEN 'error' THEN 'labeled'
         ELSE 'created' END AS action,
    'org/r' || CAST(user_id % 8 AS VARCHAR) AS repo,
    CASE WHEN k % 25 IN (7, 8) THEN 401
         WHEN k IN (96, 97) THEN 400
         WHEN NOT (event_type IN ('signup', 'purchase', 'click') OR (event_type = 'view' AND k % 2 = 0)) THEN 202
         WHEN k = 98 AND NOT (event_type IN ('signup', 'purchase') AND user_id = 0) THEN 400
         WHEN user_id = 0 AND event_type IN ('click', 'view') THEN 400
         ELSE 202 END AS status,
    event_type IN ('signup', 'purchase', 'click') OR (event_type = 'view' AND k % 2 = 0) AS routed
  FROM dl_fx
),
jobs_fx AS (
  SELECT 1 AS version, CAST(event_id AS VARCHAR) AS delivery_id,
         CASE WHEN event_type = 'signup' THEN 'review' ELSE 'mining' END AS work_type,
         event, action, repo, user_id AS pr_number, k, copy
  FROM out_fx WHERE status = 202 AND routed
)"""


def curated(src: str, name: str) -> str:
    """B8 + C8 over CTE ``src`` as CTE ``name``."""
    return f"""
{name}_sel AS (SELECT * FROM {src} WHERE coalesce(implemented, true) AND coalesce(include_in_vector_store, true)),
{name}_cut AS (SELECT repo, max(merged_at) AS cutoff FROM {name}_sel
               WHERE supersedes_prior_architecture AND coalesce(merged_at, '') <> '' GROUP BY repo),
{name} AS (SELECT s.* FROM {name}_sel s LEFT JOIN {name}_cut c ON c.repo = s.repo
           WHERE NOT (s.category = 'architecture' AND coalesce(s.merged_at, '') <> ''
                      AND c.cutoff IS NOT NULL AND s.merged_at < c.cutoff))"""


WAVES = f"""
state_src AS (SELECT * FROM notes_fx WHERE github_comment_id % 3 <> 0),
{curated('state_src', 'state_fx')},
keys_fx AS (SELECT DISTINCT repo, pr_number FROM notes_fx WHERE pr_number % 4 = 1),
inc1_fx AS (
  SELECT * REPLACE (CASE WHEN supersedes_prior_architecture AND merged_at <> ''
                         THEN strftime(CAST(merged_at AS DATE) + 700, '%Y-%m-%d') ELSE merged_at END AS merged_at)
  FROM notes_fx WHERE pr_number % 4 = 1 AND github_comment_id % 7 <> 2
),
comb1_fx AS (
  SELECT * FROM state_fx WHERE (repo, pr_number) NOT IN (SELECT (repo, pr_number) FROM keys_fx)
  UNION ALL SELECT * FROM inc1_fx
),
{curated('comb1_fx', 'act1_fx')},
inc2_fx AS (
  SELECT * REPLACE (CASE WHEN supersedes_prior_architecture THEN false ELSE include_in_vector_store END
                    AS include_in_vector_store) FROM inc1_fx
),
comb2_fx AS (
  SELECT * FROM act1_fx WHERE (repo, pr_number) NOT IN (SELECT (repo, pr_number) FROM keys_fx)
  UNION ALL SELECT * FROM inc2_fx
),
{curated('comb2_fx', 'act2_fx')}"""

TREE = """
tree_fx AS (
  SELECT 'org/r' || CAST(page_id % 8 AS VARCHAR) AS repo,
         sha256('org/r' || CAST(page_id % 8 AS VARCHAR)) AS head_sha,
         url || '~' || CAST(page_id AS VARCHAR) AS path,
         CASE WHEN page_id % 13 = 12 THEN 'tree' ELSE 'blob' END AS type,
         sha256(html) AS sha, CAST(octet_length(encode(html)) AS BIGINT) AS size,
         page_id = 7 AS truncated, page_id AS item_ord, html
  FROM pages
),
bad_heads AS (SELECT DISTINCT repo FROM tree_fx WHERE truncated),
blobs_fx AS (SELECT * FROM tree_fx WHERE type = 'blob' AND repo NOT IN (SELECT repo FROM bad_heads)),
elen AS (
  SELECT *, length(path)
            + (length(path) - length(regexp_replace(path, '["\\\\\\n\\r\\t\\x08\\x0C]', '', 'g')))
            + 5 * (length(path) - length(regexp_replace(path, '[\\x00-\\x07\\x0B\\x0E-\\x1F\\x7F]', '', 'g')))
            + 5 * (length(path) - length(regexp_replace(path, '[\\x{80}-\\x{FFFF}]', '', 'g')))
            + 11 * (length(path) - length(regexp_replace(path, '[\\x{10000}-\\x{10FFFF}]', '', 'g')))
            + 2 + length(CAST(size AS VARCHAR)) + 17 AS entry_len
  FROM blobs_fx
),
head_stats AS (
  SELECT repo, count(*) AS n, count(*) FILTER (WHERE size <= 5000) AS m,
         coalesce(sum(entry_len) FILTER (WHERE size <= 5000), 0) + greatest(count(*) FILTER (WHERE size <= 5000) - 1, 0) + 2 AS chars
  FROM elen GROUP BY repo
),
manifest_fx AS (
  SELECT b.* FROM blobs_fx b JOIN head_stats h ON h.repo = b.repo
  WHERE b.size <= 5000 AND h.n <= 20000 AND h.chars <= 7000
)"""

OPEN = """
open_fx AS (
  SELECT repo, pr_number, title, body, sha256(repo) AS head_sha FROM prs_fx
  WHERE state = 'open' AND repo IN (SELECT repo FROM tree_fx)
)"""

SELECTIONS = """
ranked_fx AS (
  SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY item_ord) - 1 AS rk, count(*) OVER (PARTITION BY repo) AS n
  FROM tree_fx WHERE type = 'blob' AND size <= 5000
),
picked_fx AS (
  SELECT o.repo, o.pr_number, list(r.path ORDER BY u.j) AS paths
  FROM open_fx o CROSS JOIN (VALUES (0), (1), (2)) u(j)
  JOIN ranked_fx r ON r.repo = o.repo AND u.j < r.n AND r.rk = (o.pr_number // 8 + u.j) % r.n
  GROUP BY ALL
),
sel_fx AS (
  SELECT repo, pr_number, CASE WHEN repo = 'org/r1' THEN list_append(paths, 'missing/file.py')
                               WHEN repo = 'org/r2' THEN list_append(paths, paths[1]) ELSE paths END AS paths
  FROM picked_fx
)"""

BLOBS = """
blobdec_fx AS (
  SELECT sha256(html) AS sha,
         CASE WHEN page_id % 29 = 3 THEN 'error: unsupported blob encoding'
              WHEN page_id % 31 = 4 THEN 'error: invalid base64 in blob'
              WHEN octet_length(encode(html)) > 5000 THEN 'skipped: too large'
              ELSE 'ok' END AS status,
         html
  FROM pages
)"""

CONTEXT = """
asked_fx AS (
  SELECT s.repo, s.pr_number, u.o AS pos, u.p AS path, m.sha, m.size
  FROM sel_fx s CROSS JOIN unnest(s.paths) WITH ORDINALITY u(p, o)
  LEFT JOIN manifest_fx m ON m.repo = s.repo AND m.path = u.p
),
asks_fx AS (
  SELECT repo, pr_number, arg_min(path, pos) FILTER (WHERE sha IS NULL) AS unknown, sum(size) AS bytes FROM asked_fx GROUP BY ALL
),
checks_fx AS (
  SELECT s.repo, s.pr_number,
         CASE WHEN len(s.paths) > 8 THEN 'selection has over 8 files'
              WHEN len(list_distinct(s.paths)) <> len(s.paths) THEN 'selection repeats a path'
              WHEN a.unknown IS NOT NULL THEN 'selection has an unknown path: ' || a.unknown
              WHEN a.bytes > 120000 THEN 'selected files exceed the context budget' END AS reason
  FROM sel_fx s LEFT JOIN asks_fx a ON a.repo = s.repo AND a.pr_number = s.pr_number
),
blob_fx AS (
  SELECT sha, min({'fine': NOT starts_with(status, 'error'), 'status': status, 'html': html}) AS b FROM blobdec_fx GROUP BY sha
),
read_fx AS (
  SELECT a.repo, a.pr_number, a.pos, a.path, coalesce(b.b.status, 'error: no blob') AS status, b.b.html AS html
  FROM asked_fx a JOIN checks_fx c ON c.repo = a.repo AND c.pr_number = a.pr_number AND c.reason IS NULL
  LEFT JOIN blob_fx b ON b.sha = a.sha
),
broken_fx AS (
  SELECT repo, pr_number, min(pos) AS pos, arg_min(path || ': ' || status, pos) AS reason
  FROM read_fx WHERE starts_with(status, 'error') GROUP BY ALL
),
parts_fx AS (
  SELECT r.repo, r.pr_number, r.pos, 'File: ' || r.path || chr(10) || r.html AS part
  FROM read_fx r LEFT JOIN broken_fx b ON b.repo = r.repo AND b.pr_number = r.pr_number
  WHERE r.status = 'ok' AND (b.pos IS NULL OR r.pos < b.pos)
),
text_fx AS (
  SELECT repo, pr_number, sum(length(part)) AS total, string_agg(part, chr(10) || chr(10) ORDER BY pos) AS context
  FROM parts_fx GROUP BY ALL
),
context_fx AS (
  SELECT repo, pr_number, CASE WHEN b.reason IS NULL AND t.total <= 5000 THEN t.context END AS context,
         CASE WHEN t.total > 5000 THEN 'selected files exceed the context budget' ELSE b.reason END AS reason
  FROM text_fx t FULL JOIN broken_fx b USING (repo, pr_number)
)"""

EVIDENCE = """
qvec_fx AS (
  SELECT o.repo, o.pr_number, CAST(e.embedding AS DOUBLE[]) AS qv
  FROM open_fx o JOIN embeddings e ON e.vec_id = o.pr_number % (SELECT count(*) FROM embeddings)
),
scored_fx AS (
  SELECT q.repo, q.pr_number, v.id, list_cosine_similarity(v.embedding, q.qv) AS score
  FROM vindex_fx v JOIN qvec_fx q ON v.repo = q.repo WHERE v.reviewer IN ('U0', 'u1', 'u2', '__merged_pr__')
),
nearest_fx AS (
  SELECT repo, pr_number, id, row_number() OVER (PARTITION BY repo, pr_number ORDER BY score DESC, id) AS rank
  FROM scored_fx QUALIFY rank <= 8
),
evidence_fx AS (
  SELECT n.repo, n.pr_number, count(*) AS n, CAST(to_json(list({'content': v.content, 'repo': v.repo, 'pr_number': v.pr_number,
         'pr_url': v.pr_url, 'file_path': v.file_path, 'category': v.category, 'severity': v.severity} ORDER BY n.rank)) AS VARCHAR) AS js
  FROM nearest_fx n JOIN vindex_fx v ON v.id = n.id GROUP BY ALL
),
changed_fx AS (
  SELECT 'org/r' || CAST(l_orderkey % 8 AS VARCHAR) AS repo, l_orderkey AS pr_number,
         string_agg('+++ b/src/p' || CAST(l_partkey AS VARCHAR) || '.py', chr(10) ORDER BY l_linenumber * 1000000 + l_partkey) AS diff,
         CAST(to_json(list('src/p' || CAST(l_partkey AS VARCHAR) || '.py' ORDER BY l_linenumber * 1000000 + l_partkey)) AS VARCHAR) AS names
  FROM lineitem GROUP BY ALL
),
rejected_fx AS (
  SELECT repo, 'repository tree was truncated' AS reason FROM bad_heads
  UNION ALL
  SELECT repo, CASE WHEN n > 20000 THEN 'repository tree has ' || CAST(n AS VARCHAR) || ' files; maximum supported is 20000'
                    ELSE 'repository tree is ' || CAST(chars AS VARCHAR) || ' characters; maximum supported is 7000' END
  FROM head_stats WHERE n > 20000 OR chars > 7000
)"""


def ascii_json(text: str) -> str:
    """SQL: JSON text with every character that isn't printable ASCII written as an escape (the tables have none beyond U+FFFF)."""
    return (f"CASE WHEN regexp_matches({text}, '[^ -~]') THEN array_to_string(list_transform(string_split({text}, ''), "
            f"lambda c: CASE WHEN unicode(c) > 126 THEN '\\u' || format('{{:04x}}', unicode(c)) ELSE c END), '') ELSE {text} END")


def json_text(value: str) -> str:
    return f"CAST(to_json({value}) AS VARCHAR)"


REVIEW_INPUT = f"""
raw_fx AS (
  SELECT o.repo, o.pr_number, o.head_sha, coalesce(e.n, 0) AS n_evidence, coalesce(length(c.context), 0) AS context_chars,
         coalesce(r.reason, k.reason, CASE WHEN s.repo IS NULL THEN 'no context selection' END, c.reason) AS reason,
         '{{"repository":' || {json_text("o.repo")} || ',"pull_request":' || CAST(o.pr_number AS VARCHAR)
         || ',"title":' || {json_text("coalesce(o.title, '')")} || ',"description":' || {json_text("coalesce(o.body, '')")}
         || ',"historical_evidence":' || coalesce(e.js, '[]') || ',"changed_code":' || {json_text("coalesce(h.diff, '')")}
         || ',"repository_context":' || {json_text("coalesce(c.context, '')")} || '}}' AS js
  FROM open_fx o LEFT JOIN evidence_fx e ON e.repo = o.repo AND e.pr_number = o.pr_number
  LEFT JOIN rejected_fx r ON r.repo = o.repo
  LEFT JOIN sel_fx s ON s.repo = o.repo AND s.pr_number = o.pr_number
  LEFT JOIN checks_fx k ON k.repo = o.repo AND k.pr_number = o.pr_number
  LEFT JOIN context_fx c ON c.repo = o.repo AND c.pr_number = o.pr_number
  LEFT JOIN changed_fx h ON h.repo = o.repo AND h.pr_number = o.pr_number
),
input_fx AS (SELECT * EXCLUDE (js), {ascii_json("js")} AS prompt FROM raw_fx)"""

SELECTION_PROMPT = f"""
listed_fx AS (
  SELECT repo, CAST(to_json(list({{'path': path, 'size': size}} ORDER BY item_ord)) AS VARCHAR) AS js FROM manifest_fx GROUP BY repo
),
rawask_fx AS (
  SELECT o.repo, o.pr_number, '{{"title":' || {json_text("coalesce(o.title, '')")} || ',"description":' || {json_text("coalesce(o.body, '')")}
         || ',"historical_evidence":' || coalesce(e.js, '[]') || ',"changed_paths":' || coalesce(h.names, '[]')
         || ',"changed_code":' || {json_text("coalesce(h.diff, '')")} || ',"repository_paths":' || coalesce(l.js, '[]') || '}}' AS js
  FROM open_fx o LEFT JOIN evidence_fx e ON e.repo = o.repo AND e.pr_number = o.pr_number
  LEFT JOIN changed_fx h ON h.repo = o.repo AND h.pr_number = o.pr_number
  LEFT JOIN listed_fx l ON l.repo = o.repo
  WHERE o.repo NOT IN (SELECT repo FROM rejected_fx)
),
ask_fx AS (SELECT repo, pr_number, {ascii_json("js")} AS prompt FROM rawask_fx)"""

MODEL_SELECTIONS = """
smallest_fx AS (
  SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY size, path) AS rk FROM manifest_fx
),
two_fx AS (SELECT repo, list(path ORDER BY rk) AS paths FROM smallest_fx WHERE rk <= 2 GROUP BY repo),
sel_fx AS (
  SELECT o.repo, o.pr_number, CASE WHEN e.n > 0 THEN coalesce(t.paths, []) ELSE [] END AS paths
  FROM open_fx o LEFT JOIN evidence_fx e ON e.repo = o.repo AND e.pr_number = o.pr_number LEFT JOIN two_fx t ON t.repo = o.repo
  WHERE o.repo NOT IN (SELECT repo FROM rejected_fx)
)"""
