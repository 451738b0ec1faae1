"""Declared schemas and fixed vocabularies.

Nothing is inferred from data: an empty landing would otherwise give an empty
schema. Provider documents and model responses stay ``VARIANT`` until validated.
"""

from pyspark.sql import types as T

# ---- fixed values (must equal the reference's for equal results) -------------
# Note categories, in alphabetical order.
CATEGORIES = [
    "api-design", "architecture", "concurrency", "documentation",
    "error-handling", "logging", "naming", "other", "performance",
    "readability", "security", "style", "testing",
]
# Note severities.
SEVERITIES = ["blocking", "suggestion", "nitpick"]
# Fields every analysis item must carry.
REQUIRED_ITEM_FIELDS = [
    "category", "original_issue", "requested_change", "rationale", "severity",
    "implemented", "include_in_vector_store", "selection_rationale",
    "implementation_example", "architecture_change", "supersedes_prior_architecture",
]
# Of those, the fields that must be JSON booleans.
BOOLEAN_ITEM_FIELDS = [
    "implemented", "include_in_vector_store", "architecture_change",
    "supersedes_prior_architecture",
]
# Transient transport failure markers (matched in lower-cased error text).
TRANSIENT_ERROR_MARKERS = [
    "eof", "connection reset", "connection refused", "timeout",
    "temporary failure", "broken pipe", "http2 stream error", "server error",
    "status 502", "status 503", "status 504",
]
# Reviewer name of merged-PR architecture notes.
MERGED_PR_REVIEWER = "__merged_pr__"
ARCHITECTURE_COMMENT_TYPE = "pull_request_architecture"
ARCHITECTURE_SELECTION_RATIONALE = "Implemented merged-PR architecture decision."
REPORT_HEADER = "# Code Review Notes"
# Configured limits.
MAX_FINAL_DIFF_CHARS = 500_000
MAX_REVIEW_TREE_ENTRIES = 20_000
MAX_REVIEW_TREE_CHARS = 200_000
MAX_REVIEW_CONTEXT_FILES = 8
MAX_REVIEW_CONTEXT_FILE_BYTES = 50_000
MAX_REVIEW_CONTEXT_CHARS = 120_000
MAX_REVIEW_PROMPT_CHARS = 400_000
ANALYSIS_BATCH_SIZE = 8
ANALYSIS_MAX_ATTEMPTS = 3
SYNTHESIS_CHUNK_SIZE = 400
MAX_FEEDBACK_PER_PR = 100
EVIDENCE_PER_REVIEW = 8
SEARCH_LIMIT = 5
MAX_RECEIVES = 5
VISIBILITY_MS = 5400 * 1000  # a failed job is tried again after this
DEAD_LETTER_RETENTION_DAYS = 14

S, L, B, I = T.StringType(), T.LongType(), T.BooleanType(), T.IntegerType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


REPLY = _struct(("github_comment_id", L), ("author", S), ("body", S),
                ("created_at", S), ("html_url", S))

# The 17 fields of one feedback row.
FEEDBACK = _struct(
    ("repo", S), ("pr_number", L), ("github_comment_id", L), ("pr_title", S),
    ("pr_url", S), ("pr_state", S), ("comment_type", S), ("file_path", S),
    ("diff_hunk", S), ("body", S), ("review_state", S), ("created_at", S),
    ("html_url", S), ("reviewer", S), ("replies", T.ArrayType(REPLY)),
    ("final_diff", S), ("merged_at", S),
)

# The 21 fields of one note.
NOTE = _struct(
    ("repo", S), ("pr_number", L), ("github_comment_id", L), ("pr_title", S),
    ("pr_url", S), ("comment_type", S), ("file_path", S), ("original_body", S),
    ("category", S), ("original_issue", S), ("requested_change", S),
    ("rationale", S), ("severity", S), ("reviewer", S), ("implemented", B),
    ("include_in_vector_store", B), ("selection_rationale", S),
    ("implementation_example", S), ("architecture_change", B),
    ("supersedes_prior_architecture", B), ("merged_at", S),
)
NOTE_FIELDS = [f.name for f in NOTE.fields]
FEEDBACK_FIELDS = [f.name for f in FEEDBACK.fields]

# The vector table (one row per indexed note).
VECTOR = _struct(
    ("id", S), ("content", S), ("content_vector", T.ArrayType(T.FloatType())),
    ("reviewer", S), ("repo", S), ("pr_number", L), ("github_comment_id", L),
    ("pr_url", S), ("file_path", S), ("category", S), ("severity", S),
    ("merged_at", T.TimestampType()),
)
SEARCH_FIELDS = ["content", "repo", "pr_number", "pr_url", "file_path", "category", "severity"]

PENDING = _struct(("repo", S), ("pr_number", L))
STATE = T.StructType([
    T.StructField("version", I, True),
    T.StructField("raw_comments", T.ArrayType(FEEDBACK), True),
    T.StructField("notes", T.ArrayType(NOTE), True),
    T.StructField("pending_prs", T.ArrayType(PENDING), True),
])

ENVELOPE = T.StructType([
    T.StructField("body", S, True),
    T.StructField("isBase64Encoded", B, True),
    T.StructField("headers", T.MapType(S, S), True),
])

JOB = _struct(("version", I), ("delivery_id", S), ("work_type", S), ("event", S),
              ("action", S), ("repo", S), ("pr_number", L))

REJECT = _struct(("operator", S), ("key", S), ("reason", S))
