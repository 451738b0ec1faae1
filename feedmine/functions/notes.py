"""Column expressions over notes: stable id (H1), indexed content (H2),
compact projection (B9) and the report line (A5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def note_id(repo="repo", comment_type="comment_type", github_comment_id="github_comment_id",
            pr_number="pr_number", file_path="file_path", original_body="original_body") -> Column:
    """SHA-256 hex of ``repo|comment_type|source``.

    source is the comment id when it is non-zero, else ``pr|path or ''|body``.
    ``concat`` (not ``concat_ws``) so that a null part is never silently dropped.
    """
    gid = _c(github_comment_id)
    source = F.when(F.coalesce(gid, F.lit(0)) != 0, gid.cast("string")).otherwise(
        F.concat(_c(pr_number).cast("string"), F.lit("|"),
                 F.coalesce(_c(file_path), F.lit("")), F.lit("|"), _c(original_body)))
    return F.sha2(F.concat(_c(repo), F.lit("|"), _c(comment_type), F.lit("|"), source), 256)


def note_content() -> Column:
    """Five fields joined by newlines, empty and missing ones skipped, in fixed order."""
    parts = ["original_issue", "requested_change", "rationale", "original_body",
             "implementation_example"]
    return F.concat_ws("\n", *[F.nullif(F.col(p), F.lit("")) for p in parts])


def comment_key() -> Column:
    """Curation key (C7): (repo, comment_type, comment id or html_url or '').

    The reference's key has no repo, which gives the same result for its single
    repository; with many repos the repo must be part of it. Notes carry no
    html_url, so a zero id falls back to ''.
    """
    gid = F.col("github_comment_id")
    ident = F.when(F.coalesce(gid, F.lit(0)) != 0, gid.cast("string")).otherwise(F.lit(""))
    return F.concat_ws("|", F.col("repo"), F.col("comment_type"), ident)
