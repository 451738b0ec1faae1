"""Selection and supersession (B8, C8, F1), against hand rows and a sequential model."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from feedmine.operators.curate import curate, curated_order

SCHEMA = ("repo string, github_comment_id long, comment_type string, category string, merged_at string, "
          "implemented boolean, include_in_vector_store boolean, supersedes_prior_architecture boolean, "
          "ordinal long")


def sequential(notes):
    """Direct model of the reference fold (for the property test)."""
    sel = [n for n in notes if (n["implemented"] is None or n["implemented"])
           and (n["include_in_vector_store"] is None or n["include_in_vector_store"])]
    ordered = sorted(enumerate(sel), key=lambda x: (x[1]["merged_at"] or "", x[0]))
    active = []
    for _, n in ordered:
        if n["supersedes_prior_architecture"] and n["merged_at"]:
            active = [e for e in active if not (e["repo"] == n["repo"] and e["category"] == "architecture"
                                                and e["merged_at"] and e["merged_at"] < n["merged_at"])]
        active.append(n)
    return active


def _df(spark, notes):
    return spark.createDataFrame([tuple(n[k] for k in (
        "repo", "github_comment_id", "comment_type", "category", "merged_at", "implemented",
        "include_in_vector_store", "supersedes_prior_architecture", "ordinal")) for n in notes], SCHEMA)


def _note(i, repo="r", cat="architecture", merged="2026-01-01", sup=False, imp=None, inc=None):
    return dict(repo=repo, github_comment_id=i, comment_type="review_comment", category=cat, merged_at=merged,
                implemented=imp, include_in_vector_store=inc, supersedes_prior_architecture=sup, ordinal=i)


def test_newer_architecture_supersedes_older(spark):
    notes = [_note(1, merged="2026-01-01"), _note(2, merged="2026-02-01", sup=True),
             _note(3, merged="2026-01-15", cat="testing"), _note(4, repo="other", merged="2025-01-01")]
    out = sorted(r["github_comment_id"] for r in curate(_df(spark, notes)).collect())
    assert out == [2, 3, 4]


def test_unknown_merge_time_is_never_removed_and_never_supersedes(spark):
    notes = [_note(1, merged=""), _note(2, merged="", sup=True), _note(3, merged="2025-01-01")]
    out = sorted(r["github_comment_id"] for r in curate(_df(spark, notes)).collect())
    assert out == [1, 2, 3]


def test_equal_times_survive_and_absent_flags_mean_true(spark):
    notes = [_note(1, merged="2026-01-01"), _note(2, merged="2026-01-01", sup=True),
             _note(3, merged="2026-03-01", imp=False), _note(4, merged="2026-03-01", inc=False)]
    out = sorted(r["github_comment_id"] for r in curate(_df(spark, notes)).collect())
    assert out == [1, 2]


note_st = st.builds(
    lambda i, repo, cat, m, sup, imp, inc: _note(i, repo, cat, m, sup, imp, inc),
    st.integers(), st.sampled_from(["a", "b"]), st.sampled_from(["architecture", "testing"]),
    st.sampled_from(["", "2026-01-01", "2026-02-01", "2026-03-01T00:00:00Z", "2026-02"]),
    st.booleans(), st.sampled_from([None, True, False]), st.sampled_from([None, True, False]))


@settings(max_examples=25, deadline=None)
@given(st.lists(note_st, min_size=0, max_size=12))
def test_closed_form_equals_sequential_fold(spark, notes):
    for k, n in enumerate(notes):
        n["github_comment_id"] = k
        n["ordinal"] = k
    expected = [n["github_comment_id"] for n in sequential(notes)]
    if not notes:
        return
    got = [r["github_comment_id"] for r in curated_order(curate(_df(spark, notes))).collect()]
    assert got == expected
