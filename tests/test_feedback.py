"""Reply threads (C2), ordinals (E1), reviewers (B2), trusted filter (B3), eligibility."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from feedmine.session import materialize
from feedmine.operators import feedback as fb
from feedmine.operators.ordering import with_ordinal

CSCHEMA = ("repo string, pr_number long, id long, in_reply_to_id long, login string, body string, "
           "created_at string, html_url string, item_ord long")


def _comments(spark, rows):
    return spark.createDataFrame([("r", 1, i, p, a, f"b{i}", "", "", k) for k, (i, p, a) in enumerate(rows)],
                                 CSCHEMA)


def bfs(rows, root):
    kids = {}
    for i, p, _ in rows:
        if p is not None:
            kids.setdefault(p, []).append(i)
    out, pending = [], list(kids.get(root, []))
    while pending:
        n = pending.pop(0)
        out.append(n)
        pending.extend(kids.get(n, []))
    return out


def _replies(spark, rows, root_ids):
    c = _comments(spark, rows)
    roots = c.where(F.col("id").isin(root_ids)).select("repo", "pr_number", "id")
    got = {r["root_id"]: [x["github_comment_id"] for x in r["replies"]] for r in fb.attach_replies(c, roots).collect()}
    return got


def test_threads_breadth_first_any_author(spark):
    rows = [(1, None, "Trusted"), (2, 1, "author"), (3, 1, "other"), (4, 2, "trusted"),
            (5, None, "someone"), (6, 5, "trusted"), (7, 99, "orphan"), (8, 9, "x"), (9, 8, "y")]
    got = _replies(spark, rows, [1])
    assert got == {1: [2, 3, 4]}


def test_deep_chain_over_100_levels(spark):
    rows = [(1, None, "t")] + [(i, i - 1, "a") for i in range(2, 130)]
    got = _replies(spark, rows, [1])
    assert got[1] == list(range(2, 130))


@settings(max_examples=10, deadline=None)
@given(st.integers(min_value=0, max_value=10_000))
def test_random_forests_match_bfs(spark, seed):
    rnd = random.Random(seed)
    rows = [(1, None, "t")]
    for i in range(2, 30):
        rows.append((i, rnd.choice([r[0] for r in rows]) if rnd.random() < 0.9 else None, "a"))
    rnd.shuffle(rows)
    got = _replies(spark, rows, [1])
    assert got.get(1, []) == bfs(rows, 1)


def test_with_ordinal_matches_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"), (F.col("id") % 3).alias("g"))
    got = with_ordinal(df, ["g", "k"], num_partitions=7).select("g", "k", "ordinal").collect()
    exp = sorted((r["g"], r["k"]) for r in df.collect())
    assert sorted((r["ordinal"], r["g"], r["k"]) for r in got) == [(i, g, k) for i, (g, k) in enumerate(exp)]


def test_reviewers_trim_dedup_keep_first_spelling(spark):
    out, _ = fb.normalize_reviewers([" Alice ", "bob", "ALICE", "Bob "], spark)
    assert sorted((r["ordinal"], r["name"]) for r in out.collect()) == [(0, "Alice"), (1, "bob")]
    with pytest.raises(ValueError):
        fb.normalize_reviewers(["ok", "  "], spark)
    with pytest.raises(ValueError):
        fb.normalize_reviewers([], spark)


def test_trusted_filter_and_eligible_summaries(spark):
    reviews = spark.createDataFrame(
        [(1, "Alice", "DISMISSED", "x"), (2, "alice", "PENDING", "y"), (3, "alice", None, "z"),
         (4, "alice", "APPROVED", ""), (5, "alice", "APPROVED", None), (6, None, "APPROVED", "w"),
         (7, "mallory", "APPROVED", "v")], "id long, login string, state string, body string")
    rv, _ = fb.normalize_reviewers(["ALICE"], spark)
    got = sorted(r["id"] for r in fb.trusted_only(fb.eligible_reviews(reviews), rv).collect())
    assert got == [2, 3]


def test_diff_guard_blank_and_cap(spark):
    d = spark.createDataFrame([(1, " \n\t"), (2, "x" * 10), (3, "x" * 11)], "pr_number long, final_diff string")
    got = {r["pr_number"]: r["reason"] for r in fb.guard_diffs(d, 10).collect()}
    assert got[1] == "empty final diff" and got[2] is None and got[3].startswith("final diff is 11")


def _forest(rng, n):
    """Replies of three PRs: trees, orphans, cycles and replies below cycles; ids repeat between PRs."""
    rows = []
    for pr in range(3):
        ids = list(range(1, n + 1))
        for k in ids:
            kind = rng.random()
            parent = None if kind < 0.1 else rng.randint(1, k - 1) if kind < 0.9 and k > 1 else rng.randint(1, n) if kind < 0.97 else 10_000 + k
            rows.append(("r", pr, k, parent, f"u{k}", "b", "", "", rng.randint(0, 50) * 1000 + k))
    return rows


def _breadth_first(rows, roots):
    below = {}
    for r in sorted(rows, key=lambda r: r[8]):
        if r[3] is not None:
            below.setdefault((r[1], r[3]), []).append(r)
    out = {}
    for pr, root in roots:
        queue, found = list(below.get((pr, root), ())), []
        while queue:
            r = queue.pop(0)
            found.append(r[2])
            queue += below.get((pr, r[2]), ())
        if found:
            out[pr, root] = found
    return out


COMMENTS = "repo string, pr_number long, id long, in_reply_to_id long, login string, body string, created_at string, html_url string, item_ord long"


def test_replies_equal_breadth_first_search(spark):
    import random
    rng = random.Random(5)
    for n in (12, 60):
        rows = _forest(rng, n)
        roots = [(r[1], r[2]) for r in rows if r[3] is None and rng.random() < 0.8]
        frame = spark.createDataFrame(rows, COMMENTS)
        got = fb.attach_replies(frame, spark.createDataFrame([("r", *x) for x in roots], "repo string, pr_number long, id long"))
        assert {(r["pr_number"], r["root_id"]): [x["github_comment_id"] for x in r["replies"]] for r in got.collect()} == _breadth_first(rows, roots)


def test_a_thousand_levels_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(fb, "materialize", lambda df: rounds.append(1) or materialize(df))
    rows = [("r", 1, k, k - 1 if k else None, "u", "b", "", "", k) for k in range(1001)]
    got = fb.attach_replies(spark.createDataFrame(rows, COMMENTS), spark.createDataFrame([("r", 1, 0)], "repo string, pr_number long, id long")).collect()
    assert [x["github_comment_id"] for x in got[0]["replies"]] == list(range(1, 1001)) and len(rounds) <= 12
