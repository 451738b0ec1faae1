"""Review context (B11, H13, H14, C9), vectors (K1-K5), roll-ups (A5, J3) and sources."""

import base64
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from feedmine.functions.text import json_ascii_len
from feedmine.operators import review as rv
from feedmine.operators import rollup as ru
from feedmine.operators import vectors as vx
from feedmine.schemas import VECTOR
from feedmine.sources import snapshot as snap
from feedmine.sources.pages import read_pages


def test_json_ascii_len_matches_json_dumps(spark):
    vals = ["abc", 'a"b\\c', "\n\t\x01é", "😀x", "é€\x7f\x0b\x0c\x08"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    assert [r[0] for r in df.select(json_ascii_len(F.col("s"))).collect()] == [len(json.dumps(v)) - 2 for v in vals]


def test_manifest_length_and_caps(spark):
    blobs = spark.createDataFrame([("r", "h", "a.py", "s1", 10), ("r", "h", "b/é.py", "s2", 20),
                                   ("r", "h", "big", "s3", 99)], "repo string, head_sha string, path string, sha string, size long")
    manifest, rejects = rv.selectable(blobs, max_file=50, max_manifest=10_000)
    expected = json.dumps([{"path": "a.py", "size": 10}, {"path": "b/é.py", "size": 20}], separators=(",", ":"))
    assert sorted(r["path"] for r in manifest.collect()) == ["a.py", "b/é.py"]
    _, rej = rv.selectable(blobs, max_file=50, max_manifest=len(expected) - 1)
    assert rej.first()["reason"] == f"repository tree is {len(expected)} characters; maximum supported is {len(expected) - 1}"
    _, rej2 = rv.selectable(blobs, max_entries=2, max_file=50)
    assert rej2.first()["reason"].startswith("repository tree has 3 files")


def test_selection_checks(spark):
    manifest = spark.createDataFrame([("r", "h", "a", "s", 10), ("r", "h", "b", "s", 10)],
                                     "repo string, head_sha string, path string, sha string, size long")
    sels = [json.dumps({"paths": ["a"]}), json.dumps({"paths": ["a"], "x": 1}), json.dumps({"paths": ["a", "a"]}),
            json.dumps({"paths": ["a", "zz"]}), json.dumps({"paths": [""]}), json.dumps({"paths": ["a"] * 9})]
    df = spark.createDataFrame([(f"r", f"h", s) for s in sels], "repo string, head_sha string, selection string") \
        .withColumn("repo", F.concat(F.lit("r"), F.monotonically_increasing_id().cast("string")))
    m = manifest.crossJoin(df.select(F.col("repo").alias("rr"))).select(F.col("rr").alias("repo"), "head_sha", "path", "sha", "size")
    _, checks = rv.validate_selection(df, m)
    got = sorted((r["repo"], r["reason"]) for r in checks.collect())
    reasons = [r for _, r in got]
    assert reasons.count(None) == 1
    assert "selection is not just a list of paths" in reasons
    assert "selection repeats a path" in reasons
    assert "selection has an unknown path: zz" in reasons
    assert "selection has a path that is no text" in reasons
    assert "selection has over 8 files" in reasons


def test_blob_decoding(spark):
    ok = base64.b64encode("héllo".encode()).decode()
    wrapped = ok[:4] + "\n" + ok[4:]
    rows = [("1", "base64", wrapped), ("2", "base64", base64.b64encode(b"\xff\xfe").decode()),
            ("3", "base64", base64.b64encode(b"x" * 20).decode()), ("4", "base64", "!!"), ("5", "utf-8", "x")]
    df = spark.createDataFrame(rows, "sha string, encoding string, content string")
    got = {r["sha"]: (r["status"], r["text"]) for r in rv.decode_blobs(df, max_bytes=10).collect()}
    assert got["1"] == ("ok", "héllo")
    assert got["2"][0] == "skipped: not UTF-8 text"
    assert got["3"][0] == "skipped: too large"
    assert got["4"][0].startswith("error: invalid base64")
    assert got["5"][0].startswith("error: unsupported")


def test_publish_plan(spark):
    m = lambda sha: f"body\n\n<!-- feedmine:{sha} -->"
    reviews = spark.createDataFrame([
        ("r", 1, 10, m("aaa"), "PENDING", "u10", 0), ("r", 1, 11, m("aaa"), "COMMENTED", "u11", 1),
        ("r", 2, 20, m("bbb"), "PENDING", "u20", 0), ("r", 3, 30, m("ccc"), None, "u30", 0)],
        "repo string, pr_number long, id long, body string, state string, html_url string, item_ord long")
    drafts = spark.createDataFrame([("r", 1, "aaa"), ("r", 2, "bbb"), ("r", 3, "ccc"), ("r", 4, "ddd")],
                                   "repo string, pr_number long, head_sha string")
    current = spark.createDataFrame([("r", 1, "aaa"), ("r", 2, "bbb"), ("r", 3, "ccc"), ("r", 4, "eee")],
                                    "repo string, pr_number long, head_sha string")
    plan = rv.plan_review_posts(reviews, drafts, current).orderBy("pr_number", "step").collect()
    got = [(r["pr_number"], r["action"], r["review_id"], r["url"]) for r in plan]
    assert got == [(1, "delete", 10, None), (1, "skip", None, "u11"),
                   (2, "delete", 20, None), (2, "create", None, None), (2, "submit", None, None),
                   (3, "skip", None, "u30"),
                   (4, "create", None, None), (4, "delete_created_and_fail", None, None)]


def _notes(spark, n):
    rows = [("r", i % 3, i, "review_comment", None, f"body {i}", "testing", "nitpick", f"u{i % 2}",
             "i", "c", "why", "ex", "", [math.cos(i), math.sin(i), 0.5], i) for i in range(n)]
    return spark.createDataFrame(rows, "repo string, pr_number long, github_comment_id long, comment_type string, "
                                 "file_path string, original_body string, category string, severity string, "
                                 "reviewer string, original_issue string, requested_change string, rationale string, "
                                 "implementation_example string, merged_at string, embedding array<float>, ordinal long") \
        .withColumn("pr_url", F.lit("u"))


def test_vectors_upsert_delete_replace_search(spark):
    empty = spark.createDataFrame([], VECTOR)
    idx = vx.save_vectors(empty, _notes(spark, 10))
    assert idx.count() == 10
    again = vx.save_vectors(idx, _notes(spark, 3).withColumn("category", F.lit("style")))
    assert again.count() == 10 and again.where(F.col("category") == "style").count() == 3
    assert vx.delete_vectors(again, _notes(spark, 2)).count() == 8
    with pytest.raises(ValueError):
        vx.replace_vectors(again, _notes(spark, 2), [])
    assert vx.replace_vectors(again, _notes(spark, 4), ["r"]).count() == 4
    q = [math.cos(3), math.sin(3), 0.5]
    top = vx.search(idx, q, "r", limit=2).orderBy("rank").collect()
    assert top[0]["rank"] == 1 and len(top) == 2
    assert vx.search(idx, q, "r", limit=3, reviewers=["U1"]).count() == 0   # case-sensitive
    assert vx.search(idx, q, "r", limit=3, reviewers=["U1"], fold_case=True).count() == 3
    with pytest.raises(ValueError):
        vx.search(idx, q, "r", query_text="  ")


def test_synthesis_call_counts(spark):
    calls = []

    def caller(system, prompt):
        return "x"
    notes = _notes(spark, 3)
    _, n1 = ru.synthesize(notes, caller, "s", ["a"], chunk=400)
    _, n3 = ru.synthesize(notes, caller, "s", ["a"], chunk=2)
    assert (n1, n3) == (1, 3)


def test_report_blocks_order(spark):
    notes = _notes(spark, 4).withColumn("pr_title", F.concat(F.lit("t"), F.col("pr_number").cast("string")))
    blocks = ru.report_blocks(notes).orderBy("repo_ord", "pr_ord").collect()
    assert [b["pr_number"] for b in blocks] == [0, 1, 2]
    assert blocks[0]["block"].startswith("### PR #0: t0\n\n- **[testing / nitpick]** (general)\n  - Original: i")


def test_pages_bad_page_named(spark):
    pages = spark.createDataFrame([("q", 1, json.dumps([{"a": 1}, {"a": 2}])), ("q", 2, json.dumps({"a": 3}))],
                                  "request_id string, page_no int, page string")
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("a", T.LongType())])
    with pytest.raises(ValueError, match="page 2 was not a JSON array"):
        read_pages(pages, schema)
    items, _ = read_pages(pages, schema, strict=False)
    assert [r["a"] for r in items.orderBy("page_no", "item_pos").collect()] == [1, 2]


def test_failed_publish_is_invisible(spark, tmp_path):
    root = str(tmp_path / "snap")
    a = spark.createDataFrame([(1,)], "x long")
    b = spark.createDataFrame([(2,)], "x long")
    snap.publish_snapshot(spark, root, {"t": a, "state": a})
    with pytest.raises(RuntimeError):
        snap.publish_snapshot(spark, root, {"t": b, "state": b}, fail_after="t")
    assert [r["x"] for r in snap.read_snapshot(spark, root, "t").collect()] == [1]


def test_near_duplicates_grouped_by_star_edges(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(0, "en", base), (1, "en", base + " again"), (2, "en", base.upper()),
            (3, "en", "completely different words that share nothing at all here"),
            (4, "fr", base), (5, "en", base.replace("today", "tomorrow")), (6, "en", "")]
    items = spark.createDataFrame(rows, "ordinal long, category string, text string")
    got = {r["ordinal"]: r["rep"] for r in ru.merge_similar(items, threshold=0.7).collect()}
    assert got[1] == got[2] == got[5] == 0       # near copies and an exact copy (case folded)
    assert got[3] == 3 and got[4] == 4 and got[6] == 6   # other text, other group, no shingles


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(25):  # families: edits of a text at several distances, so that some links skip the least id
        base = [rng.choice(words) for _ in range(rng.randint(3, 40))]
        for _ in range(6):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    texts += ["w1  w2!", None, None, "", "", "W1 w2 w3", "w1 w2, w3", "w1 w2 w3 " * 50]
    rng.shuffle(texts)
    rows = [(i, rng.choice(["en", None]), t) for i, t in enumerate(texts)]

    def shingles(t):
        w = [x for x in re.split(r"[^a-z0-9]+", (t or "").lower()) if x]
        return {tuple(w[i:i + 3]) for i in range(len(w) - 2)}
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    sets = [shingles(t) for _, _, t in rows]
    for i, (_, g, t) in enumerate(rows):
        for j in range(i):
            same = (t and t.lower()) == (rows[j][2] and rows[j][2].lower())
            if g == rows[j][1] and (same or sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.7):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    items = spark.createDataFrame(rows, "ordinal long, category string, text string")
    got = {r["ordinal"]: r["rep"] for r in ru.merge_similar(items).collect()}
    assert got == {i: find(i) for i in range(len(rows))}
    assert ru.merge_similar(items.where("false")).count() == 0
