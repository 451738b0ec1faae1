"""State migration (A7), dead-letter retention (I3), executor-side HMAC (H7), wait-for-merge (I4)."""

import hashlib
import hmac
import json
import os

import pytest
from pyspark.sql import functions as F

from feedmine.functions.hmac import hmac_sha256_udf
from feedmine.sources import snapshot as snap
from feedmine.streaming import pipeline as sp


def _doc(tmp_path, name, doc):
    p = tmp_path / name
    p.write_text(json.dumps(doc))
    return str(p)


def test_legacy_state_versions(spark, tmp_path):
    note = {"repo": "r", "pr_number": 1, "github_comment_id": 2, "comment_type": "review_comment",
            "category": "testing"}
    v1 = _doc(tmp_path, "v1.json", {"version": 1, "raw_comments": [], "notes": [note]})
    t = snap.migrate_state_document(spark, v1)
    assert t["notes"].count() == 1 and t["pending_prs"].count() == 0
    v2 = _doc(tmp_path, "v2.json", {"version": 2, "raw_comments": [], "notes": [],
                                    "pending_prs": [{"repo": "r", "pr_number": 3}]})
    assert [r["pr_number"] for r in snap.migrate_state_document(spark, v2)["pending_prs"].collect()] == [3]
    with pytest.raises(RuntimeError, match="not initialised"):
        snap.migrate_state_document(spark, _doc(tmp_path, "v3.json", {"version": 3, "raw_comments": [], "notes": []}))
    with pytest.raises(ValueError, match="history arrays"):
        snap.migrate_state_document(spark, _doc(tmp_path, "bad.json", {"version": 2, "raw_comments": {}, "notes": []}))
    with pytest.raises(ValueError, match="pending_prs"):
        snap.migrate_state_document(spark, _doc(tmp_path, "badp.json", {"version": 2, "raw_comments": [],
                                                                         "notes": [], "pending_prs": 5}))


def test_retry_and_dead_letter(spark):
    log = spark.createDataFrame([
        ("a", 1, False, "2026-01-01 00:00:00"), ("a", 2, True, "2026-01-01 00:01:00"),
        *[("b", i, False, "2026-01-02 00:00:00") for i in range(1, 6)],
        ("c", 1, False, "2026-01-03 00:00:00")], "delivery_id string, receive int, ok boolean, at string") \
        .withColumn("at", F.to_timestamp("at"))
    got = {r["delivery_id"]: r["status"] for r in sp.split_failures(log).collect()}
    assert got == {"a": "done", "b": "dead", "c": "retry"}
    dead = sp.split_failures(log).where(F.col("status") == "dead")
    now = F.lit("2026-01-20 00:00:00").cast("timestamp")
    assert sp.dead_letters_kept(dead, now).count() == 0
    assert sp.dead_letters_kept(dead, F.lit("2026-01-10 00:00:00").cast("timestamp")).count() == 1


def test_executor_side_hmac(spark, tmp_path):
    secret = tmp_path / "secret"
    secret.write_text("k\n")
    body = b"payload"
    good = "sha256=" + hmac.new(b"k", body, hashlib.sha256).hexdigest()
    df = spark.createDataFrame([(bytearray(body), good), (bytearray(body), "sha256=00"), (bytearray(body), None)],
                               "b binary, s string")
    assert [r[0] for r in df.select(hmac_sha256_udf(secret_file=str(secret))("b", "s")).collect()] == [True, False, False]


def test_wait_for_merge_state(spark, tmp_path):
    root = str(tmp_path / "i4")
    obs = [("r", 1, 0, "open", None), ("r", 2, 0, "open", None), ("r", 1, 1, "closed", "2026-01-01"),
           ("r", 2, 1, "closed", None), ("r", 1, 2, "closed", "2026-01-01")]
    df = spark.createDataFrame(obs, "repo string, pr_number long, seq long, state string, merged_at string")
    for seq in (0, 1, 2):
        df.where(F.col("seq") == seq).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{root}/in")
        sp.run_available(sp.pending_until_merged(stream), f"{root}/out", f"{root}/ck")
    got = sorted((r["pr_number"], r["seq"], r["action"]) for r in spark.read.parquet(f"{root}/out").collect())
    assert got == [(1, 0, "pending"), (1, 1, "mine"), (1, 2, "mine"), (2, 0, "pending"), (2, 1, "forget")]


def test_a_pr_is_followed_without_frames(monkeypatch):
    """One call per PR: late, equal and unnumbered snapshots as before, and no frame is built to sort a few rows."""
    import pandas as pd

    class State:
        exists, get = True, (False, 3)

        def update(self, value):
            self.now = value

    state = State()
    pdfs = [pd.DataFrame({"seq": [5, 2], "state": ["closed", "open"], "merged_at": [None, None]}),
            pd.DataFrame({"seq": [4, None, 6], "state": ["open", "open", "closed"], "merged_at": [None, None, "2026-01-01"]})]
    monkeypatch.setattr(sp.pd, "concat", None)
    out = [tuple(r) for f in sp._pending_fn(("r", 1), iter(pdfs), state) for r in f.itertuples(index=False)]
    assert out == [("r", 1, 4, "pending"), ("r", 1, 5, "forget"), ("r", 1, 6, "mine")] and state.now == (False, 6)


def test_prs_of_a_bucket_share_a_state(spark, tmp_path):
    """There was a call and a state for each PR. The same rows come of it, also for repeated, late and unnumbered snapshots and null keys."""
    import random
    rng = random.Random(4)
    big = 2 ** 53 + 1
    prs = [(f"r{n % 3}", n) for n in range(60)] + [("r0", None), (None, 7), (None, None), ("r0", big), ("r0", big - 1)]
    batches = [[(*rng.choice(prs), rng.choice([None, *range(-2, 9)]), *rng.choice([("open", None), ("open", ""), (None, None), ("closed", None),
                                                                               ("closed", ""), ("closed", "2026-01-01")])) for _ in range(300)] for _ in range(3)]
    # Equal numbers of one PR and batch have no order, so only equal snapshots share one.
    batches = [[*{r[:3]: r for r in b}.values()] for b in batches]
    batches = [b + b[:20] for b in batches]
    found, states = [], []
    for buckets in (None, 4):
        root = str(tmp_path / f"i4-{buckets}")
        for n, batch in enumerate(batches):
            df = spark.createDataFrame(batch, "repo string, pr_number long, seq long, state string, merged_at string")
            df.write.mode("append").parquet(f"{root}/in")
            stream = sp.pending_until_merged(spark.readStream.schema(df.schema).parquet(f"{root}/in"), buckets)
            q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start()
            q.awaitTermination()
        states.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
        found.append(sorted(map(repr, spark.read.parquet(f"{root}/out").collect())))
    assert found[0] == found[1] and len(found[0]) > 100 and f"pr_number={big}," in "".join(found[1])
    assert states[0] > 60 and states[1] == 4
