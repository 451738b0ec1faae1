"""Nothing is lost, doubled or overwritten in silence: analysis, evidence, dispatch, snapshots, vectors, review."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from small_data import SF_SMALL
from feedmine.operators import review as rv
from feedmine.operators import rollup as ru
from feedmine.operators import validate as va
from feedmine.operators import vectors as vx
from feedmine.plans import analysis as an
from feedmine.plans.catalog import valid_fake_model
from feedmine.sources import replay_fixture as rf
from feedmine.sources import snapshot as snap
from feedmine.sources import testdata as fx
from feedmine.sources.tables import checked_evidence, merged_evidence
from feedmine.streaming import pipeline as sp


@pytest.fixture(scope="module")
def equal_comments(spark):
    """Four equal comments on one PR in two batches, so both batches have the same prompt."""
    b = rf.batched_roots(spark, SF_SMALL).where("ordinal < 4")
    one = b.where("ordinal = 0").drop("ordinal", "batch_id", "pos", "github_comment_id").limit(1)
    rows = spark.range(4).select(F.col("id").alias("ordinal"), (F.col("id") + 100).alias("github_comment_id"),
                                 F.floor(F.col("id") / 2).cast("long").alias("batch_id"), (F.col("id") % 2).alias("pos"))
    return one.crossJoin(rows).select(*b.columns).checkpoint()


def test_equal_prompts_give_each_comment_one_note(spark, equal_comments):
    notes = an.analyze_with_caller(equal_comments, fx.pr_diffs(spark, SF_SMALL), valid_fake_model, "system")
    assert sorted(r["github_comment_id"] for r in notes.collect()) == [100, 101, 102, 103]


def test_a_call_that_raises_is_tried_again(spark, equal_comments, tmp_path):
    folder = str(tmp_path)

    def fails_first(system, prompt):
        import os
        tries = len(os.listdir(folder))
        open(f"{folder}/{tries}", "w").close()
        if tries < 2:
            raise ConnectionError("reset")
        return valid_fake_model(system, prompt)

    notes = an.analyze_with_caller(equal_comments, fx.pr_diffs(spark, SF_SMALL), fails_first, "system")
    assert notes.count() == 4 and len(list(tmp_path.iterdir())) == 3  # one call per attempt, as the prompts are equal

    def always_fails(system, prompt):
        raise ConnectionError("reset by peer")

    with pytest.raises(RuntimeError, match="after 3 attempts: model call failed: reset by peer"):
        an.analyze_with_caller(equal_comments, fx.pr_diffs(spark, SF_SMALL), always_fails, "system")


def test_batch_without_a_recorded_response_fails(spark):
    batched = rf.batched_roots(spark, SF_SMALL).checkpoint()
    recorded = rf.recorded_responses(spark, SF_SMALL, batched).where("batch_id <> 1")
    diffs = fx.pr_diffs(spark, SF_SMALL)
    notes, _, failed = an.analyze_recorded(batched, diffs, recorded, strict=False)
    lost = {r["batch_id"] for r in failed.collect()}
    assert 1 in lost
    done = {r["batch_id"] for r in batched.select("batch_id", "github_comment_id").join(notes, "github_comment_id").collect()}
    assert done | lost == {r["batch_id"] for r in batched.select("batch_id").collect()} and not done & lost
    with pytest.raises(RuntimeError):
        an.analyze_recorded(batched, diffs, recorded)


def test_batch_without_any_attempt_fails(spark):
    status = spark.createDataFrame([(1, 1, True, None)], "batch_id long, attempt int, valid boolean, reason string")
    accepted, failed = va.accept_attempts(status, 3, spark.createDataFrame([(1,), (2,)], "batch_id long"))
    assert [r["batch_id"] for r in accepted.collect()] == [1]
    assert [(r["batch_id"], r["attempts"]) for r in failed.collect()] == [(2, 0)]


def test_merged_pr_without_a_diff_is_refused(spark):
    prs = spark.createDataFrame([("r", 1, "2024"), ("r", 2, "2024"), ("r", 3, None)], "repo string, pr_number long, merged_at string")
    diffs = spark.createDataFrame([("r", 1, "+x")], "repo string, pr_number long, final_diff string")
    assert merged_evidence(prs, diffs).count() == 2
    evidence, rejects = checked_evidence(prs, diffs, strict=False)
    assert [r["pr_number"] for r in evidence.collect()] == [1] and [r["pr_number"] for r in rejects.collect()] == [2]
    with pytest.raises(ValueError, match="r#2"):
        checked_evidence(prs, diffs)


def test_pr_without_an_assessment_is_a_reject(spark):
    evidence = spark.createDataFrame([("r", 1, "t", "b", "u", "2024", 0)],
                                     "repo string, pr_number long, title string, body string, html_url string, merged_at string, ordinal long")
    responses = spark.sql("SELECT 'r' AS repo, 9L AS pr_number, parse_json('{}') AS obj, CAST(NULL AS STRING) AS error")
    notes, rejects = va.architecture_notes(evidence, responses)
    assert notes.count() == 0 and [tuple(r) for r in rejects.collect()] == [("r", 1, "no architecture assessment")]


def test_handler_runs_once_per_delivery(spark, tmp_path):
    jobs = spark.createDataFrame([(1, f"d{k}", "mining", "e", "a", "r", k, 202) for k in range(5)],
                                 "version int, delivery_id string, work_type string, event string, action string, repo string, pr_number long, status int")
    calls = spark.sparkContext.accumulator(0)

    def handler(df):
        def run(batches):
            for pdf in batches:
                calls.add(len(pdf))
                yield pd.DataFrame({"delivery_id": pdf["delivery_id"], "ok": pdf["delivery_id"] != "d3"})
        return df.select("delivery_id").mapInPandas(run, "delivery_id string, ok boolean")

    receipts, results = f"{tmp_path}/receipts", f"{tmp_path}/results"
    sp.ev.jobs_of, kept = (lambda b: b), sp.ev.jobs_of
    try:
        sp.dispatch_batch(jobs, 0, handler, receipts, results)
        assert calls.value == 5
        sp.RECEIPT_BUCKETS, buckets = 7, sp.RECEIPT_BUCKETS  # receipts of another bucket count still count
        sp.dispatch_batch(jobs, 1, handler, receipts, results)
        sp.RECEIPT_BUCKETS = buckets
    finally:
        sp.ev.jobs_of = kept
    assert calls.value == 6
    done = spark.read.parquet(receipts)
    assert sorted(r["delivery_id"] for r in done.collect()) == ["d0", "d1", "d2", "d4"]


def test_versions_never_go_back(spark, tmp_path):
    root, df = str(tmp_path), spark.range(2)
    assert snap.latest_version(spark, root) is None
    assert [snap.publish_snapshot(spark, root, {"t": df}) for _ in range(3)] == [1, 2, 3]
    assert snap.publish_snapshot(spark, root, {"t": spark.range(5)}, version=3) == 3  # a replay
    with pytest.raises(ValueError, match="older"):
        snap.publish_snapshot(spark, root, {"t": df}, version=2)
    next((tmp_path / "_commits").glob("part-*.parquet")).write_bytes(b"torn")
    with pytest.raises(Exception, match="(?i)parquet"):
        snap.publish_snapshot(spark, root, {"t": df})
    assert sorted(p.name for p in (tmp_path / "t").glob("version=*")) == ["version=1", "version=2", "version=3"]


def test_late_snapshot_changes_nothing():
    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state = State()
    seen = lambda *rows: [tuple(r) for out in sp._pending_fn(("r", 1), iter([pd.DataFrame(
        rows, columns=["seq", "state", "merged_at"])]), state) for r in out[["seq", "action"]].to_numpy()]
    assert seen((1, "open", None)) == [(1, "pending")]
    assert seen((5, "closed", None)) == [(5, "forget")]
    assert seen((2, "open", None)) == [] and state.get == (False, 5)
    assert seen((6, "open", None), (4, "open", None)) == [(6, "pending")]


def vector_notes(spark, *vectors):
    rows = [("r", k, k, "title", "u", "review_comment", "f", "body", "testing", "i", "c", "w", "minor", "rev", True, True, "s", "e", False, False,
             "2024-01-01", k, v) for k, v in enumerate(vectors)]
    from feedmine.schemas import NOTE
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in NOTE.fields)
    return spark.createDataFrame(rows, f"{fields}, ordinal long, embedding array<float>")


def test_vectors_without_a_direction_are_refused(spark):
    good, bad = [1.0, 0.0], ([0.0, 0.0], [1.0, None], [1.0], [1.0, 2.0, 3.0], [], None)
    empty = vx.index_rows(vector_notes(spark, good)).select(*vx.INDEX_COLUMNS).limit(0)
    index = vx.save_vectors(empty, vector_notes(spark, good), dimension=2)
    assert index.count() == 1
    for vector in bad:
        rows = vector_notes(spark, good, vector, [0.0, 3.0])
        with pytest.raises(ValueError, match="rejected"):
            vx.save_vectors(index, rows)
        assert vx.save_vectors(index, rows, strict=False).count() == 2


def test_embeddings_follow_the_order_of_their_indices(spark):
    inputs = spark.createDataFrame([("q", 0, "a"), ("q", 1, "b")], "request_id string, pos long, text string")
    response = spark.createDataFrame([("q", 7, [2.0]), ("q", 3, [1.0])], "request_id string, index long, embedding array<float>")
    aligned, rejects = vx.align_embeddings(inputs, response)
    assert {r["text"]: r["embedding"] for r in aligned.collect()} == {"a": [1.0], "b": [2.0]} and rejects.count() == 0


def test_selections_of_one_head_are_judged_apart(spark):
    manifest = spark.createDataFrame([("r", "h", "a.py", "s1", 5)], "repo string, head_sha string, path string, sha string, size long")
    given = spark.createDataFrame([("r", 1, "h", '{"paths": ["a.py"]}'), ("r", 2, "h", '{"paths": ["b.py"]}')],
                                  "repo string, pr_number long, head_sha string, selection string")
    selected, checks = rv.validate_selection(given, manifest)
    assert [(r["pr_number"], r["path"]) for r in selected.collect()] == [(1, "a.py")]
    assert {r["pr_number"]: r["reason"] is None for r in checks.collect()} == {1: True, 2: False}


def test_labels_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(90)], "a long, b long")
    labels = ru.connected_min_label(edges, spark.range(91).select(F.col("id").alias("node")))
    assert {r["label"] for r in labels.collect()} == {0}


def files_of(root, table):
    return {str(p.relative_to(root)): p for p in root.glob(f"{table}/version=*/repo=*/part-*.parquet")}


def test_mining_writes_only_the_repos_it_touches(spark, tmp_path):
    state = fx.wave_state(spark, SF_SMALL)
    root = str(tmp_path)
    snap.publish_snapshot(spark, root, {"notes": state}, version=1)
    before = files_of(tmp_path, "notes")
    assert sorted(map(str, snap.read_snapshot(spark, root, "notes").collect())) == sorted(map(str, state.collect()))
    repo = state.groupBy("repo").count().orderBy(F.desc("count")).first()["repo"]
    keys = state.where(F.col("repo") == repo).select("repo", "pr_number").distinct()
    for batch in (0, 0):  # the second one replays the first
        sp.mine_batch(keys, batch, root, 1, lambda k: state.limit(0))
        fresh = {n: p for n, p in files_of(tmp_path, "notes").items() if n not in before}
        assert all(p.parent.name == f"repo={repo}" for p in fresh.values()) and set(before) <= set(files_of(tmp_path, "notes"))
        now = snap.read_snapshot(spark, root, "notes").collect()
        kept = state.where(F.col("repo") != repo).collect()
        assert sorted(map(str, now)) == sorted(map(str, kept))
    assert snap.read_snapshot(spark, root, "notes", 1).count() == state.count()
    old = [p for p in before.values() if p.parent.name == f"repo={repo}"]
    assert snap.drop_old_files(spark, root, "notes") == len(old) and not any(p.exists() for p in old)
    assert sorted(map(str, snap.read_snapshot(spark, root, "notes").collect())) == sorted(map(str, kept))


def test_snapshot_of_an_empty_table(spark, tmp_path):
    snap.publish_snapshot(spark, str(tmp_path), {"p": spark.createDataFrame([], "repo string, n long"), "q": spark.createDataFrame([], "n long")})
    assert snap.read_snapshot(spark, str(tmp_path), "p").collect() == [] and snap.read_snapshot(spark, str(tmp_path), "q").collect() == []


def test_failed_jobs_wait_and_the_fifth_failure_is_dead(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sp.ev, "jobs_of", lambda b: b)
    schema = "version int, delivery_id string, work_type string, event string, action string, repo string, pr_number long"
    jobs = lambda *ids: spark.createDataFrame([(1, i, "mining", "e", "a", "r", 1) for i in ids], schema)
    folder, root = str(tmp_path / "calls"), str(tmp_path)
    (tmp_path / "calls").mkdir()

    def handler(df):
        def run(batches):
            import os
            import uuid
            for pdf in batches:
                tries = []
                for i in pdf["delivery_id"]:
                    tries.append(sum(n.startswith(f"{i}-") for n in os.listdir(folder)))
                    open(f"{folder}/{i}-{uuid.uuid4().hex}", "w").close()
                ok = [i == "good" or i == "third" and n == 2 for i, n in zip(pdf["delivery_id"], tries, strict=True)]
                yield pd.DataFrame({"delivery_id": pdf["delivery_id"], "ok": ok})[pdf["delivery_id"] != "mute"]
        return df.select("delivery_id").mapInPandas(run, "delivery_id string, ok boolean")

    sp.retry_batch(jobs("good", "third", "never", "mute"), 0, handler, root)
    sp.retry_batch(jobs("good", "never"), 1, handler, root)  # sent again: one is done, the other waits already
    for batch in range(2, 7):
        sp.retry_batch(jobs(), batch, handler, root)
    calls = [p.name.split("-")[0] for p in (tmp_path / "calls").iterdir()]
    assert {i: calls.count(i) for i in set(calls)} == {"good": 1, "third": 3, "never": 5, "mute": 5}
    assert sorted(r["delivery_id"] for r in spark.read.parquet(f"{root}/receipts").collect()) == ["good", "third"]
    dead = spark.read.option("basePath", f"{root}/dead").parquet(f"{root}/dead/batch_id=*/date=*")
    assert sorted((r["delivery_id"], r["receives"]) for r in dead.collect()) == [("mute", 5), ("never", 5)]
    assert spark.read.parquet(f"{root}/waiting/batch_id=6").where("delivery_id IS NOT NULL").count() == 0
