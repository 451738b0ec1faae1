"""I3 as a keyed stateful stream: counted receives, timers, dead letters, copies, a restart."""

import json

import pytest
from pyspark.sql import functions as F

from feedmine.streaming import pipeline as sp
from feedmine.streaming import retry as rt

SCHEMA = f"delivery_id string, {rt.JOB}"


def worker():
    """A handler, made here so that it travels by value: workers can't import test modules."""
    def flaky(job):
        """Fails by the delivery's name: ``f2...`` for two receives, ``dead...`` always."""
        name = job["delivery_id"]
        if name.startswith("dead") or (name.startswith("f") and job["receive"] <= int(name[1])):
            raise RuntimeError(f"receive {job['receive']} of {job['repo']}#{job['pr_number']}")
    return flaky


def land(folder, name, *deliveries):
    folder.mkdir(parents=True, exist_ok=True)
    rows = [{"delivery_id": d, "version": 1, "work_type": "mining", "event": "pull_request", "action": "closed", "repo": "r", "pr_number": k}
            for k, d in enumerate(deliveries)]
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def run(spark, tmp_path, visibility_ms=50):
    jobs = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    query = rt.start(rt.receives(jobs, worker(), visibility_ms=visibility_ms), str(tmp_path / "out"), str(tmp_path / "ckpt"), "100 milliseconds")
    rt.run_until_settled(query, spark, str(tmp_path / "out"), 120)


def test_receives_are_counted_and_copies_ignored(spark, tmp_path):
    land(tmp_path / "in", "1.json", "ok1", "f2", "dead", "ok1", "f4")
    run(spark, tmp_path)
    root = str(tmp_path / "out")
    want = {"ok1": (1, "done"), "f2": (3, "done"), "f4": (5, "done"), "dead": (5, "dead")}
    assert {r["delivery_id"]: (r["receives"], r["status"]) for r in rt.last_status(spark, root).collect()} == want
    log = sorted((r["delivery_id"], r["receive"], r["status"]) for r in rt.read_receives(spark, root).collect())
    assert log == sorted((d, k, "retry" if k < n else s) for d, (n, s) in want.items() for k in range(1, n + 1))
    dead = rt.read_dead(spark, root).collect()
    assert [(r["delivery_id"], r["error"], r["pr_number"]) for r in dead] == [("dead", "RuntimeError: receive 5 of r#2", 2)]
    assert sp.dead_letters_kept(rt.read_dead(spark, root)).count() == 1
    assert sp.dead_letters_kept(rt.read_dead(spark, root), F.current_timestamp() + F.expr("INTERVAL 15 DAYS")).count() == 0

    # A restart goes on from the stored state: settled deliveries stay settled, new ones are handled.
    land(tmp_path / "in", "2.json", "ok1", "dead", "f2", "late")
    run(spark, tmp_path)
    again = {r["delivery_id"]: (r["receives"], r["status"]) for r in rt.last_status(spark, root).collect()}
    assert again == want | {"late": (1, "done")}


def test_a_waiting_job_survives_a_restart(spark, tmp_path):
    """The query is stopped while a job waits; the next run finds its timer and count in the state."""
    land(tmp_path / "in", "1.json", "f1")
    jobs = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    root = str(tmp_path / "out")
    query = rt.start(rt.receives(jobs, worker(), visibility_ms=4000), root, str(tmp_path / "ckpt"), "100 milliseconds")
    try:
        while not rt.read_receives(spark, root).count():
            assert query.isActive
    finally:
        query.stop()
    assert [(r["receives"], r["status"]) for r in rt.last_status(spark, root).collect()] == [(1, "retry")]
    run(spark, tmp_path, visibility_ms=4000)
    assert [(r["receives"], r["status"]) for r in rt.last_status(spark, root).collect()] == [(2, "done")]


def test_a_replayed_batch_replaces_its_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "dead", "x", None, 1, "mining", "e", "a", "r", 1)], rt.RECEIVES).withColumn("at", F.current_timestamp())
    for _ in range(2):
        rt.write_receives(rows, 7, str(tmp_path))
    assert rt.read_receives(spark, str(tmp_path)).count() == 1 and rt.read_dead(spark, str(tmp_path)).count() == 1


def test_only_waiting_jobs_hold_a_state(spark, tmp_path):
    """Settled deliveries keep the mark that stops their copies, and no more."""
    land(tmp_path / "in", "1.json", *(f"ok{k}" for k in range(40)), "f1", "f9", "dead", "ok1", "dead")
    jobs = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    query = rt.start(rt.receives(jobs, worker(), visibility_ms=50), str(tmp_path / "out"), str(tmp_path / "ckpt"), "100 milliseconds")
    rt.run_until_settled(query, spark, str(tmp_path / "out"), 120)
    marks = {o["operatorName"]: [] for p in query.recentProgress for o in p["stateOperators"]}
    for p in query.recentProgress:
        for o in p["stateOperators"]:
            marks[o["operatorName"]].append(o["numRowsTotal"])
    assert max(marks["dedupe"]) == 43 and max(v for k, m in marks.items() if k != "dedupe" for v in m) == 3
    assert all(m[-1] == 0 for k, m in marks.items() if k != "dedupe")
    assert rt.waiting(spark, str(tmp_path / "out")) == (42 - 2 + 2 + 5 + 5, 0)


def test_a_long_batch_is_not_cut_off(spark, tmp_path):
    """The time limit counts while nothing is received, not while a batch is at work."""
    def slow(job):
        time.sleep(3)
    import time
    land(tmp_path / "in", "1.json", "a")
    jobs = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    root = str(tmp_path / "out")
    rt.run_until_settled(rt.start(rt.receives(jobs, slow), root, str(tmp_path / "ckpt"), "100 milliseconds"), spark, root, 1)
    assert [(r["receives"], r["status"]) for r in rt.last_status(spark, root).collect()] == [(1, "done")]

    land(tmp_path / "in", "2.json", "f1")
    with pytest.raises(TimeoutError, match="1 deliveries still wait"):
        rt.run_until_settled(rt.start(rt.receives(jobs, worker(), visibility_ms=10 ** 6), root, str(tmp_path / "ckpt"), "100 milliseconds"), spark, root, 1)
