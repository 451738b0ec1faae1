"""Merge-on-read tables against a dict that takes the same changes; bytes, replays, writers, plans."""

import random
from pathlib import Path

import pytest

from feedmine.sources import claims
from feedmine.sources import deltas as dl

SCHEMA = "id long, repo string, pr long, text string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def contents(df):
    return sorted(tuple(r) for r in df.collect())


def size(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_random_changes_equal_a_dict(spark, tmp_path):
    rng = random.Random(5)
    root = str(tmp_path)
    state = {i: (i, f"r{i % 3}", i % 5, None if i % 4 == 0 else "base") for i in range(20)}
    dl.create(spark, root, table(spark, list(state.values())), ["id"])
    history = {0: dict(state)}
    for step in range(1, 8):
        kind = rng.choice(["save", "delete", "repo", "slice", "save"])
        new = {i: (i, f"r{rng.randrange(3)}", rng.randrange(5), f"step {step}") for i in rng.sample(range(30), 4)}
        if kind == "save":
            version = dl.apply(spark, root, f"c{step}", table(spark, list(new.values())))
        elif kind == "delete":
            version = dl.apply(spark, root, f"c{step}", gone=[table(spark, list(new.values())).select("id")])
            state, new = {k: v for k, v in state.items() if k not in new}, {}
        else:
            cols = (1,) if kind == "repo" else (1, 2)
            slices = {tuple(("r1", 2)[c - 1] for c in cols)}
            leaving = table(spark, [(0, "r1", 2, "")]).select(*[["id", "repo", "pr"][c] for c in cols])
            version = dl.apply(spark, root, f"c{step}", table(spark, list(new.values())), [leaving])
            state = {k: v for k, v in state.items() if tuple(v[c] for c in cols) not in slices}
        state = {**state, **new}
        if step == 4:
            version = dl.compact(spark, root, "compact", ["repo"])
        history[version] = dict(state)
        assert contents(dl.read(spark, root)) == sorted(state.values()), (step, kind)
    for version, then in history.items():  # earlier versions stay readable
        assert contents(dl.read(spark, root, version)) == sorted(then.values())
    assert dl.drop_old_files(spark, root) > 0
    assert contents(dl.read(spark, root)) == sorted(state.values())


def test_a_change_of_one_row_writes_one_row(spark, tmp_path):
    root = str(tmp_path)
    dl.create(spark, root, spark.range(200_000).selectExpr("id", "concat('r', id % 7) repo", "id % 90 pr", "uuid() text"), ["id"])
    before = size(root)
    dl.apply(spark, root, "one", table(spark, [(17, "r3", 17, "new")]))
    assert size(root) - before < 20_000 < before / 100
    got = dl.read(spark, root)
    assert got.count() == 200_000 and got.where("id = 17").first()["text"] == "new"
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert not dl.needs_compaction(spark, root) and dl.needs_compaction(spark, root, share=0)


def test_replays_and_two_writers(spark, tmp_path):
    root = str(tmp_path)
    rows = table(spark, [(1, "a", 1, "x")])
    assert dl.create(spark, root, rows, ["id"]) == 0 == dl.create(spark, root, rows, ["id"])
    assert dl.apply(spark, root, "batch 1", table(spark, [(2, "a", 1, "y")])) == 1
    assert dl.apply(spark, root, "batch 1", table(spark, [(2, "a", 1, "other")])) == 1
    assert contents(dl.read(spark, root)) == [(1, "a", 1, "x"), (2, "a", 1, "y")]
    claims.claim(spark, root, 2, 1, "another")  # it has begun, but not committed
    with pytest.raises(claims.VersionTaken, match="another"):
        dl.apply(spark, root, "batch 2", rows)
    assert dl.head(spark, root)["version"] == 1
    with pytest.raises(ValueError, match="already"):
        dl.create(spark, root, rows, ["id"], "create again")


def test_bad_changes_are_refused_before_a_claim(spark, tmp_path):
    root = str(tmp_path)
    dl.create(spark, root, table(spark, []), ["id"])
    for bad in ([(1, "a", 1, "x"), (1, "a", 1, "y")], [(None, "a", 1, "x")]):
        with pytest.raises(ValueError, match="more than once"):
            dl.apply(spark, root, "bad", table(spark, bad))
    with pytest.raises(ValueError, match="no column nope"):
        dl.apply(spark, root, "bad", gone=[spark.range(1).withColumnRenamed("id", "nope")])
    assert claims.holder(spark, root, 1) is None
    assert dl.apply(spark, root, "empty", table(spark, []), [table(spark, []).select("repo")]) == 1
    assert contents(dl.read(spark, root)) == []
    with pytest.raises(ValueError, match="no table"):
        dl.apply(spark, root + "/none", "x", table(spark, []))
