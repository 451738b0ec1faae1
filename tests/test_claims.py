"""Claims of versions (A8), calls of the summary that are tried again (J3), null fields in prompts."""

import pytest
from pyspark.sql import functions as F

from feedmine.operators import rollup as ru
from feedmine.sources import claims
from feedmine.sources import snapshot as snap


def test_of_two_writers_of_one_version_one_fails(spark, tmp_path):
    root = str(tmp_path / "history")
    rows = spark.createDataFrame([("a", 1)], "repo string, n long")
    assert snap.publish_snapshot(spark, root, {"notes": rows}, writer="nightly") == 1
    more = spark.createDataFrame([("a", 2)], "repo string, n long")
    assert snap.publish_snapshot(spark, root, {"notes": more}, version=2, writer="stream") == 2
    other = spark.createDataFrame([("a", 3)], "repo string, n long")
    with pytest.raises(claims.VersionTaken, match="stream"):
        snap.publish_snapshot(spark, root, {"notes": other}, version=2, writer="nightly")
    assert [r["n"] for r in snap.read_snapshot(spark, root, "notes").collect()] == [2]
    # A replay of the same writer writes the same version again.
    assert snap.publish_snapshot(spark, root, {"notes": more}, version=2, writer="stream") == 2
    assert [r["n"] for r in snap.read_snapshot(spark, root, "notes").collect()] == [2]


def test_a_claim_on_another_parent_fails(spark, tmp_path):
    root = str(tmp_path)
    assert claims.holder(spark, root, 5) is None
    claims.claim(spark, root, 5, 4, "w")
    claims.claim(spark, root, 5, 4, "w")
    assert claims.holder(spark, root, 5) == {"writer": "w", "parent": 4}
    with pytest.raises(claims.VersionTaken, match="version 5 is held by w on version 4"):
        claims.claim(spark, root, 5, 3, "w")
    # A writer that died before it wrote its name holds the version all the same.
    (tmp_path / claims.CLAIMS / "version=6").touch()
    with pytest.raises(claims.VersionTaken):
        claims.claim(spark, root, 6, 5, "w")


NOTES = "category string, severity string, original_issue string, requested_change string, rationale string, implementation_example string, ordinal long"


def test_summary_calls_are_tried_again_alone(spark, tmp_path):
    notes = spark.createDataFrame([("c", "s", f"issue {k}", "change", None, None, k) for k in range(6)], NOTES)
    log = str(tmp_path)

    def flaky(system, prompt):
        """Fails the first time for the chunk of note 4; every call leaves a file."""
        import hashlib
        import os
        name = hashlib.sha256(prompt.encode()).hexdigest()[:8]
        times = len([f for f in os.listdir(log) if f.startswith(name)])
        open(f"{log}/{name}-{times}", "w").close()
        if "issue 4" in prompt and times == 0:
            raise OSError("away")
        return "text " + name
    text, calls = ru.synthesize(notes, flaky, "system", ["u"], chunk=2)
    assert text.count() == 1 and calls == 4
    assert len(list(tmp_path.iterdir())) == 5  # three chunks, one of them twice, and the merge

    def never(system, prompt):
        raise OSError("away")
    with pytest.raises(RuntimeError, match="after 3 attempts.*away"):
        ru.synthesize(notes, never, "system", ["u"], chunk=2)


def test_null_fields_stay_in_the_prompt(spark):
    notes = spark.createDataFrame([("c", None, "i", "r", None, None, 0)], NOTES)
    prompt = ru.synthesis_prompts(notes, ["u"]).select(F.col("prompt")).first()[0]
    assert prompt.endswith('[{"category":"c","severity":null,"original_issue":"i","requested_change":"r","rationale":null,"implementation_example":""}]')


def test_readers_open_the_listed_files_only(spark, tmp_path):
    root = str(tmp_path / "a+b c")  # paths are decoded as they were encoded
    first = spark.createDataFrame([("org/r1", 1), ("org/r2", 2), (None, 3)], "repo string, n long")
    snap.publish_snapshot(spark, root, {"notes": first})
    for n in range(2, 6):  # one repo changes in each version
        step = spark.createDataFrame([("org/r1", 10 * n)], "repo string, n long")
        snap.publish_snapshot(spark, root, {"notes": step}, touched={"notes": step.select("repo")})
    (tmp_path / "a+b c" / "notes" / "version=3" / "repo=org%2Fr1" / "part-left-over.parquet").write_text("not parquet")
    now = snap.read_snapshot(spark, root, "notes")
    assert sorted((r["repo"] or "", r["n"]) for r in now.collect()) == [("", 3), ("org/r1", 50), ("org/r2", 2)]
    assert sorted({f.split("/version=")[1][0] for f in now.inputFiles()}) == ["1", "5"]
    one = spark.createDataFrame([("org/r2",), ("org/r9",)], "repo string")
    assert [(r["repo"], r["n"]) for r in snap.read_snapshot(spark, root, "notes", repos=one).collect()] == [("org/r2", 2)]
    assert snap.read_snapshot(spark, root, "notes", repos=one.where("repo = 'org/r9'")).collect() == []
    assert [r["n"] for r in snap.read_snapshot(spark, root, "notes", 3).where("repo = 'org/r1'").collect()] == [30]
    assert snap.table_rows(spark, root, "notes", 5) == 3


def test_old_files_of_repos_with_a_slash_go(spark, tmp_path):
    root = str(tmp_path)
    for n in (1, 2):
        snap.publish_snapshot(spark, root, {"notes": spark.createDataFrame([("org/r1", n)], "repo string, n long")})
    assert snap.drop_old_files(spark, root, "notes") == 1
    assert not list((tmp_path / "notes" / "version=1").rglob("part-*.parquet"))
    assert [r["n"] for r in snap.read_snapshot(spark, root, "notes").collect()] == [2]


def test_commits_are_folded_into_one_file(spark, tmp_path):
    root = str(tmp_path)
    for n in (1, 2, 2, 3):  # a replay commits twice
        snap.publish_snapshot(spark, root, {"notes": spark.createDataFrame([("a", n)], "repo string, n long")}, version=n, next_ordinal=10 * n)
    files = lambda: list((tmp_path / snap.COMMITS).glob("part-*.parquet"))
    assert len(files()) == 4 and snap.fold_commits(spark, root) == 4 and len(files()) == 1
    assert snap.fold_commits(spark, root) == 0
    assert snap.latest_version(spark, root) == 3 and snap.committed_ordinal(spark, root, 2) == 20
    assert [r["n"] for r in snap.read_snapshot(spark, root, "notes", 2).collect()] == [2]
    assert snap.publish_snapshot(spark, root, {"notes": spark.createDataFrame([("a", 4)], "repo string, n long")}) == 4


def test_counters_are_taken_in_the_pass_that_writes(spark, tmp_path):
    root = str(tmp_path)
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            runs.add(len(batch))
            yield batch
    rows = spark.range(0, 1000, 1, 4).mapInPandas(seen, "id long").selectExpr("concat('r', id % 3) AS repo", "id AS n")
    empty = spark.createDataFrame([], "repo string, n long")
    tables = {"notes": rows, "plain": rows.select("n"), "none": empty, "none_plain": empty.select("n")}
    snap.publish_snapshot(spark, root, tables, counters={"notes": {"odd": F.count_if(F.col("n") % 2 == 1)}, "none": {"most": F.max("n")}})
    assert runs.value == 2000  # each input once
    got = {r["name"]: r["value"] for r in snap.read_counters(spark, root).collect()}
    assert got == {"notes.rows": 1000, "notes.odd": 500, "plain.rows": 1000, "none.rows": 0, "none.most": None, "none_plain.rows": 0}
    step = spark.createDataFrame([("r1", 1)], "repo string, n long")
    snap.publish_snapshot(spark, root, {"notes": step}, touched={"notes": step.select("repo")})
    assert {r["name"]: r["value"] for r in snap.read_counters(spark, root).collect()} == {"notes.rows": 1}
    assert snap.table_rows(spark, root, "notes", 2) == 1000 - 333 + 1
