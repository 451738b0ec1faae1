"""The batch job and the mining step as wholes."""

import pytest
from pyspark.sql import functions as F

from small_data import SF_SMALL
from feedmine.plans import catalog as cat
from feedmine.plans import history as hi
from feedmine.sources import snapshot as snap


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """A history of the even PRs below 600, and the inputs."""
    root = str(tmp_path_factory.mktemp("history"))
    feedback, evidence, model = cat._history_inputs(spark, SF_SMALL)
    feedback, evidence = (x.where("pr_number < 600").checkpoint() for x in (feedback, evidence))
    hi.batch_job(spark, root, feedback.where("pr_number % 2 = 0"), evidence.where("pr_number % 2 = 0"), model,
                 [f"org/r{i}" for i in range(8)])
    return root, feedback, evidence, model


def rows(spark, root, version=None):
    out = {}
    for name in ("raw_comments", "notes", "vectors"):
        df = snap.read_snapshot(spark, root, name, version)
        out[name] = sorted((r["repo"], r["pr_number"], r["github_comment_id"], r["category"] if "category" in df.columns else "")
                           for r in df.collect())
    return out


def test_failed_jobs_leave_the_history_alone(spark, built):
    root, feedback, evidence, model = built
    before = rows(spark, root)

    def raises(*_):
        raise OSError("away")
    for broken in (hi.Model(model.annotate, raises, model.embed),
                   hi.Model(model.annotate, model.assess, lambda texts: [[1.0]] * (len(texts) - 1))):
        with pytest.raises(Exception):  # noqa: B017 - what is raised differs; what counts is that it is
            hi.mine_step(spark, root, evidence.where("pr_number in (1, 3)"), 2, feedback, evidence, broken)
    assert snap.latest_version(spark, root) == 1 and rows(spark, root) == before


@pytest.mark.parametrize("diff, reason", [("cast(null as string)", "empty final diff"), ("' \n '", "empty final diff"),
                                          ("repeat('x', 3000000)", "characters; maximum supported")])
def test_merged_pr_without_a_usable_diff_is_refused_before_any_call(spark, built, tmp_path, diff, reason):
    root, feedback, evidence, model = built
    before = rows(spark, root)
    good, lost = (r["pr_number"] for r in evidence.select("pr_number").distinct().orderBy("pr_number").limit(2).collect())
    bad = evidence.where(f"pr_number in ({good}, {lost})").selectExpr(
        *[c for c in evidence.columns if c != "final_diff"], f"if(pr_number = {lost}, {diff}, final_diff) AS final_diff")

    def raises(*_):
        raise OSError("called")
    never = hi.Model(raises, raises, raises)
    some = feedback.where(f"pr_number in ({good}, {lost})")
    with pytest.raises(ValueError, match=reason):
        hi.batch_job(spark, str(tmp_path), some, bad, never, [f"org/r{i}" for i in range(8)])
    assert snap.latest_version(spark, str(tmp_path)) is None
    # The mining step takes each PR by itself: without the good one, nothing is left to call the model for.
    only = hi.mine_step(spark, root, bad.where(f"pr_number = {lost}"), 2, feedback, bad, never).collect()
    assert [r["pr_number"] for r in only] == [lost] and reason in only[0]["reason"]
    assert rows(spark, root) == before
    with pytest.raises(Exception, match="called"):
        hi.mine_step(spark, root, bad, 2, feedback, bad, never)
    assert rows(spark, root) == before


def test_mining_adds_whole_prs_refuses_large_ones_and_can_be_replayed(spark, built):
    root, feedback, evidence, model = built
    before = rows(spark, root)
    odd = evidence.where("pr_number % 2 = 1 and repo = 'org/r1'")
    counts = {r["pr_number"]: r["count"] for r in feedback.join(odd, ["repo", "pr_number"], "left_semi").groupBy("pr_number").count().collect()}
    cap = max(counts.values()) - 1
    refused = hi.mine_step(spark, root, odd.unionByName(odd), 2, feedback, evidence, model, feedback_cap=cap)
    assert {r["pr_number"] for r in refused.collect()} == {k for k, n in counts.items() if n > cap}
    after = rows(spark, root)
    mined = {r["pr_number"] for r in odd.collect()} - {k for k, n in counts.items() if n > cap}
    for name in before:
        assert [r for r in after[name] if r[0] != "org/r1"] == [r for r in before[name] if r[0] != "org/r1"]
    assert {r[1] for r in after["raw_comments"]} - {r[1] for r in before["raw_comments"]} == mined & set(counts)
    assert [r[:3] for r in after["vectors"]] == [r[:3] for r in after["notes"]]
    hi.mine_step(spark, root, odd, 2, feedback, evidence, model, feedback_cap=cap)  # the same step again
    assert rows(spark, root) == after and rows(spark, root, 1) == before
    # Only the mined repo was written.
    parts = spark.read.schema("repo string, data_version int").parquet(f"{root}/_parts/notes/version=2")
    assert {r["repo"] for r in parts.where("data_version = 2").collect()} == {"org/r1"}


def test_resumed_job_does_not_call_the_model(spark, built, tmp_path):
    _, feedback, evidence, model = built
    root = str(tmp_path)
    few, ev = feedback.where("pr_number < 40"), evidence.where("pr_number < 40")
    repos = [f"org/r{i}" for i in range(8)]
    hi.batch_job(spark, root, few, ev, model, repos)

    def raises(*_):
        raise OSError("called")
    assert hi.batch_job(spark, root, few, ev, hi.Model(raises, raises, model.embed), repos, resume=True) == 2
    assert rows(spark, root, 1) == rows(spark, root, 2)
    report = "\n".join(r["value"] for r in spark.read.text(f"{root}/report/version=2").collect())
    skill = [r["value"] for r in spark.read.text(f"{root}/skill/version=2").collect()]
    assert "### PR #" in report and skill and all(x.startswith("- [") for x in skill)
    with pytest.raises(RuntimeError, match="no review feedback"):
        hi.batch_job(spark, str(tmp_path / "none"), few.where("false"), ev.where("false"), model, repos)
    only = str(tmp_path / "only")  # merged PRs without any feedback
    hi.batch_job(spark, only, few.where("false"), ev, model, repos)
    assert {r["comment_type"] for r in snap.read_snapshot(spark, only, "notes").collect()} == {"pull_request_architecture"}
    assert snap.read_snapshot(spark, only, "raw_comments").count() == 0


def test_ordinals_stay_unique_over_steps_on_different_repos(spark, built, tmp_path):
    """Steps on two repos in turn, one bad diff and one bad answer among good PRs."""
    _, feedback, evidence, model = built
    root = str(tmp_path)
    feedback, evidence = feedback.where("pr_number < 200"), evidence.where("pr_number < 200")
    hi.batch_job(spark, root, feedback.where("pr_number % 2 = 0"), evidence.where("pr_number % 2 = 0"), model, [f"org/r{i}" for i in range(8)])
    odd = [(r["repo"], r["pr_number"]) for r in evidence.where("pr_number % 2 = 1").orderBy("repo", "pr_number").collect()]
    repos = sorted({r for r, _ in odd})[:2]
    blank, unfit = odd[0], odd[1]
    broken = evidence.withColumn("final_diff", F.expr(f"if(pr_number = {blank[1]}, ' ', final_diff)"))
    assess = model.assess
    number = unfit[1]

    def sometimes(system, prompt):
        return "{}" if f"PR #{number}:" in prompt else assess(system, prompt)
    refused = {}
    for version, repo in enumerate(repos, 2):
        keys = evidence.where(f"pr_number % 2 = 1 and repo = '{repo}'")
        got = hi.mine_step(spark, root, keys, version, feedback, broken, hi.Model(model.annotate, sometimes, model.embed))
        refused |= {(r["repo"], r["pr_number"]): r["reason"] for r in got.collect()}
    assert set(refused) == {blank, unfit} and refused[blank] == "empty final diff"
    notes = snap.read_snapshot(spark, root, "notes")
    ordinals = [r["ordinal"] for r in notes.select("ordinal").collect()]
    assert len(set(ordinals)) == len(ordinals) and max(ordinals) < snap.committed_ordinal(spark, root, len(repos) + 1)
    # Curation drops some notes of the good PRs; the feedback of each is there, and nothing of the refused ones.
    kept = {(r["repo"], r["pr_number"]) for r in snap.read_snapshot(spark, root, "raw_comments").where("pr_number % 2 = 1").collect()}
    asked = {(r["repo"], r["pr_number"]) for r in feedback.select("repo", "pr_number").collect()}
    assert kept == {x for x in odd if x[0] in repos and x in asked} - set(refused)
    assert not {(r["repo"], r["pr_number"]) for r in notes.collect()} & set(refused)
