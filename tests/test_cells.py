"""The stored inverted-cell index: recall, exact search with bounds, appended and removed rows, the rebuild rule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedmine.operators import blocked, cells
from feedmine.operators import vectors as vx
from feedmine.sources import testdata as fx

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def index(spark):
    return vx.save_vectors(spark.createDataFrame([], "id string, content string, content_vector array<float>, reviewer string, repo string, "
                                                 "pr_number long, github_comment_id long, pr_url string, file_path string, category string, "
                                                 "severity string, merged_at timestamp"), fx.vector_notes(spark, SF)).cache()


@pytest.fixture(scope="module")
def built(index, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("cells"))
    assert cells.build(index, root, cells=10) == 1
    return root


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["id"]) for r in df.select("query_id", "rank", "id").collect())


def recall(found, exact):
    want = {(q, i) for q, _, i in exact}
    return len(want & {(q, i) for q, _, i in found}) / len(want)


def test_recall_against_exact_search(spark, index, built):
    queries = fx.vector_queries(spark, SF)
    exact = rows_of(vx.search_many(index, queries, k=8))
    assert recall(rows_of(cells.search_cells(spark, built, queries, k=8, probe=8)), exact) >= 0.9
    # All cells: what is missed is what 8-bit codes rank too low, next to nothing.
    assert recall(rows_of(cells.search_cells(spark, built, queries, k=8, probe=10)), exact) >= 0.999


def test_exact_search_equals_all_pairs(spark, index, built):
    queries = fx.vector_queries(spark, SF)
    assert rows_of(cells.search_exact(spark, built, queries, k=8)) == rows_of(vx.search_many(index, queries, k=8))
    some = queries.limit(40).withColumn("who", F.when(F.col("query_id") % 2 == 0, F.array(F.lit("u1"))).otherwise(F.array().cast("array<string>")))
    want = rows_of(vx.search_many(index, some, k=30, reviewers_col="who"))
    assert rows_of(cells.search_exact(spark, built, some, k=30, reviewers_col="who")) == want
    found = cells.search_cells(spark, built, some, k=30, probe=10, reviewers_col="who").collect()
    assert all(r["reviewer"] == "u1" for r in found if r["query_id"] % 2 == 0)


def clustered(spark, n=4000, groups=40, dim=16, repos=2):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(groups, dim))
    x = centers[np.arange(n) % groups] + rng.normal(scale=0.05, size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(f"n{k:05}", f"r{k % 3 % repos}", "u", k, x[k].astype(np.float32).tolist()) for k in range(n)]
    return spark.createDataFrame(rows, "id string, repo string, reviewer string, github_comment_id long, content_vector array<float>")


def brute(index, queries, k, dead=()):
    rows = [r for r in index.collect() if r["id"] not in dead]
    ids = np.array([r["id"] for r in rows])
    x = np.array([r["content_vector"] for r in rows], np.float64)
    repo = np.array([r["repo"] for r in rows])
    out = []
    for q in queries.collect():
        v = np.array(q["query_vector"], np.float32).astype(np.float64)
        score = np.where(repo == q["repo"], x @ v / np.linalg.norm(v), -9)
        best = np.lexsort((ids, -score))[:k]
        out += [(q["query_id"], n + 1, ids[i]) for n, i in enumerate(best) if score[i] > -9]
    return sorted(out)


def test_bounds_skip_cells_where_vectors_have_neighbours(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocked, "BLOCK_ROWS", 64)
    index = clustered(spark)
    root = str(tmp_path)
    cells.build(index, root, cells=40)
    queries = index.where("github_comment_id % 20 = 0").select(F.col("github_comment_id").alias("query_id"), "repo", F.col("content_vector").alias("query_vector"))
    assert rows_of(cells.search_exact(spark, root, queries, k=5)) == brute(index, queries, 5)
    _, further = cells.exact_passes(spark, root, queries, 5, 2, None)
    # Two cells are looked at in the first pass; of the other 38 nearly all are skipped.
    assert further.count() < 0.1 * queries.count() * 38
    assert recall(rows_of(cells.search_cells(spark, root, queries, k=5, probe=2)), brute(index, queries, 5)) >= 0.95


def test_appended_and_removed_rows(spark, tmp_path):
    index = clustered(spark, n=900, groups=9)
    root = str(tmp_path)
    cells.build(index.where("github_comment_id < 800"), root, cells=9)
    stored = {p for p in tmp_path.rglob("blocks/**/part-*")}
    new = index.where("github_comment_id >= 800")
    moved = index.where("github_comment_id < 30").withColumn("content_vector", F.transform("content_vector", lambda v: -v))
    cells.upsert(new.unionByName(moved), root, seq=1)
    cells.remove(index.where("github_comment_id BETWEEN 100 AND 139").select("id"), root, seq=2)
    assert stored <= {p for p in tmp_path.rglob("blocks/**/part-*")}
    now = index.where("github_comment_id >= 30").unionByName(moved).where("github_comment_id NOT BETWEEN 100 AND 139")
    queries = index.where("github_comment_id % 20 = 0").select(F.col("github_comment_id").alias("query_id"), "repo", F.col("content_vector").alias("query_vector"))
    want = brute(now, queries, 6)
    assert rows_of(cells.search_exact(spark, root, queries, k=6)) == want
    assert recall(rows_of(cells.search_cells(spark, root, queries, k=6, probe=9)), want) >= 0.99
    # The same append again changes nothing; a removed id may come back.
    cells.upsert(new.unionByName(moved), root, seq=1)
    assert rows_of(cells.search_exact(spark, root, queries, k=6)) == want
    cells.upsert(index.where("github_comment_id = 100"), root, seq=3)
    back = now.unionByName(index.where("github_comment_id = 100"))
    assert rows_of(cells.search_exact(spark, root, queries, k=6)) == brute(back, queries, 6)
    assert sorted(r["id"] for r in cells.live_rows(spark, root).collect()) == sorted(r["id"] for r in back.collect())
    assert cells.needs_rebuild(spark, root) is None and cells.needs_rebuild(spark, root, most_appended=0.1) == "appended"
    assert cells.needs_rebuild(spark, root, most_skew=0.5) == "skewed"
    assert cells.build(cells.live_rows(spark, root), root, cells=9) == 2 and cells.needs_rebuild(spark, root, 0.0) is None
    assert rows_of(cells.search_exact(spark, root, queries, k=6)) == brute(back, queries, 6)


def test_equal_vectors_go_by_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocked, "BLOCK_ROWS", 7)
    rows = [(f"n{k:03}", "r", "u", k, [0.6, 0.8, 0.0] if k % 3 else [0.0, 0.6, 0.8]) for k in range(100)]
    index = spark.createDataFrame(rows, "id string, repo string, reviewer string, github_comment_id long, content_vector array<float>").repartition(5)
    cells.build(index, str(tmp_path), cells=3)
    queries = spark.createDataFrame([(1, "r", [0.6, 0.8, 0.0]), (2, "none", [1.0, 0.0, 0.0])], "query_id long, repo string, query_vector array<float>")
    want = [(1, n + 1, f"n{k:03}") for n, k in enumerate([k for k in range(100) if k % 3][:10])]
    assert rows_of(cells.search_exact(spark, str(tmp_path), queries, k=10)) == want
    assert rows_of(cells.search_cells(spark, str(tmp_path), queries, k=10, probe=3)) == want
    with pytest.raises(ValueError, match="limit"):
        cells.search_cells(spark, str(tmp_path), queries, k=0)


def test_no_index(spark, tmp_path):
    with pytest.raises(cells.NoIndex):
        cells.centers_of(spark, str(tmp_path / "none"))
