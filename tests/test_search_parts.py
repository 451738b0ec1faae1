"""Searches of many queries, dealt to parts: the same rows as all pairs, and queries that move once for each part."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedmine.operators import blocked, cells
from feedmine.operators import vectors as vx

FIELDS = ["id", "repo", "pr_number", "github_comment_id", "reviewer", "content", "pr_url", "file_path", "category", "severity"]


def index_of(spark, n=900, dim=8):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, dim))
    x[n // 2:n // 2 + 30] = x[:30]  # equal vectors, ties go by id
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [(f"n{k:05}", f"r{k % 3 % 2}", k, k, f"u{k % 4}", f"c{k}", "u", None, "style", "low", x[k].tolist()) for k in range(n)]
    return spark.createDataFrame(rows, "id string, repo string, pr_number long, github_comment_id long, reviewer string, content string, "
                                       "pr_url string, file_path string, category string, severity string, content_vector array<float>")


def asked(index, repeat=1):
    q = index.select(F.col("github_comment_id").alias("query_id"), "repo", F.col("content_vector").alias("query_vector"),
                     F.when(F.col("github_comment_id") % 2 == 0, F.array(F.lit("u1"), F.lit("u2"))).otherwise(F.array().cast("array<string>")).alias("who"))
    return q if repeat == 1 else q.unionByName(q.where("query_id % 5 = 0"))


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["id"]) for r in df.select("query_id", "rank", "id").collect())


@pytest.mark.parametrize("repeat", [1, 2])
@pytest.mark.parametrize("rows", [70, 1 << 16])
def test_parts_find_what_a_broadcast_finds(spark, monkeypatch, rows, repeat):
    index = index_of(spark)
    want = rows_of(vx.search_many(index, asked(index, repeat), k=7, reviewers_col="who"))
    monkeypatch.setattr(blocked, "PART_ROWS", rows)
    monkeypatch.setattr(blocked, "QUERY_PART_ROWS", 100)
    monkeypatch.setattr(blocked, "SCORES", 1000)
    assert rows_of(vx.search_many(index, asked(index, repeat), k=7, reviewers_col="who", broadcast_bytes=0)) == want
    assert len(want) == 900 * 7


def test_a_query_moves_once_for_each_part(spark, monkeypatch):
    """Sixty-four copies of each query were made before, however few rows its repo had."""
    index = index_of(spark)
    q = asked(index).select("query_id", "repo", vx.unit(F.col("query_vector")).alias("_qvec"))
    sizes = index.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.lit(8).alias("dim"))
    plan = blocked.grid(sizes, q, ["repo"], 7, broadcast_bytes=0)
    assert sorted(tuple(r) for r in plan.collect()) == [("r0", 1, 1), ("r1", 1, 1)]
    found = blocked.best_in_parts(blocked.packed(blocked.in_parts(index, plan, ["repo"], F.col("id")), ["repo", "part"], FIELDS, "content_vector", 64),
                                  q, plan, ["repo"], ["query_id"], 7, FIELDS)
    assert found.count() == 900 * 7  # not k for each of the blocks
    # A few queries that would find more than a bounded number of rows aren't broadcast either.
    assert blocked.grid(sizes, q, ["repo"], 7) is None
    monkeypatch.setattr(blocked, "BROADCAST_HITS", 900 * 7 - 1)
    assert blocked.grid(sizes, q, ["repo"], 7) is not None


@pytest.mark.parametrize("repeat", [1, 2])
def test_stored_cells_in_parts(spark, tmp_path, monkeypatch, repeat):
    monkeypatch.setattr(blocked, "BLOCK_ROWS", 40)
    index, root = index_of(spark), str(tmp_path)
    cells.build(index.where("github_comment_id % 3 <> 0"), root, cells=6)
    cells.upsert(index.where("github_comment_id % 3 = 0 OR github_comment_id % 7 = 0"), root, seq=1)
    q = asked(index, repeat)
    exact, near = (rows_of(f(spark, root, q, 7, reviewers_col="who", **more)) for f, more in ((cells.search_exact, {}), (cells.search_cells, {"probe": 4})))
    monkeypatch.setattr(blocked, "BROADCAST_HITS", 0)
    monkeypatch.setattr(blocked, "PART_ROWS", 200)
    monkeypatch.setattr(blocked, "QUERY_PART_ROWS", 150)
    assert rows_of(cells.search_exact(spark, root, q, 7, reviewers_col="who")) == exact
    assert rows_of(cells.search_cells(spark, root, q, 7, probe=4, reviewers_col="who")) == near
    if repeat == 1:
        assert exact == rows_of(vx.search_many(index, q, 7, reviewers_col="who"))


def test_approximate_search_makes_no_pairs(spark):
    index = index_of(spark)
    got = vx.search_approx(index, asked(index), k=7, cells=6, probe=6)
    assert rows_of(got) == rows_of(vx.search_many(index, asked(index), k=7))
    assert "posexplode" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "content_vector" not in plan[:plan.index("MapInArrow")]


def part_of(n=5000, dim=8):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    same = min(60, n // 2)
    x[n // 2:n // 2 + same] = x[:same]  # ties, more than k of one vector below
    x[n // 3:n // 3 + 20] = x[n // 3]
    stored = pa.StructArray.from_arrays([pa.array([f"n{(k * 7919) % n:05}" for k in range(n)]), pa.array([None if k % 11 == 0 else f"u{k % 4}" for k in range(n)])], ["id", "reviewer"])
    part = blocked._Part()
    for lo in range(0, n, 700):
        part.add({"rows": stored.slice(lo, 700), "x": x[lo:lo + 700], "cell": None, "dead": [3] if lo == 0 else None, "codes": None, "scales": None})
    return part, x, stored


@pytest.mark.parametrize("lists", [[["u1", "u2"]], [["u1", None], [], None, ["u1", "u2"], ["nobody"]]])
@pytest.mark.parametrize("n", [5, 60, 5000, 5003])
def test_the_best_of_a_part(monkeypatch, n, lists):
    """Each score of every pair was sorted; the k-th best is now sought among the best of sixteen rows each."""
    part, x, stored = part_of(n)
    q = np.concatenate([x[n // 3:n // 3 + 1], x[:40], np.random.default_rng(3).normal(size=(30, x.shape[1]))]).astype(np.float64)
    wanted = [lists[i % len(lists)] for i in range(len(q))]
    asked = pa.StructArray.from_arrays([pa.array(range(len(q))), pa.array(wanted, pa.list_(pa.string()))], ["query_id", "reviewers"])
    sorted_, partition = [], np.partition
    monkeypatch.setattr(blocked.np, "partition", lambda a, *more, **m: sorted_.append(a.size) or partition(a, *more, **m))
    monkeypatch.setattr(blocked, "SCORES", 1000)
    query, row, score = part.best(asked, q, 7, 0)
    ids, by = stored.field("id").to_pylist(), stored.field("reviewer").to_pylist()
    want = []
    for i, w in enumerate(wanted):
        found = [r for r in range(len(x)) if r != 3 and (not w or by[r] in w)]
        exact = {r: (x[r].astype(np.float64) * q[i]).sum() for r in found}
        want += [(i, r) for r in sorted(found, key=lambda r: (-exact[r], ids[r]))[:7]]
    assert list(zip(query.tolist(), row.tolist())) == want
    assert n < 5000 or sum(sorted_) < len(q) * n / 8


def test_units_are_as_spark_makes_them(spark):
    rng = np.random.default_rng(2)
    rows = [[float(v) for v in rng.normal(size=5) * 10.0 ** rng.integers(-25, 20)] for _ in range(200)] + [[0.0] * 5, [1e-30] * 5, [1.0, None, 2.0, 3.0, 4.0]]
    for kind, arrow in (("float", pa.float32()), ("double", pa.float64())):
        df = spark.createDataFrame([(r,) for r in rows], f"v array<{kind}>")
        want = [[np.nan if v is None else v for v in r[0]] for r in df.select(vx.unit(F.col("v"))).collect()]
        column = pa.array(rows, pa.list_(arrow))
        got = blocked.unit_rows(blocked.matrix(column), column.type).astype(np.float32)
        np.testing.assert_array_equal(got, np.array(want, np.float32))


def test_blocks_of_any_keys(spark):
    rows = [(None if n % 5 == 0 else f"r{n % 3}", n % 2, n, [float(n), 1.0]) for n in range(300)]
    df = spark.createDataFrame(rows, "repo string, part int, id long, v array<float>").coalesce(1)
    got = blocked.packed(df, ["repo", "part"], ["id"], "v", 40).collect()
    assert all(b["n"] == len(b["rows"]) <= 40 and len(b["vectors"]) == 8 * b["n"] for b in got)
    assert sorted((str(b["repo"]), b["part"], e["id"]) for b in got for e in b["rows"]) == sorted((str(r), p, n) for r, p, n, _ in rows)
    assert all(e["id"] == np.frombuffer(b["vectors"], "<f4")[2 * i] for b in got for i, e in enumerate(b["rows"]))
    assert len(got) <= 8 + 300 // 40
