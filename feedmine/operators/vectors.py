"""The vector table of active notes: upsert (K1), delete (K2), scoped replace (K3),
exact search (K4, K5), approximate search (K6) and embedding alignment (C4).

The index is a table (id, content, content_vector, reviewer, repo, pr_number,
github_comment_id, pr_url, file_path, category, severity, merged_at), written
partitioned by repo. Vectors are stored unit-normalised, so cosine similarity is
one dot product: of whole blocks for many queries (``blocked``), of one row at a time for a
single query (K4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedmine.functions.notes import note_content, note_id
from feedmine.functions.text import is_blank
from feedmine.operators import blocked as bl
from feedmine.operators.joins import BROADCAST_BYTES

INDEX_COLUMNS = ["id", "content", "content_vector", "reviewer", "repo", "pr_number",
                 "github_comment_id", "pr_url", "file_path", "category", "severity", "merged_at"]


def unit(vec: Column) -> Column:
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))
    # An array of one, so that the norm is worked out once and not for each element.
    return F.transform(F.array(norm), lambda n: F.transform(vec, lambda x: F.try_divide(x.cast("double"), n).cast("float")))[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def index_rows(notes: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Notes with their embedding → index rows (id H1, content H2, ``'' → null`` date)."""
    return notes.select(
        note_id().alias("id"),
        note_content().alias("content"),
        unit(F.col(vector_col)).alias("content_vector"),
        "reviewer", "repo", "pr_number", "github_comment_id", "pr_url", "file_path",
        "category", "severity",
        F.to_timestamp(F.nullif(F.col("merged_at"), F.lit(""))).alias("merged_at"),
        *([F.col("ordinal")] if "ordinal" in notes.columns else [F.lit(0).cast("long").alias("ordinal")]),
    )


def _bad_row(dimension: Column) -> Column:
    """Whether an index row can't be stored: no key, no vector, null elements (a zero vector has no
    direction, so its elements are null too), or another length than ``dimension``."""
    return (F.col("repo").isNull() | F.col("id").isNull() | F.col("content_vector").isNull()
            | (F.size("content_vector") != dimension) | F.exists("content_vector", lambda x: x.isNull()))


def save_vectors(index: DataFrame, notes: DataFrame, vector_col: str = "embedding",
                 strict: bool = True, dimension: int | None = None) -> DataFrame:
    """K1: upsert; the same id replaces, within one call the last (highest ordinal) wins.

    Returns the new index. An empty input leaves the index unchanged. A row without a
    vector, with a zero vector, null elements or another length than ``dimension`` (that
    of the stored vectors if not given) is rejected: in strict mode the job fails before
    anything is written, else the row is left out.
    """
    rows = index_rows(notes, vector_col)
    if dimension is None and (stored := index.select(F.size("content_vector").alias("n")).limit(1).collect()):
        dimension = stored[0]["n"]
    if strict or dimension is None:
        # One narrow pass says whether any row is bad, and the greatest length if none is known.
        size = F.size("content_vector")
        facts = rows.agg(F.max(size).alias("most"), F.min(size).alias("least"), F.count_if(_bad_row(size)).alias("bad")).first()
        dimension = facts["most"] or 0 if dimension is None else dimension
        if strict and (facts["bad"] or {facts["least"], facts["most"]} - {dimension, None}):
            _fail_if_any(rows.where(_bad_row(F.lit(dimension))), "vector rows rejected")
    rows = rows.where(~_bad_row(F.lit(dimension)))
    latest = (rows.groupBy("id")
              .agg(F.max_by(F.struct(*[c for c in INDEX_COLUMNS if c != "id"]), "ordinal").alias("r"))
              .select("id", "r.*"))
    kept = index.join(latest.select("id"), "id", "left_anti")
    return kept.select(*INDEX_COLUMNS).unionByName(latest.select(*INDEX_COLUMNS))


def delete_vectors(index: DataFrame, notes: DataFrame) -> DataFrame:
    """K2: delete by id; a missing id is fine."""
    ids = notes.select(note_id().alias("id")) if "id" not in notes.columns else notes.select("id")
    return index.join(ids.distinct(), "id", "left_anti")


def replace_vectors(index: DataFrame, notes: DataFrame, repos: list[str],
                    vector_col: str = "embedding") -> DataFrame:
    """K3: save, then delete everything in ``repos`` that is not among the new ids.

    Rows of other repos stay as they are. The result is a whole new index table; ``cells`` appends instead.
    """
    if not repos:
        raise ValueError("at least one repository is required for vector replacement")
    saved = save_vectors(index, notes, vector_col)
    new_ids = notes.select(note_id().alias("id")).distinct()
    in_scope = F.col("repo").isin(repos)
    stale = saved.where(in_scope).join(new_ids, "id", "left_anti").select("id")
    return saved.join(stale, "id", "left_anti")


def search(index: DataFrame, query_vector: list[float], repo: str, limit: int = 5,
           reviewers: list[str] | None = None, query_text: str = "x",
           fold_case: bool = False) -> DataFrame:
    """K4: the ``limit`` nearest notes of one repo by cosine; filters before ranking.

    Returns the 7 stored fields plus ``rank`` (no score). The reviewer filter is
    case-sensitive as in the reference unless ``fold_case``.
    """
    if not query_text.strip():
        raise ValueError("search query must not be empty")
    if limit < 1:
        raise ValueError("search limit must be at least 1")
    q = F.array(*[F.lit(float(x)).cast("float") for x in query_vector])
    cand = index.where(F.col("repo") == repo)
    if reviewers:
        if fold_case:
            cand = cand.where(F.lower("reviewer").isin([r.lower() for r in reviewers]))
        else:
            cand = cand.where(F.col("reviewer").isin(reviewers))
    scored = cand.withColumn("_score", dot(F.col("content_vector"), unit(q)))
    top = scored.orderBy(F.col("_score").desc(), F.col("id")).limit(limit)
    # All rows are of one repo; the window sees at most `limit` rows.
    w = Window.partitionBy("repo").orderBy(F.col("_score").desc(), F.col("id"))
    return top.withColumn("rank", F.row_number().over(w)).select(
        "id", "content", "repo", "pr_number", "pr_url", "file_path", "category", "severity", "rank")


def search_many(index: DataFrame, queries: DataFrame, k: int,
                broadcast_bytes: int = BROADCAST_BYTES, salt_buckets: int = 64,
                reviewers_col: str | None = None) -> DataFrame:
    """K5: K4 for a table of queries (query_id, repo, query_vector[, reviewers]).

    The index is read in place and its rows are scored in blocks, as matrix products with blocks of queries of the same
    repo (``blocked``). Queries that, measured, take no more than ``broadcast_bytes`` and find few rows are broadcast: no shuffle of the
    index, and a repo holding a third of all rows is spread over all of its file splits. More queries go to the parts of
    their repo, those of a hot repo over up to ``salt_buckets`` tasks a part, and only the best k of each
    part and query move. Returns (query_id, id, rank, plus the stored fields).
    """
    if k < 1:
        raise ValueError("search limit must be at least 1")
    q = queries.select("query_id", "repo", F.col("query_vector").alias("_qvec"),  # brought to length one with the blocks
                       *([F.col(reviewers_col).alias("reviewers")] if reviewers_col else []))
    fields = ["id", "repo", "pr_number", "github_comment_id", "reviewer", "content", "pr_url", "file_path", "category", "severity"]
    asked = ["query_id", *(["reviewers"] if reviewers_col else [])]
    sizes = index.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("content_vector")).alias("dim"))
    plan = bl.grid(sizes, q, ["repo"], k, broadcast_bytes, salt_buckets)
    if plan is None:
        blocks = bl.packed(index, ["repo"], fields, "content_vector", bl.BLOCK_ROWS)
        best = bl.ranked(bl.hits(bl.broadcast_blocks(blocks, q, ["repo"], asked, unit=True), k, fields), k)
    else:
        rows = bl.in_parts(index, plan, ["repo"], F.col("id"))
        blocks = bl.packed(rows, ["repo", "part"], fields, "content_vector", bl.BLOCK_ROWS)
        best = bl.ranked_parts(bl.best_in_parts(blocks, q, plan, ["repo"], asked, k, fields, unit=True), q, plan, k)
    return best.select("query_id", "id", "rank", *fields[1:])


def align_embeddings(inputs: DataFrame, response: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C4: one vector per input, in the order of the returned index.

    ``inputs`` (request_id, pos, text, ...), ``response`` (request_id, index, embedding). Only the
    order of the indices counts, not their values. Returns (aligned rows, rejects). A request is rejected whole when a text is
    blank or the number of vectors differs from the number of inputs.
    """
    n_in = inputs.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("_n_in"),
        F.sum(F.when(is_blank(F.col("text")), 1).otherwise(0)).alias("_blank"))
    n_out = response.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n_out"))
    checks = n_in.join(n_out, "request_id", "left").select(
        "request_id",
        F.when(F.col("_blank") > 0, F.lit("blank input text"))
         .when(F.coalesce("_n_out", F.lit(0)) != F.col("_n_in"),
               F.concat(F.lit("expected "), F.col("_n_in").cast("string"), F.lit(" vectors, got "),
                        F.coalesce("_n_out", F.lit(0)).cast("string")))
         .alias("reason"))
    ok = checks.where(F.col("reason").isNull()).select("request_id")
    # A request is one embedding call, so a bounded group.
    nth = lambda col: F.row_number().over(Window.partitionBy("request_id").orderBy(col))
    aligned = (inputs.join(ok, "request_id", "left_semi").withColumn("_nth", nth("pos"))
               .join(response.withColumn("_nth", nth("index")).drop("index"), ["request_id", "_nth"], "left").drop("_nth"))
    rejects = checks.where(F.col("reason").isNotNull())
    return aligned, rejects


def kmeans_cells(index: DataFrame, cells: int, seed: int = 7, max_iter: int = 20):
    """K6 training: k-means over the unit vectors with cosine distance."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    feats = index.select("id", array_to_vector("content_vector").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=max_iter, distanceMeasure="cosine",
                   featuresCol="features", predictionCol="cell").fit(feats)
    return model


def search_approx(index: DataFrame, queries: DataFrame, k: int, cells: int = 10,
                  probe: int = 4, seed: int = 7) -> DataFrame:
    """K6: probe the ``probe`` nearest k-means cells per query, re-rank exactly.

    Approximate, like the reference's HNSW index; recall is measured against K5.
    The centroids (``cells`` rows) are broadcast. A query goes to the parts of its repo with the list of its cells, and
    a task scores it against the blocks of those (``blocked``).
    """
    from pyspark.ml.functions import array_to_vector

    model = kmeans_cells(index, cells, seed)
    centers = [c.tolist() for c in model.clusterCenters()]
    # The centroids are a bounded literal (``cells`` rows): each query scores them
    # in place, no join needed.
    lit_centers = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers])
    assigned = model.transform(
        index.withColumn("features", array_to_vector("content_vector"))).drop("features")
    qv = queries.select("query_id", F.col("repo").alias("_qrepo"),
                        unit(F.col("query_vector")).alias("_qvec"))
    qc = qv.select("*", F.posexplode(lit_centers).alias("cell", "center")) \
        .withColumn("_cs", cosine(F.col("_qvec"), F.col("center")))
    wq = Window.partitionBy("query_id").orderBy(F.col("_cs").desc(), F.col("cell"))
    probes = qc.withColumn("_r", F.row_number().over(wq)).where(F.col("_r") <= probe)
    # A query row has its cells in a list; those that come n times (a query asked twice) count n times.
    copies = F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_copy")
    q = (probes.groupBy("query_id", F.col("_qrepo").alias("repo"), "_qvec", "cell").agg(F.count(F.lit(1)).alias("_n"))
         .groupBy("query_id", "repo", "_qvec", "_n").agg(F.collect_list("cell").alias("cells")).select("query_id", "repo", "_qvec", "cells", copies).drop("_copy"))
    sizes = index.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("content_vector")).alias("dim"))
    plan = bl.grid(sizes, qv.withColumnRenamed("_qrepo", "repo"), ["repo"], k, broadcast_bytes=0)
    fields = ["id", "repo", "github_comment_id"]
    rows = bl.in_parts(assigned, plan, ["repo"], F.col("id"))
    blocks = bl.packed(rows, ["repo", "part", "cell"], fields, "content_vector", bl.BLOCK_ROWS)
    found = bl.best_in_parts(blocks, q, plan, ["repo"], ["query_id", "cells"], k, fields)
    return bl.ranked(found, k).select("query_id", "id", "rank", "repo", "github_comment_id")


def _fail_if_any(rejects: DataFrame, message: str) -> None:
    first = rejects.limit(1).collect()
    if first:
        raise ValueError(f"{message}: {first[0].asDict()}")
