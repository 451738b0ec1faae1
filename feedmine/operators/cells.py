"""K6 as a stored inverted-cell index, and exact search over it that skips cells by bounds.

Layout, under one folder::

    cells/version=M        cell, center            a trained cell model, one row per cell
    blocks/model=M/seq=N   repo, cell, salt, ...   rows of up to ``BLOCK_ROWS`` vectors of one repo and cell
    gone/model=M/seq=N     id                      ids deleted or written anew at N

A block row holds a matrix: the vectors as float32 bytes, their differences from the cell's center as 8-bit codes with
one scale each, the stored fields as an array, and the least cosine of its vectors with their cell's center.

* ``build`` trains k-means on a bounded sample, assigns every row and writes the blocks.
* ``upsert`` and ``remove`` append: new rows go to the cells of the stored model, and ids that may have been there
  before are named in ``gone``. Nothing that is stored is read or rewritten.
* ``needs_rebuild`` says when what was appended or removed outweighs the rest, or a cell has grown out of
  proportion; ``build`` of ``live_rows`` then starts a new model.
* ``search_cells`` (approximate, K6) looks at the ``probe`` cells nearest to each query, finds candidates by 8-bit codes
  and ranks them by the exact product. No model is fitted per call.
* ``search_exact`` (K5) looks at the nearest cells first and takes the k-th best score as a floor, and then at those
  cells alone whose bound reaches it. Its rows equal ``vectors.search_many``.

A hot repo is split: a cell's rows are dealt by salts, as many as its rows ask for. Only the cell model reaches the driver,
and its size is checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedmine.operators import blocked as bl
from feedmine.operators.vectors import unit
from feedmine.session import materialize, path_exists

#: Rows that train the cell model; everything is assigned.
SAMPLE_ROWS = 50_000
#: A cell of one repo has one more salt for each so many rows.
SALT_ROWS = 64 * bl.BLOCK_ROWS
#: Candidates by 8-bit codes that are ranked exactly, for each of the k wanted.
OVERSAMPLE = 4
MAX_CENTERS_BYTES = 64 << 20
FIELDS = ["id", "repo", "reviewer", "github_comment_id"]


class NoIndex(RuntimeError):
    """The folder holds no built index."""


def _versions(spark: SparkSession, folder: str) -> list[int]:
    if not path_exists(spark, folder):
        return []
    return sorted(r["version"] for r in spark.read.parquet(folder).select("version").distinct().collect())  # models ever trained


def centers_of(spark: SparkSession, root: str) -> tuple[int, np.ndarray]:
    """The number of the newest model and its centers, unit rows. A model is small; its size is checked."""
    versions = _versions(spark, f"{root}/cells")
    if not versions:
        raise NoIndex(f"{root} holds no index; build it first")
    rows = spark.read.parquet(f"{root}/cells").where(F.col("version") == versions[-1])
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("center") * 8), F.lit(0))).first()
    if size > MAX_CENTERS_BYTES:
        raise ValueError(f"a model of {n} cells takes {size} bytes; train one of at most {MAX_CENTERS_BYTES}")
    return versions[-1], np.array([r["center"] for r in rows.orderBy("cell").collect()], np.float64)


def train(index: DataFrame, cells: int, seed: int = 7, sample_rows: int = SAMPLE_ROWS, max_iter: int = 20) -> np.ndarray:
    """Centers of at most ``cells`` cells by k-means with the cosine distance, on about ``sample_rows`` rows at most."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = index.count()
    if not rows:
        return np.zeros((0, 0))
    sample = index if rows <= sample_rows else index.sample(sample_rows / rows, seed=seed)
    features = sample.select(array_to_vector("content_vector").alias("features"))
    model = KMeans(k=max(2, cells), seed=seed, maxIter=max_iter, distanceMeasure="cosine", featuresCol="features").fit(features)
    centers = np.array(model.clusterCenters(), np.float64)
    return centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-30)


def assigned(index: DataFrame, centers: np.ndarray) -> DataFrame:
    """The fields, the vector and its nearest center as ``cell``."""
    rows = index.select(*FIELDS, "content_vector")
    names = [*rows.columns, "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nearest = (bl.matrix(batch.column(len(FIELDS))) @ centers.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest)], names=names)
    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("cell", T.IntegerType())]))


def blocks(index: DataFrame, centers: np.ndarray) -> DataFrame:
    """The block rows of an index table."""
    rows = materialize(assigned(index, centers))
    counts = rows.groupBy("repo", "cell").count()
    salts = counts.select("repo", "cell", F.ceil(F.col("count") / SALT_ROWS).cast("int").alias("salts"))
    dealt = rows.join(salts, ["repo", "cell"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    dealt = dealt.repartition("repo", "cell", "salt").sortWithinPartitions("repo", "cell", "salt", "id")
    plain = bl.packed(dealt, ["repo", "cell", "salt"], FIELDS, "content_vector", bl.BLOCK_ROWS)
    schema = T.StructType([*plain.schema, T.StructField("codes", T.BinaryType()), T.StructField("scales", T.BinaryType()),
                           T.StructField("least_cos", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                cell, n = batch.column(1)[b].as_py(), batch.column(3)[b].as_py()
                x = np.frombuffer(batch.column(4)[b].as_buffer(), "<f4").reshape(n, -1).astype(np.float64)
                # What a query's product with the center adds is the same for the whole block, so codes hold the rest alone.
                rest = x - centers[cell]
                scale = np.maximum(np.abs(rest).max(axis=1, initial=0), 1e-30) / 127
                codes = np.rint(rest / scale[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(b, 1) for c in batch.columns), pa.array([codes.tobytes()], pa.binary()), pa.array([scale.astype("<f4").tobytes()], pa.binary()),
                     pa.array([float((x @ centers[cell]).min())])], names=schema.names)
    return plain.mapInArrow(run, schema)


# ---- writing -------------------------------------------------------------------------------------
def build(index: DataFrame, root: str, cells: int, seed: int = 7, sample_rows: int = SAMPLE_ROWS) -> int:
    """Train a model on a bounded sample of ``index``, write the blocks of all rows, then the model; its number."""
    spark = index.sparkSession
    centers = train(index, cells, seed, sample_rows)
    model = (_versions(spark, f"{root}/cells") or [0])[-1] + 1
    blocks(index, centers).write.mode("overwrite").parquet(f"{root}/blocks/model={model}/seq=0")
    # Readers look for the model, so it comes last.
    rows = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centers)], "cell int, center array<double>")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/cells/version={model}")
    return model


def upsert(rows: DataFrame, root: str, seq: int) -> None:
    """Append index rows as ``seq`` (1, 2, ...; the same one again replaces it). Rows of the same ids stored before count
    no more. Ids among ``rows`` must differ (K1 sees to it)."""
    model, centers = centers_of(rows.sparkSession, root)
    remove(rows, root, seq)
    if len(centers):
        blocks(rows, centers).write.mode("overwrite").parquet(f"{root}/blocks/model={model}/seq={seq}")


def remove(ids: DataFrame, root: str, seq: int) -> None:
    """Name ids (column ``id``) as gone from ``seq`` on; ids that aren't stored don't matter."""
    model, _ = centers_of(ids.sparkSession, root)
    ids.select("id").distinct().write.mode("overwrite").parquet(f"{root}/gone/model={model}/seq={seq}")


def stale_ids(spark: SparkSession, root: str, model: int) -> DataFrame:
    """``id, gone_at``: rows of this id written before ``gone_at`` don't count."""
    folder = f"{root}/gone/model={model}"
    if not path_exists(spark, folder):
        return spark.createDataFrame([], "id string, gone_at int")
    return spark.read.schema("id string, seq int").parquet(folder).groupBy("id").agg(F.max("seq").alias("gone_at"))


def stored_blocks(spark: SparkSession, root: str, model: int) -> DataFrame:
    """All blocks of a model, with ``dead``, the places of their rows that don't count. Stale ids alone are joined
    with the ids; a block's matrix isn't touched if it holds none."""
    stored = spark.read.parquet(f"{root}/blocks/model={model}")
    name = F.struct("seq", "repo", "cell", "salt", F.col("rows")[0]["id"].alias("first"))
    each = stored.select(name.alias("block"), "seq", F.posexplode("rows.id").alias("at", "id"))
    dead = (each.join(stale_ids(spark, root, model), "id").where("seq < gone_at")
            .groupBy("block").agg(F.collect_list("at").alias("dead")))  # at most BLOCK_ROWS numbers
    return stored.withColumn("block", name).join(dead, "block", "left").drop("block")


def live_rows(spark: SparkSession, root: str) -> DataFrame:
    """The fields and ``content_vector`` of every row that counts; the input of a rebuild."""
    model, _ = centers_of(spark, root)
    stored = stored_blocks(spark, root, model)
    entry = stored.schema["rows"].dataType.elementType
    schema = T.StructType([*entry, T.StructField("content_vector", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                rows = batch.column(0)[b].values
                x = np.frombuffer(batch.column(1)[b].as_buffer(), "<f4").reshape(len(rows), -1)
                at = np.setdiff1d(np.arange(len(rows)), np.array(batch.column(2)[b].as_py() or [], np.int64))
                if len(at):
                    flat = pa.array(x[at].reshape(-1))
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * x.shape[1], pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([*(rows.field(f).take(pa.array(at)) for f in FIELDS), vectors], names=schema.names)
    return stored.select("rows", "vectors", "dead").mapInArrow(run, schema)


def needs_rebuild(spark: SparkSession, root: str, most_appended: float = 0.5, most_skew: float = 20.0) -> str | None:
    """Why the index should be built anew, or None: rows appended or named as gone outweigh ``most_appended`` of those of
    the build, or the largest cell holds over ``most_skew`` times the mean."""
    model, centers = centers_of(spark, root)
    counts = spark.read.parquet(f"{root}/blocks/model={model}").groupBy("cell").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("seq") == 0, F.col("n")).otherwise(0)).alias("built"))
    total, built, largest = (x or 0 for x in counts.agg(F.sum("n"), F.sum("built"), F.max("n")).first())
    if total - built + stale_ids(spark, root, model).count() > most_appended * max(built, 1):
        return "appended"
    return "skewed" if total and largest > most_skew * total / max(len(centers), 1) else None


# ---- searching -----------------------------------------------------------------------------------
def _asked(queries: DataFrame, reviewers_col: str | None) -> tuple[DataFrame, list[str]]:
    fields = ["query_id", *(["reviewers"] if reviewers_col else [])]
    return queries.select("query_id", "repo", unit(F.col("query_vector")).alias("_qvec"),
                          *([F.col(reviewers_col).alias("reviewers")] if reviewers_col else [])), fields


def _cosines(queries: DataFrame, centers: np.ndarray) -> DataFrame:
    """``query_id, repo, cell, cosine, place`` of every query and cell; place 0 is the nearest."""
    rows = queries.select("query_id", "repo", "_qvec")
    schema = T.StructType([*rows.schema[:2], *T._parse_datatype_string("cell int, cosine double, place int")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                cosine = bl.matrix(part.column(2)) @ centers.T
                order = np.argsort(-cosine, axis=1, kind="stable")
                row = pa.array(np.repeat(np.arange(part.num_rows), len(centers)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(row), part.column(1).take(row), pa.array(order.reshape(-1).astype(np.int32)),
                     pa.array(np.take_along_axis(cosine, order, axis=1).reshape(-1)), pa.array(np.tile(np.arange(len(centers), dtype=np.int32), part.num_rows))],
                    names=schema.names)
    return rows.mapInArrow(run, schema)


def _plan(stored: DataFrame, asked: DataFrame, dim: int, k: int, tried: int) -> DataFrame | None:
    sizes = stored.groupBy("repo").agg(F.sum("n").alias("n"), F.lit(dim).alias("dim"))
    return bl.grid(sizes, asked, ["repo"], k, tried=tried)


def _with_cells(asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """The queries with the ``cells`` that ``pairs`` (query_id, cell) names; pairs that come n times count n times."""
    times = pairs.groupBy("query_id", "cell").count()
    lists = times.groupBy("query_id", "count").agg(F.collect_list("cell").alias("cells"))
    lists = lists.select("query_id", "cells", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("_time"))
    return asked.join(lists.drop("_time"), "query_id")


def _found(stored: DataFrame, asked: DataFrame, fields: list[str], pairs: DataFrame, plan: DataFrame | None, k: int, oversample: int = 0) -> DataFrame:
    """What the queries find in the cells named by ``pairs``. Many queries are dealt by repo, so that a query moves once
    with the list of its cells."""
    if plan is None:
        return bl.hits(bl.broadcast_blocks(stored, asked.join(pairs, "query_id"), ["repo", "cell"], fields), k, FIELDS, oversample)
    blocks = bl.in_parts(stored, plan, ["repo"], F.col("rows")[0]["id"])
    return bl.best_in_parts(blocks, _with_cells(asked, pairs), plan, ["repo"], [*fields, "cells"], k, FIELDS, oversample)


def search_cells(spark: SparkSession, root: str, queries: DataFrame, k: int, probe: int = 4, reviewers_col: str | None = None) -> DataFrame:
    """K6: ``query_id, id, rank, repo, github_comment_id, reviewer`` of about the ``k`` nearest live rows of each query's repo.

    ``queries``: query_id, repo, query_vector and, if named, an array of reviewers to look at (empty: all).
    """
    if k < 1:
        raise ValueError("search limit must be at least 1")
    model, centers = centers_of(spark, root)
    asked, fields = _asked(queries, reviewers_col)
    probes = _cosines(asked, centers).where(F.col("place") < probe).select("query_id", "cell")
    stored = stored_blocks(spark, root, model)
    plan = _plan(spark.read.parquet(f"{root}/blocks/model={model}"), asked, centers.shape[1], k, probe)
    found = _found(stored, asked, fields, probes, plan, k, OVERSAMPLE)
    best = bl.ranked(found, k) if plan is None else bl.ranked_parts(found, asked, plan, k)
    return best.select("query_id", "id", "rank", *FIELDS[1:])


def search_exact(spark: SparkSession, root: str, queries: DataFrame, k: int, first: int = 2, reviewers_col: str | None = None) -> DataFrame:
    """K5 over the stored index: the columns of ``search_cells``, the exact rows."""
    if k < 1:
        raise ValueError("search limit must be at least 1")
    found, _ = exact_passes(spark, root, queries, k, first, reviewers_col)
    return bl.ranked(found, k).select("query_id", "id", "rank", *FIELDS[1:])


def exact_passes(spark: SparkSession, root: str, queries: DataFrame, k: int, first: int, reviewers_col: str | None) -> tuple[DataFrame, DataFrame]:
    """What both passes of the exact search found, and the (query_id, repo, cell) of the second.

    The angle between a query and any vector of a cell is at least that between the query and the center, less the
    cell's widest angle from its center. So no product exceeds the cosine of that difference.
    """
    model, centers = centers_of(spark, root)
    stored = stored_blocks(spark, root, model)
    asked, fields = _asked(queries, reviewers_col)
    cosines = materialize(_cosines(asked, centers))
    plan = _plan(spark.read.parquet(f"{root}/blocks/model={model}"), asked, centers.shape[1], k, len(centers))

    def scored(pairs: DataFrame) -> DataFrame:
        return _found(stored, asked, fields, pairs.select("query_id", "cell"), plan, k)

    sure = materialize(scored(cosines.where(F.col("place") < first)))
    floors = bl.ranked(sure, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    widest = spark.read.parquet(f"{root}/blocks/model={model}").groupBy("repo", "cell").agg(F.min("least_cos").alias("least_cos"))
    angle = F.greatest(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("cosine"))))
                       - F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("least_cos")))), F.lit(0.0))
    further = (cosines.where(F.col("place") >= first).join(widest, ["repo", "cell"]).join(floors, "query_id", "left")
               .where(F.col("floor").isNull() | (F.cos(angle) >= F.col("floor") - 1e-6)).select("query_id", "repo", "cell"))
    return sure.unionByName(scored(further)), further
