"""Versioned snapshots (A8), stage resume (A9) and the state tables.

A run writes its rows under ``<root>/<table>/version=N``, tables with a ``repo`` partitioned by
it, and then appends N with the tables' schemas to ``<root>/_commits``, so a run that fails
midway stays invisible and the previous snapshot stays readable. For each version of a
partitioned table, ``<root>/_parts/<table>/version=N`` names each repo's files, the version that wrote
them and their rows. A run that changes few repos writes only those: the others keep the files of
earlier versions. Readers open the files of that list and no others, so a table's folders are never listed and
old versions cost nothing; ``fold_commits`` keeps the commits one file. A replayed micro-batch writes the same N again.

The rows of each table are counted while they are written (D5) and the counters committed with the version.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedmine.schemas import FEEDBACK, NOTE, PENDING
from feedmine.session import path_exists
from feedmine.sources.claims import claim

COMMITS = "_commits"
COMMIT = "version int, tables map<string,string>, next_ordinal long, counters map<string,long>"
PARTS = "repo string, data_version int, files array<string>, rows long"
STATE_TABLES = ("raw_comments", "notes", "pending_prs")


def _commits(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(COMMIT).parquet(f"{root}/{COMMITS}")


def latest_version(spark: SparkSession, root: str) -> int | None:
    """The newest committed version; None only if nothing was ever committed. Any other failure to
    read the commits is raised, so that no version is given out twice."""
    if not path_exists(spark, f"{root}/{COMMITS}"):
        return None
    row = _commits(spark, root).agg(F.max("version").alias("v")).first()
    return None if row is None or row["v"] is None else int(row["v"])


def committed_ordinal(spark: SparkSession, root: str, version: int) -> int | None:
    """The first free ordinal as of a committed version; None if its commit doesn't say."""
    row = _commits(spark, root).where(F.col("version") == version).agg(F.max("next_ordinal")).first()
    return row[0]


def _schema(spark: SparkSession, root: str, version: int, name: str) -> T.StructType:
    row = _commits(spark, root).where(F.col("version") == version).select(
        F.col("tables")[name].alias("schema")).first()
    if row is None or row["schema"] is None:
        raise RuntimeError(f"version {version} of {name} is not committed")
    return T.StructType.fromJson(json.loads(row["schema"]))


def _parts(spark: SparkSession, root: str, name: str, version: int) -> DataFrame:
    """(repo, data_version, files, rows): the files of each repo in this version, under the folder of the version that wrote them."""
    return spark.read.schema(PARTS).parquet(f"{root}/_parts/{name}/version={version}")


def _below(folder: str) -> Column:
    """A scanned row's file as a path below ``folder``, whose last step has to be the only one of that name."""
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))  # a plus sign is itself in a path
    return F.substring_index(path, f"/{folder}/", -1)


def _written_parts(spark: SparkSession, root: str, name: str, version: int, schema: T.StructType) -> DataFrame:
    """The list of the files that this version has just written; no column is read for it."""
    rows = spark.read.schema(schema).parquet(f"{root}/{name}/version={version}")
    files = rows.select("repo", _below(f"{name}/version={version}").alias("file")).groupBy("repo", "file").agg(F.count(F.lit(1)).alias("n"))
    return files.groupBy("repo").agg(F.array_sort(F.collect_list("file")).alias("files"), F.sum("n").alias("rows")) \
        .select("repo", F.lit(version).alias("data_version"), "files", "rows")


def _observed(df: DataFrame, more: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows, and whatever else is asked, on the way to its sink. Nothing is shuffled after this, so a
    task that runs twice counts once."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.cast("long").alias(n) for n, c in more.items())), seen


def publish_snapshot(spark: SparkSession, root: str, tables: dict[str, DataFrame],
                     version: int | None = None, fail_after: str | None = None,
                     touched: dict[str, DataFrame] | None = None, next_ordinal: int | None = None,
                     writer: str | None = None, counters: dict[str, dict[str, Column]] | None = None) -> int:
    """Write all tables for a new version, then commit it. A version older than the newest is refused.

    ``touched`` names tables of which only some repos changed: its frame lists these repos, the
    table's frame has all their rows, and no other repo's files are written. ``next_ordinal`` is the
    first ordinal that no note of any version has. A named ``writer`` claims the version before it writes anything
    (``claims``): of two that take the same one, the second fails; a replay of the same writer goes on. ``counters`` names aggregates to be taken of a table's rows beside their number, in the pass
    that writes them (``read_counters``). ``fail_after`` (a table name) simulates a crash after that table is written, for tests.
    """
    newest = latest_version(spark, root) or 0
    v = version if version is not None else newest + 1
    if v < newest:  # the newest itself may be written again: a replayed micro-batch
        raise ValueError(f"version {v} is older than the committed version {newest}")
    # The newest version before this one, also when this one is being written again.
    before = max((r["version"] for r in _commits(spark, root).select("version").distinct().collect()
                  if r["version"] < v), default=0) if newest else 0
    if writer is not None:
        claim(spark, root, v, before, writer)
    counted = {}
    for name, df in tables.items():
        folder = f"{root}/{name}/version={v}"
        rows, seen = _observed(df, (counters or {}).get(name, {}))
        if "repo" not in df.columns:
            rows.write.mode("overwrite").parquet(folder)
        else:
            rows.write.mode("overwrite").partitionBy("repo").parquet(folder)
            schema = T.StructType([*(f for f in df.schema if f.name != "repo"), T.StructField("repo", T.StringType())])
            parts = _written_parts(spark, root, name, v, schema)
            changed = (touched or {}).get(name)
            if changed is not None and before and path_exists(spark, f"{root}/_parts/{name}/version={before}"):
                same = _parts(spark, root, name, before).alias("p").join(
                    changed.select(F.col("repo").alias("_r")).distinct(), F.col("repo").eqNullSafe(F.col("_r")), "left_anti")
                parts = parts.unionByName(same)
            parts.coalesce(1).write.mode("overwrite").parquet(f"{root}/_parts/{name}/version={v}")
        counted.update({f"{name}.{key}": value for key, value in seen.get.items()})
        if fail_after == name:
            raise RuntimeError(f"simulated failure after writing {name}")
    if next_ordinal is None and newest:
        next_ordinal = committed_ordinal(spark, root, newest)
    commit = spark.createDataFrame([(v, {n: df.schema.json() for n, df in tables.items()}, next_ordinal, counted)], COMMIT)
    commit.coalesce(1).write.mode("append").parquet(f"{root}/{COMMITS}")
    return v


def read_snapshot(spark: SparkSession, root: str, name: str, version: int | None = None,
                  repos: DataFrame | None = None) -> DataFrame:
    """A table of a committed version, the newest by default; of the listed ``repos`` only, if given."""
    v = version if version is not None else latest_version(spark, root)
    if v is None:
        raise RuntimeError("history is not initialised; run the batch job first")
    schema = _schema(spark, root, v, name)
    if "repo" not in schema.names:
        return spark.read.schema(schema).parquet(f"{root}/{name}/version={v}")
    parts = _parts(spark, root, name, v)
    if repos is not None:
        parts = parts.join(repos.select(F.col("repo").alias("_r")).distinct(), F.col("repo").eqNullSafe(F.col("_r")), "left_semi")
    # As many short paths as the version has files of these repos: what Spark's own file index holds on the driver.
    paths = [f"{root}/{name}/version={r['data_version']}/{file}" for r in parts.select("data_version", "files").toLocalIterator()
             for file in r["files"]]
    if not paths:
        return spark.createDataFrame([], schema)
    return (spark.read.schema(T.StructType([*schema, T.StructField("version", T.IntegerType())]))
            .option("basePath", f"{root}/{name}").parquet(*paths).select(*schema.names))


def read_counters(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The counters (name, value) committed with a version, the newest by default; names are ``<table>.<counter>``, and
    ``<table>.rows`` is the number of rows written. No table is read."""
    v = version if version is not None else latest_version(spark, root)
    kept = _commits(spark, root).where((F.col("version") == v) & F.col("counters").isNotNull()).limit(1)
    return kept.select(F.explode("counters").alias("name", "value"))


def table_rows(spark: SparkSession, root: str, name: str, version: int) -> int:
    """The rows of a repo-partitioned table in a version, those of repos it did not touch too; from its list of files."""
    return _parts(spark, root, name, version).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def _delete(spark: SparkSession, urls: list[str]) -> int:
    """Remove files named as the scan names them, percent-encoded; how many were there."""
    gone = 0
    for url in urls:
        target = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(url))
        gone += bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, False))
    return gone


def fold_commits(spark: SparkSession, root: str) -> int:
    """Write all commits into one file and remove the others, so that readers don't open a file per version; how many were
    removed. Stopped midway it leaves commits twice, which changes nothing. For times when nobody commits or reads."""
    commits = _commits(spark, root)
    old = commits.inputFiles()
    if len(old) < 2:
        return 0
    one = commits.groupBy("version").agg(F.any_value("tables").alias("tables"), F.max("next_ordinal").alias("next_ordinal"),
                                         F.any_value("counters", True).alias("counters"))
    one.coalesce(1).write.mode("append").parquet(f"{root}/{COMMITS}")
    return _delete(spark, old)


def drop_old_files(spark: SparkSession, root: str, name: str) -> int:
    """Remove the files of a repo-partitioned table that its newest version doesn't refer to; how many.
    Only for times when no reader is on an older version and nobody writes."""
    v = latest_version(spark, root)
    if v is None:
        return 0
    schema = _schema(spark, root, v, name)
    kept = _parts(spark, root, name, v).select(F.col("data_version").alias("version"), F.explode("files").alias("below"))
    rows = spark.read.schema(T.StructType([*schema, T.StructField("version", T.IntegerType())])).parquet(f"{root}/{name}")
    files = rows.select("version", _below(name).alias("path"), F.col("_metadata.file_path").alias("url")).distinct() \
        .withColumn("below", F.expr("substring(path, instr(path, '/') + 1)"))
    return _delete(spark, [r["url"] for r in files.join(kept, ["version", "below"], "left_anti").collect()])


def run_stage(spark: SparkSession, root: str, outputs: list[str], compute, resume: bool) -> dict[str, DataFrame]:
    """Reuse a stage's tables only if asked and all of them exist in the committed
    snapshot; otherwise compute them (``compute()`` returns {name: DataFrame})."""
    v = latest_version(spark, root)
    if resume and v is not None:
        committed = _commits(spark, root).where(F.col("version") == v).first()["tables"]
        if all(o in committed for o in outputs):
            return {o: read_snapshot(spark, root, o, v) for o in outputs}
    return compute()


def require_evidence(feedback: DataFrame, evidence: DataFrame) -> None:
    """No feedback and no merged-PR evidence at all → stop with an error."""
    if feedback.limit(1).count() == 0 and evidence.limit(1).count() == 0:
        raise RuntimeError("no review feedback or merged pull requests were found")


# ---- A7 -------------------------------------------------------------------------------------
def read_state(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The state as three tables of the newest committed snapshot; absent → error."""
    return {name: read_snapshot(spark, root, name) for name in STATE_TABLES}


def migrate_state_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Accept a legacy one-document state (version 1 or 2): arrays must be arrays,
    version 1 has no pending list (→ empty). Returned as the three state tables,
    to be published as version 2 by ``publish_snapshot``.

    A legacy document is a single JSON file, parsed by one task; this is a one-time
    bootstrap input, after which the state lives in partitioned tables.
    """
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    version = F.try_variant_get("v", "$.version", "int")
    t = lambda p: F.schema_of_variant(F.try_variant_get("v", p, "variant"))
    checks = raw.select(
        version.alias("version"),
        F.coalesce(t("$.raw_comments").startswith("ARRAY"), F.lit(False)).alias("raw_ok"),
        F.coalesce(t("$.notes").startswith("ARRAY"), F.lit(False)).alias("notes_ok"),
        (F.try_variant_get("v", "$.pending_prs", "variant").isNull()
         | F.coalesce(t("$.pending_prs").startswith("ARRAY"), F.lit(False))).alias("pending_ok")).first()
    if checks is None or checks["version"] not in (1, 2):
        raise RuntimeError("history is not initialised; run the batch job first")
    if not (checks["raw_ok"] and checks["notes_ok"]):
        raise ValueError("state contains invalid history arrays")
    if not checks["pending_ok"]:
        raise ValueError("state contains an invalid pending_prs array")

    def arr(p, st):
        return raw.select(F.explode(F.coalesce(F.try_variant_get("v", p, f"array<{st.simpleString()}>"),
                                               F.array().cast(f"array<{st.simpleString()}>"))).alias("r")) \
            .select("r.*")
    return {"raw_comments": arr("$.raw_comments", FEEDBACK), "notes": arr("$.notes", NOTE),
            "pending_prs": arr("$.pending_prs", PENDING)}


def write_skill(text: DataFrame, path: str) -> None:
    """The checklist document (one row) as a text file."""
    text.select("text").write.mode("overwrite").text(path)
