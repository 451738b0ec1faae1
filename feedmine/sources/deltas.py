"""Keyed tables that are merged when they are read (K1-K3, G2): a change writes its own rows, not the table.

A table starts with a base, written whole. Each change after it is a delta: the rows that enter, and the keys that leave, by the
table's key or by any other columns (a repo, the slice of a pull request). A row is part of the table if no
later delta names its key; a delta's own rows aren't hit by the keys it names. ``compact`` writes a new base.

Reading joins the scan with the keys that left, one row per key; while these fit they are broadcast and the table isn't
shuffled, beyond that the join is salted (``join_small``). Readers open the folders of the last base and the deltas after it, by
name, and list nothing else. A change has a name and is claimed before anything is written (``claims``): of two writers of
one version one fails, and a change that was committed before is passed over.

Keys are not null, and a change holds a key once; both are checked before it is claimed. Other columns may be null.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedmine.operators.joins import join_small
from feedmine.session import materialize, path_exists
from feedmine.sources.claims import claim

LOG = "_log"
LOG_SCHEMA = "version int, base int, change string, n long, gone array<string>, key array<string>, schema string"
SEQ = "delta_seq"


def _log(spark: SparkSession, root: str) -> DataFrame:
    if not path_exists(spark, f"{root}/{LOG}"):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).parquet(f"{root}/{LOG}")


def head(spark: SparkSession, root: str, version: int | None = None) -> Row | None:
    """The log row of a version, the newest by default; None if there is none."""
    rows = _log(spark, root)
    if version is not None:
        rows = rows.where(F.col("version") == version)
    found = rows.orderBy(F.desc("version")).limit(1).collect()
    return found[0] if found else None


def _checked(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows``, computed once, if their keys are complete and each is there once."""
    rows = materialize(rows)
    missing = F.lit(False)
    for c in key:
        missing = missing | F.col(c).isNull()
    if bad := rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | missing).limit(1).collect():
        raise ValueError(f"a key is null or there more than once: {bad[0].asDict()}")
    return rows


def _commit(spark: SparkSession, root: str, change: str, last: Row | None, rows: DataFrame,
            gone: dict[tuple[str, ...], DataFrame], key: Sequence[str], as_base: bool) -> int:
    version = 0 if last is None else last["version"] + 1
    claim(spark, root, version, version - 1, change)
    folder = f"{root}/rows/{SEQ}={version}"
    rows.write.mode("overwrite").parquet(folder)
    n = spark.read.schema(rows.schema).parquet(folder).count()
    for by, keys in gone.items():
        folder = f"{root}/gone/by={'+'.join(by)}/{SEQ}={version}"
        keys.select(*by).distinct().write.mode("overwrite").parquet(folder)
        n += spark.read.parquet(folder).count()
    entry = (version, version if as_base else last["base"], change, n, ["+".join(by) for by in gone], list(key), rows.schema.json())
    spark.createDataFrame([entry], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/{LOG}")
    return version


def _done(spark: SparkSession, root: str, change: str) -> int | None:
    """The version that ``change`` made, if it was committed."""
    return _log(spark, root).where(F.col("change") == change).agg(F.max("version")).first()[0]


def create(spark: SparkSession, root: str, rows: DataFrame, key: Sequence[str], change: str = "create") -> int:
    """Start a table with ``rows`` as its base."""
    if (done := _done(spark, root, change)) is not None:
        return done
    if head(spark, root) is not None:
        raise ValueError(f"{root} holds a table already")
    return _commit(spark, root, change, None, _checked(rows, key), {}, key, as_base=True)


def apply(spark: SparkSession, root: str, change: str, rows: DataFrame | None = None,
          gone: Sequence[DataFrame] = ()) -> int:
    """One change: the rows that enter (K1: each replaces the row of its key) and, per DataFrame of ``gone``, the values of its
    columns whose rows leave (K2: the key; K3: the repo; G2: repo and pull request). Rows that enter stay. Returns the version."""
    if (done := _done(spark, root, change)) is not None:
        return done
    last = head(spark, root)
    if last is None:
        raise ValueError(f"{root} holds no table")
    schema = T.StructType.fromJson(json.loads(last["schema"]))
    key = tuple(last["key"])
    keys: dict[tuple[str, ...], DataFrame] = {}
    if rows is not None:
        rows = _checked(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]), key)
        keys[key] = rows.select(*key)
    else:
        rows = spark.createDataFrame([], schema)
    for leaving in gone:
        by = tuple(leaving.columns)
        if unknown := set(by) - set(schema.names):
            raise ValueError(f"the table has no column {sorted(unknown)[0]}")
        keys[by] = keys[by].unionByName(leaving) if by in keys else leaving
    return _commit(spark, root, change, last, rows, keys, key, as_base=False)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table as of ``version``, the newest by default."""
    last = head(spark, root, version)
    if last is None:
        raise ValueError(f"{root} holds no version {'at all' if version is None else version}")
    schema = T.StructType.fromJson(json.loads(last["schema"]))
    # One row per delta since the last base, which compaction keeps few.
    steps = _log(spark, root).where(F.col("version").between(last["base"], last["version"])).select("version", "gone").collect()
    seq = T.StructField(SEQ, T.IntegerType())
    folder = f"{root}/rows"
    rows = spark.read.schema(T.StructType([*schema.fields, seq])).option("basePath", folder).parquet(
        *[f"{folder}/{SEQ}={s['version']}" for s in steps])
    for by in sorted({b for s in steps for b in s["gone"]}):
        cols = by.split("+")
        folder = f"{root}/gone/by={by}"
        left = spark.read.schema(T.StructType([*[schema[c] for c in cols], seq])).option("basePath", folder).parquet(
            *[f"{folder}/{SEQ}={s['version']}" for s in steps if by in s["gone"]])
        last_gone = left.groupBy(*cols).agg(F.max(SEQ).alias("_gone_at"))
        rows = join_small(rows, last_gone, cols, "left").where(F.col("_gone_at").isNull() | (F.col(SEQ) >= F.col("_gone_at"))).drop("_gone_at")
    return rows.select(*schema.names)


def needs_compaction(spark: SparkSession, root: str, share: float = 0.2, deltas: int = 64) -> bool:
    """Whether the deltas since the last base hold more than ``share`` as many rows and keys as it, or are more than ``deltas``."""
    last = head(spark, root)
    if last is None:
        return False
    later = F.col("version") > last["base"]
    facts = _log(spark, root).where(F.col("version") >= last["base"]).agg(
        F.sum(F.when(later, F.col("n"))).alias("n"), F.count_if(later).alias("deltas"), F.sum(F.when(~later, F.col("n"))).alias("base")).first()
    return facts["deltas"] > deltas or (facts["n"] or 0) > share * facts["base"]


def compact(spark: SparkSession, root: str, change: str, cluster: Sequence[str] = ()) -> int:
    """Write the table as a new base, in ranges of ``cluster`` and the key, so that a filter on them skips files."""
    if (done := _done(spark, root, change)) is not None:
        return done
    last = head(spark, root)
    order = [*cluster, *[k for k in last["key"] if k not in cluster]]
    rows = read(spark, root, last["version"]).repartitionByRange(*order).sortWithinPartitions(*order)
    return _commit(spark, root, change, last, rows, {}, last["key"], as_base=True)


def drop_old_files(spark: SparkSession, root: str) -> int:
    """Delete the files before the newest base, which no reader of the newest version opens. Returns how many folders went."""
    base = head(spark, root)["base"]
    old = _log(spark, root).where(F.col("version") < base).select("version", "gone").collect()
    n = 0
    for step in old:
        for folder in [f"rows/{SEQ}={step['version']}", *[f"gone/by={by}/{SEQ}={step['version']}" for by in step["gone"]]]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}")
            n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n
