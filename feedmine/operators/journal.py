"""A journal of model answers (J1, J3): what a lost task or a stopped job has already been answered isn't asked again.

A task appends its answers in small Parquet files, each whole or absent, under ``<folder>/run=<id>/task=<number>``. The
restarted task reads the files of its own number; a job started again on the same folder joins its prompts with the
whole journal, as a table. Answers are keyed by (system text, prompt id, attempt); another model needs another folder. If two
copies of a task answered the same call, the least file name counts.

Files go through pyarrow's file systems (local, HDFS, S3, GCS), as Python tasks have no Hadoop client.
"""

from __future__ import annotations

import uuid
from hashlib import sha256

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmine.session import path_exists

SCHEMA = "system_id string, prompt_id string, attempt int, raw string"
_ARROW = pa.schema([("system_id", pa.string()), ("prompt_id", pa.string()), ("attempt", pa.int32()), ("raw", pa.string())])


def system_id(system: str) -> str:
    return sha256(system.encode()).hexdigest()


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with its file system named, so that a task opens the same place as the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def answers(spark: SparkSession, folder: str, system: str, attempt: int) -> DataFrame:
    """(prompt_id, attempt, raw): the journal's answers to ``system`` in one attempt, one per prompt. No folder: no rows."""
    if not path_exists(spark, folder):
        return spark.createDataFrame([], "prompt_id string, attempt int, raw string")
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(folder)
    rows = rows.where((F.col("system_id") == system_id(system)) & (F.col("attempt") == attempt))
    rows = rows.withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.groupBy("prompt_id", "attempt").agg(F.min_by("raw", "_file").alias("raw"))


class TaskJournal:
    """The part of a journal that belongs to one task of one run."""

    def __init__(self, folder: str, run: str, task: int, system: str, attempt: int):
        if "://" in folder:
            self._fs, root = pafs.FileSystem.from_uri(folder)
        else:
            self._fs, root = pafs.LocalFileSystem(), folder.removeprefix("file:")
        self._dir = f"{root}/run={run}/task={task}"
        self._key = system_id(system)
        self._attempt = attempt

    def read(self) -> dict[str, str]:
        """prompt id -> answer of an earlier copy of this task."""
        found = {}
        for info in self._fs.get_file_info(pafs.FileSelector(self._dir, allow_not_found=True)):
            if info.base_name.startswith("seg-"):
                rows = pq.read_table(info.path, schema=_ARROW, filesystem=self._fs, partitioning=None)
                for pid, raw in zip(rows["prompt_id"].to_pylist(), rows["raw"].to_pylist(), strict=True):
                    if pid not in found or info.path < found[pid][0]:
                        found[pid] = (info.path, raw)
        return {pid: raw for pid, (_, raw) in found.items()}

    def append(self, rows: pd.DataFrame) -> None:
        """Add answers (prompt_id, raw) as one file. It is written under a name that readers pass over, then moved."""
        if rows.empty:
            return
        table = pa.table({"system_id": [self._key] * len(rows), "prompt_id": rows["prompt_id"].tolist(),
                          "attempt": [self._attempt] * len(rows), "raw": rows["raw"].tolist()}, schema=_ARROW)
        self._fs.create_dir(self._dir, recursive=True)
        name = f"{uuid.uuid4().hex}.parquet"
        pq.write_table(table, f"{self._dir}/_tmp-{name}", filesystem=self._fs)
        self._fs.move(f"{self._dir}/_tmp-{name}", f"{self._dir}/seg-{name}")
