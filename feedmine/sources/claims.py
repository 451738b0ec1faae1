"""Claims: a version of a history belongs to the writer that first creates its claim file.

Two jobs may take the same next version at the same time. Each creates ``<root>/_claims/version=N`` if it is absent, which a file
system does atomically (HDFS, local disks; on an object store only with a committer that has conditional writes). The file
names the writer and the version it builds on. The one who finds another's name fails before it writes
anything. A writer that replays its own version, with the same name and parent, goes on.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

CLAIMS = "_claims"


class VersionTaken(RuntimeError):
    """Another writer holds this version, or it was claimed on another parent."""


def _file(spark: SparkSession, root: str, version: int):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{CLAIMS}/version={version}")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def holder(spark: SparkSession, root: str, version: int) -> dict | None:
    """``writer`` and ``parent`` of a version's claim; None if nobody has claimed it. A claim whose writer died before
    it could write its name reads as held by nobody known."""
    path, files = _file(spark, root, version)
    if not files.exists(path):
        return None
    stream = files.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text) if text else {"writer": None, "parent": None}


def claim(spark: SparkSession, root: str, version: int, parent: int, writer: str) -> None:
    """Take ``version``, built on the committed version ``parent``, for ``writer``; raises ``VersionTaken`` if it isn't to be had."""
    path, files = _file(spark, root, version)
    wanted = {"writer": writer, "parent": parent}
    try:
        stream = files.create(path, False)
    except Exception as failure:  # noqa: BLE001 - the file system's own error says only that the file is there
        found = holder(spark, root, version)
        if found is None:
            raise
        if found != wanted:
            raise VersionTaken(f"version {version} is held by {found['writer']} on version {found['parent']}") from failure
        return
    try:
        stream.write(json.dumps(wanted).encode())
    finally:
        stream.close()
