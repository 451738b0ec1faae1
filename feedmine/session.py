"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings every feedmine job relies on. They are correctness settings, not tuning:
# - LAST_WIN lets header maps keep the later duplicate after lower-casing (H8).
# - recursion limits are lifted for reply forests deeper than 100 levels.
# - a union must not rely on equal partitionings of its sides: when adaptive execution merges the
#   partitions of one side only, Spark 4.1 ends the job ("Can't zip RDDs").
# - UTC keeps derived timestamps equal to the ISO strings they came from.
REQUIRED_CONF = {
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.cteRecursionLevelLimit": "-1",
    "spark.sql.cteRecursionRowLimit": "-1",
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "feedmine") -> SparkSession:
    """Return the active session, creating a local one for tests and benches.

    On a cluster the session already exists (spark-submit); only the
    correctness settings above are applied to it.
    """
    active = SparkSession.getActiveSession()
    if active is None:
        builder = (
            SparkSession.builder.appName(app_name)
            .master(master or os.environ.get("FEEDMINE_MASTER", "local[8]"))
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "16g")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        )
        for key, value in REQUIRED_CONF.items():
            builder = builder.config(key, value)
        active = builder.getOrCreate()
        active.sparkContext.setLogLevel("ERROR")
    else:
        for key, value in REQUIRED_CONF.items():
            active.conf.set(key, value)
        if shuffle_partitions:
            active.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    checkpoint_dir(active)
    return active


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Taken from ``spark.checkpoint.dir`` when the cluster sets it. A fresh local folder is used only
    on a local master (tests, local runs); on a cluster an unset folder is an error, as executors
    cannot see the driver's own folders.
    """
    configured = (spark.conf.get("spark.checkpoint.dir", None)
                  or spark.sparkContext.getConf().get("spark.checkpoint.dir", None))
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="feedmine-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir() or local


def materialize(df):
    """Write ``df`` to the shared checkpoint folder and read it back (eager).

    Used where a value must be computed exactly once: model output (costly, not
    reproducible) and parsed responses (the optimizer would otherwise substitute
    the parse into every validation check that a filter pushes below it).
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Make a session handed to us (e.g. by a job runner) ready for feedmine:
    apply the correctness settings, set the checkpoint folder if unset, and ship the
    package to the executors' Python workers (once per context)."""
    for key, value in REQUIRED_CONF.items():
        try:
            spark.conf.set(key, value)
        except Exception:  # noqa: BLE001 - a static setting fixed by the cluster
            pass
    checkpoint_dir(spark)
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        # Spark serves the archive to the executors from the driver, whatever file system the
        # checkpoint folder is on.
        pkg = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="feedmine-"), "feedmine"), "zip",
                                      os.path.dirname(pkg), os.path.basename(pkg))
        sc.addPyFile(archive)
        _SHIPPED.add(sc.applicationId)
    return spark


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on whatever file system it names; a failure to look is raised."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))
