"""Stable dense ordinals (E1) and fixed-size batches.

A dense ``0..n-1`` numbering in a total order is usually written as
``row_number() over (order by ...)``, which moves every row into one task. Here:
range-partition on the order key, sort within partitions, tag each row with its
position inside its partition, count rows per partition (one number per
partition, so the driver receives O(partitions), never data), turn the counts
into offsets, and add them back with a broadcast of that tiny table.

The range bounds are sampled, so the partitioned data is checkpointed (to the
shared checkpoint folder) before counting: the counts and the rows then come
from the same materialisation, also after an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmine.session import checkpoint_dir


def with_ordinal(df: DataFrame, order_cols: list[Column | str], name: str = "ordinal",
                 num_partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranged = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.checkpoint(eager=True)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    rows = sorted((r["_pid"], r["_n"], r["_m0"]) for r in counts.collect())
    offsets, running = [], 0
    for pid, cnt, m0 in rows:
        offsets.append((pid, running, m0))
        running += cnt
    if not offsets:
        return ranged.drop("_pid", "_mid").withColumn(name, F.lit(None).cast("long"))
    off = spark.createDataFrame(offsets, "_pid int, _off long, _m0 long")
    return (ranged.join(F.broadcast(off), "_pid")
            .withColumn(name, F.col("_off") + F.col("_mid") - F.col("_m0"))
            .drop("_pid", "_mid", "_off", "_m0"))


def assign_batches(df: DataFrame, size: int, ordinal: str = "ordinal") -> DataFrame:
    """Consecutive slices of the ordered rows; the last one may be short.

    Batches may span PRs and repos, as in the reference.
    """
    if size < 1:
        raise ValueError("batch size must be at least 1")
    return (df.withColumn("batch_id", F.floor(F.col(ordinal) / size).cast("long"))
              .withColumn("pos", (F.col(ordinal) % size).cast("long")))
