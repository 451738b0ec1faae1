"""Consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``points`` places on a ring of 64-bit hashes; a key belongs to the shard of
the first place at or after its own hash. A full shard lets its further keys go on clockwise
to the next shard, so no shard exceeds its bound, and keys whose shard has room never move.

Bounds: the row count is divided over the shards, the first ones taking one more each, so the
bounds add up to exactly all rows (law ``rows``: counts at most one apart).

All keys of one arc (the keys before one place) meet the same shards in the same order. So the
walk needs only the number of keys in each arc, at most ``shards * points`` numbers whatever
the corpus: the driver settles which arc gives how many keys to which shard, in rounds, each
round offering what is left to the next shard clockwise, arcs in ring order. The rows then
find their shard and slot by their rank within their arc. No text is shuffled.

Every row counts, repeated rows too. A null text has size 16 and CRC 0. Rows with a null id
are placed by the hash of their text and size. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW_OVERHEAD = 16


def ring_points(spark: SparkSession, shards: int, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places on the ring and the shard of each; the same hash as for the keys."""
    rows = (spark.range(shards * points, numPartitions=1)
            .select((F.col("id") % shards).cast("int").alias("shard"),
                    F.xxhash64(F.lit("place"), F.col("id") % shards,
                               F.floor(F.col("id") / shards)).alias("place")).collect())
    rows = sorted((r["place"], r["shard"]) for r in rows)
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int32)


def walk(arc_counts: np.ndarray, shard_at: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) for every piece of every arc."""
    places = len(shard_at)
    room, used = bounds.astype(np.int64).copy(), np.zeros(len(bounds), np.int64)
    left, rank = arc_counts.astype(np.int64).copy(), np.zeros(places, np.int64)
    pieces = []
    # A full shard is passed over, so every further round reaches at least one other shard.
    at = np.arange(places)
    while (todo := np.flatnonzero(left)).size:
        for arc in todo:
            shard = shard_at[at[arc]]
            take = int(min(left[arc], room[shard]))
            if take:
                pieces.append((int(arc), int(rank[arc]), int(rank[arc]) + take, int(shard), int(used[shard])))
                room[shard] -= take
                used[shard] += take
                left[arc] -= take
                rank[arc] += take
            at[arc] = (at[arc] + 1) % places
        if not room.any() and left.any():
            raise ValueError("the bounds hold fewer rows than there are")
    return pieces


def shard_rows(docs: DataFrame, shards: int = 40, points: int = 256, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, home_shard, shard, slot``: the id, UTF-8 bytes of the text plus
    16, the CRC-32 of its bytes, the shard its key belongs to, the one that has it, and its
    place there (0, 1, ... without gaps)."""
    spark = docs.sparkSession
    places, shard_at = ring_points(spark, shards, points)

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        at = np.searchsorted(places, h.to_numpy(np.int64), side="left") % len(places)
        return pd.Series(at.astype(np.int32))

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("size", "text_crc32"))
    rows = rows.withColumn("h", F.xxhash64(F.lit("key"), F.col("doc_id").cast("string"), spread))
    rows = rows.withColumn("arc", arc_of("h"))
    counted = rows.groupBy("arc").count().collect()  # at most shards * points numbers
    arc_counts = np.zeros(len(places), np.int64)
    for r in counted:
        arc_counts[r["arc"]] = r["count"]
    total = int(arc_counts.sum())
    bounds = np.full(shards, total // shards, np.int64)
    bounds[:total % shards] += 1
    pieces = walk(arc_counts, shard_at, bounds)
    home = [int(x) for x in shard_at]
    plan = spark.createDataFrame([(a, home[a], lo, hi, s, slot) for a, lo, hi, s, slot in pieces],
                                 "arc int, home_shard int, lo long, hi long, shard int, first long")
    in_arc = Window.partitionBy("arc").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(in_arc).cast("long") - 1)
    # The plan has about one row per place, at most a few per shard more: a fixed size.
    return (ranked.join(F.broadcast(plan), "arc")
            .where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
            .select("doc_id", "size", "text_crc32", "home_shard", "shard",
                    (F.col("first") + F.col("rank") - F.col("lo")).alias("slot")))
