"""Join helpers: broadcast only behind a measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only if its rows were counted and take no more than this.
BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_ROW_LIMIT = 1_000_000


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: 8 per value, text by its bytes, arrays by their elements."""
    def of(col: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(col), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)):
                return F.octet_length(F.to_json(F.struct(col.alias("x")))) + 16
            return F.coalesce(F.size(col), F.lit(0)) * 8 + 16
        if isinstance(kind, (T.StructType, T.MapType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(col.alias("x")))), F.lit(0)) + 16
        return F.lit(8)
    total = F.lit(16).cast("long")
    for f in df.schema.fields:
        total = total + of(F.col(f"`{f.name}`"), f.dataType)
    return total


def fits_broadcast(df: DataFrame, limit_bytes: int = BROADCAST_BYTES, limit_rows: int = BROADCAST_ROW_LIMIT) -> bool:
    """Whether the rows, counted and measured now, are few and small enough for every executor's memory."""
    n, size = df.select(row_bytes(df).alias("b")).agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return n <= limit_rows and size <= limit_bytes


def broadcast_if_small(df: DataFrame, row_bound: int | None) -> DataFrame:
    """Hint a broadcast when the caller knows the side has at most ``row_bound`` rows and the measured
    rows fit.

    Otherwise no hint is given and Spark's own size estimate
    (``autoBroadcastJoinThreshold``) and AQE decide at run time, falling back to a
    shuffled join when the side is large.
    """
    if row_bound is not None and row_bound <= BROADCAST_ROW_LIMIT and fits_broadcast(df, limit_rows=row_bound):
        return F.broadcast(df)
    return df


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left",
               limit_rows: int = BROADCAST_ROW_LIMIT, salt_buckets: int = 64,
               salt_col: str | None = None) -> DataFrame:
    """Join a large table to a per-key aggregate (one row per key).

    The small side is measured first (two numbers to the driver). If it fits it is
    broadcast: the large side is never shuffled, so a key holding a third of all
    rows cannot land in one task. Else the small side is replicated over
    ``salt_buckets`` salts and the large side takes one salt per row (a hash of
    ``salt_col`` or of the row), so each key is split over that many tasks.
    """
    small = small.persist()
    if fits_broadcast(small, limit_rows=limit_rows):
        return big.join(F.broadcast(small), on, how)
    salted_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
    h = F.xxhash64(F.col(salt_col)) if salt_col else F.xxhash64(*[F.col(c) for c in big.columns])
    salted_big = big.withColumn("_salt", F.pmod(h, F.lit(salt_buckets)).cast("int"))
    return salted_big.join(salted_small, on + ["_salt"], how).drop("_salt")
