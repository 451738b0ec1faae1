"""Shared helpers: the shared folder, ordered ranges, small vectorised pieces."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmine.session import checkpoint_dir, materialize

#: Null ids sort before all others; among themselves by a hash of the text, in this range.
NULL_KEY_BASE = -(2 ** 63)
NULL_KEY_SPAN = 2 ** 40

__all__ = ["NULL_KEY_BASE", "byte_slices", "chunks_of", "id_key", "joined", "key_ranges", "materialize", "parallelism",
           "range_of", "shared_folder", "texts_of", "words_of"]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the folder that the driver and all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_key(id_col: str, text_col: str) -> Column:
    """The total order "ascending id": the id as a long; rows without an id come first, in
    the order of a hash of their text, so that many of them still spread over all ranges."""
    spread = F.pmod(F.xxhash64(F.col(text_col)), F.lit(NULL_KEY_SPAN))
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY_BASE).cast("long") + spread)


def key_ranges(df: DataFrame, id_col: str, text_col: str, parts: int) -> tuple[np.ndarray, int | None]:
    """Cut points of about equal row counts in the order of ``id_key``, and the least key.

    Every cut point is the key of a row, the first of its range. Only one number per range
    reaches the driver. The text column is read only if some id is null.
    """
    has_null = df.where(F.col(id_col).isNull()).select(F.lit(1)).limit(1).count() > 0
    key = id_key(id_col, text_col) if has_null else F.col(id_col).cast("long")
    probs = [i / parts for i in range(1, parts)] or [0.5]
    row = df.select(key.alias("k")).agg(
        F.min("k").alias("least"),
        F.percentile_approx("k", probs, F.lit(max(10_000, 20 * parts))).alias("cuts")).first()
    if row is None or row["least"] is None:
        return np.empty(0, np.int64), None
    cuts = np.unique(np.array(row["cuts"] if parts > 1 else [], np.int64))
    return cuts[cuts > row["least"]], int(row["least"])


def range_of(key: Column, cuts: np.ndarray) -> Column:
    """Number of the range that holds ``key``: how many cut points are not above it."""
    @F.pandas_udf("int")
    def number(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(np.int64), side="right").astype(np.int32))
    return number(key)


def texts_of(column: pa.ChunkedArray | pa.Array) -> Iterator[str]:
    """The strings of an Arrow column one by one, null as empty; no list of all of them."""
    for value in column:
        yield value.as_py() or ""


def chunks_of(column: pa.Array, max_chars: int = 8_000_000) -> Iterator[tuple[int, list[str]]]:
    """Consecutive runs of a batch's texts of about ``max_chars`` (at least one text each),
    with the position of the first."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts_of(column)):
        if held and size + len(text) > max_chars:
            yield start, held
            start, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield start, held


def byte_slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Start and count of consecutive runs of texts of about ``most`` bytes, at least one text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        done = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield start, end - start
        start = end


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (stretches without ASCII white space) of all texts in one array, and how many each text has."""
    lists = pc.ascii_split_whitespace(texts)
    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(words), 0)
    return words.filter(some), np.bincount(rows.filter(some).to_numpy(), minlength=len(texts))


def joined(words: pa.Array, sizes: np.ndarray, stays: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words that stay, joined by one space for each text, and their numbers."""
    upto = np.concatenate([[0], np.cumsum(stays)])
    ends = np.cumsum(sizes)
    offsets = upto[np.concatenate([[0], ends])]
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), words.filter(pa.array(stays)))
    return pc.cast(pc.binary_join(lists, " "), pa.string()), np.diff(offsets)
