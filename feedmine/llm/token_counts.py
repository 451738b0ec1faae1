"""Exact length histogram: documents by encoded length, suffix sums for every context limit.

The texts are encoded once and only their lengths go on. Equal lengths of a group are counted
(partial counts before the shuffle), so what follows has one row per distinct length, however
many documents there are. For the length L the suffix sums over the histogram answer

* ``docs_over``, ``tokens_over``: documents longer than L and their tokens;
* ``tokens_kept``: all tokens if every document is cut to L tokens;
* ``docs_upto``, ``quantile``: documents of at most L tokens and their share, so the
  q-quantile is the least length with ``quantile >= q``.

The sums are made in two steps, within blocks of lengths and over the blocks, so no task
holds a group's whole histogram.

Null and empty texts have length 0. A null group column is a group of its own. Repeated rows
count each time. An empty table gives no rows. Other columns are ignored.

An empty table has no lengths; a long text is encoded whole and is one document of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedmine.llm.common import chunks_of, materialize
from feedmine.llm.encoders import library_ids

BLOCK = 1024


def token_lengths(docs: DataFrame, tokenizer_path: str, kind: str = "byte", text_col: str = "text",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and ``length``, the number of ids of the whole text."""
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_ids(tokenizer_path, kind)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for start, texts in chunks_of(batch.column(0)):
                n[start:start + len(texts)] = np.diff(encoder.encode(texts)[1], prepend=0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n)],
                                             names=[*batch.schema.names[1:], "length"])

    kept = docs.select(text_col, *keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:]),
                        "length bigint"])
    return kept.mapInArrow(lengths, schema)


def length_histogram(lengths: DataFrame, group_col: str | None = None) -> DataFrame:
    """``group, length, docs, tokens`` and the suffix sums named above, one row per distinct
    length of each group. With ``group_col``, the group ``*`` counts all documents too; a null
    group is shown as null."""
    counts = lengths.select(
        (F.col(group_col) if group_col else F.lit(None)).cast("string").alias("group"), "length")
    # Grouping column and marker apart, so a null group and the total don't meet.
    # One row per distinct length; kept, as it is read four times below.
    counts = materialize(counts.groupBy("group", "length").agg(F.count(F.lit(1)).alias("docs")))
    per_group = counts.withColumn("total", F.lit(group_col is None))
    if group_col:
        total = (counts.groupBy("length").agg(F.sum("docs").alias("docs"))
                 .select(F.lit("*").alias("group"), "length", "docs", F.lit(True).alias("total")))
        per_group = per_group.unionByName(total)
    else:
        per_group = per_group.withColumn("group", F.lit("*"))
    rows = (per_group.withColumn("tokens", F.col("docs") * F.col("length"))
            .withColumn("block", F.floor(F.col("length") / BLOCK).cast("long")))

    by_group = Window.partitionBy("total", "group")
    after = by_group.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    blocks = (rows.groupBy("total", "group", "block")
              .agg(F.sum("docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
              .select(F.col("total").alias("b_total"), F.col("group").alias("b_group"),
                      F.col("block").alias("b_block"),
                      F.coalesce(F.sum("b_docs").over(after), F.lit(0)).alias("docs_after"),
                      F.coalesce(F.sum("b_tokens").over(after), F.lit(0)).alias("tokens_after"),
                      F.sum("b_docs").over(by_group).alias("docs_all"),
                      F.sum("b_tokens").over(by_group).alias("tokens_all")))
    longer = (Window.partitionBy("total", "group", "block").orderBy("length")
              .rowsBetween(1, Window.unboundedFollowing))
    within = (rows.withColumn("docs_in", F.coalesce(F.sum("docs").over(longer), F.lit(0)))
              .withColumn("tokens_in", F.coalesce(F.sum("tokens").over(longer), F.lit(0))))
    joined = within.join(blocks, (F.col("total") == F.col("b_total"))
                         & F.col("group").eqNullSafe(F.col("b_group"))
                         & (F.col("block") == F.col("b_block")))
    docs_over = F.col("docs_in") + F.col("docs_after")
    tokens_over = F.col("tokens_in") + F.col("tokens_after")
    return joined.select(
        "group", "total", "length", "docs", "tokens",
        docs_over.alias("docs_over"), tokens_over.alias("tokens_over"),
        (F.col("tokens_all") - tokens_over + docs_over * F.col("length")).alias("tokens_kept"),
        (F.col("docs_all") - docs_over).alias("docs_upto"),
        ((F.col("docs_all") - docs_over) / F.col("docs_all")).alias("quantile"))
