"""Best-fit decreasing of token pieces into sequences of a fixed capacity.

Best-fit decreasing takes the pieces from long to short and puts each into the open sequence
with the least room that still holds it, or opens a new one. Pieces of equal length and
sequences of equal room are alike, so the whole corpus is settled on its length histogram, which has at
most ``capacity`` numbers: the tightest room is found in a segment tree over the rooms 1 to
``capacity``, in logarithmic time, and as many pieces of that length as fit go there at once.
The outcome is that of placing the pieces one by one.

The resulting steps say which ranks of a length go to which sequences. Every piece then finds its
sequence and offset from its rank among the pieces of its length; ranks are made of counts per
(length, salt) and places within them, so a length that a third of the corpus has is split too.

An empty table gives no pieces; only texts longer than a sequence are cut, into as many pieces as they need.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedmine.llm.common import chunks_of, materialize
from feedmine.llm.encoders import library_ids

SALTS = 64


class RoomTree:
    """How many sequences have each room, with the least non-empty room at or above a length."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, length: int) -> int | None:
        at = length + self.size
        if self.count[at]:
            return length
        while at > 1:
            # Up while there is nothing to the right, then down on the left.
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_steps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first sequence, pieces per sequence, offset) in the order of the packing; a step
    holds the ranks up to the next step of its length."""
    tree, open_ = RoomTree(capacity), {}
    steps, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            open_.setdefault(room, deque()).append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, n = capacity, -(-left // (capacity // length))
                first, opened = opened, opened + n
            else:
                first, n = open_[room].popleft()
                tree.add(room, -n)
            each = room // length
            full, rest = divmod(min(left, n * each), each)
            steps.append((length, rank, first, each, capacity - room))
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + (rest > 0), n - full - (rest > 0))
            rank += full * each + rest
            left -= full * each + rest
    return steps


def pack(pieces: DataFrame, capacity: int, length_col: str = "length", order_cols: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with ``sequence_id`` (from 0, any order) and ``offset`` (these replace columns of the same name).

    ``length_col`` must lie between 1 and ``capacity``; a null or other length raises an error. Ties are
    broken by ``order_cols``; repeated rows are pieces each. An empty table gives no rows.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = pieces.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{length_col}`").cast("int").alias("length"),
                         F.xxhash64(*[F.col(f"`{c}`") for c in order_cols]).alias("mix"))
    fits = F.col("length").between(1, capacity)
    rows = rows.withColumn("length", F.when(fits, F.col("length")).otherwise(
        F.raise_error(F.concat(F.lit("no piece length: "), F.coalesce(F.col("length").cast("string"), F.lit("null")))).cast("int")))
    rows = materialize(rows.withColumn("salt", F.pmod("mix", F.lit(SALTS)).cast("int")))
    counts = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = np.array(best_fit_steps(histogram, capacity), np.int64).reshape(-1, 5)
    lengths, firsts, sequences, each, offsets = steps[np.lexsort((steps[:, 1], steps[:, 0]))].T

    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("length").alias("s_length"), F.col("salt").alias("s_salt"), F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "salt").orderBy("mix", *[f"row.{c}" for c in order_cols]))
    ranked = rows.withColumn("place", place.cast("long"))
    # At most capacity * SALTS rows, whatever the corpus, dealt like the ranked rows.
    ranked = (ranked.join(starts, (F.col("length") == F.col("s_length")) & (F.col("salt") == F.col("s_salt")))
              .select("row", "length", (F.col("before") + F.col("place") - 1).alias("rank")))
    schema = ranked.select("row.*").schema.add("sequence_id", "long").add("offset", "long")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = lengths << 44 | firsts
        for batch in batches:
            length, rank = (batch.column(i).to_numpy().astype(np.int64) for i in (1, 2))
            step = np.searchsorted(key, length << 44 | rank, side="right") - 1
            nth = rank - firsts[step]
            yield pa.RecordBatch.from_arrays(
                [*batch.column(0).flatten(), pa.array(sequences[step] + nth // each[step]),
                 pa.array(offsets[step] + nth % each[step] * length)], names=schema.names)

    return ranked.mapInArrow(assign, schema)


def cut_into_pieces(docs: DataFrame, tokenizer_path: str, kind: str, end_id: int, capacity: int,
                    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids`` as little-endian unsigned 32-bit, if asked for) of
    every whole text, encoded by the tokenizers library, ``end_id`` appended, cut every ``capacity`` ids.

    Null is the empty text: a piece with the end id alone. Repeated rows give their own pieces. Other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = library_ids(tokenizer_path, kind), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for first, texts in chunks_of(batch.column(1)):
                at, piece, start, length, crc, kept = [], [], [], [], [], []
                for k, ids in enumerate(encoder.encode_each(texts)):
                    ids += last
                    for p in range(0, len(ids), 4 * capacity):
                        part = ids[p:p + 4 * capacity]
                        at.append(first + k)
                        piece.append(p // (4 * capacity))
                        start.append(p // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            kept.append(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *[pa.array(kept, pa.binary())] * with_ids], names=names)

    schema = f"doc_id {rows.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, kind: str = "word", end_id: int = 1, capacity: int = 4096,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut and pack whole documents: the columns of ``cut_into_pieces``, ``sequence_id`` and ``offset``."""
    return pack(cut_into_pieces(docs, tokenizer_path, kind, end_id, capacity, id_col, text_col, with_ids), capacity)
