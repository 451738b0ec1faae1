"""Repeated passages of words over all documents by seed and extend.

A window is ``window`` consecutive words of one document. A word goes if some window that covers it
also starts earlier: in a document before (ascending id, null ids first, equal ids by a hash of the text,
equal rows one after the other) or earlier in the same one.

1. Winnowing. Every ``seed_words`` consecutive words have a hash; in each window the least one (the
   rightmost of equals) is its anchor. Equal windows have equal anchors at the same place, so no repeat of
   the window's length is missed. The windows around one anchor are its cell, at most
   ``2 * window - seed_words`` words, seven windows on average.
2. Join on anchors. The cells of all documents meet by anchor. An anchor met once ends here.
3. Extension. An anchor's match is extended to both ends of the cell: a cell equal to an earlier one of
   the same anchor repeats as a whole. Where the cells of an anchor differ, the first of each kind is extended
   window by window: the words around its anchor are fetched from its document, and each window
   meets all others of the same words.
4. Windows that start earlier elsewhere are joined to maximal stretches, and their words go.

Words are compared by two 64-bit hashes. Within an anchor's group cells are equal if 64 bits of theirs are too,
windows if 128 bits are.

Hot groups. A bounded sample of documents (``SAMPLE_DOCS`` rows) shows which anchors are so frequent
that one task would get far more than its share. Their cells are dealt by a salt besides. What comes first
under its salt need not be the first of all, so it goes through the window step, where the windows of hot
anchors meet in two steps: under a salt, then the first ones of all salts. The sample decides only how rows
are dealt; results are exact whatever it holds.

Results: one row per row of the table. A null text has no words. A text shorter than a window keeps
all its words. Of equal rows all but one lose every word, if they hold a window. An empty table gives an
empty table; columns but id and text don't matter. Texts are worked on in slices of ``SLICE_BYTES``, a longer
one alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedmine.llm.common import byte_slices, id_key, joined, parallelism, shared_folder, words_of

SLICE_BYTES = 8 << 20
SAMPLE_DOCS = 20_000
#: An anchor that occurs fewer times in the sample is never hot, so the list of hot ones is short.
LEAST_SAMPLED = 20
#: Equal rows are given back in blocks of this many.
COPIES = 100_000
#: Odd multipliers of the two polynomial hashes, and those of the final mixing.
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIXERS = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
#: Below a cell's first window: 8 bits for its further windows, one for "look at each window", one for "hot".
FIRST_BIT, SPAN_BIT = 10, 2


def mixed(h: np.ndarray) -> np.ndarray:
    for m in MIXERS:
        h = (h ^ h >> np.uint64(33)) * np.uint64(m)
    return h ^ h >> np.uint64(33)


def word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every word; each distinct one is hashed once."""
    coded = words.dictionary_encode()
    distinct, codes = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()
    one, other = (np.array([xxhash.xxh64_intdigest(w, seed) for w in distinct], np.uint64)[codes] for seed in (0, 1))
    return one, other


def powers(factor: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, factor
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = out[:more] * np.uint64(step)
        done, step = done + more, step * step % 2 ** 64
    return out


class Stretches:
    """Hashes of any stretches of words: a sum of word hashes times powers, shifted to the stretch's start."""

    def __init__(self, hashes: np.ndarray, factor: int):
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(factor, len(hashes))[:len(hashes)], out=self.sums[1:])
        self.back = powers(pow(factor, -1, 2 ** 64), len(hashes) + 1)

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[start + size] - self.sums[start]) * self.back[start] + np.asarray(size, np.uint64))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` consecutive values the place of the least one, the rightmost of equals."""
    place, step = np.arange(len(values)), 1

    def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] <= values[a], b, a)

    while 2 * step <= width:
        place, step = lesser(place[:-step], place[step:]), 2 * step
    return lesser(place[:len(place) - (width - step)], place[width - step:]) if width > step else place


def window_cells(hashes: np.ndarray, sizes: np.ndarray, window: int, seed_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor of every cell; places are those in ``hashes``."""
    none = np.empty(0, np.int64)
    if len(hashes) < window:
        return none, none, none.astype(np.uint64)
    grams = Stretches(hashes, FACTORS[0]).of(np.arange(len(hashes) - seed_words + 1), seed_words)
    place = least_places(grams, window - seed_words + 1)
    ends = np.cumsum(sizes)
    room = np.maximum(sizes - window + 1, 0)
    # Starts of windows that lie within one document.
    start = np.arange(room.sum()) + (ends - sizes - np.cumsum(room) + room).repeat(room)
    if not len(start):
        return none, none, none.astype(np.uint64)
    chosen = place[start]
    # Neighbouring documents never share an anchor: it lies within its window.
    opens = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    return start[opens], np.diff(np.append(opens, len(start))), grams[chosen[opens]]


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def cells_of(docs: DataFrame, window: int, seed_words: int, hot: np.ndarray) -> DataFrame:
    """``key, tie, anchor, cell, at, hot`` of every cell of every document; ``at`` packs its first window (word
    number) and its further windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, count in byte_slices(batch.column(2), SLICE_BYTES):
                part = batch.slice(begin, count)
                words, sizes = words_of(part.column(2))
                hashes, others = word_hashes(words)
                first, windows, anchor = window_cells(hashes, sizes, window, seed_words)
                if not len(first):
                    continue
                content = Stretches(others, FACTORS[1]).of(first, windows + window - 1)
                starts = np.cumsum(sizes) - sizes
                row = np.searchsorted(starts, first, side="right") - 1
                at = first - starts[row] << FIRST_BIT | windows - 1 << SPAN_BIT
                for lo in range(0, len(first), 1 << 17):
                    s = slice(lo, lo + (1 << 17))
                    rows = pa.array(row[s])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(rows), part.column(1).take(rows), _signed(anchor[s]), _signed(content[s]), pa.array(at[s]),
                         pa.array(np.isin(anchor[s], hot))], names=["key", "tie", "anchor", "cell", "at", "hot"])
    return docs.select("key", "tie", "text").mapInArrow(run, "key long, tie long, anchor long, cell long, at long, hot boolean")


def hot_anchors(docs: DataFrame, window: int, seed_words: int) -> np.ndarray:
    """Anchors so frequent in a sample of documents that one of them would fill a good part of a task."""
    sample = docs.sample(min(1.0, SAMPLE_DOCS / max(docs.count(), 1)), seed=1)
    counted = cells_of(sample, window, seed_words, np.empty(0, np.uint64)).groupBy("anchor").count()
    frequent = F.when(F.col("count") >= LEAST_SAMPLED, F.struct("anchor", "count"))
    row = counted.agg(F.sum("count").alias("all"), F.collect_list(frequent).alias("frequent")).first()
    least = max(LEAST_SAMPLED, (row["all"] or 0) / (4 * parallelism(docs.sparkSession)))
    return np.array([a for a, n in row["frequent"] if n >= least], np.int64).view(np.uint64)


def taken_once(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``key, tie, doc_id, text, n``: every different row once with its number; key and tie are its place in the order.
    Beside it whether some ids repeat, so that ``n`` can be over 1.

    With unique ids no text moves. Else equal rows are counted down before the shuffle, and the table
    is written to the shared folder."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select(id_key("doc_id", "text").alias("key"), "doc_id", "text")
    if not rows.groupBy("doc_id").count().where("count > 1").select(F.lit(1)).limit(1).count():
        return rows.select("key", F.lit(0).cast("long").alias("tie"), "doc_id", "text", F.lit(1).cast("long").alias("n")), False
    once = (rows.withColumn("tie", F.xxhash64("text")).groupBy("key", "tie")
            .agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("n")))
    folder = shared_folder(docs.sparkSession, "different-rows")
    once.write.parquet(folder)
    return docs.sparkSession.read.parquet(folder), True


def _salt(hot: str, parts: int, *columns: str) -> Column:
    return F.when(F.col(hot), F.pmod(F.xxhash64(*columns), F.lit(parts))).otherwise(0)


def matched_cells(cells: DataFrame, parts: int, by: list[str]) -> DataFrame:
    """The columns of ``by`` and ``cells``: of every document the cells that repeat as a whole, and (marked) those whose windows
    have to be looked at one by one. One shuffle, by anchor; hot anchors by a salt besides."""
    dealt = cells.withColumn("salt", _salt("hot", parts, "key", "tie", "at")).repartition("anchor", "salt")
    of_kind = Window.partitionBy("anchor", "salt", "cell").orderBy("key", "tie", "at")
    # The same order as above: one sort serves both.
    of_anchor = (Window.partitionBy("anchor", "salt").orderBy("cell", "key", "tie", "at")
                 .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = (dealt.withColumn("nth", F.row_number().over(of_kind))
              .withColumn("least", F.first("cell").over(of_anchor)).withColumn("most", F.last("cell").over(of_anchor)))
    first = F.col("nth") == 1
    marked = marked.where(~first | F.col("hot") | (F.col("least") < F.col("most")))
    bits = F.when(first, 2).otherwise(0) + F.when(F.col("hot"), 1).otherwise(0)
    return marked.select(*by, (F.col("at") + bits).alias("at")).groupBy(*by).agg(F.collect_list("at").alias("cells"))


def marked_windows(docs: DataFrame, window: int) -> DataFrame:
    """``key, tie, at, h1, h2, hot`` of every window of the marked cells; ``at`` is its first word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at = _entries(batch.column(5))
            marked = at & 2 > 0
            row, at = row[marked], at[marked]
            need = np.unique(row)
            batch = batch.take(pa.array(need))
            row = np.searchsorted(need, row)
            for begin, count in byte_slices(batch.column(3), SLICE_BYTES):
                part = batch.slice(begin, count)
                words, sizes = words_of(part.column(3))
                mine = (row >= begin) & (row < begin + count)
                some, cell = row[mine] - begin, at[mine]
                windows = (cell >> SPAN_BIT & 255) + 1
                upto = np.cumsum(windows)
                first = np.arange(int(windows.sum())) + ((cell >> FIRST_BIT) - upto + windows).repeat(windows)
                owner, hot = some.repeat(windows), (cell & 1 > 0).repeat(windows)
                start = first + (np.cumsum(sizes) - sizes)[owner]
                hashes = [Stretches(h, f).of(start, window) for h, f in zip(word_hashes(words), FACTORS, strict=True)]
                for lo in range(0, len(first), 1 << 17):
                    s = slice(lo, lo + (1 << 17))
                    rows = pa.array(owner[s])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(rows), part.column(1).take(rows), pa.array(first[s]), *(_signed(h[s]) for h in hashes),
                         pa.array(hot[s])], names=["key", "tie", "at", "h1", "h2", "hot"])
    return docs.mapInArrow(run, "key long, tie long, at long, h1 long, h2 long, hot boolean")


def later_windows(windows: DataFrame, parts: int, by: list[str]) -> DataFrame:
    """The columns of ``by`` and ``windows``: of every document the windows whose words start earlier too."""
    dealt = windows.withColumn("salt", _salt("hot", parts, "key", "tie", "at")).repartition("h1", "h2", "salt")
    order = ("key", "tie", "at")
    once = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("h1", "h2", "salt").orderBy(*order)))
    # At most one row per salt is left of a hot window.
    again = once.where("hot AND nth = 1").select("h1", "h2", *order)
    again = again.withColumn("nth", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(*order)))
    later = once.where("nth > 1").select(*by, "at").union(again.where("nth > 1").select(*by, "at"))
    return later.groupBy(*by).agg(F.collect_list(F.shiftleft("at", FIRST_BIT)).alias("windows"))


def _entries(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every entry of a list column."""
    return pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).to_numpy()


def _without(docs: DataFrame, id_type: str, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = [_entries(batch.column(c)) for c in (5, 6)]
            entries[0] = tuple(x[entries[0][1] & 2 == 0] for x in entries[0])
            row, at = (np.concatenate(x) for x in zip(*entries, strict=True))
            for begin, count in byte_slices(batch.column(3), SLICE_BYTES):
                part = batch.slice(begin, count)
                words, sizes = words_of(part.column(3))
                starts = np.cumsum(sizes) - sizes
                mine = (row >= begin) & (row < begin + count)
                first = starts[row[mine] - begin] + (at[mine] >> FIRST_BIT)
                change = np.zeros(len(words) + 1, np.int32)
                np.add.at(change, first, 1)
                np.add.at(change, first + (at[mine] >> SPAN_BIT & 255) + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                kept, left = joined(words, sizes, ~gone)
                # Stretches end with their document.
                edge = np.zeros(len(words) + 1, bool)
                edge[starts] = True
                opens = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone])[:-1]))
                edge[-1] = True
                closes = np.flatnonzero(gone & (edge[1:] | ~np.append(gone, False)[1:])) + 1
                of = np.searchsorted(starts, opens, side="right") - 1
                spans = pa.StructArray.from_arrays([pa.array(opens - starts[of]), pa.array(closes - opens)], names=["start", "length"])
                offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=count))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(2), pa.array(sizes), pa.array(sizes - left), kept, pa.ListArray.from_arrays(pa.array(offsets), spans)],
                    names=["doc_id", "n_words", "n_removed", "kept", "repeats"])
    return docs.mapInArrow(run, f"doc_id {id_type}, n_words long, n_removed long, kept string, repeats array<struct<start: long, length: long>>")


def _further_copies(once: DataFrame, window: int) -> DataFrame:
    """The rows of ``_without`` for all but the first of equal rows: every word of theirs starts earlier too."""
    words = once.where("n > 1").selectExpr("doc_id", "n - 1 AS more", r"filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '') AS words")
    rows = words.selectExpr("doc_id", "more", "cast(size(words) AS long) AS n_words", f"size(words) >= {window} AS gone",
                            f"CASE WHEN size(words) >= {window} THEN '' ELSE array_join(words, ' ') END AS kept")
    blocks = rows.withColumn("lo", F.explode(F.expr(f"sequence(0L, more - 1, {COPIES}L)"))).repartition("doc_id", "lo")
    each = blocks.withColumn("_", F.explode(F.expr(f"sequence(lo, least(more, lo + {COPIES}) - 1)")))
    return each.selectExpr("doc_id", "n_words", "if(gone, n_words, 0L) AS n_removed", "kept",
                           "CASE WHEN gone THEN array(struct(0L AS start, n_words AS length)) "
                           "ELSE cast(array() AS array<struct<start: bigint, length: bigint>>) END AS repeats")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, seed_words: int = 6) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the words that stay, joined by one
    space) and ``repeats`` (start and length of the maximal stretches that went, in words)."""
    if not 0 < seed_words <= window <= seed_words + 255:
        raise ValueError("a window holds a seed and at most 256 places for it")
    parts = parallelism(docs.sparkSession)
    once, repeated = taken_once(docs, id_col, text_col)
    cells = cells_of(once, window, seed_words, hot_anchors(once, window, seed_words))
    # Both steps over documents ask for the same columns in the same way, so that their texts are shuffled once.
    columns = ("key", "tie", "doc_id", "text", "n", "cells")
    by = ["key", "tie"] if repeated else ["key"]
    matched = once.join(matched_cells(cells, parts, by), by, "left").select(*columns)
    later = later_windows(marked_windows(matched, window), parts, by)
    result = _without(matched.join(later, by, "left").select(*columns, "windows"), once.schema["doc_id"].dataType.simpleString(), window)
    return result.unionByName(_further_copies(once, window)) if repeated else result
