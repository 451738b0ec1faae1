"""Near duplicates by SimHash, searched with a Gray-order hierarchical index.

Fingerprint: A-Z in lower case, words are runs of other than ASCII white space, every three words
in a row (repeats included) are joined by a space and hashed with XXH64 (seed 42); a text of
fewer words is one shingle, a text without words has fingerprint zero. A bit is set if it is set
in over half of the hashes. Two documents are linked if their fingerprints differ in at most two
bits; groups are the connected components.

Search: only different fingerprints are searched. The 64 bits are cut into three blocks. Two
fingerprints that differ in two bits agree in at least one of them, so each fingerprint goes to three
buckets, one per block with its 21 or 22 bits as key. A bucket is only a first cut that deals the
work out; what it holds, some 5,000 of 10**10 fingerprints, is searched by the index. Within a task, each bucket's members are sorted
by the rank that the fingerprint has in Gray code, where neighbours share most bits. Over them
stands a hierarchy: a node has the mask of bits in which all its members agree, and their
pattern. A query goes down from the bucket's root with the differences met so far; a node adds only
the bits its own mask has beyond its parent's, and is left with all its members as soon as the
sum exceeds the limit.

A fingerprint has at most 2,080 others within two bits, so links never grow as the square of a
group. Each task sends on a spanning forest of the links it found; the components of
those are found by ``components.connected``.

An empty table gives no rows; a text of any length is hashed whole, its bits counted in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedmine.llm.common import materialize, parallelism
from feedmine.llm.components import connected

SHINGLE_WORDS, MAX_BITS, SEED = 3, 2, 42
#: First bit and number of bits of each block.
BLOCKS = ((0, 22), (22, 21), (43, 21))
FANOUT = 16
#: Rows searched at once (a bucket is never cut), and pairs of queries and members of their buckets, which bound
#: what a step of the search can hold before anything is pruned.
SEARCH_ROWS, PAIRS = 1 << 18, 1 << 22
BIT_SLICE = 1 << 16


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    shingles = zip(*(words[k:] for k in range(shingle_words)), strict=False) if len(words) >= shingle_words else [words]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, BIT_SLICE):
        part = hashes[i:i + BIT_SLICE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp, text_hash``: the fingerprint as a signed long and a hash of the text, which tells
    rows of equal id apart. Null is the empty text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("text_hash"),
                       F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(1)],
                                             names=["doc_id", "fp", "text_hash"])
    return rows.mapInArrow(run, "doc_id long, fp long, text_hash long")


def text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each number in the sequence of Gray codes."""
    rank = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """The hierarchy over members sorted by (bucket, Gray rank); ``bucket`` numbers are ascending."""

    def __init__(self, members: np.ndarray, bucket: np.ndarray):
        order = np.lexsort((gray_rank(members), bucket))
        self.members, self.order = members[order], order
        owner = bucket[order]
        mask, pattern = np.full(len(members), ~np.uint64(0)), self.members
        # Per level from the leaves up: mask, pattern, first child, and end of the children.
        self.levels: list[tuple[np.ndarray, ...]] = [(mask, pattern, None, None)]
        while True:
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.append(first, len(owner)))
            place = np.arange(len(owner)) - np.repeat(first, sizes)
            if (sizes == 1).all() and len(self.levels) > 1:
                break
            start = np.flatnonzero(place % FANOUT == 0)
            lead = np.repeat(pattern[start], np.diff(np.append(start, len(owner))))
            differs = np.bitwise_or.reduceat(pattern ^ lead, start)
            mask = np.bitwise_and.reduceat(mask, start) & ~differs
            pattern = pattern[start] & mask
            self.levels.append((mask, pattern, start, np.append(start[1:], len(owner))))
            owner = owner[start]
        self.root = np.searchsorted(owner, bucket[order])
        self.pairs = np.cumsum(np.bincount(self.root)[self.root])
        self.compared = 0  # members that were not pruned with a group above them

    def links(self, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (in ``members``) of pairs within ``max_bits`` in a bucket, each pair once."""
        lo = 0
        while lo < len(self.members):
            done = self.pairs[lo - 1] if lo else 0
            query = np.arange(lo, max(lo + 1, int(np.searchsorted(self.pairs, done + PAIRS, side="right"))))
            lo += len(query)
            node, met = self.root[query], np.zeros(len(query), np.int64)
            for depth in range(len(self.levels) - 1, 0, -1):
                mask, _, start, end = self.levels[depth]
                below_mask, below_pattern = self.levels[depth - 1][:2]
                n = end[node] - start[node]
                child = np.repeat(start[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
                query, met, parent = np.repeat(query, n), np.repeat(met, n), np.repeat(node, n)
                new_bits = below_mask[child] & ~mask[parent]
                met = met + np.bitwise_count((self.members[query] ^ below_pattern[child]) & new_bits)
                keep = met <= max_bits
                query, node, met = query[keep], child[keep], met[keep]
                self.compared += len(child) if depth == 1 else 0
            later = node > query
            yield query[later], node[later]


def spanning_links(fps: np.ndarray, bucket: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links between members of the same bucket."""
    index = GrayIndex(fps, bucket)
    label = np.arange(len(fps))
    for a, b in index.links(max_bits):
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(label, up := label[label]):
                label = up
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return index.members[label[linked]], index.members[linked]


def candidate_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b``: a spanning forest, per task, of the links between the fingerprints ``fp`` of ``distinct``."""
    if max_bits > MAX_BITS:
        raise ValueError("three blocks find pairs of up to two differing bits")
    tables = []
    for t, kept in enumerate(combinations(BLOCKS, len(BLOCKS) - MAX_BITS)):
        mask = sum(((1 << n) - 1) << at for at, n in kept)
        signed = mask - (1 << 64) if mask >> 63 else mask
        tables.append(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed).cast("long")).alias("bits")))
    rows = distinct.select("fp", F.explode(F.array(*tables)).alias("k")).select("fp", "k.t", "k.bits")
    dealt = rows.repartition(parallelism(distinct.sparkSession), "t", "bits").sortWithinPartitions("t", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def search(columns: list[np.ndarray]) -> pa.RecordBatch:
            fp, t, bits = columns
            fresh = np.r_[True, (t[1:] != t[:-1]) | (bits[1:] != bits[:-1])]
            bucket = np.cumsum(fresh)
            shared = np.bincount(bucket)[bucket] > 1
            a, b = spanning_links(fp[shared].view(np.uint64), bucket[shared], max_bits) if shared.any() else (fp[:0], fp[:0])
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        waiting: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            waiting.append([c.to_numpy().astype(np.int64) for c in batch.columns])
            size += batch.num_rows
            if size >= SEARCH_ROWS:
                held = [np.concatenate(c) for c in zip(*waiting, strict=True)]
                _, t, bits = held
                cuts = np.flatnonzero((t[1:] != t[:-1]) | (bits[1:] != bits[:-1]))
                end = int(cuts[-1]) + 1 if len(cuts) else 0
                if end:
                    yield search([c[:end] for c in held])
                waiting = [[c[end:] for c in held]]
                size = len(waiting[0][0])
        if size:
            yield search([np.concatenate(c) for c in zip(*waiting, strict=True)])

    return dealt.mapInArrow(run, "a long, b long")


def components(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fp, root`` for every distinct fingerprint: the least fingerprint (as a signed long) of its component."""
    distinct = prints.select("fp").distinct()
    roots = connected(candidate_links(distinct, max_bits))
    return (distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
            .select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row: 16 hex digits, and the least id reachable over links.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows stay
    each. Ids that are null are not counted for the least id; a component without any id has a
    null ``component_id``. Other columns are ignored; an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle_words).select("doc_id", "fp"))
    ids = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(components(prints, max_bits), "fp")
    least = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = ids.select("fp", "root").join(least, "root").select("fp", "component_id")
    return (prints.join(of_fp, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: that of the least id, then of the least text hash.

    Rows without an id stay only if their component has no row with one. All columns are kept; names that
    clash with those used here don't matter. Which row stays is settled without the texts, which
    are then shuffled once, with their narrow keys.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle_words))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    ids = prints.groupBy("fp").agg(F.min(rank).alias("least")).join(components(prints, max_bits), "fp")
    stays = ids.groupBy("root").agg(F.min("least").alias("least"))
    stays = stays.select(F.col("least.doc_id").alias("_stays_id"), F.col("least.text_hash").alias("_stays_hash"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                        F.col(id_col).cast("long").alias("_id"), text_hash(text_col).alias("_hash"))
    left = keyed.join(stays, F.col("_id").eqNullSafe(F.col("_stays_id")) & (F.col("_hash") == F.col("_stays_hash")), "left_semi")
    # Of repeated rows (equal id and text) one stays.
    once = Window.partitionBy("_id", "_hash").orderBy("_id")
    return left.withColumn("_nth", F.row_number().over(once)).where("_nth = 1").select("_row.*")
