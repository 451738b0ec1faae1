"""Quartile bucket digest of whole texts, and the bounded difference of two digests.

A window of five bytes slides over the UTF-8 text. Six byte triplets of each window, all with
its first byte, are hashed into 128 buckets and counted. Each bucket is then coded by the
quartile of the 128 counts that its count falls in (2 bits), so the code says which triplets
are common and not how long the text is. In front stand the length on a logarithmic scale and
the ratios of the quartiles.

Hex digits of a fingerprint: 2 length code, 2 quartile ratios, 64 bucket codes (two buckets a
digit). Texts under five bytes have no window; their buckets are set from their bytes' hash, so
that short texts are alike only if equal.

The difference of two fingerprints adds up the steps between bucket codes (a step over the
whole range counts double), between length codes and between ratio codes, each bounded; the
likeness is 1 - difference / greatest difference.

Equal texts have equal fingerprints. Null is the empty text.

An empty table gives an empty table; a text of any length is counted in slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmine.llm.common import id_key, key_ranges, parallelism, range_of

BUCKETS = 128
WINDOW = 5
#: Offsets of the second and third byte of the six triplets of a window.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: Odd multipliers of the triplet hash.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
SLICE = 1 << 18
LENGTH_STEPS = 16
RATIO_STEPS = 4
#: Cost of a step of 0 to 3 between two bucket codes.
CODE_COST = np.array([0, 1, 2, 6])
#: Differences from here on all count as unlike.
BOUND = 256


def bucket_counts(data: bytes) -> np.ndarray:
    """Counts of the hashed triplets of every window; slices bound the memory."""
    counts = np.zeros(BUCKETS, np.int64)
    a, b, c = (np.uint32(m) for m in MULTIPLIERS)
    for start in range(0, max(0, len(data) - WINDOW + 1), SLICE):
        part = np.frombuffer(data, np.uint8, min(SLICE + WINDOW - 1, len(data) - start), start).astype(np.uint32)
        n = len(part) - WINDOW + 1
        first = part[:n] * a
        for k, (i, j) in enumerate(TRIPLETS):
            h = first + part[i:i + n] * b
            h ^= h >> np.uint32(15)
            h += part[j:j + n] * c + np.uint32(k * 0x165667B1)
            h *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(h >> np.uint32(25), minlength=BUCKETS)
    return counts


def encode(counts: np.ndarray, data: bytes) -> str:
    """The fingerprint of a text with these bucket counts and bytes."""
    if len(data) < WINDOW:
        bits = np.frombuffer(hashlib.sha256(data).digest(), np.uint8)
        return "0000" + bits.tobytes().hex()
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(-1, 4)
    packed = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    length = min(255, int(np.log2(len(data)) * 8))
    ratios = [int(16 * q // max(1, q3)) & 15 if q < q3 else 15 for q in (q1, q2)]
    return f"{length:02x}{ratios[0]:x}{ratios[1]:x}{packed.astype(np.uint8).tobytes().hex()}"


def fingerprint(text: str | None) -> str:
    data = (text or "").encode()
    return encode(bucket_counts(data), data)


def difference(one: str, other: str) -> int:
    """From 0 for equal fingerprints to ``BOUND``."""
    a, b = (np.frombuffer(bytes.fromhex(x[4:]), np.uint8) for x in (one, other))
    total = 0
    for shift in (0, 2, 4, 6):
        step = np.abs((a >> shift & 3).astype(np.int8) - (b >> shift & 3).astype(np.int8))
        total += int(CODE_COST[step].sum())
    total += min(LENGTH_STEPS, abs(int(one[:2], 16) - int(other[:2], 16)))
    total += sum(min(RATIO_STEPS, abs(int(one[i], 16) - int(other[i], 16))) for i in (2, 3))
    return min(BOUND, total)


def likeness(one: str, other: str) -> float:
    return 1 - difference(one, other) / BOUND


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with a column ``name`` holding each text's fingerprint (it replaces a column of
    that name)."""
    @F.pandas_udf("string")
    def of(texts):
        return texts.map(fingerprint)
    return docs.withColumn(name, of(F.coalesce(F.col(text_col), F.lit(""))))


def compare_with_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document's text.

    The edited text has its last quarter of code points replaced by as many first ones of the
    next document in ascending id (after the last comes the first). Rows with a null id come
    before all others; rows of equal id follow each other by text. A table of one row is its
    own next document.

    The rows are dealt to ranges of ids and sorted there, one shuffle; the first row of each
    range goes to the end of the range before it too, so each range can be read through with
    only two texts in memory. The share that original and edited text have in common is
    counted once.
    """
    cuts, least = key_ranges(docs, id_col, text_col, parallelism(docs.sparkSession))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("key", id_key("doc_id", "text")).withColumn("part", range_of(F.col("key"), cuts))
    last = len(cuts)
    first_keys = [int(c) for c in cuts] + ([least] if least is not None else [])
    # A row that opens a range closes the one before; the first row of all closes the last range.
    closes = F.when(F.col("key").isin(first_keys),
                    F.array(F.struct(F.col("part"), F.lit(False).alias("tail")),
                            F.struct(F.when(F.col("part") == 0, last).otherwise(F.col("part") - 1).alias("part"),
                                     F.lit(True).alias("tail"))))
    alone = F.array(F.struct(F.col("part"), F.lit(False).alias("tail")))
    dealt = (rows.select("doc_id", "text", "key", F.explode(F.coalesce(closes, alone)).alias("to"))
             .select("doc_id", "text", "key", "to.part", "to.tail")
             .repartitionById(last + 1, F.col("part"))
             .sortWithinPartitions("tail", "key", "text"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # doc_id, text, its fingerprint and counts so far
        done = False
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for k in range(batch.num_rows):
                if done:
                    break
                text, tail = batch.column(1)[k].as_py() or "", batch.column(4)[k].as_py()
                data = text.encode()
                n = len(text)
                stays = text[:n - n // 4].encode()
                # Windows within the part that stays, then those that begin in its last bytes.
                common = bucket_counts(stays)
                border = max(0, len(stays) - WINDOW + 1)
                own = encode(common + bucket_counts(data[border:]), data)
                if held is not None:
                    for column, value in zip(out, _edited(*held, text, own), strict=True):
                        column.append(value)
                done = tail
                held = (batch.column(0)[k].as_py(), text, own, common, stays)
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(out, _TYPES, strict=True)], names=_NAMES)

    return dealt.mapInArrow(compare, ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                      "edited_fingerprint string, near_edited double, near_next double"))


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _edited(doc_id, text: str, own: str, common: np.ndarray, stays: bytes, following: str, next_own: str) -> tuple:
    data = stays + following[:len(text) // 4].encode()
    border = max(0, len(stays) - WINDOW + 1)
    edited = encode(common + bucket_counts(data[border:]), data)
    return (doc_id, len(text), hashlib.sha256(data).hexdigest(), own, edited,
            likeness(own, edited), likeness(own, next_own))
