"""Token ids in files of fixed-width bit packing, with block offsets for random access.

Each id takes the least number of bits that holds the largest id of the vocabulary, lowest bit
first, one after the other. A file:

    header   8 bytes ``FMIDPACK``, then little-endian: version u32, bits u32, ids per block u32, range i64
    blocks   packed ids of a fixed number of ids; the last may hold fewer
    footer   documents u64, ids u64, blocks u64; byte offset of each block u64; per document:
             id i64, whether it has an id u8, number of ids u64
    trailer  byte offset of the footer u64, 8 bytes ``FMIDPACK``

Behind each of these parts stand the 8 bytes ``FMIDPEND``: Spark's text writer puts them there
as its line separator. So the files go through Spark's own commit of output, on any file
system that Spark writes to, and a lost executor leaves no half-written file behind.

Documents lie in ascending id, those without an id first; file ``n`` holds the n-th range of ids.

An empty table gives one file without documents at most; a long text is encoded whole and spans blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmine.llm.common import chunks_of, id_key, key_ranges, materialize, parallelism
from feedmine.llm.encoders import library_ids

MAGIC, END = b"FMIDPACK", "FMIDPEND"
HEADER = struct.Struct("<8sIIIq")
VERSION = 1
BLOCK_IDS = 1 << 16
#: Bytes of text a file, about as many of ids; Spark reads a binary file whole, of 2 GB at most.
FILE_TEXT = 512 << 20


def width_of(vocabulary: int) -> int:
    """Bits that hold every id of a vocabulary of this size."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} takes more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(each[:, :bits], bitorder="little").tobytes()


def unpack(packed: np.ndarray, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from the place ``first`` on; touches only the bytes that hold them."""
    if bits in (8, 16, 32):
        step = bits // 8
        return packed[first * step:(first + count) * step].view(f"<u{step}").astype("<u4")
    low = first * bits
    each = np.unpackbits(packed[low // 8:(low + count * bits + 7) // 8], bitorder="little")
    out = np.zeros((count, 32), np.uint8)
    out[:, :bits] = each[low % 8:low % 8 + count * bits].reshape(count, bits)
    return np.packbits(out, axis=1, bitorder="little").reshape(-1).view("<u4")


class TokenFile:
    """Reads the bytes of one file."""

    def __init__(self, content: bytes | memoryview):
        self._data = np.frombuffer(content, np.uint8)
        magic, version, self.bits, self.block_ids, self.range = HEADER.unpack_from(content, 0)
        end = len(content) - len(END)
        at, tail = struct.unpack_from("<Q8s", content, end - 16)
        if (magic, version, tail) != (MAGIC, VERSION, MAGIC):
            raise ValueError("not a whole token file of this version")
        docs, self.ids, blocks = struct.unpack_from("<QQQ", content, at)
        at += 24

        def array(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, n, at)
            at += out.nbytes
            return out

        self.offsets = array("<u8", blocks)
        self.doc_ids, self.has_id, self.counts = array("<i8", docs), array("u1", docs), array("<u8", docs).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def read(self, start: int, count: int) -> np.ndarray:
        """The ids ``start`` to ``start + count - 1`` of this file."""
        out = []
        while count > 0:
            block, first = divmod(start, self.block_ids)
            n = min(count, self.block_ids - first)
            out.append(unpack(self._data[int(self.offsets[block]):], self.bits, first, n))
            start, count = start + n, count - n
        return np.concatenate(out) if out else np.zeros(0, "<u4")

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.counts[k]))


def file_parts(rows: Iterator[tuple[int | None, np.ndarray]], bits: int, number: int,
               block_ids: int = BLOCK_IDS) -> Iterator[bytes]:
    """The parts of one file, one after the other; holds one block and the footer's numbers."""
    held, n_held, offsets, names, counts = [], 0, [], [], []
    header = HEADER.pack(MAGIC, VERSION, bits, block_ids, number)
    yield header
    at = len(header) + len(END)
    for name, ids in rows:
        names.append(name)
        counts.append(len(ids))
        held.append(ids)
        n_held += len(ids)
        if n_held >= block_ids:
            flat = np.concatenate(held)
            for i in range(0, n_held - block_ids + 1, block_ids):
                offsets.append(at)
                yield (block := pack(flat[i:i + block_ids], bits))
                at += len(block) + len(END)
            held = [flat[n_held // block_ids * block_ids:]]
            n_held = len(held[0])
    if n_held:
        offsets.append(at)
        yield (block := pack(np.concatenate(held), bits))
        at += len(block) + len(END)
    yield b"".join((
        struct.pack("<QQQ", len(names), sum(counts), len(offsets)), np.array(offsets, "<u8").tobytes(),
        np.array([x if x is not None else 0 for x in names], "<i8").tobytes(),
        np.array([x is not None for x in names], "u1").tobytes(), np.array(counts, "<u8").tobytes()))
    yield struct.pack("<Q8s", at, MAGIC)


def _transit(bits: int) -> str:
    return "<u1" if bits <= 8 else "<u2" if bits <= 16 else "<u4"


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, vocabulary: int,
                      kind: str = "byte", id_col: str = "doc_id", text_col: str = "text",
                      block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text with the tokenizers library, append ``end_id``, write the files.

    Null is the empty text: it has the end id alone. Repeated rows and rows of equal id are written
    each, in the order of their ids' bytes. Other columns are ignored. The ids are shuffled once,
    in the narrowest whole-byte type; texts are not.
    """
    bits = width_of(vocabulary)
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    files = max(parallelism(docs.sparkSession), -(-total // FILE_TEXT))
    cuts, _ = key_ranges(docs, id_col, text_col, files)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_ids(tokenizer_path, kind)
        last = np.array([end_id], _transit(bits)).tobytes()
        for batch in batches:
            number = np.searchsorted(cuts, batch.column(1).to_numpy(), side="right").astype(np.int32)
            for start, texts in chunks_of(batch.column(2)):
                ids = [x + last for x in encoder.encode_each(texts, _transit(bits))]
                at = slice(start, start + len(texts))
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(texts)).columns[:2], pa.array(number[at]), pa.array(ids, pa.binary())],
                                                 names=["doc_id", "key", "part", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def rows() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in chain([first], batches):
                yield from documents(batch)

        def documents(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
            for k in range(batch.num_rows):
                yield batch.column(0)[k].as_py(), np.frombuffer(batch.column(3)[k].as_py(), _transit(bits))

        for part in file_parts(rows(), bits, first.column(2)[0].as_py(), block_ids):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], names=["part"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), id_key(id_col, text_col).alias("key"),
                       F.col(text_col).alias("text"))
    encoded = rows.mapInArrow(encode, "doc_id long, key long, part int, ids binary")
    dealt = encoded.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("key", "ids")
    (dealt.mapInArrow(write, "part binary").select(F.col("part").cast("string").alias("value"))
     .write.option("lineSep", END).option("compression", "none").text(folder))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, range, start_in_file, file_ids, ids`` of every document, from the files alone; ``ids``
    are little-endian unsigned 32-bit."""
    return _documents(spark, folder, "ids binary", lambda ids: pa.array([x.tobytes() for x in ids], pa.binary()))


def token_file_index(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files: how many ids stand before each document in
    all files, its number of ids, the CRC-32 of them as little-endian unsigned 32-bit numbers.

    Only the number of ids of each file goes through the driver.
    """
    rows = materialize(_documents(spark, folder, "n_tokens long, ids_crc32 long",
                                  lambda ids: pa.array([len(x) for x in ids], pa.int64()),
                                  lambda ids: pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())))
    totals = sorted((r["range"], r["file_ids"]) for r in rows.select("range", "file_ids").distinct().collect())
    before = np.cumsum([0] + [n for _, n in totals])
    base = spark.createDataFrame([(r, int(b)) for (r, _), b in zip(totals, before, strict=False)], "range long, base long")
    return (rows.join(F.broadcast(base), "range")  # one row per file
            .select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32"))


def _documents(spark: SparkSession, folder: str, columns: str, *make) -> DataFrame:
    names = ["doc_id", "range", "start_in_file", "file_ids", *(c.split()[0] for c in columns.split(", "))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                if len(content := batch.column(0)[k].as_buffer()) == 0:
                    continue  # the file of an empty table
                file = TokenFile(content)
                for i in range(0, len(file.counts), 1000):
                    ids = [file.document(j) for j in range(i, min(i + 1000, len(file.counts)))]
                    n, at = len(ids), slice(i, i + len(ids))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.doc_ids[at], mask=file.has_id[at] == 0), pa.array(np.full(n, file.range, np.int64)),
                         pa.array(file.starts[at]), pa.array(np.full(n, file.ids, np.int64)), *(f(ids) for f in make)],
                        names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(read, f"doc_id long, range long, start_in_file long, file_ids long, {columns}")
