"""WARC archives of individually compressed records with a Zstandard dictionary in front.

Every page gives one WARC/1.1 record. Of pages with equal payloads of at least ``MIN_REVISIT``
bytes the one with the least id is archived whole (``response``), the others as ``revisit`` of
it with the HTTP header alone; smaller payloads are archived whole each.

An archive is one Zstandard file: a skippable frame (magic 0x184D2A5D) with a dictionary, then one
frame per record, compressed with that dictionary. The dictionary is built from records of the
whole table, evenly chosen by a hash (at most ``SAMPLE_RECORDS``, of each its first ``SAMPLE_BYTES`` bytes, so that long
ones don't fill the sample), and stands in front of every archive. Spark's text writer writes the files, with an empty skippable frame as its line
separator: readers of Zstandard pass over it. So the archives go through Spark's own commit of
output on any file system that Spark writes to, and a lost executor leaves no torn file.

A record's id holds the page id, and the fields ``Page-ID`` and ``Refers-To-Page-ID`` repeat it in
plain digits. A page without id is a response without ``Page-ID``: nothing can refer to it and it
takes part in no revisit. Of repeated rows (equal id and payload) one is the response and the
others revisit it. A null payload is empty. A null URL leaves out ``WARC-Target-URI``; line breaks
in one are written as %0D and %0A. An empty table gives an archive folder without records.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmine.llm.common import parallelism

MIN_REVISIT = 100
SAMPLE_RECORDS, SAMPLE_BYTES = 1000, 8 << 10
#: Payload bytes of an archive; Spark reads a binary file whole, of 2 GB at most.
LEAST_ARCHIVE, MOST_ARCHIVE = 4 << 20, 256 << 20
DICTIONARY_MAGIC, SKIP_MAGIC = 0x184D2A5D, 0x184D2A50
#: An empty skippable frame; all its bytes are ASCII.
SEPARATOR = struct.pack("<II", SKIP_MAGIC, 0).decode("ascii")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: int | None, digest: str) -> str:
    """A name-based id of a page: from its id, or from its payload if it has none."""
    name = f"page:{page}" if page is not None else f"payload:{digest}"
    h = hashlib.sha256(name.encode()).digest()[:16]
    h = bytes([*h[:6], h[6] & 0x0F | 0x80, h[7], h[8] & 0x3F | 0x80, *h[9:]]).hex()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """The bytes of one WARC record."""
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "revisit" if refers_to is not None else "response"),
              ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if page is not None:
        fields.append(("Page-ID", str(page)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)),
                   ("Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary from sample records. Too few or too short ones to train on serve as they are: Zstandard
    takes any bytes as a dictionary of raw content."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 4)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def archive_frames(records: Iterator[bytes], level: int, dictionary: bytes) -> Iterator[bytes]:
    """The frames of one archive: the dictionary's, then one per record. An archive without records has none."""
    compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary))
    first = True
    for r in records:
        if first:
            yield struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
            first = False
        yield compressor.compress(r)


def archive_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record of an archive's bytes."""
    decompressor = zstandard.ZstdDecompressor()
    if len(content) >= 8:
        magic, size = struct.unpack_from("<II", content)
        if magic == DICTIONARY_MAGIC:
            decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(content[8:8 + size])))
            content = memoryview(content)[8 + size:]
    stream = io.BufferedReader(decompressor.stream_reader(content, read_across_frames=True), 1 << 18)
    while first := stream.readline():
        if first.strip() != b"WARC/1.1":
            raise ValueError("not a WARC record")
        fields = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("the archive ends within a record")
        yield fields, block


def table_dictionary(rows: DataFrame, size: int, date: str) -> bytes | None:
    """The dictionary of a table (page_id, url, payload): its sample goes to one task, its bytes come back."""
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [record(*(c[k].as_py() for c in batch.columns), None, date)[:SAMPLE_BYTES]
                   for batch in batches for k in range(batch.num_rows)]
        if samples:
            yield pa.RecordBatch.from_arrays([pa.array([build_dictionary(samples, size)], pa.binary())], names=["dictionary"])
    digest = F.sha2("payload", 256).alias("digest")
    picked = rows.select("page_id", "url", F.substring("payload", 1, SAMPLE_BYTES).alias("payload"), digest)
    picked = picked.orderBy(F.xxhash64("page_id", "digest"), "page_id", "digest", "url").limit(SAMPLE_RECORDS)
    found = picked.mapInArrow(train, "dictionary binary").first()
    return None if found is None else bytes(found["dictionary"])


def archive_count(total_bytes: int, parts: int) -> int:
    """As many archives as shuffle partitions; fewer if they would be smaller than ``LEAST_ARCHIVE`` (a dictionary
    stands in each), more if they would be larger than ``MOST_ARCHIVE``."""
    return max(1, min(parts, -(-total_bytes // LEAST_ARCHIVE)), -(-total_bytes // MOST_ARCHIVE))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               date: str = "1970-01-01T00:00:00Z", level: int = 3, dictionary_bytes: int = 64 * 1024,
               archives: int | None = None) -> None:
    """Write every page's record into ``archives`` files (by the payloads' bytes if not given).

    The least id of each repeated payload is found on digests alone: a payload that very many pages
    share is counted down before the shuffle, and the pages are then dealt by page id, which no
    payload can make uneven. Payloads move once.
    """
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("payload"))
    total = rows.agg(F.sum(F.octet_length("payload").cast("long"))).first()[0] or 0
    parts = archives or archive_count(total, parallelism(pages.sparkSession))
    dictionary = table_dictionary(rows, dictionary_bytes, date) or b""
    digests = rows.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size"))
    digests = digests.where(F.col("page_id").isNotNull() & (F.col("size") >= MIN_REVISIT))
    pairs = digests.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    least = (pairs.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.sum("n").alias("n"))
             .where("n > 1").select("digest", "first_id"))
    # Which pages revisit which: from the digests, without payloads.
    again = pairs.join(least, "digest").select(F.col("page_id").alias("a_page_id"), F.col("digest").alias("a_digest"), "first_id")
    dealt = rows.withColumn("digest", F.sha2("payload", 256)).repartition(parts, "page_id", "digest")
    joined = dealt.join(again.repartition(parts, "a_page_id", "a_digest"),
                        (F.col("page_id") == F.col("a_page_id")) & (F.col("digest") == F.col("a_digest")), "left")
    joined = joined.select("page_id", "digest", "url", "payload", "first_id").sortWithinPartitions("page_id", "digest", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            before = None
            for batch in batches:
                for k in range(batch.num_rows):
                    page, digest, url, payload, first = (c[k].as_py() for c in batch.columns)
                    same, before = (page, digest) == before, (page, digest)
                    revisits = first is not None and (page != first or same)
                    yield record(page, url, payload, digest, first if revisits else None, date)
        for frame in archive_frames(records(), level, dictionary):
            yield pa.RecordBatch.from_arrays([pa.array([frame], pa.binary())], names=["frame"])

    (joined.mapInArrow(write, "frame binary").select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", SEPARATOR).option("compression", "none").text(folder))


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload`` of every record, from the
    archives alone. A revisit's payload is null; its size and digest are those its record gives of
    the whole payload. A response's digest is computed from the payload and must be the stated one."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out: list[list] = [[] for _ in _READ]
                size = 0
                for row in _pages(batch.column(0)[k].as_buffer()):
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    size += row[4]
                    if size >= 8 << 20:
                        yield _batch(out)
                        out, size = [[] for _ in _READ], 0
                if out[0]:
                    yield _batch(out)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
                                  "payload_digest string, payload binary")


_READ = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
         "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}


def _batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _READ.values(), strict=True)], names=list(_READ))


def _pages(content: bytes) -> Iterator[tuple]:
    for fields, block in archive_records(content):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        stated = fields["warc-payload-digest"].removeprefix("sha256:")
        revisit = fields["warc-type"] == "revisit"
        if not revisit and (hashlib.sha256(payload).hexdigest() != stated or len(payload) != int(http["Content-Length"])):
            raise ValueError("a payload doesn't fit its digest")
        number = lambda x: None if x is None else int(x)
        yield (number(fields.get("page-id")), fields.get("warc-target-uri"), fields["warc-type"],
               number(fields.get("refers-to-page-id")), int(http["Content-Length"]), stated, None if revisit else payload)
