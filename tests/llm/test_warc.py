"""WARC archives: round trip, revisits, dictionary, defined results for odd rows."""

import hashlib
import struct
from collections import Counter

import pytest
import zstandard

from feedmine.llm import warc
from feedmine.llm.common import shared_folder

BIG, OTHER = "<p>" + "same payload " * 40, "<p>" + "é other " * 40


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(5, "http://a/1", BIG), (3, "http://a/2", BIG), (9, None, BIG), (3, "http://a/2", BIG), (None, "http://n", BIG), (None, None, None),
            (1, "http://s\r\nX: y", "small"), (2, "http://s", "small"), (4, "u", None), (6, "u", ""), (7, "u", OTHER), (8, "u", "x" * 99),
            (10, "u", "x" * 99), (11, "u", "y" * 100), (12, "u", "y" * 100), (13, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (-2, "u", "long " * 200_000)]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, size int")


def expected(rows):
    least, out, met = {}, Counter(), set()
    for page, _, html in rows:
        if page is not None:
            least[html] = min(least.get(html, page), page)
    for page, url, html in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (html or "").encode()
        first = page is None or len(data) < 100 or (page == least[html] and html not in met)
        if page is not None and page == least[html]:
            met.add(html)
        out[page, len(data), hashlib.sha256(data).hexdigest(), "response" if first else "revisit", None if first else least[html]] += 1
    return out


@pytest.mark.parametrize("archives", [1, 5])
def test_round_trip(spark, pages, archives):
    folder = shared_folder(spark, "test")
    warc.write_warc(pages, folder, archives=archives)
    got = warc.read_warc(spark, folder).collect()
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == expected(rows)
    texts = Counter((r[2] or "").encode() for r in rows)
    assert all(bytes(r["payload"]) in texts for r in got if r["record_type"] == "response")
    assert {r["url"] for r in got} >= {"http://s%0D%0AX: y", None}


def test_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    folder = shared_folder(spark, "test")
    warc.write_warc(pages, folder, archives=2)
    got = warc.read_warc(spark, folder).collect()
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == expected(rows)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).collect()
    for f in files:
        content = bytes(f["content"])
        magic, size = struct.unpack_from("<II", content)
        assert magic == warc.DICTIONARY_MAGIC and content[8:12] == b"\x37\xa4\x30\xec"
        # Records are frames of their own, so one can be read without those before it.
        first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8:8 + size])).decompress(content[16 + size:])
        assert first.startswith(b"WARC/1.1\r\n") and first.endswith(b"\r\n\r\n")
    plain = sum(len(zstandard.compress(r[2].encode())) for r in rows)
    assert sum(len(f["content"]) for f in files) < plain + len(rows) * 250 + len(files) * 70_000


def test_empty(spark):
    folder = shared_folder(spark, "test")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_warc(spark, folder).collect() == []


def test_every_archive_has_a_dictionary(spark):
    """Also 200 archives of one or two pages, and pages in front that are longer than any sample."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    long = spark.createDataFrame([(-9, "u", "long page " * 600_000)], "page_id long, url string, html string")
    for table, archives in ((pages, 200), (pages.select("page_id", "url", "html").union(long), 2), (long, 1), (pages.limit(1), 3)):
        folder = shared_folder(spark, "test")
        warc.write_warc(table, folder, archives=archives)
        files = [bytes(f["content"]) for f in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).collect()]
        filled = [f for f in files if f]
        assert filled and all(struct.unpack_from("<I", f)[0] == warc.DICTIONARY_MAGIC for f in filled)
        assert len({f[8:8 + struct.unpack_from("<I", f, 4)[0]] for f in filled}) == 1
        assert warc.read_warc(spark, folder).count() == table.count()


def test_number_of_archives_follows_the_bytes():
    assert warc.archive_count(0, 200) == 1 and warc.archive_count(10 << 20, 200) == 3
    assert warc.archive_count(10 << 30, 200) == 200 and warc.archive_count(1 << 40, 200) == 4096


def test_few_records_serve_as_raw_dictionary():
    assert warc.build_dictionary([b"one record", b"two"], 8) == b"ecordtwo"
    raw = warc.build_dictionary([b"WARC/1.1 short"], 64)
    frames = list(warc.archive_frames(iter([b"one", b"two"]), 3, raw))
    assert len(frames) == 3 and frames[0][8:] == raw and list(warc.archive_frames(iter([]), 3, raw)) == []


def test_torn_archives_raise():
    record = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "2020-01-01T00:00:00Z")
    content = b"".join(warc.archive_frames(iter([record, record[:-5]]), 3, warc.build_dictionary([record], 1 << 16)))
    with pytest.raises(ValueError):
        list(warc.archive_records(content))
