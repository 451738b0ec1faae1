"""Fill-in-the-middle against a rewriting with Python's own strings, and back to the exact text."""

import hashlib
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedmine.llm import fill_middle
from feedmine.llm.common import byte_slices
from feedmine.llm.queries import op12_fill_in_middle


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(docs):
    rows = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((r["doc_id"], *brute(r["doc_id"], r["text"]), r["text"] or "") for r in docs.collect())
    assert Counter(tuple(r) for r in rows) == want
    return rows


@pytest.mark.parametrize("table", ["odd", "documents", "empty"])
def test_equals_brute_force(table, request):
    rows = check(request.getfixturevalue(table))
    assert table != "documents" or {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_sentinels_and_odd_characters(spark):
    pieces = ["<", "<P", "P>", "<P>", "<S>", "<M>", "<<S", "S>", "<M", "a\U0001F600b", "\x00", "é漢字", "\r\n", "Ω ", "abc", ">", "ÿ"]
    rows = [(k, "".join(pieces[(k * 7 + j * (k % 5 + 1)) % len(pieces)] for j in range(k % 9))) for k in range(400)]
    rows += [(1000 + k, "<" * k) for k in range(40)] + [(2000 + k, "<P<S<M" * k + "<S") for k in range(40)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(r["form"] == "plain" for r in got if any(x in r["back"] for x in ("<P>", "<S>", "<M>")))


def test_slices_hold_every_text_once():
    texts = pa.array([b"x" * n for n in (3, 0, 10, 4, 4, 4, 50, 1)])
    found = list(byte_slices(texts, 8))
    assert [s for s, _ in found] == [0, *[s + n for s, n in found]][:-1] and sum(n for _, n in found) == len(texts)
    assert all(n == 1 or sum(len(x.as_py()) for x in texts.slice(s, n)) <= 8 for s, n in found)
    assert list(byte_slices(pa.array([], pa.binary()), 8)) == []


def test_kept_columns(spark, odd):
    rows = fill_middle.fill_in_middle(odd, keep=("source", "group"))
    assert rows.columns == ["doc_id", "n_units", "form", "prefix_chars", "middle_chars", "output", "source", "group"]
    assert Counter((r["doc_id"], r["source"], r["group"]) for r in rows.collect()) == \
        Counter((r["doc_id"], r["source"], r["group"]) for r in odd.collect())
    with pytest.raises(ValueError, match="form"):
        fill_middle.fill_in_middle(odd.withColumn("form", F.lit(1)), keep=("form",))


def test_query_digests(spark):
    rows = op12_fill_in_middle(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == \
        {i: (*(b := brute(i, t))[:4], sha(b[4]), sha(t)) for i, t in docs.items()}
