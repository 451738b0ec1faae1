"""Repeated passages against a search over all windows in Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from feedmine.llm import substring_dedup
from feedmine.llm.common import id_key


def words_in(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, window=20):
    """rows in order: (doc_id, text). What stays of each, and the stretches that go."""
    seen, out = set(), []
    for doc_id, text in rows:
        words = words_in(text)
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            if key in seen:
                gone[i:i + window] = [True] * window
            seen.add(key)
        flags = "".join("x" if g else "." for g in gone)
        spans = tuple((m.start(), len(m[0])) for m in re.finditer("x+", flags))
        out.append((doc_id, len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g), spans))
    return Counter(out)


def in_order(spark, docs):
    """The documented order: ascending id, null ids first, equal ids by the hash of the text."""
    rows = docs.selectExpr("doc_id", "coalesce(text, '') AS text").withColumn("key", id_key("doc_id", "text"))
    return [(r["doc_id"], r["text"]) for r in rows.selectExpr("*", "xxhash64(text) AS tie").orderBy("key", "tie").collect()]


def shown(rows):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"], tuple((x["start"], x["length"]) for x in r["repeats"])) for r in rows)


@pytest.mark.parametrize("table", ["odd", "documents", "empty"])
def test_equals_brute_force(spark, table, request):
    docs = request.getfixturevalue(table)
    assert shown(substring_dedup.without_repeats(docs).collect()) == brute(in_order(spark, docs))


def passages(rng):
    """Documents of a small vocabulary that share passages with other surroundings, repeats within them, and copies."""
    words = [f"w{k}" for k in range(40)]
    shared = [[rng.choice(words) for _ in range(rng.randint(4, 60))] for _ in range(6)]
    texts = []
    for _ in range(rng.randint(2, 60)):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += rng.choice(shared) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.1:
                text += ["again"] * rng.randint(1, 45)
        texts.append(text)
    texts += [list(t) for t in rng.choices(texts, k=3)]
    for t in rng.choices(texts, k=3):
        if t:
            t[rng.randrange(len(t))] = "edit"
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("least", [1, 20])
@pytest.mark.parametrize("shape", [(20, 6), (8, 3), (5, 5), (12, 1)])
def test_shared_passages(spark, monkeypatch, least, shape):
    """With ``least`` 1 nearly every anchor counts as hot, so that all goes by salts."""
    rng = random.Random(shape[0] * 100 + least)
    monkeypatch.setattr(substring_dedup, "LEAST_SAMPLED", least)
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", rng.choice([50, 8 << 20]))
    if least == 1:
        monkeypatch.setattr(substring_dedup, "hot_anchors", lambda docs, *a: np.array(
            [r["anchor"] for r in substring_dedup.cells_of(docs, *a, np.empty(0, np.uint64)).select("anchor").distinct().collect()],
            np.int64).view(np.uint64))
    texts = passages(rng)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = substring_dedup.without_repeats(docs, window=shape[0], seed_words=shape[1])
    assert shown(got.collect()) == brute(list(enumerate(texts)), shape[0])


def test_one_id_holds_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "COPIES", 7)
    rng = random.Random(8)
    copy = " ".join(rng.choice("abcdefgh") for _ in range(50))
    rows = [(7, copy)] * 40 + [(7, "short text")] * 20 + [(None, copy + " x")] * 3 + [(k, f"{k} " + copy) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(6)
    got = substring_dedup.without_repeats(docs)
    assert got.schema["doc_id"].dataType.simpleString() == "int"
    assert shown(got.collect()) == brute(in_order(spark, docs))


def test_hot_anchors(spark):
    rng = random.Random(4)
    line = " ".join(f"l{k}" for k in range(22))
    texts = [" ".join(rng.choice([f"v{k}" for k in range(3000)]) for _ in range(40)) + (" " + line if i % 3 == 0 else "") for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    once, repeated = substring_dedup.taken_once(docs, "doc_id", "text")
    hot = substring_dedup.hot_anchors(once, 20, 6)
    assert 0 < len(hot) <= 20 and not repeated
    counts = {r["anchor"] % 2 ** 64: r["count"] for r in substring_dedup.cells_of(once, 20, 6, hot).groupBy("anchor").count().collect()}
    assert all(counts[int(h)] >= 20 for h in hot)
    assert shown(substring_dedup.without_repeats(docs).collect()) == brute(list(enumerate(texts)))


def test_cells_hold_every_window_once():
    rng = np.random.default_rng(1)
    for _ in range(100):
        sizes = rng.integers(0, 60, rng.integers(1, 6))
        hashes = rng.integers(0, 30, sizes.sum()).astype(np.uint64)
        first, windows, anchors = substring_dedup.window_cells(hashes, sizes, 20, 6)
        got = sorted(int(f) + k for f, n in zip(first, windows, strict=True) for k in range(n))
        starts = np.cumsum(sizes) - sizes
        assert got == [int(s) + k for s, n in zip(starts, sizes, strict=True) for k in range(max(0, n - 19))]
        assert len(windows) == 0 or windows.max() <= 15


def test_texts_are_shuffled_once(spark, documents):
    """Both steps that need whole texts read the same exchange."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = substring_dedup.without_repeats(documents)
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("FileScan parquet") == 2 and "ReusedExchange [key" in plan
