"""Periodic runs of words against a search over every period, and the query against the same search."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from feedmine.llm import word_runs
from feedmine.llm.queries import op11_word_runs

SF = "/root/testdata/sf0.001"


def brute_runs(words, least=12):
    """Every period, every stretch of equal words that far apart; the least period of a stretch counts."""
    found, n = {}, len(words)
    codes = {w: k for k, w in enumerate(dict.fromkeys(words))}
    x = np.array([codes[w] for w in words], np.int64)
    for q in range(1, n // 2 + 1):
        equal = np.concatenate([[0], x[q:] == x[:-q], [0]]).astype(int)
        edges = np.flatnonzero(np.diff(equal))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s + q >= max(least, 2 * q) and not any((s, e + q - s) == (a, b) for a, b, _ in found):
                # A stretch of a multiple of its least period was found before, with that period.
                found[s, e - s + q, q] = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def brute_lyndon(x):
    return [next((j - i for j in range(i + 1, len(x)) if x[j:] <= x[i:]), len(x) - i) for i in range(len(x))]


def made_texts(rng):
    texts = []
    for _ in range(rng.randint(1, 6)):
        n = rng.choice([0, 1, 2, 5, 20, 60])
        x = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(n)]
        if n and rng.random() < 0.4:
            x = (x[:rng.randint(1, 6)] * n)[:n]
            x[rng.randrange(n)] = rng.randrange(5)
        texts.append(x)
    return texts


def flat(texts):
    return np.array(sum(texts, []), np.int32), np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])


def test_lyndon_arrays_under_both_orders():
    rng = random.Random(3)
    for _ in range(200):
        texts = [x for x in made_texts(rng) if x] or [[0]]
        up, down = word_runs.lyndon_arrays(*flat(texts))
        assert up.tolist() == sum((brute_lyndon(x) for x in texts), [])
        assert down.tolist() == sum((brute_lyndon([-c for c in x]) for x in texts), [])


@pytest.mark.parametrize("least", [2, 12])
def test_runs_of_many_texts(least):
    rng = random.Random(least)
    fibonacci = [0]
    other = [0, 1]
    for _ in range(8):
        fibonacci, other = other, other + fibonacci
    for k in range(300):
        texts = [*made_texts(rng), *([other, [0] * 50, [0, 1] * 30 + [0]] if k == 0 else [])]
        got = np.stack(word_runs.runs_of(*flat(texts), least)).T.tolist()
        assert got == [[t, *r] for t, x in enumerate(texts) for r in brute_runs(x, least)]


def test_a_hash_that_goes_too_far(monkeypatch):
    """With hashes that say nothing every extension is too long; the words still decide."""
    monkeypatch.setattr(word_runs, "prefix_hashes", lambda codes: (np.zeros(len(codes) + 1, np.int64), np.ones(len(codes) + 1, np.int64)))
    rng = random.Random(9)
    for _ in range(60):
        texts = made_texts(rng)
        got = np.stack(word_runs.runs_of(*flat(texts), 3)).T.tolist()
        assert got == [[t, *r] for t, x in enumerate(texts) for r in brute_runs(x, 3)]


def words_in(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("table", ["odd", "documents", "empty"])
@pytest.mark.parametrize("slice_bytes", [1, 10 << 20])
def test_operator(table, slice_bytes, request, monkeypatch):
    docs = request.getfixturevalue(table)
    monkeypatch.setattr(word_runs, "SLICE_BYTES", slice_bytes)
    want = Counter()
    for r in docs.collect():
        words = words_in(r["text"])
        # The very long random texts hold no run: their brute force is left to shorter periods.
        runs = brute_runs(words) if len(words) < 20_000 else [x for x in brute_runs(words[:5000])]
        want[r["doc_id"], len(words), tuple(runs), collapsed(words, runs)] += 1
    got = Counter((r["doc_id"], r["n_words"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]), r["collapsed"])
                  for r in word_runs.word_runs(docs).collect())
    assert got == want


def test_long_periodic_text(spark):
    words = [f"w{k * k % 97}" for k in range(3000)]
    texts = [" ".join(words[:700] * 5 + ["end"]), "a " * 30_000, " ".join(["a", "b"] * 9_000 + ["b", "a"] * 9_000)]
    got = {r["doc_id"]: r for r in word_runs.word_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 30_000, 1)] and got[1]["collapsed"] == "a"
    assert (0, 18_001, 2) in [tuple(x) for x in got[2]["runs"]] or (0, 18_000, 2) in [tuple(x) for x in got[2]["runs"]]
    assert [tuple(x) for x in got[0]["runs"]] == brute_runs(words_in(texts[0]))


def test_query(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words, h = words_in(r["text"]), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[r["doc_id"]] = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                             sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(collapsed(words, runs)))
    got = {r["doc_id"]: tuple(r)[1:] for r in op11_word_runs(spark, SF).collect()}
    assert got == want and sum(v[0] for v in want.values()) > len(want) // 20
