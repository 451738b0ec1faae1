"""Token counts, BPE, token files and packing against the tokenizers library and brute force."""

import hashlib
import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from feedmine.llm import bpe, packing, token_counts, token_file
from feedmine.llm.common import shared_folder

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


library = lru_cache(Tokenizer.from_file)


def ids_of(path, text):
    return np.array(library(path).encode(text or "", add_special_tokens=False).ids, "<u4")


@pytest.fixture(params=["odd", "documents", "empty", "characters"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_token_counts(docs):
    got = token_counts.length_histogram(token_counts.token_lengths(docs, BYTE, keep=("source",)), "source").collect()
    rows = docs.collect()
    lengths = [(r["source"], len(ids_of(BYTE, r["text"]))) for r in rows]
    want = {}
    for group, total in [(s, False) for s in {s for s, _ in lengths}] + [("*", True)] * bool(rows):
        own = [n for s, n in lengths if total or s == group]
        for length, docs_n in Counter(own).items():
            over = [n for n in own if n > length]
            want[group, total, length] = (docs_n, docs_n * length, len(over), sum(over), sum(min(n, length) for n in own),
                                          len(own) - len(over), (len(own) - len(over)) / len(own))
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == want and len(got) == len(want)


def test_token_counts_null_group(spark):
    df = spark.createDataFrame([(None, 3), (None, 3), ("*", 4)], "g string, length long")
    got = {tuple(r[:4]) for r in token_counts.length_histogram(df, "g").collect()}
    assert got == {(None, False, 3, 2), ("*", False, 4, 1), ("*", True, 3, 2), ("*", True, 4, 1)}


def test_bpe_round_trip(docs):
    tokenizer = Tokenizer.from_file(BYTE)
    want = Counter()
    for r in docs.collect():
        ids = ids_of(BYTE, r["text"])
        back = tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        want[r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.round_trip(docs, BYTE).collect())) == want


def test_bpe_tables(odd):
    encoded = bpe.encode_texts(odd, BYTE)
    back = Counter(map(tuple, bpe.decode_texts(encoded, BYTE).collect()))
    assert back == Counter((r["doc_id"], r["text"] or "") for r in odd.collect())


def test_bpe_long_words_and_invalid_bytes():
    tables = bpe.BytePairs(BYTE)
    tokenizer = Tokenizer.from_file(BYTE)
    for word in ("a" * 9001, "abcab" * 1500, "é" * 5000):
        for limit in (10, 10**9):
            bpe.LONG, kept = limit, bpe.LONG
            assert tables.merge([word.encode()])[0].tolist() == tokenizer.encode(word).ids
            bpe.LONG = kept
    ids = tokenizer.encode("漢字 é").ids
    for k in range(len(ids)):
        assert tables.decode(np.array(ids[k:])) == tokenizer.decode(ids[k:], skip_special_tokens=False)


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 32])
def test_packing_of_bits(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 10_007, dtype=np.uint64).astype("<u4")
    raw = np.frombuffer(token_file.pack(ids, bits), np.uint8)
    assert len(raw) == -(-len(ids) * bits // 8)
    for first, n in ((0, 10_007), (3, 1), (777, 4000), (10_006, 1), (5, 0)):
        assert token_file.unpack(raw, bits, first, n).tolist() == ids[first:first + n].tolist()
    if bits < 32:
        with pytest.raises(ValueError):
            token_file.pack(np.array([1 << bits], "<u4"), bits)


def test_token_file_random_access():
    rng = np.random.default_rng(1)
    docs = [(k if k != 4 else None, rng.integers(0, 2000, n, dtype=np.uint32)) for k, n in enumerate((0, 5, 700, 1, 64, 63, 65))]
    end = token_file.END.encode()
    content = b"".join(p + end for p in token_file.file_parts(iter(docs), 11, 3, block_ids=64))
    file = token_file.TokenFile(content)
    assert (file.range, file.bits, file.ids) == (3, 11, sum(len(d) for _, d in docs))
    assert all((file.document(k) == d).all() for k, (_, d) in enumerate(docs))
    flat = np.concatenate([d for _, d in docs])
    assert all((file.read(s, n) == flat[s:s + n]).all() for s, n in ((0, 1), (60, 10), (130, 500), (890, 8)))
    with pytest.raises(ValueError):
        token_file.TokenFile(content[:-30])


def test_token_files(spark, docs):
    folder = shared_folder(spark, "test")
    token_file.write_token_files(docs, folder, BYTE, end_id=0, vocabulary=50257, block_ids=1000)
    got = token_file.token_file_index(spark, folder).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.append(ids_of(BYTE, r["text"]), np.uint32(0)).astype("<u4")
        want[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    in_order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in in_order] == np.cumsum([0] + [r["n_tokens"] for r in in_order])[:-1].tolist()
    ids = [r["doc_id"] for r in in_order]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def brute_best_fit(lengths, capacity):
    rooms, opened = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect_left(rooms, n)
        if at == len(rooms):
            opened, room = opened + 1, capacity
        else:
            room = rooms.pop(at)
        if room > n:
            insort(rooms, room - n)
    return opened


def check_packed(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(sequences) == brute_best_fit([r["length"] for r in rows], capacity)


@pytest.mark.parametrize("capacity", [4096, 50])
def test_best_fit_packing(docs, capacity):
    got = packing.pack_documents(docs, WORD, "word", 1, capacity, with_ids=True).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.append(ids_of(WORD, r["text"]), np.uint32(1)).astype("<u4")
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s:s + capacity].tobytes()
            want[r["doc_id"], k, s, len(part) // 4, zlib.crc32(part), part] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got) == want
    check_packed(got, capacity)


def test_best_fit_equals_one_by_one():
    rng = np.random.default_rng(3)
    for capacity in (7, 64, 1000):
        for _ in range(40):
            lengths = rng.integers(1, capacity + 1, rng.integers(0, 300)).tolist() + [capacity // 2] * 30
            steps = packing.best_fit_steps(dict(Counter(lengths)), capacity)
            assert max((s[2] for s in steps), default=-1) < brute_best_fit(lengths, capacity)


def test_pack_keeps_columns_and_refuses_bad_lengths(spark):
    df = spark.createDataFrame([(1, 0, 3, "x"), (1, 0, 3, "x"), (None, 1, 4, None)], "doc_id long, piece int, length int, sequence_id string")
    got = packing.pack(df, 10)
    assert got.columns == ["doc_id", "piece", "length", "sequence_id", "offset"]
    check_packed(got.collect(), 10)
    for bad in (0, 11, None):
        with pytest.raises(Exception, match="no piece length"):
            packing.pack(spark.createDataFrame([(1, 0, bad)], "doc_id long, piece int, length int"), 10)
