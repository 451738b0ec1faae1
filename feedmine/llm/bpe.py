"""Byte-level BPE with numpy: merge rounds over the symbols of many words at once.

The tokenizer file gives the vocabulary, the ranked merges and the added tokens. A text is cut
at its added tokens, then by the split pattern into words, whose bytes are the first symbols.
The words that a batch of texts doesn't share with earlier batches are put into one flat symbol
array; in every round each word merges all places of its lowest-ranked pair. Pairs are found by
binary search of ``left * size + right`` in the sorted keys of all merges. Words without a pair
left leave the array, so a round costs only what still merges.

A merge's result only takes part in later merges, so merging all places of a word's lowest pair
in one round, from the left, gives what one merge at a time gives. A word of very many symbols
would need as many rounds as it has different pairs; such words are merged by a heap instead,
in the same order.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from feedmine.llm.common import chunks_of
from feedmine.llm.encoders import RememberedWords, WordIds, byte_letters, mark_spaces

#: Fixed value: the split pattern of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG = 4096


class BytePairs:
    """The tables of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if (model["type"], pre["type"], pre["add_prefix_space"], spec["normalizer"]) != ("BPE", "ByteLevel", False, None):
            raise ValueError("not a byte-level BPE file that keeps its text as it is")
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.first = np.array([vocab[x] for x in letters], np.int64)
        byte_of = {x: b for b, x in enumerate(letters)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that look at their neighbours are not supported")
        self.size = max([*vocab.values(), *added.values()]) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[x] for x in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.added = added
        self._added_at = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self._split = regex.compile(SPLIT)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list[np.ndarray | None] = [None] * len(words)
        short = []
        for i, word in enumerate(words):
            if len(word) > LONG:
                out[i] = self._merge_long(word)
            else:
                short.append(i)
        lengths = np.array([len(words[i]) for i in short], np.int64)
        symbols = self.first[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        owner = np.repeat(np.array(short, np.int64), lengths)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            rank, made = self._ranks(symbols[:-1], symbols[1:])
            rank = np.append(np.where(owner[1:] == owner[:-1], rank, len(self.keys)), len(self.keys))
            best = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.append(starts, len(symbols)))
            lowest = np.repeat(best, counts)
            finished = lowest == len(self.keys)
            if finished.any():
                ends = np.cumsum(counts)
                for s, e in zip(starts[best == len(self.keys)], ends[best == len(self.keys)], strict=True):
                    out[owner[s]] = symbols[s:e].astype("<u4")
            at = np.flatnonzero((rank == lowest) & ~finished)
            # Of places in a row ("aaa") every other one merges, from the left.
            fresh = np.r_[True, np.diff(at) > 1] if len(at) else np.zeros(0, bool)
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0)) if len(at) else at
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            symbols[at] = made[at]
            keep = ~finished
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return [np.zeros(0, "<u4") if x is None else x for x in out]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; the number of merges where there is none."""
        pair = left * self.size + right
        place = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        found = self.keys[place] == pair
        return np.where(found, self.rank[place], len(self.keys)), self.made[place]

    def _merge_long(self, word: bytes) -> np.ndarray:
        symbols = self.first[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        rank, made = self._ranks(np.array(symbols[:-1]), np.array(symbols[1:]))
        heap = [(r, i, symbols[i], symbols[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), made.tolist(), strict=True))
                if r < len(self.keys)]
        heapq.heapify(heap)
        pairs: dict[tuple[int, int], tuple[int, int]] = {}

        def push(i: int, j: int) -> None:
            key = (symbols[i], symbols[j])
            if key not in pairs:
                r, m = self._ranks(np.array(key[:1]), np.array(key[1:]))
                pairs[key] = (int(r[0]), int(m[0]))
            r, m = pairs[key]
            if r < len(self.keys):
                heapq.heappush(heap, (r, i, *key, m))

        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= len(symbols) or symbols[j] != b:
                continue
            symbols[i], symbols[j] = m, -1
            after[i] = after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
                push(i, after[j])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([s for s in symbols if s >= 0], "<u4")

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of cuts of texts, as bytes; a cut may hold several words and added tokens."""
        flat: dict[str, int] = {}
        plans: list[list[int]] = []
        for cut in words:
            plan = []
            for part in self._added_at.split(cut) if self._added_at else (cut,):
                if part in self.added:
                    plan.append(-1 - self.added[part])
                else:
                    plan.extend(flat.setdefault(w, len(flat)) for w in self._split.findall(part))
            plans.append(plan)
        ids = [x.tobytes() for x in self.merge([w.encode() for w in flat])]
        return [b"".join(ids[p] if p >= 0 else np.array([-1 - p], "<u4").tobytes() for p in plan) for plan in plans]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special ones included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> tuple[BytePairs, WordIds]:
    """The tables of a file and an encoder that remembers words, per process."""
    tables = BytePairs(path)
    return tables, WordIds(RememberedWords(tables.encode_words), mark_spaces)


def encode_texts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of every whole text, little-endian unsigned 32-bit, as binary.

    Null is the empty text, which has no ids. Repeated rows are encoded each. Other columns are
    ignored; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder = byte_pairs(tokenizer_path)
        for batch in batches:
            for start, texts in chunks_of(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(encoder.encode_each(texts), pa.binary())],
                    names=["doc_id", "ids"])
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, ids binary")


def decode_texts(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, text`` of the rows of ``encode_texts``; null ids give the empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, _ = byte_pairs(tokenizer_path)
        for batch in batches:
            texts = [tables.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])
    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text encoded and decoded again, in
    one pass that keeps neither ids nor texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, encoder = byte_pairs(tokenizer_path)
        for batch in batches:
            for start, texts in chunks_of(batch.column(1)):
                ids = encoder.encode_each(texts)
                back = [tables.decode(np.frombuffer(x, "<u4")) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                     pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_tokens long, "
                                "ids_sha256 string, decoded_sha256 string")
