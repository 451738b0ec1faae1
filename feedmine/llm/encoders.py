"""Whole texts to ids with the tokenizers library, which sees each distinct word of a chunk once.

Both public vocabularies split a text into pieces before any merge, and some places are
piece borders whatever stands around them. Cutting a text there and encoding each distinct
cut once gives the ids of the whole text: the library still makes every id.

* byte-level BPE: a space before a character that is no white space starts a piece, and a
  single line break between two such characters is a piece.
* word BPE: ASCII white space ends a piece and is dropped.

White space is taken in Python's sense, which holds more characters than the library's, so a
cut is never made where the library might glue.

Most cuts are plain words: Latin letters, then perhaps punctuation. What the library does to those
before its merges is known (the letters are one piece, the punctuation is another, and both are
written in the vocabulary's letters for bytes), so thousands of them go through its BPE model in
one call. All other cuts go through the whole tokenizer.

The texts of a chunk are cut, told apart and put together again by Arrow and numpy. Nothing is
remembered from chunk to chunk, so memory depends on the chunk alone.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BEFORE_WORD = re.compile(r"(?= \S)")
_BLANKS = "\t\n\r\x0b\x0c"


def mark_spaces(text: str, mark: str) -> tuple[str, int]:
    """The text with ``mark`` at cuts for byte-level BPE, and the number of parts."""
    words, spaces, breaks = text.split(), text.count(" "), text.count("\n")
    if len(words) == spaces + breaks + 1 and sum(map(len, words)) + spaces + breaks == len(text):
        return text.replace(" ", mark + " ").replace("\n", mark + "\n" + mark), 1 + spaces + 2 * breaks
    # White space side by side, at an end, or of another kind.
    parts = _BEFORE_WORD.split(text)
    return mark.join(parts), len(parts)


def mark_blanks(text: str, mark: str) -> tuple[str, int]:
    """The text with ``mark`` for each ASCII white space, which carries no id, and the number of parts."""
    for blank in _BLANKS:
        if blank in text:
            text = text.replace(blank, " ")
    return text.replace(" ", mark), 1 + text.count(" ")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it can be printed, else
    the next unused code point from 256 on."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    unused = iter(range(256, 512))
    return [chr(b) if b in printed else chr(next(unused)) for b in range(256)]


def marks() -> Iterator[str]:
    """Characters that may stand for a cut: private ones first, then all others that are neither white space,
    at which texts are cut, nor surrogates, which can't be written."""
    private, last = range(0xE000, 0xF900), 0x110000
    rest = (c for c in chain(range(last - 2, 0xF900, -1), range(0xD7FF, -1, -1)) if not chr(c).isspace())
    return map(chr, chain(private, rest))


#: Ids of distinct words: all of them one after the other, and where each word's begin and how many they are.
Pool = tuple[np.ndarray, np.ndarray, np.ndarray]


class WordIds:
    """Ids of texts, by word. ``pool_of`` gives the ids of distinct words, ``cut`` marks the cuts of a text."""

    def __init__(self, pool_of: Callable[[pa.Array], Pool], cut: Callable[[str, str], tuple[str, int]]):
        self._pool_of, self._cut = pool_of, cut

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids end."""
        if not texts:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        mark = next(m for m in marks() if not any(m in t for t in texts))
        marked, parts = zip(*(self._cut(t, mark) for t in texts), strict=True)
        joined = pa.array([mark.join(marked)], pa.large_string())
        del marked
        coded = pc.split_pattern(joined, mark).flatten().dictionary_encode()
        del joined
        at = coded.indices.to_numpy()
        pool, first, sizes = self._pool_of(coded.dictionary)
        n = sizes[at]
        ends = np.cumsum(n)
        small = np.int32 if ends[-1] < 2 ** 31 else np.int64
        place = np.repeat((first[at] - ends + n).astype(small), n)
        place += np.arange(len(place), dtype=small)
        return pool[place], ends[np.cumsum(parts) - 1]

    def encode_each(self, texts: list[str], dtype: str = "<u4") -> list[bytes]:
        """The ids of each text as bytes of ``dtype``."""
        flat, ends = self.encode(texts)
        raw, step = flat.astype(dtype).tobytes(), np.dtype(dtype).itemsize
        stops = (ends * step).tolist()
        return [raw[s:e] for s, e in zip([0, *stops], stops, strict=False)]


class RememberedWords:
    """The pool of distinct words from a function on lists of words, each asked for once. What it holds is
    bounded: it forgets all at ``max_words`` and keeps no long words."""

    def __init__(self, encode_words: Callable[[list[str]], list[bytes]], max_words: int = 300_000, long_word: int = 16):
        self._encode, self._max, self._long = encode_words, max_words, long_word
        self._known: dict[str, bytes] = {}

    def __call__(self, words: pa.Array) -> Pool:
        if len(self._known) > self._max:
            self._known.clear()
        names = words.to_pylist()
        ids = list(map(self._known.get, names))
        gaps = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(gaps, self._encode([names[i] for i in gaps]), strict=True):
            ids[i] = x
            if len(names[i]) <= self._long:
                self._known[names[i]] = x
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes, sizes


#: What a file must say for its plain words to be known, by kind: how it splits text.
_SPLITS = {
    "byte": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
    "word": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: ASCII punctuation other than apostrophes and angle brackets.
_POINTS = r"!-&(-/:;=?@\[-`{-~"
CALL_WORDS = 4_000


class LibraryWords:
    """The pool of distinct words from the tokenizers library."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers
        self._whole = Tokenizer.from_file(path)
        self._whole.no_truncation()
        self._whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]
        if kind == "word":
            split = split["pretokenizers"][0]["pattern"]["Regex"]
        if split != _SPLITS[kind]:
            raise ValueError(f"{path} doesn't split text as a {kind} vocabulary does")
        model, self._lower = spec["model"], kind == "word"
        suffix = model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        more = {"end_of_word_suffix": suffix} if suffix else {}
        # Every word comes once, so the model's own memory of words would only cost time.
        self._model = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **more))
        self._model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self._covers = np.zeros(max(model["vocab"].values()) + 1, np.int64)
        for token, i in model["vocab"].items():
            self._covers[i] = len(token) - (len(suffix) if suffix and token.endswith(suffix) else 0)
        self._letters = {b: x for b, x in enumerate(byte_letters()) if x != chr(b) and b != 10}
        self._plain = f"^ ?[{_LATIN}]+[{_POINTS}]*$"
        self._border = f"([{_LATIN}])([{_POINTS}])"

    def __call__(self, words: pa.Array) -> Pool:
        sizes, first = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        plain = pc.match_substring_regex(words, self._plain).to_numpy(zero_copy_only=False)
        ascii_ = pc.equal(pc.binary_length(words), pc.utf8_length(words)).to_numpy(zero_copy_only=False)
        pools, done = [], 0
        for chosen, encode in ((plain & ascii_, self._encode_plain), (plain & ~ascii_, self._encode_plain), (~plain, self._encode_other)):
            at = np.flatnonzero(chosen)
            for i in range(0, len(at), CALL_WORDS):
                some = at[i:i + CALL_WORDS]
                ids, n = encode(words.take(pa.array(some)))
                sizes[some], first[some] = n, done + np.cumsum(n) - n
                pools.append(ids)
                done += len(ids)
        return np.concatenate(pools) if pools else np.zeros(0, "<u4"), first, sizes

    def _encode_plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lines = pc.replace_substring_regex(words, self._border, "\\1\n\\2", max_replacements=1)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(lines)], lines.cast(pa.string())), "\n")[0].as_py()
        if self._lower:
            joined = joined.lower()
        if joined.isascii():
            joined = joined.replace(" ", self._letters[32])
        else:
            joined = joined.encode().decode("latin-1").translate(self._letters)
        ids = np.array(self._model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        # The letters that each id covers tell where a word's ids end; every Latin-1 letter is two
        # bytes in either case.
        covered, ends = np.cumsum(self._covers[ids]), np.cumsum(pc.binary_length(words).to_numpy())
        last = np.searchsorted(covered, ends)
        if not np.array_equal(covered[last], ends):
            raise RuntimeError("the ids don't cover the words")
        return ids, np.diff(last + 1, prepend=0)

    def _encode_other(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, "<u4") for e in self._whole.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))


@lru_cache(maxsize=4)
def library_ids(path: str, kind: str) -> WordIds:
    """A per-process encoder for the tokenizer file ``path``; ``kind`` is ``byte`` or ``word``."""
    return WordIds(LibraryWords(path, kind), {"byte": mark_spaces, "word": mark_blanks}[kind])
