"""Maximal periodic runs of words by Baier grouping, and texts without the repeats.

A run is a stretch of words with least period q, at least ``max(least, 2 * q)`` long, which no word
before or after it continues with that period. Every run holds a Lyndon word of length q (its root)
that is the longest Lyndon word at its place, in the given order of the words or in the reverse one.
So the two Lyndon arrays name all candidates: the word at i with its length.

Phase one of Baier's suffix sorter gives these arrays directly (``lyndon_arrays``). The text is a
row of blocks, at first its single words, all in groups of equal blocks, and the groups are in
order. The greatest group is taken again and again: its blocks are the longest Lyndon words at
their places, so they are done, and each joins the block before it (a block followed by k of them
takes all k). Blocks grown alike leave their group together for a new one right above it. The
groups of one text depend on each other, those of different texts don't: so the texts of a slice,
once in each order, all take their greatest group in the same round, a round being a few numpy
calls over flat arrays. Each place is done once; rounds are as many as the groups of one text.

Candidates are extended through the longest common extension to both sides (``extended``): a
comparison of one word rules out nearly all, the rest go through a binary search over prefix
hashes. Hashes never cut an extension short; each run found is compared word by word, and scanned
anew should a hash have gone too far.

A word is dropped if a run holds it after the run's first q words. Null is the empty text. Equal
rows have equal results, ids play no part. An empty table gives an empty table; texts are worked
on in slices of about ``SLICE_BYTES``, a longer one alone, in memory of some 150 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmine.llm.common import byte_slices, joined, words_of

SLICE_BYTES = 10 << 20
#: A prime under 2**31 and a multiplier of the prefix hashes.
PRIME, BASE = 2_147_483_647, 1_103_515_245


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, one after the other."""
    upto = sizes.cumsum()
    return np.arange(upto[-1]) + (starts - upto + sizes).repeat(sizes)


def stretches(opening: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each stretch opens, and its size."""
    at = opening.nonzero()[0]
    sizes = np.empty_like(at)
    sizes[:-1] = at[1:] - at[:-1]
    sizes[-1] = len(opening) - at[-1]
    return at, sizes


class Blocks:
    """The blocks of many texts, their groups and the order of the groups, as flat arrays over all places.

    A group holds consecutive slots and is known by its first one; ``place_at`` and ``slot`` lead from slots to
    places and back. ``left`` has the start of the block before (-1 for none), ``length`` that of the block.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        n = len(codes)
        self.text_end = np.repeat(ends, ends - starts)
        key = np.repeat(np.arange(len(starts)), ends - starts) * (int(codes.max(initial=0)) + 1) + codes
        self.place_at = np.argsort(key, kind="stable")
        key = key[self.place_at]
        opens = np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), key[1:] != key[:-1]]))
        sizes = np.diff(np.append(opens, n))
        self.slot = np.empty(n, np.int64)
        self.slot[self.place_at] = np.arange(n)
        self.group = np.empty(n, np.int64)
        self.group[self.place_at] = np.repeat(opens, sizes)
        self.group_end = np.zeros(n, np.int64)
        self.group_end[opens] = opens + sizes
        self.left = np.arange(-1, n - 1)
        self.left[starts] = -1
        self.length = np.ones(n, np.int64)
        self.marked = np.zeros(n, bool)

    def first_slots(self, top: np.ndarray) -> np.ndarray:
        """First slot of the group that ends before each slot of ``top``."""
        return self.group[self.place_at[top - 1]]

    def finish_single(self, start: np.ndarray) -> None:
        """Groups of one block each, no two of one text: its block joins the one before."""
        place = self.place_at[start]
        head, own = self.left[place], self.length[place]
        following = place + own
        inside = following < self.text_end[place]
        self.left[following[inside]] = head[inside]
        taken = head >= 0
        head = head[taken]
        if not len(head):
            return
        self.length[head] += own[taken]
        group, current = self.group[head], self.slot[head]
        end = self.group_end[group]
        target = end - 1
        other = self.place_at[target]
        self.place_at[current], self.slot[other] = other, current
        self.place_at[target], self.slot[head] = head, target
        self.group_end[group] = target
        self.group[head] = target
        self.group_end[target] = end

    def finish(self, start: np.ndarray, size: np.ndarray) -> None:
        """Groups of any size: equal blocks in a row join the block before the first of them together."""
        place = self.place_at[ranges(start, size)]
        place.sort()
        before = self.left[place]
        opening = np.ones(len(place), bool)
        opening[1:] = before[1:] != place[:-1]
        at, times = stretches(opening)
        last = place[at + times - 1]
        head, own = before[at], self.length[last]
        following = last + own
        inside = following < self.text_end[last]
        self.left[following[inside]] = head[inside]
        taken = head >= 0
        head, times = head[taken], times[taken]
        if len(head):
            self.length[head] += times * own[taken]
            self._raise(head, times)

    def _raise(self, head: np.ndarray, times: np.ndarray) -> None:
        """Grown blocks go to the end of their group, those that took more equal blocks last, and form groups there."""
        group = self.group[head]
        if len(head) > 1:
            order = np.lexsort((times, group))
            head, times, group = head[order], times[order], group[order]
        parts = np.ones(len(head), bool)
        parts[1:] = group[1:] != group[:-1]
        at, count = stretches(parts)
        old = group[at]
        end = self.group_end[old]
        target, current = ranges(end - count, count), self.slot[head]
        # Blocks in the way change places with those that come from further down in the same group.
        self.marked[head] = True
        there = self.place_at[target]
        pushed, free = there[~self.marked[there]], current[current < (end - count).repeat(count)]
        self.marked[head] = False
        self.place_at[free], self.slot[pushed] = pushed, free
        self.place_at[target], self.slot[head] = head, target
        # A group that moves as a whole keeps its first slot, so the old end goes first.
        self.group_end[old] = end - count
        parts[1:] |= times[1:] != times[:-1]
        at, sizes = stretches(parts)
        first = target[at]
        self.group[head] = first.repeat(sizes)
        self.group_end[first] = first + sizes


def lyndon_arrays(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the longest Lyndon word at each place, in the order of the codes and in the reverse
    one. ``bounds`` has the start of each text (none empty) and at last the number of all words."""
    n = len(codes)
    base, top = (np.concatenate([b, b + n]) for b in (bounds[:-1], bounds[1:]))
    blocks = Blocks(np.concatenate([codes, codes.max(initial=0) - codes]).astype(np.int64), base, top)
    while len(top):
        start = blocks.first_slots(top)
        size = top - start
        single = size == 1
        if single.all():
            blocks.finish_single(start)
        else:
            several = ~single
            blocks.finish(start[several], size[several])
            blocks.finish_single(start[single])
        top = start
        going = top > base
        if not going.all():
            top, base = top[going], base[going]
    return blocks.length[:n], blocks.length[n:]


def prefix_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of code times power up to each place, and the powers; both modulo ``PRIME``."""
    n = len(codes)
    power = np.ones(n + 1, np.int64)
    done, step = 1, BASE
    while done <= n:
        more = min(done, n + 1 - done)
        power[done:done + more] = power[:more] * step % PRIME
        done, step = done + more, step * step % PRIME
    sums = np.zeros(n + 1, np.int64)
    np.cumsum((codes + 1) % PRIME * power[:n] % PRIME, out=sums[1:])
    return sums, power


def extended(codes: np.ndarray, place: np.ndarray, period: np.ndarray, start: np.ndarray, end: np.ndarray,
             sums: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the words from ``place`` on, and those before it, agree with the words ``period`` later."""
    def agree(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        one = (sums[lo + size] - sums[lo]) % PRIME
        other = (sums[lo + period + size] - sums[lo + period]) % PRIME
        return one * power[period] % PRIME == other

    def furthest(most: np.ndarray, forwards: bool) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            fits = agree(place if forwards else place - middle, middle)
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low

    return furthest(end - place - period, True), furthest(place - start, False)


def runs_of(codes: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start in its text, length and period of every run, in ascending order."""
    none = np.empty(0, np.int64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if not len(full):
        return none, none, none, none
    bounds = np.append(bounds[full], bounds[-1])
    codes = codes.astype(np.int64)
    n = len(codes)
    found = []
    text_start, text_end = (b.repeat(np.diff(bounds)) for b in (bounds[:-1], bounds[1:]))
    for period in lyndon_arrays(codes, bounds):
        # One equal word at either side is the least that any run needs.
        place = np.arange(n)
        near = np.zeros(n, bool)
        right = (place + period < text_end).nonzero()[0]
        near[right] = codes[right + period[right]] == codes[right]
        before = (place > text_start).nonzero()[0]
        near[before] |= codes[before - 1] == codes[before + period[before] - 1]
        chosen = near.nonzero()[0]
        found.append(chosen * (n + 1) + period[chosen])
    place, period = np.divmod(np.unique(np.concatenate(found)), n + 1)
    del text_start, text_end
    text = np.searchsorted(bounds, place, side="right") - 1
    start, end = bounds[:-1][text], bounds[1:][text]
    sums, power = prefix_hashes(codes)
    right, before = extended(codes, place, period, start, end, sums, power)
    enough = right + before + period >= np.maximum(least, 2 * period)
    run = np.stack([text[enough], place[enough] - before[enough], (right + before + period)[enough], period[enough]])
    run = np.unique(run, axis=1)
    wrong = [k for k, (_, s, size, q) in enumerate(run.T) if not np.array_equal(codes[s:s + size - q], codes[s + q:s + size])]
    if wrong:
        run = _scanned(run, codes, bounds, place, period, text, least)
    text, start, size, period = run[:, np.lexsort((run[3], run[1], run[0]))]
    return full[text], start - bounds[:-1][text], size, period


def _scanned(run: np.ndarray, codes: np.ndarray, bounds: np.ndarray, place: np.ndarray, period: np.ndarray,
             text: np.ndarray, least: int) -> np.ndarray:
    """The runs with those of texts in which a hash went too far found word by word."""
    bad = {int(t) for t, s, size, q in run.T if not np.array_equal(codes[s:s + size - q], codes[s + q:s + size])}
    rows = [r for r in run.T.tolist() if r[0] not in bad]
    for t in bad:
        lo, hi = int(bounds[t]), int(bounds[t + 1])
        found = set()
        for i, q in zip(place[text == t].tolist(), period[text == t].tolist(), strict=True):
            s, e = i, i + q
            while s > lo and codes[s - 1] == codes[s - 1 + q]:
                s -= 1
            while e < hi and codes[e] == codes[e - q]:
                e += 1
            if e - s >= max(least, 2 * q):
                found.add((t, s, e - s, q))
        rows += sorted(found)
    return np.array(rows, np.int64).reshape(-1, 4).T


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_words``, ``runs`` (array of start, length, period in words, by
    start, then period) and ``collapsed`` (the words that stay, joined by one space). Nothing is shuffled."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, count in byte_slices(batch.column(1), SLICE_BYTES):
                words, sizes = words_of(batch.column(1).slice(start, count))
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                codes = words.dictionary_encode().indices.to_numpy()
                text, first, length, period = runs_of(codes, bounds, least)
                # Words covered by a run after its first period.
                change = np.zeros(len(codes) + 1, np.int32)
                np.add.at(change, bounds[text] + first + period, 1)
                np.add.at(change, bounds[text] + first + length, -1)
                stays = np.cumsum(change[:-1]) == 0
                kept, _ = joined(words, sizes, stays)
                found = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (first, length, period)], fields=list(entry))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=count))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, count), pa.array(sizes, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), found),
                     kept],
                    names=[id_col, "n_words", "runs", "collapsed"])

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words long, "
                                "runs array<struct<start: long, length: long, period: long>>, collapsed string")
