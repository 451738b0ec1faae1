"""Secret scans with a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived: whatever the regex matches
contains, in lower case, all trigrams of at least one alternative of each of its mandatory
strings. For a block of documents an inverted index maps the trigrams that any query names to the
documents that hold them. Postings are joined (OR) and intersected (AND) as the query says, and the
regex itself runs only over the candidates. A rule without a mandatory trigram runs over every
document of the block.

Positions are code points, the end is exclusive. Matches of a rule don't overlap; those of
different rules may. Null and empty texts have no spans. Repeated rows are scanned each.

An empty table gives an empty table; a long text is searched whole, one text at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product
from re import _constants as op
from re import _parser as regex_parser

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmine.llm.common import chunks_of


@dataclass(frozen=True)
class Rule:
    """A match counts if the group ``group`` of it has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    @property
    def flags(self) -> int:
        return re.ASCII | (re.IGNORECASE if self.any_case else 0)


#: The rules every scan has, in the order in which ties are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
MORE_RULES = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"://[A-Za-z0-9._-]+:[^\s:/@]{6,}@[A-Za-z0-9.-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----)?"),
)
RULES = BASE_RULES + MORE_RULES
MAX_STRINGS = 64
#: Texts of about so many characters share an index.
BLOCK_CHARS = 2_000_000
MASK = "[REDACTED]"

#: A query: every element must hold; an element is a set of alternatives, each a set of trigrams.
Query = list[frozenset[frozenset[str]]]


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


def _demand(strings: set[str], query: Query) -> None:
    """One of ``strings`` stands in every match; says nothing if one of them has no trigram."""
    options = {_grams(s) for s in strings}
    if frozenset() not in options:
        query.append(frozenset(o for o in options if not any(p < o for p in options)))


def _strings(item, any_case: bool) -> set[str] | None:
    """All strings of a part of a regex in lower case, or None if they are too many or unbounded."""
    code, arg = item
    if code is op.LITERAL:
        return {chr(arg).lower()}
    if code is op.AT:
        return {""}
    if code is op.IN and all(c is op.LITERAL for c, _ in arg) and len(arg) <= 8:
        return {chr(a).lower() for _, a in arg}
    if code is op.SUBPATTERN:
        return _all_strings(arg[-1], any_case)
    if code is op.BRANCH:
        parts = [_all_strings(p, any_case) for p in arg[1]]
        return None if None in parts else _few(set().union(*parts))
    if code in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[1] <= 4 and (inner := _all_strings(arg[2], any_case)) is not None:
        return _few({"".join(p) for n in range(arg[0], int(arg[1]) + 1) for p in product(inner, repeat=n)})
    return None


def _few(strings: set[str]) -> set[str] | None:
    return strings if len(strings) <= MAX_STRINGS else None


def _all_strings(sequence, any_case: bool) -> set[str] | None:
    strings = {""}
    for item in sequence:
        more = _strings(item, any_case)
        strings = None if more is None else _few({a + b for a in strings for b in more})
        if strings is None:
            return None
    return strings


def _require(sequence, any_case: bool, query: Query) -> None:
    """Add to ``query`` what every match of this sequence of regex parts contains."""
    run = {""}
    for item in sequence:
        more = _strings(item, any_case)
        joined = _few({a + b for a in run for b in more}) if more is not None else None
        if joined is not None:
            run = joined
            continue
        _demand(run, query)
        run = more if more is not None else {""}
        code, arg = item
        if more is None and code is op.SUBPATTERN:
            _require(arg[-1], any_case, query)
        elif more is None and code in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] >= 1:
            _require(arg[2], any_case, query)
        elif more is None and code is op.BRANCH:
            _either(arg[1], any_case, query)
    _demand(run, query)


def _either(branches, any_case: bool, query: Query) -> None:
    """One branch matches: its demands, each branch's multiplied out to alternatives."""
    options: set[frozenset[str]] = set()
    for branch in branches:
        own: Query = []
        _require(branch, any_case, own)
        multiplied = {frozenset().union(*p) for p in product(*own)} if own else {frozenset()}
        if frozenset() in multiplied or len(options) + len(multiplied) > MAX_STRINGS:
            return
        options |= multiplied
    query.append(frozenset(options))


def trigram_query(pattern: str, any_case: bool = False) -> Query:
    """The trigrams that every match of ``pattern`` contains, in lower case; empty: none can be said."""
    query: Query = []
    _require(regex_parser.parse(pattern, re.ASCII), any_case, query)
    return query


class Scanner:
    """Compiled rules with their queries."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.compiled = [re.compile(r.pattern, r.flags) for r in rules]
        self.queries = [trigram_query(r.pattern, r.any_case) for r in rules]
        grams = sorted({g for q in self.queries for element in q for o in element for g in o
                        if len(g.encode()) == 3})
        self.number = {g: i for i, g in enumerate(grams)}
        self.table = np.full(1 << 24, -1, np.int16)
        for g, i in self.number.items():
            a, b, c = g.encode()
            self.table[a << 16 | b << 8 | c] = i

    def postings(self, texts: list[bytes]) -> dict[int, np.ndarray]:
        """Trigram number to the ascending numbers of the texts that hold it, for the trigrams of the queries."""
        flat = np.frombuffer(b"\0\0".join(texts).lower(), np.uint8)
        if len(flat) < 3:
            return {}
        code = flat[:-2].astype(np.uint32)
        code <<= np.uint32(8)
        code |= flat[1:-1]
        code <<= np.uint32(8)
        code |= flat[2:]
        gram = self.table[code]
        at = np.flatnonzero(gram >= 0)
        starts = np.cumsum([0] + [len(t) + 2 for t in texts[:-1]])
        pairs = np.unique(gram[at].astype(np.int64) * len(texts) + np.searchsorted(starts, at, side="right") - 1)
        cut = np.flatnonzero(np.diff(pairs // len(texts))) + 1
        return {int(p[0] // len(texts)): p % len(texts) for p in np.split(pairs, cut)} if len(pairs) else {}

    def candidates(self, query: Query, index: dict[int, np.ndarray], n: int) -> np.ndarray:
        none = np.zeros(0, np.int64)
        found = np.arange(n)
        for element in query:
            union = []
            for option in element:
                lists = [index.get(self.number[g], none) if g in self.number else np.arange(n) for g in option]
                hits = lists[0]
                for more in sorted(lists[1:], key=len):
                    hits = np.intersect1d(hits, more, assume_unique=True)
                union.append(hits)
            found = np.intersect1d(found, np.unique(np.concatenate(union)), assume_unique=True)
        return found

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of every span of each text, ascending."""
        index = self.postings([t.encode() for t in texts])
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, (rule, find, query) in enumerate(zip(self.rules, self.compiled, self.queries, strict=True)):
            where = self.candidates(query, index, len(texts)) if query else range(len(texts))
            for k in where:
                for m in find.finditer(texts[k]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        spans[k].append((m.start(), number, m.end()))
        for s in spans:
            s.sort()
        return spans


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by ``MASK``."""
    out, done = [], 0
    for start, _, end in spans:
        if start >= done:
            out += [text[done:start], MASK]
        done = max(done, end)
    return "".join([*out, text[done:]])


def listing(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans`` per row; ``spans`` is an array of (kind, start, end) in the order of the text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(rules)
        for batch in batches:
            for first, texts in chunks_of(batch.column(1), BLOCK_CHARS):
                found = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in find.scan(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(found, pa.list_(span))],
                                                 names=["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, "
                                "spans array<struct<kind: string, start: bigint, end: bigint>>")


def span_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``: counts and digest of the base rules' spans, and
    all spans as ``kind:start:end``, comma-joined."""
    found = find_secrets(docs, id_col, text_col)
    base = [r.kind for r in BASE_RULES]
    write = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *(of(k).alias(f"n_{k}") for k in base),
                        F.sha2(write(F.filter("spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
                        write(F.col("spans")).alias("spans"))


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars",
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span masked and ``length_col``, if there is such a column, set to the new number of
    code points of changed texts. Texts without spans, null ones too, stay as they are."""
    names = docs.columns
    place = names.index(text_col)
    length = names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(rules)
        for batch in batches:
            for first, texts in chunks_of(batch.column(place), BLOCK_CHARS):
                part = batch.slice(first, len(texts))
                found = find.scan(texts)
                hit = pa.array([bool(s) for s in found])
                if any(found):
                    columns = part.columns
                    fresh = [mask(t, s) if s else None for t, s in zip(texts, found, strict=True)]
                    columns[place] = pa.compute.if_else(hit, pa.array(fresh, columns[place].type), columns[place])
                    if length is not None:
                        sizes = pa.array([None if t is None else len(t) for t in fresh], columns[length].type)
                        columns[length] = pa.compute.if_else(hit, sizes, columns[length])
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield part

    return docs.mapInArrow(run, docs.schema)
