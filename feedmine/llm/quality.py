"""Quality rules: document statistics, two fixed base rules, and boosted trees trained on labels.

A document fails the base rules if it has fewer than ``MIN_WORDS`` words or if more than
``MAX_REPEAT`` percent of its words stand in repeated windows of eight words. What passes is scored
by gradient-boosted trees over the statistics; the score may only fall with more symbols, more
repeated words or lines, more upper case and more exclamation marks. The trees are trained on a
sample of labelled documents of at most ``SAMPLE_ROWS`` (the ones of least hash of their id). Each of
them that passes takes part: equal texts under one id count once, and all its different texts do, unless
there are more than ``2 * SAMPLE_ROWS`` in all; then as many are taken evenly by document, by their hash.
The statistics and verdicts cover every document.

Null and empty texts have no words and fail the base rules. Without usable labels, or with labels of
one class, the trees keep every document that passes the base rules. Repeated rows are judged each,
alike. Labels without a document, documents without label, null labels and null ids take no
part in training; a document labelled more than once counts with its least label.

An empty table gives an empty table; a long text is measured whole, one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmine.llm.common import materialize
from feedmine.llm.gbt import Forest, train

WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 30
#: At most so many labelled documents train the trees.
SAMPLE_ROWS = 20_000
#: A document is rejected below this probability of being good.
LEAST_SCORE = 0.5
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
BLANK = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "exclaims", "points",
            "distinct", "line_words", "non_ascii", "longest")
#: What may only lower the score.
FALLING = ("symbols", "dup_lines", "repeats", "upper", "exclaims")


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """How many words stand in windows of eight that occur twice or more, and how many differ."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    n = len(words) - WINDOW + 1
    if n < 2 or len(number) == len(words):
        return 0, len(number)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[k:k + n]
    in_order = np.sort(h)
    if not (in_order[1:] == in_order[:-1]).any():
        return 0, len(number)
    # Some windows share a hash: number them exactly, pairs of pairs of pairs.
    span = ids
    for k in (1, 2, 4):
        span = np.unique(span[:-k] * (int(span.max()) + 1) + span[k:], return_inverse=True)[1]
    found = np.flatnonzero(np.bincount(span)[span] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[found] += 1
    edge[found + WINDOW] -= 1
    return int((edge.cumsum() > 0).sum()), len(number)


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five counts and the features of a text."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0] * len(COUNTS), [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(words)
    chars = int(len(data) - seen[0x80:0xC0].sum() - seen[BLANK].sum())
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    dup = len(lines) - len(set(lines))
    repeats, distinct = repeated_words(words)
    symbols = int(seen[SYMBOLS].sum())
    non_ascii = int(seen[0xC0:].sum())
    counts = [n, chars, symbols, dup, repeats]
    return counts, [np.log1p(n), chars / n, symbols / n, dup / len(lines), repeats / n, int(seen[65:91].sum()) / chars,
                    int(seen[48:58].sum()) / chars, int(seen[33]) / n, int(seen[[44, 46, 58, 59]].sum()) / n, distinct / n,
                    n / len(lines), non_ascii / chars, np.log1p(max(map(len, words)))]


def base_failed(counts: np.ndarray) -> np.ndarray:
    n_words, repeats = counts[:, 0], counts[:, 4]
    return (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT * n_words)


def passes_trees(forest: Forest, score: np.ndarray, least_score: float) -> np.ndarray:
    """A forest without trees, from labels of one class or none, rejects nothing whatever the bound."""
    return (score >= least_score) | (len(forest.roots) == 0)


def _batch_statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    rows = [statistics(t.as_py()) for t in column]
    return (np.array([r[0] for r in rows], np.int64).reshape(-1, len(COUNTS)),
            np.array([r[1] for r in rows], float).reshape(-1, len(FEATURES)))


def train_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Forest:
    """The trees, trained on the driver from at most ``2 * sample_rows`` rows of statistics."""
    chosen = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
              .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(sample_rows))
    # At most sample_rows rows.
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .join(F.broadcast(chosen), "id").select("text", "label", "id", F.xxhash64("text").alias("text_hash")))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, features = _batch_statistics(batch.column(0))
            passed = ~base_failed(counts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).filter(pa.array(passed)) for k in (1, 2, 3)), *(pa.array(f[passed]) for f in features.T)],
                names=["label", "id", "text_hash", *FEATURES])

    measured = rows.mapInArrow(measure, ", ".join(["label int, id long, text_hash long", *(f"{f} double" for f in FEATURES)]))
    measured = materialize(measured.dropDuplicates(["id", "text_hash"]))
    # At most sample_rows rows. The row of least hash of each document comes first; the n rows of a document then
    # lie evenly over 0 to n, so below any limit all documents have equally many, or all they have.
    each = measured.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("text_hash").alias("least"))
    place = F.when(F.col("text_hash") == F.col("least"), F.lit(-1.0)).otherwise(
        F.col("n") * (F.xxhash64("text_hash", "id") / F.lit(2.0 ** 64) + 0.5))
    table = (measured.join(F.broadcast(each), "id").orderBy(place, "text_hash", "id").limit(2 * sample_rows)
             .select("label", *FEATURES).toPandas().sort_values(["label", *FEATURES]))
    x, y = table[list(FEATURES)].to_numpy(float), (table["label"].to_numpy() > 0).astype(float)
    return train(x, y, {FEATURES.index(f): -1 for f in FALLING})


def judge(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text",
          least_score: float = LEAST_SCORE) -> DataFrame:
    """``doc_id``, the five counts, ``base_failed``, ``score`` and ``kept`` for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, features = _batch_statistics(batch.column(1))
            failed, score = base_failed(counts), forest.score(features)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score),
                 pa.array(~failed & passes_trees(forest, score, least_score))],
                names=["doc_id", *COUNTS, "base_failed", "score", "kept"])

    return rows.mapInArrow(run, ", ".join([f"doc_id {rows.schema[0].dataType.simpleString()}", *(f"{c} long" for c in COUNTS),
                                           "base_failed boolean, score double, kept boolean"]))


def keep_good(docs: DataFrame, forest: Forest, text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are, in one pass without a shuffle."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, features = _batch_statistics(batch.column(place))
            yield batch.filter(pa.array(~base_failed(counts) & passes_trees(forest, forest.score(features), least_score)))

    return docs.mapInArrow(run, docs.schema)
