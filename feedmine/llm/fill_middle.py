"""Fill-in-the-middle rewriting of whole texts as a pipeline of Arrow kernels.

A text is a row of units: runs of ASCII letters and single other characters. It is cut after two
numbers of units into prefix, middle and suffix, and written anew in one of three forms:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* ``plain``: the text as it is, for ``plain_percent`` of the documents and for every text that is
  empty or holds a sentinel itself (its output couldn't be told apart).

Form and cuts follow from the SHA-256 of a seed and the document's id, so they don't depend on
partitions or repeated runs. Per batch: the texts are split into lists of units, the lists are
flattened with the number of their row, each unit gets its ordinal in its row and from that
its role, the units of a role are filtered out, put into lists again and joined, and the pieces are
joined in the order of the form. All of it runs on bytes, where 0xFF separates units: no UTF-8 text
holds it, and no character is ever cut.

A null text is the empty text. Rows with a null id are seeded as if their id had no digits. Repeated
rows give repeated results, equal ids with other texts have equal seeds. A batch is worked
on in slices of ``SLICE_BYTES``; a longer text is a slice of its own. An empty table gives an
empty table. Columns named in ``keep`` are passed on as they are; all others don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedmine.llm.common import byte_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A run of letters, another ASCII character, or the bytes of one other character.
UNIT = rb"[A-Za-z]+|[\x00-\x40\x5B-\x60\x7B-\x7F]|[\xC0-\xFF][\x80-\xBF]*"
MARK = b"\xff"
SLICE_BYTES = 4 << 20

_OUT = {"n_units": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(),
        "output": pa.string()}


def seeds(id_col: str, seed: str) -> list[Column]:
    """The first four groups of eight hexadecimal digits of the SHA-256 of seed, colon and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def rest(a: pa.Array, b: pa.Array) -> pa.Array:
    """a modulo b of numbers that aren't negative."""
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def joined_by_row(units: pa.Array, rows: pa.Array, chosen: pa.Array, n_rows: int) -> pa.Array:
    """The chosen units of each row as one binary value; rows without any give the empty value."""
    sizes = np.bincount(pc.filter(rows, chosen).to_numpy(), minlength=n_rows)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, pc.filter(units, chosen)), b"")


def rewrite(texts: pa.Array, h: list[pa.Array], plain_percent: int, spm_percent: int) -> list[pa.Array]:
    """The columns of ``_OUT`` for a slice of texts (binary, no nulls) and their seeds."""
    n_rows = len(texts)
    marked = pc.replace_substring_regex(texts, pattern=UNIT, replacement=rb"\0" + MARK)
    lists = pc.split_pattern(marked, pattern=MARK)
    # The mark stands after every unit, so each list ends with an empty value that is no unit.
    ends = lists.offsets.to_numpy().astype(np.int64)
    n = np.diff(ends) - 1
    units, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    ordinal = pa.array(np.arange(len(rows)) - (ends[:-1] - ends[0])[rows.to_numpy()])
    n_units = pa.array(n)
    places = pc.add(n_units, 1)
    one, other = rest(h[0], places), rest(h[1], places)
    first, second = pc.min_element_wise(one, other), pc.max_element_wise(one, other)

    before = pc.less(ordinal, pc.take(first, rows))
    after = pc.greater_equal(ordinal, pc.take(second, rows))
    between = pc.invert(pc.or_(before, after))
    prefix, middle, suffix = (joined_by_row(units, rows, role, n_rows) for role in (before, between, after))

    holds = pc.equal(n_units, 0)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        holds = pc.or_(holds, pc.match_substring(texts, pattern=sentinel.encode()))
    plain = pc.or_(holds, pc.greater_equal(rest(h[2], pa.scalar(100)), 100 - plain_percent))
    spm = pc.less(rest(h[3], pa.scalar(100)), spm_percent)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    p, s, m = (pa.scalar(x.encode()) for x in (PREFIX, SUFFIX, MIDDLE))
    psm_text = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, b"")
    spm_text = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, b"")
    output = pc.if_else(plain, texts, pc.if_else(spm, spm_text, psm_text))
    none = pa.scalar(None, pa.int64())
    prefix_chars, middle_chars = (pc.if_else(plain, none, pc.cast(pc.utf8_length(pc.cast(x, pa.large_string())), pa.int64()))
                                  for x in (prefix, middle))
    return [n_units, form, prefix_chars, middle_chars, pc.cast(output, pa.string())]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
                   seed: str = "1", plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_units``, ``form``, ``prefix_chars`` and ``middle_chars`` (code points,
    null if plain), ``output`` (the text written anew), then the columns of ``keep``. Nothing is shuffled."""
    if clash := {id_col, *_OUT, *(f"_h{k}" for k in range(4)), "_text"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} can't be kept beside the results")
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"),
                       *(h.alias(f"_h{k}") for k, h in enumerate(seeds(id_col, seed))), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, size in byte_slices(batch.column(1), SLICE_BYTES):
                part = batch.slice(start, size)
                # Sliced Arrow buffers may be shared with the rest of the batch; take copies the slice alone.
                texts = part.column(1).take(pa.array(np.arange(size)))
                out = rewrite(texts, [part.column(2 + k) for k in range(4)], plain_percent, spm_percent)
                yield pa.RecordBatch.from_arrays([part.column(0), *out, *part.columns[6:]], names=names)

    numbers = [T.StructField(n, T.StringType() if t == pa.string() else T.LongType()) for n, t in _OUT.items()]
    schema = T.StructType([rows.schema[0], *numbers, *rows.schema[6:]])
    names = schema.names
    return rows.mapInArrow(run, schema)


def _around(text: Column, sentinel: str) -> tuple[Column, Column]:
    """What stands before and after the first occurrence of a sentinel."""
    before = F.substring_index(text, sentinel, 1)
    return before, F.substr(text, F.length(before) + 1 + len(sentinel))


def restored(output: Column, form: Column) -> Column:
    """The exact text from output and form alone, with Spark's own functions.

    No piece holds a sentinel, and none can arise where two pieces meet: sentinels begin with ``<``,
    which stands nowhere else in them. So the first occurrence of each is its own.
    """
    head, middle = _around(output, MIDDLE)
    to_suffix, suffix_last = _around(head, SUFFIX)
    to_prefix, prefix_last = _around(head, PREFIX)
    return (F.when(form == "psm", F.concat(F.substr(to_suffix, F.lit(1 + len(PREFIX))), middle, suffix_last))
            .when(form == "spm", F.concat(prefix_last, middle, F.substr(to_prefix, F.lit(1 + len(SUFFIX)))))
            .otherwise(output))
