"""Roll-ups of the notes: Markdown report (A5), checklist bands (D3), near-duplicate
merge (D4), run counters (D5), synthesis prompts (H16) and chunk-and-merge
synthesis (J3).

The report is produced as ordered text blocks, one per PR (bounded by the
feedback cap), plus one header block per repo; a global sort on (repo order, PR
order) and a text sink give the document without any task holding a whole repo.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedmine.operators import model as md
from feedmine.operators.joins import fits_broadcast, join_small
from feedmine.operators.ordering import assign_batches
from feedmine.schemas import ANALYSIS_MAX_ATTEMPTS, REPORT_HEADER, SYNTHESIS_CHUNK_SIZE
from feedmine.session import checkpoint_dir, materialize


# ---- A5 --------------------------------------------------------------------------------
def note_line() -> Column:
    """One report entry (ends with a newline, as in the reference)."""
    return F.concat(
        F.lit("- **["), F.col("category"), F.lit(" / "), F.col("severity"), F.lit("]** "),
        F.coalesce(F.nullif(F.col("file_path"), F.lit("")), F.lit("(general)")),
        F.lit("\n  - Original: "), F.coalesce("original_issue", F.lit("")),
        F.lit("\n  - Requested: "), F.coalesce("requested_change", F.lit("")),
        F.lit("\n  - Why: "), F.coalesce("rationale", F.lit("")), F.lit("\n"))


def report_blocks(notes: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """PR blocks of the report: (repo, pr_number, repo_ord, pr_ord, block).

    Repos and PRs appear in first-appearance order of the notes; a PR block is its
    header (title of the PR's first note), its entries, and a trailing empty line.
    """
    per_pr = notes.groupBy("repo", "pr_number").agg(
        F.min(ordinal).alias("pr_ord"),
        F.min_by("pr_title", ordinal).alias("_title"),
        F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), note_line().alias("t")))).alias("_n"))
    repo_ord = notes.groupBy("repo").agg(F.min(ordinal).alias("repo_ord"))
    block = F.array_join(F.concat(
        F.array(F.concat(F.lit("### PR #"), F.col("pr_number").cast("string"), F.lit(": "),
                         F.coalesce("_title", F.lit("")), F.lit("\n"))),
        F.transform("_n", lambda x: x["t"]), F.array(F.lit(""))), "\n")
    return join_small(per_pr, repo_ord, ["repo"], "inner", salt_col="pr_number").select("repo", "pr_number", "repo_ord", "pr_ord", block.alias("block"))


def notes_report(notes: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The whole report as ordered text rows (text, sort keys). Concatenating the
    ``text`` column in key order with newlines gives the reference's document."""
    blocks = report_blocks(notes, ordinal)
    heads = blocks.groupBy("repo", "repo_ord").agg(F.lit(-1).cast("long").alias("pr_ord")).select(
        "repo_ord", "pr_ord", F.concat(F.lit("## "), F.col("repo"), F.lit("\n")).alias("text"))
    body = blocks.select("repo_ord", "pr_ord", F.col("block").alias("text"))
    spark = notes.sparkSession
    top = spark.range(1).select(F.lit(-1).cast("long").alias("repo_ord"), F.lit(-1).cast("long").alias("pr_ord"),
                                F.lit(REPORT_HEADER + "\n").alias("text"))
    return top.unionByName(heads).unionByName(body)


def write_report(report: DataFrame, path: str) -> None:
    """Text sink: a range-partitioned sort keeps the document order across part files."""
    report.orderBy("repo_ord", "pr_ord").select("text").write.mode("overwrite").text(path)


# ---- D3 --------------------------------------------------------------------------------
def normalized(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(col), r"(?U)\s+", " "))


def skill_bands(notes: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Deterministic checklist: per (category, normalised requested change) the first
    instruction and rationale, the support count and whether any source was blocking.
    Only categories with evidence appear. (The reference asks the model for this.)"""
    return notes.groupBy("category", normalized(F.col("requested_change")).alias("item")).agg(
        F.min_by("requested_change", ordinal).alias("instruction"),
        F.min_by("rationale", ordinal).alias("rationale"),
        F.count(F.lit(1)).alias("support"),
        F.max((F.col("severity") == "blocking").cast("int")).cast("boolean").alias("blocking"),
        F.min(ordinal).alias("first_ordinal"))


# ---- D4 --------------------------------------------------------------------------------
def exact_groups(items: DataFrame, text: str = "text", ordinal: str = "ordinal",
                 group: str = "category") -> DataFrame:
    """Exact pass: items with the same normalised text (within a group) share the
    smallest ordinal as representative; null texts are equal to each other, null groups are one
    group. Returns (ordinal, rep)."""
    # Kept, as both sides of the join read it: each text is normalised once.
    return _first_of_equal(materialize(items.select(ordinal, F.col(group).alias("_g"), text_key(F.col(text)).alias("_h"))), ordinal)


def text_key(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def _first_of_equal(keyed: DataFrame, ordinal: str) -> DataFrame:
    reps = keyed.groupBy(F.col("_g").alias("_g2"), F.col("_h").alias("_h2")).agg(F.min(ordinal).alias("rep"))
    return keyed.join(reps, F.col("_g").eqNullSafe(F.col("_g2")) & F.col("_h").eqNullSafe(F.col("_h2"))).select(ordinal, "rep")


def words_of(col: Column) -> Column:
    """The words of the normalised text. They lie between its spaces, so only lower case matters here."""
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_from_words(words: Column, n: int = 3) -> Column:
    """Distinct n-word shingles of a word array: a zip of n shifted copies, so the
    words are read a constant number of times (no per-position re-evaluation)."""
    shifted = [words] + [F.slice(words, k + 1, F.size(words)) for k in range(1, n)]
    zipped = F.arrays_zip(*[s.alias(f"w{k}") for k, s in enumerate(shifted)])
    full = F.filter(zipped, lambda x: x[f"w{n - 1}"].isNotNull())
    return F.array_distinct(F.transform(full, lambda x: F.concat_ws(" ", *[x[f"w{k}"] for k in range(n)])))


def shingles(col: Column, n: int = 3) -> Column:
    """Distinct n-word shingles of the normalised text."""
    return shingles_from_words(words_of(col), n)


def connected_min_label(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest reachable node id per node, by iterative min-label propagation over
    undirected edges (a, b). Only nodes with an edge take part. Each round is a join and a
    group-by; the labels are checkpointed every round so the lineage stays short. Rounds go on until one
    changes nothing; each also follows the labels' own labels, so a chain takes about log(n) rounds.
    Returns (node, label)."""
    und = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = und.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label"))
    labels = materialize(labels.withColumn("moved", F.col("label") != F.col("node")))
    while labels.where("moved").limit(1).count():
        prop = und.join(labels.select(F.col("node").alias("b"), F.col("label").alias("_l")), "b") \
            .groupBy(F.col("a").alias("node")).agg(F.min("_l").alias("_m"))
        near = labels.join(prop, "node").select("node", F.col("label").alias("_old"), F.least("label", "_m").alias("label"))
        up = near.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        labels = materialize(near.join(up, "label").select("node", F.col("_up").alias("label"),
                                                           (F.col("_up") != F.col("_old")).alias("moved")))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def merge_similar(items: DataFrame, threshold: float = 0.7, n: int = 3, text: str = "text",
                  ordinal: str = "ordinal", group: str = "category", salt_buckets: int = 16) -> DataFrame:
    """Exact pass, then all pairs of a group whose n-word shingle sets have a Jaccard similarity of at
    least ``threshold``, then connected components; the smallest ordinal represents each
    component. Returns (ordinal, rep).

    The similarity join is exact, by prefix filtering. Items with equal sets are one. The shingles of a set
    are put in order of rarity within the group; two similar sets share one of their first
    ``size - ceil(threshold * size) + 1`` shingles, so only these make buckets, and a shingle that only one
    set has makes none. A bucket's members carry their size, the shingle's place and 256 parity bits of the whole
    set, which bound what two sets can share (``_may_reach``), so most unlike pairs are gone before any set is
    shuffled. Hot buckets are cut down in two steps before any pair is formed:

    * each member is compared with its bucket's smallest member, and the components of
      the links found are joined: a crowd of near copies becomes one component here;
    * a bucket within one component is done. In any other, only the members outside of the bucket's
      largest component are paired with the rest, and only across components. Buckets
      are split over ``salt_buckets`` tasks.

    Items of fewer than ``n`` words, null and empty texts take part only in the exact pass.
    """
    # Shingles are made where the texts lie, also those of exact copies: no text is shuffled, and each is read once.
    texts = items.select(F.col(ordinal).alias("node"), F.col(group).alias("grp"), text_key(F.col(text)).alias("text_key"),
                         F.coalesce(F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)), F.array()).alias("words"))
    made = materialize(_shingle_sets(texts, n))
    sets = made.select("node", "grp", "sh").where(F.size("sh") > 0)
    # 128 bits stand for a set, so that finding equal ones moves no set.
    keys = materialize(made.select("node", "grp", "text_key", F.when(F.size("sh") > 0, F.struct(
        "grp", F.xxhash64("sh"), F.xxhash64(F.lit(1), "sh"), F.size("sh"))).alias("key")))
    exact = _first_of_equal(keys.select(F.col("node").alias(ordinal), F.col("grp").alias("_g"), F.col("text_key").alias("_h")), ordinal)
    keyed = keys.where("key is not null").select("node", "key")
    firsts = materialize(keyed.groupBy("key").agg(F.min("node").alias("a")))
    equal = keyed.join(firsts, "key").select("a", F.col("node").alias("b"))
    different = firsts.select(F.col("a").alias("node"))
    different = F.broadcast(different) if fits_broadcast(different) else different
    buckets = materialize(_prefix_buckets(sets.join(different, "node", "left_semi"), threshold, _measured(sets)))

    centers = buckets.groupBy("grp", "token").agg(F.min(F.struct("node", *MEASURES)).alias("c"), F.count(F.lit(1)).alias("members")) \
        .where("members > 1").drop("members")
    star = _bucket_join(buckets, centers, salt_buckets).where(F.col("node") != F.col("c.node"))
    star = star.select("node", *MEASURES, F.col("c.node").alias("o_node"), *(F.col(f"c.{m}").alias(f"o_{m}") for m in MEASURES)) \
        .where(_may_reach(threshold, first=False)).select(F.col("o_node").alias("a"), F.col("node").alias("b"))
    links = materialize(_verified(star, sets, threshold).unionByName(equal.where("a <> b")))
    nodes = items.select(F.col(ordinal).alias("node"))
    labels = connected_min_label(links, nodes)

    rest = _verified(_mixed_pairs(buckets, labels, threshold, salt_buckets), sets, threshold)
    # What is left links components, so it is small: each end is its component's label.
    between = rest.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a") \
        .join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b") \
        .select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    merged = connected_min_label(materialize(between), labels.select(F.col("label").alias("node")).distinct())
    comp = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("least")), "label").select("node", "least")
    return exact.join(comp, F.col("rep") == F.col("node")).select(ordinal, F.col("least").alias("rep"))


PARITY_WORDS = 4
MEASURES = ["size", "pos", *(f"bits{k}" for k in range(PARITY_WORDS))]


def _shingle_sets(texts: DataFrame, n: int) -> DataFrame:
    """``texts`` with ``sh``, the sorted different hashes of ``n`` consecutive ``words`` (hashes), in place of ``words``."""
    kept = [f for f in texts.schema.fields if f.name != "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = _flat(batch.column("words"))
            hashes = np.zeros(max(len(values) - n + 1, 0), np.uint64)
            for k in range(n):  # each step mixes one more word into all shingles at once
                hashes = (hashes ^ values[k:k + len(hashes)].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                hashes ^= hashes >> np.uint64(29)
                hashes *= np.uint64(0xBF58476D1CE4E5B9)
                hashes ^= hashes >> np.uint64(32)
            # A shingle that would reach into the next text is none.
            sets = [np.unique(hashes[start:max(start, end - n + 1)].view(np.int64)) for start, end in zip(ends, ends[1:])]
            offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            sh = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), sh], names=[*(f.name for f in kept), "sh"])
    return texts.mapInArrow(run, T.StructType([*kept, T.StructField("sh", T.ArrayType(T.LongType()))]))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a column of arrays of longs, without nulls, and where each array begins and ends in them."""
    ends = lists.offsets.to_numpy()
    return lists.values.to_numpy()[ends[0]:ends[-1]], ends - ends[0]


def _measured(sets: DataFrame) -> DataFrame:
    """(node, grp, size, bits) of the sets ``sh``: each shingle flips the parity bit that its hash names."""
    kept = [sets.schema["node"], sets.schema["grp"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = _flat(batch.column("sh"))
            values = values.view(np.uint64)
            row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            bits = np.zeros((len(ends) - 1, PARITY_WORDS), np.uint64)
            np.bitwise_xor.at(bits, (row, (values >> np.uint64(6)) % np.uint64(PARITY_WORDS)), np.uint64(1) << (values & np.uint64(63)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("grp"), pa.array(np.diff(ends).astype(np.int32)),
                 *(pa.array(np.ascontiguousarray(bits[:, k]).view(np.int64)) for k in range(PARITY_WORDS))], names=["node", "grp", "size", *MEASURES[2:]])
    return sets.select("node", "grp", "sh").mapInArrow(run, T.StructType(
        [*kept, T.StructField("size", T.IntegerType()), *(T.StructField(m, T.LongType()) for m in MEASURES[2:])]))


def _prefix_buckets(sets: DataFrame, threshold: float, measured: DataFrame | None = None) -> DataFrame:
    """(grp, token, node, size, pos, bits): the rarest shingles of each set, as many as a similar set can't miss all of, with
    their place in the set's order from 0 and the set's parity bits. ``measured`` may hold other sets too."""
    # A token stands for a shingle of its group, so that two numbers a shingle are shuffled, once to be counted.
    flat = sets.select("node", F.explode(F.transform("sh", lambda x: F.xxhash64("grp", x))).alias("token"))
    # A set has a token once, so that a token's rows are no more than there are sets.
    seen = flat.withColumn("freq", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("freq > 1")
    # Shingles of one set only come first; one array per set, no longer than its text.
    per = seen.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("freq", "token"))).alias("_t"))
    single = F.col("size") - F.size("_t")
    first = F.col("size") - F.ceil(threshold * F.col("size") - 1e-9) + 1 - single
    return per.join(_measured(sets) if measured is None else measured, "node").where(first > 0) \
        .select("*", F.posexplode(F.slice("_t", F.lit(1), first.cast("int"))).alias("_at", "_e")) \
        .select("grp", "_e.token", "node", "size", (F.col("_at") + single).cast("int").alias("pos"), *MEASURES[2:])


def _may_reach(threshold: float, first: bool) -> Column:
    """Whether two members of a bucket, the second's columns named ``o_``, can be similar enough, by what they carry:

    * sizes: the smaller set is at least ``threshold`` times the larger;
    * places: after the bucket's shingle they share no more than the shorter remainder has. ``first`` takes it for the
      first one they share, so that nothing is shared before it: similar sets pass there, and may fail in later buckets;
    * parity: sets differ in at least as many shingles as their parity bits differ.
    """
    size, other = F.col("size"), F.col("o_size")
    needed = F.ceil(threshold / (1 + threshold) * (size + other) - 1e-9)
    shared = 1 + F.least(size - F.col("pos") - 1, other - F.col("o_pos") - 1)
    if not first:
        shared = shared + F.least("pos", "o_pos")
    differing = sum((F.bit_count(F.col(f"bits{k}").bitwiseXOR(F.col(f"o_bits{k}"))) for k in range(PARITY_WORDS)), F.lit(0))
    return ((F.least(size, other) >= threshold * F.greatest(size, other) - 1e-9) & (shared >= needed)
            & (size + other - differing >= 2 * needed))


#: Members of a bucket for each task that it is split over.
SALT_ROWS = 1000


def _bucket_join(members: DataFrame, other: DataFrame, salt_buckets: int) -> DataFrame:
    """``members`` with the columns of ``other``, one row per (grp, token); a bucket of more than ``SALT_ROWS`` members lies in up to
    ``salt_buckets`` tasks, and only its row of ``other`` is copied."""
    large = materialize(members.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SALT_ROWS).select(
        "token", F.least(F.lit(salt_buckets), 1 + F.floor(F.col("n") / SALT_ROWS)).cast("int").alias("_salts")))

    def salted(df: DataFrame, salt: Column) -> DataFrame:
        known = join_small(df, large, ["token"], "left", salt_col="token").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
        return known.withColumn("_salt", salt).drop("_salts")
    left = salted(members, F.pmod(F.xxhash64("node"), F.col("_salts")).cast("int"))
    right = salted(other, F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).withColumnsRenamed(
        {"grp": "_grp", "token": "_token", "_salt": "_s"})
    return left.join(right, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("token") == F.col("_token"))
                     & (F.col("_salt") == F.col("_s"))).drop("_grp", "_token", "_s", "_salt")


def _mixed_pairs(buckets: DataFrame, labels: DataFrame, threshold: float, salt_buckets: int) -> DataFrame:
    """(a, b): pairs of one bucket but of different components that ``_may_reach`` the similarity. Members meet those of their
    own and the next bands of sizes only; a bucket of some thousand members is split over up to ``salt_buckets`` tasks."""
    labelled = buckets.join(labels, "node")
    counts = labelled.groupBy("grp", "token", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("grp", "token").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("members"),
                                               F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels")
    # Similar sets are less than one band apart: a band is a little wider than the ratio of their sizes.
    width = max(-math.log(threshold), 1e-9) * (1 + 1e-6)
    open_ = materialize(_bucket_join(labelled, mixed, salt_buckets)
                        .withColumn("band", F.floor(F.log(F.col("size")) / width))
                        .withColumn("salts", F.least(F.lit(salt_buckets), 1 + F.floor(F.col("members") / 1000)).cast("int")))
    few = open_.where(F.col("label") != F.col("main")).select(
        F.col("grp").alias("o_grp"), F.col("token").alias("o_token"), F.col("node").alias("o_node"), F.col("label").alias("o_label"),
        *(F.col(m).alias(f"o_{m}") for m in MEASURES), F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("o_band"), "salts") \
        .withColumn("o_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    salted = open_.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    pairs = salted.join(few, F.col("grp").eqNullSafe(F.col("o_grp")) & (F.col("token") == F.col("o_token"))
                        & (F.col("band") == F.col("o_band")) & (F.col("salt") == F.col("o_salt")))
    # Two members outside of the largest component would meet twice.
    once = (F.col("label") == F.col("main")) | (F.col("node") < F.col("o_node"))
    return pairs.where((F.col("label") != F.col("o_label")) & once & _may_reach(threshold, first=True)) \
        .select(F.col("node").alias("a"), F.col("o_node").alias("b"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Where the sets in pairs are few, no others are shuffled."""
    pairs = materialize(pairs.distinct())
    paired = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = sets.select("node", "sh")
    if fits_broadcast(paired):
        sets = sets.join(F.broadcast(paired), "node", "left_semi")
    return (pairs.join(sets.select(F.col("node").alias("a"), F.col("sh").alias("sa")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("sh").alias("sb")), "b")
            .where(jaccard(F.col("sa"), F.col("sb")) >= threshold).select("a", "b"))


def jaccard(a: Column, b: Column) -> Column:
    inter = F.size(F.array_intersect(a, b))
    return inter / (F.size(a) + F.size(b) - inter)


# ---- D5 --------------------------------------------------------------------------------
def run_summary(**counted: DataFrame) -> DataFrame:
    """Run counters as (name, value) rows: one aggregate per input, unioned."""
    out = None
    for name, df in counted.items():
        row = df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("name"), "value")
        out = row if out is None else out.unionByName(row)
    return out


# ---- H16 -------------------------------------------------------------------------------
COMPACT_FIELDS = ["category", "severity", "original_issue", "requested_change", "rationale",
                  "implementation_example"]


def synthesis_prompts(notes: DataFrame, reviewers: list[str], chunk: int = SYNTHESIS_CHUNK_SIZE,
                      ordinal: str = "ordinal") -> DataFrame:
    """One prompt per chunk of ``chunk`` notes in curated order (``ordinal`` is dense):
    reviewer names, the count, and the JSON list of compact notes (bounded: ``chunk``)."""
    b = assign_batches(notes, chunk, ordinal)
    compact = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c == "implementation_example"
                         else F.col(c) for c in COMPACT_FIELDS])
    per = b.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos"), compact.alias("n")))).alias("_c"))
    names = ", ".join(reviewers)
    arr = F.transform("_c", lambda x: x["n"])
    prompt = F.concat(F.lit(f"Trusted reviewer GitHub usernames: {names}\nTotal review notes: "),
                      F.size(arr).cast("string"), F.lit("\n\nNotes (JSON array):\n"), F.to_json(arr, {"ignoreNullFields": "false"}))
    return per.select(F.col("batch_id").alias("chunk_id"), F.size(arr).cast("long").alias("n_notes"),
                      prompt.alias("prompt"))


# ---- J3 --------------------------------------------------------------------------------
CHUNK_NOTE = ("\n\nThese notes are one part of a larger set. Answer with short patterns for each "
              "category; the answers to all parts are put together later.")
MERGE_NOTE = ("The texts below each sum up one part of the notes. Put them together into one document, "
              "name every pattern once, and keep to the structure asked for.")
MERGE_FAN_IN = 50


def _call_all(prompts: DataFrame, caller: Callable[[str, str], str], system: str,
              max_attempts: int = ANALYSIS_MAX_ATTEMPTS, journal: str | None = None) -> DataFrame:
    """One call per different prompt (J1), spread over the shuffle partitions; kept, as answers can't be made again. A call that
    raises is tried again, alone, up to ``max_attempts`` times in all; then the job ends."""
    keyed = materialize(prompts.select("chunk_id", "prompt", F.sha2("prompt", 256).alias("prompt_id")))
    pending, answers = keyed, None
    for attempt in range(1, max_attempts + 1):
        raw = md.annotate(pending, caller, system, attempt=attempt, journal=journal)
        good = raw.where("call_error is null")
        answers = good if answers is None else answers.unionByName(good)
        pending = pending.join(good, "prompt_id", "left_anti")
        lost = raw.where("call_error is not null").limit(1).collect()
        if not lost:
            return materialize(keyed.join(answers.select("prompt_id", F.col("raw").alias("text")), "prompt_id").select("chunk_id", "text"))
    raise RuntimeError(f"after {max_attempts} attempts: {lost[0]['call_error']}")


def synthesize(notes: DataFrame, caller: Callable[[str, str], str], system: str, reviewers: list[str],
               chunk: int = SYNTHESIS_CHUNK_SIZE, ordinal: str = "ordinal", chunk_note: str = CHUNK_NOTE,
               merge_note: str = MERGE_NOTE, fan_in: int = MERGE_FAN_IN,
               journal: str | None = None) -> tuple[DataFrame, int]:
    """≤ ``chunk`` notes: one call; more: one call per chunk (in parallel, order kept by
    chunk id), then merge calls over at most ``fan_in`` texts each, joined with ``---``, in
    levels until one text is left. So no row holds more than ``fan_in`` texts. With ``journal`` (see J1), a job started
    again asks only what was not answered.

    Returns (one-row DataFrame ``text``, number of calls).
    """
    if chunk < 1 or fan_in < 2:
        raise ValueError("chunks hold at least one note and merges at least two texts")
    prompts = synthesis_prompts(notes, reviewers, chunk, ordinal)
    n = prompts.count()
    if n == 0:
        spark = notes.sparkSession
        prompts = spark.createDataFrame([(0, 0, synthesis_prompts_empty(reviewers))],
                                        "chunk_id long, n_notes long, prompt string")
        n = 1
    calls = n
    texts = _call_all(prompts, caller, system + chunk_note if n > 1 else system, journal=journal)
    head = f"Trusted reviewer GitHub usernames: {', '.join(reviewers)}\n\n{merge_note}\n\n"
    while n > 1:
        group = F.floor(F.col("chunk_id") / fan_in).cast("long")
        merge = texts.groupBy(group.alias("chunk_id")).agg(F.concat(F.lit(head), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("chunk_id").alias("k"), "text"))), lambda x: x["text"]), "\n\n---\n\n"))
            .alias("prompt"))
        n = -(-n // fan_in)
        calls += n
        texts = _call_all(merge, caller, system, journal=journal)
    return texts.select("text"), calls


def synthesis_prompts_empty(reviewers: list[str]) -> str:
    names = ", ".join(reviewers)
    return f"Trusted reviewer GitHub usernames: {names}\nTotal review notes: 0\n\nNotes (JSON array):\n[]"
