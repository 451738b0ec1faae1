"""Structured Streaming: delivery stream (I1), exactly-once dispatch (I2), retry and
dead letter (I3), wait-for-merge state (I4) and incremental mining (I5).

Every stream reuses the batch operators: a micro-batch is a DataFrame, so the
same functions run in ``foreachBatch``. Sinks write under a directory keyed by the
batch id with overwrite, so a replayed batch (after a driver or executor failure)
rewrites the same output instead of adding to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedmine.operators import events as ev
from feedmine.schemas import DEAD_LETTER_RETENTION_DAYS, ENVELOPE, MAX_RECEIVES
from feedmine.session import materialize, path_exists

LANDED_ENVELOPE = T.StructType(list(ENVELOPE.fields) + [
    T.StructField("event_id", T.LongType()), T.StructField("copy", T.IntegerType()),
    T.StructField("k", T.IntegerType())])


# ---- I1 -------------------------------------------------------------------------------
def delivery_stream(spark: SparkSession, landing_dir: str, secret: str | None,
                    schema: T.StructType = LANDED_ENVELOPE, max_files: int | None = None) -> DataFrame:
    """Landed envelopes (JSON lines) → H8 → H7 → H9 → C5: one status row per delivery,
    with the job fields where a rule routed it. Stateless."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return ev.route_deliveries(reader.json(landing_dir), secret)


def run_available(stream: DataFrame, out_dir: str, checkpoint: str, fmt: str = "parquet",
                  partition_by: list[str] | None = None) -> None:
    """Process everything available now into a file sink, then stop."""
    w = stream.writeStream.format(fmt).option("path", out_dir).option("checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()


# ---- I2 -------------------------------------------------------------------------------
# Receipt buckets: a micro-batch reads only the buckets of its delivery ids. Sized so that
# a bucket file per batch stays large enough; raise it with the delivery volume.
RECEIPT_BUCKETS = 64


def receipt_bucket(col: str = "delivery_id"):
    return F.pmod(F.xxhash64(F.col(col)), F.lit(RECEIPT_BUCKETS)).cast("int")


def write_receipts(receipts: DataFrame, receipts_dir: str, batch_id: int) -> None:
    """Receipts are partitioned by (number of buckets, bucket of the delivery id, batch id); a replayed
    batch overwrites exactly its own partitions. Receipts written with another number of
    buckets stay readable: they are just not pruned."""
    (receipts.withColumn("buckets", F.lit(RECEIPT_BUCKETS)).withColumn("bucket", receipt_bucket())
     .withColumn("batch_id", F.lit(batch_id))
     .repartition("bucket")  # one file per bucket and batch
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("buckets", "bucket", "batch_id").parquet(receipts_dir))


def dispatch_batch(batch: DataFrame, batch_id: int, handler: Callable[[DataFrame], DataFrame],
                   receipts_dir: str, results_dir: str) -> None:
    """One micro-batch of jobs: dedup inside the batch, skip completed ids (C6), run the
    handler, then write its results and the receipts of the successes, both keyed by
    the batch id (a replay overwrites the same files). Receipts are written only after
    the handler succeeded.

    Receipts never expire, so they are not scanned whole: only the hash buckets of
    the delivery ids in this batch are read (at most ``RECEIPT_BUCKETS`` small ints
    reach the driver, never receipts or jobs).
    """
    dispatch_jobs(ev.jobs_of(batch).dropDuplicates(["delivery_id"]), batch_id, handler, receipts_dir, results_dir)


def dispatch_jobs(jobs: DataFrame, batch_id: int, handler: Callable[[DataFrame], DataFrame],
                  receipts_dir: str, results_dir: str) -> None:
    """The jobs without a receipt through the handler, once; results, then receipts."""
    spark = jobs.sparkSession
    jobs = jobs.withColumn("_bucket", receipt_bucket()).persist()
    buckets = [r["_bucket"] for r in jobs.select("_bucket").distinct().collect()]
    pending = jobs
    if path_exists(spark, receipts_dir):
        ours = (F.col("buckets") != RECEIPT_BUCKETS) | F.col("bucket").isin(buckets)
        receipts = spark.read.parquet(receipts_dir).where(ours & (F.col("batch_id") != batch_id))
        pending = ev.pending_jobs(jobs, receipts)
    results = handler(pending.drop("_bucket")).withColumn("batch_id", F.lit(batch_id))  # (delivery_id, ok, ...)
    folder = f"{results_dir}/batch_id={batch_id}"
    results.write.mode("overwrite").parquet(folder)
    jobs.unpersist()
    # The handler has run once, for the results; receipts come from what it has left.
    done = spark.read.parquet(folder).where(F.col("ok")).select(
        "delivery_id", F.lit("COMPLETED").alias("state"), F.current_timestamp().alias("completed_at"))
    write_receipts(done, receipts_dir, batch_id)


def dispatch(stream: DataFrame, handler: Callable[[DataFrame], DataFrame], receipts_dir: str,
             results_dir: str, checkpoint: str) -> None:
    q = (stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda b, i: dispatch_batch(b, i, handler, receipts_dir, results_dir))
         .trigger(availableNow=True).start())
    q.awaitTermination()


# ---- I3 -------------------------------------------------------------------------------
def split_failures(receives: DataFrame, max_receives: int = MAX_RECEIVES) -> DataFrame:
    """Per delivery over its receive log (delivery_id, receive, ok, at): 'done' when a
    receive succeeded, 'dead' after ``max_receives`` failed receives, else 'retry'.
    Only failed rows are retried; successful rows of the same batch are not."""
    per = receives.groupBy("delivery_id").agg(
        F.max(F.col("ok").cast("int")).alias("_ok"), F.count(F.lit(1)).alias("receives"),
        F.max("at").alias("last_at"))
    status = (F.when(F.col("_ok") == 1, F.lit("done"))
              .when(F.col("receives") >= max_receives, F.lit("dead")).otherwise(F.lit("retry")))
    return per.select("delivery_id", F.col("receives").cast("long").alias("receives"), "last_at",
                      status.alias("status"))


def _batch_before(spark: SparkSession, folder: str, batch_id: int) -> DataFrame | None:
    """The rows that the newest batch before ``batch_id`` left in a folder keyed by batch."""
    if not path_exists(spark, folder):
        return None
    rows = spark.read.parquet(folder)
    before = rows.where(F.col("batch_id") < batch_id).agg(F.max("batch_id")).first()[0]
    return None if before is None else rows.where(F.col("batch_id") == before)


def retry_batch(batch: DataFrame, batch_id: int, handler: Callable[[DataFrame], DataFrame], root: str,
                max_receives: int = MAX_RECEIVES) -> None:
    """One micro-batch with retries: the new jobs and those that wait from the batch before go to the
    handler together. What succeeds gets a receipt; what fails, or gets no answer, waits for the next
    batch; what has failed ``max_receives`` times goes to the dead letters, partitioned by date.

    ``waiting`` holds for each batch all jobs that still wait, so one batch of it is the whole
    state and a replayed batch starts from the same jobs and overwrites the same folders. An
    empty batch only tries the waiting jobs again.
    """
    spark = batch.sparkSession
    jobs = ev.jobs_of(batch).dropDuplicates(["delivery_id"]).withColumn("receives", F.lit(0).cast("long"))
    waiting = _batch_before(spark, f"{root}/waiting", batch_id)
    if waiting is not None:
        waiting = waiting.where(F.col("delivery_id").isNotNull()).select(*jobs.columns)
        jobs = jobs.join(waiting.select("delivery_id"), "delivery_id", "left_anti").select(*waiting.columns).unionByName(waiting)
    jobs = materialize(jobs)
    dispatch_jobs(jobs, batch_id, handler, f"{root}/receipts", f"{root}/results")
    ok = spark.read.parquet(f"{root}/results/batch_id={batch_id}").where("ok").select("delivery_id")
    completed = spark.read.parquet(f"{root}/receipts") if path_exists(spark, f"{root}/receipts") else None
    failed = jobs.join(ok, "delivery_id", "left_anti")
    if completed is not None:
        failed = ev.pending_jobs(failed, completed.where(F.col("batch_id") < batch_id))
    failed = materialize(failed.withColumn("receives", F.col("receives") + 1).select(*jobs.columns))
    dead = failed.where(F.col("receives") >= max_receives).withColumn("last_at", F.current_timestamp())
    (dead.withColumn("date", F.to_date("last_at")).write.mode("overwrite").partitionBy("date")
     .parquet(f"{root}/dead/batch_id={batch_id}"))
    # A row without a delivery marks the batch, so that a batch after which nothing waits shows too.
    mark = spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in failed.schema))
    (failed.where(F.col("receives") < max_receives).unionByName(mark)
     .write.mode("overwrite").parquet(f"{root}/waiting/batch_id={batch_id}"))


def dispatch_retrying(stream: DataFrame, handler: Callable[[DataFrame], DataFrame], root: str, checkpoint: str) -> None:
    q = (stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda b, i: retry_batch(b, i, handler, root))
         .trigger(availableNow=True).start())
    q.awaitTermination()


def dead_letters_kept(dead: DataFrame, now_col=None, days: int = DEAD_LETTER_RETENTION_DAYS) -> DataFrame:
    """Retention: dead letters older than ``days`` are dropped (a filter on the date)."""
    now = now_col if now_col is not None else F.current_timestamp()
    return dead.where(F.col("last_at") >= now - F.expr(f"INTERVAL {days} DAYS"))


# ---- I4 -------------------------------------------------------------------------------
PENDING_STATE = "pending boolean, last_seq long"
PENDING_OUT = "repo string, pr_number long, seq long, action string"
# PRs share a state by a hash of their key: for each PR, a call into Python and a row of the state store cost some
# milliseconds, far more than following it. A batch rewrites the states of its PRs' buckets, so raise the number with that of
# the PRs ever seen (some 20 bytes each); a stream keeps the number it was started with.
PENDING_BUCKETS = 2048
PENDING_BUCKET_STATE = "prs binary"
PENDING_BUCKET_OUT = "repo string, pr_number string, seq long, action string"


def _follow(rows: list[tuple], pending: bool, last: int) -> tuple[list[tuple[int, str]], bool, int]:
    """The actions (seq, action) that the snapshots (seq, state, merged_at) of one PR ask for, and its state after them."""
    out = []
    # Snapshots that arrive after a newer one of the same PR change nothing.
    for seq, now, merged_at in sorted((r for r in rows if r[0] is not None and r[0] > last), key=lambda r: r[0]):
        merged = isinstance(merged_at, str) and merged_at != ""
        if merged:
            out.append((int(seq), "mine"))
            pending = False
        elif now == "closed":
            if pending:
                out.append((int(seq), "forget"))
            pending = False
        else:
            if not pending:
                out.append((int(seq), "pending"))
            pending = True
        last = int(seq)
    return out, pending, last


def _pending_fn(key, pdfs: Iterator[pd.DataFrame], state):
    pending, last = state.get if state.exists else (False, -1)
    rows = []  # plain values: a call gets the few snapshots of one PR, for which frames cost more than the work
    for pdf in pdfs:
        rows += zip(pdf["seq"].tolist(), pdf["state"].tolist(), pdf["merged_at"].tolist(), strict=True)
    actions, pending, last = _follow(rows, pending, last)
    state.update((pending, last))
    if actions:
        yield pd.DataFrame([(*key, *a) for a in actions], columns=["repo", "pr_number", "seq", "action"])


def _pack_prs(prs: dict[tuple, tuple[bool, int]]) -> bytes:
    """The states of a bucket's PRs as one Arrow stream."""
    (repos, numbers), (pending, last) = zip(*prs, strict=True), zip(*prs.values(), strict=True)
    batch = pa.record_batch({"repo": pa.array(repos, pa.string()).dictionary_encode(), "pr_number": pa.array(numbers, pa.string()),
                             "pending": pa.array(pending, pa.bool_()), "last_seq": pa.array(last, pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack_prs(packed: bytes) -> dict[tuple, tuple[bool, int]]:
    repos, numbers, pending, last = (c.to_pylist() for c in pa.ipc.open_stream(pa.py_buffer(packed)).read_all().columns)
    return dict(zip(zip(repos, numbers, strict=True), zip(pending, last, strict=True), strict=True))


def _pending_bucket_fn(key, pdfs: Iterator[pd.DataFrame], state):
    """All PRs of a bucket that have snapshots in the batch, each by itself."""
    prs = _unpack_prs(state.get[0]) if state.exists else {}
    rows: dict[tuple, list[tuple]] = {}
    for pdf in pdfs:
        for repo, number, *row in zip(*(pdf[c].tolist() for c in ("repo", "pr_number", "seq", "state", "merged_at")), strict=True):
            rows.setdefault((repo, number), []).append(row)
    out = []
    for pr, snapshots in rows.items():
        actions, *prs[pr] = _follow(snapshots, *prs.get(pr, (False, -1)))
        out += ((*pr, *a) for a in actions)
    state.update((_pack_prs(prs),))
    if out:
        yield pd.DataFrame(out, columns=["repo", "pr_number", "seq", "action"])


def pending_until_merged(observations: DataFrame, buckets: int | None = PENDING_BUCKETS) -> DataFrame:
    """I4: per (repo, PR), remember open PRs, mine merged ones (again on any later event),
    forget closed unmerged ones. State lives in the state store: one small entry per
    PR ever seen, as the sequence number of a closed one still decides what is late. The entries of a bucket of PRs are one
    state, followed by one call for each batch; without ``buckets`` each PR is a state of its own, with which streams started so go on.
    """
    if buckets is None:
        return observations.groupBy("repo", "pr_number").applyInPandasWithState(
            _pending_fn, PENDING_OUT, PENDING_STATE, "append", "NoTimeout")
    # Numbers go as text, since a null among them would make frames hold them as floats. Snapshots without a number change nothing.
    numbered = observations.where(F.col("seq").isNotNull()).select(
        "repo", F.col("pr_number").cast("string").alias("pr_number"), "seq", "state", "merged_at",
        F.pmod(F.xxhash64("repo", "pr_number"), F.lit(buckets)).cast("int").alias("bucket"))
    out = numbered.groupBy("bucket").applyInPandasWithState(
        _pending_bucket_fn, PENDING_BUCKET_OUT, PENDING_BUCKET_STATE, "append", "NoTimeout")
    return out.withColumn("pr_number", F.col("pr_number").cast("long"))


# ---- I5 -------------------------------------------------------------------------------
def mine_batch(keys: DataFrame, batch_id: int, state_root: str, base_version: int,
               incoming_for: Callable[[DataFrame], DataFrame]) -> None:
    """One micro-batch of mined PR keys: read the state of the previous version, of the keys' repos
    only, mine, publish version ``base + batch_id + 1`` (commit last). Repos without a key keep
    their files. A replayed batch reads the same input version and overwrites the same
    output version."""
    from feedmine.plans.mining import mine
    from feedmine.sources import snapshot as snap

    spark = keys.sparkSession
    keys = materialize(keys.select("repo", "pr_number").distinct())
    repos = keys.select("repo").distinct()
    prior = snap.read_snapshot(spark, state_root, "notes", base_version + batch_id, repos=repos)
    result = mine(prior, materialize(incoming_for(keys)), keys)
    snap.publish_snapshot(spark, state_root, {"removed": result.removed, "current": result.current, "notes": result.active},
                          version=base_version + batch_id + 1, touched={"notes": repos})


def mining_stream(keys_stream: DataFrame, state_root: str, base_version: int,
                  incoming_for: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
    q = (keys_stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda b, i: mine_batch(b, i, state_root, base_version, incoming_for))
         .trigger(availableNow=True).start())
    q.awaitTermination()
