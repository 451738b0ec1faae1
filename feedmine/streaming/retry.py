"""I3 as a keyed stateful stream: a mark per delivery, and for those that wait a state with a timer instead of a
queue's visibility timeout.

Spark's own streaming deduplication keeps a mark of each delivery, so only its first copy gets through. The job is then handed
to the handler, in Arrow batches. If the handler raises, the job gets a keyed state, which counts the receives and sets a timer
``visibility_ms`` ahead; when it fires, the job is tried again, also if no new file has arrived. After
``max_receives`` failed receives the job is dead. A delivery that arrives again while it waits, or after it was settled,
changes nothing. Only failed jobs are tried again, never those of the same batch that succeeded: these pass
the keyed state in a few groups, without a state of their own.

Every receive gives one row: ``delivery_id, receive, status`` (``done``, ``retry`` or ``dead``), ``error``, ``at`` and the job's fields. The
sink writes them under the batch's number with overwrite, so a replayed batch replaces its own rows; dead jobs go to
a folder of their own besides, partitioned by date. State lives in the RocksDB state store, partitioned by delivery: a
settled delivery keeps its mark, which is the receipt that stops later copies, and gives up its keyed state.

A batch that fails midway is run again from the state before it, so a handler may see a receive again: it
has to be idempotent, as with any queue that delivers at least once.
"""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from feedmine.schemas import MAX_RECEIVES, VISIBILITY_MS
from feedmine.session import path_exists

JOB = "version int, work_type string, event string, action string, repo string, pr_number long"
JOB_FIELDS = [f.split()[0] for f in JOB.split(", ")]
STATE = f"receives int, {JOB}"
RECEIVES = f"delivery_id string, receive int, status string, error string, at timestamp, {JOB}"
RECEIVE_FIELDS = ["delivery_id", "receive", "status", "error", "at", *JOB_FIELDS]
#: Groups in which the receives that don't wait pass the keyed state.
PASSING_GROUPS = 1024
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _receive(handle: Callable[[dict], None], delivery: str, receive: int, job: dict, max_receives: int) -> tuple[str, str | None]:
    """One call of the handler: the status it leaves the delivery in, and the error."""
    try:
        handle({"delivery_id": delivery, "receive": receive, **job})
    except Exception as failure:  # noqa: BLE001 - whatever a handler raises counts as a failed receive
        return "dead" if receive >= max_receives else "retry", f"{type(failure).__name__}: {failure}"
    return "done", None


class Receives(StatefulProcessor):
    """The state machine of one delivery after its first receive. ``handle(job)`` gets the job's fields, ``delivery_id`` and ``receive`` as a dict."""

    def __init__(self, handle: Callable[[dict], None], max_receives: int, visibility_ms: int):
        self._work, self._most, self._visibility = handle, max_receives, visibility_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._timers = handle
        self._state = handle.getValueState("delivery", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        for row in rows:
            if row["status"] == "retry":  # alone in its group
                self._wait(row["receive"], tuple(row[f] for f in JOB_FIELDS), timerValues)
            yield Row(**{f: row[f] for f in RECEIVE_FIELDS})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        before, *job = self._state.get()
        fields = dict(zip(JOB_FIELDS, job, strict=True))
        status, error = _receive(self._work, key[0], before + 1, fields, self._most)
        if status == "retry":
            self._wait(before + 1, tuple(job), timerValues)
        else:
            self._state.clear()
        at = datetime.datetime.fromtimestamp(timerValues.getCurrentProcessingTimeInMs() / 1000, datetime.timezone.utc).replace(tzinfo=None)
        yield Row(delivery_id=key[0], receive=before + 1, status=status, error=error, at=at, **fields)

    def close(self) -> None:
        pass

    def _wait(self, receives: int, job: tuple, timers) -> None:
        self._state.update((receives, *job))
        self._timers.registerTimer(timers.getCurrentProcessingTimeInMs() + self._visibility)


def receives(jobs: DataFrame, handle: Callable[[dict], None], max_receives: int = MAX_RECEIVES, visibility_ms: int = VISIBILITY_MS) -> DataFrame:
    """The stream of receives of a stream of jobs (``ev.jobs_of``). Jobs without a delivery id never get this far (H9)."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_receive(handle, row.pop("delivery_id"), 1, row, max_receives) for row in batch.drop_columns(["at"]).to_pylist()]
            status, error = (pa.array([x[k] for x in found], pa.string()) for k in (0, 1))
            columns = {"receive": pa.array([1] * len(found), pa.int32()), "status": status, "error": error}
            yield pa.RecordBatch.from_arrays([columns[f] if f in columns else batch.column(f) for f in RECEIVE_FIELDS], names=RECEIVE_FIELDS)
    once = jobs.select("delivery_id", *JOB_FIELDS).dropDuplicates(["delivery_id"]).withColumn("at", F.current_timestamp())
    waits = F.col("status") == "retry"
    passing = F.pmod(F.xxhash64("delivery_id"), F.lit(PASSING_GROUPS)).cast("int")
    keyed = once.mapInArrow(first, RECEIVES).withColumns({"waiting": F.when(waits, F.col("delivery_id")).otherwise(""),
                                                          "passing": F.when(waits, -1).otherwise(passing)})
    return keyed.groupBy("waiting", "passing").transformWithState(
        statefulProcessor=Receives(handle, max_receives, visibility_ms), outputStructType=RECEIVES, outputMode="Append", timeMode="ProcessingTime")


def write_receives(batch: DataFrame, batch_id: int, root: str) -> None:
    """The rows of one batch, and its dead jobs once more in the dead-letter folder."""
    folder = f"{root}/receives/batch_id={batch_id}"
    batch.write.mode("overwrite").parquet(folder)
    dead = batch.sparkSession.read.schema(RECEIVES).parquet(folder).where(F.col("status") == "dead")
    (dead.withColumn("date", F.to_date("at")).write.mode("overwrite").partitionBy("date").parquet(f"{root}/dead/batch_id={batch_id}"))


def start(stream: DataFrame, root: str, checkpoint: str, trigger: str = "10 seconds") -> StreamingQuery:
    """Run until stopped. Every trigger is a batch, with or without new jobs, so timers fire."""
    conf, before = stream.sparkSession.conf, stream.sparkSession.conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)  # a query keeps the settings it was started with
    try:
        return (stream.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
                .foreachBatch(lambda b, i: write_receives(b, i, root)).trigger(processingTime=trigger).start())
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)


def read_receives(spark: SparkSession, root: str) -> DataFrame:
    if not path_exists(spark, f"{root}/receives"):
        return spark.createDataFrame([], RECEIVES)
    return spark.read.schema(RECEIVES + ", batch_id long").parquet(f"{root}/receives")


def read_dead(spark: SparkSession, root: str) -> DataFrame:
    """Dead letters with their date; ``pipeline.dead_letters_kept`` holds the retention (column ``last_at``)."""
    rows = spark.read.schema(RECEIVES + ", date date, batch_id long").option("basePath", f"{root}/dead").parquet(f"{root}/dead/*")
    return rows.withColumnRenamed("at", "last_at")


def last_status(spark: SparkSession, root: str) -> DataFrame:
    """``delivery_id, receives, status`` of every delivery so far."""
    return read_receives(spark, root).groupBy("delivery_id").agg(
        F.max("receive").cast("long").alias("receives"), F.max_by("status", "receive").alias("status"))


def waiting(spark: SparkSession, root: str) -> tuple[int, int]:
    """How many receives there are so far, and how many deliveries wait: a receive that leaves its delivery waiting is
    followed by one with a number over 1, so two counts tell."""
    row = read_receives(spark, root).agg(F.count(F.lit(1)), F.count_if(F.col("status") == "retry") - F.count_if(F.col("receive") > 1)).first()
    return row[0], row[1]


def run_until_settled(query: StreamingQuery, spark: SparkSession, root: str, timeout_s: float = 600.0) -> None:
    """Let a started query run until its input is read and no delivery waits, then stop it. ``timeout_s`` bounds the time without
    input or a receive; a batch at work is never cut off, however long it takes."""
    end, met, before = time.monotonic() + timeout_s, None, None
    try:
        while True:
            if not query.isActive:
                raise query.exception() or RuntimeError("the stream ended")
            progress = query.lastProgress
            if progress and progress["timestamp"] != met:
                met, count, left = progress["timestamp"], None, None
                if progress["numInputRows"] == 0:
                    count, left = waiting(spark, root)
                # A restarted query first repeats a batch that was cut off, without a look at its input.
                if left == 0 and len(query.recentProgress) > 1:
                    return
                if count is None or count != before:
                    end, before = time.monotonic() + timeout_s, count
                elif time.monotonic() > end:
                    raise TimeoutError(f"{left} deliveries still wait, and none was received in {timeout_s} seconds")
            time.sleep(0.3)
    finally:
        query.stop()
