"""Structured Streaming forms of the operators whose result depends on the order of arrival.

Each takes a streaming DataFrame and returns one, with state per key in the state store. Within a micro-batch rows are put
into arrival order first, so a stream gives the rows of its batch form whatever its batches are."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logweave.operators import sequence as S
from logweave.operators.processing import LIFECYCLE
from logweave.sources.scratch import scratch_path

GAP_OUT = "partition int, publisher_id string, seq long, event_no long, copy int, outcome string, missed_start long, missed_end long"


def _together(parts: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(order, kind="stable")


def gap_detector(stream: DataFrame, ttl_ms: int = 0) -> DataFrame:
    """Outcome of every row (partition, publisher_id, seq, event_no, copy, arrival_ts); state: the highest number of a stream.

    With a time to live, a publisher that stays quiet for longer is forgotten and starts anew."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _together(parts, ["arrival_ts", "event_no", "copy"])
        highest = state.get[0] if state.exists else -1
        before = rows["seq"].cummax().shift(fill_value=-1).clip(lower=highest)
        expected, seq = before + 1, rows["seq"]
        gap = seq > expected
        outcome = pd.Series("duplicate", index=rows.index).mask(seq == expected, "deliver").mask(gap, "gap")
        state.update((int(max(highest, seq.max())),))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        out = rows[["partition", "publisher_id", "seq", "event_no", "copy"]].assign(outcome=outcome)
        yield out.assign(missed_start=expected.where(gap).astype("Int64"), missed_end=seq.where(gap).astype("Int64"))

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    rows = stream.select("partition", "publisher_id", "seq", "event_no", "copy", "arrival_ts")
    return rows.groupBy("partition", "publisher_id").applyInPandasWithState(step, GAP_OUT, "highest long", "append", timeout)


def bounded_dedup(stream: DataFrame, capacity: int = 10_000, shards: int = 16, order: str = "arrival_no") -> DataFrame:
    """event_id, arrival_no, duplicate: an id is new unless it is among the last `capacity` ids inserted in its shard."""
    shard = F.pmod(F.conv(F.substring(F.md5(F.col("event_id").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _together(parts, [order])
        flags, held = fifo_flags(rows["event_id"], list(state.get[0]) if state.exists else [], capacity)
        state.update((held,))
        yield rows[["event_id", order]].assign(duplicate=flags)

    rows = stream.select("event_id", F.col(order), shard.alias("shard"))
    kind = rows.schema[order].dataType.simpleString()
    return rows.groupBy("shard").applyInPandasWithState(step, f"event_id string, {order} {kind}, duplicate boolean", "ids array<string>", "append", GroupStateTimeout.NoTimeout)


def fifo_flags(ids, held: list[str], capacity: int) -> tuple[list[bool], list[str]]:
    """(duplicate flag per id, ids held afterwards) of a first-in first-out memory."""
    memory = OrderedDict.fromkeys(held)
    flags = []
    for i in ids:
        flags.append(i in memory)
        if i not in memory:
            memory[i] = None
            if len(memory) > capacity:
                memory.popitem(last=False)
    return flags, list(memory)


def dedup_within(stream: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Native form without a fixed capacity: one row per id within the watermark delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["event_id"])


def retry_outcomes(stream: DataFrame, max_attempts: int, shards: int = 1024) -> DataFrame:
    """event_id, attempt_no, failures, outcome (ack, retry, dlq); state: failures since the last success.

    Ids are dealt to `shards` groups by hash, so that one call of Python serves many of them: most ids have few attempts. The
    state of a group holds the ids whose last attempt failed. A stream keeps its number of shards for life."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _together(parts, ["event_id", "attempt_no"])
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        codes, ids = pd.factorize(rows["event_id"], use_na_sentinel=False)
        ids = [i if isinstance(i, str) else None for i in ids]
        before = np.array([held.get(i, 0) for i in ids], dtype=np.int64)
        at, ok = np.arange(len(rows)), rows["ok"].eq(True).to_numpy(bool)
        first = np.searchsorted(codes, np.arange(len(ids)))  # ids lie together, in the order of their codes
        success = np.maximum.accumulate(np.where(ok, at, -1))
        n = np.where(success >= first[codes], at - success, at - first[codes] + 1 + before[codes])
        held |= zip(ids, n[np.append(first[1:], len(rows)) - 1].tolist(), strict=True)
        held = {i: k for i, k in held.items() if k}
        state.update((list(held), list(held.values())))
        outcome = np.where(ok, "ack", np.where(n >= max_attempts, "dlq", "retry"))
        yield rows[["event_id", "attempt_no"]].assign(failures=n, outcome=outcome)

    rows = stream.select("event_id", "attempt_no", "ok", F.pmod(F.xxhash64("event_id"), F.lit(shards)).alias("shard"))
    out = "event_id string, attempt_no long, failures long, outcome string"
    return rows.groupBy("shard").applyInPandasWithState(step, out, "ids array<string>, failures array<long>", "append", GroupStateTimeout.NoTimeout)


def lifecycle(stream: DataFrame, inactive_us: int = 300_000_000, grace_us: int = 120_000_000) -> DataFrame:
    """Transitions of publishers (publisher_id, at_us) as their activity arrives; the quiet after the last activity is told when
    the next one comes. State: last activity, state and epoch."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, name, epoch = state.get if state.exists else (None, None, 0)
        out = []
        for at in sorted(x for p in parts for x in p["at_us"]):
            if last is not None:
                for k, to in enumerate(("SUSPECTED", "DRAINING", "ARCHIVED")):
                    due = last + inactive_us + k * grace_us
                    if due < at:
                        out.append((key[0], due, to, epoch))
                        name, epoch = to, epoch + 1
            if name != "ACTIVE":
                out.append((key[0], at, "ACTIVE", epoch))
                name, epoch = "ACTIVE", epoch + 1
            last = at
        state.update((last, name, epoch))
        yield pd.DataFrame(out, columns=LIFECYCLE.fieldNames())

    return stream.select("publisher_id", "at_us").groupBy("publisher_id").applyInPandasWithState(step, LIFECYCLE, "at long, name string, epoch long", "append", GroupStateTimeout.NoTimeout)


def publish_watermarks(stream: DataFrame, log_path: str, on_marks, checkpoint: str, **trigger):
    """Append each micro-batch to the stored log, then hand the watermarks of the streams it touched to `on_marks(df, batch_id)`.

    A batch is stored under its own number, so one that runs again after a failure overwrites itself."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{log_path}/batch={number}")
        stored = spark.read.parquet(log_path)
        touched = batch.select(*S.STREAM).distinct()
        on_marks(S.watermarks(stored.join(touched, list(S.STREAM), "left_semi")), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def commit_offsets(stream: DataFrame, group_id: str, path: str, checkpoint: str, generation: int = 1, **trigger):
    """Commit the positions that each micro-batch of a consumer reaches; readers take the highest per stream."""

    def run(batch: DataFrame, number: int) -> None:
        rows = S.cursors(batch).withColumns({"group_id": F.lit(group_id), "generation": F.lit(generation).cast("long"), "commit_no": F.lit(number).cast("long")})
        rows.write.mode("overwrite").parquet(f"{path}/commit={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live(spark, schema: T.StructType, path: str, max_files: int | None = None) -> DataFrame:
    """The log as a stream of files; catching up is a larger `max_files` per trigger, and nothing is ever dropped."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def run_to_table(stream: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what there is and return its output, also as the temporary view `name` (tests, inspection).

    Tasks write the rows as files in the shared folder, or below `checkpoint` where one is given, so that a run that goes on from
    it adds to what is there; the driver holds none of them."""
    spark = stream.sparkSession
    path = f"{checkpoint}/output" if checkpoint else scratch_path(spark, name)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)  # a stream without files runs no batch
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint or scratch_path(spark, f"{name}-checkpoint"))
    q = writer.trigger(availableNow=True).start(path)
    q.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(path)
    rows.createOrReplaceTempView(name)
    return rows
