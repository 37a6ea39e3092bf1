"""Stream processors, retries, slow-consumer detection, publisher lifecycle, latency summaries."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.functions.exprs import backoff_ms, map_processor
from logweave.sources.scratch import stored

from .tasks import spread


def process(rows: DataFrame, mode: str, payload_col: str = "payload", drop_share: float = 0.0, delay_ms: int = 0, id_col: str = "event_id") -> DataFrame:
    """passthrough, delay (ts moves), filter (drops a share, chosen by a hash of the id so that reruns agree) or map."""
    if mode == "passthrough":
        return rows
    if mode == "delay":
        return rows.withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(delay_ms / 1000)))
    if mode == "filter":
        share = min(max(drop_share, 0.0), 1.0)
        u = F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
        return rows.where(u >= share)
    if mode == "map":
        return rows.withColumn(payload_col, map_processor(F.col(payload_col)))
    raise ValueError(f"unknown mode {mode!r}")


def retry_outcomes(attempts: DataFrame, max_attempts: int, base_ms: int, max_ms: int) -> DataFrame:
    """attempts (event_id, attempt_no, ok) with failure count since the last success, outcome (ack, retry, dlq) and delay."""
    w = Window.partitionBy("event_id").orderBy("attempt_no")
    rows = spread(attempts, "event_id").withColumn("__n", F.row_number().over(w))
    success = F.max(F.when(F.col("ok"), F.col("__n"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("failures", F.when(~F.col("ok"), F.col("__n") - F.coalesce(success, F.lit(0))).otherwise(0)).drop("__n")
    outcome = F.when(F.col("ok"), "ack").when(F.col("failures") >= max_attempts, "dlq").otherwise("retry")
    rows = rows.withColumn("outcome", outcome)
    return rows.withColumn("delay_ms", F.when(F.col("outcome") == "retry", backoff_ms(F.col("failures") - 1, base_ms, max_ms)))


def slow_consumers(samples: DataFrame, fullness: float = 0.8, lag: int = 10_000, debounce_us: int = 2_000_000) -> DataFrame:
    """Samples (consumer, ts, fullness, lag) at which a consumer has been over a limit, without a break, for longer than the debounce.

    The first sample over a limit starts the clock; a run is told by the number of samples below before it."""
    over = (F.col("fullness") > fullness) | (F.col("lag") > lag)
    by = Window.partitionBy("consumer").orderBy("ts")
    rows = samples.withColumn("__over", over).withColumn("__run", F.sum((~F.col("__over")).cast("int")).over(by)).where("__over")
    start = F.min("ts").over(Window.partitionBy("consumer", "__run"))
    held = F.timestamp_diff("MICROSECOND", start, F.col("ts"))
    return rows.withColumn("over_us", held).where(F.col("over_us") > debounce_us).select("consumer", "ts", "over_us")


LIFECYCLE = T.StructType(
    [
        T.StructField("publisher_id", T.StringType()),
        T.StructField("at_us", T.LongType()),
        T.StructField("state", T.StringType()),
        T.StructField("epoch", T.LongType()),
    ]
)


def lifecycle_steps(seen_us: list[int], until_us: int, inactive_us: int, grace_us: int) -> list[tuple[int, str, int]]:
    """(time, state, epoch) transitions of one publisher with activity at the given times.

    ACTIVE at its first activity; SUSPECTED when it has been quiet for inactive_us; DRAINING after grace_us more; ARCHIVED
    after another grace_us. Any activity makes it ACTIVE again. Every transition raises the epoch."""
    times = sorted(seen_us)
    return _transitions(list(zip(times, [*times[1:], None], strict=True)), until_us, inactive_us, grace_us)


def _transitions(activity: list[tuple[int, int | None]], until_us: int, inactive_us: int, grace_us: int) -> list[tuple[int, str, int]]:
    """lifecycle_steps() from (time, time of the next activity) pairs; pairs that change nothing may be left out."""
    out: list[tuple[int, str, int]] = []
    state, epoch = None, 0

    def move(at: int, to: str) -> None:
        nonlocal state, epoch
        state = to
        out.append((at, to, epoch))
        epoch += 1

    for at, following in activity:
        if state != "ACTIVE":
            move(at, "ACTIVE")
        quiet_until = until_us + 1 if following is None else following
        for wait, to in ((inactive_us, "SUSPECTED"), (inactive_us + grace_us, "DRAINING"), (inactive_us + 2 * grace_us, "ARCHIVED")):
            if at + wait < quiet_until:
                move(at + wait, to)
    return out


def lifecycle(activity: DataFrame, until_us: int, inactive_us: int = 300_000_000, grace_us: int = 120_000_000) -> DataFrame:
    """Transitions of all publishers from activity (publisher_id, at_us): an ordered fold per publisher.

    An activity that follows and is followed by another within inactive_us changes nothing, so only the first and last of
    each busy run go to the fold: a chatty publisher doesn't fill a task."""
    by = Window.partitionBy("publisher_id").orderBy("at_us")
    rows = activity.select("publisher_id", "at_us").distinct().withColumns({"before": F.lag("at_us").over(by), "following": F.lead("at_us").over(by)})
    far = lambda a, b: F.coalesce(b - a >= inactive_us, F.lit(True))
    ends = rows.where(far(F.col("before"), F.col("at_us")) | far(F.col("at_us"), F.col("following")))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at_us")
        pairs = [(int(a), None if pd.isna(b) else int(b)) for a, b in zip(pdf["at_us"], pdf["following"].astype("Int64"), strict=True)]
        rows = [(pdf["publisher_id"].iloc[0], *s) for s in _transitions(pairs, until_us, inactive_us, grace_us)]
        return pd.DataFrame(rows, columns=LIFECYCLE.fieldNames())

    return ends.select("publisher_id", "at_us", "following").groupBy("publisher_id").applyInPandas(fold, LIFECYCLE)


def latency_summary(rows: DataFrame, value: Column, by: list[str], part: int = 250_000) -> DataFrame:
    """Exact percentiles, mean and standard deviation.

    Equal values are counted, the counts are put in order over all tasks, `part` of them to each, and written. Only parts that hold
    a wanted rank are looked into, so no group has to fit one task. Percentiles between two ranks are interpolated as Spark does."""
    shares = {f"p{x}": x / 100 for x in (25, 50, 75, 95, 99)}
    rows = rows.select(*by, value.cast("double").alias("__v"))
    summary = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("__v").alias("mean"), F.stddev("__v").alias("stddev"))
    counts = stored(rows.where("__v is not null").groupBy(*by, "__v").agg(F.count("*").alias("__c")), "value-counts")
    order = counts.repartitionByRange(max(1, -(-counts.count() // part)), *by, "__v").withColumn("__part", F.spark_partition_id())
    order = stored(order, "values-in-order")
    of, at = Window.partitionBy(*by), {c: F.lit(q) * (F.col("__all") - 1).cast("double") for c, q in shares.items()}
    parts = order.groupBy(*by, "__part").agg(F.sum("__c").alias("__m")).withColumn("__all", F.sum("__m").over(of))
    parts = parts.withColumn("__before", F.coalesce(F.sum("__m").over(of.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    holds = lambda low, n: reduce(or_, ((F.floor(p) < low + n) & (F.ceil(p) >= low) for p in at.values()))
    near = _join(order, parts.where(holds(F.col("__before"), F.col("__m"))), [*by, "__part"], "inner")
    upto = F.sum("__c").over(Window.partitionBy(*by, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("__low", F.col("__before") + upto - F.col("__c"))
    value_at = lambda rank: F.max(F.when((F.col("__low") <= rank) & (rank < F.col("__low") + F.col("__c")), F.col("__v")))
    ranks = [(f"__{c}_{end}", rank(p)) for c, p in at.items() for end, rank in (("low", F.floor), ("high", F.ceil))]
    found = near.groupBy(*by, "__all").agg(*[value_at(rank).alias(name) for name, rank in ranks])
    for c, p in at.items():
        low, high = F.col(f"__{c}_low"), F.col(f"__{c}_high")
        found = found.withColumn(c, F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high))
    return _join(summary, found.select(*by, *shares), by, "left").select(*by, "n", *shares, "mean", "stddev")


def _join(a: DataFrame, b: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join on columns that may be null; null meets null."""
    b = b.withColumnsRenamed({c: f"__{i}_on" for i, c in enumerate(on)})
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__{i}_on")) for i, c in enumerate(on)), F.lit(True))
    return a.join(b, same, how).drop(*[f"__{i}_on" for i in range(len(on))])


def interval_rates(ticks: DataFrame) -> DataFrame:
    """ticks (source, tick, total): growth per two-second tick, halved, never below 0."""
    before = F.lag("total", 1, 0).over(Window.partitionBy("source").orderBy("tick"))
    return ticks.withColumn("per_second", F.floor(F.greatest(F.col("total") - before, F.lit(0)) / 2))


def sparkline(points: DataFrame) -> DataFrame:
    """points (group_id, value, ...) scaled by the group's highest value, 1 at least."""
    top = F.greatest(F.max("value").over(Window.partitionBy("group_id")), F.lit(1))
    return points.withColumn("height", F.col("value") / top)
