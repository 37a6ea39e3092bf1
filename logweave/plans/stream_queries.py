"""Streaming operators run over stored arrivals, checked against the SQL of their batch forms, and generated data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from logweave.sources import generators as G
from logweave.sources.adapters import ARRIVALS_SQL, arrivals, event_log
from logweave.sources.scratch import scratch_path
from logweave.streaming import twins

from .cluster_queries import ATTEMPTS
from .registry import ORACLE_SQL, query
from .sequence_queries import LOG_SQL


def _as_stream(df, name: str):
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return twins.live(df.sparkSession, df.schema, path)


def _run(stream, name: str):
    return twins.run_to_table(stream, f"{name}_{uuid.uuid4().hex[:8]}", scratch_path(stream.sparkSession, f"{name}-checkpoint"))


@query("stream_gap_detector", ORACLE_SQL["gap_detector"])
def stream_gap_detector(spark, sf_dir):
    rows = arrivals(event_log(spark, sf_dir)).select("partition", "publisher_id", "seq", "event_no", "copy", "arrival_ts")
    return _run(twins.gap_detector(_as_stream(rows, "arrivals")), "gaps")


@query("stream_bounded_dedup", f"""WITH {ARRIVALS_SQL} SELECT event_id, event_no * 2 + copy AS arrival_no, copy = 1 AS duplicate FROM arrivals""")
def stream_bounded_dedup(spark, sf_dir):
    """Bounded memory over arrivals whose copies follow at once, so that no capacity forgets them."""
    rows = arrivals(event_log(spark, sf_dir)).select("event_id", (F.col("event_no") * 2 + F.col("copy")).alias("arrival_no"))
    return _run(twins.bounded_dedup(_as_stream(rows, "ids"), capacity=100), "dedup")


@query("stream_dlq_outcomes", f"""WITH {LOG_SQL}, {ATTEMPTS}, r AS (SELECT *, coalesce(sum(CAST(ok AS INT)) OVER (PARTITION BY event_id ORDER BY attempt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM att),
  f AS (SELECT event_id, attempt_no, ok, CASE WHEN ok THEN 0 ELSE row_number() OVER (PARTITION BY event_id, run ORDER BY attempt_no) END AS failures FROM r)
  SELECT event_id, attempt_no, failures, CASE WHEN ok THEN 'ack' WHEN failures >= 3 THEN 'dlq' ELSE 'retry' END AS outcome FROM f""")  # fmt: skip
def stream_dlq_outcomes(spark, sf_dir):
    rows = event_log(spark, sf_dir).withColumn("attempt_no", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))))
    rows = rows.select("event_id", "attempt_no", ((F.col("event_no") * 7 + F.col("attempt_no") * 3) % 5 == 0).alias("ok"))
    return _run(twins.retry_outcomes(_as_stream(rows, "attempts"), 3), "retries")


@query("stream_lifecycle")
def stream_lifecycle(spark, sf_dir):
    """Transitions as activity arrives; equal to lifecycle_states up to the last activity of each publisher."""
    rows = event_log(spark, sf_dir).select("publisher_id", F.expr("ts_ns div 1000").alias("at_us"))
    return _run(twins.lifecycle(_as_stream(rows, "activity"), 86_400_000_000, 43_200_000_000), "lifecycle")


SENSOR = {
    "device_id": {"type": "uuid"},
    "reading": {"type": "float", "min": 0, "max": 1000},
    "priority": {"type": "enum", "values": ["low", "normal", "high"]},
    "region": {"type": "enum", "values": ["eu", "us", "ap"]},
    "active": {"type": "bool", "p": 0.9},
    "tag": {"type": "pattern", "pattern": "s-{10-99}/{1-3}"},
}


@query("generated_payloads")
def generated_payloads(spark, sf_dir):
    """Sensor payloads, the same in every run."""
    return G.batch(spark, 1000, "schema", SENSOR, seed=7)
