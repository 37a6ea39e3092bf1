"""Queries over the event log and the keyed order log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions import exprs
from logweave.functions.exprs import QueryFilters, ReplayFilters
from logweave.operators import log as L
from logweave.operators import sequence as S
from logweave.sources.adapters import LOG_SQL, VERSIONS_SQL, event_log, order_versions

from .registry import query

COLS = ["partition", "publisher_id", "seq", "event_id", "ts_ns", "key", "hlc_physical_ns", "hlc_logical"]
OUT = "partition, publisher_id, seq, event_id, ts_ns, key, hlc_physical_ns, hlc_logical, CAST(strlen(payload) AS INTEGER) AS payload_size"
HLC = "hlc_physical_ns IS NOT NULL"
PUBLISHER = "00000003"
#: Bounds inside the time span of the test events, in nanoseconds since 1970.
T1, T2 = 1704585600_000_000_000, 1706400000_000_000_000

AFTER = f"(hlc_physical_ns > {T1} OR (hlc_physical_ns = {T1} AND hlc_logical > 1))"


def out(rows: DataFrame) -> DataFrame:
    return rows.select(*COLS, F.length("payload").alias("payload_size"))


def log_sql(where: str = "true", tail: str = "") -> str:
    return f"WITH {LOG_SQL} SELECT {OUT} FROM log WHERE {where} {tail}"


def log_query(name: str, make, where: str = "true", tail: str = "") -> None:
    query(name, log_sql(where, tail))(lambda spark, sf_dir: out(make(event_log(spark, sf_dir))))


log_query("log_scan", lambda log: L.scan(log))
log_query("log_seq_range", lambda log: L.scan(log, QueryFilters(after_seq=5, before_seq=40)), "seq > 5 AND seq < 40")
log_query("log_time_range", lambda log: L.scan(log, QueryFilters(after_time_ns=T1, before_time_ns=T2)), f"ts_ns > {T1} AND ts_ns < {T2}")
log_query("log_by_publisher", lambda log: L.scan(log, QueryFilters(publisher_id=PUBLISHER, after_seq=3)), f"publisher_id = '{PUBLISHER}' AND seq > 3")
log_query("log_limit", lambda log: L.scan(log, QueryFilters(after_seq=2, limit=100)), "seq > 2", "ORDER BY publisher_id, seq LIMIT 100")
log_query("log_selector", lambda log: L.scan(log, exprs.parse_query_selector("events/_store/*?after_seq=10;before_seq=20&shape=x")), "seq > 10 AND seq < 20")
log_query("replay_all", lambda log: L.replay(log), HLC)
log_query("replay_hlc_range", lambda log: L.replay(log, ReplayFilters(after_hlc=(T1, 1), before_hlc=(T2, 0), key_prefix="c", limit=100)),
          f"{HLC} AND {AFTER} AND hlc_physical_ns < {T2} AND starts_with(key, 'c')",
          "ORDER BY hlc_physical_ns, hlc_logical, publisher_id, seq LIMIT 100")
log_query("replay_key", lambda log: L.replay(log, ReplayFilters(key=f"click/{PUBLISHER}", key_prefix="ignored")), f"{HLC} AND key = 'click/{PUBLISHER}'")
log_query("replay_key_prefix", lambda log: L.replay(log, ReplayFilters(key_prefix="pu")), f"{HLC} AND starts_with(key, 'pu')")
log_query("replay_publisher", lambda log: L.replay(log, ReplayFilters(publisher_id=PUBLISHER)), f"{HLC} AND publisher_id = '{PUBLISHER}'")
log_query("replay_selector", lambda log: L.replay(log, exprs.parse_replay_selector(f"x?after_hlc={T1}:1&key_prefix=vi")),
          f"{HLC} AND {AFTER} AND starts_with(key, 'vi')")
log_query("subscribe_partitions", lambda log: L.subscribe(log, partitions=[1, 4, 9]), "partition IN (1, 4, 9)")
log_query("subscribe_key_prefix", lambda log: L.subscribe(log, key_prefix="click"), "key = 'click' OR starts_with(key, 'click/')")
log_query("subscribe_patterns", lambda log: L.subscribe(log, patterns=["events/p/3/**", "events/p/*/k/purchase/*/*"]),
          "starts_with(key_expr, 'events/p/3/') OR regexp_matches(key_expr, '^events/p/[^/]+/k/purchase/[^/]+/[^/]+$')")
log_query("query_by_key", lambda log: L.by_key(log, f"click/{PUBLISHER}", 20), f"key = 'click/{PUBLISHER}'", "ORDER BY publisher_id, seq LIMIT 20")
log_query("publisher_cache", lambda log: L.publisher_cache(log, 16, after_seq=20), "true",
          "QUALIFY row_number() OVER (PARTITION BY publisher_id ORDER BY ts_ns DESC, seq DESC) <= 16 AND seq >= 20")
log_query("gc_before", lambda log: L.collect_garbage(log, T1), f"ts_ns >= {T1}")
NEW = "row_number() OVER (PARTITION BY partition ORDER BY ts_ns DESC, publisher_id DESC, seq DESC)"
log_query("retention_max_events", lambda log: L.retain_newest(log, max_events=50), "true", f"QUALIFY {NEW} <= 50")
BYTES = "sum(strlen(payload)) OVER (PARTITION BY partition ORDER BY ts_ns DESC, publisher_id DESC, seq DESC ROWS UNBOUNDED PRECEDING)"
log_query("retention_max_bytes", lambda log: L.retain_newest(log, max_bytes=500), "true", f"QUALIFY {BYTES} <= 500")


@query("replay_fallback", f"""WITH {LOG_SQL} SELECT partition, publisher_id, seq, event_id, ts_ns, key,
  coalesce(hlc_physical_ns, ts_ns) AS hlc_physical_ns, coalesce(hlc_logical, 0) AS hlc_logical, CAST(strlen(payload) AS INTEGER) AS payload_size FROM log""")  # fmt: skip
def replay_fallback(spark, sf_dir):
    """Rows without a clock take part by their timestamp."""
    return out(L.replay(event_log(spark, sf_dir), fallback=True))


@query("replay_page_2", log_sql(HLC, "ORDER BY hlc_physical_ns, hlc_logical, publisher_id, seq LIMIT 100 OFFSET 100"))
def replay_page_2(spark, sf_dir):
    """The second page behind the full cursor of the first one's last row."""
    log = event_log(spark, sf_dir)
    last = L.page_after(log, None, 100).orderBy(*[F.col(c).desc() for c in L.REPLAY_ORDER]).first()
    cursor = (last.hlc_physical_ns, last.hlc_logical, last.publisher_id, last.seq)
    return out(L.page_after(log, cursor, 100))


NEWEST = "QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY seq DESC, publisher_id) = 1"
V_OUT = "publisher_id, seq, o_orderkey, key, key_expr, CAST(strlen(payload) AS INTEGER) AS payload_size"


def v_out(rows: DataFrame) -> DataFrame:
    return rows.select("publisher_id", "seq", "o_orderkey", "key", "key_expr", F.length("payload").alias("payload_size"))


def version_query(name: str, make, sql: str) -> None:
    query(name, f"WITH {VERSIONS_SQL} {sql}")(lambda spark, sf_dir: v_out(make(order_versions(spark, sf_dir))))


COMPACTED = f"""(SELECT * FROM versions WHERE key IS NOT NULL {NEWEST.format(by="key")} UNION ALL SELECT * FROM versions WHERE key IS NULL)"""
version_query("latest_by_keys", lambda v: L.latest_by_keys(v, [f"cust/{i}" for i in range(1, 60)]),
              f"SELECT {V_OUT} FROM versions WHERE key IN (SELECT 'cust/' || i FROM range(1, 60) t(i)) {NEWEST.format(by='key')}")
version_query("compact_key_expr", L.compact, f"SELECT {V_OUT} FROM versions {NEWEST.format(by='key_expr')}")
version_query("compact_keyed", L.compact_keyed, f"SELECT {V_OUT} FROM {COMPACTED}")
version_query("tombstones_removed", lambda v: L.without_tombstones(L.compact_keyed(v)), f"SELECT {V_OUT} FROM {COMPACTED} WHERE strlen(payload) > 0")


@query("compaction_stats", f"""WITH {VERSIONS_SQL} SELECT count(*) FILTER (rn > 1) AS removed, count(*) FILTER (rn = 1) AS retained
  FROM (SELECT row_number() OVER (PARTITION BY key ORDER BY seq DESC, publisher_id) AS rn FROM versions WHERE key IS NOT NULL)""")  # fmt: skip
def compaction_stats(spark, sf_dir):
    """Rows that a keyed compaction removes and keeps: counts of rows and of keys, without sorting."""
    rows = order_versions(spark, sf_dir).where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    return rows.agg(F.sum(F.col("n") - 1).alias("removed"), F.count("*").alias("retained"))


@query("gc_count", f"WITH {LOG_SQL} SELECT count(*) AS removed FROM log WHERE ts_ns < {T1}")
def gc_count(spark, sf_dir):
    return event_log(spark, sf_dir).where(F.col("ts_ns") < T1).agg(F.count("*").alias("removed"))


@query("upsert_idempotent", log_sql())
def upsert_idempotent(spark, sf_dir):
    """Storing the same batch twice leaves the log as it was."""
    log = event_log(spark, sf_dir).withColumn("arrived", F.lit(0))
    again = log.where("seq % 3 = 0").withColumn("arrived", F.lit(1))
    return out(L.upsert(L.upsert(log, again, "arrived"), again.withColumn("arrived", F.lit(2)), "arrived"))


@query("extract_key_partition", f"""WITH {LOG_SQL} SELECT key_expr, partition AS found_partition, key AS found_key, false AS internal FROM log
  UNION ALL SELECT 'events/_watermark', 0, NULL, true""")  # fmt: skip
def extract_key_partition(spark, sf_dir):
    """Partition and key parsed out of the path alone."""
    rows = event_log(spark, sf_dir).select("key_expr").unionByName(spark.createDataFrame([("events/_watermark",)], "key_expr string"))
    p = F.col("key_expr")
    return rows.select(p, exprs.extract_partition(p).alias("found_partition"), exprs.extract_key(p).alias("found_key"), exprs.is_internal(p).alias("internal"))


@query("event_summary", f"""WITH {LOG_SQL} SELECT publisher_id, seq, partition, key, CAST(strlen(payload) AS INTEGER) AS payload_size, ts FROM log""")
def event_summary(spark, sf_dir):
    return event_log(spark, sf_dir).select("publisher_id", "seq", "partition", "key", F.length("payload").alias("payload_size"), "ts")


@query("http_events_page", f"""WITH {LOG_SQL}, p AS (SELECT * FROM log WHERE partition = 3 ORDER BY partition, seq, publisher_id LIMIT 51)
  SELECT partition, publisher_id, seq, key, base64(encode(payload)) AS payload_base64, payload AS payload_text, (SELECT count(*) > 50 FROM p) AS has_more
  FROM (SELECT *, row_number() OVER (ORDER BY partition, seq, publisher_id) AS n FROM p) WHERE n <= 50""")  # fmt: skip
def http_events_page(spark, sf_dir):
    rows = L.event_page(event_log(spark, sf_dir), 50, partition=3)
    text = F.try_validate_utf8(F.col("payload").cast("string"))
    return rows.select("partition", "publisher_id", "seq", "key", F.base64("payload").alias("payload_base64"), text.alias("payload_text"), "has_more")


@query("key_partition", f"WITH {LOG_SQL} SELECT DISTINCT key, CAST(CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % 64 AS INTEGER) AS key_partition FROM log WHERE key IS NOT NULL")
def key_partition(spark, sf_dir):
    from logweave.sources.adapters import stable_partition

    return event_log(spark, sf_dir).where("key is not null").select("key", stable_partition(F.col("key"), 64).alias("key_partition")).distinct()


@query("round_robin_partition", f"""WITH {LOG_SQL} SELECT publisher_id, seq, CAST((row_number() OVER (PARTITION BY publisher_id ORDER BY seq) - 1) % 8 AS INTEGER) AS partition FROM log""")
def round_robin_partition(spark, sf_dir):
    rows = event_log(spark, sf_dir).select("publisher_id", "seq")
    return S.round_robin(rows, 8, [F.col("seq")]).select("publisher_id", "seq", "partition")


@query("sequence_assign", f"""WITH {LOG_SQL} SELECT partition, publisher_id, event_id, row_number() OVER (PARTITION BY partition, publisher_id ORDER BY ts, event_no) - 1 AS seq FROM log""")
def sequence_assign(spark, sf_dir):
    rows = event_log(spark, sf_dir).select("partition", "publisher_id", "event_id", "ts", "event_no")
    return S.assign_sequence(rows, [F.col("ts"), F.col("event_no")]).select("partition", "publisher_id", "event_id", "seq")
