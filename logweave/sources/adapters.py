"""The canonical tables of the engine, built from the star-schema test tables without actions.

Every table is a plain DataFrame over `spark.read.parquet`, so filters and column choices reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARTITIONS = 16
TOPIC = "events"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stable_partition(key: Column, partitions: int | Column) -> Column:
    """Portable hash partition: the first 32 bits of md5 modulo the number of partitions."""
    n = partitions if isinstance(partitions, Column) else F.lit(partitions)
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % n).cast("int")


def epoch_ns(ts: Column) -> Column:
    """Nanoseconds since 1970 of a timestamp without time zone; independent of the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) * 1000


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log: one publisher per user, sequence gaps where events are lost, some rows without key or hybrid clock."""
    ev = table(spark, sf_dir, "events").withColumn("publisher_id", F.lpad(F.col("user_id").cast("string"), 8, "0"))
    ev = ev.withColumn("seq", (F.row_number().over(Window.partitionBy("publisher_id").orderBy("ts", "event_id")) - 1).cast("long"))
    ev = ev.where("event_id % 17 <> 5").withColumn("partition", stable_partition(F.col("publisher_id"), PARTITIONS))
    key = F.when(F.col("event_id") % 7 != 0, F.concat_ws("/", "event_type", "publisher_id"))
    clock = F.col("event_id") % 29 != 0
    ev = ev.withColumn("key", key)
    path = F.concat_ws("/", F.lit(TOPIC), F.lit("p"), F.col("partition").cast("string"), F.when(key.isNotNull(), F.concat(F.lit("k/"), key)), F.col("seq").cast("string"))
    return ev.select(
        F.lit(TOPIC).alias("topic"), "partition", "publisher_id", "seq",
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"), F.col("event_id").alias("event_no"),
        "ts", epoch_ns(F.col("ts")).alias("ts_ns"), path.alias("key_expr"), "key",
        F.when(clock, epoch_ns(F.col("ts"))).alias("hlc_physical_ns"), F.when(clock, F.col("event_id") % 3).alias("hlc_logical"),
        F.encode("props", "utf-8").alias("payload"), "value",
    )


def arrivals(log: DataFrame) -> DataFrame:
    """The log as a subscriber receives it: some rows twelve hours late, some twice. Order: arrival_ts, event_no, copy."""
    late = F.when(F.col("event_no") % 10 == 3, F.expr("ts + INTERVAL '12' HOUR")).otherwise(F.col("ts"))
    copies = F.when(F.col("event_no") % 23 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return log.withColumn("arrival_ts", late).withColumn("copy", F.explode(copies))


def order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed log with many versions per key: orders by customer. The last version of every seventh customer is a tombstone."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    last = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    rows = table(spark, sf_dir, "orders").withColumn("seq", (F.row_number().over(by) - 1).cast("long"))
    emptied = (F.col("o_custkey") % 7 == 0) & (F.row_number().over(last) == 1)
    key = F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit("cust/"), F.col("o_custkey").cast("string")))
    return rows.select(
        F.concat(F.lit("w"), (F.col("o_custkey") % 3).cast("string")).alias("publisher_id"), "seq", "o_orderkey", key.alias("key"),
        F.concat(F.lit("orders/p/0/k/cust/"), F.col("o_custkey").cast("string")).alias("key_expr"), F.col("o_orderdate").alias("ts"),
        F.when(emptied, F.lit("")).otherwise(F.col("o_orderpriority")).cast("binary").alias("payload"),
    )


def offset_commits(log: DataFrame) -> DataFrame:
    """Commits of three groups: per publisher and group four commits in time, with rising generations and one stale one."""
    top = log.groupBy("partition", "publisher_id").agg(F.max("seq").alias("top"))
    grid = F.explode(F.array(*[F.struct(F.lit(f"g{g}").alias("group_id"), F.lit(g).alias("g"), F.lit(c).alias("c")) for g in range(3) for c in range(4)]))
    rows = top.where("cast(publisher_id as int) % 13 <> 4").withColumn("x", grid).select("partition", "publisher_id", "top", "x.*")
    generation = F.when((F.col("c") == 2) & (F.col("publisher_id").cast("int") % 5 == 0), 1).otherwise(F.col("c") + 1)
    return rows.select(
        "group_id", F.concat(F.lit("m"), F.col("c") % 2).alias("member_id"), "partition", "publisher_id",
        F.floor(F.col("top") * (F.col("c") + F.col("g") + 1) / 7).cast("long").alias("seq"),
        generation.cast("long").alias("generation"), F.col("c").cast("long").alias("commit_no"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,c,g,0)").alias("ts"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage nodes from suppliers: id, capacity, rack and labels."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.format_string("node-%06d", "s_suppkey").alias("node_id"), (100 + F.pmod(F.floor("s_acctbal").cast("long"), F.lit(3)) * 100).cast("int").alias("capacity"),
        F.when(F.col("s_suppkey") % 9 != 0, F.concat(F.lit("rack-"), (F.col("s_nationkey") % 4).cast("string"))).alias("rack"),
        F.when(F.col("s_suppkey") % 2 == 0, "ssd").otherwise("hdd").alias("disk"), F.col("s_nationkey").alias("zone"), F.col("s_suppkey").alias("n"),
    )


def manifests(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(published, received) manifests of a run: received lacks, repeats, alters and reorders some events."""
    entry = log.select("event_id", "event_no", "seq", "publisher_id", "partition", "ts", F.md5("payload").alias("checksum"))
    published = entry.withColumn("line", F.col("event_no"))
    copies = F.when(F.col("event_no") % 41 == 0, F.array(*map(F.lit, (0, 1, 2)))).when(F.col("event_no") % 23 == 0, F.array(F.lit(0), F.lit(1)))
    got = entry.where("event_no % 31 <> 0").withColumn("copy", F.explode(F.coalesce(copies, F.array(F.lit(0)))))
    got = got.withColumn("checksum", F.when(F.col("event_no") % 37 == 0, F.lit("altered")).otherwise(F.col("checksum")))
    got = got.withColumn("line", F.when(F.col("event_no") % 19 == 0, F.col("event_no") * 8 + 4004).otherwise(F.col("event_no") * 8) + F.col("copy"))
    return published, got


# The same tables in DuckDB's SQL, as common table expressions.
LOG_SQL = """
ev AS (SELECT *, lpad(CAST(user_id AS VARCHAR), 8, '0') AS publisher_id FROM events),
ev2 AS (SELECT *, row_number() OVER (PARTITION BY publisher_id ORDER BY ts, event_id) - 1 AS seq,
        CAST(CAST('0x' || substr(md5(publisher_id), 1, 8) AS BIGINT) % 16 AS INTEGER) AS part,
        CASE WHEN event_id % 7 <> 0 THEN event_type || '/' || publisher_id END AS k FROM ev),
log AS (SELECT 'events' AS topic, part AS partition, publisher_id, seq, lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id, event_id AS event_no, ts,
        epoch_us(ts) * 1000 AS ts_ns,
        'events/p/' || part || CASE WHEN k IS NULL THEN '' ELSE '/k/' || k END || '/' || seq AS key_expr, k AS key,
        CASE WHEN event_id % 29 <> 0 THEN epoch_us(ts) * 1000 END AS hlc_physical_ns,
        CASE WHEN event_id % 29 <> 0 THEN event_id % 3 END AS hlc_logical, props AS payload, value FROM ev2 WHERE event_id % 17 <> 5)
"""
ARRIVALS_SQL = LOG_SQL + """,
arrivals AS (SELECT log.*, CASE WHEN event_no % 10 = 3 THEN ts + INTERVAL 12 HOUR ELSE ts END AS arrival_ts, c.copy
             FROM log, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR event_no % 23 = 0)
"""
VERSIONS_SQL = """
ov AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seq,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders),
versions AS (SELECT 'w' || (o_custkey % 3) AS publisher_id, seq, o_orderkey,
       CASE WHEN o_orderkey % 11 <> 0 THEN 'cust/' || o_custkey END AS key, 'orders/p/0/k/cust/' || o_custkey AS key_expr, o_orderdate AS ts,
       CASE WHEN o_custkey % 7 = 0 AND back = 1 THEN '' ELSE o_orderpriority END AS payload FROM ov)
"""
COMMITS_SQL = LOG_SQL + """,
tops AS (SELECT partition, publisher_id, max(seq) AS top FROM log WHERE CAST(publisher_id AS INT) % 13 <> 4 GROUP BY ALL),
commits AS (SELECT 'g' || g AS group_id, 'm' || (c % 2) AS member_id, partition, publisher_id,
       CAST(floor(top * (c + g + 1) / 7) AS BIGINT) AS seq,
       CAST(CASE WHEN c = 2 AND CAST(publisher_id AS INT) % 5 = 0 THEN 1 ELSE c + 1 END AS BIGINT) AS generation, CAST(c AS BIGINT) AS commit_no,
       TIMESTAMP '2024-01-01 00:00:00' + to_hours(c) + to_minutes(g) AS ts
       FROM tops, range(3) r1(g), range(4) r2(c))
"""
NODES_SQL = """
nodes AS (SELECT 'node-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS node_id,
       CAST(100 + (((CAST(floor(s_acctbal) AS BIGINT) % 3) + 3) % 3) * 100 AS INTEGER) AS capacity,
       CASE WHEN s_suppkey % 9 <> 0 THEN 'rack-' || (s_nationkey % 4) END AS rack,
       CASE WHEN s_suppkey % 2 = 0 THEN 'ssd' ELSE 'hdd' END AS disk, s_nationkey AS zone, s_suppkey AS n FROM supplier)
"""
MANIFESTS_SQL = LOG_SQL + """,
published AS (SELECT event_id, event_no, seq, publisher_id, partition, ts, md5(payload) AS checksum, event_no AS line FROM log),
received AS (SELECT event_id, event_no, seq, publisher_id, partition, ts, CASE WHEN event_no % 37 = 0 THEN 'altered' ELSE checksum END AS checksum, copy,
       CASE WHEN event_no % 19 = 0 THEN event_no * 8 + 4004 ELSE event_no * 8 END + copy AS line
       FROM published, (VALUES (0), (1), (2)) c(copy)
       WHERE event_no % 31 <> 0 AND (copy = 0 OR (copy = 1 AND (event_no % 41 = 0 OR event_no % 23 = 0)) OR (copy = 2 AND event_no % 41 = 0)))
"""
