"""Queries over placement, cluster state, audits, processors and topologies."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.functions import exprs
from logweave.operators import audit as A
from logweave.operators import cluster as C
from logweave.operators import placement as P
from logweave.operators import processing as R
from logweave.operators import topology as Y
from logweave.sources.adapters import LOG_SQL, MANIFESTS_SQL, NODES_SQL, event_log, manifests, nodes, table

from .registry import query

N, FACTOR = 64, 3
SCORES = f"""{NODES_SQL},
pairs AS (SELECT CAST(p AS INTEGER) AS partition, node_id, capacity, rack, n, CAST(CAST('0x' || substr(md5(p || ':' || node_id), 1, 13) AS BIGINT) AS DOUBLE) AS hash FROM range({N}) t(p), nodes),
scores AS (SELECT *, -capacity / ln((hash + 1.0) / (4503599627370496.0 + 2.0)) AS score FROM pairs)
"""
TOP = f"top AS (SELECT partition, CAST(row_number() OVER (PARTITION BY partition ORDER BY score DESC, node_id) - 1 AS INTEGER) AS replica, node_id FROM scores QUALIFY replica < {FACTOR})"


def rack_sql(where: str = "true", factor: int = FACTOR, name: str = "racks") -> str:
    return f"""{name} AS (SELECT partition, CAST(row_number() OVER (PARTITION BY partition ORDER BY again, score DESC, node_id) - 1 AS INTEGER) AS replica, node_id FROM
      (SELECT *, row_number() OVER (PARTITION BY partition, coalesce(rack, '') ORDER BY score DESC, node_id) > 1 AS again FROM scores WHERE {where}) QUALIFY replica < {factor})"""


@query("hrw_assign", f"WITH {SCORES} SELECT partition, node_id FROM scores QUALIFY row_number() OVER (PARTITION BY partition ORDER BY hash DESC, node_id) = 1")
def hrw_assign(spark, sf_dir):
    return P.assign(P.partition_range(spark, N), nodes(spark, sf_dir))


@query("replicas_top_rf", f"WITH {SCORES}, {TOP} SELECT * FROM top")
def replicas_top_rf(spark, sf_dir):
    return P.replicas(P.partition_range(spark, N), nodes(spark, sf_dir), FACTOR)


@query("replicas_rack_aware", f"WITH {SCORES}, {rack_sql()} SELECT * FROM racks")
def replicas_rack_aware(spark, sf_dir):
    return P.replicas_rack_aware(P.partition_range(spark, N), nodes(spark, sf_dir), FACTOR)


@query("partition_distribution", f"WITH {SCORES}, {TOP} SELECT node_id, count(*) AS partitions FROM top GROUP BY node_id")
def partition_distribution(spark, sf_dir):
    return P.distribution(P.replicas(P.partition_range(spark, N), nodes(spark, sf_dir), FACTOR))


def _overrides(spark):
    return spark.range(N * 2).select(
        (F.col("id") % N).cast("int").alias("partition"), F.lit(0).alias("replica"), F.format_string("node-%06d", F.col("id") % 7 + 1).alias("node_id"),
        F.lit("manual").alias("reason"), F.col("id").alias("epoch"),
        F.when(F.col("id") % 5 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("expires_at"),
    ).where("epoch % 3 <> 1")


OVERRIDES_SQL = f"""overrides AS (SELECT CAST(id % {N} AS INTEGER) AS partition, 0 AS replica, 'node-' || lpad(CAST(id % 7 + 1 AS VARCHAR), 6, '0') AS node_id,
  id AS epoch, id % 5 = 0 AS expired FROM range({N * 2}) t(id) WHERE id % 3 <> 1)"""
NEWEST = "QUALIFY row_number() OVER (PARTITION BY partition, replica ORDER BY epoch DESC) = 1"


@query("assignment_with_overrides", f"""WITH {SCORES}, {TOP}, {OVERRIDES_SQL}, live AS (SELECT * FROM overrides WHERE NOT expired {NEWEST})
  SELECT t.partition, t.replica, coalesce(o.node_id, t.node_id) AS node_id, o.node_id IS NOT NULL AS overridden FROM top t LEFT JOIN live o USING (partition, replica)""")  # fmt: skip
def assignment_with_overrides(spark, sf_dir):
    base = P.replicas(P.partition_range(spark, N), nodes(spark, sf_dir), FACTOR)
    return P.with_overrides(base, _overrides(spark), now="2024-06-01 00:00:00")


@query("override_merge", f"WITH {OVERRIDES_SQL} SELECT partition, replica, node_id, epoch FROM overrides {NEWEST}")
def override_merge(spark, sf_dir):
    return P.newest_overrides(_overrides(spark)).select("partition", "replica", "node_id", "epoch")


@query("override_upsert", f"""WITH {OVERRIDES_SQL}, o AS (SELECT partition, replica, node_id, epoch FROM overrides WHERE epoch < 64), n AS (SELECT partition, replica, node_id, epoch FROM overrides WHERE epoch >= 64)
  SELECT * FROM o WHERE (partition, replica) NOT IN (SELECT partition, replica FROM n) UNION ALL SELECT * FROM n""")  # fmt: skip
def override_upsert(spark, sf_dir):
    rows = _overrides(spark).select("partition", "replica", "node_id", "epoch")
    return P.upsert_overrides(rows.where("epoch < 64"), rows.where("epoch >= 64"))


@query("undrain", f"WITH {OVERRIDES_SQL} SELECT partition, replica, node_id, epoch FROM overrides WHERE node_id <> 'node-000003'")
def undrain(spark, sf_dir):
    return P.without_node(_overrides(spark), "node-000003").select("partition", "replica", "node_id", "epoch")


@query("drain_plan", f"""WITH {SCORES}, {TOP}, {rack_sql("node_id <> 'node-000003'", 1)}
  SELECT t.partition, t.replica, r.node_id FROM top t JOIN racks r USING (partition) WHERE t.node_id = 'node-000003'""")  # fmt: skip
def drain_plan(spark, sf_dir):
    all_nodes, parts = nodes(spark, sf_dir), P.partition_range(spark, N)
    return P.drain_plan(P.replicas(parts, all_nodes, FACTOR), parts, all_nodes, "node-000003")


@query("rebalance_diff", f"""WITH {SCORES}, a AS (SELECT partition, node_id FROM scores QUALIFY row_number() OVER (PARTITION BY partition ORDER BY hash DESC, node_id) = 1),
  b AS (SELECT partition, node_id FROM scores WHERE n <> 2 QUALIFY row_number() OVER (PARTITION BY partition ORDER BY hash DESC, node_id) = 1)
  SELECT *, 'gained' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'lost' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")  # fmt: skip
def rebalance_diff(spark, sf_dir):
    parts, all_nodes = P.partition_range(spark, N), nodes(spark, sf_dir)
    return P.rebalance(P.assign(parts, all_nodes), P.assign(parts, all_nodes.where("n <> 2")))


@query("reconcile_actions", f"""WITH {SCORES}, {TOP}, want AS (SELECT partition, replica FROM top WHERE node_id = 'node-000001'),
  have AS (SELECT partition, replica, CASE WHEN partition % 4 = 0 THEN 'draining' ELSE 'active' END AS state FROM top WHERE node_id IN ('node-000001', 'node-000002') AND partition % 3 <> 0)
  SELECT partition, replica, 'start' AS action FROM want WHERE (partition, replica) NOT IN (SELECT partition, replica FROM have)
  UNION ALL SELECT partition, replica, 'drain' FROM have WHERE state <> 'draining' AND (partition, replica) NOT IN (SELECT partition, replica FROM want)""")  # fmt: skip
def reconcile_actions(spark, sf_dir):
    base = P.replicas(P.partition_range(spark, N), nodes(spark, sf_dir), FACTOR)
    have = base.where("node_id in ('node-000001', 'node-000002') and partition % 3 <> 0").withColumn("state", F.when(F.col("partition") % 4 == 0, "draining").otherwise("active"))
    return P.reconcile(base.where("node_id = 'node-000001'"), have)


@query("label_placement", f"""WITH {NODES_SQL} SELECT r_name AS topic, node_id FROM region, nodes
  WHERE (CASE WHEN r_regionkey % 2 = 0 THEN disk = 'ssd' ELSE true END) AND coalesce(rack, '') <> 'rack-' || (r_regionkey % 4)""")  # fmt: skip
def label_placement(spark, sf_dir):
    n = nodes(spark, sf_dir).withColumn("labels", F.create_map(F.lit("disk"), F.col("disk"), F.lit("rack"), F.coalesce("rack", F.lit(""))))
    topics = table(spark, sf_dir, "region").select(
        F.col("r_name").alias("topic"), F.when(F.col("r_regionkey") % 2 == 0, F.create_map(F.lit("disk"), F.lit("ssd"))).alias("required"),
        F.create_map(F.lit("rack"), F.concat(F.lit("rack-"), (F.col("r_regionkey") % 4).cast("string"))).alias("excluded"),
    )
    return P.eligible_nodes(topics, n)


@query("shard_routing", f"WITH {LOG_SQL} SELECT DISTINCT publisher_id, CAST(CAST('0x' || substr(md5(publisher_id), 1, 8) AS BIGINT) % 4 AS INTEGER) AS shard FROM log")
def shard_routing(spark, sf_dir):
    return event_log(spark, sf_dir).select("publisher_id", P.shard_of(F.col("publisher_id"), 4).alias("shard")).distinct()


# Control streams, derived from suppliers: two statuses, one health beacon and one liveness event per node
NOW = "2024-01-01 01:00:00"
STREAMS_SQL = f"""{NODES_SQL},
statuses AS (SELECT node_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(n * 60 + k * 30) AS ts, n * 2 + k AS partitions FROM nodes, range(2) t(k) WHERE n % 6 <> 5),
health AS (SELECT node_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(n * 61) AS ts, n / 100.0 AS cpu FROM nodes WHERE n % 4 <> 3),
liveness AS (SELECT node_id, TIMESTAMP '2024-01-01 00:20:00' + to_seconds(n * 59 + k * 5) AS ts, CASE WHEN k = 1 THEN 'delete' ELSE 'put' END AS kind
             FROM nodes, range(2) t(k) WHERE k = 0 OR n % 3 = 0),
ls AS (SELECT node_id, max(ts) AS s_ts, arg_max(partitions, ts) AS partitions FROM statuses GROUP BY node_id),
lh AS (SELECT node_id, max(ts) AS h_ts, arg_max(cpu, ts) AS cpu FROM health GROUP BY node_id),
ll AS (SELECT node_id, max(ts) AS l_ts, arg_max(kind, ts) AS kind FROM liveness GROUP BY node_id),
joined AS (SELECT node_id, coalesce(kind = 'put', false) AS online, coalesce(partitions, 0) AS partitions, cpu, greatest(s_ts, h_ts, l_ts) AS last_seen
           FROM ls FULL JOIN lh USING (node_id) FULL JOIN ll USING (node_id)),
cview AS (SELECT * FROM joined WHERE online OR epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_seen) < 1501000000)
"""


def _streams(spark, sf_dir):
    n = nodes(spark, sf_dir)
    at = lambda start, seconds: F.lit(f"2024-01-01 {start}").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    two = n.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    statuses = two.where("n % 6 <> 5").select("node_id", at("00:00:00", F.col("n") * 60 + F.col("k") * 30).alias("ts"), (F.col("n") * 2 + F.col("k")).alias("partitions"))
    health = n.where("n % 4 <> 3").select("node_id", at("00:00:00", F.col("n") * 61).alias("ts"), (F.col("n") / 100.0).alias("cpu"))
    live = two.where("k = 0 or n % 3 = 0").select("node_id", at("00:20:00", F.col("n") * 59 + F.col("k") * 5).alias("ts"), F.when(F.col("k") == 1, "delete").otherwise("put").alias("kind"))
    return statuses, health, live


def _view(spark, sf_dir):
    return C.cluster_view(*_streams(spark, sf_dir), now=NOW, evict_after=1500)


@query("cluster_view", f"WITH {STREAMS_SQL} SELECT * FROM cview")
def cluster_view(spark, sf_dir):
    return _view(spark, sf_dir)


@query("cluster_status", f"WITH {STREAMS_SQL} SELECT count(*) AS total_nodes, count(*) FILTER (online) AS online_nodes, CAST(coalesce(sum(partitions), 0) AS BIGINT) AS total_partitions FROM cview")
def cluster_status(spark, sf_dir):
    return C.cluster_status(_view(spark, sf_dir))


@query("node_alerts", f"""WITH {STREAMS_SQL}, a AS (SELECT node_id, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_seen)) // 1000000 AS offline_seconds FROM cview WHERE NOT online)
  SELECT node_id, offline_seconds, CASE WHEN offline_seconds > 60 THEN 'critical' ELSE 'warning' END AS severity FROM a""")  # fmt: skip
def node_alerts(spark, sf_dir):
    return C.node_alerts(_view(spark, sf_dir), NOW)


@query("store_tracker", f"WITH {STREAMS_SQL} SELECT node_id, arg_max(kind, ts) = 'put' AS online, min(ts) AS first_seen, max(ts) AS last_seen FROM liveness GROUP BY node_id")
def store_tracker(spark, sf_dir):
    return C.store_tracker(_streams(spark, sf_dir)[2])


UNDER = """up AS (SELECT node_id FROM nodes WHERE n % 3 <> 0), counts AS (SELECT partition, count(*) AS replicas FROM top WHERE node_id IN (SELECT node_id FROM up) GROUP BY partition)"""


@query("replica_counts", f"WITH {SCORES}, {TOP}, {UNDER} SELECT * FROM counts")
def replica_counts(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return C.replica_counts(P.replicas(P.partition_range(spark, N), n, FACTOR), n.where("n % 3 <> 0"))


@query("under_replicated", f"""WITH {SCORES}, {TOP}, {UNDER}, r AS (SELECT CAST(p AS INTEGER) AS partition, coalesce(replicas, 0) AS replicas FROM range({N}) t(p) LEFT JOIN counts ON partition = p)
  SELECT *, CASE WHEN replicas = 0 THEN 'critical' ELSE 'warning' END AS severity FROM r WHERE replicas < {FACTOR}""")  # fmt: skip
def under_replicated(spark, sf_dir):
    n, parts = nodes(spark, sf_dir), P.partition_range(spark, N)
    return C.under_replicated(parts, C.replica_counts(P.replicas(parts, n, FACTOR), n.where("n % 3 <> 0")), FACTOR)


@query("replica_lists", f"""WITH {SCORES}, {TOP}, few AS (SELECT * FROM top WHERE partition % 5 <> 0)
  SELECT CAST(p AS INTEGER) AS partition, coalesce(string_agg(node_id, ',' ORDER BY replica), '') AS nodes FROM range({N}) t(p) LEFT JOIN few ON partition = p GROUP BY p""")  # fmt: skip
def replica_lists(spark, sf_dir):
    parts = P.partition_range(spark, N)
    rows = C.replica_lists(parts, P.replicas(parts, nodes(spark, sf_dir), FACTOR).where("partition % 5 <> 0"))
    return rows.withColumn("nodes", F.array_join("nodes", ","))


@query("node_partitions", f"""WITH {SCORES}, {TOP} SELECT r_name AS topic, string_agg(CAST(partition AS VARCHAR), ',' ORDER BY partition) AS partitions
  FROM (SELECT DISTINCT r_name, partition FROM region, top WHERE starts_with(node_id, 'node-00000') AND (partition + r_regionkey) % 2 = 0) GROUP BY r_name""")  # fmt: skip
def node_partitions(spark, sf_dir):
    base = P.replicas(P.partition_range(spark, N), nodes(spark, sf_dir), FACTOR)
    topics = table(spark, sf_dir, "region").select(F.col("r_name").alias("topic"), "r_regionkey")
    rows = base.join(F.broadcast(topics), (F.col("partition") + F.col("r_regionkey")) % 2 == 0)
    return C.node_partitions(rows, "node-00000").withColumn("partitions", F.array_join(F.col("partitions").cast("array<string>"), ","))


@query("newest_lag_points", f"""WITH {LOG_SQL} SELECT partition, publisher_id, seq FROM log QUALIFY row_number() OVER (PARTITION BY partition ORDER BY ts_ns DESC, event_no DESC) <= 30""")
def newest_lag_points(spark, sf_dir):
    rows = C.keep_newest(event_log(spark, sf_dir), 30, [F.col("ts_ns").desc(), F.col("event_no").desc()], ["partition"])
    return rows.select("partition", "publisher_id", "seq")


@query("newest_events", f"WITH {LOG_SQL} SELECT event_id, ts FROM log ORDER BY ts_ns DESC, event_no DESC LIMIT 10")
def newest_events(spark, sf_dir):
    return C.keep_newest(event_log(spark, sf_dir), 10, [F.col("ts_ns").desc(), F.col("event_no").desc()]).select("event_id", "ts")


@query("schema_registry", """WITH puts AS (SELECT 'topic-' || (c_custkey % 20) AS topic, (c_custkey // 20) % 9 AS version, CASE WHEN c_custkey % 13 = 0 THEN 'json' ELSE 'binary' END AS codec,
    CAST(16 AS INTEGER) AS partitions, c_custkey AS put_no FROM customer),
  f AS (SELECT * FROM puts QUALIFY row_number() OVER (PARTITION BY topic, version ORDER BY put_no) = 1),
  x AS (SELECT topic, version, count(DISTINCT codec || partitions) > 1 AS conflict FROM puts GROUP BY ALL)
  SELECT topic, version, codec, partitions, conflict FROM f JOIN x USING (topic, version) QUALIFY row_number() OVER (PARTITION BY topic ORDER BY version DESC) = 1""")  # fmt: skip
def schema_registry(spark, sf_dir):
    c = F.col("c_custkey")
    puts = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("topic-"), (c % 20).cast("string")).alias("topic"), F.expr("(c_custkey div 20) % 9").alias("version"),
        F.when(c % 13 == 0, "json").otherwise("binary").alias("codec"), F.lit(16).alias("partitions"), c.alias("put_no"),
    )
    return C.schema_registry(puts)


@query("group_membership", """WITH e AS (SELECT 'g' || (o_custkey % 5) AS group_id, 'm' || (o_custkey % 11) AS member_id, o_orderkey AS event_no,
    CASE WHEN o_orderkey % 3 = 0 THEN 'leave' ELSE 'join' END AS kind FROM orders),
  b AS (SELECT *, kind <> coalesce(lag(kind) OVER (PARTITION BY group_id, member_id ORDER BY event_no), 'leave') AS effective FROM e)
  SELECT *, CAST(sum(CAST(effective AS INT)) OVER (PARTITION BY group_id ORDER BY event_no) AS BIGINT) AS generation FROM b""")  # fmt: skip
def group_membership(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    tag = lambda p, n: F.concat(F.lit(p), (F.col("o_custkey") % n).cast("string"))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "leave").otherwise("join")
    return C.membership(o.select(tag("g", 5).alias("group_id"), tag("m", 11).alias("member_id"), F.col("o_orderkey").alias("event_no"), kind.alias("kind")))


# Audits
@query("missing_events", f"WITH {MANIFESTS_SQL} SELECT event_id FROM published WHERE event_id NOT IN (SELECT event_id FROM received)")
def missing_events(spark, sf_dir):
    return A.missing(*manifests(event_log(spark, sf_dir)))


@query("duplicate_events", f"WITH {MANIFESTS_SQL} SELECT event_id, count(*) AS times FROM received GROUP BY event_id HAVING count(*) > 1")
def duplicate_events(spark, sf_dir):
    return A.duplicates(manifests(event_log(spark, sf_dir))[1])


@query("checksum_mismatches", f"""WITH {MANIFESTS_SQL} SELECT r.event_id, p.checksum AS published, r.checksum AS received FROM received r JOIN published p USING (event_id) WHERE r.checksum <> p.checksum""")
def checksum_mismatches(spark, sf_dir):
    return A.checksum_mismatches(*manifests(event_log(spark, sf_dir)))


VIOLATIONS = "SELECT publisher_id, line, seq, previous_seq FROM (SELECT *, lag(seq) OVER (PARTITION BY publisher_id{by} ORDER BY line) AS previous_seq FROM received) WHERE seq < previous_seq"


@query("ordering_violations", f"WITH {MANIFESTS_SQL} {VIOLATIONS.format(by='')}")
def ordering_violations(spark, sf_dir):
    return A.ordering_violations(manifests(event_log(spark, sf_dir))[1])


@query("ordering_violations_partition", f"WITH {MANIFESTS_SQL} {VIOLATIONS.format(by=', partition')}")
def ordering_violations_partition(spark, sf_dir):
    return A.ordering_violations(manifests(event_log(spark, sf_dir))[1], per_partition=True)


@query("invariant_report", f"""WITH {MANIFESTS_SQL}, c AS (SELECT (SELECT count(DISTINCT event_id) FROM published) AS published, (SELECT count(*) FROM received) AS received,
   (SELECT count(*) FROM published WHERE event_id NOT IN (SELECT event_id FROM received)) AS missing,
   (SELECT count(*) FROM (SELECT event_id FROM received GROUP BY event_id HAVING count(*) > 1)) AS duplicates,
   (SELECT count(*) FROM received r JOIN published p USING (event_id) WHERE r.checksum <> p.checksum) AS mismatches,
   (SELECT count(*) FROM ({VIOLATIONS.format(by='')})) AS disordered)
  SELECT *, CASE WHEN missing + duplicates + mismatches = 0 THEN 'pass' ELSE 'fail' END AS verdict FROM c""")  # fmt: skip
def invariant_report(spark, sf_dir):
    return A.report(*manifests(event_log(spark, sf_dir)))


# Processors
@query("processor_filter", f"WITH {LOG_SQL} SELECT event_id, seq FROM log WHERE CAST('0x' || substr(md5(event_id), 1, 8) AS BIGINT) / 4294967296.0 >= 0.3")
def processor_filter(spark, sf_dir):
    return R.process(event_log(spark, sf_dir), "filter", drop_share=0.3).select("event_id", "seq")


@query("processor_map", f"""WITH {LOG_SQL} SELECT event_id, CASE WHEN event_no % 9 = 0 THEN 'not json' ELSE '{{"processed":true,"original":' || replace(payload, ' ', '') || '}}' END AS payload FROM log""")
def processor_map(spark, sf_dir):
    rows = event_log(spark, sf_dir).select("event_id", F.when(F.col("event_no") % 9 == 0, "not json").otherwise(F.col("payload").cast("string")).alias("payload"))
    return R.process(rows, "map")


@query("processor_delay", f"WITH {LOG_SQL} SELECT event_id, ts + INTERVAL 250 MILLISECOND AS ts FROM log")
def processor_delay(spark, sf_dir):
    return R.process(event_log(spark, sf_dir), "delay", delay_ms=250).select("event_id", "ts")


ATTEMPTS = "att AS (SELECT event_id, CAST(k AS BIGINT) AS attempt_no, (event_no * 7 + k * 3) % 5 = 0 AS ok FROM log, range(1, 9) t(k))"


@query("dlq_outcomes", f"""WITH {LOG_SQL}, {ATTEMPTS}, r AS (SELECT *, coalesce(sum(CAST(ok AS INT)) OVER (PARTITION BY event_id ORDER BY attempt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM att),
  f AS (SELECT event_id, attempt_no, ok, CAST(CASE WHEN ok THEN 0 ELSE row_number() OVER (PARTITION BY event_id, run ORDER BY attempt_no) END AS INTEGER) AS failures FROM r),
  o AS (SELECT *, CASE WHEN ok THEN 'ack' WHEN failures >= 3 THEN 'dlq' ELSE 'retry' END AS outcome FROM f)
  SELECT *, CASE WHEN outcome = 'retry' THEN CAST(least(100 * pow(2, failures - 1), 1000) AS BIGINT) END AS delay_ms FROM o""")  # fmt: skip
def dlq_outcomes(spark, sf_dir):
    rows = event_log(spark, sf_dir).withColumn("attempt_no", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))))
    rows = rows.select("event_id", "attempt_no", ((F.col("event_no") * 7 + F.col("attempt_no") * 3) % 5 == 0).alias("ok"))
    return R.retry_outcomes(rows, 3, 100, 1000)


@query("backoff_delays", "SELECT k AS attempt, CAST(50 AS BIGINT) AS fixed_ms, CAST(least(50 * pow(2, k), 30000) AS BIGINT) AS exponential_ms FROM range(40) t(k)")
def backoff_delays(spark, sf_dir):
    a = F.col("id")
    return spark.range(40).select(a.alias("attempt"), exprs.backoff_ms(a, 50).alias("fixed_ms"), exprs.backoff_ms(a, 50, 30_000).alias("exponential_ms"))


SAMPLES = "s AS (SELECT publisher_id AS consumer, ts, (event_no % 10) / 10.0 AS fullness, CASE WHEN event_no % 4 = 0 THEN 0 ELSE event_no % 20000 END AS lag FROM log)"


@query("slow_consumer_debounce", f"""WITH {LOG_SQL}, {SAMPLES}, r AS (SELECT *, sum(CAST(NOT (fullness > 0.5 OR lag > 6000) AS INT)) OVER (PARTITION BY consumer ORDER BY ts) AS run FROM s),
  o AS (SELECT *, epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY consumer, run)) AS over_us FROM r WHERE fullness > 0.5 OR lag > 6000)
  SELECT consumer, ts, over_us FROM o WHERE over_us > 3600000000""")  # fmt: skip
def slow_consumer_debounce(spark, sf_dir):
    log = event_log(spark, sf_dir)
    lag = F.when(F.col("event_no") % 4 == 0, 0).otherwise(F.col("event_no") % 20_000)
    samples = log.select(F.col("publisher_id").alias("consumer"), "ts", ((F.col("event_no") % 10) / 10.0).alias("fullness"), lag.alias("lag"))
    return R.slow_consumers(samples, 0.5, 6000, 3_600_000_000)


@query("lifecycle_states")
def lifecycle_states(spark, sf_dir):
    """Transitions of all publishers with a day of inactivity and half a day of grace (an ordered fold: no SQL)."""
    rows = event_log(spark, sf_dir).select("publisher_id", F.expr("ts_ns div 1000").alias("at_us"))
    return R.lifecycle(rows, 1_710_000_000_000_000, 86_400_000_000, 43_200_000_000)


@query("latency_percentiles", """SELECT l_shipmode AS mode, count(*) AS n, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95,
   round(quantile_cont(v, 0.99), 6) AS p99, round(avg(v), 4) AS mean FROM (SELECT l_returnflag AS l_shipmode, l_extendedprice / l_quantity AS v FROM lineitem) GROUP BY l_shipmode""")  # fmt: skip
def latency_percentiles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("mode"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    got = R.latency_summary(rows, F.col("v"), ["mode"])
    return got.select("mode", "n", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p95", "p99")], F.round("mean", 4).alias("mean"))


@query("interval_rates", f"""WITH {LOG_SQL}, t AS (SELECT publisher_id AS source, (ts_ns // 86400000000000) AS tick, count(*) AS n FROM log GROUP BY ALL),
  u AS (SELECT source, tick, CAST(sum(n) OVER (PARTITION BY source ORDER BY tick) AS BIGINT) AS total FROM t)
  SELECT source, tick, total, CAST(floor(greatest(total - lag(total, 1, 0) OVER (PARTITION BY source ORDER BY tick), 0) / 2) AS BIGINT) AS per_second FROM u""")  # fmt: skip
def interval_rates(spark, sf_dir):
    from pyspark.sql import Window

    ticks = event_log(spark, sf_dir).groupBy(F.col("publisher_id").alias("source"), F.expr("ts_ns div 86400000000000").alias("tick")).agg(F.count("*").alias("n"))
    ticks = ticks.withColumn("total", F.sum("n").over(Window.partitionBy("source").orderBy("tick"))).drop("n")
    return R.interval_rates(ticks)


@query("lag_sparkline", f"""WITH {LOG_SQL} SELECT publisher_id AS group_id, seq AS value, seq / greatest(max(seq) OVER (PARTITION BY publisher_id), 1) AS height FROM log""")
def lag_sparkline(spark, sf_dir):
    return R.sparkline(event_log(spark, sf_dir).select(F.col("publisher_id").alias("group_id"), F.col("seq").alias("value")))


# Topologies: nations are topics, suppliers are components
COMPONENTS_SQL = """comp AS (SELECT s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'producer' WHEN 1 THEN 'consumer' WHEN 2 THEN 'processor' ELSE 'storage' END AS kind,
   CASE WHEN s_suppkey % 4 <> 2 THEN 't' || (s_nationkey % 12) END AS topic, CASE WHEN s_suppkey % 4 = 2 THEN 't' || (s_nationkey % 5) END AS input_topic,
   CASE WHEN s_suppkey % 4 = 2 THEN 't' || (s_suppkey % 7) END AS output_topic, CASE WHEN s_suppkey % 3 = 0 THEN 'binary' END AS codec FROM supplier),
  topics AS (SELECT 't' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'json' END AS codec FROM nation WHERE n_nationkey < 10)"""


def _components(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    kind = F.when(k == 0, "producer").when(k == 1, "consumer").when(k == 2, "processor").otherwise("storage")
    t = lambda c, n: F.concat(F.lit("t"), (F.col(c) % n).cast("string"))
    comp = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), kind.alias("kind"), F.when(k != 2, t("s_nationkey", 12)).alias("topic"), F.when(k == 2, t("s_nationkey", 5)).alias("input_topic"),
        F.when(k == 2, t("s_suppkey", 7)).alias("output_topic"), F.when(F.col("s_suppkey") % 3 == 0, "binary").alias("codec"),
    )
    topics = table(spark, sf_dir, "nation").where("n_nationkey < 10").select(
        F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "json").alias("codec")
    )
    return comp, topics


@query("config_inheritance", f"""WITH {COMPONENTS_SQL} SELECT c.name, c.kind, c.topic, coalesce(c.codec, t.codec, 'postcard') AS codec FROM comp c LEFT JOIN topics t ON c.topic = t.name""")
def config_inheritance(spark, sf_dir):
    return Y.inherit(*_components(spark, sf_dir), {"codec": "postcard"}).select("name", "kind", "topic", "codec")


@query("unknown_topics", f"""WITH {COMPONENTS_SQL}, u AS (SELECT name, topic FROM comp UNION SELECT name, input_topic FROM comp UNION SELECT name, output_topic FROM comp)
  SELECT name, topic FROM u WHERE topic IS NOT NULL AND topic NOT IN (SELECT name FROM topics)""")  # fmt: skip
def unknown_topics(spark, sf_dir):
    return Y.unknown_topics(*_components(spark, sf_dir))


@query("source_coverage", f"""WITH {COMPONENTS_SQL} SELECT topic FROM (SELECT topic FROM comp WHERE kind = 'consumer' UNION SELECT input_topic FROM comp) WHERE topic IS NOT NULL
  AND topic NOT IN (SELECT topic FROM comp WHERE kind = 'producer' AND topic IS NOT NULL UNION SELECT output_topic FROM comp WHERE output_topic IS NOT NULL)""")  # fmt: skip
def source_coverage(spark, sf_dir):
    return Y.uncovered_topics(_components(spark, sf_dir)[0])


@query("storage_coverage", f"WITH {COMPONENTS_SQL} SELECT name AS topic FROM topics WHERE name NOT IN (SELECT topic FROM comp WHERE kind = 'storage' AND topic IS NOT NULL)")
def storage_coverage(spark, sf_dir):
    comp, topics = _components(spark, sf_dir)
    return Y.unstored_topics(topics, comp)


@query("duplicate_components", "SELECT name, count(*) AS times FROM (SELECT substr(s_name, 1, length(s_name) - 1) AS name FROM supplier) GROUP BY name HAVING count(*) > 1")
def duplicate_components(spark, sf_dir):
    return Y.duplicate_names(table(spark, sf_dir, "supplier").select(F.expr("substr(s_name, 1, length(s_name) - 1)").alias("name")))


@query("pipeline_cycles", f"""WITH RECURSIVE {COMPONENTS_SQL}, e AS (SELECT DISTINCT input_topic AS a, output_topic AS b FROM comp WHERE kind = 'processor'),
  r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
  cyc AS (SELECT DISTINCT a AS t FROM r WHERE a = b)
  SELECT DISTINCT t AS topic FROM (SELECT t FROM cyc UNION SELECT x.b FROM r x JOIN r y ON x.b = y.a WHERE x.a IN (SELECT t FROM cyc) AND y.b IN (SELECT t FROM cyc))""")  # fmt: skip
def pipeline_cycles(spark, sf_dir):
    return Y.cyclic_topics(_components(spark, sf_dir)[0])


@query("offload_events")
def offload_events(spark, sf_dir):
    """Lifecycle of consumers that fall behind (an ordered fold: no SQL)."""
    from logweave.operators.offload import offload_events as fold

    log = event_log(spark, sf_dir)
    lag = F.when(F.col("event_no") % 4 == 0, 0).otherwise(F.col("event_no") % 20_000)
    full = F.when(F.col("event_no") % 3 == 0, 0.0).otherwise((F.col("event_no") % 10) / 10.0)
    samples = log.select(F.col("publisher_id").alias("consumer"), "ts", full.alias("fullness"), lag.cast("long").alias("lag"))
    return fold(samples, 0.5, 6000, 3_600_000_000, 50)


@query("chaos_timeline")
def chaos_timeline(spark, sf_dir):
    """A seeded timeline of faults against the nodes."""
    from logweave.sources import chaos

    actions = (chaos.Action("kill", 1.0, 5000), chaos.Action("pause", 2.0, 2000), chaos.Action("delay", 3.0))
    plan = chaos.Plan(0.5, 600_000, 1000, 2, actions, tuple(f"node-{i:06d}" for i in range(1, 11)))
    return chaos.timeline_table(spark, plan, seed=11)


CLIENTS_SQL = """cl AS (SELECT 'topic-' || (c_custkey % 6) AS topic, 'client-' || (c_custkey // 2) AS client_id, CASE WHEN c_nationkey % 3 = 0 THEN 'publisher' ELSE 'consumer' END AS role,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c_custkey) AS ts, CASE WHEN c_custkey % 5 = 0 THEN 'delete' ELSE 'put' END AS kind, c_custkey FROM customer)"""


def _clients(spark, sf_dir):
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("topic-"), (c % 6).cast("string")).alias("topic"), F.concat(F.lit("client-"), F.expr("cast(c_custkey div 2 as string)")).alias("client_id"),
        F.when(F.col("c_nationkey") % 3 == 0, "publisher").otherwise("consumer").alias("role"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, c_custkey)").alias("ts"), F.when(c % 5 == 0, "delete").otherwise("put").alias("kind"),
        F.concat(F.lit("clients/"), F.when(c % 7 == 0, "_internal/").otherwise(""), c.cast("string")).alias("key_expr"),
    )


@query("client_counts", f"""WITH {CLIENTS_SQL}, l AS (SELECT topic, client_id, role, arg_max(kind, ts) AS kind FROM cl GROUP BY ALL)
  SELECT topic, count(*) FILTER (role = 'publisher') AS publishers, count(*) FILTER (role = 'consumer') AS consumers FROM l WHERE kind = 'put' GROUP BY topic""")  # fmt: skip
def client_counts(spark, sf_dir):
    return C.client_counts(_clients(spark, sf_dir))


@query("puts_only", f"WITH {CLIENTS_SQL} SELECT client_id, ts FROM cl WHERE kind = 'put' AND c_custkey % 7 <> 0")
def puts_only(spark, sf_dir):
    return C.puts_only(_clients(spark, sf_dir)).select("client_id", "ts")


@query("total_assigned_partitions", f"""WITH {SCORES}, {TOP} SELECT node_id, count(*) AS partitions FROM top, region WHERE (partition + r_regionkey) % 3 <> 0 GROUP BY node_id""")
def total_assigned_partitions(spark, sf_dir):
    base = P.replicas(P.partition_range(spark, N), nodes(spark, sf_dir), FACTOR)
    topics = table(spark, sf_dir, "region").select("r_regionkey")
    return C.assigned_total(base.join(F.broadcast(topics), (F.col("partition") + F.col("r_regionkey")) % 3 != 0))


@query("alerts_by_severity", f"""WITH {STREAMS_SQL}, a AS (SELECT node_id, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_seen)) // 1000000 AS s FROM cview WHERE NOT online)
  SELECT node_id, s AS offline_seconds FROM a WHERE s > 60 ORDER BY s DESC, node_id LIMIT 1000""")  # fmt: skip
def alerts_by_severity(spark, sf_dir):
    """The newest 1000 alerts of one severity."""
    rows = C.node_alerts(_view(spark, sf_dir), NOW).where("severity = 'critical'")
    return C.keep_newest(rows, 1000, [F.col("offline_seconds").desc(), F.col("node_id")]).select("node_id", "offline_seconds")
