"""Cluster views, health, alerts, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _age(ts: Column, now: str) -> Column:
    return F.timestamp_diff("SECOND", ts, F.lit(now).cast("timestamp_ntz"))


def latest(rows: DataFrame, by: str, ts: str = "ts") -> DataFrame:
    """The newest row per value of `by`; ties by the whole row."""
    rest = [c for c in rows.columns if c != by]
    best = F.max_by(F.struct(*rest), F.struct(ts, *[c for c in rest if c != ts])).alias("b")
    return rows.groupBy(by).agg(best).select(by, "b.*")


def cluster_view(statuses: DataFrame, health: DataFrame, liveness: DataFrame, now: str, evict_after: int = 300) -> DataFrame:
    """One row per node known from any stream: node_id, online, partitions, cpu, last_seen; long offline nodes are gone.

    statuses: node_id, ts, partitions; health: node_id, ts, cpu; liveness: node_id, ts, kind (put or delete)."""
    s = latest(statuses, "node_id").select("node_id", F.col("ts").alias("s_ts"), "partitions")
    h = latest(health, "node_id").select("node_id", F.col("ts").alias("h_ts"), "cpu")
    l = latest(liveness, "node_id").select("node_id", F.col("ts").alias("l_ts"), "kind")  # noqa: E741
    view = s.join(h, "node_id", "full").join(l, "node_id", "full")
    view = view.withColumn("online", F.coalesce(F.col("kind") == "put", F.lit(False))).withColumn("last_seen", F.greatest("s_ts", "h_ts", "l_ts"))
    view = view.where(F.col("online") | (_age(F.col("last_seen"), now) <= evict_after))
    return view.select("node_id", "online", F.coalesce("partitions", F.lit(0)).alias("partitions"), "cpu", "last_seen")


def cluster_status(view: DataFrame) -> DataFrame:
    return view.agg(F.count("*").alias("total_nodes"), F.count_if("online").alias("online_nodes"), F.coalesce(F.sum("partitions"), F.lit(0)).cast("long").alias("total_partitions"))


def replica_counts(assignment: DataFrame, online: DataFrame) -> DataFrame:
    """partition, replicas on nodes that are online."""
    return assignment.join(online.select("node_id"), "node_id", "left_semi").groupBy("partition").agg(F.count("*").alias("replicas"))


def under_replicated(partitions: DataFrame, counts: DataFrame, factor: int) -> DataFrame:
    """partition, replicas, severity: critical without any replica, else warning."""
    rows = partitions.select("partition").join(counts, "partition", "left").select("partition", F.coalesce("replicas", F.lit(0)).alias("replicas"))
    return rows.where(F.col("replicas") < factor).withColumn("severity", F.when(F.col("replicas") == 0, "critical").otherwise("warning"))


def node_alerts(view: DataFrame, now: str, critical_after: int = 60) -> DataFrame:
    """Offline nodes: warning, and critical when they have been away for longer."""
    age = _age(F.col("last_seen"), now)
    return view.where("not online").select("node_id", age.alias("offline_seconds"), F.when(age > critical_after, "critical").otherwise("warning").alias("severity"))


def keep_newest(rows: DataFrame, n: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The last n rows, of each group if `by` names one: ring buffers of alerts, events and lag reports."""
    if not by:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def store_tracker(events: DataFrame) -> DataFrame:
    """node_id, online, first_seen, last_seen from liveness events (node_id, ts, kind)."""
    last = F.max_by("kind", F.struct("ts", "kind"))
    return events.groupBy("node_id").agg((last == "put").alias("online"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def replica_lists(partitions: DataFrame, assignment: DataFrame) -> DataFrame:
    """partition, nodes array (empty without assignment)."""
    lists = assignment.groupBy("partition").agg(F.sort_array(F.collect_list(F.struct("replica", "node_id")))["node_id"].alias("nodes"))
    return partitions.select("partition").join(lists, "partition", "left").select("partition", F.coalesce("nodes", F.array().cast("array<string>")).alias("nodes"))


def node_partitions(assignment: DataFrame, node: str) -> DataFrame:
    """topic, partitions of a node that is named by its id or the beginning of it."""
    rows = assignment.where(F.col("node_id").startswith(node))
    return rows.groupBy("topic").agg(F.sort_array(F.collect_set("partition")).alias("partitions"))


def schema_registry(puts: DataFrame) -> DataFrame:
    """topic, version, codec, partitions, conflict: registrations (topic, version, codec, partitions, put_no) in order.

    A higher version replaces; the same version must have the same wire contract, else it is a conflict and the first
    one stays."""
    first = puts.withColumn("__rn", F.row_number().over(Window.partitionBy("topic", "version").orderBy("put_no"))).where("__rn = 1")
    clash = puts.groupBy("topic", "version").agg((F.count_distinct(F.struct("codec", "partitions")) > 1).alias("conflict"))
    rows = first.join(clash, ["topic", "version"])
    best = F.max_by(F.struct("version", "codec", "partitions", "conflict"), "version").alias("b")
    return rows.groupBy("topic").agg(best).select("topic", "b.*")


def membership(events: DataFrame) -> DataFrame:
    """group_id, event_no, member_id, kind, effective, generation: join and leave events in order; the generation rises with
    each that changes the set of members."""
    own = Window.partitionBy("group_id", "member_id").orderBy("event_no")
    before = F.coalesce(F.lag("kind").over(own), F.lit("leave"))
    rows = events.withColumn("effective", F.col("kind") != before)
    upto = Window.partitionBy("group_id").orderBy("event_no")
    return rows.withColumn("generation", F.sum(F.col("effective").cast("long")).over(upto))


def client_counts(events: DataFrame) -> DataFrame:
    """topic, publishers, consumers that are alive, from liveness events (topic, client_id, role, ts, kind)."""
    last = events.groupBy("topic", "client_id", "role").agg(F.max_by("kind", F.struct("ts", "kind")).alias("kind")).where("kind = 'put'")
    return last.groupBy("topic").agg(F.count_if(F.col("role") == "publisher").alias("publishers"), F.count_if(F.col("role") == "consumer").alias("consumers"))


def assigned_total(assignment: DataFrame) -> DataFrame:
    """node_id, partitions over all topics."""
    return assignment.groupBy("node_id").agg(F.count("*").alias("partitions"))


def puts_only(samples: DataFrame) -> DataFrame:
    """Samples that carry data: puts whose path is no control traffic."""
    return samples.where((F.col("kind") == "put") & ~F.col("key_expr").contains("/_"))
