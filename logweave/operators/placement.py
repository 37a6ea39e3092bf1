"""Partitioning and placement: highest-random-weight assignment of partitions and replicas to nodes.

Node tables are small by nature (one row per machine), so partitions are scored against a broadcast of them; the result
has one row per partition and replica."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores use the first 52 bits of md5, which doubles hold exactly and other engines compute alike.
HASH_SPACE = float(1 << 52)
#: Node tables above this number are not broadcast.
BROADCAST_NODES = 100_000


def pair_hash(partition: Column, node: Column) -> Column:
    text = F.concat_ws(":", partition.cast("string"), node)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")


def weighted_score(hash_: Column, capacity: Column) -> Column:
    """-capacity / ln((h + 1) / (space + 2)): the node with the highest score wins in proportion to its capacity."""
    return -capacity / F.log((hash_ + 1.0) / F.lit(HASH_SPACE + 2.0))


def scored(partitions: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per partition and node: partition, node_id, rack, capacity, hash, score."""
    side = nodes.select("node_id", "capacity", "rack")
    side = F.broadcast(side) if nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else side
    pairs = partitions.select("partition").join(side, F.lit(True))
    h = pair_hash(F.col("partition"), F.col("node_id"))
    return pairs.withColumn("hash", h).withColumn("score", weighted_score(F.col("hash"), F.col("capacity")))


def partition_range(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("partition"))


def assign(partitions: DataFrame, nodes: DataFrame) -> DataFrame:
    """partition, node_id: the unweighted winner of each partition; of equal hashes the smaller id."""
    w = Window.partitionBy("partition").orderBy(F.col("hash").desc(), "node_id")
    return scored(partitions, nodes).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("partition", "node_id")


def _best(w_by: tuple = ("partition",)):
    return Window.partitionBy(*w_by).orderBy(F.col("score").desc(), "node_id")


def replicas(partitions: DataFrame, nodes: DataFrame, factor: int) -> DataFrame:
    """partition, replica (0-based), node_id: the nodes with the highest weighted scores."""
    rows = scored(partitions, nodes).withColumn("rn", F.row_number().over(_best())).where(F.col("rn") <= factor)
    return rows.select("partition", (F.col("rn") - 1).alias("replica"), "node_id")


def replicas_rack_aware(partitions: DataFrame, nodes: DataFrame, factor: int) -> DataFrame:
    """Replicas on different racks first: the best node of each rack by score, then the others by score. Nodes without a rack
    share one."""
    rows = scored(partitions, nodes).withColumn("rack", F.coalesce("rack", F.lit("")))
    rows = rows.withColumn("again", F.row_number().over(_best(("partition", "rack"))) > 1)
    w = Window.partitionBy("partition").orderBy("again", F.col("score").desc(), "node_id")
    rows = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= factor)
    return rows.select("partition", (F.col("rn") - 1).alias("replica"), "node_id")


def with_overrides(assignment: DataFrame, overrides: DataFrame, now: str | None = None) -> DataFrame:
    """partition, replica, node_id, overridden: a live override of (partition, replica) replaces the computed node."""
    live = overrides
    if now is not None:
        live = live.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp_ntz")))
    live = newest_overrides(live).select("partition", "replica", F.col("node_id").alias("__to"))
    joined = assignment.join(live, ["partition", "replica"], "left")
    return joined.select("partition", "replica", F.coalesce("__to", "node_id").alias("node_id"), F.col("__to").isNotNull().alias("overridden"))


def newest_overrides(overrides: DataFrame) -> DataFrame:
    """The override with the highest epoch of each (partition, replica)."""
    rest = [c for c in overrides.columns if c not in ("partition", "replica")]
    best = F.max_by(F.struct(*rest), F.struct("epoch", "node_id")).alias("b")
    return overrides.groupBy("partition", "replica").agg(best).select("partition", "replica", "b.*")


def upsert_overrides(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new, ["partition", "replica"], "left_anti").unionByName(new)


def without_node(overrides: DataFrame, node_id: str) -> DataFrame:
    """Overrides after a node's drain is taken back."""
    return overrides.where(F.col("node_id") != node_id)


def drain_plan(assignment: DataFrame, partitions: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """partition, replica, node_id: where each replica on a node goes, the best other node for its partition by rack-aware order."""
    best = replicas_rack_aware(partitions, nodes.where(F.col("node_id") != node_id), 1).select("partition", F.col("node_id").alias("to"))
    return assignment.where(F.col("node_id") == node_id).join(best, "partition").select("partition", "replica", F.col("to").alias("node_id"))


def rebalance(old: DataFrame, new: DataFrame) -> DataFrame:
    """partition, node_id, change: what nodes gain and lose between two assignments."""
    a, b = old.select("partition", "node_id"), new.select("partition", "node_id")
    return b.subtract(a).withColumn("change", F.lit("gained")).unionByName(a.subtract(b).withColumn("change", F.lit("lost")))


def reconcile(desired: DataFrame, actual: DataFrame) -> DataFrame:
    """partition, replica, action on one node: start what is desired and not there; drain what is there and not desired,
    unless it is draining already (state)."""
    keys = ["partition", "replica"]
    start = desired.select(*keys).join(actual.select(*keys), keys, "left_anti").withColumn("action", F.lit("start"))
    drain = actual.where("state <> 'draining'").select(*keys).join(desired.select(*keys), keys, "left_anti").withColumn("action", F.lit("drain"))
    return start.distinct().unionByName(drain.distinct())


def labels_fit(labels: Column, required: Column, excluded: Column) -> Column:
    """All required labels agree and none of the excluded does."""
    has = lambda e: labels[e["key"]].eqNullSafe(e["value"])
    every = F.forall(F.map_entries(F.coalesce(required, F.create_map().cast("map<string,string>"))), has)
    none = ~F.exists(F.map_entries(F.coalesce(excluded, F.create_map().cast("map<string,string>"))), has)
    return every & none


def eligible_nodes(topics: DataFrame, nodes: DataFrame) -> DataFrame:
    """topic, node_id pairs whose labels fit. Both are small configuration tables."""
    fits = labels_fit(F.col("labels"), F.col("required"), F.col("excluded"))
    return topics.join(F.broadcast(nodes), fits).select("topic", "node_id")


def distribution(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("node_id").agg(F.count("*").alias("partitions"))


def shard_of(publisher: Column, shards: int) -> Column:
    """Shard of a publisher in a subscriber's pipeline."""
    return F.pmod(F.conv(F.substring(F.md5(publisher.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")
