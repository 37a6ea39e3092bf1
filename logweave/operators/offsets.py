"""Consumer-group offsets with generation fencing, and lag analytics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLOT = ("group_id", "partition", "publisher_id")


def fence(commits: DataFrame, order: str = "commit_no") -> DataFrame:
    """Commits of one publisher each, with accepted boolean: a generation below the highest so far is rejected.

    Rejected commits never raise that height, as they lie below it, so the running maximum over all commits is exact."""
    w = Window.partitionBy(*SLOT).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return commits.withColumn("accepted", F.col("generation") >= F.coalesce(F.max("generation").over(w), F.col("generation")))


def fence_atomic(commits: DataFrame, order: str = "commit_no") -> DataFrame:
    """Commits whose rows (one per publisher, same `order` value) stand or fall together.

    A commit with one stale row is rejected whole and raises nothing, which only an ordered fold can tell: one task per
    (group, partition), whose state is one number per publisher."""
    schema = T.StructType([*commits.schema.fields, T.StructField("accepted", T.BooleanType())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        height: dict = {}
        verdict = {}
        for number, rows in pdf.sort_values([order, "publisher_id"]).groupby(order, sort=True):
            pairs = list(zip(rows["publisher_id"], rows["generation"], strict=True))
            verdict[number] = all(g >= height.get(p, g) for p, g in pairs)
            if verdict[number]:
                height.update(pairs)
        return pdf.assign(accepted=pdf[order].map(verdict).astype(bool))

    return commits.groupBy("group_id", "partition").applyInPandas(fold, schema)


def latest_offsets(commits: DataFrame, order: str = "commit_no") -> DataFrame:
    """The last accepted commit per group, partition and publisher; its seq may be lower than earlier ones."""
    accepted = fence(commits, order).where("accepted")
    best = F.max_by(F.struct("seq", "generation", "member_id"), F.col(order)).alias("b")
    return accepted.groupBy(*SLOT).agg(best).select(*SLOT, "b.seq", "b.generation", "b.member_id")


def highest_offsets(commits: DataFrame) -> DataFrame:
    """What a lag monitor keeps: highest seq and time ever seen."""
    return commits.groupBy(*SLOT).agg(F.max("seq").alias("seq"), F.max("ts").alias("ts"))


def latest_keyed_offsets(commits: DataFrame, order: str = "commit_no") -> DataFrame:
    """Last accepted clock position per group and key filter (filter_kind, filter_value)."""
    slot = ["group_id", "filter_kind", "filter_value"]
    w = Window.partitionBy(*slot).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = commits.withColumn("__height", F.max("generation").over(w)).where("__height is null or generation >= __height")
    best = F.max_by(F.struct("hlc_physical_ns", "hlc_logical", "generation"), F.col(order)).alias("b")
    return rows.groupBy(*slot).agg(best).select(*slot, "b.hlc_physical_ns", "b.hlc_logical", "b.generation")


def lag_by_publisher(offsets: DataFrame, marks: DataFrame, include_uncommitted: bool = False) -> DataFrame:
    """group_id, partition, publisher_id, lag. A publisher without a watermark lags by 0; one without an offset isn't seen,
    unless `include_uncommitted`, which counts all its rows for every group of its partition."""
    keys = ["partition", "publisher_id"]
    marks = marks.select(*keys, F.col("committed_seq").alias("wm"))
    if include_uncommitted:
        groups = offsets.select("group_id", "partition").distinct()
        slots = groups.join(marks.select(*keys), "partition").select(*SLOT).unionByName(offsets.select(*SLOT)).distinct()
        offsets = slots.join(offsets.select(*SLOT, "seq"), list(SLOT), "left").withColumn("seq", F.coalesce("seq", F.lit(-1)))
    joined = offsets.select(*SLOT, "seq").join(marks, keys, "left")
    return joined.select(*SLOT, F.greatest(F.coalesce("wm", F.lit(0)) - F.col("seq"), F.lit(0)).cast("long").alias("lag"))


def consumer_lag(offsets: DataFrame, marks: DataFrame, include_uncommitted: bool = False) -> DataFrame:
    """group_id, partition, publishers map<string,long>, total_lag."""
    lags = lag_by_publisher(offsets, marks, include_uncommitted)
    per = F.map_from_entries(F.sort_array(F.collect_list(F.struct("publisher_id", "lag"))))
    return lags.groupBy("group_id", "partition").agg(per.alias("publishers"), F.sum("lag").alias("total_lag"))


def group_lag(offsets: DataFrame, marks: DataFrame, partitions: int | None = None) -> DataFrame:
    lags = lag_by_publisher(offsets, marks)
    if partitions is not None:
        lags = lags.where(F.col("partition") < partitions)
    return lags.groupBy("group_id").agg(F.sum("lag").alias("total_lag"), F.countDistinct("partition").alias("partitions"))


def stale_partitions(marks: DataFrame, now: str, seconds: int = 120) -> DataFrame:
    """partition, is_stale: whether any watermark (with ts) is older than the threshold."""
    old = F.timestamp_diff("MICROSECOND", F.col("ts"), F.lit(now).cast("timestamp_ntz")) > seconds * 1_000_000
    return marks.groupBy("partition").agg(F.bool_or(old).alias("is_stale"))


def known_groups(commits: DataFrame) -> DataFrame:
    return commits.select("group_id").distinct().orderBy("group_id")


def publisher_partitions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("publisher_id").agg(F.sort_array(F.collect_set("partition")).alias("partitions"))


def groups_with_members(lag: DataFrame, members: DataFrame) -> DataFrame:
    """Groups that have lag or live members (group_id, member_id): total lag and number of members."""
    live = members.groupBy("group_id").agg(F.countDistinct("member_id").alias("members"))
    joined = lag.select("group_id", "total_lag").join(live, "group_id", "full")
    return joined.select("group_id", F.coalesce("total_lag", F.lit(0)).alias("total_lag"), F.coalesce("members", F.lit(0)).alias("members"))


def expire(entries: DataFrame, now: str, seconds: int) -> DataFrame:
    """Entries (with ts) that are not older than the limit."""
    return entries.where(F.timestamp_diff("MICROSECOND", F.col("ts"), F.lit(now).cast("timestamp_ntz")) <= seconds * 1_000_000)


def reset_offsets(marks: DataFrame, group_id: str, to_latest: bool) -> DataFrame:
    """Offsets of a group that is set to the start or to the watermarks."""
    seq = F.col("committed_seq") if to_latest else F.lit(0).cast("long")
    return marks.select(F.lit(group_id).alias("group_id"), "partition", "publisher_id", seq.alias("seq"))


def lag_extremes(rows: DataFrame, positions: DataFrame) -> DataFrame:
    """One row: max_seq_lag, the largest distance of a publisher's newest number from a position, and behind_by, their sum."""
    keys = ["partition", "publisher_id"]
    tops = rows.groupBy(*keys).agg(F.max("seq").alias("top"))
    joined = tops.join(positions.select(*keys, F.col("seq").alias("at")), keys, "left")
    lag = F.greatest(F.col("top") - F.coalesce("at", F.lit(-1)), F.lit(0))
    return joined.agg(F.coalesce(F.max(lag), F.lit(0)).alias("max_seq_lag"), F.coalesce(F.sum(lag), F.lit(0)).cast("long").alias("behind_by"))


def replay_from_committed(log: DataFrame, committed: DataFrame, group_id: str) -> DataFrame:
    """Rows behind the clock position that a group has committed for its publishers' key filter (group_id, publisher_id,
    hlc_physical_ns, hlc_logical); publishers without one are read from the start."""
    at = committed.where(F.col("group_id") == group_id).select("publisher_id", F.struct("hlc_physical_ns", "hlc_logical").alias("__at"))
    rows = log.where("hlc_physical_ns is not null").join(at, "publisher_id", "left")
    return rows.where(F.col("__at").isNull() | (F.struct("hlc_physical_ns", "hlc_logical") > F.col("__at"))).drop("__at")
