"""Sequence analytics: durability watermarks, gaps, duplicates, recovery and catch-up.

Gaps are found from neighbouring sequence numbers and never by enumerating [0, max], so work follows the rows that exist
and the numbers that are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STREAM = ("partition", "publisher_id")


def missing_ranges(log: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """partition, publisher_id, missed_start, missed_end (exclusive): runs of missing numbers below the highest one.

    Neighbours are compared within chunks of a stream's numbers, and across chunks from one row per chunk, so a publisher
    with a large share of all rows is many tasks. Repeated numbers are neighbours without a gap and need no distinct."""
    rows = log.select(*STREAM, "seq", F.expr(f"seq div {chunk}").alias("chunk"))
    before = F.lag("seq").over(Window.partitionBy(*STREAM, "chunk").orderBy("seq"))
    within = rows.withColumn("before", before).where("seq > before + 1").select(*STREAM, "before", "seq")
    ends = rows.groupBy(*STREAM, "chunk").agg(F.min("seq").alias("seq"), F.max("seq").alias("last"))
    last = F.lag("last", 1, -1).over(Window.partitionBy(*STREAM).orderBy("chunk")).cast("long")
    across = ends.withColumn("before", last).where("seq > before + 1").select(*STREAM, "before", "seq")
    return within.unionByName(across).select(*STREAM, (F.col("before") + 1).alias("missed_start"), F.col("seq").alias("missed_end"))


def gaps(log: DataFrame) -> DataFrame:
    """One row per missing number."""
    return missing_ranges(log).select(*STREAM, F.explode(F.sequence("missed_start", F.col("missed_end") - 1)).alias("seq"))


def watermarks(log: DataFrame, reopened: bool = False) -> DataFrame:
    """partition, publisher_id, committed_seq, gaps array<long> (sorted).

    Everything up to committed_seq is stored but for the gaps listed: it is the number before the smallest gap from 1 on,
    or the highest number. A missing 0 doesn't hold it back, except after a store was `reopened`, which then commits 0."""
    tops = log.groupBy(*STREAM).agg(F.max("seq").alias("top"))
    holes = missing_ranges(log).groupBy(*STREAM).agg(
        F.sort_array(F.flatten(F.collect_list(F.sequence("missed_start", F.col("missed_end") - 1)))).alias("gaps"),
        F.min(F.when(F.col("missed_end") > 1, F.greatest("missed_start", F.lit(1)))).alias("first"),
        F.min("missed_start").alias("lowest"),
    )
    committed = F.coalesce(F.col("first") - 1, "top")
    if reopened:
        committed = F.when(F.col("lowest") == 0, F.lit(0).cast("long")).otherwise(committed)
    return tops.join(holes, list(STREAM), "left").select(*STREAM, committed.alias("committed_seq"), F.coalesce("gaps", F.array().cast("array<long>")).alias("gaps"))


def durable(requests: DataFrame, marks: DataFrame) -> DataFrame:
    """`requests` (partition, publisher_id, seq) with durable boolean; streams without a watermark are not durable."""
    is_durable = (F.col("seq") <= F.col("committed_seq")) & ~F.array_contains("gaps", F.col("seq"))
    joined = requests.join(marks, list(STREAM), "left")
    return joined.select(*[F.col(c) for c in requests.columns], F.coalesce(is_durable, F.lit(False)).alias("durable"))


def detect(rows: DataFrame, order: list[Column], checkpoints: DataFrame | None = None, chunk: Column | None = None) -> DataFrame:
    """`rows` in arrival order with outcome deliver, gap or duplicate, and the missed range of a gap.

    Expected is one more than the highest number seen of the stream, 0 at first, or what a checkpoint (partition,
    publisher_id, seq) says. A late row that fills a gap counts as a duplicate.

    `chunk`, which never falls along `order` (say, the day of arrival), cuts streams into pieces: the running maximum then
    starts from the maximum of the pieces before, so a stream with a large share of all rows is many tasks."""
    w = Window.partitionBy(*STREAM) if chunk is None else Window.partitionBy(*STREAM, "__chunk")
    if chunk is not None:
        rows = rows.withColumn("__chunk", chunk)
        tops = rows.groupBy(*STREAM, "__chunk").agg(F.max("seq").alias("__top"))
        earlier = F.max("__top").over(Window.partitionBy(*STREAM).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.join(tops.withColumn("__before", earlier).drop("__top"), [*STREAM, "__chunk"])
    seen = F.max("seq").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    if chunk is None:
        rows = rows.withColumn("seen", seen)
    else:
        rows = rows.withColumn("seen", F.greatest(seen, "__before")).drop("__before", "__chunk")
    if checkpoints is not None:
        marks = checkpoints.groupBy(*STREAM).agg(F.max("seq").alias("mark"))
        rows = rows.join(marks, list(STREAM), "left").withColumn("seen", F.greatest("seen", "mark")).drop("mark")
    expected = F.coalesce(F.col("seen") + 1, F.lit(0).cast("long"))
    gap = F.col("seq") > F.col("expected")
    rows = rows.withColumn("expected", expected).drop("seen")
    outcome = F.when(F.col("seq") == F.col("expected"), "deliver").when(gap, "gap").otherwise("duplicate")
    return rows.withColumns({"outcome": outcome, "missed_start": F.when(gap, F.col("expected")), "missed_end": F.when(gap, F.col("seq"))}).drop("expected")


def heartbeat_gaps(heartbeats: DataFrame, cursors: DataFrame) -> DataFrame:
    """Ranges [expected, seq + 1) that a heartbeat (publisher_id, partition, seq) shows to be missing behind the cursors."""
    expected = F.coalesce(F.col("cursor") + 1, F.lit(0).cast("long"))
    joined = heartbeats.join(cursors.withColumnRenamed("seq", "cursor"), list(STREAM), "left").withColumn("missed_start", expected)
    return joined.where("seq >= missed_start").select(*STREAM, "missed_start", (F.col("seq") + 1).alias("missed_end"))


def cursors(rows: DataFrame) -> DataFrame:
    """Highest number per stream."""
    return rows.groupBy(*STREAM).agg(F.max("seq").alias("seq"))


def assign_sequence(rows: DataFrame, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*STREAM).orderBy(*order)
    return rows.withColumn("seq", (F.row_number().over(w) - 1).cast("long"))


def round_robin(rows: DataFrame, partitions: int, order: list[Column]) -> DataFrame:
    """Partition of unkeyed rows: a publisher's rows take the partitions in turn."""
    w = Window.partitionBy("publisher_id").orderBy(*order)
    return rows.withColumn("partition", F.pmod(F.row_number().over(w) - 1, F.lit(partitions)).cast("int"))


def first_of_each(rows: DataFrame, id_col: str, order: list[Column]) -> DataFrame:
    """The first arrival of each id."""
    w = Window.partitionBy(id_col).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def catch_up(log: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows behind the cursors (partition, publisher_id, seq); streams without a cursor are read from the start."""
    joined = log.join(marks.select(*STREAM, F.col("seq").alias("__cursor")), list(STREAM), "left")
    return joined.where(F.col("seq") > F.coalesce("__cursor", F.lit(-1))).drop("__cursor")


def caught_up(marks: DataFrame, positions: DataFrame, threshold: int = 0) -> DataFrame:
    """One row, caught_up boolean: no watermark passes its position (0 without one) by more than the threshold."""
    joined = marks.select(*STREAM, "committed_seq").join(positions.select(*STREAM, F.col("seq").alias("at")), list(STREAM), "left")
    return joined.agg(F.coalesce(F.bool_and(F.col("committed_seq") <= F.coalesce("at", F.lit(0)) + threshold), F.lit(True)).alias("caught_up"))


def replay_then_live(history: DataFrame, live: DataFrame) -> DataFrame:
    """History and the live rows that it doesn't have."""
    return history.unionByName(live.join(history.select("publisher_id", "seq").distinct(), ["publisher_id", "seq"], "left_anti"))


def recover(ranges: DataFrame, store: DataFrame, cache: DataFrame) -> DataFrame:
    """What becomes of every missing number: found in the store, else in the publishers' cache, else lost."""
    wanted = ranges.select(*STREAM, F.explode(F.sequence("missed_start", F.col("missed_end") - 1)).alias("seq")).distinct()
    keys = [*STREAM, "seq"]
    tier = lambda rows, name: rows.select(*keys).distinct().withColumn(name, F.lit(True))
    joined = wanted.join(tier(store, "s"), keys, "left").join(tier(cache, "c"), keys, "left")
    return joined.select(*keys, F.when(F.col("s"), "store").when(F.col("c"), "cache").otherwise("lost").alias("found"))


def remaining(ranges: DataFrame, recovered: DataFrame) -> DataFrame:
    """Missing numbers that recovery hasn't brought."""
    wanted = ranges.select(*STREAM, F.explode(F.sequence("missed_start", F.col("missed_end") - 1)).alias("seq")).distinct()
    return wanted.join(recovered.select(*STREAM, "seq").distinct(), [*STREAM, "seq"], "left_anti")


def checkpoint(acks: DataFrame) -> DataFrame:
    """Highest acknowledged number per stream: acknowledgements in any order never move it back."""
    return cursors(acks)
