"""Scans, replay, keyed lookups, compaction and retention over an event log.

Functions take and return DataFrames with the columns of the event log (see sources.adapters.event_log); what isn't named
here passes through."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.exprs import QueryFilters, ReplayFilters, is_internal, path_pattern

from .tasks import spread

PRIMARY_ORDER = ("publisher_id", "seq")
REPLAY_ORDER = ("hlc_physical_ns", "hlc_logical", "publisher_id", "seq")


def clock() -> Column:
    return F.struct("hlc_physical_ns", "hlc_logical")


def _clock_at(at: tuple[int, int]) -> Column:
    return F.struct(F.lit(at[0]).cast("long"), F.lit(at[1]).cast("long"))


def scan(log: DataFrame, f: QueryFilters = QueryFilters(), ordered: bool = True) -> DataFrame:
    """Filtered scan in (publisher, seq) order; the limit counts rows that passed the filters."""
    tests = [
        (f.publisher_id, lambda v: F.col("publisher_id") == v),
        (f.after_seq, lambda v: F.col("seq") > v),
        (f.before_seq, lambda v: F.col("seq") < v),
        (f.after_time_ns, lambda v: F.col("ts_ns") > v),
        (f.before_time_ns, lambda v: F.col("ts_ns") < v),
    ]
    for value, test in tests:
        if value is not None:
            log = log.where(test(value))
    if ordered or f.limit is not None:
        log = log.orderBy(*PRIMARY_ORDER)
    return log if f.limit is None else log.limit(f.limit)


def clock_bounds(f: ReplayFilters) -> list[Column]:
    """Exclusive clock bounds. The plain bound on the physical part lets the scan skip row groups."""
    out = []
    if f.after_hlc is not None:
        out += [F.col("hlc_physical_ns") >= f.after_hlc[0], clock() > _clock_at(f.after_hlc)]
    if f.before_hlc is not None:
        out += [F.col("hlc_physical_ns") <= f.before_hlc[0], clock() < _clock_at(f.before_hlc)]
    return out


def replay(log: DataFrame, f: ReplayFilters = ReplayFilters(), fallback: bool = False, ordered: bool = True) -> DataFrame:
    """Rows in the total order (clock, publisher, seq). Rows without a clock have no place in it; with `fallback` their
    timestamp stands in for it."""
    if fallback:
        log = log.withColumns({"hlc_physical_ns": F.coalesce("hlc_physical_ns", "ts_ns"), "hlc_logical": F.coalesce("hlc_logical", F.lit(0).cast("long"))})
    log = log.where("hlc_physical_ns is not null")
    if f.key is not None:
        log = log.where(F.col("key") == f.key)
    elif f.key_prefix is not None:
        log = log.where(F.col("key").startswith(f.key_prefix))
    if f.publisher_id is not None:
        log = log.where(F.col("publisher_id") == f.publisher_id)
    for bound in clock_bounds(f):
        log = log.where(bound)
    if ordered or f.limit is not None:
        log = log.orderBy(*REPLAY_ORDER)
    return log if f.limit is None else log.limit(f.limit)


def page_after(log: DataFrame, cursor: tuple[int, int, str, int] | None, size: int, f: ReplayFilters = ReplayFilters()) -> DataFrame:
    """One page of a replay behind a full cursor (physical, logical, publisher, seq), so equal clocks at a page's end lose nothing."""
    rows = replay(log, replace(f, limit=None), ordered=False)
    if cursor is not None:
        at = F.struct(F.lit(cursor[0]).cast("long"), F.lit(cursor[1]).cast("long"), F.lit(cursor[2]), F.lit(cursor[3]).cast("long"))
        rows = rows.where(F.col("hlc_physical_ns") >= cursor[0]).where(F.struct(*REPLAY_ORDER) > at)
    return rows.orderBy(*REPLAY_ORDER).limit(size)


def pages(log: DataFrame, size: int, f: ReplayFilters = ReplayFilters(), at_most: int | None = None):
    """Pages of a replay, one after the other, as lists of rows of at most `size`; `at_most` bounds all pages together."""
    cursor, left = None, at_most if at_most is not None else f.limit
    while left is None or left > 0:
        n = size if left is None else min(size, left)
        rows = page_after(log, cursor, n, f).collect()
        if rows:
            yield rows
        if len(rows) < n:
            return
        last = rows[-1]
        cursor = (last.hlc_physical_ns, last.hlc_logical, last.publisher_id, last.seq)
        left = None if left is None else left - len(rows)


def subscribe(log: DataFrame, partitions: list[int] | None = None, key: str | None = None, key_prefix: str | None = None, patterns: list[str] | None = None) -> DataFrame:
    """Rows that a subscription sees, batch or stream. No partition at all means no row; prefixes are whole path segments."""
    rows = log.where(~is_internal(F.col("key_expr")))
    if partitions is not None:
        rows = rows.where(F.col("partition").isin(partitions) if partitions else F.lit(False))
    if key is not None:
        rows = rows.where(F.col("key") == key)
    if key_prefix is not None:
        rows = rows.where((F.col("key") == key_prefix) | F.col("key").startswith(key_prefix + "/"))
    if patterns is not None:
        fits = F.lit(False)
        for p in patterns:
            fits = fits | F.col("key_expr").rlike(path_pattern(p))
        rows = rows.where(fits)
    return rows


def by_key(log: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    rows = log.where(F.col("key") == key).orderBy(*PRIMARY_ORDER)
    return rows if limit is None else rows.limit(limit)


def newest(log: DataFrame, by: str) -> DataFrame:
    """One row per value of `by`: the highest seq, of equal ones the lowest publisher.

    row_number() = 1 lets Spark keep one row per group and task before the shuffle (window group limit)."""
    w = Window.partitionBy(by).orderBy(F.col("seq").desc(), F.col("publisher_id").asc())
    return log.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def latest_by_keys(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    rows = log.where("key is not null")
    return newest(rows if keys is None else rows.where(F.col("key").isin(keys)), "key")


def compact(log: DataFrame) -> DataFrame:
    """The newest row of each path."""
    return newest(log, "key_expr")


def compact_keyed(log: DataFrame) -> DataFrame:
    """The newest row of each key, tombstones included; rows without a key stay."""
    return newest(log.where("key is not null"), "key").unionByName(log.where("key is null"))


def without_tombstones(compacted: DataFrame) -> DataFrame:
    return compacted.where(F.length("payload") > 0)


def collect_garbage(log: DataFrame, cutoff_ns: int) -> DataFrame:
    """What stays when rows older than the cutoff go."""
    return log.where(F.col("ts_ns") >= cutoff_ns)


def retain_newest(log: DataFrame, max_events: int | None = None, max_bytes: int | None = None, by: str = "partition") -> DataFrame:
    """Per partition the newest rows, as many as a number of events or of payload bytes allows."""
    w = Window.partitionBy(by).orderBy(F.col("ts_ns").desc(), F.col("publisher_id").desc(), F.col("seq").desc())
    if max_events is not None:
        log = log.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= max_events).drop("__n")
    if max_bytes is not None:
        upto = F.sum(F.length("payload")).over(w.rowsBetween(Window.unboundedPreceding, 0))
        log = log.withColumn("__b", upto).where(F.col("__b") <= max_bytes).drop("__b")
    return log


def upsert(log: DataFrame, batch: DataFrame, arrival: str) -> DataFrame:
    """Rows after storing a batch: of equal (partition, publisher, seq) the one that arrived last stays, so storing twice is harmless."""
    return last_arrival(log.unionByName(batch), arrival)


def last_arrival(rows: DataFrame, arrival: str) -> DataFrame:
    w = Window.partitionBy("partition", "publisher_id", "seq").orderBy(F.col(arrival).desc())
    return spread(rows, "partition", "publisher_id", "seq").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def publisher_cache(log: DataFrame, size: int = 256, after_seq: int | None = None, before_seq: int | None = None) -> DataFrame:
    """What a publisher still holds: its last `size` rows per partition; from `after_seq` inclusive to `before_seq` exclusive."""
    w = Window.partitionBy("publisher_id").orderBy(F.col("ts_ns").desc(), F.col("seq").desc())
    rows = log.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= size).drop("__rn")
    if after_seq is not None:
        rows = rows.where(F.col("seq") >= after_seq)
    return rows if before_seq is None else rows.where(F.col("seq") < before_seq)


def event_page(log: DataFrame, limit: int = 50, key: str | None = None, partition: int | None = None) -> DataFrame:
    """The page of an events endpoint in (partition, seq, publisher) order, 1 to 1000 rows; has_more says whether rows follow it."""
    limit = max(1, min(limit, 1000))
    if key is not None:
        log = log.where(F.col("key") == key)
    if partition is not None:
        log = log.where(F.col("partition") == partition)
    rows = log.orderBy("partition", "seq", "publisher_id").limit(limit + 1)
    n = F.row_number().over(Window.orderBy("partition", "seq", "publisher_id"))
    rows = rows.withColumn("__n", n).withColumn("has_more", F.max("__n").over(Window.partitionBy()) > limit)
    return rows.where(F.col("__n") <= limit).drop("__n")


def write_log(log: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The stored layout: a folder per partition, rows of a file in publisher and seq order, so both filters prune."""
    rows = log.repartition("partition").sortWithinPartitions("partition", "publisher_id", "seq")
    rows.write.mode(mode).partitionBy("partition").parquet(path)
