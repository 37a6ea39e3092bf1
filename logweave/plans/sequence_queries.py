"""Queries over sequence numbers: watermarks, gaps, duplicates, catch-up, and consumer offsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.operators import log as L
from logweave.operators import offsets as O
from logweave.operators import sequence as S
from logweave.sources.adapters import ARRIVALS_SQL, COMMITS_SQL, LOG_SQL, arrivals, event_log, offset_commits

from .registry import query

RANGES_SQL = """
runs AS (SELECT partition, publisher_id, seq, lag(seq, 1, -1) OVER (PARTITION BY partition, publisher_id ORDER BY seq) AS before
         FROM (SELECT DISTINCT partition, publisher_id, seq FROM log)),
ranges AS (SELECT partition, publisher_id, before + 1 AS missed_start, seq AS missed_end FROM runs WHERE seq > before + 1),
missed AS (SELECT partition, publisher_id, unnest(range(missed_start, missed_end)) AS seq FROM ranges)
"""
MARKS_SQL = f"""{RANGES_SQL},
holes AS (SELECT partition, publisher_id, list(seq ORDER BY seq) AS gaps, min(seq) FILTER (seq >= 1) - 1 AS held, min(seq) AS lowest FROM missed GROUP BY ALL),
marks AS (SELECT t.partition, t.publisher_id, coalesce(h.held, t.top) AS committed_seq, coalesce(h.gaps, []) AS gaps, h.lowest
          FROM (SELECT partition, publisher_id, max(seq) AS top FROM log GROUP BY ALL) t LEFT JOIN holes h USING (partition, publisher_id))
"""


def _order():
    return [F.col("arrival_ts"), F.col("event_no"), F.col("copy")]


@query("publisher_watermarks", f"WITH {LOG_SQL}, {MARKS_SQL} SELECT partition, publisher_id, committed_seq, array_to_string(gaps, ',') AS gaps FROM marks")
def publisher_watermarks(spark, sf_dir):
    return S.watermarks(event_log(spark, sf_dir)).withColumn("gaps", F.array_join(F.col("gaps").cast("array<string>"), ","))


@query("watermarks_reopened", f"""WITH {LOG_SQL}, {MARKS_SQL}
  SELECT partition, publisher_id, CASE WHEN lowest = 0 THEN 0 ELSE committed_seq END AS committed_seq, array_to_string(gaps, ',') AS gaps FROM marks""")  # fmt: skip
def watermarks_reopened(spark, sf_dir):
    return S.watermarks(event_log(spark, sf_dir), reopened=True).withColumn("gaps", F.array_join(F.col("gaps").cast("array<string>"), ","))


@query("publisher_gaps", f"WITH {LOG_SQL}, {RANGES_SQL} SELECT * FROM missed")
def publisher_gaps(spark, sf_dir):
    return S.gaps(event_log(spark, sf_dir))


@query("missing_ranges", f"WITH {LOG_SQL}, {RANGES_SQL} SELECT * FROM ranges")
def missing_ranges(spark, sf_dir):
    return S.missing_ranges(event_log(spark, sf_dir))


@query("is_durable", f"""WITH {LOG_SQL}, {MARKS_SQL}, asked AS (SELECT DISTINCT partition, publisher_id, seq + 3 AS seq FROM log UNION ALL SELECT 0, 'nobody', 0)
  SELECT a.*, coalesce(a.seq <= m.committed_seq AND NOT list_contains(m.gaps, a.seq), false) AS durable
  FROM asked a LEFT JOIN marks m USING (partition, publisher_id)""")  # fmt: skip
def is_durable(spark, sf_dir):
    log = event_log(spark, sf_dir)
    asked = log.select("partition", "publisher_id", (F.col("seq") + 3).alias("seq")).distinct()
    asked = asked.unionByName(spark.createDataFrame([(0, "nobody", 0)], "partition int, publisher_id string, seq long"))
    return S.durable(asked, S.watermarks(log))


DETECT = """SELECT partition, publisher_id, seq, event_no, copy,
  CASE WHEN seq = expected THEN 'deliver' WHEN seq > expected THEN 'gap' ELSE 'duplicate' END AS outcome,
  CASE WHEN seq > expected THEN expected END AS missed_start, CASE WHEN seq > expected THEN seq END AS missed_end FROM e"""
SEEN = "max(seq) OVER (PARTITION BY partition, publisher_id ORDER BY arrival_ts, event_no, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
D_COLS = ["partition", "publisher_id", "seq", "event_no", "copy", "outcome", "missed_start", "missed_end"]


@query("gap_detector", f"WITH {ARRIVALS_SQL}, e AS (SELECT *, coalesce({SEEN} + 1, 0) AS expected FROM arrivals) {DETECT}")
def gap_detector(spark, sf_dir):
    return S.detect(arrivals(event_log(spark, sf_dir)), _order(), chunk=F.date_trunc("day", "arrival_ts")).select(*D_COLS)


@query("gap_detector_checkpoint", f"""WITH {ARRIVALS_SQL}, e AS (SELECT *, coalesce(greatest({SEEN}, CASE WHEN CAST(publisher_id AS INT) % 2 = 0 THEN 7 END) + 1, 0) AS expected
  FROM arrivals) {DETECT}""")  # fmt: skip
def gap_detector_checkpoint(spark, sf_dir):
    log = event_log(spark, sf_dir)
    marks = log.where("cast(publisher_id as int) % 2 = 0").select("partition", "publisher_id", F.lit(7).cast("long").alias("seq")).distinct()
    return S.detect(arrivals(log), _order(), marks, F.date_trunc("day", "arrival_ts")).select(*D_COLS)


@query("heartbeat_gaps", f"""WITH {LOG_SQL}, c AS (SELECT partition, publisher_id, max(seq) FILTER (seq < 30) AS cur, max(seq) AS beat FROM log GROUP BY ALL)
  SELECT partition, publisher_id, coalesce(cur + 1, 0) AS missed_start, beat + 1 AS missed_end FROM c WHERE beat >= coalesce(cur + 1, 0)""")  # fmt: skip
def heartbeat_gaps(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return S.heartbeat_gaps(S.cursors(log), S.cursors(log.where("seq < 30")))


@query("event_id_dedup", f"WITH {ARRIVALS_SQL} SELECT event_id, min(arrival_ts) AS arrival_ts FROM arrivals GROUP BY event_id")
def event_id_dedup(spark, sf_dir):
    return S.first_of_each(arrivals(event_log(spark, sf_dir)), "event_id", _order()).select("event_id", "arrival_ts")


@query("replay_then_live", f"""WITH {LOG_SQL}, h AS (SELECT publisher_id, seq FROM log WHERE seq < 40), l AS (SELECT publisher_id, seq FROM log WHERE seq >= 30)
  SELECT * FROM h UNION ALL SELECT * FROM l WHERE (publisher_id, seq) NOT IN (SELECT publisher_id, seq FROM h)""")  # fmt: skip
def replay_then_live(spark, sf_dir):
    log = event_log(spark, sf_dir).select("publisher_id", "seq")
    return S.replay_then_live(log.where("seq < 40"), log.where("seq >= 30"))


@query("catch_up", f"""WITH {LOG_SQL}, c AS (SELECT partition, publisher_id, max(seq) AS at FROM log WHERE seq < 25 AND CAST(publisher_id AS INT) % 3 <> 0 GROUP BY ALL)
  SELECT log.partition, log.publisher_id, log.seq FROM log LEFT JOIN c USING (partition, publisher_id) WHERE log.seq > coalesce(c.at, -1)""")  # fmt: skip
def catch_up(spark, sf_dir):
    log = event_log(spark, sf_dir).select("partition", "publisher_id", "seq")
    return S.catch_up(log, S.cursors(log.where("seq < 25 and cast(publisher_id as int) % 3 <> 0")))


@query("is_caught_up", f"""WITH {LOG_SQL}, {MARKS_SQL}, c AS (SELECT partition, publisher_id, max(seq) AS at FROM log WHERE seq < 60 GROUP BY ALL)
  SELECT t AS threshold, coalesce(bool_and(m.committed_seq <= coalesce(c.at, 0) + t), true) AS caught_up
  FROM marks m LEFT JOIN c USING (partition, publisher_id), (VALUES (0), (100000)) x(t) GROUP BY t""")  # fmt: skip
def is_caught_up(spark, sf_dir):
    log = event_log(spark, sf_dir)
    marks, at = S.watermarks(log), S.cursors(log.where("seq < 60"))
    both = [S.caught_up(marks, at, t).select(F.lit(t).alias("threshold"), "caught_up") for t in (0, 100_000)]
    return both[0].unionByName(both[1])


@query("gap_recovery", f"""WITH {LOG_SQL}, {RANGES_SQL}, all_ev AS (SELECT publisher_id, seq, event_id AS event_no, part AS partition FROM ev2)
  SELECT m.partition, m.publisher_id, m.seq, CASE WHEN a.event_no % 2 = 0 THEN 'store' WHEN a.event_no % 3 = 0 THEN 'cache' ELSE 'lost' END AS found
  FROM missed m JOIN all_ev a USING (partition, publisher_id, seq)""")  # fmt: skip
def gap_recovery(spark, sf_dir):
    """Missing numbers looked up in a peer's store and then in the publishers' caches."""
    from pyspark.sql import Window

    from logweave.sources.adapters import PARTITIONS, stable_partition, table

    ev = table(spark, sf_dir, "events").withColumn("publisher_id", F.lpad(F.col("user_id").cast("string"), 8, "0"))
    ev = ev.withColumn("seq", (F.row_number().over(Window.partitionBy("publisher_id").orderBy("ts", "event_id")) - 1).cast("long"))
    ev = ev.withColumn("partition", stable_partition(F.col("publisher_id"), PARTITIONS))
    return S.recover(S.missing_ranges(event_log(spark, sf_dir)), ev.where("event_id % 2 = 0"), ev.where("event_id % 3 = 0"))


@query("gaps_remaining", f"WITH {LOG_SQL}, {RANGES_SQL} SELECT * FROM missed WHERE seq % 2 = 1")
def gaps_remaining(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return S.remaining(S.missing_ranges(log), S.gaps(log).where("seq % 2 = 0"))


@query("checkpoint_restore", f"WITH {ARRIVALS_SQL} SELECT partition, publisher_id, max(seq) AS seq FROM arrivals GROUP BY ALL")
def checkpoint_restore(spark, sf_dir):
    return S.checkpoint(arrivals(event_log(spark, sf_dir)))


@query("publisher_partitions", f"""WITH {LOG_SQL} SELECT publisher_id, array_to_string(list_sort(list(DISTINCT p)), ',') AS partitions FROM
  (SELECT publisher_id, CAST((partition + seq % 2) AS INTEGER) AS p FROM log) GROUP BY publisher_id""")  # fmt: skip
def publisher_partitions(spark, sf_dir):
    rows = event_log(spark, sf_dir).select("publisher_id", (F.col("partition") + F.col("seq") % 2).cast("int").alias("partition"))
    return O.publisher_partitions(rows).withColumn("partitions", F.array_join(F.col("partitions").cast("array<string>"), ","))


FENCED = """fenced AS (SELECT *, coalesce(generation >= max(generation) OVER (PARTITION BY group_id, partition, publisher_id ORDER BY commit_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM commits)"""
LATEST = "latest AS (SELECT * FROM fenced WHERE accepted QUALIFY row_number() OVER (PARTITION BY group_id, partition, publisher_id ORDER BY commit_no DESC) = 1)"
LAGS = f"{COMMITS_SQL}, {MARKS_SQL}, {FENCED}, {LATEST}, lags AS (SELECT l.group_id, l.partition, l.publisher_id, greatest(coalesce(m.committed_seq, 0) - l.seq, 0) AS lag FROM latest l LEFT JOIN marks m USING (partition, publisher_id))"


@query("offset_fencing", f"WITH {COMMITS_SQL}, {FENCED} SELECT group_id, partition, publisher_id, commit_no, seq, generation, accepted FROM fenced")
def offset_fencing(spark, sf_dir):
    rows = O.fence(offset_commits(event_log(spark, sf_dir)))
    return rows.select("group_id", "partition", "publisher_id", "commit_no", "seq", "generation", "accepted")


@query("offset_latest", f"WITH {COMMITS_SQL}, {FENCED}, {LATEST} SELECT group_id, partition, publisher_id, seq, generation, member_id FROM latest")
def offset_latest(spark, sf_dir):
    return O.latest_offsets(offset_commits(event_log(spark, sf_dir)))


@query("offset_highest", f"WITH {COMMITS_SQL} SELECT group_id, partition, publisher_id, max(seq) AS seq, max(ts) AS ts FROM commits GROUP BY ALL")
def offset_highest(spark, sf_dir):
    return O.highest_offsets(offset_commits(event_log(spark, sf_dir)))


@query("keyed_offset_latest", f"""WITH {COMMITS_SQL}, k AS (SELECT group_id, CASE WHEN CAST(publisher_id AS INT) % 2 = 0 THEN 'exact' ELSE 'prefix' END AS filter_kind,
   'user/' || publisher_id AS filter_value, seq * 1000 AS hlc_physical_ns, commit_no AS hlc_logical, generation, commit_no FROM commits)
  SELECT group_id, filter_kind, filter_value, hlc_physical_ns, hlc_logical, generation FROM
   (SELECT *, max(generation) OVER (PARTITION BY group_id, filter_kind, filter_value ORDER BY commit_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS height FROM k)
  WHERE height IS NULL OR generation >= height QUALIFY row_number() OVER (PARTITION BY group_id, filter_kind, filter_value ORDER BY commit_no DESC) = 1""")  # fmt: skip
def keyed_offset_latest(spark, sf_dir):
    rows = offset_commits(event_log(spark, sf_dir)).select(
        "group_id", F.when(F.col("publisher_id").cast("int") % 2 == 0, "exact").otherwise("prefix").alias("filter_kind"),
        F.concat(F.lit("user/"), "publisher_id").alias("filter_value"), (F.col("seq") * 1000).alias("hlc_physical_ns"),
        F.col("commit_no").alias("hlc_logical"), "generation", "commit_no",
    )
    return O.latest_keyed_offsets(rows)


@query("consumer_lag", f"""WITH {LAGS} SELECT group_id, partition, string_agg(publisher_id || '=' || lag, ',' ORDER BY publisher_id) AS publishers,
  CAST(sum(lag) AS BIGINT) AS total_lag FROM lags GROUP BY group_id, partition""")  # fmt: skip
def consumer_lag(spark, sf_dir):
    log = event_log(spark, sf_dir)
    rows = O.consumer_lag(O.latest_offsets(offset_commits(log)), S.watermarks(log))
    shown = F.transform(F.map_entries("publishers"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return rows.withColumn("publishers", F.array_join(shown, ","))


@query("group_lag_total", f"WITH {LAGS} SELECT group_id, CAST(sum(lag) AS BIGINT) AS total_lag, count(DISTINCT partition) AS partitions FROM lags WHERE partition < 12 GROUP BY group_id")
def group_lag_total(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return O.group_lag(O.latest_offsets(offset_commits(log)), S.watermarks(log), partitions=12)


@query("lag_uncommitted", f"""WITH {LAGS}, slots AS (SELECT DISTINCT l.group_id, m.partition, m.publisher_id FROM latest l JOIN marks m USING (partition)
    UNION SELECT group_id, partition, publisher_id FROM latest)
  SELECT s.group_id, s.partition, s.publisher_id, greatest(coalesce(m.committed_seq, 0) - coalesce(l.seq, -1), 0) AS lag
  FROM slots s LEFT JOIN latest l USING (group_id, partition, publisher_id) LEFT JOIN marks m USING (partition, publisher_id)""")  # fmt: skip
def lag_uncommitted(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return O.lag_by_publisher(O.latest_offsets(offset_commits(log)), S.watermarks(log), include_uncommitted=True)


NOW = "2024-01-20 00:00:00"


@query("lag_stale", f"""WITH {LOG_SQL}, m AS (SELECT partition, publisher_id, max(ts) AS ts FROM log GROUP BY ALL)
  SELECT partition, bool_or(epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) > 120000000) AS is_stale FROM m GROUP BY partition""")  # fmt: skip
def lag_stale(spark, sf_dir):
    marks = event_log(spark, sf_dir).groupBy("partition", "publisher_id").agg(F.max("ts").alias("ts"))
    return O.stale_partitions(marks, NOW)


@query("lag_expiry", f"""WITH {COMMITS_SQL} SELECT group_id, partition, publisher_id, commit_no FROM commits
  WHERE epoch_us(TIMESTAMP '2024-01-01 03:00:00') - epoch_us(ts) <= 7200000000""")  # fmt: skip
def lag_expiry(spark, sf_dir):
    rows = O.expire(offset_commits(event_log(spark, sf_dir)), "2024-01-01 03:00:00", 7200)
    return rows.select("group_id", "partition", "publisher_id", "commit_no")


@query("known_groups", f"WITH {COMMITS_SQL} SELECT DISTINCT group_id FROM commits")
def known_groups(spark, sf_dir):
    return O.known_groups(offset_commits(event_log(spark, sf_dir)))


@query("group_list", f"""WITH {LAGS}, t AS (SELECT group_id, CAST(sum(lag) AS BIGINT) AS total_lag FROM lags GROUP BY group_id),
  m AS (SELECT group_id, count(DISTINCT member_id) AS members FROM (SELECT group_id, member_id FROM commits WHERE group_id <> 'g0' UNION ALL SELECT 'idle', 'm9') GROUP BY group_id)
  SELECT group_id, coalesce(total_lag, 0) AS total_lag, coalesce(members, 0) AS members FROM t FULL JOIN m USING (group_id)""")  # fmt: skip
def group_list(spark, sf_dir):
    log = event_log(spark, sf_dir)
    commits = offset_commits(log)
    members = commits.where("group_id <> 'g0'").select("group_id", "member_id").unionByName(spark.createDataFrame([("idle", "m9")], "group_id string, member_id string"))
    return O.groups_with_members(O.group_lag(O.latest_offsets(commits), S.watermarks(log)), members)


@query("offset_reset", f"WITH {LOG_SQL}, {MARKS_SQL} SELECT 'g1' AS group_id, partition, publisher_id, committed_seq AS seq FROM marks")
def offset_reset(spark, sf_dir):
    return O.reset_offsets(S.watermarks(event_log(spark, sf_dir)), "g1", to_latest=True)


@query("fan_in_union", f"WITH {LOG_SQL} SELECT partition, publisher_id, seq FROM log WHERE partition IN (2, 5, 7)")
def fan_in_union(spark, sf_dir):
    """Subscriptions to several partitions as one scan."""
    return L.subscribe(event_log(spark, sf_dir), partitions=[2, 5, 7]).select("partition", "publisher_id", "seq")


@query("max_seq_lag", f"""WITH {LOG_SQL}, t AS (SELECT partition, publisher_id, max(seq) AS top, max(seq) FILTER (seq < 50) AS cur FROM log WHERE true GROUP BY ALL),
  l AS (SELECT greatest(top - CASE WHEN CAST(publisher_id AS INT) % 4 = 0 THEN -1 ELSE coalesce(cur, -1) END, 0) AS lag FROM t)
  SELECT coalesce(max(lag), 0) AS max_seq_lag, CAST(coalesce(sum(lag), 0) AS BIGINT) AS behind_by FROM l""")  # fmt: skip
def max_seq_lag(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return O.lag_extremes(log, S.cursors(log.where("seq < 50 and cast(publisher_id as int) % 4 <> 0")))


@query("replay_from_committed", f"""WITH {LOG_SQL}, c AS (SELECT publisher_id, max(hlc_physical_ns) AS p FROM log WHERE seq < 20 AND hlc_physical_ns IS NOT NULL AND CAST(publisher_id AS INT) % 2 = 0 GROUP BY 1)
  SELECT l.publisher_id, l.seq, l.event_id FROM log l LEFT JOIN c USING (publisher_id)
  WHERE hlc_physical_ns IS NOT NULL AND (p IS NULL OR hlc_physical_ns > p OR (hlc_physical_ns = p AND hlc_logical > 1))""")  # fmt: skip
def replay_from_committed(spark, sf_dir):
    log = event_log(spark, sf_dir)
    at = log.where("seq < 20 and hlc_physical_ns is not null and cast(publisher_id as int) % 2 = 0").groupBy("publisher_id").agg(F.max("hlc_physical_ns").alias("hlc_physical_ns"))
    committed = at.select(F.lit("g").alias("group_id"), "publisher_id", "hlc_physical_ns", F.lit(1).cast("long").alias("hlc_logical"))
    return O.replay_from_committed(log, committed, "g").select("publisher_id", "seq", "event_id")
