"""Operators against sequential models, plan shapes, streaming forms and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from logweave.functions.exprs import QueryFilters, ReplayFilters
from logweave.operators import audit as A
from logweave.operators import cluster as C
from logweave.operators import log as L
from logweave.operators import offsets as O
from logweave.operators import placement as P
from logweave.operators import processing as R
from logweave.operators import sequence as S
from logweave.plans.catalog import QUERIES
from logweave.sources.adapters import event_log
from logweave.streaming import twins

STREAM = "partition int, publisher_id string, seq long"


def test_pages_cover_the_replay(spark):
    rows = [(0, f"p{i % 3}", i, 1_000 + i // 4, 0, i) for i in range(50)]
    log = spark.createDataFrame(rows, "partition int, publisher_id string, seq long, hlc_physical_ns long, hlc_logical long, n long")
    whole = [r.n for r in L.replay(log).collect()]
    for size in (1, 7, 50, 60):
        assert [r.n for page in L.pages(log, size) for r in page] == whole
    assert [r.n for page in L.pages(log, 7, at_most=10) for r in page] == whole[:10]


def test_replay_is_independent_of_storage_order(spark):
    rows = [(0, f"p{i}", s, 10**9 + s * 3 + i, 0) for i in range(3) for s in range(10)]
    want = None
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        log = spark.createDataFrame(rows, "partition int, publisher_id string, seq long, hlc_physical_ns long, hlc_logical long")
        got = [(r.publisher_id, r.seq) for r in L.replay(log).collect()]
        want = want or got
        assert got == want


def test_clock_bounds_are_exclusive_and_pushed_down(spark, tmp_path):
    L.write_log(event_log(spark, "/root/testdata/sf0.001"), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    some = log.where("hlc_physical_ns is not null").orderBy(*L.REPLAY_ORDER).limit(30).collect()
    a, b = some[5], some[20]
    f = ReplayFilters(after_hlc=(a.hlc_physical_ns, a.hlc_logical), before_hlc=(b.hlc_physical_ns, b.hlc_logical))
    assert [r.event_id for r in L.replay(log, f).collect()] == [r.event_id for r in some[6:20]]
    plan = L.replay(log, f)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(hlc_physical_ns" in plan
    plan = L.scan(log.where("partition = 3"), QueryFilters(publisher_id="00000003"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(publisher_id,00000003)" in plan and "PartitionFilters: [isnotnull(partition" in plan


def test_watermarks_and_detector_follow_sequential_models(spark):
    rng = random.Random(5)
    for _ in range(3):
        rows, order = [], 0
        for p in range(4):
            seqs = [s for s in range(rng.randint(1, 30)) if rng.random() < 0.8]
            seqs += rng.sample(seqs, min(len(seqs), 3))
            rng.shuffle(seqs)
            for s in seqs:
                rows.append((p % 2, f"p{p}", s, order))
                order += 1
        if not rows:
            continue
        df = spark.createDataFrame(rows, STREAM + ", at long")
        want = {}
        for part, pub in {r[:2] for r in rows}:
            have = {r[2] for r in rows if r[:2] == (part, pub)}
            gaps = [s for s in range(max(have)) if s not in have]
            low = [g for g in gaps if g >= 1]
            want[(part, pub)] = (low[0] - 1 if low else max(have), gaps, 0 if 0 in gaps else (low[0] - 1 if low else max(have)))
        got = {(r.partition, r.publisher_id): (r.committed_seq, list(r.gaps)) for r in S.watermarks(df).collect()}
        assert got == {k: v[:2] for k, v in want.items()}
        again = {(r.partition, r.publisher_id): r.committed_seq for r in S.watermarks(df, reopened=True).collect()}
        assert again == {k: v[2] for k, v in want.items()}
        last, out = {}, {}
        for part, pub, seq, at in rows:
            e = last.get((part, pub), -1) + 1
            out[at] = ("deliver", None) if seq == e else ("gap", (e, seq)) if seq > e else ("duplicate", None)
            last[(part, pub)] = max(last.get((part, pub), -1), seq)
        for chunk in (None, F.expr("at div 7"), F.expr("at div 1000")):
            found = {r.at: (r.outcome, (r.missed_start, r.missed_end) if r.outcome == "gap" else None) for r in S.detect(df, [F.col("at")], chunk=chunk).collect()}
            assert found == out
        runs = {tuple(r) for r in S.missing_ranges(df).collect()}
        for chunk in (1, 3, 8):
            split = {(r.partition, r.publisher_id, r.seq) for r in S.missing_ranges(df, chunk).select("partition", "publisher_id", F.explode(F.sequence("missed_start", F.col("missed_end") - 1)).alias("seq")).collect()}
            assert split == {(a, b, x) for a, b, c, d in runs for x in range(c, d)}


def test_empty_log(spark):
    none = spark.createDataFrame([], STREAM)
    assert S.watermarks(none).count() == 0 and S.gaps(none).count() == 0
    assert S.caught_up(S.watermarks(none), none).first().caught_up is True


def test_atomic_fencing(spark):
    # commit 1 raises a to 5; commit 2 is stale for a and must not raise b; so commit 3, generation 3 for b, stands
    rows = [("g", 0, "a", 1, 5, 1), ("g", 0, "a", 2, 4, 2), ("g", 0, "b", 2, 9, 2), ("g", 0, "b", 3, 3, 3)]
    df = spark.createDataFrame(rows, "group_id string, partition int, publisher_id string, seq long, generation long, commit_no long")
    assert {(r.commit_no, r.publisher_id): r.accepted for r in O.fence_atomic(df).collect()} == {(1, "a"): True, (2, "a"): False, (2, "b"): False, (3, "b"): True}
    single = df.where("publisher_id = 'a'")
    assert {r.commit_no: r.accepted for r in O.fence(single).collect()} == {1: True, 2: False}


def test_rack_aware_follows_the_greedy_model(spark):
    nodes = spark.createDataFrame([(f"n{i}", 100 + 100 * (i % 3), f"r{i % 3}" if i % 4 else None) for i in range(9)], "node_id string, capacity int, rack string")
    parts = P.partition_range(spark, 40)
    scores = {}
    for r in P.scored(parts, nodes).collect():
        scores.setdefault(r.partition, []).append((-r.score, r.node_id, r.rack or ""))
    for factor in (1, 3, 9):
        want = {}
        for p, rows in scores.items():
            rows, picked, racks = sorted(rows), [], set()
            for s in rows:
                if s[2] not in racks:
                    picked.append(s)
                    racks.add(s[2])
            picked = (picked + [s for s in rows if s not in picked])[:factor]
            want[p] = [s[1] for s in picked]
        got = {}
        for r in P.replicas_rack_aware(parts, nodes, factor).orderBy("partition", "replica").collect():
            got.setdefault(r.partition, []).append(r.node_id)
        assert got == want


def test_weighted_placement_is_fair_and_stable(spark):
    nodes = spark.createDataFrame([("a", 100, "r"), ("b", 300, "r")], "node_id string, capacity int, rack string")
    counts = {r.node_id: r.partitions for r in P.distribution(P.replicas(P.partition_range(spark, 2000), nodes, 1)).collect()}
    assert 0.6 < counts["b"] / 2000 < 0.9
    more = nodes.unionByName(spark.createDataFrame([("c", 100, "r")], nodes.schema))
    old, new = P.replicas(P.partition_range(spark, 500), nodes, 1), P.replicas(P.partition_range(spark, 500), more, 1)
    moved = {r.node_id for r in P.rebalance(old, new).where("change = 'gained'").collect()}
    assert moved == {"c"}


def test_lifecycle_steps():
    assert R.lifecycle_steps([0, 5, 400], 2000, 100, 50) == [(0, "ACTIVE", 0), (105, "SUSPECTED", 1), (155, "DRAINING", 2), (205, "ARCHIVED", 3), (400, "ACTIVE", 4), (500, "SUSPECTED", 5), (550, "DRAINING", 6), (600, "ARCHIVED", 7)]
    assert R.lifecycle_steps([0, 100], 150, 100, 50) == [(0, "ACTIVE", 0)]


def test_lifecycle_ignores_busy_runs(spark):
    times = list(range(0, 1000, 7)) + [5000, 5010, 9000]
    df = spark.createDataFrame([("p", t) for t in times], "publisher_id string, at_us long")
    got = [(r.at_us, r.state, r.epoch) for r in R.lifecycle(df, 20_000, 100, 50).orderBy("epoch").collect()]
    assert got == R.lifecycle_steps(times, 20_000, 100, 50)


def test_streamed_lifecycle_is_the_batch_one_up_to_the_last_activity(spark, sf_dir):
    last = {r.publisher_id: r.at for r in event_log(spark, sf_dir).groupBy("publisher_id").agg(F.max(F.expr("ts_ns div 1000")).alias("at")).collect()}
    batch = {tuple(r) for r in QUERIES["lifecycle_states"](spark, sf_dir).collect()}
    assert {tuple(r) for r in QUERIES["stream_lifecycle"](spark, sf_dir).collect()} == {r for r in batch if r[1] <= last[r[0]]}


def test_fifo_memory():
    flags, held = twins.fifo_flags(["1", "2", "3", "4", "1", "3"], [], 3)
    assert flags == [False, False, False, False, False, True] and held == ["3", "4", "1"]


def test_manifests_from_files(spark, tmp_path):
    (tmp_path / "b-0-received.jsonl").write_text('{"event_id":"x","seq":1,"publisher_id":"p","partition":0,"role":"received"}\n\n{"event_id":"y","seq":0,"publisher_id":"p","partition":0,"role":"received"}\n')
    (tmp_path / "a-0-published.jsonl").write_text('{"event_id":"x","seq":1,"publisher_id":"p","partition":0,"role":"published"}\n')
    rows = A.read_manifests(spark, str(tmp_path), "received").orderBy("file", "line").collect()
    assert [r.event_id for r in rows] == ["x", "y"] and A.read_manifests(spark, str(tmp_path)).count() == 3


def test_ordering_violations_across_chunks(spark):
    rng = random.Random(2)
    rows = [(f"p{rng.randint(0, 2)}", rng.randint(0, 9), line) for line in range(120)]
    df = spark.createDataFrame(rows, "publisher_id string, seq long, line long")
    last, want = {}, set()
    for p, q, line in rows:
        if p in last and q < last[p]:
            want.add((p, line, q, last[p]))
        last[p] = q
    for chunk in (1, 7, 1000):
        assert {tuple(r) for r in A.ordering_violations(df, chunk=chunk).collect()} == want


def test_slow_consumer_needs_a_sustained_run(spark):
    rows = [("c", s, 0.9 if s != 3 else 0.1, 0) for s in range(8)]
    df = spark.createDataFrame(rows, "consumer string, s int, fullness double, lag long").withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0,0,0,s)"))
    assert [r.over_us for r in R.slow_consumers(df).orderBy("ts").collect()] == [3_000_000]


def test_under_replication(spark):
    parts = P.partition_range(spark, 3)
    placed = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a")], "partition int, node_id string")
    online = spark.createDataFrame([("a",)], "node_id string")
    got = {r.partition: (r.replicas, r.severity) for r in C.under_replicated(parts, C.replica_counts(placed, online), 2).collect()}
    assert got == {0: (1, "warning"), 1: (1, "warning"), 2: (0, "critical")}


def test_streamed_store_and_offsets(spark, tmp_path, sf_dir):
    log = event_log(spark, sf_dir).select("partition", "publisher_id", "seq")
    log.repartition(2).write.parquet(str(tmp_path / "in"))
    seen = []
    q = twins.publish_watermarks(twins.live(spark, log.schema, str(tmp_path / "in"), 1), str(tmp_path / "log"), lambda df, n: seen.append((n, df.count())), str(tmp_path / "c1"))
    q.awaitTermination()
    assert len(seen) == 2
    q = twins.commit_offsets(twins.live(spark, log.schema, str(tmp_path / "in")), "g", str(tmp_path / "offsets"), str(tmp_path / "c2"))
    q.awaitTermination()
    got = {(r.partition, r.publisher_id): r.seq for r in S.cursors(spark.read.parquet(str(tmp_path / "offsets"))).collect()}
    assert got == {(r.partition, r.publisher_id): r.seq for r in S.cursors(log).collect()}


@pytest.mark.parametrize("partitions", [[], [0]])
def test_no_partition_means_no_row(spark, partitions):
    rows = spark.createDataFrame([(0, "e/p/0/1"), (0, "e/_watermark")], "partition int, key_expr string")
    assert L.subscribe(rows, partitions=partitions).count() == len(partitions)


def test_a_long_chain_of_topics_has_no_cycle(spark):
    from logweave.operators import topology

    chain = [(f"c{i}", f"c{i + 1}") for i in range(2500)]
    loops = [("x", "y"), ("y", "x"), ("y", "m"), ("m", "z"), ("z", "z"), ("z", "c0"), ("c0", "d")]
    for rows, want in ((chain, []), (chain + loops, ["m", "x", "y", "z"])):
        got = topology.cyclic_topics(spark.createDataFrame(rows, "input_topic string, output_topic string"))
        assert [r.topic for r in got.collect()] == want


@pytest.mark.parametrize("name", ["stream_bounded_dedup", "stream_gap_detector"])
def test_streams_leave_their_output_in_files(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir)
    assert rows.inputFiles() and rows.count() > 0


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    arrived = "partition int, publisher_id string, seq long, event_no long, copy int, arrival_ts timestamp_ntz"
    rows = spark.createDataFrame([(0, "p", s) for s in (0, 1, 4)], STREAM)
    rows = rows.select("*", F.col("seq").alias("event_no"), F.lit(0).alias("copy"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0,0,0,seq)").alias("arrival_ts"))
    got = []
    for part in ("seq < 2", "seq > 2"):
        rows.where(part).write.mode("append").parquet(str(tmp_path / "in"))
        out = twins.run_to_table(twins.gap_detector(twins.live(spark, spark.createDataFrame([], arrived).schema, str(tmp_path / "in"))), "going_on", str(tmp_path / "c"))
        got.append(sorted((r.seq, r.outcome, r.missed_start) for r in out.collect()))
    assert got == [[(0, "deliver", None), (1, "deliver", None)], [(0, "deliver", None), (1, "deliver", None), (4, "gap", 2)]]


def test_streamed_retries_of_many_ids_share_a_call(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "c", None]), n, rng.choice([True, False, False])) for n in range(60)]
    df = spark.createDataFrame(rows, "event_id string, attempt_no long, ok boolean")
    want = sorted((str(r.event_id), r.attempt_no, r.failures, r.outcome) for r in R.retry_outcomes(df, 3, 100, 1000).collect())
    for shards in (1, 2, 64):
        path, check = str(tmp_path / f"in{shards}"), str(tmp_path / f"c{shards}")
        for part in ("attempt_no < 25", "attempt_no between 25 and 40", "attempt_no > 40"):
            df.where(part).write.mode("append").parquet(path)
            got = twins.run_to_table(twins.retry_outcomes(twins.live(spark, df.schema, path), 3, shards=shards), f"retries_{shards}", check)
        assert sorted((str(r.event_id), r.attempt_no, r.failures, r.outcome) for r in got.collect()) == want


def test_last_arrival_deals_large_logs_to_a_number_of_tasks(spark, monkeypatch):
    from logweave.operators import tasks

    rows = spark.createDataFrame([(0, "p", i % 5, i) for i in range(20)], STREAM + ", arrived int")
    monkeypatch.setattr(tasks, "SHARE", 1)
    got = L.last_arrival(rows, "arrived")
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.arrived for r in got.collect()) == list(range(15, 20))


def test_retry_outcomes_sort_once_over_a_number_of_tasks(spark, monkeypatch):
    from logweave.operators import tasks

    rows = spark.createDataFrame([("a", n, n in (3, 4)) for n in range(1, 9)], "event_id string, attempt_no long, ok boolean")
    monkeypatch.setattr(tasks, "SHARE", 1)
    got = R.retry_outcomes(rows, 3, 100, 1000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Sort [") == 1
    assert [r.failures for r in got.orderBy("attempt_no").collect()] == [1, 2, 0, 0, 1, 2, 3, 4]


def test_percentiles_come_from_ranks_over_all_tasks(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([float(rng.randint(0, 9)), rng.random(), None])) for _ in range(400)] + [("one", 2.5), ("none", None), ("nan", float("nan")), ("nan", 1.0)]
    df = spark.createDataFrame(rows, "mode string, v double")
    names = {f"p{x}": x / 100 for x in (25, 50, 75, 95, 99)}
    want = {r["mode"]: r for r in df.groupBy("mode").agg(F.count("*").alias("n"), *[F.percentile("v", F.lit(q)).alias(c) for c, q in names.items()]).collect()}
    for part in (7, 100_000):
        summary = R.latency_summary(df, F.col("v"), ["mode"], part)
        assert "percentile" not in summary._jdf.queryExecution().optimizedPlan().toString()
        got = {r["mode"]: r for r in summary.collect()}
        assert {m: [repr(r[c]) for c in ("n", *names)] for m, r in got.items()} == {m: [repr(r[c]) for c in ("n", *names)] for m, r in want.items()}
    assert R.latency_summary(df, F.col("v"), [], 7).first().n == len(rows)
