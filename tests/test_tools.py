"""Offload state machine, chaos timelines, configuration tables and the command line."""

import json

import pytest

from logweave import cli
from logweave.operators import log as L
from logweave.operators.offload import offload_events, offload_steps
from logweave.plans import catalog
from logweave.sources import chaos, configs
from logweave.sources.adapters import event_log


def test_offload_steps():
    samples = [(0, 0.9, 0), (1, 0.9, 0), (2, 0.1, 0), (3, 0.9, 50), (6, 0.9, 60), (7, 0.5, 60), (8, 0.0, 60), (9, 0.0, 9), (10, 0.9, 9)]
    got = offload_steps(samples, 0.8, 100, 2, 10)
    assert got == [(6, "lag_detected", "DRAINING", 60), (8, "drained", "CATCHING_UP", 60), (9, "caught_up", "LIVE", 9)]
    assert offload_steps([(0, 0.9, 0), (2, 0.9, 0)], 0.8, 100, 2, 10) == []


def test_offload_table_follows_the_steps(spark, sf_dir):
    from pyspark.sql import functions as F

    rows = event_log(spark, sf_dir).select(F.col("publisher_id").alias("consumer"), "ts", ((F.col("event_no") % 10) / 10.0).alias("fullness"), (F.col("event_no") % 900).alias("lag"))
    got = [(r.consumer, r.event) for r in offload_events(rows, 0.5, 600, 3_600_000_000, 50).orderBy("consumer", "ts").collect()]
    want, by = [], {}
    for r in rows.orderBy("consumer", "ts").collect():
        by.setdefault(r.consumer, []).append((round(r.ts.timestamp() * 1e6), r.fullness, r.lag))
    for c in sorted(by):
        want += [(c, s[1]) for s in offload_steps(by[c], 0.5, 600, 3_600_000_000, 50)]
    assert got == want and got


def test_timelines():
    actions = (chaos.Action("kill", 1, 5000), chaos.Action("pause", 3))
    plan = chaos.Plan(2.0, 60_000, 500, 1, actions, ("a", "b"))
    one = chaos.timeline(plan, 3)
    assert one == chaos.timeline(plan, 3) != chaos.timeline(plan, 4) and [e[0] for e in one] == list(range(len(one)))
    at = [e[1] for e in one]
    assert all(b - a >= 499 for a, b in zip(at, at[1:], strict=False)) and max(at) < 60_000
    for i, e in enumerate(one):
        assert sum(o[1] + o[4] > e[1] for o in one[:i] if o[4]) == 0
    assert chaos.timeline(chaos.Plan(2.0, 1000), 1) == []


def test_restamp(spark):
    rows = spark.createDataFrame([("b", 5, 0), ("a", 5, 0), ("a", 1, 7)], "source string, elapsed_ms long, sequence long")
    assert [(r.source, r.sequence) for r in chaos.restamp(rows).orderBy("sequence").collect()] == [("a", 0), ("a", 1), ("b", 2)]


def test_configs(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"topics": [{"name": "t"}], "components": [{"name": "p", "kind": "producer", "topic": "t"}]}))
    config = configs.load(str(path))
    assert configs.topics(spark, config).first().num_partitions == 16 and configs.components(spark, config).first().instances == 1
    with pytest.raises(ValueError):
        configs.topics(spark, {"topics": [{"nome": "t"}]})


def test_command_line(spark, sf_dir, tmp_path, capsys):
    assert cli.main(["queries"]) == 0 and "replay_all" in capsys.readouterr().out.split()
    assert cli.main(["run", "known_groups", sf_dir], spark) == 0 and "g1" in capsys.readouterr().out
    assert cli.main(["run", "nothing", sf_dir], spark) == 2
    L.write_log(event_log(spark, sf_dir), str(tmp_path / "log"))
    assert cli.main(["diagnose", str(tmp_path / "log")], spark) == 1
    assert "warn  missing numbers" in capsys.readouterr().out


def test_every_query_has_a_name_of_its_own():
    assert len(catalog.QUERIES) > 100 and set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
