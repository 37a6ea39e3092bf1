"""Seeded timelines of faults for test runs: Poisson arrivals, weighted actions, a least distance and a bound on open faults."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Action:
    name: str
    weight: float
    duration_ms: int = 0


@dataclass(frozen=True)
class Plan:
    rate_per_second: float
    duration_ms: int
    min_interval_ms: int = 0
    max_concurrent: int = 1
    actions: tuple[Action, ...] = ()
    targets: tuple[str, ...] = ()


def timeline(plan: Plan, seed: int) -> list[tuple[int, int, str, str, int]]:
    """(sequence, elapsed_ms, action, target, duration_ms) events; the same seed gives the same events on any machine."""
    if not plan.actions or not plan.targets or plan.rate_per_second <= 0:
        return []
    rng, at, last, open_until, out = random.Random(seed), 0.0, -math.inf, [], []
    weights = [a.weight for a in plan.actions]
    while True:
        at += -math.log(1.0 - rng.random()) / plan.rate_per_second * 1000
        if at >= plan.duration_ms:
            return out
        action, target = rng.choices(plan.actions, weights)[0], rng.choice(plan.targets)
        open_until = [t for t in open_until if t > at]
        if at - last < plan.min_interval_ms or len(open_until) >= plan.max_concurrent:
            continue
        last = at
        if action.duration_ms:
            open_until.append(at + action.duration_ms)
        out.append((len(out), int(at), action.name, target, action.duration_ms))


def timeline_table(spark: SparkSession, plan: Plan, seed: int) -> DataFrame:
    return spark.createDataFrame(timeline(plan, seed), "sequence long, elapsed_ms long, action string, target string, duration_ms long")


def restamp(entries: DataFrame) -> DataFrame:
    """Chaos manifest entries of several writers with one running sequence in order of time, source and own sequence."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.orderBy("elapsed_ms", "source", "sequence")
    return entries.withColumn("sequence", (F.row_number().over(w) - 1).cast("long"))
