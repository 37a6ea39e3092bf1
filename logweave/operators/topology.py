"""Configuration of topologies: inheritance, validation and cycles over small component tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inherit(components: DataFrame, topics: DataFrame, defaults: dict) -> DataFrame:
    """Settings of each component: its own, else its topic's, else the default. Columns named in `defaults` are settings."""
    t = topics.select(F.col("name").alias("__topic"), *[F.col(c).alias(f"__{c}") for c in defaults])
    joined = components.join(t, components.topic == F.col("__topic"), "left")
    held = [F.col(c) for c in components.columns if c not in defaults]
    return joined.select(*held, *[F.coalesce(F.col(c), F.col(f"__{c}"), F.lit(v)).alias(c) for c, v in defaults.items()])


def duplicate_names(components: DataFrame) -> DataFrame:
    return components.groupBy("name").agg(F.count("*").alias("times")).where("times > 1")


def unknown_topics(components: DataFrame, topics: DataFrame) -> DataFrame:
    """name, topic: references to topics that don't exist."""
    used = components.select("name", F.explode(F.array("topic", "input_topic", "output_topic")).alias("topic")).where("topic is not null").distinct()
    return used.join(topics.select(F.col("name").alias("topic")), "topic", "left_anti").select("name", "topic")


def uncovered_topics(components: DataFrame) -> DataFrame:
    """Topics that are consumed and that nothing produces."""
    consumed = components.where("kind = 'consumer'").select(F.col("topic")).unionByName(components.select(F.col("input_topic").alias("topic")))
    produced = components.where("kind = 'producer'").select("topic").unionByName(components.select(F.col("output_topic").alias("topic")))
    return consumed.where("topic is not null").distinct().join(produced.where("topic is not null").distinct(), "topic", "left_anti")


def unstored_topics(topics: DataFrame, components: DataFrame) -> DataFrame:
    stored = components.where("kind = 'storage'").select("topic")
    return topics.select(F.col("name").alias("topic")).join(stored, "topic", "left_anti")


def cyclic_topics(components: DataFrame) -> DataFrame:
    """Topics on a cycle of processors, or between cycles: what is left when topics without way in or way out are peeled off.

    The edges are a configuration table; each of them is looked at once per end, so chains may be as long as they like."""
    edges = components.where("input_topic is not null and output_topic is not null").select(F.col("input_topic").alias("a"), F.col("output_topic").alias("b")).distinct()
    rows = [(r.a, r.b) for r in edges.limit(100_001).collect()]
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 edges are no configuration table")
    left = {t for e in rows for t in e}
    for ends in (rows, [(b, a) for a, b in rows]):
        after, ways_in = {}, dict.fromkeys(left, 0)
        for a, b in ends:
            if a in left and b in left:
                after.setdefault(a, []).append(b)
                ways_in[b] += 1
        bare = [t for t, n in ways_in.items() if not n]
        while bare:
            t = bare.pop()
            left.discard(t)
            for b in after.get(t, ()):
                ways_in[b] -= 1
                if not ways_in[b]:
                    bare.append(b)
    return components.sparkSession.createDataFrame([(t,) for t in sorted(left)], "topic string")
