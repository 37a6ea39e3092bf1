"""Configuration files: topics, components, nodes. JSON needs nothing; YAML is read where a YAML library is installed."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

COMPONENTS = "name string, kind string, topic string, input_topic string, output_topic string, codec string, instances int"
TOPICS = "name string, key_prefix string, num_partitions int, replication_factor int, codec string"
TOPIC_DEFAULTS = {"num_partitions": 16, "replication_factor": 1, "codec": "postcard"}


def load(path: str) -> dict:
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs a YAML library; write the file as JSON") from e
    return yaml.safe_load(text)


def _rows(entries: list[dict], schema: str, defaults: dict) -> list[tuple]:
    names = [f.split()[0] for f in schema.split(", ")]
    unknown = {k for e in entries for k in e} - set(names)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return [tuple(e.get(n, defaults.get(n)) for n in names) for e in entries]


def topics(spark: SparkSession, config: dict) -> DataFrame:
    return spark.createDataFrame(_rows(config.get("topics", []), TOPICS, TOPIC_DEFAULTS), TOPICS)


def components(spark: SparkSession, config: dict) -> DataFrame:
    return spark.createDataFrame(_rows(config.get("components", []), COMPONENTS, {"instances": 1}), COMPONENTS)
