"""Synthetic payloads and streams, fully determined by a seed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unit(row: Column, field: str, seed: int) -> Column:
    """A number in [0, 1) from a row's id, a field's name and the seed: the same in every run and partitioning."""
    text = F.concat_ws("|", row.cast("string"), F.lit(field), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def field(row: Column, name: str, spec: dict, seed: int = 0) -> Column:
    """One generated field. Kinds: float and int (min, max), bool (p), enum (values), uuid, datetime (start, step_ms),
    counter, and pattern, in which {N-M} is a whole number between both."""
    u, kind = unit(row, name, seed), spec["type"]
    if kind == "float":
        return u * (spec["max"] - spec["min"]) + spec["min"]
    if kind == "int":
        return (F.floor(u * (spec["max"] - spec["min"] + 1)) + spec["min"]).cast("long")
    if kind == "bool":
        return u < spec.get("p", 0.5)
    if kind == "enum":
        return F.element_at(F.array(*map(F.lit, spec["values"])), (F.floor(u * len(spec["values"])) + 1).cast("int"))
    if kind == "uuid":
        h = F.md5(F.concat_ws("|", row.cast("string"), F.lit(name), F.lit(str(seed))).cast("binary"))
        return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    if kind == "datetime":
        return F.timestamp_micros(F.lit(spec.get("start_us", 0)) + row * (spec.get("step_ms", 1000) * 1000))
    if kind == "counter":
        return row.cast("long")
    if kind == "pattern":
        parts = re.split(r"\{(\d+)-(\d+)\}", spec["pattern"])
        out = [F.lit(parts[0])]
        for i in range(1, len(parts), 3):
            low, high = int(parts[i]), int(parts[i + 1])
            v = F.floor(unit(row, f"{name}#{i}", seed) * (high - low + 1)) + low
            out += [v.cast("long").cast("string"), F.lit(parts[i + 2])]
        return F.concat(*out)
    raise ValueError(f"unknown field type {kind!r}")


def payloads(rows: DataFrame, kind: str, spec: dict | None = None, size: int = 256, seed: int = 0, id_col: str = "id") -> DataFrame:
    """`rows` with a payload string: schema (JSON of generated fields), counter, fixed (size letters) or random_json."""
    row, spec = F.col(id_col), spec or {}
    if kind == "schema":
        body = F.to_json(F.struct(*[field(row, n, s, seed).alias(n) for n, s in spec.items()]))
    elif kind == "counter":
        body = F.to_json(F.struct(row.alias("counter")))
    elif kind == "fixed":
        body = F.repeat(F.lit(spec.get("letter", "x")), F.lit(size))
    elif kind == "random_json":
        fill = F.repeat(F.md5(F.concat_ws("|", row.cast("string"), F.lit(str(seed))).cast("binary")), F.lit(size // 32 + 1))
        body = F.to_json(F.struct(row.alias("id"), F.substring(fill, 1, size).alias("data")))
    else:
        raise ValueError(f"unknown payload kind {kind!r}")
    return rows.withColumn("payload", body)


def batch(spark: SparkSession, n: int, kind: str, spec: dict | None = None, size: int = 256, seed: int = 0) -> DataFrame:
    return payloads(spark.range(n), kind, spec, size, seed)


def stream(spark: SparkSession, per_second: int, kind: str, spec: dict | None = None, size: int = 256, seed: int = 0) -> DataFrame:
    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return payloads(rows.withColumnRenamed("value", "id"), kind, spec, size, seed)
