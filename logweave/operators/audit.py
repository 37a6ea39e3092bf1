"""Delivery audits over published and received manifests (event_id, seq, publisher_id, partition, checksum, line, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("publisher_id", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("payload_checksum", T.LongType()),
        T.StructField("role", T.StringType()),
    ]
)


def read_manifests(spark, folder: str, role: str | None = None) -> DataFrame:
    """All *.jsonl files of a folder with file and line columns that give their order; blank lines are skipped."""
    text = spark.read.text(f"{folder}/*.jsonl").withColumn("file", F.input_file_name()).withColumn("line", F.monotonically_increasing_id())
    rows = text.where(F.length(F.trim("value")) > 0).select("file", "line", F.from_json("value", MANIFEST).alias("m")).select("file", "line", "m.*")
    return rows if role is None else rows.where(F.col("role") == role)


def write_manifest(rows: DataFrame, path: str, order: list | None = None) -> None:
    """One JSON line per row; with `order` each gets a running number from 0."""
    if order:
        rows = rows.withColumn("sequence", F.row_number().over(Window.orderBy(*order)) - 1)
    rows.write.mode("overwrite").json(path)


def first_published(published: DataFrame, order: list) -> DataFrame:
    w = Window.partitionBy("event_id").orderBy(*order)
    return published.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def missing(published: DataFrame, received: DataFrame) -> DataFrame:
    return published.select("event_id").distinct().join(received, "event_id", "left_anti")


def duplicates(received: DataFrame) -> DataFrame:
    return received.groupBy("event_id").agg(F.count("*").alias("times")).where("times > 1")


def checksum_mismatches(published: DataFrame, received: DataFrame) -> DataFrame:
    """event_id, published, received: every received row whose checksum is not that of the first publication."""
    first = first_published(published, ["line"]).select("event_id", F.col("checksum").alias("published"))
    return received.join(first, "event_id").where("checksum <> published").select("event_id", "published", F.col("checksum").alias("received"))


def ordering_violations(received: DataFrame, per_partition: bool = False, chunk: int = 1 << 18) -> DataFrame:
    """Rows whose number is below that of the row received before, per publisher (and partition if asked).

    Rows are compared within chunks of lines; the first of a chunk meets the last row of the chunk before, of which there is
    one per publisher and chunk."""
    by = ["publisher_id", "partition"] if per_partition else ["publisher_id"]
    rows = received.withColumn("__chunk", F.expr(f"line div {chunk}"))
    ends = rows.groupBy(*by, "__chunk").agg(F.max_by("seq", "line").alias("__last"))
    ends = ends.withColumn("__before", F.lag("__last").over(Window.partitionBy(*by).orderBy("__chunk"))).drop("__last")
    rows = rows.join(ends, [*by, "__chunk"])
    within = F.lag("seq").over(Window.partitionBy(*by, "__chunk").orderBy("line"))
    rows = rows.withColumn("previous_seq", F.coalesce(within, "__before"))
    return rows.where("seq < previous_seq").select("publisher_id", "line", "seq", "previous_seq")


def report(published: DataFrame, received: DataFrame) -> DataFrame:
    """One row of totals with a verdict; order doesn't count for it. Four counts that run in parallel, joined by nothing."""
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    counts = n(published.select("event_id").distinct(), "published").unionByName(n(received, "received")).unionByName(n(missing(published, received), "missing"))
    counts = counts.unionByName(n(duplicates(received), "duplicates")).unionByName(n(checksum_mismatches(published, received), "mismatches"))
    counts = counts.unionByName(n(ordering_violations(received), "disordered"))
    names = ["published", "received", "missing", "duplicates", "mismatches", "disordered"]
    wide = counts.groupBy().agg(*[F.sum(F.when(F.col("what") == c, F.col("n"))).alias(c) for c in names])
    good = (F.col("missing") == 0) & (F.col("duplicates") == 0) & (F.col("mismatches") == 0)
    return wide.withColumn("verdict", F.when(good, "pass").otherwise("fail"))
