"""python -m logweave.cli: list and run registered queries, and check a stored log."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators import audit as A
from logweave.operators import sequence as S
from logweave.session import local_session


def diagnose(log: DataFrame) -> DataFrame:
    """One row per check of a log: check, found, status (pass or warn)."""
    counts = [
        ("rows", log.agg(F.count("*").alias("n")), False),
        ("streams", log.select(*S.STREAM).distinct().agg(F.count("*").alias("n")), False),
        ("missing numbers", S.missing_ranges(log).agg(F.coalesce(F.sum(F.col("missed_end") - F.col("missed_start")), F.lit(0)).alias("n")), True),
        ("repeated events", A.duplicates(log).agg(F.count("*").alias("n")), True),
        ("rows without clock", log.where("hlc_physical_ns is null").agg(F.count("*").alias("n")), True),
    ]
    out = None
    for name, n, bad in counts:
        status = F.when(F.lit(bad) & (F.col("n") > 0), "warn").otherwise("pass")
        row = n.select(F.lit(name).alias("check"), F.col("n").cast("long").alias("found"), status.alias("status"))
        out = row if out is None else out.unionByName(row)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from logweave.plans import catalog

    parser = argparse.ArgumentParser(prog="logweave")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="list the registered queries")
    run = sub.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("name")
    run.add_argument("folder")
    run.add_argument("--rows", type=int, default=20)
    check = sub.add_parser("diagnose", help="check a stored event log")
    check.add_argument("path")
    args = parser.parse_args(argv)
    if args.command == "queries":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    spark = spark or local_session()
    if args.command == "run":
        if args.name not in catalog.QUERIES:
            print(f"no query {args.name}", file=sys.stderr)
            return 2
        catalog.QUERIES[args.name](spark, args.folder).show(args.rows, truncate=False)
        return 0
    rows = diagnose(spark.read.parquet(args.path)).collect()
    for r in rows:
        print(f"{r.status:5} {r.check}: {r.found}")
    return int(any(r.status == "warn" for r in rows))


if __name__ == "__main__":
    sys.exit(main())
