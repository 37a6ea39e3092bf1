"""How many tasks a sort is dealt to."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of stored input, as Spark estimates them, for each task. A task of a window holds some tens of times as much when it sorts.
SHARE = 4 << 20
#: Times the setting at most: of joins and of rows that aren't from files, Spark's estimate is far too high.
MOST = 10


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """`rows` dealt by `keys` to as many tasks as Spark's setting for shuffles says, and to more where the input is larger.

    Adaptive execution joins partitions up to 64 MB as compressed for the shuffle, which a window's sorts may turn into
    gigabytes for one task; it leaves a number that is asked for. Inputs of less than a share are left to it."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < SHARE:
        return rows
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, min(-(-size // SHARE), MOST * least)), *keys)
