"""Connected components by contraction, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """Label the ends of `edges` (u long, v long) by component.

    Result: node long, root long, one row per node of an edge; two nodes share a root iff a path joins them. The
    root is some node of the component, not the smallest one: callers aggregate what they need by root.
    Null ends and loops link nothing and give no rows; repeated edges change nothing; no edges, no rows.

    Each round hooks every node onto the neighbour (or itself) that comes first in a hashed order and contracts the
    edges. The hashed order makes a constant share of the nodes disappear per round whatever the ids look like
    (paths of rising ids too), and at least one per round in any case, so the rounds end. Every step is a partially aggregated group-by or an equi-join that adaptive
    execution can split, so a hub node is no hot task; nothing is collected but the count of edges left."""
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("n"))
    both = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    both = cut(both, "edges")
    labels = None
    while not both.isEmpty():
        ends = both.select("u", "v").unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = ends.groupBy("u").agg(F.least(F.min(order(F.col("v"))), order(F.col("u")))["n"].alias("to"))
        hook = cut(hook.withColumnRenamed("u", "at"), "hook")
        if labels is None:
            labels = hook.select(F.col("at").alias("node"), F.col("to").alias("root"))
        else:
            labels = cut(
                labels.join(hook, labels.root == hook["at"], "left").select("node", F.coalesce("to", "root").alias("root")), "labels"
            )
        a, b = hook.select(F.col("at").alias("u"), F.col("to").alias("a")), hook.select(F.col("at").alias("v"), F.col("to").alias("b"))
        both = both.join(a, "u").join(b, "v").where("a <> b")
        both = cut(both.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    if labels is None:
        return both.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels
