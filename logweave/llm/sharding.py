"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has `virtual` points on a ring of 64-bit hashes. A document's key is the hash of its text (copies lie together,
ordered among themselves by the hash of their id); it belongs to the shard of the first point clockwise. A shard holds
its share of the rows and no more: shards take their own keys in ring order up to that bound, and keys that overflow
continue clockwise to the next point whose shard has room. The bounds are floor(n / shards), and one more for the first n
mod shards, so the law is `rows`: counts are at most one apart, whatever the keys.

Scale: rows are range-partitioned by their place on the ring, id hash included, so a text with millions of copies spans
partitions. The driver sees one count per partition and one per arc between points (shards * virtual), and gives back
intervals of ring ranks, about as many as arcs; a map turns each row's rank into shard and slot."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

SHARDS = 16
VIRTUAL = 64
_SIGN = np.uint64(1 << 63)


def ring(shards: int, virtual: int = VIRTUAL) -> tuple[np.ndarray, np.ndarray]:
    """(points, shard of each point), by point. A shard's points don't depend on how many shards there are."""
    at = [(xxhash.xxh64_intdigest(f"{s}/{v}"), s) for s in range(shards) for v in range(virtual)]
    at.sort()
    return np.array([p for p, _ in at], dtype=np.uint64), np.array([s for _, s in at], dtype=np.int64)


def bounds(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def assign(counts: list[int], owner: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """(first rank, end rank, shard, first slot) intervals for arcs with these counts of keys, in ring order.

    Ranks number the keys of arc 0, then of arc 1 and so on; an arc's point is where it ends."""
    room, filled, placed, excess, at = list(room), [0] * len(room), [], [], 0
    for arc, n in enumerate(counts):
        own = min(n, room[owner[arc]])
        if own:
            placed.append((at, at + own, owner[arc]))
            room[owner[arc]] -= own
        if n > own:
            excess.append((arc, at + own, at + n))
        at += n
    for arc, start, end in excess:
        step = arc
        while start < end:
            step = (step + 1) % len(counts)
            shard = owner[step]
            if taken := min(room[shard], end - start):
                placed.append((start, start + taken, shard))
                room[shard] -= taken
                start += taken
    out = []
    for start, end, shard in sorted(placed):
        out.append((start, end, shard, filled[shard]))
        filled[shard] += end - start
    return out


def place(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Shard and slot of every document.

    Result, one row per row of `docs`: doc_id, size long (UTF-8 bytes of the text plus 1), text_crc32 long, law ('rows'), shard
    int, slot long (gapless from 0 in each shard), grown_shard int (null: this law has none), and the columns named in
    `carry`, which move with the row. Null texts count as empty ones: size 1, checksum 0. A null id stays null; repeated rows
    take a slot each. Columns that aren't carried are ignored whatever their names. Fewer rows than shards leave shards
    empty; an empty table gives an empty result."""
    points, owner = ring(shards, virtual)
    start = points[-1] + np.uint64(1)  # the ring read from behind its last point: arcs are then runs of ranks, each ended by its point
    turned = points - start
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    carry = list(carry or [])
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("__ring"), F.xxhash64(F.col(id_col)).alias("__order"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)],
    )
    # place on the turned ring, as a long whose signed order is the unsigned one
    turn = int(start.astype(np.int64))
    rows = rows.withColumn("__ring", F.expr(f"cast((cast(__ring as decimal(20,0)) - {turn} + {3 << 64}) % {1 << 64} - {1 << 63} as long)"))
    rows = rows.repartitionByRange("__ring", "__order", "doc_id").sortWithinPartitions("__ring", "__order", "doc_id")
    rows = cut(rows.withColumn("__at", F.monotonically_increasing_id()), "ring")

    edges = np.sort((turned ^ _SIGN).view(np.int64))
    part, local = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)

    def arcs(batches):
        held = np.zeros(len(points), dtype=np.int64)
        for batch in batches:
            at = np.searchsorted(edges, batch["__ring"].to_numpy(zero_copy_only=False), side="left")
            held += np.bincount(at % len(points), minlength=len(points))
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(held[found])], names=["arc", "n"])

    by_arc = rows.select("__ring").mapInArrow(arcs, "arc long, n long").groupBy("arc").agg(F.sum("n").alias("n")).collect()
    by_part = sorted((r.p, r.n) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    return _slots(rows, by_arc, by_part, owner, shards, part, local, carry)


def _slots(rows, by_arc, by_part, owner, shards, part, local, carry) -> DataFrame:
    counts = [0] * len(owner)
    for r in by_arc:
        counts[r.arc] = r.n
    placed = assign(counts, owner.tolist(), bounds(sum(counts), shards))
    starts = np.array([p[0] for p in placed], dtype=np.int64)
    shard, slot = np.array([p[2] for p in placed], dtype=np.int32), np.array([p[3] for p in placed], dtype=np.int64)
    parts = np.array([p for p, _ in by_part], dtype=np.int64)
    before = np.cumsum([0, *(n for _, n in by_part)])[:-1]
    sent = rows.sparkSession.sparkContext.broadcast((starts, shard, slot, parts, before))
    held = ["doc_id", "size", "text_crc32", *[f"__c{i}" for i in range(len(carry))]]

    def run(batches):
        starts, shard, slot, parts, before = sent.value
        for batch in batches:
            rank = before[np.searchsorted(parts, batch["__p"].to_numpy(zero_copy_only=False))] + batch["__l"].to_numpy(zero_copy_only=False)
            at = np.searchsorted(starts, rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in held), pa.array(shard[at]), pa.array(slot[at] + rank - starts[at])], names=[*held, "shard", "slot"])

    schema = T.StructType([*(rows.schema[c] for c in held), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    out = rows.select(*held, part.alias("__p"), local.alias("__l")).mapInArrow(run, schema)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)],
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write doc_id, text and slot of every document to one folder per shard."""
    out = place(docs, shards, id_col=id_col, text_col=text_col, carry=[text_col])
    out.select("doc_id", F.col(text_col).alias("text"), "slot", "shard").write.partitionBy("shard").parquet(path)


def op6_ring_shards(spark, sf_dir: str) -> DataFrame:
    """All documents over 16 shards."""
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet"))
