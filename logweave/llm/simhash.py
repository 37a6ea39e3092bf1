"""SimHash near-duplicates by anchor-point covering.

Fingerprint: 64 bits by majority vote over the XXH64 of a text's three-word shingles. Two fingerprints link at
`THRESHOLD` or fewer differing bits.

Anchors: bits 0-22 and bits 23-45 are each covered by the binary Golay code, in which every 23-bit word has exactly one
codeword within the covering radius of 3. An anchor is a pair of codewords (2^24 of them); the last 18 bits are left
to the comparison. Every fingerprint lives at the one anchor that has it within the covering radius in both blocks, and
is copied to every anchor within covering radius plus threshold: radius 3 + s in one block and 3 + t in the other, for
s + t <= threshold. If x and y differ in s bits of the first and t of the second block, s + t <= threshold, then the
home anchor of x is one that y is copied to. So no link is lost, and comparing home members with visitors per anchor
finds each link from both sides. A fingerprint has 61 copies on average (68 at most) whatever the size of the corpus.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, cut
from .components import connected_components

THRESHOLD = 2
SEED = 42
SHINGLE = 3
BLOCK = 23
RADIUS = 3
#: Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
MASK = (1 << BLOCK) - 1


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one text; zero where it has no word."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    space, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(space(words), SEED)]
    else:
        hashes = [digest(space(w), SEED) for w in zip(words, words[1:], words[2:], strict=False)]
    votes, shingles = np.zeros(64, dtype=np.int64), np.array(hashes, dtype="<u8")
    for i in range(0, len(shingles), 1 << 16):  # bounds the unpacked bits of a very long text
        part = shingles[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id as it is, fp long (the fingerprint's bits as a signed long). One row per row of `docs`, no shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch["text"]), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    schema = T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType())])
    return arrow_map(rows, run, schema)


def _syndrome(word: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator."""
    rest = word.astype(np.int64)
    for bit in range(BLOCK - 1, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@lru_cache(1)
def _errors() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Per syndrome: the error pattern of weight <= RADIUS, and all patterns of weight <= RADIUS + THRESHOLD with what each
    takes of the threshold."""
    patterns = np.array([sum(1 << b for b in bits) for n in range(RADIUS + THRESHOLD + 1) for bits in combinations(range(BLOCK), n)])
    weight, of = np.bitwise_count(patterns), _syndrome(patterns)
    nearest = np.zeros(1 << 11, dtype=np.int64)
    nearest[of[weight <= RADIUS]] = patterns[weight <= RADIUS]
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange((1 << 11) + 1))
    lists = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return nearest, [(patterns[x], np.maximum(weight[x].astype(np.int64) - RADIUS, 0)) for x in lists]


def home_anchor(fps: np.ndarray) -> np.ndarray:
    """The anchor within the covering radius of each fingerprint (uint64 in, int64 out)."""
    nearest, _ = _errors()
    low, high = (fps & np.uint64(MASK)).astype(np.int64), ((fps >> np.uint64(BLOCK)) & np.uint64(MASK)).astype(np.int64)
    return ((high ^ nearest[_syndrome(high)]) << BLOCK) | (low ^ nearest[_syndrome(low)])


def visited_anchors(fp: int) -> np.ndarray:
    """All anchors within covering radius plus threshold of one fingerprint, its home included."""
    _, lists = _errors()
    low, high = fp & MASK, (fp >> BLOCK) & MASK
    (a, s), (b, t) = lists[int(_syndrome(np.array([low]))[0])], lists[int(_syndrome(np.array([high]))[0])]
    near = s[:, None] + t[None, :] <= THRESHOLD
    return (((high ^ b)[None, :] << BLOCK) | (low ^ a)[:, None])[near]


def _copies(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For an array of fingerprints: (row of the fingerprint, anchor) for every copy, fingerprints of like syndromes at once."""
    _, lists = _errors()
    low, high = (fps & np.uint64(MASK)).astype(np.int64), ((fps >> np.uint64(BLOCK)) & np.uint64(MASK)).astype(np.int64)
    at, anchors = [], []
    sl, sh = _syndrome(low), _syndrome(high)
    for i in range(len(fps)):
        (a, s), (b, t) = lists[sl[i]], lists[sh[i]]
        got = (((high[i] ^ b)[None, :] << BLOCK) | (low[i] ^ a)[:, None])[s[:, None] + t[None, :] <= THRESHOLD]
        at.append(np.full(len(got), i))
        anchors.append(got)
    return (np.concatenate(at), np.concatenate(anchors)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def anchor_rows(distinct_fps: DataFrame, home_only: bool) -> DataFrame:
    """(anchor long, fp long) rows of distinct fingerprints: their homes, or all anchors that they are copied to."""

    def run(batches):
        for batch in batches:
            signed = batch["fp"].to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, len(signed), 4096):
                part = signed[i : i + 4096]
                if home_only:
                    at, anchors = slice(None), home_anchor(part.view(np.uint64))
                else:
                    at, anchors = _copies(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(part[at])], names=["anchor", "fp"])

    return distinct_fps.select("fp").mapInArrow(run, "anchor long, fp long")


def fingerprint_links(distinct_fps: DataFrame) -> DataFrame:
    """(u long, v long): all pairs of different fingerprints with at most THRESHOLD differing bits, each from both sides.

    An equi-join per anchor whose comparison is part of the join condition: what does not link is never emitted, and
    adaptive execution can split an anchor that many fingerprints share.

    The join is hinted, as Spark takes the copies to be as large as the fingerprints that they are made from, a 61st of their
    size, and would collect them on the driver for a broadcast."""
    home = anchor_rows(distinct_fps, True).withColumnRenamed("fp", "u").hint("merge")
    away = anchor_rows(distinct_fps, False).withColumnRenamed("fp", "v")
    differ = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    return home.join(away, (home.anchor == away.anchor) & differ.between(1, THRESHOLD)).select("u", "v")


def hex_of(fp: Column) -> Column:
    """16 lowercase hex digits of a signed long's bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of near-duplicate documents.

    Result, one row per row of `docs`: doc_id, fingerprint string, component_id (the smallest doc_id of the class), kept
    boolean (doc_id = component_id). Other columns of `docs` are ignored whatever their names.

    Equal fingerprints link without a comparison: they are grouped first, so a group of copies costs one row from then
    on. Null, empty and blank texts have fingerprint zero and link like any other. Rows with a null id take part; they
    never name a class, and a class of null ids alone has a null component_id and keeps nothing. Repeated rows are rows of
    the same class. An empty table gives an empty result."""
    fps = cut(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = connected_components(fingerprint_links(classes))
    linked = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = linked.join(smallest, "root").select("fp", "component_id")
    # every fingerprint has its row in ids; a left join, as of an inner one Spark may broadcast the documents
    return fps.join(ids, "fp", "left").select(
        "doc_id",
        hex_of(F.col("fp")).alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def op8_anchor_simhash(spark, sf_dir: str) -> DataFrame:
    """All documents by anchor-point covering."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
