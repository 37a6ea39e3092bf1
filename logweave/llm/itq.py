"""Embedding near-duplicates: iterative quantisation codes, multi-index Hamming tables, rerank by the original vectors.

1. Equal vectors form a class; from then on a class is one row, so a very common vector costs one row.
2. A rotation that balances and decorrelates binary codes is learned on a bounded sample of classes (`FIT_ROWS`).
3. Every class gets a 64-bit code, cut into `TABLES` substrings. Table t holds each code under its t-th substring and under
   all substrings at one differing bit; two codes whose t-th substrings differ in two bits or fewer meet there. So
   all pairs with up to 3 * TABLES - 1 = 11 differing bits meet for certain. How many of the others meet is measured on pairs
   planted at the threshold around the sample; where it is less than `RECALL` codes get further words from random rotations,
   and so further tables, until it isn't. Where `MOST_WORDS` about the mean don't suffice (nearly parallel vectors), codes are
   random rotations of the vectors as they are: there a pair's chance to meet depends on its angle alone.
4. Vectors within half the threshold's angle of a pivot all link with each other, as angles obey the triangle inequality. Such
   groups are found first and counted, so a dense group of n near copies costs n rows and not n^2 pairs. Pivots are the
   smallest ids that share a substring with a vector, and in a second round the pivots of those that do.
5. Other pairs that meet are compared by the whole code inside the join, and each is emitted by one table and key only.
6. Cosine in double precision on the original vectors decides. No pair below the threshold links.

Growth: a code has 17 rows per table, four tables for centred vectors and up to 4 * MOST_WORDS for others. The pairs that meet by chance grow with n^2 / 2^(64 / TABLES); for corpora far
above 10^7 vectors use fewer, longer substrings (TABLES = 2) - the number of rows per code stays linear in the bits.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, sample_by_hash
from .components import connected_components

THRESHOLD = 0.9
BITS = 64
TABLES = 4
#: Tables are added until at least this share of planted pairs is found, in the worse of two ways to plant them.
RECALL = 0.99
PLANTED, MOST_WORDS = 4000, 8
#: Pairs with more differing bits than all but this share of the planted pairs, and than MAX_BITS, are not reranked. At cosine
#: 0.9 a pair of centred vectors differs in 9.2 bits of a word on average (sd 2.8).
BEYOND, MAX_BITS = 0.001, 18
#: At most so many vectors, and so many numbers in them, are collected to learn the rotation.
FIT_ROWS, FIT_VALUES = 20_000, 4_000_000
ROUNDS = 40


def usable(vec):
    """True where a vector has components, all finite, and one that is not zero. Never null."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vec) > 0) & F.forall(vec, number) & F.exists(vec, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, without overflow for large or tiny components."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection d x BITS) learned from unit vectors: principal directions, then the ITQ rotation.

    With fewer than BITS dimensions several rotations, each from its own start, fill the code."""
    d, rng = sample.shape[1], np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    x = sample - mean
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, : min(d, BITS)]
    low, parts = x @ axes, []
    while sum(p.shape[1] for p in parts) < BITS:
        turn = np.linalg.qr(rng.normal(size=(low.shape[1], low.shape[1])))[0]
        for _ in range(ROUNDS):
            signs = np.where(low @ turn >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(signs.T @ low)
            turn = vt.T @ u.T
        parts.append(axes @ turn)
    return mean, np.concatenate(parts, axis=1)[:, :BITS]


def random_words(d: int, n: int, seed: int = 0) -> np.ndarray:
    """Projection d x (n * BITS) of random rotations."""
    rng, parts, have = np.random.default_rng(seed), [], 0
    while have < n * BITS:
        parts.append(np.linalg.qr(rng.normal(size=(d, min(d, BITS))))[0] * rng.choice([-1.0, 1.0], min(d, BITS)))
        have += min(d, BITS)
    return np.concatenate(parts, axis=1)[:, : n * BITS]


def planted(sample: np.ndarray, threshold: float, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors whose cosine is the threshold: sampled ones turned in any direction, and towards one another."""
    rng, d = np.random.default_rng(seed), sample.shape[1]
    x = sample[rng.integers(0, len(sample), PLANTED)]
    cosine = np.clip(threshold, -1.0, 1.0)
    out = []
    for z in (rng.normal(size=(PLANTED, d)), sample[rng.integers(0, len(sample), PLANTED)]):
        aside = z - (z * x).sum(axis=1, keepdims=True) * x
        length = np.sqrt((aside * aside).sum(axis=1, keepdims=True))
        ok = length[:, 0] > 1e-6
        if ok.any():
            out.append((x[ok], cosine * x[ok] + np.sqrt(1 - cosine**2) * aside[ok] / length[ok]))
    return out


def needed(model: tuple[np.ndarray, np.ndarray], pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[int | None, list[int]]:
    """(tables that find RECALL of the pairs, None if the model's words don't suffice; bits to allow for 1, 2, ... words)."""
    mean, projection = model
    words, width = projection.shape[1] // BITS, BITS // TABLES
    differ = [((x - mean) @ projection >= 0) != ((y - mean) @ projection >= 0) for x, y in pairs]
    bits = [b.reshape(len(b), words, BITS).sum(axis=2).cumsum(axis=1) for b in differ]
    allowed = [max(MAX_BITS, *[int(np.ceil(np.quantile(b[:, w], 1 - BEYOND))) for b in bits]) if bits else MAX_BITS for w in range(words)]
    met = [np.logical_or.accumulate(b.reshape(len(b), words * TABLES, width).sum(axis=2) <= 2, axis=1) for b in differ]
    for t in range(TABLES, words * TABLES + 1):
        w = (t - 1) // TABLES
        if all((m[:, t - 1] & (b[:, w] <= allowed[w])).mean() >= RECALL for m, b in zip(met, bits, strict=True)):
            return t, allowed
    return None, allowed


def choose(sample: np.ndarray, centred: bool, threshold: float) -> tuple[tuple[np.ndarray, np.ndarray], int, list[int]]:
    """(model of MOST_WORDS words, tables, bits to allow) for unit vectors."""
    d, pairs = sample.shape[1], planted(sample, threshold)
    if centred:
        mean, first = fit(sample)
        model = mean, np.concatenate([first, random_words(d, MOST_WORDS - 1, 1)], axis=1)
        tables, allowed = needed(model, pairs)
        if tables:
            return model, tables, allowed
    model = np.zeros(d), random_words(d, MOST_WORDS, 2)
    tables, allowed = needed(model, pairs)
    if not tables:
        logging.getLogger(__name__).warning("%d tables find fewer than %s of the pairs at the threshold", MOST_WORDS * TABLES, RECALL)
    return model, tables or MOST_WORDS * TABLES, allowed


def encode(rows: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Signed 64-bit words of the codes of vectors, a row each."""
    mean, projection = model
    bits = (unit(rows) - mean) @ projection >= 0
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def learn(classes: DataFrame, threshold: float) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], int, int]:
    """(one model per vector length, tables, most differing bits). Lengths of which the sample has too few get random rotations
    about zero."""
    lengths = [r[0] for r in classes.select(F.size("embedding").alias("d")).distinct().limit(65).collect()]
    if len(lengths) > 64:
        raise ValueError("embeddings of more than 64 lengths in one table")
    if not lengths:
        return {}, TABLES, MAX_BITS
    bound = max(64, min(FIT_ROWS, FIT_VALUES // max(lengths)))
    sample = sample_by_hash(classes.select("first", "embedding"), "first", bound).select("embedding").toArrow()["embedding"].combine_chunks()
    size = np.array([len(x) for x in sample]) if len(sample) else np.zeros(0, int)
    chosen = {}
    for d in lengths:
        own = sample.filter(pa.array(size == d))
        few = len(own) < BITS
        chosen[d] = choose(unit(np.random.default_rng(d).normal(size=(256, d))) if few else unit(_matrix(own, d)), not few, threshold)
    tables = max(t for _, t, _ in chosen.values())
    words = -(-tables // TABLES)
    models = {d: (mean, projection[:, : words * BITS]) for d, ((mean, projection), _, _) in chosen.items()}
    return models, tables, max(allowed[words - 1] for _, _, allowed in chosen.values())


def word_names(models: dict) -> list[str]:
    """Columns of the words of a code: code, code1, ..."""
    words = max((p.shape[1] // BITS for _, p in models.values()), default=1)
    return ["code", *(f"code{w}" for w in range(1, words))]


def codes(classes: DataFrame, models: dict) -> DataFrame:
    """node, d int, the words of the code (longs), embedding."""
    sent, names = classes.sparkSession.sparkContext.broadcast(models), word_names(models)

    def run(batches):
        for batch in batches:
            vectors = batch["embedding"]
            d = np.array(vectors.value_lengths())
            code = np.zeros((len(d), len(names)), dtype=np.int64)
            for n in np.unique(d):
                at = d == n
                code[at] = encode(_matrix(vectors.filter(pa.array(at)), n), sent.value[int(n)])
            words = [pa.array(np.ascontiguousarray(w)) for w in code.T]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(d.astype(np.int32)), *words, vectors], names=["node", "d", *names, "embedding"])

    element = classes.schema["embedding"].dataType.simpleString()
    return arrow_map(classes.select("node", "embedding"), run, f"node long, d int, {', '.join(f'{c} long' for c in names)}, embedding {element}")


def _substring(code: str, t: str) -> str:
    """SQL for the t-th substring of a word of a code."""
    width = BITS // TABLES
    return f"(shiftrightunsigned({code}, {t} * {width}) & {(1 << width) - 1}L)"


def _close(pairs: DataFrame, least: float, held: list[str]) -> DataFrame:
    """The columns `held` (longs) of the rows whose vectors a and b have a cosine of at least `least`."""

    def run(batches):
        for batch in batches:
            n = np.array(batch["a"].value_lengths())
            keep = np.zeros(len(n), dtype=bool)
            for d in np.unique(n):
                at = n == d
                pick = pa.array(at)
                a, b = unit(_matrix(batch["a"].filter(pick), d)), unit(_matrix(batch["b"].filter(pick), d))
                keep[at] = (a * b).sum(axis=1) >= least
            yield batch.select(held).filter(pa.array(keep))

    return arrow_map(pairs.select(*held, "a", "b"), run, ", ".join(f"{c} long" for c in held))


def pivots(coded: DataFrame, threshold: float) -> DataFrame:
    """node, pivot for the nodes that lie within half the threshold's angle of a pivot other than themselves.

    Nodes of one pivot link pairwise. Every bucket proposes the smallest pivot that its members have, in the first round
    the smallest of its members; of the pivots that are near enough a node takes the smallest."""
    half = float(np.cos(np.arccos(np.clip(threshold, -1.0, 1.0)) / 2)) + 1e-9  # the margin covers rounding
    tables = F.array(*map(F.lit, range(TABLES)))
    own = coded.select("node", F.col("embedding").alias("a"))
    other = coded.select(F.col("node").alias("pivot"), F.col("embedding").alias("b"))
    rows = coded.select("node", "d", "code", F.explode(tables).alias("t")).select("node", "d", "t", F.expr(_substring("code", "t")).alias("key"))
    found = None
    for _ in range(2):
        now = rows.withColumn("has", F.col("node")) if found is None else rows.join(found, "node", "left").withColumn("has", F.coalesce("pivot", "node")).drop("pivot")
        best = cut(now.groupBy("d", "t", "key").agg(F.min("has").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n"), "buckets")
        tried = rows.join(best, ["d", "t", "key"]).where("pivot <> node").select("node", "pivot").distinct()
        near = _close(tried.join(own, "node").join(other, "pivot"), half, ["node", "pivot"])
        if found is not None:
            near = near.unionByName(found)
        found = cut(near.groupBy("node").agg(F.min("pivot").alias("pivot")), "pivots")
    return found


def candidates(coded: DataFrame, names: list[str], tables: int, max_bits: int) -> DataFrame:
    """(u, v), u < v: pairs of codes that meet in a table and differ in at most `max_bits` bits, each once. `coded` has node, d, the
    words of the code and pivot; pairs of one pivot are left out."""
    width = BITS // TABLES
    own = F.array(*[F.struct(F.lit(t).alias("t"), F.expr(_substring(names[t // TABLES], str(t % TABLES))).alias("s")) for t in range(tables)])
    probes = F.array(*[F.lit(m).cast("long") for m in [0, *(1 << b for b in range(width))]])
    rows = coded.select("node", "d", "pivot", *names, F.explode(own).alias("o")).select("*", F.explode(probes).alias("m"))
    side = lambda names_of: rows.select(
        *[F.expr(e).alias(n) for e, n in zip(["node", "pivot", "d", "o.t", "o.s", "o.s ^ m", *names], names_of, strict=True)]
    )
    a = side(["u", "p", "d", "t", "s", "key", *(f"x{w}" for w in range(len(names)))])
    b = side(["v", "q", "d2", "t2", "s2", "key2", *(f"y{w}" for w in range(len(names)))])
    apart = [f"(x{w} ^ y{w})" for w in range(len(names))]
    total = " + ".join(f"bit_count({x})" for x in apart)
    first = "".join(f" AND (t <= {t} OR bit_count({_substring(apart[t // TABLES], str(t % TABLES))}) > 2)" for t in range(tables - 1))
    #: of the keys that both reach, the one whose distance to u's own substring is the lowest differing bit, or nothing
    only = "(key ^ s) = CASE WHEN bit_count(s ^ s2) = 2 THEN (s ^ s2) & -(s ^ s2) ELSE 0L END"
    on = F.expr(f"d = d2 AND t = t2 AND key = key2 AND u < v AND p <> q AND {total} <= {max_bits} AND {only}{first}")
    return a.join(b, on).select("u", "v")


def links(classes: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Two tables of links between classes: (node, pivot), where the nodes of one pivot link pairwise, a row per node; and
    (u, v), u < v, of the other pairs with a cosine of at least `threshold`."""
    models, tables, max_bits = learn(classes, threshold)
    names = word_names(models)
    coded = cut(codes(classes, models), "codes")
    near = pivots(coded, threshold)
    grouped = coded.select("node").join(near, "node", "left").select("node", F.coalesce("pivot", "node").alias("pivot"))
    grouped = cut(grouped, "groups")
    one = coded.select(F.col("node").alias("u"), F.col("embedding").alias("a"))
    two = coded.select(F.col("node").alias("v"), F.col("embedding").alias("b"))
    met = candidates(coded.select("node", "d", *names).join(grouped, "node"), names, tables, max_bits)
    return grouped, _close(met.join(one, "u").join(two, "v"), threshold, ["u", "v"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Links and classes of near-equal vectors.

    Result, one row per row of `vectors`: vec_id, n_links long (other rows linked directly), component_id long (smallest vec_id
    reachable, itself included), kept boolean (vec_id = component_id). Other columns are ignored whatever their names.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different
    lengths with each other; such a row has no links and is its own component. A null vec_id links with nothing, has a null
    component_id and is not kept. Rows with equal vectors link with each other; an id that names several vectors is each of
    them. An empty table gives an empty result."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    good = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    classes = rows.where(good).groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("size"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    groups, pairs = links(classes, threshold)
    found = cut(pairs, "links")
    sizes = classes.select("node", "size")
    ends = found.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(found.select(F.col("v").alias("node"), F.col("u").alias("other")))
    across = ends.join(sizes.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.sum("size").alias("n"))
    members = cut(groups.join(sizes, "node"), "members")
    whole = cut(members.groupBy("pivot").agg(F.sum("size").alias("total"), F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1"), "whole")
    inside = members.join(whole, "pivot")
    within = inside.select("node", (F.col("total") - F.col("size")).alias("n"))
    beside = across.unionByName(within).groupBy("node").agg(F.sum("n").alias("beside"))
    roots = cut(connected_components(found.unionByName(inside.select(F.col("node").alias("u"), F.col("head").alias("v")))), "roots")
    smallest = roots.join(classes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("smallest"))
    component = roots.join(smallest, "root").select("node", "smallest")
    known = classes.join(beside, "node", "left").join(component, "node", "left").select(
        F.col("embedding").alias("vector"),
        (F.col("size") - 1 + F.coalesce("beside", F.lit(0))).alias("n_links"),
        F.coalesce("smallest", "first").alias("component_id"),
    )
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.where(good).join(known, F.col("embedding") == F.col("vector")).select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_itq_near_dup(spark, sf_dir: str) -> DataFrame:
    """All embeddings against all."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Brute force: every pair is compared. The query finds pairs by codes, so on tables where it misses a link the two differ.
OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE (SELECT bool_and(x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x)) AND bool_or(x <> 0) FROM (SELECT unnest(e) AS x))
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (SELECT u, w FROM l UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u
), n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u
), c AS (SELECT u, min(w) AS smallest FROM r GROUP BY u
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, smallest) AS component_id, vec_id = least(vec_id, smallest) AS kept
FROM v LEFT JOIN n ON n.u = vec_id LEFT JOIN c ON c.u = vec_id
"""
