"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

The rates r of the documents minimise the sum of r ln r - r over documents, 0 <= r <= `CAP`, under one constraint per source: its
words times their rates make its target. The dual is convex with one variable per source, and its solution tilts each
document's rate exponentially by its size, r = min(exp(l_source * size), CAP). A Newton step takes the sums of size * r and
size^2 * r over all documents of every source, one distributed aggregation for all sources; a bracket that each step narrows
keeps the steps safe. The sums run over documents counted by source and size, which is exact and combined before the shuffle.

Rounding: every document gets floor(r) copies, and those get one more whose hash, shifted by the fraction of r, lies below a
cutoff that makes the words come out. There is one cutoff for the source's documents above its mean size, which take their
share of the words still due, and then one for the others, which take what is left: so the miss is about half a small document.
A cutoff is found by counting words per hash digit, one digit a pass (256 bins per source, whatever the source's size). Copies
are a function of a document's id, text and size and of a table with one row per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import code_point_order, cut, unused, words_of

WEIGHTS = (5, 2, 1)
CAP = 3
#: Steps end when every source is within this share of its target; the bracket makes that certain, so the bound is never met.
RESIDUAL, NEWTON_STEPS = 1e-10, 400
DIGITS = 4


def size_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def _key(source: Column) -> Column:
    """A source as a key that joins null with null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def _hash(doc_id: Column, text: Column) -> Column:
    """32 bits of the md5 of an id and its text, so that rows of one id or without an id are told apart."""
    named = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] | dict[str, int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source of `sizes` (source, size): key, source, source_size long, weight int, target double.

    `weights` names the weight of each source (others and null have none and are left out), or sources by code point, null
    last, take the weights in turn. They share all words by weight; no target passes `cap` times its
    source's words, and what is above goes to the others by weight. That is a water level: sources whose cap per weight
    lies below it are capped, the others get the level times their weight. The windows run over one row per source."""
    rank = Window.orderBy(code_point_order("source"))
    given = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    if isinstance(weights, dict):
        weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("source")], F.lit(0))
    else:
        weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int"))
    given = given.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    by = Window.orderBy(F.try_divide(F.col("most"), F.col("weight")).asc_nulls_last(), code_point_order("source"))
    every = Window.partitionBy()
    below = F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    given = given.withColumn("level", F.try_divide(F.sum("source_size").over(every) - below, above))
    first = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.row_number().over(by).alias("n"), "level"))
    given = given.withColumn("level", F.min(first).over(every)["level"])
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("most").cast("double")))
    target = F.when(F.col("weight") > 0, target).otherwise(F.lit(0.0))
    return given.select(_key(F.col("source")).alias("key"), "source", "source_size", "weight", target.alias("target"))


def tilts(sizes: DataFrame, goals: DataFrame, cap: int = CAP) -> tuple[DataFrame, int]:
    """(key, tilt double per row of `goals`, number of Newton steps). `sizes` has key and size per document, `goals` key, source_size and
    target. Where there is nothing to take the tilt is null.

    The root lies between 0, where every rate is 1, and the tilt that gives the smallest document the rate target / source_size.
    A step goes by the logarithm of the words, and to the middle of the bracket where it would leave it or where the step before
    didn't halve the miss, so each step halves the one or the other."""
    counted = cut(sizes.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")), "counted")
    least = counted.groupBy("key").agg(F.min("size").alias("least"))
    end = F.log(F.col("target") / F.col("source_size")) / F.col("least")
    state = goals.where("target > 0 and source_size > 0").join(least, "key").select("key", "source_size", "target", end.alias("end"))
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    state = cut(state.select(
        "key", "target", F.least("end", F.lit(0.0)).alias("low"), F.greatest("end", F.lit(0.0)).alias("high"),
        F.when(full, F.col("end")).otherwise(F.lit(0.0)).alias("tilt"), F.lit(float("inf")).alias("miss"), full.alias("done"),
    ), "tilts")
    grown = F.exp(F.col("tilt") * F.col("size"))
    mass = F.col("n") * F.col("size") * F.least(grown, F.lit(float(cap)))
    steps = 0
    while not state.where("not done").isEmpty():
        if steps == NEWTON_STEPS:
            raise RuntimeError(f"no balance after {steps} steps")
        sums = counted.join(state.where("not done").select("key", "tilt"), "key").groupBy("key").agg(
            F.sum(mass).alias("words"), F.sum(F.when(grown < cap, mass * F.col("size")).otherwise(0.0)).alias("slope")
        )
        now = state.join(sums, "key", "left")
        low = F.when(F.col("words") < F.col("target"), F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("words") > F.col("target"), F.col("tilt")).otherwise(F.col("high"))
        now = now.withColumns({"low": low, "high": high})
        step = F.col("tilt") - F.log(F.col("words") / F.col("target")) * F.try_divide(F.col("words"), F.col("slope"))
        middle = (F.col("low") + F.col("high")) / 2
        miss = F.abs(F.log(F.col("words") / F.col("target")))
        inside = (step > F.col("low")) & (step < F.col("high")) & (miss <= F.col("miss") / 2)
        near = F.abs(F.col("words") - F.col("target")) <= RESIDUAL * F.col("target")
        near = near | (F.col("high") - F.col("low") <= 1e-15 * F.greatest(F.abs("low"), F.abs("high")))
        done = F.col("done") | F.coalesce(near, F.lit(True))
        state = cut(now.select(
            "key", "target", "low", "high", F.when(done, F.col("tilt")).when(inside, step).otherwise(middle).alias("tilt"),
            miss.alias("miss"), done.alias("done"),
        ), "tilts")
        steps += 1
    return goals.select("key").join(state.select("key", "tilt"), "key", "left"), steps


def _whole(size: Column, tilt: Column, cap: int) -> Column:
    """Copies that a document gets for certain."""
    return F.floor(_rate(size, tilt, cap) + 1e-9)


def _rate(size: Column, tilt: Column, cap: int) -> Column:
    return F.least(F.coalesce(F.exp(tilt * size), F.lit(0.0)), F.lit(float(cap)))  # least() passes over nulls


def _place(u: Column, size: Column, tilt: Column, cap: int) -> Column:
    """A document's hash moved down by the fraction of its rate, as 32 bits: below the middle for that fraction of all hashes."""
    part = F.greatest(_rate(size, tilt, cap) - _whole(size, tilt, cap), F.lit(0.0))
    return F.floor((u / float(1 << 32) - part + 1) * float(1 << 31)).cast("long")


def _big(size: Column) -> Column:
    """Whether a document is above its source's mean size."""
    return size * F.col("n") > F.col("source_size")


def _cutoff(sizes: DataFrame, state: DataFrame) -> DataFrame:
    """Per key of `state` (key, rest): below, the hash under which documents are taken so that their words come nearest to
    `rest`, and got, those words. `sizes` has key, u and size."""
    state = state.select("key", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("words"), F.lit(False).alias("every"))
    for digit in range(DIGITS):
        low = 8 * (DIGITS - 1 - digit)
        inside = sizes.join(state.where("not every").select("key", "prefix"), "key").where(F.shiftright("u", low + 8) == F.col("prefix"))
        bins = inside.groupBy("key", F.shiftright("u", low).alias("bin")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("key").orderBy("bin"))
        bins = bins.withColumn("upto", upto).join(state.select("key", "rest", "before"), "key")
        crossed = bins.groupBy("key").agg(
            F.min(F.when(F.col("before") + F.col("upto") > F.col("rest"), F.struct("bin", "words", "upto"))).alias("b"), F.max("upto").alias("all")
        )
        # without a bin that crosses, every document is taken; that shows at the first digit
        state = state.join(crossed, "key", "left").select(
            "key", "rest", F.coalesce("b.bin", "prefix").alias("prefix"),
            (F.col("before") + F.coalesce(F.col("b.upto") - F.col("b.words"), F.when(F.col("every"), 0).otherwise(F.col("all")), F.lit(0))).alias("before"),
            F.coalesce("b.words", F.lit(0)).alias("words"), (F.col("every") | F.col("b").isNull()).alias("every"),
        )
        state = cut(state, "cutoffs")
    more = ~F.col("every") & (F.col("rest") - F.col("before") >= F.col("words") / 2)
    below = F.when(F.col("every"), F.lit(1 << 8 * DIGITS)).otherwise(F.col("prefix") + more.cast("long"))
    return state.select("key", below.cast("long").alias("below"), (F.col("before") + F.when(more, F.col("words")).otherwise(0)).alias("got"))


def plan(sizes: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """Per source: key, source_size, target, n (documents), tilt, and the places under which big and small documents get one more
    copy than the whole part of their rates.

    `sizes` has key, u (hash) and size per document."""
    goals = cut(goals, "goals")
    balanced, _ = tilts(sizes, goals, cap)
    goals = goals.join(sizes.groupBy("key").agg(F.count("*").alias("n")), "key").join(balanced, "key")
    goals = cut(goals.select("key", "source_size", "target", "n", "tilt"), "rates")
    size, tilt = F.col("size"), F.col("tilt")
    marked = sizes.join(goals, "key").where("size > 0").select(
        "key", "size", _place(F.col("u"), size, tilt, cap).alias("u"), _big(size).alias("big"), _whole(size, tilt, cap).alias("whole"), _rate(size, tilt, cap).alias("rate")
    )
    marked = cut(marked, "marked")
    sums = marked.groupBy("key").agg(
        F.sum(F.col("size") * F.col("whole")).alias("given"), F.sum(F.when(F.col("big"), F.col("size") * F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))).alias("rest")
    )
    goals = goals.join(sums, "key", "left").withColumn("due", F.greatest(F.col("target") - F.coalesce("given", F.lit(0)), F.lit(0.0)))
    goals = cut(goals.withColumn("rest", F.round(F.least(F.coalesce("rest", F.lit(0.0)), F.col("due")), 6)), "rates")
    more = marked.where(F.col("whole") < cap)
    big = _cutoff(more.where("big"), goals).select("key", F.col("below").alias("below_big"), "got")
    goals = goals.join(big, "key").withColumn("rest", F.greatest(F.col("due") - F.col("got"), F.lit(0.0)))
    small = _cutoff(more.where("not big"), cut(goals, "rates")).select("key", F.col("below").alias("below_small"))
    # written, as only a table whose size is known is broadcast without shuffling the documents first
    return cut(goals.join(small, "key").select("key", "source_size", "target", "n", "tilt", "below_big", "below_small"), "plan")


def copies(u: Column, size: Column, cap: int = CAP) -> Column:
    """Copies of a document (hash, size) that is joined to its source's row of plan()."""
    below = F.when(_big(size), F.col("below_big")).otherwise(F.col("below_small"))
    whole = _whole(size, F.col("tilt"), cap)
    return F.least(whole + (_place(u, size, F.col("tilt"), cap) < below).cast("long"), F.lit(cap).cast("long"))


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size, key, u of every row, written."""
    text, source = F.col(f"`{text_col}`").cast("string"), F.col(f"`{source_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), source.alias("source"), size_of(text).alias("size"), _key(source).alias("key"), _hash(F.col(f"`{id_col}`"), text).alias("u"))
    return cut(rows, "sizes")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] | dict[str, int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size long, source_size long, target double, taken long (size times copies), copies long: one row per row of `docs`.

    Null, empty and blank texts have size 0 and take nothing; a source without words has target 0. A null source is a
    source of its own. Rows that repeat an id and its text get equal copies, each row for itself. Other columns are ignored
    whatever their names. An empty table gives an empty result."""
    rows = _measured(docs, id_col, text_col, source_col)
    rates = plan(rows, targets(rows, weights, cap), cap)
    out = rows.join(rates, "key").withColumn("copies", copies(F.col("u"), F.col("size"), cap))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] | dict[str, int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """`docs` with each row as often as the mix takes it. Texts are not shuffled: rows meet the table of sources only."""
    rows = _measured(docs, id_col, text_col, source_col)
    key, rate, copy, own = (unused(n, docs.columns) for n in ("__key", "__rate", "__copy", "__own"))
    rates = plan(rows, targets(rows, weights, cap), cap)
    rates = rates.select(F.col("key").alias(key), F.struct("source_size", "n", "tilt", "below_big", "below_small").alias(rate))
    joined = docs.join(rates, _key(F.col(f"`{source_col}`").cast("string")) == F.col(key))
    text = F.col(f"`{text_col}`").cast("string")
    joined = joined.withColumn(own, F.explode(F.array(F.struct(size_of(text).alias("size"), _hash(F.col(f"`{id_col}`"), text).alias("u")))))
    r = lambda c: F.col(f"{rate}.{c}")
    size, u = F.col(f"{own}.size"), F.col(f"{own}.u")
    below = F.when(size * r("n") > r("source_size"), r("below_big")).otherwise(r("below_small"))
    n = F.least(_whole(size, r("tilt"), cap) + (_place(u, size, r("tilt"), cap) < below).cast("long"), F.lit(cap).cast("long"))
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_entropy_mix(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copies")


#: The tilts come by bisection here, not by Newton steps.
OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 8) AS BIGINT) AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n, min(size) FILTER (size > 0) AS least,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source
), c AS (SELECT *, 3 * source_size AS most, sum(source_size) OVER () AS total FROM s
), l AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST) AS place FROM c
), w AS (SELECT *, (SELECT arg_min(level, place) FROM l WHERE level * weight <= most) AS water FROM l
), t AS (SELECT source, source_size, n, least, least(most::DOUBLE, coalesce(water * weight, most::DOUBLE)) AS target FROM w
), k AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY source, size
), z AS (SELECT source, target, source_size, CASE WHEN target > 0 AND source_size > 0 THEN ln(target / source_size) / least END AS stop FROM t
), h(source, target, low, high, step) AS (
  SELECT source, target, CASE WHEN target >= 3 * source_size * (1 - 1e-12) THEN stop ELSE least(stop, 0) END, greatest(stop, 0), 0 FROM z WHERE stop IS NOT NULL
  UNION ALL
  SELECT h.source, any_value(h.target),
         CASE WHEN sum(k.n * k.size * least(exp((h.low + h.high) / 2 * k.size), 3)) < any_value(h.target) THEN any_value((h.low + h.high) / 2) ELSE any_value(h.low) END,
         CASE WHEN sum(k.n * k.size * least(exp((h.low + h.high) / 2 * k.size), 3)) < any_value(h.target) THEN any_value(h.high) ELSE any_value((h.low + h.high) / 2) END,
         any_value(h.step) + 1
  FROM h JOIN k ON k.source IS NOT DISTINCT FROM h.source WHERE h.step < 100 GROUP BY h.source
), x AS (SELECT source, (low + high) / 2 AS tilt FROM h WHERE step = 100
), r AS (
  SELECT d.*, t.source_size, t.target, d.size * t.n > t.source_size AS big, least(coalesce(exp(x.tilt * d.size), 0), 3) AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
), f AS (SELECT *, CAST(floor(rate + 1e-9) AS BIGINT) AS whole, greatest(rate - floor(rate + 1e-9), 0) AS part FROM r
), e AS (SELECT *, CAST(floor((u / 4294967296.0::DOUBLE - part + 1) * 2147483648.0::DOUBLE) AS BIGINT) AS v FROM f
), m AS (
  SELECT source, greatest(any_value(target) - sum(size * whole), 0) AS due, coalesce(sum(size * part) FILTER (big), 0) AS heavy FROM e GROUP BY source
), g AS (
  SELECT e.source, big, v, sum(size) AS words, any_value(due) AS due, any_value(round(least(heavy, due), 6)) AS rest
  FROM e JOIN m ON e.source IS NOT DISTINCT FROM m.source WHERE whole < 3 AND size > 0 GROUP BY e.source, big, v
), b AS (SELECT *, sum(words) OVER (PARTITION BY source, big ORDER BY v) AS upto FROM g
), o AS (SELECT source, v, words, upto - words / 2.0 <= rest AS more FROM b WHERE big
), got AS (SELECT source, sum(words) FILTER (more) AS got FROM o GROUP BY source
), q AS (
  SELECT b.source, b.v, b.upto - b.words / 2.0 <= greatest(b.due - coalesce(got.got, 0), 0) AS more
  FROM b LEFT JOIN got ON b.source IS NOT DISTINCT FROM got.source WHERE NOT b.big
), y AS (SELECT source, v, true AS big, more FROM o UNION ALL SELECT source, v, false, more FROM q
)
SELECT e.doc_id, e.size, e.source_size, e.target, CAST(e.size * (e.whole + CASE WHEN y.more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e LEFT JOIN y ON y.v = e.v AND y.big = e.big AND y.source IS NOT DISTINCT FROM e.source AND e.whole < 3
"""
