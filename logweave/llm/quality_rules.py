"""Quality rules: base counts of a text and a hashed n-gram log-likelihood ratio, with DataFrame functions only.

Two multinomials over `BUCKETS` hashed n-grams of the orders in `ORDERS` are counted: one over every document (raw) and one
over the trusted ones (target). A document's score is the mean over its n-grams of ln p_target - ln p_raw; it is kept if
no base rule fails and the score is at least `MIN_SCORE`. Counting is one scan whose groups are the buckets, combined before
the shuffle, so its shuffle has BUCKETS rows per task at most. Scoring is a map over rows: the model is a constant of
the plan whose size BUCKETS fixes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, let, unused, words_of

BUCKETS = 1 << 16
#: Single words. Held out on 10,000 documents, words alone part junk (all below -0.37) from prose (all above -0.08); words and
#: pairs together leave -0.13 and -0.06, as most pairs occur once and say nothing.
ORDERS = (1,)
#: The ratio of a bucket is (target + a) / (expected + a), where expected is the raw count at the target's size: rare buckets
#: say little, so a trusted set that is a small part of the corpus doesn't count against the rare words of the rest.
SMOOTHING = 5.0
#: Nats per n-gram.
MIN_SCORE = -0.16
#: The ids of so many trusted documents are broadcast; of more, Spark joins them as it sees fit.
BROADCAST_IDS = 1_000_000
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept")


@dataclass(frozen=True)
class Rules:
    """A fitted model: ln p_target - ln p_raw per bucket, comma-separated in the order of the buckets."""

    weights: str
    min_score: float = MIN_SCORE
    orders: tuple[int, ...] = ORDERS


def gram_buckets(words: Column, orders: tuple[int, ...] = ORDERS) -> Column:
    """Buckets of all n-grams of the given orders."""

    def of(n: int) -> Column:
        starts = words if n == 1 else F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
        follow = lambda i: [F.get(words, i + k) for k in range(1, n)]
        bucket = lambda w, i: F.pmod(F.xxhash64(w, *follow(i)), F.lit(BUCKETS)).cast("int")
        return F.transform(starts, (lambda w: bucket(w, 0)) if n == 1 else (lambda w, i: bucket(w, i)))

    return of(orders[0]) if len(orders) == 1 else F.concat(*[of(n) for n in orders])


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window which the text holds twice or more.

    Windows are compared by 64-bit hash. Sorting finds the repeated ones, so a text costs n log n whatever repeats."""
    count = F.greatest(F.size(words) - 2, F.lit(0))
    windows = F.transform(
        F.slice(words, F.lit(1), count), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    )

    def equal_neighbour(s, i):
        before = F.when(i > 0, F.get(s, i - 1)["h"])
        after = F.get(s, i + 1)["h"]
        return F.coalesce(F.get(s, i)["h"] == before, F.lit(False)) | F.coalesce(F.get(s, i)["h"] == after, F.lit(False))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(placed, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: equal_neighbour(s, i)), lambda x: x["i"])))
        return let(
            starts,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
            ),
        )

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def _row(text: Column, rules: Rules | None) -> Column:
    """A struct of all results for one text."""
    text = F.coalesce(text, F.lit(""))

    def fields(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        n = F.size(words).cast("long")
        columns = [
            n.alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
        ]
        if rules is not None:
            weights = F.split(F.lit(rules.weights), ",").cast("array<double>")
            total = let(
                gram_buckets(words, rules.orders),
                lambda g: F.aggregate(g, F.lit(0.0), lambda a, x: a + F.get(weights, x)) / F.greatest(F.size(g), F.lit(1)),
            )
            columns.append(total.alias("score"))
        return F.struct(*columns)

    return F.transform(F.array(F.array_remove(F.split(text, GAP), "")), fields)


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        min_score: float = MIN_SCORE, orders: tuple[int, ...] = ORDERS) -> Rules:
    """Count both multinomials over all of `docs`. `trusted` has the ids of the target's documents.

    Ids that `docs` lacks, null and repeated ids change nothing. With no trusted document both models agree, every
    score is zero and only base rules reject."""
    ids = trusted.select(F.col(id_col).alias("__id")).where("__id is not null").distinct()
    few = ids.count() <= BROADCAST_IDS
    ids = ids.withColumn("__trusted", F.lit(1))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(ids) if few else ids, "__id", "left")
    grams = F.transform(F.array(words_of(F.col("__text"))), lambda w: gram_buckets(w, orders))
    counts = (
        rows.select("__trusted", F.explode(F.flatten(grams)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("__trusted").alias("target"))
    )
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(counts, "bucket", "left").na.fill(0, ["raw", "target"])
    counts = counts.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    share = F.col("target") / F.greatest("raw", F.lit(1))
    ratio = lambda x: F.log((x["target"] + SMOOTHING) / (x["raw"] * share + SMOOTHING))
    weight = F.transform("c", lambda x: F.when(F.col("target") > 0, ratio(x)).otherwise(F.lit(0.0)))
    text = counts.select(F.array_join(F.transform(weight, lambda w: F.format_string("%.6f", w)), ",")).first()[0]
    return Rules(text, min_score, orders)


def judge(docs: DataFrame, rules: Rules, text_col: str = "text", prefix: str = "") -> DataFrame:
    """`docs` with the result columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept.

    A map: rows keep their partition, and repeated rows get the same verdict. Null, empty and blank texts have zero of
    everything and fail the base rules. Columns of `docs` that are named like a result are replaced; `prefix` avoids that."""
    names = RESULTS[:6]
    r = unused("__r", docs.columns)
    failed = (F.col(f"{r}.n_words") < MIN_WORDS) | (100 * F.col(f"{r}.n_repeat_words") > 50 * F.col(f"{r}.n_words"))
    out = [F.col(f"{r}.{n}").alias(prefix + n) for n in names]
    out += [failed.alias(f"{prefix}base_failed"), (~failed & (F.col(f"{r}.score") >= rules.min_score)).alias(f"{prefix}kept")]
    made = {prefix + n for n in RESULTS}
    held = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    # explode, and not a column: Catalyst would compute a column again in each filter that is pushed below it
    return docs.select("*", F.explode(_row(F.col(f"`{text_col}`"), rules)).alias(r)).select(*held, *out)


def free_prefix(columns: list[str], prefix: str = "__q_") -> str:
    """`prefix`, or what comes of it by underscores until none of the columns is named like a result behind it."""
    taken = {c.lower() for c in columns}
    while any((prefix + n).lower() in taken for n in RESULTS):
        prefix += "_"
    return prefix


def trusted_ids(spark, sf_dir: str) -> DataFrame:
    """Documents whose quality the labels vouch for."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")


def op4_ngram_llr(spark, sf_dir: str) -> DataFrame:
    """All documents; the target is the documents labelled good."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = fit(docs, trusted_ids(spark, sf_dir))
    return judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )
