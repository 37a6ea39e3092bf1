"""URL filters by hash-prefix lookup, with DataFrame functions only.

A rule is an expression host + path: it fits a URL whose host is the rule's host or a subdomain of it and whose path
starts with the rule's path. Every URL is expanded into its host suffixes combined with the prefixes of its path, at the
numbers of labels and the path lengths that rules have. Expressions meet the rules by an equi-join on the first four bytes of their SHA-256 digest, a key of
fixed size however long the expressions are; the full digest then confirms. Of the rules that fit, the longest expression
wins, and of equal expressions a block.

Equal URLs are judged once. The rules are broadcast only while there are at most `BROADCAST_RULES` of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_RULES = 100_000
DEFAULT_VERDICT = "allow"
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark, rules=RULES) -> DataFrame:
    """Rules (host, path, verdict) as a table of constants."""
    rows = [F.struct(*[F.lit(x).cast("string").alias(c) for c, x in zip(("host", "path", "verdict"), rule, strict=True)]) for rule in rules]
    return spark.range(1).select(F.inline(F.array(*rows))) if rows else spark.range(0).selectExpr("'' host", "'' path", "'' verdict")


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://, or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def labels_of(host: Column) -> Column:
    """Number of labels, one more than dots."""
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def expansions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """For the shapes (labels, path length) that a URL is large enough for: its last labels with its path's first characters."""
    known = F.split(F.lit(",".join(f"{k}:{n}" for k, n in shapes)), ",")
    pairs = F.transform(known, lambda x: F.struct(F.substring_index(x, ":", 1).cast("int").alias("k"), F.substring_index(x, ":", -1).cast("int").alias("n")))

    def fitting(labels: Column, size: Column) -> Column:
        return F.filter(pairs, lambda x: (x["k"] <= labels) & (x["n"] <= size))

    suffix = lambda k: F.call_function("substring_index", host, F.lit("."), -k)
    return F.transform(fitting(labels_of(host), F.length(path)), lambda x: F.concat(suffix(x["k"]), F.substring(path, F.lit(1), x["n"])))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """The distinct URLs of `pages` (null as empty) that have a rule: url, rule string, verdict string.

    `rules` has host, path and verdict (block or allow); null hosts, paths or verdicts are no rules, hosts are compared in
    lower case, and a rule that is given twice with both verdicts blocks."""
    known = rules.where("host is not null and path is not null and verdict is not null")
    known = known.select(F.concat(F.translate("host", CAPITALS, SMALL), "path").alias("rule"), labels_of(F.col("host")).alias("k"), F.length("path").alias("n"), "verdict")
    shapes = sorted((r.k, r.n) for r in known.select("k", "n").distinct().collect())
    known = known.groupBy("rule").agg(F.max("verdict").alias("verdict"))  # block follows allow
    known = known.select("rule", "verdict", _digest(F.col("rule")).alias("full"), F.substring(_digest(F.col("rule")), 1, 8).alias("short"))
    if known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        known = F.broadcast(known)
    urls = pages.select(F.coalesce(F.col(url_col), F.lit("")).alias("url")).distinct()
    found = urls.withColumn("expression", F.explode(expansions(host_of(F.col("url")), path_of(F.col("url")), shapes or [(1, 0)])))
    found = found.select("url", _digest(F.col("expression")).alias("own")).withColumn("short", F.substring("own", 1, 8))
    fits = found.join(known, "short").where(F.col("own") == F.col("full"))
    best = fits.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    return best.select("url", "best.rule", "best.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict (the rule's, else `default`): one row per row of `pages`.

    A null URL and one without :// have an empty host and path and fit no rule but one whose host and path are both
    empty. Repeated rows are judged alike; a null id stays null. Other columns are ignored whatever their names. An
    empty table gives an empty result, an empty rule table the default for all."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    ruled = judge(rows, rules, "url").withColumnRenamed("url", "__url")
    joined = rows.join(ruled, F.col("url") == F.col("__url"), "left")
    return joined.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def op9_url_rules(spark, sf_dir: str) -> DataFrame:
    """All pages."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), r(h, q, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), f AS (
  SELECT p.*, (SELECT arg_max(struct_pack(rule := h || q, verdict := verdict), length(h || q)) FROM r
               WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)) AS best FROM p
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM f
"""
