"""A corpus pipeline of five stages, each written as Parquet before the next one reads it.

Odd rows: null, empty and blank texts have fewer words than the quality rules ask for and go in the first stage (later stages
on their own give such texts score 0, one class, no copies and the closing id alone). Null ids pass all stages but are
never what the models are fitted on; a null source is a source of its own. Repeated rows stay alike until the near
duplicates, which keep one row. Columns that aren't those of `documents` pass through, whatever their names. Very long texts
are read whole. An empty table gives empty results at every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import crf, mixing, packing, quality_rules, simhash
from logweave.llm.common import cut, unused


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule and no likelihood ratio rejects."""
    rules, prefix = quality_rules.fit(docs, quality_rules.trusted_ids(spark, sf_dir)), quality_rules.free_prefix(docs.columns)
    return quality_rules.judge(docs, rules, prefix=prefix).where(F.col(f"{prefix}kept")).drop(*[prefix + c for c in quality_rules.RESULTS])


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field predicts to be good.

    It is fitted on the labelled rows of the whole table: the stage before leaves next to none that are labelled bad."""
    field = crf.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused("__score", docs.columns)
    return crf.classify(docs, field, score_col=score, keep_from=crf.PREDICT_FROM).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id, of repeated ids one row; null ids come last.

    Rows are numbered once and written with their numbers, as a second scan may be split otherwise."""
    name = unused("__row", docs.columns)
    numbered = cut(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    key = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.col(name).alias("row"))
    found = simhash.near_duplicates(numbered.select(key.alias("key"), "text"), id_col="key")
    kept = found.where("kept").select(F.col("doc_id.row").alias(name))
    return numbered.join(kept, name, "left_semi").drop(name)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeat_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths, with digests of their ids."""
    return packing.pack(docs, emit_ids=False, added=packing.ADDED_TOKENS).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", classifier_stage),
    ("near duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Hashes, a trained field and a tokenizer: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name.replace(" ", "-"))
    return docs
