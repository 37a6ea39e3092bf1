"""Token counts: totals by source, language and tokenizer version that are maintained by deltas.

Totals are sums, so a batch of changes is a small table of signed numbers: an insert adds one document and its tokens, a
delete takes both away, a revised count adds the difference. A batch is summed by key before it is stored, is written to
a staging folder and becomes visible by one rename to a folder named after the batch. A batch that is there already is
left alone, so a job that dies and runs again, or a queue that delivers twice, changes nothing. Totals are the sum of the
newest snapshot and of the batches it doesn't have; `compact` writes a new snapshot."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, cut, scratch_dir
from .packing import ADDED_TOKENS, encoder, token_ids, tokenizer_files

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
BPE, WORDS = "byte_bpe_50k/1", "words/1"


class Rollup:
    """Totals under one folder of any file system that Hadoop reaches; its rename must be atomic and refuse a target that exists."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at, fs = self._at(f"{self.root}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def _publish(self, write, target: str) -> bool:
        """Write to a staging folder, then rename; False, and no trace, if the target is there by then."""
        staging = f"{self.root}/staging/{uuid.uuid4().hex}"
        write(staging)
        (a, fs), (b, _) = self._at(staging), self._at(target)
        fs.mkdirs(b.getParent())
        if not fs.exists(b) and fs.rename(a, b):
            # a rename onto a folder that another writer has just made moves the staging folder into it
            inner, _ = self._at(f"{target}/{a.getName()}")
            if not fs.exists(inner):
                return True
            fs.delete(inner, True)
            return False
        fs.delete(a, True)
        return False

    def batches(self) -> list[str]:
        return self._names("batches")

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Store a batch of signed deltas (source, lang, tokenizer, docs, tokens); False if the batch is there already.

        Null keys are keys of their own; null numbers count as 0; other columns are ignored. An empty batch is a batch."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.=-]{0,200}", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        target = f"{self.root}/batches/{batch_id}"
        at, fs = self._at(target)
        if fs.exists(at):
            return False
        summed = deltas.groupBy(*KEYS).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("docs", "tokens")])
        return self._publish(lambda path: summed.coalesce(1).write.parquet(path), target)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens of all committed batches; keys whose numbers are both back at zero have no row."""
        old, included = self._snapshot()
        new = [f"{self.root}/batches/{b}" for b in self.batches() if b not in included]
        empty = self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(SCHEMA)])
        parts = empty if old is None else old
        if new:
            parts = parts.unionByName(self.spark.read.schema(SCHEMA).parquet(*new))
        return parts.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def _snapshot(self) -> tuple[DataFrame | None, set[str]]:
        names = self._names("snapshots")
        if not names:
            return None, set()
        at = f"{self.root}/snapshots/{names[-1]}"
        included = {r[0] for r in self.spark.read.schema("batch string").parquet(f"{at}/batches").collect()}
        return self.spark.read.schema(SCHEMA).parquet(f"{at}/totals"), included

    def compact(self) -> bool:
        """Write a snapshot of all batches there are. Batches stay: they are what makes a repeated commit harmless."""
        held, totals = self.batches(), self.totals()
        number = int((self._names("snapshots") or ["0"])[-1]) + 1

        def write(path: str) -> None:
            totals.coalesce(1).write.parquet(f"{path}/totals")
            names = F.array(*map(F.lit, held)).cast("array<string>")  # a plan without a Python worker, unlike createDataFrame
            self.spark.range(1).select(F.explode(names).alias("batch")).coalesce(1).write.parquet(f"{path}/batches")

        return self._publish(write, f"{self.root}/snapshots/{number:012d}")


def inserted(counted: DataFrame, tokenizer: str, tokens: str = "tokens") -> DataFrame:
    """Deltas of documents that arrive: one document and its tokens each."""
    return _signed(counted, tokenizer, F.lit(1), F.col(tokens))


def deleted(counted: DataFrame, tokenizer: str, tokens: str = "tokens") -> DataFrame:
    """Deltas of documents that go."""
    return _signed(counted, tokenizer, F.lit(-1), -F.col(tokens))


def revised(counted: DataFrame, tokenizer: str, before: str, after: str) -> DataFrame:
    """Deltas of documents that stay and whose count changes from column `before` to column `after`."""
    return _signed(counted, tokenizer, F.lit(0), F.coalesce(after, F.lit(0)) - F.coalesce(before, F.lit(0)))


def _signed(counted: DataFrame, tokenizer: str, docs, tokens) -> DataFrame:
    return counted.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), docs.cast("long").alias("docs"), tokens.cast("long").alias("tokens"))


def count_tokens(docs: DataFrame, files: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
                 added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """doc_id, source, lang, digest binary (md5 of the text), words long, tokens long per row of `docs`, texts read whole.

    A map: null texts count as empty ones, with no words and no tokens; repeated rows are counted each.
    `added` as in packing."""
    files = files or tokenizer_files()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text"),
    )
    held = ["doc_id", "source", "lang", "digest"]

    def run(batches):
        enc = encoder(*files, added)
        for batch in batches:
            words, tokens = [], []
            for t in batch["text"]:
                t = t.as_py()
                words.append(len(t.encode("utf-8", "replace").split()))
                tokens.append(len(token_ids(t, enc)))
            numbers = [pa.array(np.array(x, dtype=np.int64)) for x in (words, tokens)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in held), *numbers], names=[*held, "words", "tokens"])

    schema = T.StructType([*(rows.schema[c] for c in held), T.StructField("words", T.LongType()), T.StructField("tokens", T.LongType())])
    return arrow_map(rows, run, schema)


def later_copies(counted: DataFrame) -> DataFrame:
    """The rows whose text a row with a smaller id has too.

    The table of texts that occur again is written first: the join then deals both its sides itself, so adaptive execution
    can split a text with very many copies, and texts that occur once take no part in it."""
    first = counted.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = cut(first.select("digest", "first"), "first")
    return counted.join(first, "digest").where(F.col("doc_id") > F.col("first"))


def op10_token_rollups(spark, sf_dir: str) -> DataFrame:
    """Totals after five commits over all documents: tokens of all, words of all, token counts revised to hold the closing id of
    each document, later copies deleted under both versions, and two of these batches delivered again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = cut(count_tokens(docs, added=ADDED_TOKENS).withColumn("closed", F.col("tokens") + 1), "counts")
    copies = cut(later_copies(counted), "copies")
    rollup = Rollup(spark, f"{scratch_dir(spark)}/logweave/rollup-{uuid.uuid4().hex}")
    tokens, words = inserted(counted, BPE), inserted(counted, WORDS, "words")
    gone = deleted(copies, BPE, "closed").unionByName(deleted(copies, WORDS, "words"))
    rollup.commit("load-tokens", tokens)
    rollup.commit("load-words", words)
    rollup.compact()
    rollup.commit("close-documents", revised(counted, BPE, "tokens", "closed"))
    rollup.commit("drop-copies", gone)
    rollup.commit("load-tokens", tokens)
    rollup.commit("drop-copies", gone)
    return rollup.totals()
