"""What the training-data operators share: scratch tables, the word rule, small column helpers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009 to U+000D. Python's bytes.split() has the same rule.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where that is unset, a new local one.

    Only sessions without a cluster may leave it unset, as there the one machine sees the local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="logweave-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        root = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    The lineage ends there, so a lost executor costs a reread and no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the interpreter ends."""
    path = f"{scratch_dir(spark)}/logweave/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of at most BATCH_BYTES, unless the session has set a size of its own: buffers of a
    batch are held outside the heap by every task, and again by its Python worker."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "67108864b":
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


_made: list[tuple[SparkSession, str]] = []


def drop_scratch() -> None:
    """Delete every path that scratch_path() has given in sessions that are still alive."""
    while _made:
        spark, path = _made.pop()
        try:
            if spark.sparkContext._jsc is not None:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session may be gone when the interpreter ends
            return


atexit.register(drop_scratch)


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once; Catalyst would otherwise repeat it wherever the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def unused(name: str, columns: list[str]) -> str:
    """`name`, or what comes of it by underscores until no column has it (Spark's names know no case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def code_point_order(col: str) -> Column:
    """UTF-8 byte order is code point order, and Spark compares strings by bytes."""
    return F.col(col).asc_nulls_last()


def sample_by_hash(df: DataFrame, id_col: str, bound: int) -> DataFrame:
    """At most `bound` rows, those with the smallest hash of the id: the same rows in any run and order.

    Of a large table only rows below twice the hash that is expected to suffice are sorted: otherwise each task would send
    its `bound` smallest rows to one."""
    order, n = F.xxhash64(F.col(id_col).cast("string")), df.count()
    if n > 4 * bound:
        df = df.where(order < int(-(1 << 63) + (1 << 64) * (2 * bound / n)))
    return df.orderBy(order, F.col(id_col)).limit(bound)


def one_text_per_id(docs: DataFrame, named: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__id, `label`, text ("" for null) of the ids in `named` (__id, `label`; few enough to broadcast): a row per id, however
    often `docs` repeats it, with the text of the smallest hash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("text")).join(F.broadcast(named), "__id")
    return rows.groupBy("__id", label).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def text_chunks(texts: list, limit: int):
    """Ranges (from, to) of a list of texts with at most `limit` characters each, or one text."""
    return _ranges(map(len, texts), limit)


def text_slices(column: pa.Array, limit: int):
    """(first row, texts) of a column of strings, nulls as "": at most `limit` bytes at a time, or one text."""
    for a, b in _ranges(pc.binary_length(column).fill_null(0).to_pylist(), limit):
        yield a, [t or "" for t in column.slice(a, b - a).to_pylist()]


def _ranges(sizes, limit: int):
    start, held, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start <= i:
        yield start, i + 1
