"""Packing by power-of-two decomposition.

A document of n tokens is cut into as many pieces of `MAX_TOKENS` as fit, then into one piece per binary digit of the
rest, longest first. Each piece is a sequence of its own: no sequence crosses documents, and as every length is a power of
two there is no padding at all. Sequences of equal length form a bucket (`bucket` = log2 of the length), from which
batches of one shape are drawn. Cutting looks at one document at a time, so packing is a map without a shuffle."""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map

MAX_TOKENS = 2048
END_OF_DOCUMENT = 1
#: Runs of the characters with the property White_Space.
LONG_BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{100000,}")
#: The token that byte_bpe_50k.json has beside its ranks, which the tokenizer of that file finds in any text.
ADDED_TOKENS = (("<|endoftext|>", 50256),)


def pieces(n: int, most: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; lengths are powers of two up to `most`."""
    out, at = [], 0
    while n - at >= most:
        out.append((at, most))
        at += most
    size = most >> 1
    while size:
        if (n - at) & size:
            out.append((at, size))
            at += size
        size >>= 1
    return out


def tokenizer_files() -> tuple[str, str]:
    """(ranks file, split pattern) of the byte-level vocabulary that byte_bpe_50k.json has too."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@lru_cache(4)
def encoder(ranks_file: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
    """Encoder for a file of base64 tokens and their ids. Its ids are those of the same vocabulary in other libraries, whose
    added tokens are `added`; strings that look like other special tokens are ordinary text."""
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(token): int(i) for token, i in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(added))


def token_ids(text: str | None, enc) -> np.ndarray:
    """Ids of a whole text."""
    if not text:
        return np.zeros(0, dtype=np.uint32)
    try:
        return np.asarray(enc.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)
    except ValueError:  # the split pattern gives up on a run of some 700,000 blanks
        return np.fromiter(_in_parts(text, enc), dtype=np.uint32)


def _in_parts(text: str, enc):
    """Ids of a text whose long runs of blanks are taken out, for patterns that end in `\\s+(?!\\S)|\\s+`: they make a run one piece, but for its
    last blank where something follows. Added tokens part the text before the pattern sees it."""
    added = sorted(enc.special_tokens_set, key=len, reverse=True)
    for part in re.split("(" + "|".join(map(re.escape, added)) + ")", text) if added else [text]:
        if part in enc.special_tokens_set:
            yield enc.encode_single_token(part)
            continue
        at = 0
        for run in LONG_BLANKS.finditer(part):
            end = run.end() if run.end() == len(part) else run.end() - 1
            yield from enc.encode_ordinary(part[at : run.start()])
            yield from enc._encode_single_piece(part[run.start() : end].encode())
            at = end
        yield from enc.encode_ordinary(part[at:])


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, files: tuple[str, str] | None = None, emit_ids: bool = True,
    added: tuple[tuple[str, int], ...] = (),
) -> DataFrame:
    """Pieces of all documents.

    Result, one row per piece: doc_id, start long, length long, ids_crc32 long (of the little-endian unsigned 32-bit ids),
    doc_tokens long (with the closing id), bucket int, ids array<int> (unless emit_ids is off), sequence_id long, offset
    long (0, as each sequence is one piece). Null and empty texts are the closing id alone, one piece of length 1. A null
    id stays null; repeated rows are packed once each. Other columns are ignored whatever their names. An empty table
    gives an empty result. `max_tokens` is a power of two. `added` tokens (text, id) are found in texts; without them such strings
    are ordinary text.

    sequence_id is made of the task, the piece's place in it and the bucket: distinct without a shuffle or a count, and
    the same whenever a task is run again on the same split."""
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    files = files or tokenizer_files()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        enc = encoder(*files, added)
        for batch in batches:
            yield from _packed(batch, enc, max_tokens, emit_ids)

    schema = [rows.schema["doc_id"]]
    schema += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")] + [T.StructField("bucket", T.IntegerType())]
    schema += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * emit_ids
    out = arrow_map(rows, run, T.StructType(schema))
    sequence = F.monotonically_increasing_id() * 64 + F.col("bucket")
    return out.withColumn("sequence_id", sequence).withColumn("offset", F.lit(0).cast("long"))


def _packed(batch: pa.RecordBatch, enc, max_tokens: int, emit_ids: bool, flush: int = 1 << 21):
    """Record batches of the pieces of one batch of documents, each with some two million ids at most (or one document)."""
    cols, held = [[] for _ in range(6)], 0
    for i, text in enumerate(batch["text"]):
        ids = np.append(token_ids(text.as_py(), enc), np.uint32(END_OF_DOCUMENT)).astype("<u4")
        for start, n in pieces(len(ids), max_tokens):
            own = ids[start : start + n]
            for c, v in zip(cols, (i, start, n, zlib.crc32(own.tobytes()), len(ids), own if emit_ids else None), strict=True):
                c.append(v)
        held += len(ids)
        if held >= flush:
            yield _batch(batch, cols, emit_ids)
            cols, held = [[] for _ in range(6)], 0
    if cols[0]:
        yield _batch(batch, cols, emit_ids)


def _batch(batch: pa.RecordBatch, cols: list[list], emit_ids: bool) -> pa.RecordBatch:
    at, start, length, crc, tokens, ids = cols
    lengths = np.array(length, dtype=np.int64)
    arrays = [batch["doc_id"].take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(tokens, pa.int64())]
    arrays.append(pa.array(np.log2(lengths).astype(np.int32)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket"]
    if emit_ids:
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names=names)


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder of sequences per length, so a reader draws batches of one shape."""
    packed.write.partitionBy("bucket").parquet(path)


def op3_pow2_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, with digests of the pieces in place of their ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, emit_ids=False, added=ADDED_TOKENS).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")
