"""Quality classifier: a linear-chain conditional random field labels every line of a text good or bad.

Each line has counts and ratios of its own characters and words plus those of the line before and after it. Two states, a
score of the good state per line and four transition scores; forward-backward gives each line's marginal, and a document's
quality is the mean of its lines' marginals weighted by length. Training is convex and runs on the driver over a bounded
sample (`TRAIN_LINES` lines in a row of each of `TRAIN_DOCS` documents at most); scoring is a map over rows without a shuffle.

Memory: short texts are scored together up to `BLOCK` characters, longer ones in blocks of whole lines, so a worker holds its
batch and some tens of bytes per character of a block; of a long text it holds numbers per line beside."""

from __future__ import annotations

import logging
import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, one_text_per_id, sample_by_hash, text_chunks, text_slices

#: The sample that the field is fitted on: so many labelled documents at most, so many lines in a row of each.
TRAIN_DOCS, TRAIN_LINES = 4000, 64
#: Characters that are taken at once.
BLOCK = 1 << 17
STEPS, RATE, RIDGE = 150, 0.1, 1e-3
PREDICT_FROM = 0.3
LOWER, UPPER, DIGIT, SYMBOL, BANG, PIPE, PUNCT, BLANK, OTHER, BREAK = range(10)
OWN = 14
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


@lru_cache(1)
def _classes() -> np.ndarray:
    """Character class of each code point below 2^16; the last entry stands for all others."""
    table = np.full(1 << 16, OTHER, dtype=np.uint8)
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))
        table[c] = UPPER if kind == "Lu" else LOWER if kind[0] == "L" else DIGIT if kind[0] == "N" else PUNCT if kind[0] in "PS" else OTHER
    table[[ord(c) for c in "#*$%&<>"]] = SYMBOL
    table[ord("!")], table[ord("|")] = BANG, PIPE
    table[[0x20, *range(0x09, 0x0E)]] = BLANK
    table[0x0A] = BREAK
    return table


def _words(line: bytes) -> tuple[int, int, int]:
    """(words, distinct words, words equal to the one before) of a line; a long line is cut at blanks, so that few of its words
    are held as objects."""
    if len(line) <= BLOCK:
        words = line.split()
        return len(words), len(set(words)), sum(map(bytes.__eq__, words[1:], words))
    n = again = at = 0
    last, digests = None, []
    while at < len(line):
        gap = _BLANK.search(line, at + BLOCK)
        end = gap.start() if gap else len(line)
        words = line[at:end].split()
        if words:
            again += sum(map(bytes.__eq__, words[1:], words)) + (words[0] == last)
            digests.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))))
            n, last = n + len(words), words[-1]
        at = end + 1
    return n, len(np.unique(np.concatenate(digests))) if digests else 0, again


def _kinds(text: str) -> np.ndarray:
    return _classes()[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0xFFFF)]


def _own(text: str, lines: list[bytes], repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own features, lengths in characters of words) of the lines of one text or of several that line ends part. `repeated`: flag
    per line, whether its text has it twice or more."""
    n_lines, by = len(lines), np.zeros((len(lines), 9))
    if n_lines == 1:  # counted in parts, so that a long line costs no array of its length
        for i in range(0, len(text), BLOCK):
            by[0] += np.bincount(_kinds(text[i : i + BLOCK]), minlength=9)
    elif text:
        kind = _kinds(text)
        ends = np.flatnonzero(kind == BREAK)
        line_of = np.repeat(np.arange(n_lines), np.diff(np.concatenate([[0], ends + 1, [len(kind)]])))
        by[:] = np.bincount(line_of * 10 + kind, minlength=n_lines * 10).reshape(n_lines, 10)[:, :9]
    ink = by.sum(axis=1) - by[:, BLANK]
    n_words, distinct, again = np.array([_words(x) for x in lines], dtype=np.float64).reshape(-1, 3).T
    full, w = np.maximum(ink, 1), np.maximum(n_words, 1)
    own = np.empty((n_lines, OWN), dtype=np.float32)
    own[:, 0], own[:, 1], own[:, 2] = np.log1p(ink), np.log1p(n_words), np.minimum(ink / w, 40)
    for j, k in enumerate((SYMBOL, UPPER, DIGIT, PUNCT, BANG, PIPE, OTHER)):
        own[:, 3 + j] = by[:, k] / full
    own[:, 10], own[:, 11], own[:, 12], own[:, 13] = distinct / w, again / w, repeated & (n_words > 0), n_words == 0
    return own, ink


def _encoded(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n")


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own features per line, lengths of lines in characters of words, lines per text) of short texts, all lines in order."""
    parts = [_encoded(t) for t in texts]
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    lines = [x for p in parts for x in p]
    repeated = np.zeros(len(lines), bool)
    at = 0
    for p in parts:
        if len(set(p)) < len(p):
            often = Counter(p)
            repeated[at : at + len(p)] = [often[x] > 1 for x in p]
        at += len(p)
    own, ink = _own("\n".join(texts), lines, repeated)
    return own, ink, counts


def blocks(text: str):
    """A text in parts of whole lines, of BLOCK characters at most or of one line."""
    at = 0
    while len(text) - at > BLOCK:
        end = text.rfind("\n", at, at + BLOCK)
        end = text.find("\n", at + BLOCK) if end < 0 else end
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def long_features(text: str):
    """(own features, lengths) of a long text, a block of lines at a time."""
    digests = np.concatenate([np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines)) for lines in map(_encoded, blocks(text))])
    order = np.argsort(digests, kind="stable")
    same = digests[order][1:] == digests[order][:-1]
    repeated = np.zeros(len(digests), bool)
    repeated[order[1:][same]] = repeated[order[:-1][same]] = True
    at = 0
    for part in blocks(text):
        lines = _encoded(part)
        yield _own(part, lines, repeated[at : at + len(lines)])
        at += len(lines)


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zero at a text's ends), and a flag for either end."""
    first = np.cumsum(counts) - counts
    start, end = np.zeros(len(own), bool), np.zeros(len(own), bool)
    start[first], end[first + counts - 1] = True, True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[start], after[end] = 0, 0
    return np.concatenate([own, before, after, start[:, None], end[:, None]], axis=1)


def with_context(parts):
    """Blocks of (own features, lengths) of one text as (features with their neighbours', lengths)."""
    before = held = None
    for part in chain(parts, [None]):
        if held is not None:
            own, ink = held
            rows = [x for x in (before, own, part and part[0][:1]) if x is not None]
            first = 0 if before is None else 1
            yield with_neighbours(np.concatenate(rows), np.array([sum(map(len, rows))]))[first : first + len(own)], ink
            before = own[-1:]
        held = part


@dataclass
class Field:
    """A fitted field: standardisation, line weights with the bias last, transition scores [from, to]."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray

    def scores(self, near: np.ndarray) -> np.ndarray:
        """Score of the good state per line, from features with the neighbours'."""
        w = self.weights[:-1] / self.scale
        return near @ w + (self.weights[-1] - self.mean @ w)

    def line_scores(self, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.scores(with_neighbours(own, counts))


def line_odds(texts: list[str], field: Field):
    """(from, to, scores of the good state, lengths, lines per text) of a list of texts, some at a time."""
    for a, b in text_chunks(texts, BLOCK):
        if len(texts[a]) > BLOCK:
            parts = [(field.scores(near), ink) for near, ink in with_context(long_features(texts[a]))]
            u, ink = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield a, b, u, ink, np.array([len(u)])
        else:
            own, ink, counts = line_features(texts[a:b])
            yield a, b, field.line_scores(own, counts), ink, counts


def _soft(a, b):
    return np.logaddexp(a, b)


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _alone(forward: np.ndarray, backward: np.ndarray, u: np.ndarray, a: int, b: int, moves: np.ndarray, part: int = 1 << 16) -> None:
    """Messages of the lines a to b, exclusive, of one text: those forward from line a - 1 on, those backward down to it."""
    (m00, m01), (m10, m11) = moves.tolist()
    r, s = float(forward[a - 1]), float(u[b - 1])
    for i in range(a, b, part):
        out = []
        for x in u[i : min(i + part, b)].tolist():
            r = x + _log_sum(m01, r + m11) - _log_sum(m00, r + m10)
            out.append(r)
        forward[i : i + len(out)] = out
    for i in range(b - 1, a - 1, -part):  # line i sends to line i - 1
        low, out = max(i - part, a - 1), []
        for x in u[low:i][::-1].tolist():
            s = _log_sum(m10, m11 + s) - _log_sum(m00, m01 + s)
            out.append(s)
            s += x
        backward[low:i] = out[::-1]


def _messages(u: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the good state from the lines up to each line, and from the lines after it.

    Texts run side by side, the longest first, so step t touches the texts that have a line t; what only the longest has, it
    runs alone."""
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    first, length = first[order], counts[order]
    forward, backward = np.array(u, dtype=np.float64), np.zeros(len(u))
    if not len(length):
        return forward, backward
    shared = int(length[1]) if len(length) > 1 else 1
    alive = np.searchsorted(-length, -np.arange(shared), side="left")  # texts with more than t lines
    for t in range(1, shared):
        at = first[: alive[t]] + t
        r = forward[at - 1]
        forward[at] += _soft(moves[0, 1], r + moves[1, 1]) - _soft(moves[0, 0], r + moves[1, 0])
    if length[0] > shared:
        _alone(forward, backward, u, int(first[0]) + shared, int(first[0] + length[0]), moves)
    for t in range(shared - 1, 0, -1):
        at = first[: alive[t]] + t
        s = u[at] + backward[at]
        backward[at - 1] = _soft(moves[1, 0], moves[1, 1] + s) - _soft(moves[0, 0], moves[0, 1] + s)
    return forward, backward


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def marginals(u: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of the good state per line."""
    forward, backward = _messages(u, counts, moves)
    return _logistic(forward + backward)


def train(near: np.ndarray, counts: np.ndarray, label: np.ndarray) -> Field:
    """Fit on chains of lines (features with the neighbours') whose text is labelled. Lines first take their text's label; then
    those of bad texts that the field finds good on their own are turned, and the fit is repeated: junk often follows an
    ordinary line."""
    x = np.ones((len(near), near.shape[1] + 1))
    x[:, :-1] = near
    mean, scale = x[:, :-1].mean(axis=0), x[:, :-1].std(axis=0) + 1e-6
    x[:, :-1] -= mean
    x[:, :-1] /= scale
    y = np.repeat(label.astype(np.float64), counts)
    field = Field(mean, scale, np.zeros(x.shape[1]), np.zeros((2, 2)))
    first = np.cumsum(counts) - counts
    later = np.ones(len(x), bool)
    later[first] = False
    here = np.flatnonzero(later)
    for turn in range(2):
        theta = np.zeros(x.shape[1] + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[here - 1].astype(int), y[here].astype(int)), 1)
        for step in range(1, STEPS + 1):
            u, moves = x @ theta[:-4], theta[-4:].reshape(2, 2)
            forward, backward = _messages(u, counts, moves)
            p = _logistic(forward + backward)
            r, s = forward[here - 1], u[here] + backward[here]
            joint = np.stack([moves[0, 0] + 0 * r, moves[0, 1] + s, moves[1, 0] + r, moves[1, 1] + r + s])
            joint = np.exp(joint - joint.max(axis=0))
            expected = (joint / joint.sum(axis=0)).sum(axis=1)
            slope = np.concatenate([x.T @ (y - p), seen.ravel() - expected]) / len(counts) - RIDGE * theta
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        field = Field(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))
        if turn == 0:
            alone = _logistic(x @ field.weights)
            y = np.where((y == 0) & (alone > 0.8), 1.0, y)
    return field


def neutral() -> Field:
    """The field when there is nothing to learn from: every text scores one half."""
    width = 3 * OWN + 2
    return Field(np.zeros(width), np.ones(width), np.zeros(width + 1), np.zeros((2, 2)))


def window(text: str) -> tuple[np.ndarray, bool]:
    """(own features of at most TRAIN_LINES lines in a row, from a place that the text's hash chooses, and of the line on either
    side; whether there is one before)."""
    n = text.count("\n") + 1
    start = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) % (n - TRAIN_LINES + 1) if n > TRAIN_LINES else 0
    low, high = max(start - 1, 0), min(start + TRAIN_LINES + 1, n)
    parts, at = [], 0
    for own, _ in long_features(text):
        parts.append(own[max(low - at, 0) : max(high - at, 0)].copy())
        at += len(own)
    return np.concatenate(parts), start > 0


def chains(windows: list[tuple[np.ndarray, bool, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(features with the neighbours', lines per chain) of windows (own features, whether the first is only a neighbour, lines)."""
    near = [with_neighbours(own, np.array([len(own)]))[before : before + n] for own, before, n in windows]
    return np.concatenate(near), np.array([len(x) for x in near])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit on the rows of `labels` (id, 0 or 1) that `docs` has. Null ids and labels are left out; of repeated ids one label counts,
    the largest, and one text. Without both labels the field is neutral, and a warning is logged."""
    named = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null and __y is not null")
    named = sample_by_hash(named.groupBy("__id").agg(F.max("__y").alias("__y")), "__id", TRAIN_DOCS)
    rows = one_text_per_id(docs, named, "__y", id_col, text_col).select("text", "__y")

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch["text"], BLOCK):
                found = [(*window(t), min(t.count("\n") + 1, TRAIN_LINES)) for t in texts]
                arrays = [batch["__y"].slice(at, len(texts)), pa.array([own.tobytes() for own, _, _ in found], pa.binary())]
                arrays += [pa.array([int(before) for _, before, _ in found], pa.int32()), pa.array([n for _, _, n in found], pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["y", "f", "before", "n"])

    got = arrow_map(rows, run, "y int, f binary, before int, n int").collect()
    y = np.array([r.y for r in got])
    if not len(y) or y.min() == y.max():
        logging.getLogger(__name__).warning("%d labelled documents, of labels %s: the field is neutral and rejects nothing", len(y), sorted({*y.tolist()}))
        return neutral()
    got.sort(key=lambda r: (r.y, r.before, r.n, bytes(r.f)))  # the same sums in any order of arrival
    near, counts = chains([(np.frombuffer(r.f, np.float32).reshape(-1, OWN), r.before, r.n) for r in got])
    return train(near, counts, np.array([r.y for r in got]))


def score_texts(texts: list[str | None], field: Field) -> np.ndarray:
    """Quality of each text: length-weighted mean of its lines' marginals; 0 where it has no word."""
    texts, out = [t or "" for t in texts], np.zeros(len(texts))
    for a, b, u, ink, counts in line_odds(texts, field):
        p = marginals(u, counts, field.moves)
        cuts = np.cumsum(counts) - counts
        out[a:b] = np.add.reduceat(p * ink, cuts) / np.maximum(np.add.reduceat(ink, cuts), 1)
    return np.clip(out, 0.0, 1.0)


def classify(
    docs: DataFrame, field: Field, text_col: str = "text", score_col: str = "score", keep_from: float | None = None, hold: list[str] | None = None
) -> DataFrame:
    """`docs` with a double column `score_col` (replaced if there), null and empty texts at 0. With `keep_from`, only rows that
    score at least that much remain; `hold` names the columns that remain, all by default. Rows stay where they are;
    repeated rows score alike."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    held = [c for c in (docs.columns if hold is None else hold) if c != score_col]

    def run(batches):
        for batch in batches:
            scores = np.concatenate([score_texts(texts, sent.value) for _, texts in text_slices(batch[text_col], BLOCK)] or [np.zeros(0)])
            out = pa.RecordBatch.from_arrays([*(batch[c] for c in held), pa.array(scores)], names=[*held, score_col])
            yield out if keep_from is None else out.filter(pa.array(scores >= keep_from))

    fields = [docs.schema[c] for c in held]
    return arrow_map(docs, run, T.StructType([*fields, T.StructField(score_col, T.DoubleType())]))


def label_lines(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", good_from: float = 0.5) -> DataFrame:
    """Every line of every text: doc_id, line int (from 0), start and end int (characters of the text), p_good double, good boolean.

    Null and empty texts are one empty line. Rows without a shuffle, in the order of the text."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch["text"], BLOCK):
                for a, b, u, _, counts in line_odds(texts, sent.value):
                    p = marginals(u, counts, sent.value.moves)
                    size = np.array([len(x) for t in texts[a:b] for x in t.split("\n")], dtype=np.int64)
                    first = np.repeat(np.cumsum(counts) - counts, counts)
                    upto = np.cumsum(size + 1) - (size + 1)
                    start = upto - upto[first]
                    of = at + np.repeat(np.arange(a, b), counts)
                    arrays = [batch["doc_id"].take(pa.array(of)), *(pa.array(x.astype(np.int32)) for x in (np.arange(len(p)) - first, start, start + size)), pa.array(p), pa.array(p >= good_from)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "line", "start", "end", "p_good", "good"])

    fields = [T.StructField(c, T.IntegerType()) for c in ("line", "start", "end")]
    return arrow_map(rows, run, T.StructType([rows.schema["doc_id"], *fields, T.StructField("p_good", T.DoubleType()), T.StructField("good", T.BooleanType())]))


def fold_of(id_col: str, folds: int):
    """crc32 of the id as text modulo `folds`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def op1_crf_quality(spark, sf_dir: str) -> DataFrame:
    """All documents; every fifth by crc32 of its id is held out of the training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold_of("doc_id", 5) != 0)
    scored = classify(docs, fit(docs, labels), hold=["doc_id"])
    return scored.select(
        "doc_id",
        F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"),
    )

