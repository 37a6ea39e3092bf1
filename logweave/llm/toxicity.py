"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length.

Folding maps every character to one character: homoglyphs and wide forms to plain Latin letters, capitals to small ones,
digits and signs that stand for letters to those letters. Marked letters stay: in many languages they part a slur from
a common word. Entries are words (bounded on both sides) or stems (bounded
where they begin); matches that lie in an exception phrase don't count. The lexicon is a parameter (`SEED_WORDS`) plus
what labelled documents teach: words and stems whose documents are toxic far more often than chance allows. A logistic
curve, fitted on the same documents, turns weight per length into a score."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, cut, one_text_per_id, sample_by_hash, text_slices
from .crf import fold_of

#: Fit on so many labelled documents at most.
TRAIN_DOCS = 20_000
#: Characters that are folded at once, and bytes of texts that a worker turns into strings at once.
BLOCK = 1 << 18
STEM_SIZES = (4, 5, 6, 7, 8, 9)
#: An entry needs a log-likelihood ratio of so many nats against the base rate, and so large a share of toxic documents.
MIN_EVIDENCE, MIN_SHARE = 20.0, 0.8
SEED_WEIGHT = 3.0
PREDICT_FROM = 0.3
SEED_WORDS = (
    "idiot", "idiots", "moron", "morons", "stupid", "scum", "loser", "losers", "pathetic", "worthless",
    "trash", "disgusting", "imbecile", "dumbass", "bastard", "retard", "scumbag", "dimwit", "halfwit", "jerk",
)
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "loser bracket", "clown fish", "stupid hat day", "jerk chicken", "jerk seasoning")
#: Letters that look like Latin ones but do not decompose into them.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ѵ": "v",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ω": "w", "ı": "i", "ɩ": "i", "ɡ": "g", "ⅼ": "l", "ø": "o", "đ": "d", "ł": "l", "ħ": "h",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e"}


FOLDED = 0x2FA20


@lru_cache(1)
def _table() -> np.ndarray:
    """Folded code point of each code point below FOLDED, where the last that NFKC changes into one lies."""
    table = np.arange(FOLDED, dtype=np.uint32)
    for c in range(0x80, FOLDED):
        if 0xD800 <= c < 0xE000:
            continue
        wide = unicodedata.normalize("NFKC", chr(c))
        x = (wide if len(wide) == 1 else chr(c)).lower()
        if len(x) == 1:
            table[c] = ord(x)
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    for c in range(0x09, 0x0E):
        table[c] = 0x20
    for a, b in HOMOGLYPHS.items():
        table[table == ord(a)] = ord(b)
    for a, b in DIGITS.items():
        table[table == ord(a)] = ord(b)
    return table


def fold(text: str) -> str:
    """The folded text, of the same length; characters from FOLDED on stay as they are."""
    return "".join(_folded(text[i : i + BLOCK]) for i in range(0, len(text), BLOCK))


def _folded(text: str) -> str:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = _table()[np.minimum(cp, FOLDED - 1)]
    return np.where(cp >= FOLDED, cp, low).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


@dataclass
class Lexicon:
    """Folded entries with weights; phrases that excuse what lies in them; the curve score = 1 / (1 + exp(-(base + slope * x)))."""

    words: dict[str, float]
    stems: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    base: float = -4.0
    slope: float = 2.0

    def automaton(self):
        found, excuses = ahocorasick.Automaton(), {*map(fold, self.exceptions)}
        for entry in {*self.words, *self.stems, *excuses}:
            found.add_word(entry, (len(entry), self.words.get(entry, 0.0), self.stems.get(entry, 0.0), entry in excuses))
        found.make_automaton()
        return found


def seed_lexicon(words: tuple[str, ...] = SEED_WORDS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    return Lexicon({fold(w): SEED_WEIGHT for w in words}, {}, exceptions)


def matches(text: str, automaton) -> list[tuple[int, int, float]]:
    """(from, to, weight) of the matches that count, none overlapping: the longest at each place, and of equals the first."""
    if not len(automaton):
        return []
    low, found, excused, n = fold(text), [], [], len(text)
    for last, (size, word, stem, excuse) in automaton.iter(low):
        start, end = last + 1 - size, last + 1
        if start and text[start - 1].isalnum():
            continue
        closed = end == n or not text[end].isalnum()
        if excuse and closed:
            excused.append((start, end))
        weight = max(word if closed else 0.0, stem)
        if weight > 0:
            found.append((start, end, weight))
    excused.sort()
    froms, upto = [a for a, _ in excused], list(accumulate((b for _, b in excused), max))
    kept, reach = [], 0
    for start, end, weight in sorted(found, key=lambda m: (m[0], -m[1])):
        before = bisect_right(froms, start)  # a phrase that begins by `start` and ends at `end` or later excuses the match
        if start >= reach and not (before and upto[before - 1] >= end):
            kept.append((start, end, weight))
            reach = end
    return kept


def burden(text: str | None, automaton) -> float:
    """ln(1 + weight of the matches per 1,000 words)."""
    if not text:
        return 0.0
    weight = sum(m[2] for m in matches(text, automaton))
    return float(np.log1p(1000 * weight / max(len(text.split()), 1))) if weight else 0.0


_TOKEN = re.compile(r"[^\W\d_]+")


def _entries(text: str) -> set[str]:
    """Candidates of a text: '=word' for words, the first letters of words for stems."""
    out: set[str] = set()
    for w in set(_TOKEN.findall(fold(text))):
        out.add("=" + w)
        out.update(w[:k] for k in STEM_SIZES if k <= len(w))
    return out


def _signature(text: str) -> int:
    """Smallest hash of the five-word shingles: near copies mostly share it, different texts don't."""
    w = text.encode("utf-8", "replace").lower().split()
    return min((xxhash.xxh64_intdigest(b" ".join(w[i : i + 5])) for i in range(max(len(w) - 4, 1))), default=0) >> 1


def fit(docs: DataFrame, labels: DataFrame, seed: Lexicon | None = None, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Learn entries and the curve from the rows of `labels` (id, 0 or 1) that `docs` has, one row per id.

    The evidence that an entry needs and the bounded sample bound what is collected. Copies of a document count once, or the rare words of one toxic text with many copies would look toxic. Null ids
    and labels are left out; of repeated ids one label counts, the largest. With no toxic or no clean document the seed
    lexicon comes back as it is."""
    seed = seed or seed_lexicon()
    named = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("toxic")).where("__id is not null and toxic is not null")
    named = sample_by_hash(named.groupBy("__id").agg(F.max("toxic").alias("toxic")), "__id", TRAIN_DOCS)
    rows = one_text_per_id(docs, named, "toxic", id_col, text_col)

    def sign(batches):
        for batch in batches:
            signs = [_signature(t) for _, texts in text_slices(batch["text"], BLOCK) for t in texts]
            yield pa.RecordBatch.from_arrays([batch["__id"], batch["toxic"], batch["text"], pa.array(signs, pa.int64())], names=["id", "toxic", "text", "sig"])

    id_type = rows.schema["__id"].dataType.simpleString()
    signed = cut(arrow_map(rows.select("__id", "toxic", "text"), sign, f"id {id_type}, toxic int, text string, sig long"), "labelled")
    first = signed.groupBy("toxic", "sig").agg(F.min("id").alias("id")).drop("sig")
    sample = cut(signed.join(F.broadcast(first), ["id", "toxic"], "left_semi").select("toxic", "text"), "sample")
    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return seed

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            toxic = batch["toxic"].to_pylist()
            for at, texts in text_slices(batch["text"], BLOCK):
                for text, y in zip(texts, toxic[at:], strict=False):
                    seen.update((e, y) for e in _entries(text))
                if len(seen) > 100_000:
                    yield _counted(seen)
                    seen = Counter()
        yield _counted(seen)

    base = size[1] / (size[0] + size[1])
    share = F.col("t") / (F.col("t") + F.col("c"))
    evidence = F.col("t") * F.log(share / base) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    learned = (
        arrow_map(sample, count, "entry string, toxic int, n long")
        .groupBy("entry")
        .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
        .where((F.col("t") > 0) & (share >= MIN_SHARE) & (evidence >= MIN_EVIDENCE))
        .collect()
    )
    words, stems = dict(seed.words), {}
    weigh = lambda r: float(np.log((r.t + 0.5) / (size[1] + 1)) - np.log((r.c + 0.5) / (size[0] + 1)))
    for r in sorted(learned, key=lambda r: (r.entry[0] == "=", len(r.entry), r.entry)):  # short stems cover longer entries
        if r.entry[0] == "=":
            if not any(r.entry[1 : 1 + k] in stems for k in STEM_SIZES):
                words[r.entry[1:]] = weigh(r)
        elif not any(r.entry[:k] in stems for k in STEM_SIZES if k < len(r.entry)):
            stems[r.entry] = weigh(r)
    lexicon = Lexicon(words, stems, seed.exceptions)
    got = _burdens(sample, "text", lexicon, ["toxic"]).collect()
    lexicon.base, lexicon.slope = _curve(np.array([r.burden for r in got]), np.array([r.toxic for r in got], dtype=float))
    return lexicon


def _counted(seen: Counter) -> pa.RecordBatch:
    keys = list(seen)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())],
        names=["entry", "toxic", "n"],
    )


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x by Newton steps, with a slight pull to zero."""
    order = np.lexsort((y, x))  # the same sums in any order of arrival
    a, b = np.stack([np.ones(len(x)), x], axis=1)[order], y[order]
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        pull = np.array([0.0, 0.01])
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull + 1e-9), a.T @ (b - p) - pull * theta)
        theta = theta + np.clip(step, -2, 2)
    return float(theta[0]), max(float(theta[1]), 0.0)


def _burdens(docs: DataFrame, text_col: str, lexicon: Lexicon, held: list[str]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        automaton = sent.value.automaton()
        for batch in batches:
            x = np.array([burden(t.as_py(), automaton) for t in batch[text_col]], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in held), pa.array(x)], names=[*held, "burden"])

    fields = [docs.schema[c] for c in held]
    return arrow_map(docs.select(*{*held, text_col}), run, T.StructType([*fields, T.StructField("burden", T.DoubleType())]))


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score double, one row per row of `docs`, without a shuffle. Other columns are ignored whatever their names.

    Null, empty and blank texts have no match and so the score of a text without one; repeated rows score alike."""
    got = _burdens(docs.select(id_col, text_col), text_col, lexicon, [id_col])
    return got.select(id_col, (1 / (1 + F.exp(-(lexicon.base + lexicon.slope * F.col("burden"))))).alias("score"))


def spans(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The matches that count, a row each: doc_id, start and end int (characters of the text), matched string, weight double.
    Texts without a match have no row."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        automaton = sent.value.automaton()
        for batch in batches:
            at, out = [], []
            for i, t in enumerate(batch["text"]):
                t = t.as_py() or ""
                for a, b, w in matches(t, automaton):
                    at.append(i)
                    out.append((a, b, t[a:b], w))
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64())
            arrays = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at, pa.int64())), *arrays], names=["doc_id", "start", "end", "matched", "weight"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, run, f"doc_id {id_type}, start int, end int, matched string, weight double")


def op7_lexicon_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents; every fourth by crc32 of its id is held out of the training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold_of("doc_id", 4) != 2)
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"),
    )
