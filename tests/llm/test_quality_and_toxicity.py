"""Quality rules, the line classifier and the lexicon."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logweave.llm import crf, quality_rules, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute_scores(docs, trusted, orders=(1,)):
    """{doc_id: score} by the definition; hashes of several words are chained as Spark chains them."""

    def grams(text):
        words = [w.encode() for w in WORD.findall(text or "")]
        out = []
        for n in orders:
            for i in range(len(words) - n + 1):
                h = 42
                for w in words[i : i + n]:
                    h = xxhash.xxh64_intdigest(w, seed=h)
                out.append((h - (1 << 64) if h >> 63 else h) % quality_rules.BUCKETS)
        return out

    raw, target, by = Counter(), Counter(), {}
    for i, text in docs:
        g = grams(text)
        by[i] = g
        raw.update(g)
        if i in trusted:
            target.update(g)
    share, a = sum(target.values()) / max(sum(raw.values()), 1), quality_rules.SMOOTHING
    weight = lambda b: round(math.log((target[b] + a) / (raw[b] * share + a)), 6) if target else 0.0
    return {i: sum(map(weight, g)) / max(len(g), 1) for i, g in by.items()}


@pytest.mark.parametrize("orders", [(1,), (1, 2), (3,)])
def test_rules_against_brute_force(spark, docs, sf_dir, orders):
    trusted = quality_rules.trusted_ids(spark, sf_dir)
    rules = quality_rules.fit(docs, trusted, orders=orders)
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = brute_scores(texts.items(), {r.doc_id for r in trusted.collect()}, orders)
    for r in quality_rules.judge(docs, rules).collect():
        n = base(texts[r.doc_id])
        assert tuple(r[c] for c in NAMES) == n
        assert abs(r.score - want[r.doc_id]) < 1e-5
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        assert r.base_failed == failed and r.kept == (not failed and r.score >= rules.min_score)


def test_rules_odd_rows(spark, odd_docs, odd_labels, no_docs):
    trusted = odd_labels.where("quality = 1").select("doc_id")
    rules = quality_rules.fit(odd_docs, trusted)
    got = quality_rules.judge(odd_docs, rules)
    texts = [r.text for r in odd_docs.collect()]
    rows = got.collect()
    assert [tuple(r[c] for c in NAMES) for r in rows] == [base(t) for t in texts]
    assert all(r.base_failed and not r.kept for r in rows if not (r.text or "").strip())
    kept = quality_rules.judge(odd_docs, rules, prefix="__q_").where("__q_kept").select(*odd_docs.columns)
    assert kept.columns == odd_docs.columns and {r.score for r in kept.collect()} == {"clash"}
    assert quality_rules.judge(no_docs, rules).count() == 0
    assert set(quality_rules.fit(no_docs, trusted).weights.split(",")) == {"0.000000"}
    assert set(quality_rules.fit(odd_docs, trusted.limit(0)).weights.split(",")) == {"0.000000"}


def test_repeats_cost_no_more_than_sorting(spark):
    text = " ".join(f"w{i % 5000}" for i in range(60_000))
    r = quality_rules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string"), quality_rules.Rules(",".join(["0"] * quality_rules.BUCKETS))).first()
    assert r.n_repeat_words == 60_000


def test_main_path_is_native(spark, docs, sf_dir):
    plan = quality_rules.op4_ngram_llr(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# The conditional random field
def test_line_features_against_plain_counts():
    texts = ["Ab c!! 12\n\nab c!! 12\nx x x y", "", "one | two", "\n", "Üß 字 𝔘"]
    own, ink, counts = crf.line_features(texts)
    lines = [x for t in texts for x in t.split("\n")]
    assert counts.tolist() == [4, 1, 1, 2, 1] and len(own) == len(lines)
    for f, n, x in zip(own, ink, lines, strict=True):
        words = x.split()
        assert n == sum(map(len, words)) and f[1] == np.float32(math.log1p(len(words)))
        assert abs(f[10] - len(set(words)) / max(len(words), 1)) < 1e-6
        assert abs(f[11] - sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(len(words), 1)) < 1e-6
        assert abs(f[7] - x.count("!") / max(n, 1)) < 1e-6 and f[13] == (not words)
    again, alone = crf.line_features(texts * 2)[0], [crf.line_features([t])[0] for t in texts]
    assert np.array_equal(again[: len(own)], own) and np.allclose(np.concatenate(alone), own)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    u, moves = rng.normal(size=9), rng.normal(size=(2, 2))
    counts = np.array([4, 1, 0 + 4])
    got, at = crf.marginals(u, counts, moves), 0
    for n in counts:
        weights = np.zeros(n)
        total = 0.0
        for code in range(1 << n):
            y = [(code >> i) & 1 for i in range(n)]
            w = math.exp(sum(u[at + i] for i in range(n) if y[i]) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            weights += w * np.array(y)
        assert np.allclose(got[at : at + n], weights / total)
        at += n


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = crf.op1_crf_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 40 and np.mean([r.predicted == r.quality for r in got]) > 0.95


def test_classifier_odd_rows(spark, odd_docs, odd_labels, no_docs):
    field = crf.fit(odd_docs, odd_labels)
    got = crf.classify(odd_docs, field)
    assert got.columns == [c for c in odd_docs.columns if c != "score"] + ["score"] and got.count() == 16
    by = {r.doc_id: r.score for r in got.collect()}
    assert by[6] == by[7] == by[8] == 0.0 and all(0 <= s <= 1 for s in by.values())
    assert crf.classify(no_docs, field).count() == 0
    assert crf.fit(no_docs, odd_labels).weights.sum() == 0 and crf.fit(odd_docs, odd_labels.limit(0)).weights.sum() == 0


def test_labelled_lines_tile_their_texts(spark, odd_docs, odd_labels):
    field, by = crf.fit(odd_docs, odd_labels), {}
    texts = {r.doc_id: r.text or "" for r in odd_docs.where("doc_id <> 13").collect()}
    for r in crf.label_lines(odd_docs.where("doc_id <> 13"), field).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(texts)
    for i, rows in by.items():
        assert [texts[i][r.start : r.end] for r in rows] == texts[i].split("\n") and [r.line for r in rows] == list(range(len(rows)))
        assert all(r.good == (r.p_good >= 0.5) for r in rows)


def test_a_chain_of_lines_lends_its_neighbours_weight():
    good, bad = "The river ran under the old stone bridge.", "BUY!! NOW!! BUY!! NOW!!"
    texts = [*["\n".join([good] * 6)] * 20, *["\n".join([bad] * 6)] * 20]
    own, _, counts = crf.line_features(texts)
    field = crf.train(crf.with_neighbours(own, counts), counts, np.array([1] * 20 + [0] * 20))
    s = crf.score_texts(["\n".join([good] * 5), "\n".join([bad] * 5), "\n".join([good, bad] * 3)], field)
    assert s[0] > 0.8 and s[1] < 0.2 and s[1] < s[2] < s[0]


def test_every_trusted_document_counts(spark, monkeypatch):
    """More than 50,000 trusted documents: where all are trusted the two models agree in every bucket."""
    many = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common word"), "id").alias("text"))
    assert set(quality_rules.fit(many, many).weights.split(",")) == {"0.000000"}
    part = quality_rules.fit(many, many.where("doc_id % 3 = 0"))
    monkeypatch.setattr(quality_rules, "BROADCAST_IDS", 0)
    assert quality_rules.fit(many, many.where("doc_id % 3 = 0")) == part


# The lexicon
def test_folding_keeps_length():
    text = "ＩＤＩОТ 1d10t Мoron \U0001d518 é ß İ\t$cum"
    low = toxicity.fold(text)
    assert len(low) == len(text) and low.split()[0] == "idiot" and "idiot" in low and low.startswith("idiot idiot moron") and low.endswith("scum")


def test_styled_letters_beyond_two_bytes_fold():
    bold, script, boxed = ("".join(chr(first + ord(c) - ord("a")) for c in "idiot") for first in (0x1D41A, 0x1D4EA, 0x1F130))
    assert toxicity.fold(f"{bold} {script} {boxed} \U0001d7cfd\U0001d7cf0t \U0001f600") == "idiot idiot idiot idiot \U0001f600"


def naive(text, lexicon):
    """Every entry at every place, by the same rules, without an automaton."""
    low, n = toxicity.fold(text), len(text)
    found, excused = [], []
    for entry in {*lexicon.words, *lexicon.stems, *map(toxicity.fold, lexicon.exceptions)}:
        for a in range(n - len(entry) + 1):
            if low[a : a + len(entry)] != entry or a and text[a - 1].isalnum():
                continue
            b = a + len(entry)
            closed = b == n or not text[b].isalnum()
            if closed and entry in set(map(toxicity.fold, lexicon.exceptions)):
                excused.append((a, b))
            w = max(lexicon.words.get(entry, 0) if closed else 0, lexicon.stems.get(entry, 0))
            if w:
                found.append((a, b, w))
    kept, reach = [], 0
    for a, b, w in sorted(found, key=lambda m: (m[0], -m[1])):
        if a >= reach and not any(x <= a and b <= y for x, y in excused):
            kept.append((a, b, w))
            reach = b
    return kept


def test_matching_against_a_naive_search():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "trash": 3.0, "scum": 2.0, "idiotic": 1.0}, {"lowei": 4.0, "scumb": 5.0}, ("trash can",))
    a = lexicon.automaton()
    texts = ["", "You idiot!", "idiots", "an 1d10t's trash", "trash can, trash cans, TRASH CAN", "loweiä aloweix scumbag scum", "idiotic idiot", "scum$$$ scum*", "x" * 50 + " trash"]
    for t in texts:
        assert toxicity.matches(t, a) == naive(t, lexicon)
    assert [len(toxicity.matches(t, a)) for t in texts] == [0, 1, 0, 2, 1, 3, 2, 2, 1]


def test_spans_point_at_the_matches(spark):
    df = spark.createDataFrame([(1, "You 1D10T, 𝔘 scum!"), (2, "fine"), (3, None)], "doc_id long, text string")
    got = toxicity.spans(df, toxicity.seed_lexicon()).collect()
    assert [(r.doc_id, r.start, r.matched) for r in got] == [(1, 4, "1D10T"), (1, 13, "scum")]


def test_lexicon_learns_and_scores_by_length(spark):
    rows, labels = [], []
    for i in range(200):
        toxic = i % 5 == 0
        words = [f"w{(i * 31 + k * 17) % 400}" + "abcdefgh"[(i + k) % 8] * 3 for k in range(60)]
        if toxic:
            words[i % 50] = "zorg" + "abcdefgh"[i % 8] * 3
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels)
    assert any(s.startswith("zorg") for s in lexicon.stems)
    got = {r.doc_id: r.score for r in toxicity.score(docs, lexicon).collect()}
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i in range(200))
    a = lexicon.automaton()
    assert toxicity.burden("zorgaaa " + "x " * 30, a) > toxicity.burden("zorgaaa " + "x " * 3000, a) > 0


def test_toxicity_odd_rows(spark, odd_docs, odd_labels, no_docs):
    lexicon = toxicity.fit(odd_docs, odd_labels)
    got = toxicity.score(odd_docs, lexicon)
    assert got.columns == ["doc_id", "score"] and got.count() == 16
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.score(no_docs, lexicon).count() == 0
    assert toxicity.fit(no_docs, odd_labels).words == toxicity.seed_lexicon().words


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op7_lexicon_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    clean, toxic = [r for r in got if r.toxic == 0], [r for r in got if r.toxic == 1]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert {r.held_out for r in got} == {True} and all((r.score >= 0.3) == bool(r.predicted) for r in got)


def test_samples_are_bounded_and_the_same_in_any_order(spark):
    from logweave.llm.common import sample_by_hash

    df = spark.range(20_000)
    got = sorted(r.id for r in sample_by_hash(df, "id", 100).collect())
    want = sorted(r.id for r in df.orderBy(F.xxhash64(F.col("id").cast("string"))).limit(100).collect())
    assert got == want == sorted(r.id for r in sample_by_hash(df.repartition(7), "id", 100).collect())
    assert sample_by_hash(df.limit(50), "id", 100).count() == 50 and sample_by_hash(df.limit(0), "id", 100).count() == 0


def test_folds(spark):
    import zlib

    got = spark.range(50).select("id", crf.fold_of("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)
    assert spark.range(1).select(F.coalesce(crf.fold_of("id", 4) == 2, F.lit(False))).count() == 1
