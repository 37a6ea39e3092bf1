"""Packing, mixing, sharding, URL rules, rollups and the pipeline."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logweave.llm import crf, mixing, packing, quality_rules, queries, rollups, sharding, simhash, url_rules

from ..oracle import compare

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def reference_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def check_pieces(rows, texts, reference_ids):
    """Pieces tile every document, are powers of two, and hold the ids of the reference tokenizer. `texts`: (doc_id, text)."""
    by, want = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for i, text in texts:
        ids = np.array(reference_ids(text), dtype="<u4")
        got = [(s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for s, n in packing.pieces(len(ids))]
        want.setdefault(i, []).extend(got)
    assert {i: sorted(v) for i, v in by.items()} == {i: sorted(v) for i, v in want.items()}
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} <= {0}


def test_pieces():
    for n in [*range(1, 300), 2047, 2048, 2049, 5000, 4096]:
        p = packing.pieces(n)
        assert sum(x for _, x in p) == n and all(x & (x - 1) == 0 and x <= 2048 for _, x in p)
        assert [s for s, _ in p] == [sum(x for _, x in p[:i]) for i in range(len(p))]
    assert packing.pieces(0) == [] and packing.pieces(5, 4) == [(0, 4), (4, 1)]


def test_packing_against_the_tokenizer(spark, docs, reference_ids, sf_dir):
    some = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check_pieces(packing.op3_pow2_packing(spark, sf_dir).collect(), some, reference_ids)


def test_packing_odd_rows(spark, odd_docs, no_docs, reference_ids):
    more = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(77, "a <|endoftext|> b")], "doc_id long, text string"))
    rows = packing.pack(more).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in more.collect()], reference_ids)
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack(odd_docs).columns == packing.pack(more).columns and packing.pack(no_docs).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd_docs, max_tokens=100)


def test_buckets_hold_one_length(spark, odd_docs, tmp_path):
    packing.write_buckets(packing.pack(odd_docs), str(tmp_path / "b"))
    got = spark.read.parquet(str(tmp_path / "b"))
    assert got.where("length <> shiftleft(1L, bucket) or size(ids) <> length").count() == 0 and got.count() == packing.pack(odd_docs).count()


# Mixing
def plain_mix(rows):
    """rows: (doc_id, source, text). {source: (size, target)} by resharing step by step."""
    size = {}
    for _, s, t in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        target = {s: float(3 * size[s]) if s in capped else left * weight[s] / w for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * size[s]}
        if not over:
            return {s: (size[s], target[s]) for s in order}
        capped |= over


def check_mix(got, rows):
    want, taken = plain_mix([(r.doc_id, r.source, r.text) for r in rows]), {}
    assert len(got) == len(rows)
    source, text = {r.doc_id: r.source for r in rows}, {r.doc_id: r.text for r in rows}
    largest = {}
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == len(WORD.findall(text[r.doc_id] or ""))
        assert r.source_size == want[s][0] and abs(r.target - want[s][1]) <= 1e-6 * max(1, want[s][1])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r["size"])
    for s, n in taken.items():
        assert abs(n - want[s][1]) <= largest[s]


def test_mix(spark, docs, sf_dir):
    rows = docs.select("doc_id", "source", "text").collect()
    got = mixing.mix(docs).collect()
    check_mix(got, rows)
    again = mixing.mix(docs.repartition(7)).collect()
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in again}
    plan = mixing.op5_entropy_mix(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_mix_caps_and_reshares(spark):
    rows = [(i, s, " ".join(["w"] * n)) for i, (s, n) in enumerate([("a", 10)] * 3 + [("b", 400)] * 5 + [("c", 50)] * 200 + [(None, 7)] * 4 + [("é", 1000)] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    check_mix(mixing.mix(df).collect(), df.collect())


def test_named_weights(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "w " * 10) for i in range(200)] + [(1000 + i, "c", "w " * 10) for i in range(50)], "doc_id long, source string, text string")
    got = mixing.mix(df, weights={"a": 3, "b": 1}).groupBy("target").agg(F.sum("taken").alias("n")).collect()
    assert sorted(r.target for r in got) == [0.0, 625.0, 1875.0] and all(abs(r.n - r.target) <= 10 for r in got)


def test_mix_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.where("doc_id is not null and doc_id <> 13").collect()
    check_mix(mixing.mix(odd_docs.where("doc_id is not null and doc_id <> 13")).collect(), rows)
    got = mixing.mix(odd_docs).collect()
    assert len(got) == 16 and len({r.copies for r in got if r.doc_id == 13}) == 1
    out = mixing.repeat_documents(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(no_docs).count() == 0 and mixing.repeat_documents(no_docs).count() == 0
    blank = mixing.mix(odd_docs.where("doc_id in (6, 7, 8)")).collect()
    assert [(r["size"], r.taken, r.target) for r in blank] == [(0, 0, 0.0)] * 3


def test_newton_reaches_the_targets(spark):
    """Rates are exponential in the size, capped, and make each target; few steps suffice."""
    shapes = {"even": [7] * 50, "wide": [1, 1, 3, 10, 40, 200, 200, 5000], "long": [120] * 200 + [60_000], "one": [31]}
    sizes = [(f"{name} {share}", n) for name, own in shapes.items() for share in (0.001, 0.3, 1.0, 1.7, 2.9, 3.0) for n in own]
    df = spark.createDataFrame(sizes, "key string, size long")
    goals = df.groupBy("key").agg(F.sum("size").alias("source_size")).withColumn("target", F.col("source_size") * F.split("key", " ")[1].cast("double"))
    got, steps = mixing.tilts(df, goals)
    tilt, words = {r.key: r.tilt for r in got.collect()}, {}
    for key, n in sizes:
        words[key] = words.get(key, 0) + n * min(np.exp(tilt[key] * n), 3)
    assert all(abs(words[r.key] - r.target) <= 1e-8 * r.target for r in goals.collect()) and steps <= 40
    assert tilt["wide 1.0"] == 0 and tilt["wide 0.3"] < 0 < tilt["wide 1.7"]


def test_mix_tells_rows_without_an_id_apart(spark):
    rows = [(None, "ab"[i % 2], f"{i} " + "w " * (99 + i % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    by = mixing.mix(df).groupBy("source_size", "target").agg(F.sum("taken").alias("n"), F.max("size").alias("most")).collect()
    assert all(abs(r.n - r.target) <= r.most for r in by)


# Sharding
def plain_ring(rows, shards=16):
    """{row number: shard}: keys in ring order, own shard first, then overflow clockwise. rows: (ring hash, order hash)."""
    points, owner = sharding.ring(shards)
    ring = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)
    at = np.searchsorted(points, ring, side="left") % len(points)
    order = np.lexsort((np.array([r[1] for r in rows]), ring - points[-1] - np.uint64(1)))
    room, out, rest = sharding.bounds(len(rows), shards), {}, []
    for i in order:
        s = owner[at[i]]
        if room[s]:
            room[s] -= 1
            out[i] = s
        else:
            rest.append(i)
    for i in rest:
        k = at[i]
        while True:
            k = (k + 1) % len(points)
            if room[owner[k]]:
                room[owner[k]] -= 1
                out[i] = owner[k]
                break
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_ring_against_a_sequential_model(spark, hot):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0 if hot else F.lit(False), "copy").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = {r.doc_id: r for r in sharding.place(df.repartition(5)).collect()}
    keys = df.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64("doc_id").alias("o")).orderBy("doc_id").collect()
    want = plain_ring([(r.h, r.o) for r in keys])
    assert all(got[i].shard == want[i] for i in range(3000))
    own, counts = sharding.ring(16), np.bincount([r.shard for r in got.values()], minlength=16)
    assert counts.max() - counts.min() <= 1 and len(own[0]) == 16 * sharding.VIRTUAL
    for s in range(16):
        assert sorted(r.slot for r in got.values() if r.shard == s) == list(range(counts[s]))


def test_another_shard_moves_few_rows(spark):
    df = spark.range(8000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    a = {r.doc_id: r.shard for r in sharding.place(df, 16).collect()}
    b = {r.doc_id: r.shard for r in sharding.place(df, 17).collect()}
    assert sum(a[i] != b[i] for i in a) < 0.3 * 8000


def test_ring_odd_rows(spark, odd_docs, no_docs, tmp_path):
    got = sharding.place(odd_docs, carry=["lang", "shard"])
    rows = got.select("doc_id", "size", "text_crc32", "law", "slot", "grown_shard").collect()
    texts = sorted((len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect())
    assert sorted((r["size"], r.text_crc32) for r in rows) == texts and {(r.law, r.grown_shard, r.slot) for r in rows} == {("rows", None, 0)}
    assert sharding.place(no_docs).count() == 0 and sharding.place(odd_docs.limit(3)).count() == 3
    sharding.write_shards(odd_docs, str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().where("count <> 4").count() == 0


# URL rules
def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_rules_against_every_rule(spark):
    urls = ["http://net/", "https://a.net/x", "https://NET", "http://xnet/a", "http://a.example.net/en/1?q", "http://example.net/enx", "http://example.net/en", "http://org/fr/",
            "http://b.org/fr/z#t", "http://b.org/de/", "ftp://example.com/de/", "http://u@a.com:80/de/", None, "", "no url", "://", "http://", "http://a.net?x=/y", "http://a.net#/en/",
            "x://y://net/", "http://a..net/", "http://ünï.net/é/", "http://long." + "a." * 200 + "net/" + "x/" * 500, "http://evil.example.com/de/../x", "http://\nnet/a\nb"]
    more = [("www.example.com", "", "block"), ("example.com", "/d", "allow"), ("", "", "block"), ("net", "/x/x/", "allow"), ("Example.ORG", "/a", "block")]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("rule", F.lit("clash"))
    for rules in (list(url_rules.RULES), [*url_rules.RULES, *more]):
        got = {r.page_id: tuple(r)[1:] for r in url_rules.filter_urls(df, url_rules.rule_table(spark, rules)).collect()}
        low = [(h.lower(), p, v) for h, p, v in rules]
        assert got == {i: plain_verdict(u, low) for i, u in enumerate(urls)}


def test_url_edge_tables(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, "http://a.net/")], "page_id long, url string")
    none = url_rules.rule_table(spark).limit(0)
    assert {tuple(r)[3:] for r in url_rules.filter_urls(df, none).collect()} == {(None, "allow")}
    both = spark.createDataFrame([("net", "/", "allow"), ("net", "/", "block"), (None, "/", "block"), ("net", None, "block")], "host string, path string, verdict string")
    got = url_rules.filter_urls(df, both).collect()
    assert len(got) == 3 and {r.verdict for r in got} == {"block"} and url_rules.filter_urls(df.limit(0), both).count() == 0


# Rollups
def test_rollups_against_brute_force(spark, docs, sf_dir, reference_ids):
    want = {}
    first = {}
    for r in docs.orderBy("doc_id").collect():
        first.setdefault(r.text or "", r)
    for r in first.values():
        for version, n in ((rollups.BPE, len(reference_ids(r.text))), (rollups.WORDS, len(WORD.findall(r.text or "")))):
            d, t = want.get((r.source, r.lang, version), (0, 0))
            want[(r.source, r.lang, version)] = (d + 1, t + n)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in rollups.op10_token_rollups(spark, sf_dir).collect()} == want


def test_rollup_batches_are_idempotent(spark, tmp_path):
    roll = rollups.Rollup(spark, f"file://{tmp_path}/r")
    rows = lambda *r: spark.createDataFrame(r, rollups.SCHEMA)
    assert roll.totals().count() == 0
    assert roll.commit("a", rows(("s", None, "t", 2, 10), ("s", None, "t", 1, 5), (None, "en", "t", 1, None)))
    assert not roll.commit("a", rows(("s", None, "t", 99, 99)))
    assert roll.commit("b", rows(("s", None, "t", 0, -3)))
    assert roll.compact() and roll.commit("empty", rows())
    assert not roll.commit("b", rows(("s", None, "t", 0, -3)))
    assert roll.commit("c", rows((None, "en", "t", -1, 0), ("z", "z", "t", 1, 1)))
    want = {("s", None, "t", 3, 12), ("z", "z", "t", 1, 1)}
    assert {tuple(r) for r in roll.totals().collect()} == want
    assert roll.compact() and {tuple(r) for r in rollups.Rollup(spark, f"file://{tmp_path}/r").totals().collect()} == want
    assert roll.batches() == ["a", "b", "c", "empty"] and not list((tmp_path / "r/staging").iterdir())
    with pytest.raises(ValueError):
        roll.commit("../x", rows())


def test_rollup_loses_a_race_cleanly(spark, tmp_path):
    """Two writers of one batch: the one that comes second leaves no trace."""
    roll = rollups.Rollup(spark, f"file://{tmp_path}/r")
    row = spark.createDataFrame([("s", "l", "t", 1, 7)], rollups.SCHEMA)

    def late(path):
        row.write.parquet(path)
        assert roll.commit("a", row)  # the other writer

    assert not roll._publish(late, f"{roll.root}/batches/a")
    assert [tuple(r) for r in roll.totals().collect()] == [("s", "l", "t", 1, 7)]


def test_count_odd_rows(spark, odd_docs, no_docs):
    rows = rollups.count_tokens(odd_docs).collect()
    assert len(rows) == 16 and {(r.words, r.tokens) for r in rows if r.doc_id in (6, 7)} == {(0, 0)}
    assert {r.doc_id for r in rollups.later_copies(rollups.count_tokens(odd_docs)).collect()} == {4, 7}
    assert rollups.count_tokens(no_docs).count() == 0


# Queries with SQL, and the pipeline
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], sf_dir) is None


def test_pipeline_stages(spark, docs, sf_dir, reference_ids):
    """Every stage's rows from the rows before it, by the definitions of its operator."""
    kept, columns = docs, docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "quality classifier", "near duplicates", "mixing", "packing"]
    step = lambda name: corpus_pipeline.cut(stages[name](spark, kept, sf_dir))

    rules = quality_rules.fit(kept, quality_rules.trusted_ids(spark, sf_dir))
    want = {r.doc_id for r in quality_rules.judge(kept, rules).where("kept").collect()}
    after = step("quality rules")
    assert after.columns == columns and {r.doc_id for r in after.collect()} == want and 0 < len(want) < docs.count()

    kept = after
    field = crf.fit(kept, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    scores = crf.score_texts([t for _, t in texts], field)
    after = step("quality classifier")
    assert after.columns == columns and {r.doc_id for r in after.collect()} == {i for (i, _), s in zip(texts, scores, strict=True) if s >= 0.3}

    kept = after
    found = simhash.near_duplicates(kept).collect()
    after = step("near duplicates")
    assert after.columns == columns and sorted(r.doc_id for r in after.collect()) == sorted({r.component_id for r in found})

    kept = after
    copies = {r.doc_id: r.copies for r in mixing.mix(kept).collect()}
    after = step("mixing")
    assert after.columns == columns and {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}

    kept = after
    out = stages["packing"](spark, kept, sf_dir).collect()
    check_pieces(out, [(r.doc_id, r.text) for r in kept.collect()], reference_ids)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.start, r.ids_crc32) for r in out)


def test_pipeline_odd_rows(spark, odd_docs, no_docs, sf_dir, tmp_path):
    path = str(tmp_path / "d")
    odd_docs.write.parquet(path)
    stored = spark.read.parquet(path)
    once = corpus_pipeline.near_duplicate_stage(spark, stored, sf_dir)
    ids = [r.doc_id for r in once.collect()]
    assert once.columns == stored.columns and sorted(i for i in ids if i is not None) == [1, 2, 3, 5, 6, 9, 10, 11, 12, 13, 14]
    assert ids.count(13) == 1 and ids.count(None) == 1 and 4 not in ids and 7 not in ids and 8 not in ids
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, stored, sf_dir).columns == stored.columns, name
        assert stage(spark, no_docs, sf_dir).count() == 0, name


def test_pipeline_classifier_rejects_junk_that_passes_the_rules(spark, docs, sf_dir):
    """Every labelled document that reaches the stage is good; the junk planted among them has no label."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    junk = "\n".join(" ".join(f"{w}{i}!!$${i * j}##" for j, w in enumerate(["BUY", "WIN", "CLICK", "FREE", "CASH"])) for i in range(30))
    rules = quality_rules.fit(docs, quality_rules.trusted_ids(spark, sf_dir))
    planted = good.limit(1).withColumns({"doc_id": F.lit(10**9).cast("long"), "text": F.lit(junk)}).select(docs.columns)
    assert quality_rules.judge(planted, rules).first().kept
    stage = dict(corpus_pipeline.STAGES)["quality classifier"]
    after = {r.doc_id for r in stage(spark, good.unionByName(planted), sf_dir).collect()}
    assert 10**9 not in after and len(after) > 0.95 * good.count()


def test_queries_find_the_added_token(spark, sf_dir, tmp_path):
    """As the tokenizer of the file does as it comes."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = lambda text: [*plain.encode(text or "", add_special_tokens=False).ids, 1]
    texts = list(enumerate(["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x  <|endoftext|>  \n y", "<|endoftext| >", "none", "", "it's<|endoftext|>'s <|fim|>"]))
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in texts], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert 50256 in ids(texts[0][1])
    check_pieces(packing.op3_pow2_packing(spark, str(tmp_path)).collect(), texts, ids)
    check_pieces(corpus_pipeline.packing_stage(spark, docs, str(tmp_path)).collect(), texts, ids)
    total = [r.tokens for r in rollups.op10_token_rollups(spark, str(tmp_path)).collect() if r.tokenizer == rollups.BPE]
    assert total == [sum(len(ids(t)) for _, t in texts)]
