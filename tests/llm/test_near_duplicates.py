"""SimHash and embedding near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logweave.llm import components, itq, simhash


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    smallest = {}
    for n in nodes:
        smallest[find(n)] = min(smallest.get(find(n), n), n)
    return {n: smallest[find(n)] for n in nodes}


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components(spark, kind):
    rng = random.Random(3)
    pairs = {"random": [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)], "path": [(i, i + 1) for i in range(100)], "star": [(0, i) for i in range(1, 80)], "none": []}[kind]
    edges = spark.createDataFrame([*pairs, (5, 5), (None, 3)], "u long, v long")
    got = components.connected_components(edges).collect()
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert {r.node for r in got} == nodes and len(got) == len(nodes)
    want, roots = union(pairs, nodes), {}
    for r in got:
        roots.setdefault(r.root, set()).add(want[r.node])
    assert all(len(s) == 1 for s in roots.values()) and len(roots) == len(set(want.values()))


def plain_fingerprint(text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if shingles and 2 * votes[b] > len(shingles))


def brute(rows):
    """{row number: component} of (doc_id, fingerprint) rows."""
    fps = sorted({f for _, f in rows})
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2]
    group, best = union(pairs, fps), {}
    for d, f in rows:
        if d is not None:
            best[group[f]] = min(best.get(group[f], d), d)
    return [best.get(group[f]) for _, f in rows]


def test_simhash_against_brute_force(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = simhash.near_duplicates(docs).collect()
    rows = [(r.doc_id, int(r.fingerprint, 16)) for r in got]
    assert sorted(r[0] for r in rows) == sorted(texts)
    assert all(plain_fingerprint(texts[d]) == f for d, f in rows)
    assert [r.component_id for r in got] == brute(rows)
    assert any(r.component_id != r.doc_id for r in got)


def test_simhash_odd_rows(spark, odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert got[0].asDict().keys() == {"doc_id", "fingerprint", "component_id", "kept"} and len(got) == 16
    rows = [(r.doc_id, int(r.fingerprint, 16)) for r in got]
    assert [r.component_id for r in got] == brute(rows)
    by = {r.doc_id: r for r in got}
    assert by[4].component_id == 1 and by[6].fingerprint == "0" * 16 and by[8].component_id == by[7].component_id == by[6].component_id
    assert by[None].component_id is None and not by[None].kept
    assert simhash.near_duplicates(no_docs).count() == 0


def test_anchors_lose_no_link():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 64, 1500, dtype=np.uint64)
    homes = simhash.home_anchor(fps)
    for fp, home in zip(fps.tolist(), homes.tolist(), strict=True):
        for n in (0, 1, 2):
            other = fp
            for b in rng.choice(64, n, replace=False):
                other ^= 1 << int(b)
            assert home in simhash.visited_anchors(other)
    at, anchors = simhash._copies(fps[:50])
    assert all(sorted(anchors[at == i]) == sorted(simhash.visited_anchors(int(f))) for i, f in enumerate(fps[:50]))


def test_dense_groups_link_completely(spark):
    """All fingerprints around one centre, many of them in the same anchors."""
    centre, rng = 0x9E3779B97F4A7C15, random.Random(1)
    fps = {centre}
    for _ in range(400):
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = {(r.u, r.v) for r in simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert links == want


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_fingerprints_are_not_broadcast(spark, tmp_path):
    """However small the table that they are made from: there are 61 of each."""
    spark.range(3000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fps"))
    plan = final_plan(simhash.fingerprint_links(spark.read.parquet(str(tmp_path / "fps"))))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_documents_are_not_broadcast(spark):
    """A row per document would go to the driver, and where there are few fingerprints one task would write all rows."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.format_string("the same %d words", F.col("id") % 7).alias("text"))
    found = simhash.near_duplicates(docs)
    top = next(line for line in final_plan(found).splitlines() if "Join" in line)
    assert "BuildLeft" not in top, top
    got = found.collect()
    assert len(got) == 3000 and [r.component_id for r in got] == brute([(r.doc_id, int(r.fingerprint, 16)) for r in got])


def vectors(n=600, d=64, seed=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    out = [base]
    for spread in (0.01, 0.1, 0.3, 0.42):
        out.append(base[:120] + spread * rng.normal(size=(120, d)))
    out.append(np.repeat(base[:3], 20, axis=0))
    return np.concatenate(out).astype(np.float32)


@pytest.mark.parametrize("d", [64, 16, 96])
def test_embeddings_against_brute_force(spark, d):
    x = vectors(d=d)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in itq.near_duplicates(df).collect()}
    u = itq.unit(x)
    linked = (u @ u.T >= 0.9 + 1e-12) & ~np.eye(len(u), dtype=bool)
    found = sum(r.n_links for r in got.values())
    assert found >= 0.95 * linked.sum()
    assert all(got[i].n_links <= linked[i].sum() for i in got)
    want = union(np.argwhere(linked).tolist(), range(len(x)))
    assert np.mean([got[i].component_id == want[i] for i in got]) > 0.97
    assert all(want[got[i].component_id] == want[i] for i in got)


@pytest.mark.parametrize(("d", "common"), [(64, 0.0), (64, 0.7), (64, 0.8), (16, 0.8)])
def test_recall_at_the_threshold(spark, d, common):
    """Pairs at a cosine of 0.90 to 0.92 whose vectors share a direction, so that their mean has the length `common`."""
    rng, n = np.random.default_rng(7), 1500
    x = np.sqrt(1 - common**2) * itq.unit(rng.normal(size=(n, d)))
    x = itq.unit(x + common * np.eye(d)[0])
    aside = rng.normal(size=(n, d))
    aside = itq.unit(aside - (aside * x).sum(axis=1, keepdims=True) * x)
    cosine = rng.uniform(0.9, 0.92, (n, 1))
    x = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * aside])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = [r.n_links for r in itq.near_duplicates(df).orderBy("vec_id").collect()]
    linked = ((itq.unit(x) @ itq.unit(x).T) >= 0.9 + 1e-12).sum(axis=1) - 1
    print(d, common, sum(got) / linked.sum())
    assert sum(got) >= 0.97 * linked.sum()


def test_embeddings_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    u = itq.unit(np.array([r.embedding for r in rows]))
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    got = [r.n_links for r in itq.near_duplicates(df).orderBy("vec_id").collect()]
    assert sum(got) >= 0.99 * want.sum() and all(a <= b for a, b in zip(got, want, strict=True))


def test_embedding_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [nan, 1.0, 0.0]), (8, [inf, 0.0, 0.0]),
            (9, [1.0, None, 0.0]), (10, [1e-30, 0.0, 0.0]), (11, [1e30, 0.0, 0.0]), (12, [1.0, 0.0]), (13, [-1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"node": F.lit(1), "size": F.lit("x"), "code": F.lit(2)})
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in itq.near_duplicates(df).collect()]
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r[1:])
    assert len(got) == len(rows)
    assert by[1] == [(5, 1, True)] and by[2] == [(5, 1, False)] and by[11] == [(5, 1, False)] and by[3] == [(5, 1, False)] * 2
    assert all(by[i] == [(0, i, True)] for i in (4, 5, 6, 7, 8, 9, 12, 13)) and by[None] == [(0, None, False)]
    assert itq.near_duplicates(df.limit(0)).count() == 0


def test_sql_of_brute_force_on_linked_vectors(spark, tmp_path):
    """The registered SQL on a table with links, which the smallest test tables lack."""
    from ..oracle import compare

    x = vectors(n=150)[:330]
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert compare(spark, "op2", itq.op2_itq_near_dup, itq.OP2_SQL, str(tmp_path)) is None
