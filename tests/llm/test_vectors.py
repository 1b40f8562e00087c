"""Vector searches against brute force, and the pipeline's stages."""

import os

import numpy as np
import pytest

from strandlake.llm import mtree, multi_index, vectors

SF = "/root/testdata/sf0.001"


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def sample(n, dims, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) + 2 * rng.integers(0, 2, (n, 1))
    x[n // 2 :: 5] = x[0]  # one vector many times: ties
    return x


def test_mtree_is_exact(spark, monkeypatch):
    monkeypatch.setattr(mtree, "NODE", 128)
    x = sample(700, 8, 3)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(9000, None, 1), (9100, [1.0, None] * 4, 1), (9200, [float("nan")] * 8, 1), (9300, [], 1), (None, x[1].tolist(), 1)]
    got = {}
    for r in mtree.mtree_top_k(table(spark, rows), k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    q = np.floor(1024 * x).astype(int)
    assert set(got) == {i for i in range(0, 700, 100)}
    for i in got:
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(700), -s)) if j != i][:10]
        assert sorted(got[i]) == [(k + 1, j, s[j]) for k, j in enumerate(order)]


def best_by_force(q, k=10):
    s = q @ q.T
    return sorted((i, place + 1, int(j), int(s[i, j])) for i in range(len(q)) for place, j in enumerate([j for j in np.lexsort((np.arange(len(q)), -s[i])) if j != i][:k]))


@pytest.mark.parametrize("scale", [1024, 1 << 27])  # products within 2**53 and beyond
def test_mtree_in_lanes_and_lots(spark, monkeypatch, scale):
    for name, value in {"NODE": 128, "LOT": 1, "LANES": 2}.items():  # lanes of 8 nodes, lots of 256 queries
        monkeypatch.setattr(mtree, name, value)
    monkeypatch.setattr(vectors, "NODE", 128)
    x = sample(2500, 8, 9)
    got = mtree.mtree_top_k(table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), k=10, scale=scale, step=1).collect()
    assert sorted(map(tuple, got)) == best_by_force(np.floor(scale * x).astype(int))


def test_mtree_of_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(mtree, "HELD", 1000)
    x = np.tile(sample(3, 8, 4)[:1], (600, 1))
    got = mtree.mtree_top_k(table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), k=10, step=1).collect()
    assert sorted(map(tuple, got)) == best_by_force(np.floor(1024 * x).astype(int))


def test_mtree_broadcasts_no_copies_of_queries(spark, monkeypatch):
    monkeypatch.setattr(mtree, "NODE", 128)
    monkeypatch.setattr(vectors, "NODE", 128)
    x = sample(4000, 64, 11)
    rows = table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]).repartition(4)
    spark.conf.set("spark.sql.maxBroadcastTableSize", "12MB")  # the copies of all queries for each node took 32 MB as one
    try:
        assert mtree.mtree_top_k(rows, k=10, step=4).count() == 10_000
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_mtree_of_few_and_none(spark):
    got = mtree.mtree_top_k(table(spark, [(100, [1.0, 0.0], 0), (1, [2.0, 1.0], 0), (2, [-0.5, 0.0], 0)]), k=10).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(100, 1, 1, 2 * 1024 * 1024), (100, 2, 2, -512 * 1024)]
    assert mtree.mtree_top_k(table(spark, []).limit(0)).count() == 0
    assert multi_index.nearest(table(spark, []).limit(0)).count() == 0


def test_traverse_takes_cells_in_order():
    rng = np.random.default_rng(1)
    a, b, sizes = rng.random(9), rng.random(7), rng.integers(0, 5, (9, 7))
    cells = list(multi_index.traverse(a, b, sizes, 10**9))
    assert len({(i, j) for _, i, j in cells}) == 63
    assert [d for d, _, _ in cells] == sorted(d for d, _, _ in cells) and all(np.isclose(d, a[i] + b[j]) for d, i, j in cells)


def test_multi_index_recall(spark):
    x = sample(3000, 16, 5)
    x[7] = 0
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5000, None, 0), (5100, [float("inf")] * 16, 0)]
    got = {}
    for r in multi_index.nearest(table(spark, rows), k=10, codes=32, share=0.3).collect():
        assert 0.3 * 2998 <= r.compared + 1 <= 0.5 * 2998  # distances only to entries of the cells taken: the share, and one vector that stands 300 times
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    found = total = 0
    for i in range(0, 3000, 100):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(3000), d)) if j not in (i, 7)][:10]
        mine = sorted(got[i])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and all(s == d[j] for _, j, s in mine)
        found += len({j for _, j, _ in mine} & set(order))
        total += 10
    assert found >= 0.9 * total


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, f in corpus_pipeline.STAGES:
        out = corpus_pipeline.stage(f(spark, docs, SF), name)
        if name != "bpe":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now and now <= ids
        if name == "language_id":
            assert now == ids  # every document here has letters
        ids, docs = now, out


def test_pipeline_keeps_one_row_a_component(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    near = a.replace("a39", "zz")  # 35 of 37 shingles in common
    rows = [
        (3, a, "en", "s", 1), (7, near, "en", "s", 2), (7, b, "en", "s", 3), (8, c, "en", "s", 4), (8, d, "en", "s", 5),  # one id, other components
        (None, e, "en", "s", 6), (None, e, "en", "s", 7), (None, e + " more", "en", "s", 8), (None, a, "en", "s", 9),  # copies without ids
        (9, b, "en", "s", 10), (5, d + " x", "en", "s", 11), (None, "", "en", "s", 12), (None, None, "en", "s", 13), (1, " ", "en", "s", 14), (1, " ", "en", "s", 14),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    tids = [r.t for r in docs.selectExpr("n_chars", "xxhash64(text) t").orderBy("n_chars").collect()]
    best = {}
    for i, (r, t) in enumerate(zip(rows, tids)):
        if sets[i]:
            best[group[i]] = min(best.get(group[i], (True, 2**63, 2**63, 2**63)), (r[0] is None, r[0] or 0, t, r[4]))
    want = sorted([b[3] for b in best.values()] + [r[4] for r, x in zip(rows, sets) if not x])
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.n_chars for r in got.collect()) == want
