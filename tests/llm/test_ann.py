"""Nearest neighbours: recall against brute force, ties, copies and unusable vectors."""

import os

import numpy as np
import pytest

from statloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, ids int, v string, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "v", None) for i, v in rows], SCHEMA)


def truth(rows, k=5):
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], np.float32).astype(np.float64)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for j in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[j]
        order = sorted((i for i in range(len(ids)) if ids[i] != ids[j]), key=lambda i: (-round(s[i], 12), ids[i]))[:k]
        out[int(ids[j])] = [(int(ids[i]), s[i]) for i in order]
    return out


@pytest.mark.parametrize("dim", [64, 24])
def test_recall(spark, dim):
    r = np.random.default_rng(dim)
    centres = r.normal(0, 1, (20, dim))
    rows = [(i, centres[i % 20] + r.normal(0, 0.7, dim)) for i in range(3000)]
    df = frame(spark, rows)
    got = {}
    for x in ann.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=900, query_bytes=25 * 8 * dim).collect():
        got.setdefault(x.query_id, {})[x.rank] = (x.vec_id, x.score)
    want = truth(rows)
    assert set(got) == set(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q].values()}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    exact = {i: v for q in want for i, v in [(q, dict(want[q]))]}
    for q, g in got.items():
        for i, s in g.values():
            if i in exact[q]:
                assert s == pytest.approx(exact[q][i], abs=1e-12)
        assert [s for _, s in (g[k] for k in sorted(g))] == sorted((s for _, s in g.values()), reverse=True)


def test_copies_ties_and_bad_vectors(spark):
    r = np.random.default_rng(1)
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(400)] + [(1000 + i, r.normal(0, 1, 4)) for i in range(100)]
    bad = [(2000, None), (2050, []), (2100, [0, 0, 0, 0]), (2150, [1, None, 0, 0]), (2200, [float("nan"), 1, 0, 0]), (2250, [float("inf"), 1, 0, 0]), (2300, [1, 2]), (None, [1, 0, 0, 0])]
    df = frame(spark, rows + bad)
    got = {}
    for x in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    assert set(got) == {i for i, _ in rows if i % 50 == 0}
    assert [v for _, v, _ in sorted(got[0])] == [1, 2, 3, 4, 5] and [v for _, v, _ in sorted(got[350])] == [0, 1, 2, 3, 4]
    assert all(s == pytest.approx(1) for _, _, s in got[50])


def test_repeated_ids_leave_k_neighbours(spark):
    """Rows of the query's own id, in its class or in others, take no places of other ids."""
    own = [(0, [1.0, 0.0, 0.0])] * 9 + [(0, [1.0, 0.001 * i, 0.0]) for i in range(1, 9)]
    df = frame(spark, own + [(i, [1.0, 0.0, 0.0]) for i in range(1, 4)] + [(i, [1.0, 0.3 + 0.01 * i, 0.0]) for i in range(4, 12)] + [(1, [1.0, 0.0, 0.0])])
    asked = frame(spark, [(0, [1.0, 0.0, 0.0])])
    got = sorted((x.rank, x.vec_id) for x in ann.nearest(df, asked, shard_rows=6).collect())
    assert got == [(1, 1), (2, 1), (3, 2), (4, 3), (5, 4)]


def test_components_of_any_size(spark):
    """Scaling vectors by huge or tiny factors changes no neighbour."""
    r = np.random.default_rng(8)
    rows = [(i, r.normal(0, 1, 8)) for i in range(300)]
    scale = {0: 1e200, 1: 1e-200, 2: 1.0}
    df = spark.createDataFrame([(i, [float(x) * scale[i % 3] for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = {}
    for x in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    m = np.array([v for _, v in rows])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 300, 50):
        s = unit @ unit[q]
        s[q] = -2
        hits += len({v for _, v, _ in got[q]} & set(np.argsort(-s)[:5].tolist()))
        assert all(score == pytest.approx(s[v], abs=1e-12) for _, v, score in got[q])
    assert hits >= 0.9 * 30


def test_recall_on_given_vectors(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data here")
    df = spark.read.parquet(path)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want, got = truth(rows), {}
    for x in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    assert sum(len({i for i, _ in want[q]} & got[q]) for q in want) >= 0.95 * 5 * len(want)


def test_small_and_empty(spark):
    few = frame(spark, [(0, [1, 0]), (1, [0, 1]), (2, [1, 1])])
    got = sorted((x.rank, x.vec_id) for x in ann.nearest(few, few.where("vec_id % 50 = 0")).collect())
    assert got == [(1, 2), (2, 1)]
    none = frame(spark, [])
    assert ann.nearest(none, none).collect() == [] and ann.nearest(none, none).columns == ["query_id", "rank", "vec_id", "score"]
    alone = frame(spark, [(0, [1, 0])])
    assert ann.nearest(alone, alone).collect() == []


def test_pigeonhole_probing_is_exact():
    r = np.random.default_rng(2)
    vectors = r.normal(0, 1, (2000, 64))
    codes = ann.Codes(vectors, 0.9, 5)
    shard, bits = ann.Shard(codes, vectors), codes.encode(vectors)
    for radius in (3, 9, 17, 25):
        for q in bits[:20]:
            assert shard.within(q, radius).tolist() == np.flatnonzero((bits != q).sum(axis=1) <= radius).tolist()
    assert len(ann.flips(16, 2)) == 137
