import numpy as np
import pytest

from longreach.llm import vector_knn as K


def brute(ids, x, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 7)
    out = {}
    for i, a in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out[a] = [(ids[j], s[i, j]) for j in order]
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 64)).astype(np.float32)
    x[200:260] = x[:60] + 0.2 * rng.normal(size=(60, 64))
    return list(range(0, 4500, 3)), x


def frame(spark, ids, x):
    rows = [(int(i), v.tolist(), "c", 1) for i, v in zip(ids, x)]
    rows += [(100001, None, "c", 1), (100002, [0.0] * 64, "c", 1), (100003, [1.0] * 3, "c", 1), (100004, [float("nan")] * 64, "c", 1)]
    return spark.createDataFrame(rows, "id bigint, embedding array<float>, codes string, list int")


def test_recall_against_brute_force(spark, data):
    ids, x = data
    want = brute(ids, x, 10)
    got = {}
    # directions without any structure, the hardest case: most of the 64 lists have to be asked
    for r in K.knn(frame(spark, ids, x), k=10, nprobe=48, queries="id % 20 = 0").collect():
        got.setdefault(r["q"], []).append(r["n"])
    assert set(got) == {i for i in ids if i % 20 == 0}
    hits = sum(len(set(got[q]) & {n for n, _ in want[q]}) for q in got)
    assert hits / (10 * len(got)) >= 0.9


def test_recall_at_the_production_ratio(spark):
    """An eighth of the lists, on vectors with the structure of a corpus: many topics, and noise around them."""
    rng = np.random.default_rng(5)
    topics = rng.normal(size=(60, 64))
    x = (topics[rng.integers(0, 60, 3000)] + 0.7 * rng.normal(size=(3000, 64))).astype(np.float32)
    assert K.lists_for(3000) == 64 and K.probes_for(64) == 32 and K.probes_for(512) == 64 and K.probes_for(4096) == 512
    want = brute(list(range(3000)), x, 10)
    got = {}
    for r in K.knn(frame(spark, range(3000), x), k=10, nprobe=8, queries="id % 20 = 0 and id < 3000").collect():
        got.setdefault(r["q"], set()).add(r["n"])
    assert sum(len(got[q] & {n for n, _ in want[q]}) for q in got) / (10 * len(got)) >= 0.9 and len(got) == 150


def test_mutual_pairs_are_complete(spark, data):
    ids, x = data
    want = {(min(a, n), max(a, n)) for a, near in brute(ids, x, 10).items() for n, s in near if s >= 0.87}
    got = {tuple(r) for r in K.mutual_pairs(frame(spark, ids, x), nprobe=8).collect()}
    assert len(want) >= 50
    assert got <= want and len(got) >= 0.98 * len(want)


def test_copies_take_the_smallest_ids(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 64)).astype(np.float32)
    rows = [(i, x[0].tolist()) for i in range(30)] + [(100 + i, v.tolist()) for i, v in enumerate(x[1:])]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    got = {}
    for r in K.knn(df, k=10, nprobe=16).collect():
        got.setdefault(r["q"], set()).add(r["n"])
    for i in range(30):
        assert got[i] == set([j for j in range(12) if j != i][:10])
    assert all(len(n) == 10 for n in got.values())


def test_large_lists_are_cut(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 7)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 64)).astype(np.float32)
    ids = list(range(60))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id bigint, embedding array<float>")
    got = {(r["q"], r["n"]) for r in K.knn(df, k=5, nprobe=16).collect()}
    assert got == {(q, n) for q, near in brute(ids, x, 5).items() for n, _ in near}


def test_empty(spark):
    assert K.knn(spark.createDataFrame([], "id bigint, embedding array<float>")).count() == 0


def test_codes_prefer_small_parallel_error():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = K.fit(x, 16)
    near = K._nearest(x, index.centroids, True)
    residual = x - index.centroids[near]

    def parallel(eta):
        codes = K._encode(residual, x, index.books, eta)
        back = np.concatenate([index.books[m][codes[:, m]] for m in range(16)], axis=1)
        return float((((residual - back) * x).sum(axis=1) ** 2).mean())

    assert parallel(index.eta) < parallel(1.0)
