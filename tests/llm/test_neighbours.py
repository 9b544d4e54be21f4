import numpy as np
import pytest

from assaylake.llm import neighbours as N


def brute(ids, x, k):
    out = {}
    for i in range(len(ids)):
        d = np.zeros(len(ids))
        for a in range(x.shape[1]):
            e = x[i, a] - x[:, a]
            d = d + e * e
        order = [j for j in np.lexsort((np.array(ids), d)) if j != i][:k]
        out[ids[i]] = [ids[j] for j in order]
    return out


def table(spark, ids, x):
    return spark.createDataFrame([(i, [float(v) for v in r], "z", 0) for i, r in zip(ids, x)], "id string, vec array<double>, vid string, dist int")


def recall(got, want):
    return sum(len(set(got[i]) & set(want[i])) for i in want) / sum(map(len, want.values()))


def answers(df, k, **kw):
    out = {}
    for r in sorted(N.nearest_neighbours(df, "id", "vec", k, **kw).collect(), key=lambda r: (r.id, r.rank)):
        out.setdefault(r.id, []).append(r.neighbour)
    return out


@pytest.mark.parametrize("dim", [2, 8])
def test_recall_and_crowds(spark, dim, monkeypatch):
    monkeypatch.setattr(N, "LIST_SIZE", 64)
    rng = np.random.default_rng(dim)
    x = np.vstack([rng.normal(0, 0.01, (700, dim)), rng.uniform(-5, 5, (900, dim)), rng.normal(2, 1, (400, dim))])
    x = np.vstack([x, np.repeat(x[:1], 600, axis=0)])  # a quarter of all rows are copies of one vector
    ids = [f"c{i:05d}" for i in rng.permutation(len(x))]
    got, want = answers(table(spark, ids, x), 5), brute(ids, x, 5)
    assert recall(got, want) >= (0.99 if dim == 2 else 0.9)
    assert all(len(v) == 5 and i not in v for i, v in got.items())
    copies = [i for i, r in zip(ids, x) if (r == x[0]).all()]
    assert all(got[i] == want[i] for i in copies)


def test_ties_go_to_the_smaller_id(spark):
    grid = [(f"p{i:02d}{j:02d}", (i, j)) for i in range(6) for j in range(6)]
    ids, x = [g[0] for g in grid], np.array([g[1] for g in grid], float)
    assert answers(table(spark, ids, x), 4) == brute(ids, x, 4)


def test_many_ties_at_the_last_distance(spark):
    """Many points on a sphere around the one that asks: the smaller ids are kept."""
    x = np.array([(0.0, 0.0, 0.0)] + [tuple(np.eye(3)[a] * s) for a in range(3) for s in (1.0, -1.0)] + [(0.6, 0.8, 0.0), (0.6, -0.8, 0.0), (-0.6, 0.8, 0.0), (-0.6, -0.8, 0.0), (0.0, 0.6, 0.8), (0.0, 0.6, -0.8), (0.0, -0.6, 0.8), (0.0, -0.6, -0.8), (0.8, 0.0, 0.6), (-0.8, 0.0, 0.6)])
    ids = ["z"] + [f"p{i:02d}" for i in np.random.default_rng(0).permutation(len(x) - 1)]
    got = answers(table(spark, ids, x), 2)
    assert got["z"] == brute(ids, x, 2)["z"] == ["p00", "p01"]
    at, near = N._nearest_in(np.zeros((1, 2)), np.array([[1.0, 0.0], [0.0, 1.0]] * 30), 3)
    assert at.tolist() == [[0, 1, 2]] and near.tolist() == [[1.0, 1.0, 1.0]]


def test_sparse_lists_are_topped_up(spark, monkeypatch):
    """Lists with fewer than k vectors: every row still gets k others."""
    monkeypatch.setattr(N, "LIST_SIZE", 4)
    monkeypatch.setattr(N, "LEAST_LIST", 2)
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(10**i, 1e-3, (3, 2)) for i in range(12)])
    ids = [f"c{i:03d}" for i in range(len(x))]
    got = answers(table(spark, ids, x), 30)
    assert all(len(set(v)) == 30 and i not in v for i, v in got.items()) and len(got) == len(x)


def test_long_lists_are_searched_by_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "SAMPLE_ROWS", 60)  # few centroids for many vectors
    monkeypatch.setattr(N, "LIST_SIZE", 24)
    monkeypatch.setattr(N, "LONG_LIST", 60)
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (1500, 2))
    ids = [f"c{i:04d}" for i in range(len(x))]
    assert recall(answers(table(spark, ids, x), 5), brute(ids, x, 5)) >= 0.99


def test_edges(spark):
    empty = table(spark, [], np.zeros((0, 2)))
    assert N.nearest_neighbours(empty, "id", "vec", 5).count() == 0
    assert answers(table(spark, ["a"], np.zeros((1, 2))), 5) == {}
    assert answers(table(spark, ["a", "b", "c"], np.array([[0, 0], [1, 0], [3, 0.0]])), 5) == {"a": ["b", "c"], "b": ["a", "c"], "c": ["b", "a"]}
    far = np.array([[0.0, 0.0], [1e9, 1e9], [1e9, 1e9 + 1], [0, 1e-9]])
    assert answers(table(spark, list("abcd"), far), 1) == {"a": ["d"], "b": ["c"], "c": ["b"], "d": ["a"]}


def test_unusable_rows(spark):
    rows = [("a", [0.0, 0.0]), ("b", [1.0, 0.0]), ("b", [1.0, 0.0]), ("b", [9.0, 9.0]), ("c", None), ("d", [1.0]), ("e", [float("nan"), 0.0]), ("f", [None, 1.0]), (None, [0.0, 0.0]), ("g", [float("inf"), 0.0]), ("h", [])]
    df = spark.createDataFrame(rows, "id string, vec array<double>")
    assert answers(df, 5) == {"a": ["b"], "b": ["a"]} == answers(df, 5, dim=2)
    assert answers(df, 5, dim=3) == {}


def test_balanced():
    x = np.vstack([np.random.default_rng(0).normal(0, 1e-3, (5000, 2)), np.random.default_rng(1).uniform(0, 9, (500, 2))])
    c = N.balanced_centroids(x, 100)
    owner = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
    assert np.bincount(owner).max() <= 400
    g = N.CentroidGraph.build(c)
    near, _ = g.nearest(x)
    assert (near[:, 0] == owner).mean() > 0.995
