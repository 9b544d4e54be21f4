import numpy as np
import pytest

from assaylake.llm import clusters as L
from assaylake.llm.clusters import Clustering, average_linkage


def cliques(rows, eps, least=3):
    like = {i: {j for j, h, y in rows if g is not None and g == h and np.sqrt(((np.array(x) - np.array(y)) ** 2).sum()) <= eps} for i, g, x in rows}
    out = set()
    for i, s in like.items():
        if len(s) >= least and all(like[j] == s for j in s) and i != min(s):
            out.add((min(s), i))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, g, [float(v) for v in x], "n", 1) for i, g, x in rows], "id string, grp int, vec array<double>, node string, cluster int")


def scene(seed):
    rng = np.random.default_rng(seed)
    pts = [(g, rng.uniform(0, 2, 2)) for g in (0, 0, 1, None) for _ in range(60)]
    for _ in range(60):
        c, n = rng.uniform(0, 6, 2), rng.integers(2, 7)
        pts += [(2, c + rng.uniform(-1, 1, 2) * rng.choice([0.005, 0.015, 0.02, 0.03])) for _ in range(n)]
    pts += [(3, rng.normal(0, 0.03, 2)) for _ in range(300)]  # a crowd
    pts += [(4, np.array([9.0, 9.0]))] * 40 + [(4, np.array([9.0, 9.04]))] * 40  # copies, one isolated clique
    return [(f"c{i:04d}", g, tuple(p)) for i, (g, p) in enumerate(pts)]


@pytest.mark.parametrize("seed", [0, 1])
def test_isolated_cliques(spark, seed):
    rows = scene(seed)
    c = Clustering(table(spark, rows), 0.05, 2)
    assert {tuple(r) for r in c.isolated_cliques().collect()} == cliques(rows, 0.05)
    members = {r.id: (r.grp, r.c0, r.c1) for r in c.members().collect()}
    assert set(members) == {i for i, g, _ in rows if g is not None}
    info = c.describe(2).collect()
    assert sum(r["size"] for r in info) == len(members)
    sizes = {}
    for m in members.values():
        sizes[m] = sizes.get(m, 0) + 1
    assert sorted(r["size"] for r in info) == sorted(sizes.values())
    heads = {r.head_id: r for r in info}
    assert heads["c" + f"{len(rows) - 80:04d}"]["size"] == 80
    assert all(len(r.typical) == min(2, r["size"]) for r in info)


def test_a_big_isolated_clique(spark):
    rng = np.random.default_rng(5)
    a = rng.uniform(0, 2 * np.pi, 900)
    r = 0.0249 * np.sqrt(rng.uniform(0, 1, 900))
    rows = [(f"k{i:04d}", 0, (1 + r[i] * np.cos(a[i]), 1 + r[i] * np.sin(a[i]))) for i in range(900)] + [("far", 0, (1.2, 1.0)), ("b", 1, (1.0, 1.0))]
    c = Clustering(table(spark, rows), 0.05, 2)
    assert {tuple(x) for x in c.isolated_cliques().collect()} == cliques(rows, 0.05) and c.isolated_cliques().count() == 899


def one_at_a_time(w, sizes, threshold):
    """Clusters by merging the single best pair again and again."""
    groups = {k: {k} for k in sizes}
    size = lambda g: sum(sizes[x] for x in g)
    while len(groups) > 1:
        s, a, b = min((-sum(w.get((min(x, y), max(x, y)), 0.0) for x in groups[a] for y in groups[b]) / size(groups[a]) / size(groups[b]), a, b) for a in groups for b in groups if a < b)
        if -s < threshold:
            break
        groups[a] |= groups.pop(b)
    return {frozenset(g) for g in groups.values()}


def test_linkage_equals_one_merge_at_a_time():
    rng = np.random.default_rng(2)
    n = 24
    w = {(i, j): round(float(rng.uniform(0, 1)), 3) for i in range(n) for j in range(i + 1, n) if rng.uniform() < 0.35}
    u, v, s = (np.array(x) for x in zip(*[(i, j, x) for (i, j), x in w.items()]))
    root, left, _, _ = average_linkage(u, v, s, np.ones(n), np.ones(n, bool), np.zeros((n, 2)), 0.3)
    assert not len(left)
    assert {frozenset(np.flatnonzero(root == r).tolist()) for r in set(root)} == one_at_a_time(w, dict.fromkeys(range(n), 1), 0.3)


@pytest.mark.parametrize("block", [3.0, 12.0])
def test_blocks_change_nothing(spark, monkeypatch, block):
    """Clusters that lie across the borders of blocks are those of one merge at a time."""
    monkeypatch.setattr(L, "BLOCK", block)
    rng = np.random.default_rng(7)
    rows = [(f"q{i:03d}", int(i % 2), tuple(rng.uniform(0, 0.45, 2))) for i in range(150)]
    c = Clustering(table(spark, rows), 0.05, 2)
    side, reach2 = c.space.side, (L.REACH * 0.05) ** 2
    tiles = {}
    for i, g, x in rows:
        tiles.setdefault((g, *(int(np.floor(a / side)) for a in x)), []).append((i, np.array(x)))
    w = {}
    for a, p in tiles.items():
        for b, q in tiles.items():
            if a < b and a[0] == b[0]:
                s = sum(1 - ((x - y) ** 2).sum() / reach2 for _, x in p for _, y in q)
                if s > 0:
                    w[a, b] = s
    want = {frozenset(i for t in g for i, _ in tiles[t]) for g in one_at_a_time(w, {t: len(p) for t, p in tiles.items()}, 0.5)}
    got = {}
    for r in c.members().collect():
        got.setdefault((r.grp, r.c0, r.c1), set()).add(r.id)
    assert {frozenset(g) for g in got.values()} == want


def test_crowded_tiles_in_doubt(spark):
    """Two crowded tiles just within, or just beyond, the radius: decided without pairs of all their points."""
    rng = np.random.default_rng(3)
    y = rng.uniform(0, 0.004, 400)
    near = [(f"a{i:03d}", 0, (0.0, v)) for i, v in enumerate(y)] + [(f"b{i:03d}", 0, (0.0497, v)) for i, v in enumerate(y)]
    apart = [(f"c{i:03d}", 1, (0.0, v)) for i, v in enumerate(y)] + [(f"d{i:03d}", 1, (0.0502, v)) for i, v in enumerate(y)]
    rows = near + apart
    assert {tuple(r) for r in Clustering(table(spark, rows), 0.05, 2).isolated_cliques().collect()} == cliques(rows, 0.05)


@pytest.mark.parametrize("dim", [1, 3])
def test_other_dimensions(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(f"e{i:03d}", 0, tuple(rng.uniform(0, 0.6 if dim == 3 else 6, dim))) for i in range(120)]
    assert {tuple(r) for r in Clustering(table(spark, rows), 0.05 if dim == 1 else 0.12, dim).isolated_cliques().collect()} == cliques(rows, 0.05 if dim == 1 else 0.12)
    with pytest.raises(ValueError):
        Clustering(table(spark, rows), 0.05, 4)


def test_edges(spark):
    empty = Clustering(table(spark, []), 0.05, 2)
    assert empty.isolated_cliques().count() == 0 and empty.describe().count() == 0
    nulls = Clustering(table(spark, [("a", None, (0, 0)), ("b", None, (0, 0))]), 0.05, 2)
    assert nulls.isolated_cliques().count() == 0 and nulls.describe().count() == 0
    negative = [("a", 0, (-1e-9, 0.0)), ("b", 0, (1e-9, 0.0)), ("c", 0, (0.0, -1e-9))]
    assert Clustering(table(spark, negative), 0.05, 2).isolated_cliques().count() == 2


def test_unusable_records(spark):
    rows = [("a", 0, [0.0, 0.0]), ("b", 0, [0.01, 0.0]), ("b", 0, [0.01, 0.0]), ("c", 0, [0.0, 0.01]), ("d", 0, None), ("e", 0, [0.0]), ("f", 0, [float("nan"), 0.0]), (None, 0, [0.0, 0.0]), ("g", None, [0.0, 0.0])]
    c = Clustering(spark.createDataFrame(rows, "id string, grp int, vec array<double>"), 0.05, 2)
    assert {tuple(r) for r in c.isolated_cliques().collect()} == {("a", "b"), ("a", "c")}
    assert [tuple(r) for r in c.describe().collect()] == [("a", 3, ["a", "b", "c"])] or c.describe().first()["size"] == 3
