"""Communities, grids, models and metadata against small computations of their own."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.model import Assay
from assaylake.operators import community as C
from assaylake.operators import graph as G
from assaylake.operators import grid as D
from assaylake.operators import hmm as H
from assaylake.operators import kernels as K
from assaylake.operators import metadata as M
from assaylake.operators import plotdata as P
from assaylake.operators import stats as T
from assaylake.operators import summaries as S


def ring_of_cliques(k=6, n=8):
    edges = [(c * n + i, c * n + j) for c in range(k) for i in range(n) for j in range(i + 1, n)]
    return k * n, edges + [(c * n, (c + 1) % k * n + 1) for c in range(k)]


def test_leiden_finds_cliques_and_stays_connected():
    n, edges = ring_of_cliques()
    a, b = np.array(edges).T
    for seed in range(3):
        part = C.communities(n, a, b, np.ones(len(a)), 1.0, seed, 2, 0.01)
        assert [len(set(part[c * 8 : c * 8 + 8])) for c in range(6)] == [1] * 6 and len(set(part)) == 6
    rng = np.random.default_rng(0)
    x = rng.random((60, 60)) < 0.08
    a, b = np.nonzero(np.triu(x, 1))
    w = np.ones(len(a))

    def quality(part):
        k = np.bincount(np.concatenate([a, b]), minlength=60)
        m = 2 * len(a)
        return 2 * (part[a] == part[b]).sum() / m - sum((k[part == c].sum() / m) ** 2 for c in set(part))

    found = C.communities(60, a, b, w, 1.0, 1, 2, 0.01)
    assert quality(found) > quality(rng.integers(0, 6, 60)) + 0.2
    labels = C._connected_parts(60, np.concatenate([a, b]), np.concatenate([b, a]), found)
    assert len(set(labels)) == len(set(found))


def test_refinement_never_joins_across_communities():
    n, edges = ring_of_cliques(4, 6)
    a, b = np.array(edges).T
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(src, kind="stable")
    indptr = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])
    part = np.arange(n) // 12
    for beta in (0.001, 0.01, 1.0):
        fine = C._refined(n, indptr, dst[order], np.ones(len(src)), part, 1.0, beta, np.random.default_rng(0))
        assert all(len(set(part[fine == c])) == 1 for c in set(fine)) and len(set(fine)) < n


def test_matrices(spark):
    n, edges = ring_of_cliques(4, 5)
    nodes, graph = spark.range(n), spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, weight double")
    rows = {r.id: r.codes for r in C.leiden_matrix(nodes, graph, [0.5, 1.0]).collect()}
    assert len(rows) == n and {len(c) for c in rows.values()} == {2}
    one = {r.id: r.community for r in C.leiden(nodes, graph, resolution=1.0, random_seed=1, beta=0.03).collect()}
    assert {i: c[1] for i, c in rows.items()} == one
    sizes = [np.bincount([c[k] for c in (r.codes for r in C.random_neighbourhood_matrix(nodes, graph, [4, 5], 2).collect())]) for k in range(2)]
    assert sizes[0].tolist() == [5] * 4 and sizes[1].tolist() == [4] * 5
    with pytest.raises(ValueError):
        C.leiden_matrix(nodes, graph, 1.0)


def test_tree(spark):
    edges = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(8)] + [(f"b{i}", f"c{i}") for i in range(3)], "src string, dst string")
    members = spark.createDataFrame([(f"{c}{i}", c) for c in "abc" for i in range(8)], "id string, community string")
    steps, order = C.community_tree(edges, members)
    assert [(r.a, r.b, r.height) for r in steps.collect()] == [(0, 1, 2.0), (2, 3, 8.0)]
    assert {r.community for r in order.collect()} == set("abc") and sorted(r.position for r in order.collect()) == [0, 1, 2]


def test_silhouettes_of_any_labels(spark):
    x = np.array([[0.0], [0.1], [5.0], [5.2], [9.0]])
    rows = [(i, [float(v)], label) for i, (v, label) in enumerate(zip(x[:, 0], ["a", "a", "b", "b", "lonely"]))] + [(9, [1.0], None)]
    got = {r.id: (r.cluster, r.silhouette) for r in C.silhouettes(spark.createDataFrame(rows, "id long, vec array<double>, cluster string")).collect()}
    assert set(got) == {0, 1, 2, 3, 4} and got[4] == ("lonely", 0.0) and got[0][0] == "a"
    assert math.isclose(got[0][1], 1 - 0.1 / 5.1)


def test_strengths_equal_a_loop():
    import pandas as pd

    rng = np.random.default_rng(0)
    rows = [np.sort(rng.random(k)) for k in (1, 5, 10, 10)] + [np.zeros(4), np.array([0.0, 0.5, 0.5])]
    for d, w in zip(rows, G._strengths.func(pd.Series(rows))):
        rho = d[d > 0].min() if (d > 0).any() else 0.0
        low, high, mid = 0.0, np.inf, 1.0
        for _ in range(64):
            s = np.exp(-np.maximum(d - rho, 0) / mid).sum()
            if abs(s - np.log2(len(d) + 1)) < 1e-5:
                break
            if s > np.log2(len(d) + 1):
                high, mid = mid, (low + mid) / 2
            else:
                low, mid = mid, mid * 2 if high == np.inf else (mid + high) / 2
        assert np.allclose(w, np.exp(-np.maximum(d - rho, 0) / max(mid, 1e-3 * d.mean(), 1e-12)))


def test_grid_chain(spark):
    rng = np.random.default_rng(0)
    shape = (9, 7)
    mask = rng.random(shape) < 0.7
    z = np.where(mask, rng.random((2, *shape)) * (rng.random((2, *shape)) < 0.8), 0.0)
    rows = spark.createDataFrame([(f"v{f}", int(i), int(j), float(z[f, i, j])) for f, i, j in zip(*np.nonzero(z))], "var_id string, ix int, iy int, z double")
    known = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(mask))], "ix int, iy int")

    def dense(df, s):
        out = np.full((2, *s), np.nan)
        for r in df.collect():
            out[int(r.var_id[1:]), r.ix, r.iy] = r.z
        assert not np.isnan(out).any()
        return out

    want = []
    for f in range(2):
        x = np.where(mask, D.median_filter(np.where(mask, z[f], np.nan)), 0.0)
        norm = D.gaussian_filter(mask.astype(float), (0.5, 0.5))
        want.append(np.where(norm <= 1e-5, 7.0, D.gaussian_filter(x, (0.5, 0.5)) / np.where(norm <= 1e-5, 1, norm)))
    x = np.array(want)
    options = dict(gauss=0.5, passes=1, nan_fill=7.0)
    plain = (x - x.min()) / (x.max() - x.min())
    assert np.allclose(dense(D.transform_grid(rows, known, shape, **options), shape), plain)
    top = np.quantile(x, 0.9)
    y = np.minimum(x, top)
    y = (y - y.min()) / (y.max() - y.min())
    y = y * np.minimum(1 / np.quantile(y.reshape(2, -1), 0.8, axis=1), 1.5)[:, None, None]
    y = np.minimum(y, np.quantile(y, 0.95))
    low = np.quantile(y, 0.1)
    y = np.where(y < low, 0.0, y)
    y = (y - y.min()) / (y.max() - y.min())
    got = dense(D.transform_grid(rows, known, shape, all_feature_q=0.8, range_q=0.9, max_up=1.5, winsor_high=0.95, winsor_low=0.1, winsor_low_to_zero=True, upscale=2, scalar=3.0, **options), (18, 14))
    assert np.allclose(got, 3 * np.array([D.bilinear(i, 2) for i in y]))
    y = np.maximum(np.minimum(x, 0.5 * x.max()), 0.2 * 0.5 * x.max())
    got = dense(D.transform_grid(rows, known, shape, winsor_high=0.5, winsor_low=0.2, winsor_is_share_of_max=True, **options), shape)
    assert np.allclose(got, (y - y.min()) / (y.max() - y.min()))
    with pytest.raises(ValueError):
        D.transform_grid(rows, known, shape, upscale=1.5)


def test_order_statistics(spark):
    x = np.random.default_rng(1).integers(0, 40, 500) / 7
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    for q in (0.0, 0.31, 0.5, 1.0):
        assert math.isclose(df.limit(1).select(K.order_statistic_quantile(df, "v", q).alias("q")).first().q, np.quantile(x, q))


def test_trimming_keeps_the_middle(spark):
    cells = [(0, 0, 1), (1, 0, 5), (2, 0, 1), (3, 0, 5), (4, 0, 1)]
    grid = spark.createDataFrame([(x, y, n, "ab"[x % 2]) for x, y, n in cells], "ix int, iy int, n_cells long, c string")
    assert sorted(r.ix for r in D.trim_grid(grid, 1).collect()) == [1, 2, 3]
    assert {r.ix: r.mode for r in D.color_summary(grid, "c", 1).collect()} == {1: "b", 2: "a", 3: "b"}
    assert D.trim_grid(grid, 99).count() == 0


def test_metabins_and_grids(spark):
    obs, var = spark.createDataFrame([("o1",)], "obs_id string"), spark.createDataFrame([("a",), ("b",)], "var_id string")
    turned = Assay(spark.createDataFrame([("a", 1), ("b", 2)], "obs_id string, leiden int"), obs.withColumnRenamed("obs_id", "var_id"), obsm={"X": spark.createDataFrame([("a", [0.0])], "obs_id string, vec array<double>")}, uns={"community_tree": "tree"})
    a = M.add_metabin_metadata(Assay(obs, var), turned, "leiden", embedding="X")
    assert {(r.var_id, r.metabin) for r in a.var.collect()} == {("a", 1), ("b", 2)} and a.uns["metabin_community_tree"] == "tree" and a.obsm["var:X_embedding"].columns == ["var_id", "vec"]
    for bad in (lambda: M.add_metabin_metadata(Assay(obs, var.limit(1)), turned, "leiden"), lambda: M.add_metabin_metadata(Assay(obs, var), turned, "kmeans"), lambda: M.add_metabin_metadata(Assay(obs, var), turned, "leiden", embedding="Y")):
        with pytest.raises(ValueError):
            bad()
    first, second = M.same_grid([Assay(obs, var, uns={"grid": 1, "summary": 2, "own": 3}), Assay(obs, var, uns={"grid": 9})])
    assert second.uns == {"grid": 1, "summary": 2} and first.uns["own"] == 3


def test_model_results_merge(spark):
    a, b = H.HmmResults("m", {"p": 1}, {"r": 2}), H.HmmResults("m", {"p": 3, "q": 4})
    with pytest.warns(UserWarning):
        both = a.merge(b)
    assert both.probabilities == {"p": 3, "q": 4} and both.reconstructed == {"r": 2}
    for bad in (lambda: a.merge(b, overwrite=False), lambda: a.merge(H.HmmResults("n"))):
        with pytest.raises(ValueError):
            bad()


def test_lagged_correlation(spark):
    y = [3.0, 1.0, 4.0, 1.5, 5.0, 9.0, 2.0]
    rows = [("g", t, float(y[t - 2]) ** 3 if t >= 2 else 0.0, y[t]) for t in range(7)] + [("flat", t, 1.0, float(t)) for t in range(4)]
    df = spark.createDataFrame(rows, "gene string, t int, x double, y double")
    got = {r.gene: r.res for r in H.lagged_correlation(df, ["gene"], lag=2).collect()}
    assert math.isclose(got["g"], 1.0) and got["flat"] is None
    plain = {r.gene: r.res for r in H.bootstrap_correlation(df, "gene", q=None, ignore_zero=False).collect()}
    assert plain["flat"] == 0.0 and math.isclose(plain["g"], np.corrcoef([r[2] for r in rows[:7]], y)[0, 1])


def test_constant_columns_have_no_correlation(spark):
    rows = [(r, c, v) for r, (a, b, k) in enumerate([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 7.0, 5.0)]) for c, v in zip("abk", (a, b, k))]
    got = {(r.a, r.b): r.r for r in T.column_correlations(spark.createDataFrame(rows, "row int, column string, value double"), "column", "row").collect()}
    assert got["a", "k"] is None and got["a", "b"] > 0.98


def test_modalities(spark):
    obs = spark.createDataFrame([("o1", "x"), ("o2", "x"), ("o3", "y")], "obs_id string, cat string")
    coo = spark.createDataFrame([("o1", "a", 1.0), ("o2", "a", 3.0), ("o3", "b", 4.0), ("o3", "c", 9.0)], "obs_id string, var_id string, value double")
    wanted = spark.createDataFrame([("a",), ("b",)], "var_id string")
    s = S.summarize_modalities({"m": coo, "n": coo.withColumn("value", F.col("value") * 2)}, wanted, obs, "cat", sqrt=True)
    assert math.isclose(s.where("modality = 'm'").agg(F.sum(F.col("value") * F.col("value"))).first()[0], 1e6)
    raw = S.summarize_modalities({"m": coo}, wanted, obs, "cat", norm_per_modality=False)
    assert {(r.cat, r.var_id): r.mean for r in S.modality_means(raw, obs, "cat").collect()} == {("x", "a"): 2.0, ("y", "b"): 4.0}


def test_pairs_of_a_list(spark):
    keys = spark.createDataFrame([(f"k{i:02d}",) for i in range(30)] + [("k00",), (None,)], "k string")
    got = [tuple(r) for r in P.index_pairs(keys, "k").collect()]
    assert len(got) == len(set(got)) == 30 * 29 // 2 and all(a < b for a, b in got)
