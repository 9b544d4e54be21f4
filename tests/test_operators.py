"""Operators whose results SQL doesn't give, against small computations of their own."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.functions.special import beta_inc, chi2_sf_1, normal_two_sided, t_two_sided
from assaylake.model import Assay, LayerSpec, Pct
from assaylake import settings as Z
from assaylake.operators import clustering as U
from assaylake.operators import community as C
from assaylake.operators import embedding as E
from assaylake.operators import graph as G
from assaylake.operators import grid as D
from assaylake.operators import hmm as H
from assaylake.operators import kernels as K
from assaylake.operators import layers as L
from assaylake.operators import metadata as M
from assaylake.operators import ontology as O
from assaylake.operators import stats as T
from assaylake.operators import summaries as S
from assaylake.sources import annotation as A
from assaylake.sources import export as X
from assaylake.sources.fragments import BIN_SIZE, count_bins, fragments, read_fragments, write_bulks
from assaylake.streaming.fragments import running_bin_counts, stream_fragments


def coo(spark, m):
    return spark.createDataFrame([(f"o{i}", f"v{j}", float(x)) for i, r in enumerate(m) for j, x in enumerate(r) if x], "obs_id string, var_id string, value double")


def dense(df, n, m):
    out = np.zeros((n, m))
    for r in df.collect():
        out[int(r.obs_id[1:]), int(r.var_id[1:])] = r.value
    return out


def names(spark, letter, n):
    return spark.createDataFrame([(f"{letter}{i}",) for i in range(n)], f"{'obs_id' if letter == 'o' else 'var_id'} string")


GOLD = [[2, 0, 1], [0, 3, 0], [1, 1, 0]]


def test_special_functions(spark):
    assert math.isclose(beta_inc(2.0, 3.0, 0.4).item(), 0.5248, abs_tol=1e-10) and beta_inc(2.0, 3.0, 0.0) == 0 and beta_inc(2.0, 3.0, 1.0) == 1
    row = spark.range(1).select(chi2_sf_1(F.lit(3.2323232)).alias("c"), normal_two_sided(F.lit(1.959963985)).alias("n"), t_two_sided(F.lit(2.228138852), F.lit(10.0)).alias("t")).first()
    assert math.isclose(row.c, 0.0721982, abs_tol=1e-6) and math.isclose(row.n, 0.05, abs_tol=1e-8) and math.isclose(row.t, 0.05, abs_tol=1e-8)


def test_ranks_and_adjustment(spark):
    v = spark.createDataFrame([(i, x) for i, x in enumerate([0.0, 0.0, 3.0, 1.0, 3.0])], "i int, v double")
    assert [r["rank"] for r in K.midrank(v, [], "v").orderBy("i").collect()] == [1.5, 1.5, 4.5, 3.0, 4.5]
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.2), (5, None), (6, float("nan"))], "i int, p double")
    assert [round(r.p_adj, 7) for r in K.benjamini_hochberg(p.where("i < 5"), "p").orderBy("i").collect()] == [0.04, 0.0533333, 0.0533333, 0.2]
    assert [r.p_adj for r in K.benjamini_hochberg(p, "p").where("i > 4").collect()] == [1.0, 1.0]
    assert K.benjamini_hochberg(p.limit(0), "p").count() == 0


def test_order_over_ranges(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.random(3000) ** 3, 3)
    df = spark.createDataFrame([(i, float(x), "ab"[i % 2]) for i, x in enumerate(p)], "i int, p double, g string").repartition(6)

    def adjust(q):
        order = np.argsort(q, kind="stable")
        a = np.minimum.accumulate((q[order] * len(q) / np.arange(1, len(q) + 1))[::-1])[::-1]
        out = np.empty(len(q))
        out[order] = np.minimum(a, 1)
        return out

    got = np.array([r.p_adj for r in K.benjamini_hochberg(df, "p").orderBy("i").collect()])
    assert np.allclose(got, adjust(p))
    got = np.array([r.p_adj for r in K.benjamini_hochberg(df, "p", partition=["g"]).orderBy("i").collect()])
    assert np.allclose(got[::2], adjust(p[::2])) and np.allclose(got[1::2], adjust(p[1::2]))
    rank = np.array([r["rank"] for r in K.midrank(df, [], "p").orderBy("i").collect()])
    assert np.allclose(rank, [(p < x).sum() + ((p == x).sum() + 1) / 2 for x in p])


def test_quantile_with_zeros(spark):
    x = np.array([[0, 0, 5, 1, 0], [0, 2, 2, 8, 9], [0, 0, 0, 0, 0], [1, 1, 1, 1, 1]], float).T
    for q in (0.0, 0.3, 0.5, 0.77, 1.0):
        got = {r.var_id: r.quantile for r in K.zero_aware_quantile(coo(spark, x), ["var_id"], F.lit(5), q).collect()}
        want = {f"v{j}": np.quantile(x[:, j], q) for j in range(4) if x[:, j].any()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got), q


def test_joins(spark):
    rng = np.random.default_rng(0)
    iv = lambda n: [(i, "ab"[int(rng.integers(2))], int(s), int(s + rng.integers(0, 40))) for i, s in enumerate(rng.integers(-50, 300, n))]
    a, b = iv(60) + [(99, "a", None, 5)], iv(60) + [(98, None, 1, 5)]
    schema = "id int, chr string, start int, end int"
    got = sorted((r.a.id, r.b.id) for r in K.interval_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), width=16).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and None not in x and None not in y and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])
    left = spark.createDataFrame([(i, "a", int(p)) for i, p in enumerate(rng.integers(-20, 200, 50))] + [(77, "none", 5)], "id int, chr string, pos int")
    starts = sorted(set(int(s) for s in rng.integers(0, 180, 20)))
    right = spark.createDataFrame([("a", s, f"b{s}") for s in starts], "chr string, start int, name string")
    hit = {r.id: r.name for r in K.asof_join(left, right, on="chr", at="pos", start="start", width=16, carry=["name"]).collect()}
    assert hit == {r.id: (f"b{max(s for s in starts if s <= r.pos)}" if r.chr == "a" and r.pos >= starts[0] else None) for r in left.collect()}


def test_layers(spark):
    a = Assay(names(spark, "o", 3), names(spark, "v", 3), {"x": coo(spark, GOLD)})
    m = np.array(GOLD, float)
    w = np.log(3 / (m > 0).sum(0))
    got = dense(L.transform(a, LayerSpec("x", idf_transform=True, normalize_with_l2_norm=True, norm_total=1.0)), 3, 3)
    want = m * w / np.linalg.norm(m * w, axis=1, keepdims=True)
    assert np.allclose(got, want) and np.allclose(got[0], [0.5938759, 0, 0.8045567])
    got = dense(L.transform(a, LayerSpec("x", normalize_with_obs_counts=True, log_transform=True)), 3, 3)
    assert np.allclose(got[0], [8.8050253, 0, 8.1120280])
    some = LayerSpec("x", features=spark.createDataFrame([("v0",)], "var_id string"), normalize_with_l2_norm=True, norm_total=1.0, scalar=2.0)
    assert np.allclose(dense(L.transform(a, some), 3, 3)[:, 0], 2 * m[:, 0] / np.linalg.norm(m, axis=1))
    assert dense(L.transform(a, LayerSpec("x", feature_active_threshold=1.5), binarize=True), 3, 3).tolist() == [[1, 0, 0], [0, 1, 0], [0, 0, 0]]
    with pytest.raises(ValueError):
        LayerSpec("x", normalize_with_obs_counts=True, normalize_with_l2_norm=True)
    with pytest.raises(KeyError):
        a.layer("y")
    x = np.random.default_rng(0).random((6, 5)) * (np.random.default_rng(1).random((6, 5)) > 0.4)
    row = L.gram_weights({"x": coo(spark, x)}).first()
    assert math.isclose(1 / row.weight, np.linalg.norm(x @ x.T - np.eye(6))) and math.isclose(row.scalar, 1.0)


def test_filter_reaches_a_fixpoint(spark):
    rng = np.random.default_rng(3)
    m = rng.integers(0, 4, (30, 20)) * (rng.random((30, 20)) < 0.4)
    a = Assay(names(spark, "o", 30), names(spark, "v", 20), {"x": coo(spark, m)})
    got = M.filter_assay(a, ["x"], [9], [12], purge=True)
    o, v = np.ones(30, bool), np.ones(20, bool)
    while True:
        o2 = o & (m[:, v].sum(1) > 9)
        v2 = v & (m[o2].sum(0) > 12)
        if (o2 == o).all() and (v2 == v).all():
            break
        o, v = o2, v2
    assert {r.obs_id for r in got.obs.collect()} == {f"o{i}" for i in np.flatnonzero(o)} and {r.var_id for r in got.var.collect()} == {f"v{i}" for i in np.flatnonzero(v)}
    again = M.filter_assay(got, ["x"], [9], [12])
    assert again.obs.where("exclude").count() == 0 and again.var.where("exclude").count() == 0
    kept = M.filter_assay(a, ["x"], [Pct(50)], [None], iterate=False)
    assert {r.obs_id for r in kept.obs.where("not exclude").collect()} == {f"o{i}" for i in np.flatnonzero(m.sum(1) > np.quantile(m.sum(1), 0.5))}


def test_tests_on_known_numbers(spark):
    one = spark.createDataFrame([(8, 10, 3, 10), (0, 10, 0, 10)], "g int, gn int, r int, rn int")
    r = T.chi_square(one, "g", "gn", "r", "rn").orderBy(F.desc("g")).collect()
    assert math.isclose(r[0].chi2, 3.2323232, abs_tol=1e-6) and math.isclose(r[0].pval, 0.0721982, abs_tol=1e-6) and math.isclose(r[0].score, 1.1699250, abs_tol=1e-6) and r[1].pval == 1.0
    v = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 5)] + [("b", float(x)) for x in (2, 4, 6, 8, 10)], "g string, value double")
    t = T.t_test(v, "g", "a", "b").first()
    assert math.isclose(t.t, -1.8973666, abs_tol=1e-6) and math.isclose(t.pval, 0.0943, abs_tol=1e-4) and t.df == 8
    assert T.mann_whitney(v, "g", "a", "b").first().u == 5.0
    both = T.pairwise_tests(v, "g", [("a", "b"), ("b", "a")], test="ttest", fdc=True).collect()
    assert len(both) == 2 and math.isclose(both[0].pval, both[1].pval)
    x = np.random.default_rng(0).integers(0, 5, (12, 4)) * (np.random.default_rng(5).random((12, 4)) > 0.5)
    lab = spark.createDataFrame([(f"o{i}", "ab"[i % 2]) for i in range(12)], "obs_id string, g string")
    for r in T.sparse_rank_sums(coo(spark, x), lab, "g", F.lit(12)).collect():
        col = x[:, int(r.var_id[1:])]
        rank = np.array([(col < c).sum() + ((col == c).sum() + 1) / 2 for c in col])
        assert r.rank_sum == rank[[i for i in range(12) if "ab"[i % 2] == r.g]].sum()


def test_likelihood_ratio(spark):
    rng = np.random.default_rng(0)
    n = 80
    y, z = rng.integers(0, 2, n), rng.normal(size=n)
    x = np.column_stack([rng.exponential(1 + 2 * y), rng.exponential(1, n), np.zeros(n), np.where(y == 1, 3.0, 1.0)])
    cells = spark.createDataFrame([(f"o{i}", "g", int(y[i]), float(z[i])) for i in range(n)], "obs_id string, group string, y int, covariate double")
    got = {r.var_id: r for r in T.likelihood_test(coo(spark, x), cells, min_lfc=0.0, fdr=False).collect()}
    assert set(got) == {"v0", "v1", "v3"}

    def fit(a):
        w = np.zeros(a.shape[1])
        for _ in range(200):
            p = 1 / (1 + np.exp(-a @ w))
            w = w + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-9 * np.eye(a.shape[1]), a.T @ (y - p))
        p = 1 / (1 + np.exp(-a @ w))
        return (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    null = np.column_stack([np.ones(n), z])
    for j in (0, 1):
        stat = 2 * (fit(np.column_stack([null, x[:, j]])) - fit(null))
        assert math.isclose(got[f"v{j}"].pval, math.erfc(math.sqrt(stat / 2)), rel_tol=1e-5)
        assert math.isclose(got[f"v{j}"].score, math.log2(x[y == 1, j].mean() / x[y == 0, j].mean()))
    assert got["v3"].pval < 1e-15  # perfect separation ends


def blobs(spark, k=3, n=40, seed=0):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(c * 8, 1, (n, 3)) for c in range(k)])
    return x, spark.createDataFrame([(f"p{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, vec array<double>")


@pytest.mark.parametrize("name", ["euclidean", "manhattan", "chebyshev", "cosine", "correlation", "canberra", "braycurtis", "minkowski:3"])
def test_knn(spark, name):
    x, df = blobs(spark)
    got = {}
    for r in G.knn_exact(df, df, 4, metric_name=name, block_rows=50).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append(r.dst)
    d = G.metric(name)(x, x)
    np.fill_diagonal(d, np.inf)
    assert got == {f"p{i:03d}": [f"p{j:03d}" for j in np.argsort(d[i], kind="stable")[:4]] for i in range(len(x))}


def test_communities(spark):
    x, df = blobs(spark)
    graph = G.fuzzy_simplicial_set(G.knn_exact(df, df, 8))
    w = {(r.src, r.dst): r.weight for r in graph.collect()}
    assert all(math.isclose(w[a, b], w[b, a]) and 0 < v <= 1 for (a, b), v in w.items())
    found = {r.id: r.community for r in C.leiden(df, graph, resolution=0.1).collect()}
    truth = {f"p{i:03d}": i // 40 for i in range(len(x))}
    assert all((found[a] == found[b]) <= (truth[a] == truth[b]) for a in found for b in found)
    q = C.modularity(graph, C.leiden(df, graph)).first().modularity
    assert q >= C.modularity(graph, spark.createDataFrame(list(truth.items()), "id string, community int")).first().modularity - 0.02
    assert found == {r.id: r.community for r in C.leiden(df, graph, resolution=0.1).collect()}
    parts = {r.id: r.component for r in C.connected_components(df, G.radius_graph(df, 4.0)).collect()}
    assert len(set(parts.values())) == 3 and all(parts[k] == f"p{v * 40:03d}" for k, v in truth.items())
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    ends = spark.range(43)
    assert {r.component for r in C.connected_components(ends, chain).collect()} == {0, 41, 42}
    assert C.connected_components(ends, chain.limit(0)).where("id <> component").count() == 0
    a, b = np.array([0, 1, 2, 3]), np.array([1, 2, 3, 4])
    assert np.bincount(C.random_neighbourhoods(6, a, b, 3, 0)).tolist() == [2, 2, 2]


def test_hierarchy():
    linkage, order = C.community_hierarchy({"a": 2, "b": 2, "c": 4}, {("a", "b"): 8, ("b", "c"): 3})
    assert linkage[0] == (0, 1, 0.5, 2) and linkage[1][3] == 3 and set(order) == {"a", "b", "c"} and abs(order.index("a") - order.index("b")) == 1
    with pytest.raises(ValueError):
        C.community_hierarchy({"a": 1, "b": 1}, {})


def test_transfer(spark):
    x, df = blobs(spark)
    labels = spark.createDataFrame([(f"p{i:03d}", "abc"[i // 40]) for i in range(len(x))], "id string, label string")
    near = spark.createDataFrame([("q0", [float(v) for v in x[5]]), ("q1", [8.1, 8.0, 7.9])], "id string, vec array<double>")
    assert {r.src: r.predicted for r in G.KnnPredictor(df, labels=labels).predict(near).collect()} == {"q0": "a", "q1": "b"}
    values = spark.createDataFrame([(f"p{i:03d}", float(i)) for i in range(len(x))], "id string, value double")
    assert {r.src: r.predicted for r in G.KnnPredictor(df, values=values).predict(near).collect()}["q0"] == 5.0
    with pytest.raises(ValueError):
        G.KnnPredictor(df)


def test_eigen(spark):
    rng = np.random.default_rng(0)
    x = rng.random((40, 12)) * (rng.random((40, 12)) < 0.6)
    x[:20, :6] += 1
    c = coo(spark, x)
    values, emb = E.spectral(c, 3, passes=10)
    w = x * np.log(40 / (x > 0).sum(0))
    w = w / np.linalg.norm(w, axis=1, keepdims=True)
    d = w @ w.sum(0) - 1
    a = (w / np.sqrt(d)[:, None]) @ (w / np.sqrt(d)[:, None]).T - np.diag(1 / d)
    true = np.linalg.eigh(a)
    top = sorted(true[0][np.argsort(-abs(true[0]))[:3]], reverse=True)
    assert np.allclose(values, top, atol=1e-3)
    v = np.array([r.vec for r in emb.orderBy(F.expr("cast(substring(obs_id, 2) as int)")).collect()])
    assert abs(abs(v[:, 0] @ true[1][:, np.argmax(true[0])]) / np.linalg.norm(v[:, 0]) - 1) < 1e-4
    pts, df = blobs(spark)
    ratio, proj = E.pca(df.withColumnRenamed("id", "obs_id"), 2)
    s = np.linalg.svd(pts - pts.mean(0), compute_uv=False) ** 2
    assert np.allclose(ratio, (s / s.sum())[:2])
    p = np.array([r.vec for r in proj.orderBy("obs_id").collect()])
    assert np.allclose(p.mean(0), 0, atol=1e-9) and np.allclose((p**2).sum(0), s[:2])


def test_images():
    z = np.arange(12, dtype=float).reshape(3, 4)
    assert np.allclose(D.gaussian_filter_1d(z, 1.0, axis=0, mode="reflect")[:, 0], [2.8350845, 4, 5.1649155])
    assert D.median_filter(np.array([[1, np.nan, 3], [4, 5, 60]]))[0].tolist() == [4.0, 4.0, 5.0]
    assert np.allclose(D.bilinear(z, 2)[0], np.linspace(0, 3, 8)) and np.allclose(D.bilinear(z, 1), z)
    with pytest.raises(ValueError):
        D.median_filter(z, (2, 3))


def test_grid_edges(spark):
    xs = [0, 0.1, 2.5, 2.6, 7.5, 9.9, 10]
    pts = spark.createDataFrame([(f"o{i}", float(v), 0.0) for i, v in enumerate(xs)], "obs_id string, x double, y double")
    assert [r.ix for r in D.assign_pixels(pts, (5, 5)).orderBy("obs_id").collect()] == [0, 1, 1, 2, 3, 4, 4]


def test_hmm(spark):
    rng = np.random.default_rng(0)
    model = H.Hmm(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.4, 0.6]]), np.array([[2.0], [1.0]]), np.array([[1.0], [3.0]]), ("gamma",))
    x = rng.exponential(1, (5, 1))
    post, _, ll = H.forward_backward(model, x)
    e = np.exp(model.log_density(x))
    total, marg = 0.0, np.zeros((5, 2))
    for code in range(32):
        s = [(code >> i) & 1 for i in range(5)]
        p = model.start[s[0]] * np.prod([model.trans[a, b] for a, b in zip(s, s[1:])]) * np.prod([e[i, k] for i, k in enumerate(s)])
        total += p
        for i, k in enumerate(s):
            marg[i, k] += p
    assert math.isclose(ll, math.log(total)) and np.allclose(post, marg / total)
    k, theta = H.gamma_fit(np.array([6.0]), np.array([float(np.log(rng.gamma(3, 2, 200_000)).mean())]))
    assert abs(k[0] - 3) < 0.05 and abs(theta[0] - 2) < 0.05
    rows = [(f"g{g}", 0, t, 0, float(rng.gamma(2, 1) if (t // 10) % 2 else rng.gamma(8, 2))) for g in range(4) for t in range(60)]
    tensor = spark.createDataFrame(rows, "gene string, cell_type int, t int, modality int, value double")
    fitted, history = H.fit_hmm(tensor, H.create_hmm(2, ["gamma"], seed=3), max_iter=12, tol=0.01)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(history, history[1:])) and np.allclose(fitted.trans.sum(1), 1)
    assert H.posteriors(tensor, fitted).where("abs(posterior[0] + posterior[1] - 1) > 1e-9").count() == 0
    assert fitted.expected().max() > 3 * fitted.expected().min()


def test_ontology(spark):
    got = spark.createDataFrame([(3, 5, 8, 20), (0, 4, 3, 9), (5, 5, 5, 10)], "k int, n int, marked int, total int").withColumn("p", O.fisher_exact("k", "n", "marked", "total")).collect()
    for r in got:
        pr = lambda i: math.comb(r.marked, i) * math.comb(r.total - r.marked, r.n - i) / math.comb(r.total, r.n)  # noqa: B023, E731
        support = range(max(0, r.n + r.marked - r.total), min(r.n, r.marked) + 1)
        assert math.isclose(r.p, min(1, sum(pr(i) for i in support if pr(i) <= pr(r.k) * (1 + 1e-7))), rel_tol=1e-9)
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "child string, parent string")
    terms = spark.createDataFrame([(x, x, "MF") for x in "abcd"], "go string, name string, ns string")
    assert {tuple(r) for r in O.closure(terms, loop).collect()} == {(x, y) for i, x in enumerate("abcd") for y in "abcd"[i:]}
    assert {r.go: r.depth for r in O.depths(terms, loop).collect()} == {"a": 3, "b": 2, "c": 1, "d": 0}


FRAG = "chr1\t100\t4900\tA\t1\n# comment\nchr1\t4900\t5100\tA\t9\nchr1\t9999\t10001\tB\t1\n"


def test_fragment_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/f.tsv").write_text(FRAG)
    frag = read_fragments(spark, str(tmp_path / "in/f.tsv"))
    want = {"both": {("A", 0, 2), ("A", 1, 1), ("B", 1, 1), ("B", 2, 1)}, "start": {("A", 0, 2), ("B", 1, 1)}, "end": {("A", 0, 1), ("A", 1, 1), ("B", 2, 1)}}
    for method, rows in want.items():
        assert {(r.bc, r.bin, r.n) for r in count_bins(frag, method=method).collect()} == rows
    genome = spark.createDataFrame([("chr1", 12000), ("chr2", 900)], "chr string, length long")
    a = fragments(frag, genome, BIN_SIZE)
    assert a.var.count() == 3 and {r.obs_id for r in a.obs.collect()} == {"A", "B"}
    short = frag.withColumn("chr", F.lit("1"))
    assert fragments(short, genome).var.where("chr = 'chr1'").count() == 3
    with pytest.raises(ValueError):
        fragments(frag.withColumn("chr", F.lit("chrZ")), genome)
    obs = spark.createDataFrame([("A", "x"), ("B", None)], "obs_id string, cat string")
    from assaylake.sources.fragments import bulk_fragments

    write_bulks(bulk_fragments(frag, obs, "cat"), str(tmp_path / "bulk"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "bulk/category=x")).count() == 2
    stream = running_bin_counts(stream_fragments(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bins").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.bc, r.bin, r.n) for r in spark.table("bins").collect()} == want["both"]


def test_annotation_files(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#x\n2L\tsrc\tgene\t5\t90\t.\t+\t.\tgene_id "FB1"; gene_symbol "abc";\n2L\tsrc\texon\t5\t9\t.\t+\t.\tgene_id "FB1";\nchrX\tsrc\tgene\t7\t80\t.\t-\t.\tgene_symbol "d"; gene_id "FB2";\n')
    got = [tuple(r) for r in A.gtf(spark, str(tmp_path / "a.gtf"), extra_key="gene_id").orderBy("start").collect()]
    assert got == [("chr2L", "+", 5, 90, "abc", "FB1"), ("chrX", "-", 7, 80, "d", "FB2")]
    (tmp_path / "o.obo").write_text("format-version: 1.2\n\n[Term]\nid: GO:1\nname: root\nnamespace: molecular_function\n\n[Term]\nid: GO:2\nname: child\nnamespace: molecular_function\nis_a: GO:1 ! root\n\n[Term]\nid: GO:3\nname: old\nnamespace: biological_process\nis_obsolete: true\n\n[Typedef]\nid: part_of\nname: x\nnamespace: external\n")
    terms, edges = A.obodag(spark, str(tmp_path / "o.obo"))
    assert {tuple(r) for r in terms.collect()} == {("GO:1", "root", "MF"), ("GO:2", "child", "MF")} and [tuple(r) for r in edges.collect()] == [("GO:2", "GO:1")]
    line = lambda sym, q, go: "\t".join(["FB", "id", sym, q, go, *["x"] * 12])
    (tmp_path / "g.gaf").write_text("!gaf-version: 2.2\n" + "\n".join([line("abc", "involved_in", "GO:2"), line("abc", "NOT|involved_in", "GO:1"), line("d", "", "GO:1"), line("d", "", "GO:3")]) + "\n")
    assert {tuple(r) for r in A.gaf(spark, str(tmp_path / "g.gaf"), terms).collect()} == {("MF", "abc", "GO:2"), ("MF", "d", "GO:1")}
    c = coo(spark, GOLD)
    X.save_sparse(c, str(tmp_path / "x"))
    assert X.load_sparse(spark, str(tmp_path / "x")).count() == 5
    codes = c.select(F.expr("cast(substring(obs_id, 2) as long)").alias("row"), F.expr("cast(substring(var_id, 2) as long)").alias("col"), "value")
    X.save_npz(codes, str(tmp_path / "x.npz"), (3, 3))
    back, shape = X.load_npz(spark, str(tmp_path / "x.npz"))
    assert shape == (3, 3) and sorted(map(tuple, back.collect())) == sorted(map(tuple, codes.collect()))


def test_summaries_on_a_dense_matrix(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(0, 5, (12, 6)) * (rng.random((12, 6)) > 0.4)
    obs = spark.createDataFrame([(f"o{i}", "xyz"[i % 3] if i else None, "pq"[i % 2]) for i in range(12)], "obs_id string, cat string, cls string")
    for r in S.summarize_obs(coo(spark, m), obs, "cat", std=True).collect():
        rows = m[[i for i in range(1, 12) if "xyz"[i % 3] == r.cat], int(r.var_id[1:])]
        assert math.isclose(r.mean, rows.mean()) and math.isclose(r.std, rows.std(), abs_tol=1e-9)
    anti = S.membership(coo(spark, m), obs, "cls", anti=True)
    assert anti.groupBy("cls").agg(F.sum("value").alias("s")).where("cls = 'p'").first().s == m[1::2].sum()
    for r in S.entropy_by_class(coo(spark, m), obs.where("cat is not null"), "cls", "cat").collect():
        means = [m[[i for i in range(1, 12) if "xyz"[i % 3] == c and "pq"[i % 2] == r.cls], int(r.var_id[1:])].mean() for c in "xyz"]
        p = np.array([x for x in means if x]) / sum(means)
        assert math.isclose(r.entropy, -(p * np.log2(p)).sum(), abs_tol=1e-9) and math.isclose(r.prevalence, np.mean(means))


def test_clusterings(spark):
    x, df = blobs(spark)
    got = {r.id: r.cluster for r in U.kmeans(df, 3).collect()}
    assert len({(v, int(k[1:]) // 40) for k, v in got.items()}) == 3
    assert U.kmeans(df.limit(0), 3).count() == 0
    rng = np.random.default_rng(0)
    prof = [(f"f{i:02d}", c, float((5.0 if i % 3 == j else 0.3) + rng.random())) for i in range(30) for j, c in enumerate("abc")]
    p = spark.createDataFrame(prof, "var_id string, column string, value double")
    assert {r.var_id: r.cluster for r in U.cocluster_summaries(p).collect()} == {f"f{i:02d}": i % 3 for i in range(30)}
    k = {r.var_id: r.cluster for r in U.cluster_summaries(p, 3).collect()}
    assert len({(v, int(n[1:]) % 3) for n, v in k.items()}) == 3
    assert {r.cluster for r in U.cluster_summaries(p.where("var_id < 'f05'"), 3).collect()} == {0}


def test_active_subclusters(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("x", "a")], "src string, dst string")
    active = spark.createDataFrame([("g", c) for c in "abcdez"] + [("h", c) for c in "abx"], "var_id string, obs_id string")
    got = {tuple(r) for r in U.active_subclusters(active, edges, min_degree=1, min_active=2).collect()}
    assert got == {("g", c, "a") for c in "abc"} | {("h", c, "a") for c in "abx"}


def test_hmm_system(spark):
    rng = np.random.default_rng(1)
    rows = [("g", c, t, 0, float(rng.gamma(2, 1 + c))) for c in range(3) for t in range(20)]
    tensor = spark.createDataFrame(rows, "gene string, cell_type int, t int, modality int, value double")
    system = H.fit_hmm_system(tensor, H.create_hmm_system(2, ["gamma"], [(0,), (1, 2)]), max_iter=2)
    assert set(system) == {(0,), (1, 2)} and H.system_posteriors(tensor, system).count() == 60
    with pytest.raises(ValueError):
        H.create_hmm(2, ["normal"])


def test_settings(spark):
    before = Z.settings.n_jobs
    assert Z.set_defaults(n_jobs=3, debug=None).n_jobs == 3
    old = spark.conf.get("spark.sql.shuffle.partitions")
    assert Z.configure(spark).conf.get("spark.sql.shuffle.partitions") == "3"
    spark.conf.set("spark.sql.shuffle.partitions", old)
    Z.set_defaults(n_jobs=before)
    Z.set_verbosity_level("error_only")
    Z.set_verbosity_level("all")
    for bad in (lambda: Z.set_defaults(cores=1), lambda: Z.set_verbosity_level("loud")):
        with pytest.raises(ValueError):
            bad()
