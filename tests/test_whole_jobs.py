"""Queries work on everything their tables hold, not on a part of a fixed size."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.model import Assay
from assaylake.operators import community as C
from assaylake.operators import embedding as E
from assaylake.operators import hmm as H
from assaylake.operators import metadata as M
from assaylake.operators.parsing import failed_rows, valid_rows
from assaylake.plans.joins import hot_keys, join_hot
from assaylake.plans.scratch import Scratch, release, shared_folder
from assaylake.queries import analysis, assay
from assaylake.queries._adapt import points, supplier_brands, supplier_parts
from assaylake.sources.tables import table


@pytest.fixture(scope="module")
def linked(spark, data):
    """ids, labels and the brute-force neighbour graph of all embeddings."""
    rows = points(spark, data).orderBy("id").collect()
    x = np.array([r.vec for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.zeros(d.shape, bool)
    np.put_along_axis(near, np.argsort(d, axis=1, kind="stable")[:, :10], True, axis=1)
    return [r.id for r in rows], np.array([r.label for r in rows]), np.where(near | near.T, 1 / (1 + d), 0.0)


def test_graph_queries_take_every_embedding(spark, data, linked):
    ids, labels, w = linked
    assert {r.id for r in analysis.QUERIES["diffusion_map"](spark, data).collect()} == set(ids)
    edges = analysis.QUERIES["community_edges"](spark, data).collect()
    assert sum(r.n_edges for r in edges) == (w > 0).sum() // 2 and {c for r in edges for c in (r.ca, r.cb)} == set(labels.tolist())
    same = labels[:, None] == labels[None]
    share = w.sum(1) / w.sum()
    want = (w * same).sum() / w.sum() - (np.outer(share, share) * same).sum()
    assert abs(analysis.QUERIES["partition_modularity"](spark, data).first().modularity - want) < 1e-5
    q = w / w.sum(0)[:, None] / w.sum(0)
    t = q / np.sqrt(q.sum(0))[:, None] / np.sqrt(q.sum(0))
    got = analysis.QUERIES["diffusion_transitions"](spark, data).collect()
    at = {v: i for i, v in enumerate(ids)}
    assert len(got) == (w > 0).sum() and all(abs(t[at[r.src], at[r.dst]] - r.weight) < 1e-5 for r in got)
    assert {r.obs_id for r in analysis.QUERIES["landscape_coarse"](spark, data).collect()} == set(ids)


def test_every_supplier_is_smoothed(spark, data):
    wide = data.replace("sf0.001", "sf0.01")
    own = {(r.obs_id, r.var_id): 0.4 * r.value for r in supplier_brands(spark, wide).layer("qty").collect()}
    moved = {r.obs_id for r in analysis.QUERIES["knn_impute"](spark, wide).collect() if abs(own.get((r.obs_id, r.var_id), 0.0) - r.value) > 1e-5}
    assert moved == {o for o, _ in own} and len(moved) > 50


def test_rank_sums_of_every_part(spark, data):
    a = supplier_parts(spark, data)
    cells = {r.obs_id: r.region for r in a.obs.collect()}
    values = {}
    for r in a.layer("qty").collect():
        values.setdefault(r.var_id, {})[r.obs_id] = r.value
    got = {(r.var_id, r.region): r.rank_sum for r in analysis.QUERIES["sparse_rank_sums"](spark, data).collect()}
    assert {v for v, _ in got} == set(values)
    for (v, g), total in got.items():
        col = np.array([values[v].get(o, 0.0) for o in cells])
        rank = np.array([(col < c).sum() + ((col == c).sum() + 1) / 2 for c in col])
        assert total == rank[[x == g for x in cells.values()]].sum()


def test_eigenvectors_converge(spark, data, linked):
    ids, _, w = linked
    q = w / w.sum(0)[:, None] / w.sum(0)
    t = q / np.sqrt(q.sum(0))[:, None] / np.sqrt(q.sum(0))
    true = np.linalg.eigvalsh(t)
    true = np.sort(true[np.argsort(-abs(true))[:4]])[::-1]
    graph = analysis._neighbour_graph(spark, data)
    values, vectors = E.diffusion_map(graph, 4)
    v = np.array([r.vec for r in vectors.orderBy("id").collect()])
    assert np.allclose(values, true, atol=1e-9) and (np.linalg.norm(t @ v - v * values, axis=0) < 2e-6 * abs(values)).all()
    with pytest.raises(RuntimeError):
        E.diffusion_map(graph, 4, passes=2)


def test_posteriors_of_every_user(spark, data):
    events = table(spark, data, "events").where("value > 0")
    got = analysis.QUERIES["hmm_posteriors"](spark, data).select("gene", "cell_type").distinct()
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in events.select("event_type", "user_id").distinct().collect()}


def test_expectations_of_many_sequences():
    rng = np.random.default_rng(0)
    model, x = H.create_hmm(2, ["gamma", "exponential"], seed=1), rng.exponential(1, (7, 6, 2))
    x[rng.random(x.shape) < 0.2] = np.nan
    one = [H.forward_backward(model, s) for s in x]
    got = H._expectations(model, x)
    assert np.isclose(got[0], sum(ll for _, _, ll in one)) and np.allclose(got[1:3], sum(p[0] for p, _, _ in one)) and np.allclose(got[3:7], sum(xi for _, xi, _ in one).ravel())
    assert np.allclose(got[7:11], sum(p.T @ ~np.isnan(s) for (p, _, _), s in zip(one, x)).ravel())


def test_unfinished_rounds_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    with pytest.raises(RuntimeError):
        C.connected_components(spark.range(41), chain, max_rounds=3)
    # a staircase: every round peels one cell and one feature
    cells = [(f"o{i}", f"v{j}", 1.0) for i in range(8) for j in (i, i + 1)]
    coo = spark.createDataFrame(cells, "obs_id string, var_id string, value double")
    a = Assay(coo.select("obs_id").distinct(), coo.select("var_id").distinct(), {"x": coo})
    with pytest.raises(RuntimeError):
        M.filter_assay(a, ["x"], [1], [1], max_rounds=2)


@pytest.mark.parametrize("terminator", ["\r", "\n", "\x85", "\u2028"])
def test_quotes_behind_a_line_terminator(spark, terminator):
    lines = spark.createDataFrame([(1, f'chr1\t5\t9\ta{terminator}b"c\t1'), (2, f"chr1\t5\t9\ta{terminator}b\t1")], "line_id long, line string")
    genome = spark.createDataFrame([("chr1", 100)], "chr string, length long")
    assert [(r.line_id, r.reason) for r in failed_rows(lines, genome).collect()] == [(1, "quoting")]


def test_a_chromosome_without_a_length_is_unknown(spark):
    lines = spark.createDataFrame([(1, "chr1\t5\t9\ta\t1"), (2, "chr2\t5\t9\ta\t1")], "line_id long, line string")
    genome = spark.createDataFrame([("chr1", None), ("chr2", 50)], "chr string, length long")
    assert [(r.line_id, r.reason) for r in failed_rows(lines, genome).collect()] == [(1, "chr")]
    assert [r.line_id for r in valid_rows(lines, genome).collect()] == [2]


def test_links_of_every_line_item(spark, data):
    want = {(str(r.l_suppkey), str(r.l_partkey)) for r in table(spark, data, "lineitem").select("l_suppkey", "l_partkey").collect()}
    assert {(r.name, r.binname) for r in assay.QUERIES["regulatory_matrix"](spark, data).collect()} == want


def test_scratch_tables(spark, tmp_path):
    a, b = Scratch(spark, "t"), Scratch(spark, "t")
    kept = a.save(spark.range(5), "x")
    b.save(spark.range(5), "y")
    b.drop("y")
    assert kept.count() == 5
    assert release(spark) >= 2 and not Path(a.root.removeprefix("file:")).exists() and not Path(b.root.removeprefix("file:")).exists()


def test_a_cluster_must_name_its_folder():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "local-cluster[2,1,1024]", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(RuntimeError):
        shared_folder(Session())


def test_join_with_hot_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}") for i in range(600)] + [(999, None)], "i int, k string")
    side = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(40)], "k string, v int")
    hot = hot_keys(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], "n", 600, share=0.3)
    assert [r.k for r in hot.collect()] == ["hot"]
    for how in ("inner", "left", "left_semi"):
        got = join_hot(rows, side, ["k"], hot, spread=F.col("i"), how=how)
        want = rows.join(side, "k", how)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
