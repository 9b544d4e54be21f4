"""Principal components, spectral embeddings, diffusion maps, layouts.

Eigenproblems use blocks: all vectors are multiplied in one pass over the data
(as arrays), until the residuals are small, and the driver only sees matrices of
at most BASIS rows and columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.operators.layers import gram_weights, idf, l2_norm
from assaylake.operators.metadata import concat_features
from assaylake.plans.scratch import Scratch

PASSES = 300
OVERSAMPLE = 10
TOLERANCE = 1e-6
BASIS = 100


def _gaussians(key: Column, k: int, seed: int) -> Column:
    """k standard normals from a key, by Box-Muller on hashes: the same at any partitioning."""
    def u(i: int, salt: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(i), F.lit(salt)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))

    return F.array(*[F.sqrt(-2 * F.ln(u(i, 0))) * F.cos(F.lit(2 * np.pi) * u(i, 1)) for i in range(k)])


def _sum_arrays(c: str, k: int) -> Column:
    return F.array(*[F.sum(F.col(c)[i]) for i in range(k)])


def _scaled(w: Column, v: Column) -> Column:
    return F.transform(v, lambda x: x * w)


def _gram(df: DataFrame, a: str, b: str, k: int) -> np.ndarray:
    """The k x k matrix of inner products of two array columns; every task returns k^2 numbers."""

    def part(frames):
        g = np.zeros((k, k))
        for f in frames:
            if len(f):
                g += np.stack(f["_a"].to_numpy()).T @ np.stack(f["_b"].to_numpy())
        yield pd.DataFrame({"g": [g.ravel()]})

    parts = df.select(F.col(a).alias("_a"), F.col(b).alias("_b")).mapInPandas(part, "g array<double>")
    rows = parts.select(F.posexplode("g").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(k * k)
    out[[r.i for r in rows]] = [r.x for r in rows]
    return out.reshape(k, k)


def _rotate(v: Column, m: np.ndarray) -> Column:
    """v M for an array column and a small matrix."""

    @F.pandas_udf("array<double>")
    def times(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x.to_numpy()) @ m)) if len(x) else x

    return times(v)


def _orthonormal(g: np.ndarray) -> np.ndarray:
    """M such that the columns of V M are orthonormal, from g = V^T V; directions that vanish are left out."""
    size = np.sqrt(np.maximum(np.diag(g), 0))
    inverse = np.where(size > 0, 1 / np.where(size > 0, size, 1), 0)
    w, u = np.linalg.eigh(inverse[:, None] * (g + g.T) / 2 * inverse)
    keep = w > max(w.max(), 0) * 1e-12
    return inverse[:, None] * u[:, keep] / np.sqrt(w[keep])


def _eigenpairs(times: Callable[[DataFrame, int], DataFrame], start: DataFrame, key: str, width: int, k: int, tol: float, passes: int, scratch: Scratch) -> tuple[np.ndarray, DataFrame, np.ndarray]:
    """Eigenvalues of largest magnitude (descending by value), (key, vec) and the matrix that turns vec into the eigenvectors.

    ``times(block, width)`` multiplies the symmetric matrix by a block (key, vec).
    Each pass adds the residuals of the leading Ritz vectors to the basis (a block
    Krylov space), which falls back to these vectors when it would exceed BASIS.
    It ends when every residual |A v - l v| is at most ``tol`` |l| (or vanishes
    beside the largest eigenvalue); after ``passes`` passes without that it raises.
    """
    m = width
    basis = scratch.save(start.join(times(start, m).withColumnRenamed("vec", "image"), key), "basis0")
    for i in range(1, passes + 1):
        g = _gram(basis.select(F.concat("vec", "image").alias("both")), "both", "both", 2 * m)
        white = _orthonormal(g[:m, :m])
        t = white.T @ g[:m, m:] @ white
        values, y = np.linalg.eigh((t + t.T) / 2)
        lead = np.argsort(-np.abs(values), kind="stable")[:width]
        values, y = values[lead], white @ y[:, lead]
        residual = np.concatenate([-y * values, y])
        r = scratch.save(basis.select(key, "vec", "image", _rotate(F.concat("vec", "image"), residual).alias("residual")), f"residual{i}")
        own = _gram(r, "residual", "residual", len(lead))
        top = np.abs(values).max()
        norms = np.sqrt(np.maximum(np.diag(own), 0))[:k]
        if (norms <= np.maximum(tol * np.abs(values[:k]), 1e-12 * top)).all():
            order = np.argsort(-values[:k], kind="stable")
            return values[:k][order], basis, y[:, :k][:, order]
        if i == passes:
            break
        new = _orthonormal(own)
        block = r.select(key, _rotate(F.col("residual"), new).alias("vec"))
        more = new.shape[1]
        image = scratch.save(block.join(times(block, more).withColumnRenamed("vec", "image"), key), f"image{i}").select(key, F.col("vec").alias("_v"), F.col("image").alias("_i"))
        old = r.select(key, "vec", "image")
        if m + more > max(BASIS, 2 * width):
            old = old.select(key, _rotate(F.col("vec"), y).alias("vec"), _rotate(F.col("image"), y).alias("image"))
            m = len(lead)
        basis = scratch.save(old.join(image, key).select(key, F.concat("vec", "_v").alias("vec"), F.concat("image", "_i").alias("image")), f"basis{i}")
        m += more
        for name in (f"basis{i - 1}", f"residual{i}", f"image{i}"):
            scratch.drop(name)
    raise RuntimeError(f"no convergence in {passes} passes: residuals {norms.max():.1e}, eigenvalues {values[:k]}")


def top_eigenpairs(entries: DataFrame, nodes: DataFrame, k: int, *, seed: int = 0, passes: int = PASSES, tol: float = TOLERANCE, scratch: Scratch | None = None) -> tuple[np.ndarray, DataFrame]:
    """Eigenvalues of largest magnitude (descending by value) and (id, vec) of a sparse symmetric matrix (src, dst, weight).

    To a residual of ``tol`` times the eigenvalue; not reaching it in ``passes``
    passes is an error. Signs are free.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "eigen")
    p = k + OVERSAMPLE
    a = scratch.save(entries.select("src", "dst", "weight"), "matrix")
    block = scratch.save(nodes.select("id", _gaussians(F.col("id"), p, seed).alias("vec")), "block0")
    ids = block.select("id")

    def times(b: DataFrame, n: int) -> DataFrame:
        prod = a.join(b.withColumnRenamed("id", "dst"), "dst").select("src", _scaled(F.col("weight"), F.col("vec")).alias("v")).groupBy("src").agg(_sum_arrays("v", n).alias("v"))
        return ids.join(prod, ids["id"] == prod["src"], "left").select("id", F.coalesce("v", F.array(*[F.lit(0.0)] * n)).alias("vec"))

    values, vectors, m = _eigenpairs(times, block, "id", p, k, tol, passes, scratch)
    return values, vectors.select("id", _rotate(F.col("vec"), m).alias("vec"))


def spectral(coo: DataFrame, k: int = 25, *, weighted_by_sd: bool = True, seed: int = 0, skip_idf: bool = False, passes: int = PASSES, tol: float = TOLERANCE) -> tuple[np.ndarray, DataFrame]:
    """Top eigenpairs of the normalised cosine graph of the cells, without its loops: (eigenvalues, (obs_id, vec)).

    With X the L2 norm of the idf of the counts, the operator is
    v -> D^-1/2 X (Xt D^-1/2 v) - D^-1 v with d = X (Xt 1) - 1; no cell x cell matrix
    appears. Vectors are scaled by the square root of their eigenvalue (negative
    ones count as 0). Cells with d < 1e-4 are isolated and an error.
    """
    n = coo.agg(F.count_distinct("obs_id").cast("double")).scalar()
    scratch = Scratch(coo.sparkSession, "spectral")
    x = scratch.save(l2_norm(coo if skip_idf else idf(coo, n)).where("value <> 0"), "x")
    return _spectral_solve(x, k, weighted_by_sd, seed, passes, tol, scratch)


def _spectral_solve(x: DataFrame, k: int, weighted: bool, seed: int, passes: int, tol: float, scratch: Scratch) -> tuple[np.ndarray, DataFrame]:
    p = k + OVERSAMPLE
    column = x.groupBy("var_id").agg(F.sum("value").alias("_c"))
    d = scratch.save(x.join(column, "var_id").groupBy("obs_id").agg((F.sum(F.col("value") * F.col("_c")) - F.sum(F.col("value") * F.col("value"))).alias("d"), F.sum(F.col("value") * F.col("value")).alias("s")), "degree")
    bad = d.where("d < 1e-4").count()
    if bad:
        raise ValueError(f"{bad} cells share nothing with any other")
    y = scratch.save(x.join(d, "obs_id").select("obs_id", "var_id", (F.col("value") / F.sqrt("d")).alias("value")), "y")
    block = scratch.save(d.select("obs_id", _gaussians(F.col("obs_id"), p, seed).alias("vec")), "block0")

    def times(b: DataFrame, n: int) -> DataFrame:
        inner = y.join(b, "obs_id").select("var_id", _scaled(F.col("value"), F.col("vec")).alias("v")).groupBy("var_id").agg(_sum_arrays("v", n).alias("u"))
        outer = y.join(inner, "var_id").select("obs_id", _scaled(F.col("value"), F.col("u")).alias("v")).groupBy("obs_id").agg(_sum_arrays("v", n).alias("v"))
        own = b.join(d, "obs_id").join(outer, "obs_id")
        return own.select("obs_id", F.zip_with("v", _scaled(F.col("s") / F.col("d"), F.col("vec")), lambda a, c: a - c).alias("vec"))

    values, vectors, m = _eigenpairs(times, block, "obs_id", p, k, tol, passes, scratch)
    scale = np.sqrt(np.maximum(values, 0)) if weighted else np.ones(len(values))
    return values, vectors.select("obs_id", _rotate(F.col("vec"), m * scale).alias("vec"))


def multiview_spectral(layers: dict[str, DataFrame], k: int = 25, *, layer_weights: dict[str, float] | None = None, sample: DataFrame | None = None, seed: int = 0, skip_idf: bool = False, passes: int = PASSES, tol: float = TOLERANCE) -> tuple[np.ndarray, DataFrame]:
    """Spectral embedding of several layers side by side, each scaled by sqrt(weight / sum of weights)."""
    given = layer_weights or {}
    x = {}
    for name, coo in layers.items():
        n = coo.agg(F.count_distinct("obs_id").cast("double")).scalar()
        x[name] = l2_norm(coo if skip_idf else idf(coo, n)).where("value <> 0")
    raw = {r.layer: r.weight * given.get(r.layer, 1.0) for r in gram_weights(x, sample).collect()}  # one row a layer
    total = sum(raw.values())
    scaled = {name: coo.withColumn("value", F.col("value") * float(np.sqrt(raw[name] / total))) for name, coo in x.items()}
    scratch = Scratch(next(iter(layers.values())).sparkSession, "multiview")
    return _spectral_solve(scratch.save(concat_features(scaled), "x"), k, True, seed, passes, tol, scratch)


def pca(embedding: DataFrame, k: int = 30, *, vec: str = "vec") -> tuple[np.ndarray, DataFrame]:
    """(explained variance ratios, (obs_id, vec)) of dense vectors; d x d moments in one pass, centred scores.

    The moments are summed inside Arrow batches, so one row of d^2 + d + 1 numbers
    a task is all that is shuffled.
    """
    d = embedding.select(F.size(vec).alias("n")).first()
    if d is None:
        return np.zeros(0), embedding.select("obs_id", vec)
    d = d.n

    def moments(frames):
        n, s, q = 0, np.zeros(d), np.zeros((d, d))
        for f in frames:
            if len(f):
                x = np.stack(f["v"].to_numpy()).astype(float)
                n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        yield pd.DataFrame({"m": [np.concatenate([[n], s, q.ravel()])]})

    parts = embedding.select(F.col(vec).cast("array<double>").alias("v")).mapInPandas(moments, "m array<double>")
    summed = parts.select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    m = np.array([r.x for r in summed.orderBy("i").collect()])  # d^2 + d + 1 numbers
    n, mean = m[0], m[1 : d + 1] / m[0]
    cov = (m[d + 1 :].reshape(d, d) - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    load = vectors[:, order]
    load = load * np.sign(load[np.abs(load).argmax(0), np.arange(len(order))])
    shift = mean @ load

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_numpy()).astype(float) @ load - shift)) if len(v) else v

    return values[order] / values.sum(), embedding.select("obs_id", project(vec).alias("vec"))


def diffusion_transitions(graph: DataFrame) -> DataFrame:
    """(src, dst, weight): T = Z^-1 K Z^-1 with K = W / (q q') and z the square root of K's column sums."""
    q = graph.groupBy("dst").agg(F.sum("weight").alias("q"))
    k = graph.join(q.select(F.col("dst").alias("src"), F.col("q").alias("qs")), "src").join(q.withColumnRenamed("q", "qd"), "dst").select("src", "dst", (F.col("weight") / F.col("qs") / F.col("qd")).alias("weight"))
    z = k.groupBy("dst").agg(F.sqrt(F.sum("weight")).alias("z"))
    return k.join(z.select(F.col("dst").alias("src"), F.col("z").alias("zs")), "src").join(z.withColumnRenamed("z", "zd"), "dst").select("src", "dst", (F.col("weight") / F.col("zs") / F.col("zd")).alias("weight"))


def diffusion_map(graph: DataFrame, n_comps: int = 15, *, seed: int = 0, passes: int = PASSES, tol: float = TOLERANCE) -> tuple[np.ndarray, DataFrame]:
    nodes = graph.select(F.col("src").alias("id")).union(graph.select("dst")).distinct()
    return top_eigenpairs(diffusion_transitions(graph), nodes, n_comps, seed=seed, passes=passes, tol=tol)


def diffusion_pseudotime(basis: DataFrame, eigenvalues: list[float], root: str) -> DataFrame:
    """(id, pseudotime): distance from the root in the weighted diffusion basis, divided by the largest.

    Components with an eigenvalue below .9994 have weight (l / (1 - l))^2, others 1.
    """
    w = F.array(*[F.lit(float((v / (1 - v)) ** 2 if v < 0.9994 else 1.0)) for v in eigenvalues])
    origin = basis.where(F.col("id") == root).agg(F.first("vec")).scalar()
    gap = F.zip_with("vec", "_origin", lambda a, b: (a - b) * (a - b))
    raw = basis.withColumn("_origin", origin).select("id", F.sqrt(F.aggregate(F.zip_with(gap, w, lambda g, x: g * x), F.lit(0.0), lambda s, x: s + x)).alias("_d"))
    return raw.select("id", F.try_divide("_d", raw.agg(F.max("_d")).scalar()).alias("pseudotime"))


def coarse_landscape(edges: DataFrame, cells: DataFrame, leaves: DataFrame) -> DataFrame:
    """(obs_id, x, y): communities placed by their links to scaffold leaves, y = -time.

    ``edges`` (src, dst), both ends count; ``cells`` (obs_id, community, time);
    ``leaves`` (obs_id, position), positions in [0, 1]. x is the mean position of
    the scaffold cells opposite to a community's cells, 0 without any.
    """
    ends = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    member = cells.select(F.col("obs_id").alias("a"), "community")
    leaf = leaves.select(F.col("obs_id").alias("b"), "position")
    x = ends.join(member, "a").join(leaf, "b").groupBy("community").agg(F.avg("position").alias("x"))
    return cells.join(x, "community", "left").select("obs_id", F.coalesce("x", F.lit(0.0)).alias("x"), (-F.col("time")).alias("y"))


def dendrogram_layout(cells: DataFrame, order: DataFrame, *, seed: int = 0) -> DataFrame:
    """(obs_id, vec): x = (leaf position + jitter in [0, 0.8)) / leaves * 100, y = time scaled to 0..100."""
    u = (F.shiftrightunsigned(F.xxhash64("obs_id", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    k = order.agg(F.count(F.lit(1))).scalar()
    low, high = cells.agg(F.min("time")).scalar(), cells.agg(F.max("time")).scalar()
    y = F.coalesce(F.try_divide(F.col("time") - low, high - low), F.lit(0.0)) * 100
    return cells.join(order, "community").select("obs_id", F.array((F.col("position") + u * 0.8) / k * 100, y).alias("vec"))


def umap_layout(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, start: np.ndarray, *, epochs: int = 200, seed: int = 0, a: float = 1.577, b: float = 0.895, rate: float = 1.0, negatives: int = 5, fixed_y: np.ndarray | None = None) -> np.ndarray:
    """Attraction along edges and repulsion from random nodes, vectorised per epoch."""
    rng = np.random.default_rng(seed)
    y = start.astype(float).copy()
    chance = weight / weight.max()
    for e in range(epochs):
        step = rate * (1 - e / epochs)
        on = rng.random(len(src)) < chance
        i, j = src[on], dst[on]
        delta = y[i] - y[j]
        d2 = (delta**2).sum(1)
        pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b), 0.0)[:, None] * delta
        pull = np.clip(pull, -4, 4) * step
        np.add.at(y, i, pull)
        np.add.at(y, j, -pull)
        i = np.repeat(i, negatives)
        j = rng.integers(0, n, len(i))
        delta = y[i] - y[j]
        d2 = (delta**2).sum(1)
        push = (2 * b / ((0.001 + d2) * (1 + a * d2**b)))[:, None] * delta
        np.add.at(y, i, np.clip(push, -4, 4) * step)
        if fixed_y is not None:
            y[:, 1] = fixed_y
    return y


def umap(graph: DataFrame, start: DataFrame, *, epochs: int = 200, seed: int = 0, limit: int = 50_000_000, force_y: DataFrame | None = None) -> DataFrame:
    """(id, vec): a two-dimensional layout of a fuzzy graph (src, dst, weight) from a start (id, vec).

    The layout moves all nodes together and runs in one task; a graph of more
    than ``limit`` edges is refused. ``force_y`` (id, y) pins the second coordinate.
    """
    if graph.count() > limit:
        raise ValueError(f"more than {limit} edges")
    pinned = start.select("id", "vec", F.lit(None).cast("double").alias("y")) if force_y is None else start.join(force_y, "id").select("id", "vec", "y")
    kind = start.schema["id"].dataType.simpleString()

    def solve(key, nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("id")
        ids = nodes["id"].to_numpy()
        edges = edges[edges["src"].isin(ids) & edges["dst"].isin(ids)].sort_values(["src", "dst"])
        y0 = np.stack(nodes["vec"].to_numpy()).astype(float)[:, :2]
        fixed = nodes["y"].to_numpy(float) if nodes["y"].notna().all() else None
        y = umap_layout(len(ids), np.searchsorted(ids, edges["src"]), np.searchsorted(ids, edges["dst"]), edges["weight"].to_numpy(float), y0, epochs=epochs, seed=seed, fixed_y=fixed)
        return pd.DataFrame({"id": ids, "vec": list(y)})

    one = lambda df: df.withColumn("_g", F.lit(0)).groupBy("_g")
    return one(pinned).cogroup(one(graph.select("src", "dst", "weight"))).applyInPandas(solve, f"id {kind}, vec array<double>")


def scaffold(memberships: DataFrame, order: DataFrame) -> DataFrame:
    """(obs_id, leaf, position): cells of each leaf community, positions scaled to [0, 1] by the last leaf."""
    top = order.agg(F.max("position").cast("double")).scalar()
    return memberships.join(order, "community").select("obs_id", F.col("community").alias("leaf"), F.coalesce(F.try_divide(F.col("position").cast("double"), top), F.lit(0.0)).alias("position"))


def time_per_cluster(df: DataFrame, time: str, group: str) -> DataFrame:
    """Each group's times shifted to 0, divided by their maximum and stretched to the overall range.

    A maximum below 4e-5 counts as 1. Rows with a null time keep it.
    """
    g = df.groupBy(group).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    span = F.when(F.col("_hi") - F.col("_lo") < 4e-5, F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo"))
    low, high = df.agg(F.min(time)).scalar(), df.agg(F.max(time)).scalar()
    joined = df.join(g, df[group].eqNullSafe(g[group]), "left").drop(g[group])
    return joined.withColumn("normalized_time", (F.col(time) - F.col("_lo")) / span * (high - low) + low).drop("_lo", "_hi")

