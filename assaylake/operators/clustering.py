"""k-means, co-clustering of summary profiles, and sub-clusters of active cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.operators.community import connected_components
from assaylake.operators.embedding import pca

#: Profiles (features x categories) are clustered in one task up to so many numbers.
PROFILE_NUMBERS = 20_000_000


def kmeans(embedding: DataFrame, n_clusters: int, *, seed: int = 0, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """(id, cluster): k-means in MLlib, seeded. Fewer rows than clusters give fewer clusters."""
    rows = embedding.where(F.col(vec).isNotNull()).select(id_col, array_to_vector(vec).alias("features"))
    if rows.limit(1).count() == 0:
        return embedding.select(id_col, F.lit(None).cast("int").alias("cluster")).limit(0)
    return KMeans(k=n_clusters, seed=seed).fit(rows).transform(rows).select(id_col, F.col("prediction").alias("cluster"))


def _wide(profiles: DataFrame) -> tuple[list, DataFrame]:
    """The columns of (var_id, column, value) in order, and (var_id, vec) with zeros filled in."""
    columns = [r[0] for r in profiles.select("column").distinct().orderBy("column").collect()]  # categories, a few
    cells = F.map_from_entries(F.collect_list(F.struct("column", "value")))
    vec = F.transform(F.array(*[F.lit(c) for c in columns]), lambda c: F.coalesce(F.try_element_at(F.col("_m"), c), F.lit(0.0)))
    return columns, profiles.groupBy("var_id").agg(cells.alias("_m")).select("var_id", vec.alias("vec"))


def cluster_summaries(profiles: DataFrame, n_clusters: int = 3, *, log_transform: bool = False, n_components: int = 2, seed: int = 0) -> DataFrame:
    """(var_id, cluster): k-means on the first principal components of features' mean profiles.

    ``profiles`` is (var_id, column, value). Fewer than ten features are all of cluster 0.
    """
    rows = profiles.withColumn("value", F.log1p(100 * F.col("value"))) if log_transform else profiles
    columns, wide = _wide(rows)
    if wide.limit(10).count() < 10:
        return wide.select("var_id", F.lit(0).alias("cluster"))
    _, low = pca(wide.withColumnRenamed("var_id", "obs_id"), min(n_components, len(columns)))
    return kmeans(low, n_clusters, seed=seed, id_col="obs_id").withColumnRenamed("obs_id", "var_id")


def cocluster(x: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Row and column clusters of a non-negative matrix from the singular vectors of its normalised form."""
    r, c = np.maximum(x.sum(1), 1e-12), np.maximum(x.sum(0), 1e-12)
    u, _, vt = np.linalg.svd(x / np.sqrt(r)[:, None] / np.sqrt(c), full_matrices=False)
    m = 1 + int(np.ceil(np.log2(max(k, 2))))
    z = np.vstack([u[:, 1:m] / np.sqrt(r)[:, None], vt[1:m].T / np.sqrt(c)[:, None]])
    label = _lloyd(z, k, seed)
    return label[: len(x)], label[len(x) :]


def _lloyd(z: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng, best = np.random.default_rng(seed), None
    for _ in range(10):
        centre = z[rng.integers(len(z))][None]
        while len(centre) < k:  # spread-out starts
            d = ((z[:, None] - centre[None]) ** 2).sum(2).min(1)
            centre = np.vstack([centre, z[rng.choice(len(z), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(z))]])
        for _ in range(100):
            d = ((z[:, None] - centre[None]) ** 2).sum(2)
            label = d.argmin(1)
            new = np.array([z[label == i].mean(0) if (label == i).any() else centre[i] for i in range(k)])
            if np.allclose(new, centre):
                break
            centre = new
        cost = d.min(1).sum()
        if best is None or cost < best[0] - 1e-12:
            best = (cost, label)
    return best[1]


def cocluster_summaries(profiles: DataFrame, *, log_transform: bool = False, seed: int = 0) -> DataFrame:
    """(var_id, cluster): features co-clustered with the categories, the cluster numbered by its category's place."""
    rows = profiles.withColumn("value", F.log1p(100 * F.col("value"))) if log_transform else profiles
    columns, wide = _wide(rows)
    if wide.count() * max(len(columns), 1) > PROFILE_NUMBERS:
        raise ValueError(f"more than {PROFILE_NUMBERS} numbers")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("var_id")
        r, c = cocluster(np.stack(pdf["vec"].to_numpy()), len(columns), seed)
        place = np.argsort(c, kind="stable")
        return pd.DataFrame({"var_id": pdf["var_id"].to_numpy(), "cluster": place[r].astype("int32")})

    return wide.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(run, "var_id string, cluster int")


def active_subclusters(active: DataFrame, edges: DataFrame, *, min_degree: int, min_active: int, cells_per_cluster: int | None = None) -> DataFrame:
    """(var_id, obs_id, cluster): for every feature at once, the connected groups of its active core cells.

    A core cell has at least ``min_degree`` active neighbours; groups of no more
    than ``min_active`` cells are dropped. Nodes are (feature, cell) pairs, so one
    run of connected components serves all features. With ``cells_per_cluster`` a
    group is cut further, by a hash of the cell, into parts of about that size.
    """
    a, b = active.select("var_id", F.col("obs_id").alias("src")), active.select("var_id", F.col("obs_id").alias("dst"))
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    inner = both.join(a, "src").join(b, ["var_id", "dst"])
    core = inner.groupBy("var_id", "src").agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") >= min_degree).select("var_id", "src")
    links = inner.join(core, ["var_id", "src"], "left_semi").join(core.withColumnRenamed("src", "dst"), ["var_id", "dst"], "left_semi")
    node = lambda c: F.concat_ws("\x1f", "var_id", c)
    nodes = core.select(node("src").alias("id"), "var_id", F.col("src").alias("obs_id"))
    parts = connected_components(nodes.select("id"), links.select(node("src").alias("src"), node("dst").alias("dst")))
    rows = nodes.join(parts, "id")
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_active)
    kept = rows.join(sizes, "component")
    name = F.element_at(F.split("component", "\x1f"), 2)
    if cells_per_cluster:
        k = F.greatest(F.floor(F.col("_n") / cells_per_cluster), F.lit(1))
        name = F.concat_ws("/", name, F.pmod(F.xxhash64("obs_id"), k).cast("string"))
    return kept.select("var_id", "obs_id", name.alias("cluster"))
