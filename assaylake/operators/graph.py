"""Neighbour graphs, label transfer and imputation.

Exact searches compare a stated query set with all rows in blocks: the base is cut
into blocks, each query looks at each block in turn inside an Arrow function and
keeps only its k best, so the shuffle holds k rows per query and block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

BLOCK_ROWS = 8_192
METRICS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {}


def _metric(f: Callable) -> Callable:
    METRICS[f.__name__.strip("_")] = f
    return f


@_metric
def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(sqeuclidean(a, b))


@_metric
def sqeuclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d = a[:, i, None] - b[None, :, i]
        out += d * d
    return out


@_metric
def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum((np.abs(a[:, i, None] - b[None, :, i]) for i in range(a.shape[1])), np.zeros((len(a), len(b))))


@_metric
def chebyshev(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        np.maximum(out, np.abs(a[:, i, None] - b[None, :, i]), out=out)
    return out


@_metric
def canberra(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        x, y = a[:, i, None], b[None, :, i]
        den = np.abs(x) + np.abs(y)
        out += np.divide(np.abs(x - y), den, out=np.zeros_like(den), where=den > 0)
    return out


@_metric
def braycurtis(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    num, den = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        num += np.abs(a[:, i, None] - b[None, :, i])
        den += np.abs(a[:, i, None] + b[None, :, i])
    return np.divide(num, den, out=np.zeros_like(num), where=den > 0)


@_metric
def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    return 1 - (a @ b.T) / np.maximum(np.outer(na, nb), 1e-300)


@_metric
def correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return cosine(a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True))


@_metric
def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum(((a[:, i, None] != b[None, :, i]).astype(float) for i in range(a.shape[1])), np.zeros((len(a), len(b)))) / a.shape[1]


def _counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    x, y = a != 0, b != 0
    tt = x.astype(float) @ y.astype(float).T
    tf, ft = x.sum(1)[:, None] - tt, y.sum(1)[None, :] - tt
    return tt, tf, ft, a.shape[1] - tt - tf - ft


def _ratio(num: np.ndarray, den: np.ndarray) -> np.ndarray:
    return np.divide(num, den, out=np.zeros_like(num, dtype=float), where=den != 0)


METRICS |= {
    "jaccard": lambda a, b: (lambda tt, tf, ft, ff: _ratio(tf + ft, tt + tf + ft))(*_counts(a, b)),
    "dice": lambda a, b: (lambda tt, tf, ft, ff: _ratio(tf + ft, 2 * tt + tf + ft))(*_counts(a, b)),
    "matching": lambda a, b: (lambda tt, tf, ft, ff: (tf + ft) / a.shape[1])(*_counts(a, b)),
    "russellrao": lambda a, b: (lambda tt, tf, ft, ff: (a.shape[1] - tt) / a.shape[1])(*_counts(a, b)),
    "rogerstanimoto": lambda a, b: (lambda tt, tf, ft, ff: _ratio(2 * (tf + ft), tt + ff + 2 * (tf + ft)))(*_counts(a, b)),
    "sokalmichener": lambda a, b: (lambda tt, tf, ft, ff: _ratio(2 * (tf + ft), tt + ff + 2 * (tf + ft)))(*_counts(a, b)),
    "sokalsneath": lambda a, b: (lambda tt, tf, ft, ff: _ratio(tf + ft, 0.5 * tt + tf + ft))(*_counts(a, b)),
    "kulsinski": lambda a, b: (lambda tt, tf, ft, ff: _ratio(tf + ft - tt + a.shape[1], tf + ft + a.shape[1]))(*_counts(a, b)),
    "yule": lambda a, b: (lambda tt, tf, ft, ff: _ratio(2 * tf * ft, tt * ff + tf * ft))(*_counts(a, b)),
    "cityblock": manhattan, "l1": manhattan, "l2": euclidean,
}


def metric(name: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    if name.startswith("minkowski:"):
        p = float(name.split(":")[1])
        return lambda a, b: sum((np.abs(a[:, i, None] - b[None, :, i]) ** p for i in range(a.shape[1])), np.zeros((len(a), len(b)))) ** (1 / p)
    if name not in METRICS:
        raise ValueError(f"metric is one of {sorted(METRICS)} or minkowski:p")
    return METRICS[name]


def _compare(queries: DataFrame, base: DataFrame, block_rows: int, keep: Callable, schema: str) -> DataFrame:
    """Runs ``keep`` on every (query block, base block)."""
    spark = base.sparkSession
    n_b = max(1, -(-base.count() // block_rows))
    n_q = max(1, -(-queries.count() // block_rows))
    b = base.select(F.col("id").alias("b_id"), F.col("vec").alias("b_vec"), F.pmod(F.xxhash64("id"), F.lit(n_b)).alias("_b"))
    q = queries.select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"), F.pmod(F.xxhash64("id"), F.lit(n_q)).alias("_q"))
    b = b.withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))))
    q = q.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_b - 1).cast("long"))))
    assert spark is not None
    return q.groupBy("_q", "_b").cogroup(b.groupBy("_q", "_b")).applyInPandas(keep, schema)


def knn_exact(queries: DataFrame, base: DataFrame, k: int, *, metric_name: str = "euclidean", skip_self: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(src, dst, distance, rank): the ``k`` nearest rows of ``base`` for each query, ties by id.

    Both are (id, vec) with vectors of one length. With ``skip_self`` a row isn't
    its own neighbour.
    """
    dist = metric(metric_name)

    def nearest(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame(columns=["src", "dst", "distance"], dtype=object)
        b = b.sort_values("b_id", kind="stable")
        y, ids = np.stack(b["b_vec"].to_numpy()).astype(float), b["b_id"].to_numpy()
        x, src = np.stack(q["q_vec"].to_numpy()).astype(float), q["q_id"].to_numpy()
        out = []
        for i in range(0, len(x), 256):
            d = dist(x[i : i + 256], y)
            if skip_self:
                d[src[i : i + 256, None] == ids[None, :]] = np.inf
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            near = np.take_along_axis(d, order, axis=1)
            row, _ = np.nonzero(np.isfinite(near))
            fine = np.isfinite(near)
            out.append(pd.DataFrame({"src": src[i + row], "dst": ids[order[fine]], "distance": near[fine]}))
        return pd.concat(out)

    kind = base.schema["id"].dataType.simpleString()
    hits = _compare(queries, base, block_rows, nearest, f"src {kind}, dst {kind}, distance double")
    w = Window.partitionBy("src").orderBy("distance", "dst")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def radius_graph(points: DataFrame, epsilon: float, *, metric_name: str = "euclidean", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(src, dst, distance) of all pairs at 0 < distance <= epsilon, both directions."""
    dist = metric(metric_name)

    def near(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame(columns=["src", "dst", "distance"], dtype=object)
        y, ids = np.stack(b["b_vec"].to_numpy()).astype(float), b["b_id"].to_numpy()
        x, src = np.stack(q["q_vec"].to_numpy()).astype(float), q["q_id"].to_numpy()
        out = []
        for i in range(0, len(x), 256):
            d = dist(x[i : i + 256], y)
            row, col = np.nonzero((d <= epsilon) & (d > 0))
            out.append(pd.DataFrame({"src": src[i + row], "dst": ids[col], "distance": d[row, col]}))
        return pd.concat(out)

    kind = points.schema["id"].dataType.simpleString()
    return _compare(points, points, block_rows, near, f"src {kind}, dst {kind}, distance double").where("src <> dst")


@F.pandas_udf(ArrayType(DoubleType()))
def _strengths(distances: pd.Series) -> pd.Series:
    """Membership strengths of rows of distances; the bisections of a batch run side by side."""
    rows = [np.asarray(d, float) for d in distances]
    if not rows:
        return pd.Series([], dtype=object)
    n = np.array([len(d) for d in rows])
    m = np.full((len(rows), max(n.max(), 1)), np.nan)
    for row, d in zip(m, rows):
        row[: len(d)] = d
    known = ~np.isnan(m)
    rho = np.where(known & (m > 0), m, np.inf).min(axis=1)
    rho[~np.isfinite(rho)] = 0.0
    over = np.where(known, np.maximum(m - rho[:, None], 0.0), 0.0)
    target = np.log2(np.maximum(n + 1, 2))
    low, high, mid, open_ = np.zeros(len(rows)), np.full(len(rows), np.inf), np.ones(len(rows)), np.ones(len(rows), bool)
    for _ in range(64):
        s = np.where(known, np.exp(-over / mid[:, None]), 0.0).sum(axis=1)
        open_ &= np.abs(s - target) >= 1e-5
        if not open_.any():
            break
        up, down = open_ & (s > target), open_ & (s <= target)
        high[up], low[down] = mid[up], mid[down]
        mid = np.where(up, (low + high) / 2, np.where(down, np.where(np.isinf(high), mid * 2, (low + np.where(np.isinf(high), 0.0, high)) / 2), mid))
    average = np.where(known, m, 0.0).sum(axis=1) / np.maximum(n, 1)
    mid = np.maximum(np.maximum(mid, 1e-3 * average), 1e-12)
    w = np.exp(-over / mid[:, None])
    return pd.Series([row[:k] for row, k in zip(w, n)])


def fuzzy_simplicial_set(neighbours: DataFrame) -> DataFrame:
    """(src, dst, weight): symmetric membership strengths a + b - ab of a neighbour table.

    Per row, rho is the nearest non-zero distance and sigma is found by bisection
    so that the strengths sum to log2 k.
    """

    near = neighbours.groupBy("src").agg(F.collect_list(F.struct("dst", "distance")).alias("_n"))  # k rows a source
    one = near.withColumn("_w", _strengths("_n.distance")).select("src", F.inline(F.arrays_zip(F.col("_n.dst").alias("dst"), F.col("_w").alias("weight"))))
    both = one.select("src", "dst", F.col("weight").alias("w")).unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("w")))
    # a pair has one or two strengths; a + b - ab = 1 - (1 - a)(1 - b)
    return both.groupBy("src", "dst").agg(F.sum("w").alias("_s"), F.max("w").alias("_a"), F.count(F.lit(1)).alias("_c")).select("src", "dst", F.when(F.col("_c") == 1, F.col("_a")).otherwise(F.col("_s") - F.col("_a") * (F.col("_s") - F.col("_a"))).alias("weight"))


def undirected(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """(src, dst, weight) with src < dst, the larger of both directions, loops dropped."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max(weight).alias(weight))


def equal_degrees(edges: DataFrame) -> DataFrame:
    """One row (equal BOOLEAN): whether all sources have the same number of neighbours."""
    d = edges.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    return d.agg((F.min("d") == F.max("d")).alias("equal"))


def knn_impute(graph: DataFrame, coo: DataFrame, *, strength: float = 0.6, density: bool = True, normalize: bool = True) -> DataFrame:
    """(obs_id, var_id, value): strength * (A X) + (1 - strength) * X.

    A is the graph with weights divided by the column sums of both ends (or by the
    largest weight). X is scaled to row sums of 1000 in the first term only.
    """
    if density:
        q = graph.groupBy("dst").agg(F.sum("weight").alias("_q"))
        a = graph.join(q.select(F.col("dst").alias("src"), F.col("_q").alias("_qs")), "src").join(q.withColumnRenamed("_q", "_qd"), "dst").select("src", "dst", (F.col("weight") / F.col("_qs") / F.col("_qd")).alias("_w"))
    else:
        a = graph.select("src", "dst", (F.col("weight") / graph.agg(F.max("weight")).scalar()).alias("_w"))
    x = coo
    if normalize:
        s = coo.groupBy("obs_id").agg(F.sum("value").alias("_s"))
        x = coo.join(s, "obs_id").select("obs_id", "var_id", F.coalesce(F.try_divide(1000 * F.col("value"), F.col("_s")), F.lit(0.0)).alias("value"))
    smoothed = a.join(x.withColumnRenamed("obs_id", "dst"), "dst").select(F.col("src").alias("obs_id"), "var_id", (F.col("_w") * F.col("value") * strength).alias("value"))
    own = coo.select("obs_id", "var_id", (F.col("value") * (1 - strength)).alias("value"))
    return smoothed.unionByName(own).groupBy("obs_id", "var_id").agg(F.sum("value").alias("value"))


def _weights(weights: str) -> Column:
    """Inverse distances; if a query meets a training row exactly, only such rows count."""
    if weights == "uniform":
        return F.lit(1.0)
    exact = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("src"))
    return F.when(exact == 1, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))


def knn_regress(neighbours: DataFrame, targets: DataFrame, *, weights: str = "distance") -> DataFrame:
    """(src, predicted): weighted mean of the neighbours' values; ``targets`` is (id, value)."""
    rows = neighbours.withColumn("_w", _weights(weights)).join(targets.select(F.col("id").alias("dst"), "value"), "dst")
    return rows.groupBy("src").agg((F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("predicted"))


def knn_regress_layer(neighbours: DataFrame, coo: DataFrame, *, weights: str = "distance") -> DataFrame:
    """(obs_id, var_id, value): weighted means of all features of a training layer."""
    w = neighbours.withColumn("_w", _weights(weights))
    total = w.groupBy("src").agg(F.sum("_w").alias("_t"))
    sums = w.join(coo.withColumnRenamed("obs_id", "dst"), "dst").groupBy("src", "var_id").agg(F.sum(F.col("_w") * F.col("value")).alias("_s"))
    return sums.join(total, "src").select(F.col("src").alias("obs_id"), "var_id", (F.col("_s") / F.col("_t")).alias("value"))


def knn_classify(neighbours: DataFrame, labels: DataFrame, *, weights: str = "distance") -> DataFrame:
    """(src, predicted): the label of largest summed weight, the smallest at a tie; ``labels`` is (id, label)."""
    votes = neighbours.withColumn("_w", _weights(weights)).join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.sum("_w").alias("_v"))
    return votes.groupBy("src").agg(F.min(F.struct((-F.col("_v")).alias("v"), "label")).alias("_b")).select("src", F.col("_b.label").alias("predicted"))


class KnnPredictor:
    """A training manifold with its targets: ``predict`` finds each query's neighbours and combines them."""

    def __init__(self, manifold: DataFrame, *, labels: DataFrame | None = None, values: DataFrame | None = None, layer: DataFrame | None = None, n_neighbors: int = 3, weights: str = "distance", metric_name: str = "euclidean") -> None:
        if sum(x is not None for x in (labels, values, layer)) != 1:
            raise ValueError("give exactly one of labels, values and layer")
        self.manifold, self.labels, self.values, self.layer = manifold, labels, values, layer
        self.k, self.weights, self.metric = n_neighbors, weights, metric_name

    def predict(self, queries: DataFrame) -> DataFrame:
        near = knn_exact(queries, self.manifold, self.k, metric_name=self.metric, skip_self=False)
        if self.labels is not None:
            return knn_classify(near, self.labels, weights=self.weights)
        if self.values is not None:
            return knn_regress(near, self.values, weights=self.weights)
        return knn_regress_layer(near, self.layer, weights=self.weights)
