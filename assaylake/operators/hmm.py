"""Hidden Markov models with gamma or exponential emissions over (gene, cell_type, time, modality) tensors."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.operators.kernels import correlation, midrank
from assaylake.plans.scratch import Scratch

TINY = 1e-8


@dataclass(frozen=True)
class Hmm:
    """Parameters: starts (k), transitions (k, k), shape and scale (k, modalities); shape 1 is exponential."""

    start: np.ndarray
    trans: np.ndarray
    shape: np.ndarray
    scale: np.ndarray
    kind: tuple[str, ...] = field(default=())

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """(t, k): summed over the modalities that are not NaN."""
        y = np.maximum(x, TINY)[:, None, :]
        lg = np.vectorize(math.lgamma)(self.shape)
        d = (self.shape - 1) * np.log(y) - y / self.scale - lg - self.shape * np.log(self.scale)
        return np.where(np.isnan(x)[:, None, :], 0.0, d).sum(2)

    def expected(self) -> np.ndarray:
        return self.shape * self.scale

    def variance(self) -> np.ndarray:
        return self.shape * self.scale**2


def create_hmm(n_states: int, kinds: list[str], *, seed: int = 0, inertia: float = 0.01) -> Hmm:
    """Uniform transitions; emissions drawn around 1 with a seed. ``inertia`` is the share of the old values kept per step."""
    bad = set(kinds) - {"gamma", "exponential"}
    if bad:
        raise ValueError(f"unknown emissions {bad}")
    rng = np.random.default_rng(seed)
    shape = np.where(np.array(kinds) == "gamma", rng.uniform(0.5, 3, (n_states, len(kinds))), 1.0)
    return Hmm(np.full(n_states, 1 / n_states), np.full((n_states, n_states), 1 / n_states), shape, rng.uniform(0.2, 2, (n_states, len(kinds))), tuple(kinds))


def create_hmm_system(n_states: int, kinds: list[str], cell_types: list[tuple[int, ...]], *, seed: int = 0) -> dict[tuple[int, ...], Hmm]:
    """One model for each group of cell types."""
    return {tuple(sorted(group)): create_hmm(n_states, kinds, seed=seed + i) for i, group in enumerate(cell_types)}


def fit_hmm_system(tensor: DataFrame, system: dict[tuple[int, ...], Hmm], *, pretrain_global: bool = True, **kwargs) -> dict[tuple[int, ...], Hmm]:
    """Fits every model on its own cell types, beginning with one fitted on all of them if wished."""
    start = fit_hmm(tensor, next(iter(system.values())), **kwargs)[0] if pretrain_global and system else None
    return {group: fit_hmm(tensor.where(F.col("cell_type").isin(list(group))), start or model, **kwargs)[0] for group, model in system.items()}


def system_posteriors(tensor: DataFrame, system: dict[tuple[int, ...], Hmm], **kwargs) -> DataFrame:
    parts = [posteriors(tensor.where(F.col("cell_type").isin(list(group))), model, **kwargs) for group, model in system.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def forward_backward(hmm: Hmm, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors (t, k), summed transition posteriors (k, k) and the log-likelihood of a sequence (t, modalities)."""
    logd = hmm.log_density(x)
    top = logd.max(1, keepdims=True)
    e = np.exp(logd - top)
    t, k = e.shape
    alpha, beta, c = np.empty((t, k)), np.ones((t, k)), np.empty(t)
    for i in range(t):
        a = (hmm.start if i == 0 else alpha[i - 1] @ hmm.trans) * e[i]
        c[i] = max(a.sum(), 1e-300)
        alpha[i] = a / c[i]
    for i in range(t - 2, -1, -1):
        beta[i] = hmm.trans @ (e[i + 1] * beta[i + 1]) / c[i + 1]
    xi = np.zeros((k, k))
    for i in range(t - 1):
        xi += np.outer(alpha[i], e[i + 1] * beta[i + 1] / c[i + 1]) * hmm.trans
    return alpha * beta, xi, float(np.log(c).sum() + top.sum())


def _expectations(hmm: Hmm, x: np.ndarray) -> np.ndarray:
    """Summed statistics of sequences of one length (n, t, modalities): log-likelihood, starts, transitions, weights, sums, sums of logarithms."""
    n, t, m = x.shape
    k = len(hmm.start)
    logd = hmm.log_density(x.reshape(n * t, m)).reshape(n, t, k)
    top = logd.max(2, keepdims=True)
    e = np.exp(logd - top)
    alpha, beta, c = np.empty((n, t, k)), np.ones((n, t, k)), np.empty((n, t))
    for i in range(t):
        a = (hmm.start if i == 0 else alpha[:, i - 1] @ hmm.trans) * e[:, i]
        c[:, i] = np.maximum(a.sum(1), 1e-300)
        alpha[:, i] = a / c[:, i, None]
    xi = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        ahead = e[:, i + 1] * beta[:, i + 1] / c[:, i + 1, None]
        beta[:, i] = ahead @ hmm.trans.T
        xi += alpha[:, i].T @ ahead * hmm.trans
    g = alpha * beta
    seen, y = ~np.isnan(x), np.maximum(np.nan_to_num(x), TINY)
    weighted = lambda z: np.einsum("ntk,ntm->km", g, z).ravel()
    return np.concatenate([[np.log(c).sum() + top.sum()], g[:, 0].sum(0), xi.ravel(), weighted(seen.astype(float)), weighted(np.where(seen, y, 0.0)), weighted(np.where(seen, np.log(y), 0.0))])


def _digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), np.zeros_like(np.array(x, float))
    while (x < 6).any():
        small = x < 6
        out[small] -= 1 / x[small]
        x[small] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def _trigamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), np.zeros_like(np.array(x, float))
    while (x < 6).any():
        small = x < 6
        out[small] += 1 / x[small] ** 2
        x[small] += 1
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f / 42))


def gamma_fit(mean: np.ndarray, mean_log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood shape and scale from the mean and the mean logarithm, by Newton's method."""
    s = np.maximum(np.log(mean) - mean_log, 1e-8)
    k = (3 - s + np.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(20):
        k = np.clip(k - (np.log(k) - _digamma(k) - s) / (1 / k - _trigamma(k)), 1e-3, 1e4)
    return k, mean / k


def _sequences(pdf: pd.DataFrame, modalities: int) -> np.ndarray:
    x = np.full((int(pdf["t"].max()) + 1, modalities), np.nan)
    x[pdf["t"].to_numpy(int), pdf["modality"].to_numpy(int)] = pdf["value"].to_numpy(float)
    return x


def fit_hmm(tensor: DataFrame, hmm: Hmm, *, max_iter: int = 50, tol: float = 1.0, inertia: float = 0.01) -> tuple[Hmm, list[float]]:
    """Baum-Welch: sequences stay in their tasks, which return summed statistics; the driver sees k x k numbers.

    ``tensor`` is (gene, cell_type, t, modality, value); a sequence runs along t.
    The sequences are written once to the shared folder.
    """
    m, k, history = hmm.shape.shape[1], len(hmm.start), []
    rows = tensor.groupBy("gene", "cell_type").agg((F.max("t") + 1).cast("int").alias("n"), F.collect_list((F.col("t") * m + F.col("modality")).cast("int")).alias("at"), F.collect_list(F.coalesce(F.col("value").cast("double"), F.lit(float("nan")))).alias("v"))
    sequences = Scratch(tensor.sparkSession, "hmm").save(rows.select("n", "at", "v"), "sequences")
    for _ in range(max_iter):
        now = hmm

        def e_step(frames):
            for f in frames:
                for n, part in f.groupby("n"):
                    x = np.full((len(part), n * m), np.nan)
                    for row, at, v in zip(x, part["at"], part["v"]):
                        row[at] = v
                    yield pd.DataFrame({"s": [_expectations(now, x.reshape(len(part), n, m))]})

        stats = sequences.mapInPandas(e_step, "s array<double>")
        summed = stats.select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
        v = np.array([r.x for r in summed])
        if not len(v):
            return hmm, history
        ll, at = v[0], 1
        start, at = v[at : at + k], at + k
        xi, at = v[at : at + k * k].reshape(k, k), at + k * k
        w, at = np.maximum(v[at : at + k * m].reshape(k, m), 1e-9), at + k * m
        mean, at = np.maximum(v[at : at + k * m].reshape(k, m) / w, TINY), at + k * m
        mean_log = v[at:].reshape(k, m) / w
        shape, scale = gamma_fit(mean, np.minimum(mean_log, np.log(mean) - 1e-8))
        exponential = np.array(hmm.kind) == "exponential"
        shape[:, exponential], scale[:, exponential] = 1.0, mean[:, exponential]
        keep = lambda new, old: (1 - inertia) * new + inertia * old
        trans = (xi + 1e-12) / (xi + 1e-12).sum(1, keepdims=True)
        hmm = Hmm(keep(start / start.sum(), hmm.start), keep(trans, hmm.trans), keep(shape, hmm.shape), keep(scale, hmm.scale), hmm.kind)
        history.append(float(ll))
        if len(history) > 1 and history[-1] - history[-2] < tol:
            break
    return hmm, history


def posteriors(tensor: DataFrame, hmm: Hmm, *, observed: list[int] | None = None) -> DataFrame:
    """(gene, cell_type, t, posterior ARRAY<DOUBLE>, loglik); modalities outside ``observed`` are masked."""
    m = hmm.shape.shape[1]
    g, c = tensor.schema["gene"].dataType.simpleString(), tensor.schema["cell_type"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _sequences(pdf, m)
        if observed is not None:
            x[:, [i for i in range(m) if i not in observed]] = np.nan
        p, _, ll = forward_backward(hmm, x)
        return pd.DataFrame({"gene": pdf["gene"].iloc[0], "cell_type": pdf["cell_type"].iloc[0], "t": np.arange(len(p), dtype="int32"), "posterior": list(p), "loglik": ll})

    return tensor.groupBy("gene", "cell_type").applyInPandas(run, f"gene {g}, cell_type {c}, t int, posterior array<double>, loglik double")


def predict_observations(post: DataFrame, hmm: Hmm, *, variance: bool = False) -> DataFrame:
    """(gene, cell_type, t, modality, value): posterior times the states' expected values or variances."""
    table = hmm.variance() if variance else hmm.expected()
    per = [F.struct(F.lit(j).alias("modality"), sum((F.col("posterior")[i] * F.lit(float(table[i, j])) for i in range(len(table))), F.lit(0.0)).alias("value")) for j in range(table.shape[1])]
    return post.select("gene", "cell_type", "t", F.inline(F.array(*per)))


@dataclass(frozen=True)
class HmmResults:
    """What a model has been used for: named tables of posteriors and of reconstructed data."""

    name: str
    probabilities: dict[str, DataFrame] = field(default_factory=dict)
    reconstructed: dict[str, DataFrame] = field(default_factory=dict)

    def merge(self, other: "HmmResults", *, overwrite: bool = True) -> "HmmResults":
        """Both together; of equal names the other's counts with a warning, or is refused."""
        if self.name != other.name:
            raise ValueError("results of different models")
        both = sorted({*self.probabilities} & {*other.probabilities}) + sorted({*self.reconstructed} & {*other.reconstructed})
        if both and not overwrite:
            raise ValueError(f"both hold {both}")
        if both:
            warnings.warn(f"overwritten: {both}", stacklevel=2)
        return HmmResults(self.name, {**self.probabilities, **other.probabilities}, {**self.reconstructed, **other.reconstructed})


def _pearson(x: np.ndarray, y: np.ndarray) -> float:
    sx, sy = x.std(), y.std()
    return float(((x - x.mean()) * (y - y.mean())).mean() / (sx * sy)) if sx > 0 and sy > 0 else 0.0


def bootstrap_correlation(pairs: DataFrame, by: str, *, q: float | None = 0.1, ignore_zero: bool = True, resamples: int = 30, seed: int = 0) -> DataFrame:
    """(by, res): the q-quantile of Pearson correlations over resamples of a third of the rows with replacement.

    With ``q`` None it is the plain correlation. With ``ignore_zero`` pairs of which
    both are the least value of their side are left out, unless values below 0
    occur in the whole table. Fewer than two rows, or a constant side, give 0.
    """
    kind = pairs.schema[by].dataType.simpleString()
    rows = pairs.select(by, "x", "y")
    if ignore_zero:
        ends = rows.groupBy(by).agg(F.min("x").alias("_x"), F.min("y").alias("_y"))
        low = rows.agg(F.least(F.min("x"), F.min("y"))).scalar()
        rows = rows.join(ends, by).where((low < 0) | (F.col("x") != F.col("_x")) | (F.col("y") != F.col("_y"))).select(by, "x", "y")
    if q is None:
        return rows.groupBy(by).agg(correlation("x", "y").alias("res")).na.fill(0.0, ["res"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        pdf = pdf.sort_values(["x", "y"])
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        n = max(len(x) // 3, 2)
        rs = [_pearson(x[i], y[i]) for i in (rng.integers(0, len(x), n) for _ in range(resamples))]
        return pd.DataFrame({by: [pdf[by].iloc[0]], "res": [float(np.quantile(rs, q))]})

    return rows.groupBy(by).applyInPandas(run, f"{by} {kind}, res double")


def lagged_correlation(pairs: DataFrame, by: list[str], *, lag: int = 0, spearman: bool = True) -> DataFrame:
    """(by, res): correlation over time of x(t + lag) with y(t), on ranks if wished; ``pairs`` is (by, t, x, y).

    Times without a partner are left out; where a side is constant, or has no two
    times, there is no correlation (null).
    """
    x = pairs.select(*by, (F.col("t") - lag).alias("t"), "x").where(F.col("x").isNotNull())
    both = x.join(pairs.select(*by, "t", "y").where(F.col("y").isNotNull()), [*by, "t"])
    if spearman:
        both = midrank(both, by, "x", out="_rx").drop("n_ties")
        both = midrank(both, by, "y", out="_ry").select(*by, F.col("_rx").alias("x"), F.col("_ry").alias("y"))
    return both.groupBy(*by).agg(correlation("x", "y").alias("res"))


def transition_frame(spark, hmm: Hmm) -> DataFrame:
    """(state, next, neg_log_p) for display."""
    k = len(hmm.start)
    return spark.createDataFrame([(i, j, float(-np.log(max(hmm.trans[i, j], 1e-300)))) for i in range(k) for j in range(k)], "state int, next int, neg_log_p double")
