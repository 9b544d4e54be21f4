"""Tests between groups of cells, correlations and markers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions.special import chi2_sf_1, normal_two_sided, t_two_sided
from assaylake.operators.kernels import benjamini_hochberg, correlation, midrank


def t_test(values: DataFrame, group: str, a, b, *, by: Sequence[str] = (), welch: bool = False) -> DataFrame:
    """(by, t, df, pval, mean_a, mean_b): two-sided t-test of two groups, Student's or Welch's."""
    is_a, is_b = F.col(group) == F.lit(a), F.col(group) == F.lit(b)
    v = F.col("value")
    m = values.where(is_a | is_b).groupBy(*by).agg(
        F.avg(F.when(is_a, v)).alias("mean_a"), F.avg(F.when(is_b, v)).alias("mean_b"), F.var_samp(F.when(is_a, v)).alias("_va"), F.var_samp(F.when(is_b, v)).alias("_vb"),
        F.count(F.when(is_a, v)).cast("double").alias("_na"), F.count(F.when(is_b, v)).cast("double").alias("_nb"),
    )
    if welch:
        sa, sb = F.col("_va") / F.col("_na"), F.col("_vb") / F.col("_nb")
        se, df = F.sqrt(sa + sb), F.try_divide((sa + sb) * (sa + sb), sa * sa / (F.col("_na") - 1) + sb * sb / (F.col("_nb") - 1))
    else:
        df = F.col("_na") + F.col("_nb") - 2
        pooled = ((F.col("_na") - 1) * F.col("_va") + (F.col("_nb") - 1) * F.col("_vb")) / df
        se = F.sqrt(pooled * (1 / F.col("_na") + 1 / F.col("_nb")))
    out = m.withColumns({"t": F.try_divide(F.col("mean_a") - F.col("mean_b"), se), "df": df})
    return out.withColumn("pval", F.coalesce(t_two_sided("t", "df"), F.lit(1.0))).select(*by, "t", "df", F.when(F.isnan("pval"), 1.0).otherwise(F.col("pval")).alias("pval"), "mean_a", "mean_b")


def mann_whitney(values: DataFrame, group: str, a, b, *, by: Sequence[str] = (), correction: bool = True) -> DataFrame:
    """(by, u, pval, n_a, n_b): Mann-Whitney U of group ``a``, normal approximation with tie (and continuity) correction."""
    rows = values.where(F.col(group).isin([a, b])).select(*by, group, "value")
    ranked = midrank(rows, by, "value")
    is_a = F.col(group) == F.lit(a)
    # t^3 - t once per distinct value is (t^2 - 1) per row
    agg = ranked.groupBy(*by).agg(
        F.sum(F.when(is_a, F.col("rank")).otherwise(0.0)).alias("_r"), F.count(F.when(is_a, 1)).cast("double").alias("n_a"), F.count(F.when(~is_a, 1)).cast("double").alias("n_b"),
        F.sum((F.col("n_ties") * F.col("n_ties") - 1).cast("double")).alias("_ties"),
    )
    n = F.col("n_a") + F.col("n_b")
    u = F.col("_r") - F.col("n_a") * (F.col("n_a") + 1) / 2
    half = F.col("n_a") * F.col("n_b") / 2
    sd = F.sqrt(F.col("n_a") * F.col("n_b") / 12 * (n + 1 - F.try_divide(F.col("_ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(u - half) - F.lit(0.5 if correction else 0.0), F.lit(0.0)), sd)
    return agg.withColumns({"u": u, "_z": z}).withColumn("pval", F.least(F.lit(1.0), F.coalesce(normal_two_sided(F.coalesce("_z", F.lit(0.0))), F.lit(1.0)))).select(*by, "u", "pval", "n_a", "n_b")


def sparse_rank_sums(coo: DataFrame, labels: DataFrame, group: str, n_obs: Column) -> DataFrame:
    """(var_id, group, rank_sum) of all cells, implicit zeros included (values must be >= 0).

    The block of z zeros of a feature has rank (z + 1) / 2; positive values are
    ranked among themselves and moved up by z.
    """
    positive = coo.where(F.col("value") > 0).join(labels.select("obs_id", group), "obs_id")
    nnz = positive.groupBy("var_id").agg(F.count(F.lit(1)).alias("_nz"))
    ranked = midrank(positive, ["var_id"], "value").join(nnz, "var_id").withColumn("_z", n_obs - F.col("_nz"))
    sums = ranked.groupBy("var_id", group).agg(F.sum(F.col("rank") + F.col("_z")).alias("_r"), F.count(F.lit(1)).alias("_k"), F.first("_z").alias("_z"))
    sizes = labels.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    return sums.join(sizes, group).select("var_id", group, (F.col("_r") + (F.col("_n") - F.col("_k")) * (F.col("_z") + 1) / 2).alias("rank_sum"))


def mann_whitney_from_sums(df: DataFrame, n1: str, n2: str, r1: str, r2: str) -> DataFrame:
    """Adds u, score = ln(U1 / mean U) and pval, without tie or continuity correction."""
    u1 = F.col(r1) - F.col(n1) * (F.col(n1) + 1) / 2
    u2 = F.col(r2) - F.col(n2) * (F.col(n2) + 1) / 2
    mean = F.col(n1) * F.col(n2) / 2
    sd = F.sqrt(F.col(n1) * F.col(n2) * (F.col(n1) + F.col(n2) + 1) / 12)
    return df.withColumns({"u": F.least(u1, u2), "score": F.ln(F.try_divide(u1, mean)), "pval": normal_two_sided((F.least(u1, u2) - mean) / sd)})


def wilcoxon(pairs: DataFrame, x: str, y: str, *, by: Sequence[str] = ()) -> DataFrame:
    """(by, w, pval, n): signed-rank test of paired rows; equal pairs are dropped; w = min(W+, W-)."""
    d = pairs.select(*by, (F.col(x) - F.col(y)).alias("_d")).where(F.col("_d") != 0).withColumn("_a", F.abs("_d"))
    ranked = midrank(d, by, "_a")
    agg = ranked.groupBy(*by).agg(F.sum(F.when(F.col("_d") > 0, F.col("rank")).otherwise(0.0)).alias("_p"), F.sum("rank").alias("_all"), F.count(F.lit(1)).cast("double").alias("n"), F.sum((F.col("n_ties") * F.col("n_ties") - 1).cast("double")).alias("_t"))
    w = F.least("_p", F.col("_all") - F.col("_p"))
    sd = F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("_t") / 48)
    z = F.try_divide(w - F.col("n") * (F.col("n") + 1) / 4, sd)
    return agg.withColumns({"w": w, "_z": z}).select(*by, "w", F.coalesce(normal_two_sided(F.coalesce("_z", F.lit(0.0))), F.lit(1.0)).alias("pval"), "n")


def chi_square(df: DataFrame, g: str, gn: str, r: str, rn: str) -> DataFrame:
    """Adds chi2 (2x2, Yates), pval and score = log2(((1 + g) / gn) / ((1 + r) / rn)).

    An empty or full margin has no test: chi2 is null and pval 1.
    """
    a, b, c, d = F.col(g), F.col(gn) - F.col(g), F.col(r), F.col(rn) - F.col(r)
    n = a + b + c + d
    cross = F.abs(a * d - b * c)
    yates = cross - F.least(cross, n / 2)
    chi2 = F.try_divide(n * yates * yates, (a + b) * (c + d) * (a + c) * (b + d))
    score = F.log2(F.try_divide((1 + F.col(g)) / F.col(gn), (1 + F.col(r)) / F.col(rn)))
    return df.withColumns({"chi2": chi2, "score": score}).withColumn("pval", F.when(F.col("chi2").isNull(), F.lit(1.0)).otherwise(chi2_sf_1(F.coalesce("chi2", F.lit(0.0)))))


def enriched_binary(coo: DataFrame, obs: DataFrame, category: str, *, above: float = 0.0) -> DataFrame:
    """(group, var_id, chi2, pval, p_adj, score): each category against all other cells, on active / not active.

    The rest is the total minus the category, so nothing is copied per category.
    P-values are adjusted over the groups of a feature.
    """
    labels = obs.where(F.col(category).isNotNull()).select("obs_id", F.col(category).alias("group"))
    sizes = labels.groupBy("group").agg(F.count(F.lit(1)).alias("gn"))
    active = coo.where(F.col("value") > above).join(labels, "obs_id")
    g = active.groupBy("group", "var_id").agg(F.count(F.lit(1)).alias("g"))
    t = active.groupBy("var_id").agg(F.count(F.lit(1)).alias("t"))
    # every category of every active feature, those without an active cell included
    grid = t.withColumn("_all", sizes.agg(F.collect_list(F.struct("group", "gn"))).scalar()).select("var_id", "t", F.inline("_all"))
    rows = grid.join(g, ["group", "var_id"], "left").na.fill(0, ["g"])
    n = labels.agg(F.count(F.lit(1))).scalar()
    rows = rows.withColumns({"r": F.col("t") - F.col("g"), "rn": n - F.col("gn")})
    tested = benjamini_hochberg(chi_square(rows, "g", "gn", "r", "rn"), "pval", partition=["var_id"])
    return tested.select("group", "var_id", "chi2", "pval", "p_adj", "score")


def enriched_ranks(coo: DataFrame, obs: DataFrame, category: str) -> DataFrame:
    """(group, var_id, u, pval, p_adj, score): Mann-Whitney of each category against the rest, zeros included."""
    labels = obs.where(F.col(category).isNotNull()).select("obs_id", F.col(category).alias("group"))
    n = labels.agg(F.count(F.lit(1)).cast("double")).scalar()
    sums = sparse_rank_sums(coo, labels, "group", n)
    sizes = labels.groupBy("group").agg(F.count(F.lit(1)).cast("double").alias("n1"))
    rows = sums.join(sizes, "group").withColumn("n2", n - F.col("n1")).where("n2 > 0")
    rows = rows.withColumn("r2", (F.col("n1") + F.col("n2")) * (F.col("n1") + F.col("n2") + 1) / 2 - F.col("rank_sum"))
    tested = benjamini_hochberg(mann_whitney_from_sums(rows, "n1", "n2", "rank_sum", "r2"), "pval", partition=["var_id"])
    return tested.select("group", "var_id", "u", "pval", "p_adj", "score")


def pairwise_tests(values: DataFrame, group: str, scheme: Sequence[tuple], *, by: Sequence[str] = (), test: str = "ttest", fdc: bool = False, welch: bool = False) -> DataFrame:
    """(scheme_i, scheme_j, by, statistic, pval): one test per pair of groups; NaN p-values are 1."""
    run = {
        "ttest": lambda a, b: t_test(values, group, a, b, by=by, welch=welch).select(*by, F.col("t").alias("statistic"), "pval"),
        "mannwhitneyu": lambda a, b: mann_whitney(values, group, a, b, by=by).select(*by, F.col("u").alias("statistic"), "pval"),
        "chisquare": lambda a, b: _binary_test(values, group, a, b, by),
    }
    if test not in run:
        raise ValueError(f"test is one of {sorted(run)}")
    out = None
    for a, b in scheme:
        rows = run[test](a, b).select(F.lit(a).alias("scheme_i"), F.lit(b).alias("scheme_j"), *by, "statistic", "pval")
        out = rows if out is None else out.unionByName(rows)
    return benjamini_hochberg(out, "pval", partition=by, out="p_adj").drop("pval").withColumnRenamed("p_adj", "pval") if fdc else out


def _binary_test(values: DataFrame, group: str, a, b, by: Sequence[str]) -> DataFrame:
    is_a, is_b, on = F.col(group) == F.lit(a), F.col(group) == F.lit(b), F.col("value") > 0
    m = values.groupBy(*by).agg(F.count(F.when(is_a & on, 1)).alias("g"), F.count(F.when(is_a, 1)).alias("gn"), F.count(F.when(is_b & on, 1)).alias("r"), F.count(F.when(is_b, 1)).alias("rn"))
    return chi_square(m, "g", "gn", "r", "rn").select(*by, F.col("chi2").alias("statistic"), "pval")


def _fit_logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, float]:
    """Newton's method with step halving; the log-likelihood at the end."""

    def loglik(w: np.ndarray) -> float:
        z = x @ w
        return float(y @ z - np.logaddexp(0, z).sum())

    w, best = start.copy(), loglik(start)
    for _ in range(max_iter):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        grad = x.T @ (y - p)
        if np.abs(grad).max() / len(y) < tol:
            break
        step = np.linalg.lstsq((x * (p * (1 - p))[:, None]).T @ x + 1e-10 * np.eye(x.shape[1]), grad, rcond=None)[0]
        for _ in range(30):
            new = loglik(w + step)
            if new >= best:
                break
            step /= 2
        else:
            break
        w, gain, best = w + step, new - best, new
        if gain < 1e-13 * (1 + abs(best)):
            break
    return w, best


def likelihood_test(coo: DataFrame, cells: DataFrame, *, groups: DataFrame | None = None, min_lfc: float = 0.25, min_base_mean: float = 0.0, fdr: bool = True, max_iter: int = 100, tol: float = 1e-8) -> DataFrame:
    """(group, var_id, pval, score, base_mean): does a feature help tell two sets of cells apart, beside a covariate?

    ``cells`` is (obs_id, group, y, covariate) with y 0 or 1 for every cell of
    every comparison; ``coo`` holds the values that enter the regression, and
    ``groups`` (default ``coo``) those of the effect size log2(mean1 / mean0).
    Features with a zero mean on either side, or too small an effect or base
    mean, are not fitted and get p = 1. Each fitted (group, feature) is one group
    of an Arrow function whose rows are the feature's non-zero values; the zeros
    come from the comparison's cells, which are sent once per comparison.
    """
    means_of = groups if groups is not None else coo
    n = cells.groupBy("group").agg(F.sum("y").cast("double").alias("n1"), F.sum(1 - F.col("y")).cast("double").alias("n0"))
    joined = means_of.join(cells.select("obs_id", "group", "y"), "obs_id")
    m = joined.groupBy("group", "var_id").agg(F.sum(F.col("value") * F.col("y")).alias("_s1"), F.sum(F.col("value") * (1 - F.col("y"))).alias("_s0")).join(n, "group")
    m = m.withColumns({"_m1": F.try_divide("_s1", "n1"), "_m0": F.try_divide("_s0", "n0")}).where("_m1 > 0 and _m0 > 0")
    m = m.select("group", "var_id", F.log2(F.col("_m1") / F.col("_m0")).alias("score"), ((F.col("_m1") + F.col("_m0")) / 2).alias("base_mean"))
    tested = m.where((F.abs("score") > min_lfc) & (F.col("base_mean") > min_base_mean)).select("group", "var_id")
    rows = coo.join(cells.select("obs_id", "group"), "obs_id").join(tested, ["group", "var_id"], "left_semi").select("group", "var_id", "obs_id", "value")

    def fit(key, features: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("obs_id")
        y = own["y"].to_numpy(float)
        null = np.column_stack([np.ones(len(own)), own["covariate"].to_numpy(float)])
        w0, ll0 = _fit_logistic(null, y, np.zeros(2), max_iter, tol)
        position = pd.Series(np.arange(len(own)), index=own["obs_id"].to_numpy())
        out = []
        for name, f in features.groupby("var_id", sort=False):
            x = np.zeros(len(own))
            x[position[f["obs_id"].to_numpy()].to_numpy()] = f["value"].to_numpy(float)
            _, ll1 = _fit_logistic(np.column_stack([null, x]), y, np.append(w0, 0.0), max_iter, tol)
            out.append((key[0], name, max(0.0, 2 * (ll1 - ll0))))
        return pd.DataFrame(out, columns=["group", "var_id", "stat"])

    # a comparison's features are divided over tasks; each gets the comparison's cells
    shards = 32
    f_rows = rows.withColumn("_shard", F.pmod(F.xxhash64("var_id"), F.lit(shards)))
    c_rows = cells.select(F.col("group").alias("_group"), "obs_id", "y", "covariate").withColumn("_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    kind = cells.schema["group"].dataType.simpleString()
    stats = f_rows.groupBy("group", "_shard").cogroup(c_rows.groupBy("_group", "_shard")).applyInPandas(fit, f"group {kind}, var_id string, stat double")
    p = stats.withColumn("pval", chi2_sf_1(F.col("stat"))).select("group", "var_id", "pval")
    if fdr:
        p = benjamini_hochberg(p, "pval", partition=["group"], out="p_adj").select("group", "var_id", F.col("p_adj").alias("pval"))
    return m.join(p, ["group", "var_id"], "left").select("group", "var_id", F.coalesce("pval", F.lit(1.0)).alias("pval"), "score", "base_mean")


def log_loss(df: DataFrame, y: str, p: str, *, eps: float = 1e-15) -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    return df.agg((-F.avg(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))).alias("loss"))


def column_correlations(profiles: DataFrame, column: str, row: str, *, spearman: bool = False) -> DataFrame:
    """(a, b, r) of all pairs a < b of columns of a long table (row, column, value).

    Every (row, column) must be there: use explicit zeros. Columns are groups or
    layers, a few; the pairs are formed per row.
    """
    rows = profiles.select(F.col(row).alias("_row"), F.col(column).alias("_c"), "value")
    if spearman:
        rows = midrank(rows, ["_c"], "value").select("_row", "_c", F.col("rank").alias("value"))
    a, b = rows.select("_row", F.col("_c").alias("a"), F.col("value").alias("x")), rows.select("_row", F.col("_c").alias("b"), F.col("value").alias("y"))
    return a.join(b, "_row").where("a < b").groupBy("a", "b").agg(correlation("x", "y").alias("r"))


def depth_correlation(embedding: DataFrame, depth: DataFrame) -> DataFrame:
    """(component, r): Pearson correlation of every embedding component with the cells' totals."""
    rows = embedding.join(depth, "obs_id").select("total", F.posexplode("vec").alias("component", "x"))
    return rows.groupBy("component").agg(correlation("x", "total").alias("r"))


def quadrants(df: DataFrame, x: str, y: str, *, at_x: float = 0.0, at_y: float = 0.0) -> DataFrame:
    """(quadrant, observed, expected): fractions, the expected ones from the two margins."""
    right, up = F.col(x) > at_x, F.col(y) > at_y
    m = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.avg(right.cast("double")).alias("r"), F.avg(up.cast("double")).alias("u"), *[F.avg(c.cast("double")).alias(n) for n, c in (("pp", right & up), ("pm", right & ~up), ("mp", ~right & up), ("mm", ~right & ~up))])
    e = {"pp": F.col("r") * F.col("u"), "pm": F.col("r") * (1 - F.col("u")), "mp": (1 - F.col("r")) * F.col("u"), "mm": (1 - F.col("r")) * (1 - F.col("u"))}
    return m.select(F.inline(F.array(*[F.struct(F.lit(n).alias("quadrant"), F.col(n).alias("observed"), e[n].alias("expected")) for n in e])))


def volcano(df: DataFrame, p: str, lfc: str, *, min_p: float = 0.05, min_lfc: float = 1.0) -> DataFrame:
    """Adds neg_log10_p (zeros count as the least positive p) and ``call``: up, down or ns."""
    least = df.where(F.col(p) > 0).agg(F.min(p)).scalar()
    q = F.when(F.col(p) == 0, least).otherwise(F.col(p))
    hit = (F.col(p) < min_p) & (F.abs(lfc) >= min_lfc)
    return df.withColumns({"neg_log10_p": -F.log10(q), "call": F.when(hit & (F.col(lfc) > 0), "up").when(hit & (F.col(lfc) < 0), "down").otherwise("ns")})


def top_markers(markers: DataFrame, n: int = 10, *, group: str = "group", p: str = "pval", score: str = "score", name: str = "var_id", alpha: float = 0.05, only_significant: bool = True, negative: bool = False) -> DataFrame:
    """The n features of least p-value per group, by name at a tie, with nlog_p = -ln p (0 for p = 0)."""
    rows = markers.where(F.col(score) < 0 if negative else F.col(score) > 0)
    rows = rows.where(F.col(p) < alpha) if only_significant else rows
    w = Window.partitionBy(group).orderBy(p, name)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn("nlog_p", F.when(F.col(p) > 0, -F.ln(p)).otherwise(F.lit(0.0)))

