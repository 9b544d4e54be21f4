"""Normalisation of sparse layers; zeros stay implicit throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.model import Assay, LayerSpec
from assaylake.operators.kernels import asof_join, midrank

SAMPLE_SEED = 0


def idf(coo: DataFrame, n_obs: Column) -> DataFrame:
    """Values times ln(n_obs / number of cells that hold the feature)."""
    df = coo.groupBy("var_id").agg(F.count(F.lit(1)).alias("_df"))
    return coo.join(df, "var_id").select("obs_id", "var_id", (F.col("value") * F.ln(n_obs / F.col("_df"))).alias("value"))


def l2_norm(coo: DataFrame, total: float = 1.0) -> DataFrame:
    """Rows scaled to Euclidean length ``total``; a row of zeros stays one."""
    norms = coo.groupBy("obs_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm"))
    return coo.join(norms, "obs_id").select("obs_id", "var_id", F.coalesce(F.try_divide(F.lit(total) * F.col("value"), F.col("_norm")), F.lit(0.0)).alias("value"))


def row_sums_to(coo: DataFrame, raw: DataFrame, total: float) -> DataFrame:
    """Rows scaled by ``total`` over their sum in the raw layer; a raw sum of 0 gives 0."""
    sums = raw.groupBy("obs_id").agg(F.sum("value").alias("_sum"))
    return coo.join(sums, "obs_id").select("obs_id", "var_id", F.coalesce(F.try_divide(F.lit(total) * F.col("value"), F.col("_sum")), F.lit(0.0)).alias("value"))


def frobenius(coo: DataFrame) -> DataFrame:
    return coo.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def transform(assay: Assay, spec: LayerSpec, *, view_only: bool = False, binarize: bool = False) -> DataFrame:
    """The layer as the spec describes it: a lazy (obs_id, var_id, value).

    Norms and rank scalars see all features, as they come before the choice of
    features; row sums are those of the raw layer even after idf. Binarisation
    looks at stored values only, so a zero is never active.
    """
    raw = assay.layer(spec.layer)
    x = raw
    if not view_only:
        if spec.idf_transform:
            x = idf(x, assay.obs.agg(F.count(F.lit(1)).cast("double")).scalar())
        if spec.normalize_with_obs_counts:
            x = row_sums_to(x, raw, spec.norm_total)
        elif spec.normalize_with_l2_norm:
            x = l2_norm(x, spec.norm_total)
        if spec.log_transform:
            x = x.withColumn("value", F.log1p("value"))
        if spec.rank_scalars is not None:
            x = x.join(spec.rank_scalars.select("var_id", "scalar"), "var_id").select("obs_id", "var_id", (F.col("value") * F.col("scalar")).alias("value"))
    if spec.features is not None:
        x = x.join(spec.features.select("var_id"), "var_id", "left_semi")
    if spec.scalar != 1.0:
        x = x.withColumn("value", F.col("value") * spec.scalar)
    if binarize:
        x = x.where(F.col("value") > spec.feature_active_threshold).withColumn("value", F.lit(1.0))
    return x.select("obs_id", "var_id", "value")


def feature_means(var: DataFrame, coo: DataFrame, n_obs: Column) -> DataFrame:
    """(var_id, mean) over all cells, those with zeros included."""
    sums = coo.groupBy("var_id").agg(F.sum("value").alias("_s"))
    return var.select("var_id").join(sums, "var_id", "left").select("var_id", (F.coalesce("_s", F.lit(0.0)) / n_obs).alias("mean"))


def stored_moments(coo: DataFrame, axis: str = "var_id", *, ddof: int = 0, n: Column | None = None) -> DataFrame:
    """(axis, mean, std) over stored values only.

    With ``ddof`` the variance is corrected by the full number of rows ``n``.
    """
    out = coo.groupBy(axis).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return out if not ddof else out.withColumn("std", F.col("std") * F.sqrt(n / (n - ddof)))


def rank_scalars(mean0: DataFrame, mean1: DataFrame, *, eps: float = 1e-2, low: float = 0.5, high: float = 2.0, mode: str = "reference") -> DataFrame:
    """(var_id, scalar): factors that give the features of ``mean1`` the spread of ``mean0``.

    ``reference`` pairs feature j with the first feature whose average rank in
    ``mean1`` is at least j's rank in ``mean0`` and takes that one's mean0.
    ``quantile`` pairs equal ranks, which is quantile normalisation. Factors are
    clipped; means up to ``eps`` count as ``eps``.
    """
    r0 = midrank(mean0.select("var_id", F.col("mean").alias("m0")), [], "m0", out="r0").select("var_id", "m0", "r0")
    r1 = midrank(mean1.select("var_id", F.col("mean").alias("m1")), [], "m1", out="r1").select("var_id", "m1", "r1")
    both = r0.join(r1, "var_id")
    if mode == "reference":
        table = both.groupBy((-F.col("r1")).alias("neg")).agg(F.min_by("m0", F.struct("r0", "var_id")).alias("picked")).withColumn("_on", F.lit(0))
        query = both.withColumns({"_on": F.lit(0), "neg0": -F.col("r0")})
    elif mode == "quantile":
        table = both.groupBy((-F.col("r0")).alias("neg")).agg(F.avg("m0").alias("picked")).withColumn("_on", F.lit(0))
        query = both.withColumns({"_on": F.lit(0), "neg0": -F.col("r1")})
    else:
        raise ValueError("mode is reference or quantile")
    paired = asof_join(query, table, on="_on", at="neg0", start="neg", width=4096, carry=["picked"])
    ratio = F.greatest("picked", F.lit(eps)) / F.greatest("m1", F.lit(eps))
    return paired.select("var_id", F.least(F.greatest(F.coalesce(ratio, F.lit(1.0)), F.lit(low)), F.lit(high)).alias("scalar"))


def gram_weights(layers: dict[str, DataFrame], sample: DataFrame | None = None) -> DataFrame:
    """(layer, weight, scalar): weight = 1 / |X Xt - I| over the sampled rows, scalar = sqrt(weight / sum).

    |X Xt - I|^2 = |Xt X|^2 - 2 |X|^2 + n: the sum runs over pairs of features
    that share a row, so no n x n matrix appears.
    """
    parts = None
    for name, coo in layers.items():
        x = coo if sample is None else coo.join(sample.select("obs_id"), "obs_id", "left_semi")
        n = x.agg(F.count_distinct("obs_id").cast("double").alias("n"), F.sum(F.col("value") * F.col("value")).alias("f"))
        a, b = x.select("obs_id", F.col("var_id").alias("i"), F.col("value").alias("x")), x.select("obs_id", F.col("var_id").alias("j"), F.col("value").alias("y"))
        gram = a.join(b, "obs_id").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("g")).agg(F.sum(F.col("g") * F.col("g")).alias("g2"))
        norm = F.sqrt(F.greatest(gram.scalar() - 2 * F.col("f") + F.col("n"), F.lit(0.0)))
        row = n.select(F.lit(name).alias("layer"), F.try_divide(F.lit(1.0), norm).alias("weight"))
        parts = row if parts is None else parts.unionByName(row)
    return parts.withColumn("scalar", F.sqrt(F.col("weight") / F.sum("weight").over(Window.partitionBy())))
