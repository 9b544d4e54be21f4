"""Group summaries of sparse layers; means count the implicit zeros."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.operators.kernels import zero_aware_quantile
from assaylake.plans.joins import join_crowded
from assaylake.plans.scratch import Scratch

TOTAL = 1e6


def _sizes(members: DataFrame, category: str) -> DataFrame:
    return members.where(F.col(category).isNotNull()).groupBy(category).agg(F.count(F.lit(1)).cast("double").alias("_n"))


def summarize_obs(coo: DataFrame, obs: DataFrame, category: str, *, std: bool = False) -> DataFrame:
    """(category, var_id, mean[, std]): means per category over all of its cells.

    Only pairs with a value are rows; every other mean is 0. ``std`` is the
    population one, from sums over stored values. Cells without a category are
    left out.
    """
    labels = obs.where(F.col(category).isNotNull()).select("obs_id", category)
    sums = coo.join(labels, "obs_id").groupBy(category, "var_id").agg(F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_q"))
    mean = F.col("_s") / F.col("_n")
    out = [category, "var_id", mean.alias("mean")]
    if std:
        out.append(F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0))).alias("std"))
    return sums.join(_sizes(labels, category), category).select(*out)


def summarize_var(coo: DataFrame, var: DataFrame, category: str, *, normalize: bool = True) -> DataFrame:
    """(obs_id, category, value): sums over the features of each group, divided by the group's size if wished."""
    labels = var.where(F.col(category).isNotNull()).select("var_id", category)
    sums = coo.join(labels, "var_id").groupBy("obs_id", category).agg(F.sum("value").alias("value"))
    if not normalize:
        return sums
    return sums.join(_sizes(labels, category), category).select("obs_id", category, (F.col("value") / F.col("_n")).alias("value"))


def summarize_both(coo: DataFrame, obs: DataFrame, obs_category: str, var: DataFrame, var_category: str, *, normalize: bool = True) -> DataFrame:
    """(obs category, var category, value): cell means first, then sums or means over feature groups."""
    means = summarize_obs(coo, obs, obs_category).select(F.col(obs_category).alias("obs_id"), "var_id", F.col("mean").alias("value"))
    return summarize_var(means, var, var_category, normalize=normalize).withColumnRenamed("obs_id", obs_category)


def membership(coo: DataFrame, obs: DataFrame, category: str, *, anti: bool = False, per_class: str | None = None, total: float = TOTAL) -> DataFrame:
    """(category, obs_id, var_id, value): the rows of each category, or those of all others.

    With ``per_class`` the values are first scaled to a sum of ``total`` within
    each class of cells. The categories are counted as metadata: each row is
    copied once per other category, which is the size of the result.
    """
    columns = ["obs_id", category, *([per_class] if per_class and per_class != category else [])]
    rows = coo.join(obs.select(*columns), "obs_id")
    if per_class:
        sums = rows.groupBy(per_class).agg(F.sum("value").alias("_t"))
        rows = rows.join(sums, per_class).withColumn("value", F.lit(total) * F.col("value") / F.col("_t"))
    if not anti:
        return rows.where(F.col(category).isNotNull()).select(category, "obs_id", "var_id", "value")
    others = obs.where(F.col(category).isNotNull()).agg(F.sort_array(F.collect_set(category)).alias("_all"))
    wide = rows.withColumn("_other", F.explode(F.array_except(others.scalar(), F.array(category))))
    return wide.select(F.col("_other").alias(category), "obs_id", "var_id", "value")


def mode_by_group(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, mode): the most frequent non-null value, the smallest at a tie; counted in two levels."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    best = counts.groupBy(*group).agg(F.min(F.struct((-F.col("_c")).alias("c"), F.col(value).alias("v"))).alias("_b"))
    return best.select(*group, F.col("_b.v").alias("mode"))


def sortable_matrix(means: DataFrame, modality: str, category: str, weights: dict[str, float]) -> DataFrame:
    """(var_id, column, value): mean profiles of several modalities, weighted, columns modality|category."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return means.select("var_id", F.concat_ws("|", modality, category).alias("column"), (F.col("mean") * F.coalesce(w[F.col(modality)], F.lit(1.0))).alias("value"))


def scale_modalities(rows: DataFrame, modality: str, *, total: float = TOTAL, sqrt: bool = False) -> DataFrame:
    """Values of each modality scaled to a grand total, then square-rooted if wished."""
    sums = rows.groupBy(modality).agg(F.sum("value").alias("_t"))
    v = F.lit(total) * F.col("value") / F.col("_t")
    return rows.join(sums, modality).withColumn("value", F.sqrt(v) if sqrt else v).drop("_t")


def summarize_modalities(layers: dict[str, DataFrame], features: DataFrame, obs: DataFrame, category: str, *, norm_per_modality: bool = True, per_class: str | None = None, sqrt: bool = False) -> DataFrame:
    """(modality, category, obs_id, var_id, value): the chosen features of several layers, divided by category.

    With ``per_class`` each class of cells is first scaled to one total, with
    ``norm_per_modality`` then each modality; ``sqrt`` takes roots last.
    """
    parts = None
    for name, coo in layers.items():
        chosen = coo.join(features.select("var_id"), "var_id", "left_semi")
        rows = membership(chosen, obs, category, per_class=per_class).select(F.lit(name).alias("modality"), category, "obs_id", "var_id", "value")
        parts = rows if parts is None else parts.unionByName(rows)
    if norm_per_modality:
        return scale_modalities(parts, "modality", sqrt=sqrt)
    return parts.withColumn("value", F.sqrt("value")) if sqrt else parts


def modality_means(summary: DataFrame, obs: DataFrame, category: str) -> DataFrame:
    """(modality, category, var_id, mean) of :func:`summarize_modalities`, over all cells of a category."""
    sums = summary.groupBy("modality", category, "var_id").agg(F.sum("value").alias("_s"))
    return sums.join(_sizes(obs, category), category).select("modality", category, "var_id", (F.col("_s") / F.col("_n")).alias("mean"))


def classify_enrichment(coo: DataFrame, n_obs: Column, *, a: float, b: float, g: float, q: float) -> DataFrame:
    """(obs_id, var_id) where (x - a) / ((quantile_q + 1)^g - 1) > b.

    Quantiles run over all cells. A denominator of 0 makes a positive numerator
    enriched and any other not. Only stored values are judged: a zero could be
    enriched only for a negative ``a``, which is refused.
    """
    if a < 0:
        raise ValueError("a must not be negative")
    quantiles = zero_aware_quantile(coo, ["var_id"], n_obs, q)
    den = F.pow(F.coalesce("quantile", F.lit(0.0)) + 1, F.lit(g)) - 1
    x = F.col("value") - a
    hit = F.when(den == 0, x > 0).otherwise(x / den > b)
    return coo.join(quantiles, "var_id", "left").where(hit).select("obs_id", "var_id")


def _active_shares(active: DataFrame, memberships: DataFrame) -> DataFrame:
    """(sample, community, var_id, share): the share of a community's cells in which a feature is active."""
    sizes = memberships.groupBy("sample", "community").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    counts = active.select("obs_id", "var_id").join(memberships, "obs_id").groupBy("sample", "community", "var_id").agg(F.count(F.lit(1)).alias("_a"))
    return counts.join(sizes, ["sample", "community"]).select("sample", "community", "var_id", (F.col("_a") / F.col("_n")).alias("share"))


def neighbourhood_activity(active: DataFrame, memberships: DataFrame, *, digits: int | None = None) -> DataFrame:
    """(obs_id, var_id, value): over samples, the sum of the active share of the cell's community.

    ``memberships`` is (sample, obs_id, community). Computed as L D (Lt X): the
    communities are aggregated first, cells are joined back last. Cells that are in
    the same communities have the same row of the result, which is summed, and
    rounded to ``digits`` if wished, once for all of them.
    """
    tables = Scratch(active.sparkSession, "activity")
    times = memberships.where("sample is not null and community is not null").groupBy("obs_id", "sample", "community").agg(F.count(F.lit(1)).alias("_m"))
    cells = tables.save(times.groupBy("obs_id").agg(F.sort_array(F.collect_list(F.struct("sample", "community", "_m"))).alias("_in")), "cells")
    alike = tables.save(cells.select("_in").distinct().withColumn("_alike", F.monotonically_increasing_id()), "alike")
    parts = join_crowded(alike.select("_alike", F.inline("_in")), _active_shares(active, memberships), ["sample", "community"])
    values = parts.groupBy("_alike", "var_id").agg(F.sum(F.col("_m") * F.col("share")).alias("value"))
    if digits is not None:
        values = values.withColumn("value", F.round("value", digits))
    return join_crowded(cells.join(alike, "_in").select("_alike", "obs_id"), values, ["_alike"]).select("obs_id", "var_id", "value")


def denoise(active: DataFrame, communities: DataFrame, threshold: float) -> DataFrame:
    """(obs_id, var_id): every cell of the communities whose active share exceeds the threshold.

    The shares are judged before any cell is joined, so only what is in the result
    is ever written out cell by cell. A cell that is listed twice is twice in it.
    """
    one = communities.select(F.lit(0).alias("sample"), "obs_id", "community")
    kept = _active_shares(active, one).where(F.col("share") > threshold).select("community", "var_id")
    return join_crowded(communities.select("community", "obs_id"), kept, ["community"]).select("obs_id", "var_id")


def one_hot(memberships: DataFrame, vec: str = "codes") -> DataFrame:
    """(obs_id, column): stacked one-hot coding of an array of codes, sample after sample.

    Sample i takes as many columns as its largest code plus one.
    """
    rows = memberships.select("obs_id", F.posexplode(vec).alias("sample", "code"))
    widths = rows.groupBy("sample").agg((F.max("code") + 1).alias("_w"))
    before = Window.orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)  # one row a sample
    offsets = widths.select("sample", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_o"))
    return rows.join(offsets, "sample").select("obs_id", (F.col("_o") + F.col("code")).alias("column"))


def entropy_by_class(coo: DataFrame, obs: DataFrame, class_key: str, type_key: str) -> DataFrame:
    """(class, var_id, entropy, prevalence): base-2 entropy of a feature over the cell types of a class.

    Cell-type means (over all cells of the type within the class) are normalised
    to 1. A feature that is 0 throughout a class has no row. ``prevalence`` is the
    mean of the cell-type means.
    """
    labels = obs.where(F.col(class_key).isNotNull() & F.col(type_key).isNotNull()).select("obs_id", class_key, type_key)
    n = labels.groupBy(class_key, type_key).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    types = n.groupBy(class_key).agg(F.count(F.lit(1)).cast("double").alias("_k"))
    means = coo.join(labels, "obs_id").groupBy(class_key, type_key, "var_id").agg(F.sum("value").alias("_s")).join(n, [class_key, type_key]).withColumn("_m", F.col("_s") / F.col("_n"))
    # H = log2(S) - sum(m log2 m) / S, so one aggregate per (class, feature) is enough
    agg = means.where("_m > 0").groupBy(class_key, "var_id").agg(F.sum("_m").alias("_sum"), F.sum(F.col("_m") * F.log2("_m")).alias("_l"))
    entropy = F.greatest(F.log2("_sum") - F.col("_l") / F.col("_sum"), F.lit(0.0))
    return agg.join(types, class_key).select(class_key, "var_id", entropy.alias("entropy"), (F.col("_sum") / F.col("_k")).alias("prevalence"))


def venn_regions(df: DataFrame, sets: Sequence[str]) -> DataFrame:
    """(region, n): rows in each combination of the boolean columns, as a string of 0 and 1; none in no set."""
    code = F.concat(*[F.coalesce(F.col(c).cast("int"), F.lit(0)).cast("string") for c in sets])
    return df.select(code.alias("region")).where(F.col("region") != "0" * len(sets)).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


def contingency(df: DataFrame, a: str, b: str, *, least: int = 0) -> DataFrame:
    """(a, b, n): rows per pair of categories that reach ``least``."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def frequencies(df: DataFrame, column: str) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / df.where(F.col(column).isNotNull()).agg(F.count(F.lit(1))).scalar())
