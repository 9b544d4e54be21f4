"""Regulatory links, region queries and layers inferred from links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.operators.kernels import asof_join, interval_join, matmul

WINDOW = 1 << 16


def region_query(features: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Features that overlap one half-open region."""
    return features.where((F.col("chr") == chrom) & (F.col("start") < end) & (F.col("end") > start))


def gene_query(features: DataFrame, reference: DataFrame, name: str) -> DataFrame:
    """Features that overlap a gene, by the first row of that name."""
    gene = reference.where(F.col("id") == name).groupBy("id").agg(F.min(F.struct("chr", "start", "end")).alias("g")).select(F.col("g.*"))
    return overlaps(features, gene, "f", "g").select("f.*")


def overlaps(a: DataFrame, b: DataFrame, left: str = "a", right: str = "b", *, width: int = WINDOW) -> DataFrame:
    """All pairs of overlapping rows as two structs, set at a time."""
    return interval_join(a, b, width=width).select(F.col("a").alias(left), F.col("b").alias(right))


def ensure_promoters(links: DataFrame, bins: DataFrame, genes: DataFrame) -> DataFrame:
    """(name, binname, score, pval, qval): the links, plus each gene's own promoter bin where it is missing.

    A promoter's bin is the one with the largest start <= promoter, if it ends at
    or after it; a promoter before the first bin has none. Added rows get score 1,
    pval 0, qval 0.
    """
    b = bins.select("chr", F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("var_id").alias("binname"))
    g = genes.where("promoter is not null and chr is not null").select(F.col("var_id").alias("name"), "chr", F.col("promoter").cast("long").alias("promoter"))
    hit = asof_join(g, b, on="chr", at="promoter", start="_start", width=WINDOW * 16, carry=["_end", "binname"]).where(F.col("promoter") <= F.col("_end"))
    new = hit.select("name", "binname").distinct().join(links.select("name", "binname"), ["name", "binname"], "left_anti")
    rows = new.select("name", "binname", F.lit(1.0).alias("score"), F.lit(0.0).alias("pval"), F.lit(0.0).alias("qval"))
    return links.select("name", "binname", "score", "pval", "qval").unionByName(rows)


def links_of(links: DataFrame, name: str) -> DataFrame:
    return links.where(F.col("name") == name)


def regulatory_matrix(links: DataFrame, genes: DataFrame, bins: DataFrame) -> DataFrame:
    """(name, binname), distinct, restricted to both lists (columns var_id)."""
    g, b = genes.select(F.col("var_id").alias("name")), bins.select(F.col("var_id").alias("binname"))
    return links.select("name", "binname").join(g, "name", "left_semi").join(b, "binname", "left_semi").distinct().select("name", "binname")


def matrix_from_memberships(features: DataFrame, group: str) -> DataFrame:
    """(name, binname): features of each group as a 0/1 matrix in long form."""
    return features.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("name"), F.col("var_id").alias("binname")).distinct()


def infer_layer(coo: DataFrame, matrix: DataFrame, *, mode: str = "mean") -> DataFrame:
    """(obs_id, var_id, value): for every name its bins' values per cell, summed, averaged over all bins, or their maximum."""
    m = matrix.select("name", "binname")
    if mode == "max":
        # implicit zeros take part: values below 0 only count if a cell holds all bins
        n = m.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
        rows = coo.join(m, F.col("var_id") == F.col("binname")).groupBy("obs_id", "name").agg(F.max("value").alias("_m"), F.count(F.lit(1)).alias("_k")).join(n, "name")
        return rows.select("obs_id", F.col("name").alias("var_id"), F.when(F.col("_k") < F.col("_n"), F.greatest("_m", F.lit(0.0))).otherwise(F.col("_m")).alias("value"))
    if mode not in ("sum", "mean"):
        raise ValueError("mode is sum, mean or max")
    right = m.select(F.col("binname").alias("var_id"), "name", F.lit(1.0).alias("value"))
    out = matmul(coo, right, row="obs_id", inner="var_id", col="name").withColumnRenamed("name", "var_id")
    if mode == "sum":
        return out
    n = m.groupBy(F.col("name").alias("var_id")).agg(F.count(F.lit(1)).alias("_n"))
    return out.join(n, "var_id").select("obs_id", "var_id", (F.col("value") / F.col("_n")).alias("value"))
