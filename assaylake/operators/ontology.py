"""Ontology closure and enrichment."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from assaylake.operators.kernels import benjamini_hochberg
from assaylake.operators.regulation import infer_layer
from assaylake.plans.scratch import Scratch

MAX_DEPTH = 100


def closure(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """(go, ancestor), each term its own ancestor; rounds double the reach and are written to the shared folder."""
    scratch = Scratch(terms.sparkSession, "closure")
    reach = scratch.save(terms.select("go", F.col("go").alias("ancestor")).union(edges.select("child", "parent")).distinct(), "reach0")
    n = reach.count()
    for k in range(1, MAX_DEPTH):
        far = reach.alias("a").join(reach.alias("b"), F.col("a.ancestor") == F.col("b.go")).select("a.go", "b.ancestor").distinct()
        reach = scratch.save(far, f"reach{k}")
        size = reach.count()
        if size == n:
            return reach
        n = size
    raise RuntimeError("the ontology has a cycle")


def depths(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """(go, depth): the longest way up to a root."""
    scratch = Scratch(terms.sparkSession, "depth")
    level = scratch.save(terms.select("go", F.lit(0).alias("depth")), "depth0")
    for k in range(1, MAX_DEPTH):
        up = edges.join(level.select(F.col("go").alias("parent"), F.col("depth")), "parent").groupBy(F.col("child").alias("go")).agg((F.max("depth") + 1).alias("_d"))
        new = scratch.save(level.join(up, "go", "left").select("go", F.coalesce("_d", F.lit(0)).alias("depth")), f"depth{k}")
        if new.join(level.withColumnRenamed("depth", "_old"), "go").where("depth <> _old").limit(1).count() == 0:
            return new
        level = new
    raise RuntimeError("the ontology has a cycle")


def propagate(assoc: DataFrame, reach: DataFrame) -> DataFrame:
    """(ns, gene, go): annotations carried to all ancestors, distinct."""
    return assoc.join(reach, "go").select("ns", "gene", F.col("ancestor").alias("go")).distinct()


@F.pandas_udf(DoubleType())
def fisher_exact(k: pd.Series, n: pd.Series, big_k: pd.Series, big_n: pd.Series) -> pd.Series:
    """Two-sided p of k of n drawn from big_n with big_k marked: the mass of all tables no likelier."""
    lg = np.vectorize(math.lgamma, otypes=[float])
    out = []
    for a, b, c, d in zip(k.astype(int), n.astype(int), big_k.astype(int), big_n.astype(int)):
        lo = max(0, b + c - d)
        i = np.arange(lo, min(b, c) + 1.0)
        # log of C(c, i) C(d - c, b - i), up to a constant that the normalisation removes
        weight = -(lg(i + 1) + lg(c - i + 1) + lg(b - i + 1) + lg(d - c - b + i + 1))
        p = np.exp(weight - weight.max())
        out.append(min(1.0, float(p[p <= p[a - lo] * (1 + 1e-7)].sum() / p.sum())))
    return pd.Series(out, dtype=float)


def go_counts(assoc: DataFrame, population: DataFrame, study: DataFrame) -> DataFrame:
    """(study, ns, go, study_count, pop_count, study_n, pop_n) of a propagated association; study is (study, gene)."""
    pop = population.select("gene").distinct()
    genes = study.join(pop, "gene", "left_semi").distinct()
    pop_n = pop.agg(F.count(F.lit(1))).scalar()
    study_n = genes.groupBy("study").agg(F.count(F.lit(1)).alias("study_n"))
    p = assoc.join(pop, "gene", "left_semi").groupBy("ns", "go").agg(F.count_distinct("gene").alias("pop_count"))
    s = assoc.join(genes, "gene").groupBy("study", "ns", "go").agg(F.count_distinct("gene").alias("study_count"))
    return s.join(p, ["ns", "go"]).join(study_n, "study").withColumn("pop_n", pop_n)


def enrichment(terms: DataFrame, edges: DataFrame, assoc: DataFrame, population: DataFrame, study: DataFrame, *, alpha: float = 0.05, propagate_counts: bool = True, include_not_significant: bool = False) -> DataFrame:
    """Fisher's exact test of every term for every study, adjusted per study and namespace.

    (study, NS, GO, name, depth, enriched, pop_count, study_count, p_corrected, p_uncorrected).
    """
    a = propagate(assoc, closure(terms, edges)) if propagate_counts else assoc.distinct()
    counts = go_counts(a, population, study).withColumn("p_uncorrected", fisher_exact("study_count", "study_n", "pop_count", "pop_n"))
    adjusted = benjamini_hochberg(counts, "p_uncorrected", partition=["study", "ns"], out="p_corrected")
    rows = adjusted.join(terms.select("go", "name"), "go").join(depths(terms, edges), "go")
    enriched = F.col("study_count") / F.col("study_n") > F.col("pop_count") / F.col("pop_n")
    out = rows.select("study", F.col("ns").alias("NS"), F.col("go").alias("GO"), "name", "depth", enriched.alias("enriched"), "pop_count", "study_count", "p_corrected", "p_uncorrected")
    return out if include_not_significant else out.where(F.col("p_corrected") <= alpha)


def top_marker_enrichment(terms: DataFrame, edges: DataFrame, assoc: DataFrame, population: DataFrame, markers: DataFrame, *, symbol_ids: DataFrame | None = None, **kwargs) -> DataFrame:
    """Enrichment of the markers (group, var_id) of every group at once, by symbol or by the ids of (gene, extra)."""
    study = markers.select(F.col("group").alias("study"), F.col("var_id").alias("gene"))
    if symbol_ids is not None:
        study = study.join(symbol_ids, "gene").where("extra is not null").select("study", F.col("extra").alias("gene"))
    return enrichment(terms, edges, assoc, population, study, **kwargs)


def descendants(terms: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """(root, go): all terms below the terms of the given names, those included."""
    roots = terms.join(names, "name").select(F.col("go").alias("ancestor"), F.col("name").alias("root"))
    return closure(terms, edges).join(roots, "ancestor").select("root", "go").distinct()


def go_matrix(terms: DataFrame, edges: DataFrame, assoc: DataFrame, population: DataFrame, names: DataFrame) -> DataFrame:
    """(name, binname): the genes of each root and namespace, named <root>_<namespace>."""
    genes = assoc.join(population.select("gene"), "gene", "left_semi").join(descendants(terms, edges, names), "go")
    return genes.select(F.concat_ws("_", "root", "ns").alias("name"), F.col("gene").alias("binname")).distinct()


def go_infer_layer(coo: DataFrame, terms: DataFrame, edges: DataFrame, assoc: DataFrame, population: DataFrame, names: DataFrame) -> DataFrame:
    """(obs_id, var_id, value): mean value per cell of each root's genes."""
    return infer_layer(coo, go_matrix(terms, edges, assoc, population, names), mode="mean")


def terms_for_plot(results: DataFrame, n: int) -> DataFrame:
    """All rows of the terms among the n least p-values of any namespace, with -log10 p."""
    from pyspark.sql import Window

    w = Window.partitionBy("NS").orderBy("p_corrected", "GO")
    named = results.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select("name").distinct()
    return results.join(named, "name", "left_semi").withColumn("neg_log10_p", -F.log10(F.greatest("p_corrected", F.lit(1e-300))))
