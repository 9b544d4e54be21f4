"""Projection, filtering and metadata of assays."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.cleaning import clean_chrom  # noqa: F401  (part of the public surface)
from assaylake.model import Assay, Pct
from assaylake.operators.kernels import order_statistic_quantile, transposed
from assaylake.plans.scratch import Scratch

Bound = float | int | Pct | None


def totals(entities: DataFrame, coo: DataFrame, key: str, out: str = "total") -> DataFrame:
    """``entities`` with the sum of a layer per row; one without values has 0."""
    sums = coo.groupBy(key).agg(F.sum("value").alias(out))
    return entities.join(sums, key, "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def add_metadata(assay: Assay, counts: dict[str, str], *, var_locations: bool = True) -> Assay:
    """Totals ``<name>_total_counts`` on cells and features, and chr, start and end from feature names."""
    obs, var = assay.obs, assay.var
    for layer, name in counts.items():
        obs = totals(obs, assay.layer(layer), "obs_id", f"{name}_total_counts")
        var = totals(var, assay.layer(layer), "var_id", f"{name}_total_counts")
    if var_locations:
        part = F.split("var_id", "[:-]")
        var = var.withColumns({"chr": F.get(part, F.lit(0)), "start": F.get(part, F.lit(1)).try_cast("int"), "end": F.get(part, F.lit(2)).try_cast("int")})
    return assay.with_obs(obs).with_var(var)


def _limit(entities: DataFrame, column: str, bound: Bound) -> float | None:
    if isinstance(bound, Pct):
        return entities.limit(1).select(order_statistic_quantile(entities, column, bound.q / 100)).first()[0]
    return bound


def _within(column: str, low: float | None, high: float | None) -> Column:
    keep = F.lit(True)
    if low is not None:
        keep = keep & (F.col(column) > low)
    if high is not None:
        keep = keep & (F.col(column) < high)
    return keep


def filter_assay(
    assay: Assay, layers: Sequence[str], min_obs: Sequence[Bound], min_var: Sequence[Bound], *, max_obs: Sequence[Bound] | None = None, max_var: Sequence[Bound] | None = None,
    iterate: bool = True, purge: bool = False, max_rounds: int = 100,
) -> Assay:
    """Marks (``exclude``) or drops cells and features whose totals leave the open interval of their bounds.

    Bounds given as percentiles are resolved once, on the unfiltered totals. Cells
    are judged first, then features over the cells that remain, and so on until a
    round drops nothing (or once, with ``iterate=False``). What remains after each
    round, the values included, is written to the shared folder: plans don't grow,
    and later rounds read less.
    """
    none = [None] * len(layers)
    bounds = {}
    for side, key, entities, low, high in (("obs", "obs_id", assay.obs, min_obs, max_obs or none), ("var", "var_id", assay.var, min_var, max_var or none)):
        for layer, lo, hi in zip(layers, low, high):
            t = totals(entities.select(key), assay.layer(layer), key) if isinstance(lo, Pct) or isinstance(hi, Pct) else None
            bounds[side, layer] = (_limit(t, "total", lo) if t is not None else lo, _limit(t, "total", hi) if t is not None else hi)
    scratch = Scratch(assay.obs.sparkSession, "filter")
    obs, var = assay.obs.select("obs_id"), assay.var.select("var_id")
    left = {n: assay.layer(n).select("obs_id", "var_id", "value") for n in layers}
    if iterate:
        left = {n: scratch.save(c, f"layer{i}-0") for i, (n, c) in enumerate(left.items())}
    kept = None
    for k in range(1, max_rounds + 1):
        for layer in layers:
            obs = totals(obs, left[layer].join(obs, "obs_id", "left_semi"), "obs_id").where(_within("total", *bounds["obs", layer])).select("obs_id")
        obs = scratch.save(obs, f"obs{k}")
        for layer in layers:
            var = totals(var, left[layer].join(obs, "obs_id", "left_semi").join(var, "var_id", "left_semi"), "var_id").where(_within("total", *bounds["var", layer])).select("var_id")
        var = scratch.save(var, f"var{k}")
        if not iterate:
            break
        size = (obs.count(), var.count())
        if size == kept:
            break
        kept = size
        for i, layer in enumerate(layers):  # the next round reads what is left
            left[layer] = scratch.save(left[layer].join(obs, "obs_id", "left_semi").join(var, "var_id", "left_semi"), f"layer{i}-{k}")
            scratch.drop(f"layer{i}-{k - 1}")
    else:
        raise RuntimeError(f"the filter still drops rows after {max_rounds} rounds")
    if purge:
        cut = {n: c.join(obs, "obs_id", "left_semi").join(var, "var_id", "left_semi") for n, c in assay.layers.items()}
        return replace(assay, obs=assay.obs.join(obs, "obs_id", "left_semi"), var=assay.var.join(var, "var_id", "left_semi"), layers=cut)
    mark = lambda df, keep, key: df.drop("exclude").join(keep.withColumn("_in", F.lit(True)), key, "left").withColumn("exclude", F.col("_in").isNull()).drop("_in")
    return assay.with_obs(mark(assay.obs, obs, "obs_id")).with_var(mark(assay.var, var, "var_id"))


def remove_component(embedding: DataFrame, index: int, vec: str = "vec") -> DataFrame:
    """The embedding without one element (counted from 0); vectors too short for it are an error."""
    c = F.col(vec)
    inside = F.when(F.size(c) > index, F.filter(F.transform(c, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["i"] != index)["x"])
    return embedding.withColumn(vec, F.coalesce(inside, F.raise_error(F.lit(f"no element {index}"))))


def pick_features(coo: DataFrame, *, names: DataFrame | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """(var_id): features of a list, or with a total strictly between the bounds."""
    if names is not None:
        return coo.select("var_id").distinct().join(names.select("var_id"), "var_id", "left_semi")
    return coo.groupBy("var_id").agg(F.sum("value").alias("_t")).where(_within("_t", low, high)).select("var_id")


def set_missing_to_zero(assay: Assay, features: DataFrame) -> Assay:
    """Features of the list that the assay lacks are appended; their values are the implicit zeros."""
    new = features.select("var_id").distinct().join(assay.var, "var_id", "left_anti")
    return assay.with_var(assay.var.unionByName(new, allowMissingColumns=True))


def rename_layer(assay: Assay, old: str, new: str) -> Assay:
    layers = {k: v for k, v in assay.layers.items() if k != old}
    return replace(assay, layers={**layers, new: assay.layer(old)})


def transpose(assay: Assay, layers: Sequence[str]) -> Assay:
    """Cells become features and features cells, in the raw layers."""
    obs = assay.var.withColumnRenamed("var_id", "obs_id")
    var = assay.obs.withColumnRenamed("obs_id", "var_id")
    return Assay(obs, var, {n: transposed(assay.layer(n)) for n in layers})


def copy_to_obs(obs: DataFrame, coo: DataFrame, *, binarize_above: float | None = None, out: str = "copied_data") -> DataFrame:
    """Each cell's sum over a (transformed) layer, or its number of values above a threshold."""
    rows = coo if binarize_above is None else coo.where(F.col("value") > binarize_above).withColumn("value", F.lit(1.0))
    return totals(obs, rows, "obs_id", out)


def first_reference(reference: DataFrame) -> DataFrame:
    """One row per id: the first by (chr, start, end, strand)."""
    order = F.struct("chr", "start", "end", "strand", "extra")
    return reference.where("id is not null").groupBy("id").agg(F.min(order).alias("_r")).select("id", "_r.*")


def add_promoter_metadata(var: DataFrame, reference: DataFrame, *, promoter: bool = True) -> DataFrame:
    """Location of every gene; genes the reference lacks get 0 and a null chromosome."""
    ref = first_reference(reference).select(F.col("id").alias("var_id"), "chr", "strand", "start", "end")
    out = var.drop("chr", "strand", "start", "end").join(ref, "var_id", "left").na.fill(0, ["start", "end"])
    at = F.when(F.col("strand").isNull(), F.lit(0)).when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end"))
    return out.withColumn("promoter", at) if promoter else out


def symbol_to_id(reference: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, extra): the identifier of each symbol, the last by position if there are several, null without."""
    last = reference.where("id is not null").groupBy("id").agg(F.max_by("extra", F.struct("chr", "start", "end", "strand", "extra")).alias("extra"))
    return genes.join(last, genes["gene"] == last["id"], "left").select("gene", "extra")


def feature_positions(features: DataFrame, wanted: DataFrame) -> DataFrame:
    """(var_id, position): the first position of each wanted name in (var_id, position), -1 if it has none."""
    first = features.groupBy("var_id").agg(F.min("position").alias("position"))
    return wanted.select("var_id").distinct().join(first, "var_id", "left").na.fill(-1, ["position"])


def align_features(a: DataFrame, b: DataFrame) -> DataFrame:
    """(var_id, pos_a, pos_b) of the names in both lists, at their first positions."""
    fa = a.groupBy("var_id").agg(F.min("position").alias("pos_a"))
    return fa.join(b.groupBy("var_id").agg(F.min("position").alias("pos_b")), "var_id")


def active_features(coo: DataFrame, *, above: float = 0.0, threshold: int = 0) -> DataFrame:
    """(var_id, n_cells): features above a value in more than ``threshold`` cells."""
    return coo.where(F.col("value") > above).groupBy("var_id").agg(F.count(F.lit(1)).alias("n_cells")).where(F.col("n_cells") > threshold)


def dense_activity(obs: DataFrame, features: Sequence[str], coo: DataFrame, *, above: float = 0.0) -> DataFrame:
    """(obs_id, active ARRAY<BOOLEAN>) over the listed features, a row for every cell."""
    hit = coo.where(F.col("var_id").isin(list(features)) & (F.col("value") > above))
    seen = hit.groupBy("obs_id").agg(F.collect_set("var_id").alias("_v"))
    flags = F.array(*[F.coalesce(F.array_contains("_v", f), F.lit(False)) for f in features])
    return obs.select("obs_id").join(seen, "obs_id", "left").select("obs_id", flags.alias("active"))


def activity_code(obs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(obs_id, code): the sum of 10^i over the active columns."""
    parts = [F.coalesce(F.col(c).cast("long"), F.lit(0)) * (10**i) for i, c in enumerate(columns)]
    return obs.select("obs_id", sum(parts[1:], parts[0]).alias("code"))


def stack_assays(assays: Sequence[Assay], names: Sequence[str], layer: str = "X", keep: int = 0) -> Assay:
    """One assay over the cells and features that all share, each input a layer of it."""
    obs, var = assays[keep].obs, assays[keep].var
    for a in assays:
        obs, var = obs.join(a.obs.select("obs_id"), "obs_id", "left_semi"), var.join(a.var.select("var_id"), "var_id", "left_semi")
    cut = {n: a.layer(layer).join(obs.select("obs_id"), "obs_id", "left_semi").join(var.select("var_id"), "var_id", "left_semi") for n, a in zip(names, assays)}
    if obs.limit(1).count() == 0 or var.limit(1).count() == 0:
        raise ValueError("the assays share no cells or no features")
    return Assay(obs, var, cut)


def concat_features(layers: dict[str, DataFrame]) -> DataFrame:
    """Layers side by side: features are prefixed with their layer's name."""
    parts = [coo.select("obs_id", F.concat(F.lit(f"{n}:"), "var_id").alias("var_id"), "value") for n, coo in layers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def add_metabin_metadata(assay: Assay, turned: Assay, membership: str, *, embedding: str | None = None, tree: str | None = "community_tree") -> Assay:
    """The feature clusters of a transposed assay as ``metabin`` of the features, with their embedding and tree if named.

    ``turned`` has the features of ``assay`` as its cells: the same names, no fewer
    and no more, or it is an error. The embedding goes to ``obsm`` under
    ``var:X_embedding``, the tree to ``uns`` under ``metabin_community_tree``.
    """
    if membership not in turned.obs.columns:
        raise ValueError(f"no column {membership!r}")
    ids = turned.obs.select(F.col("obs_id").alias("var_id"))
    if assay.var.select("var_id").join(ids, "var_id", "full").count() != assay.var.join(ids, "var_id").count():
        raise ValueError("the assays aren't transposes of each other")
    out = assay.with_var(assay.var.drop("metabin").join(turned.obs.select(F.col("obs_id").alias("var_id"), F.col(membership).alias("metabin")), "var_id"))
    if embedding is not None:
        if embedding not in turned.obsm:
            raise ValueError(f"no embedding {embedding!r}")
        out = replace(out, obsm={**out.obsm, "var:X_embedding": turned.obsm[embedding].withColumnRenamed("obs_id", "var_id")})
    if tree is not None:
        if tree not in turned.uns:
            raise ValueError(f"no {tree!r}")
        out = out.with_uns(metabin_community_tree=turned.uns[tree])
    return out


def same_grid(assays: Sequence[Assay]) -> list[Assay]:
    """All assays with the grid and summary (``uns``) of the first one."""
    first = {k: assays[0].uns[k] for k in ("grid", "summary")}
    return [assays[0], *[a.with_uns(**first) for a in assays[1:]]]
