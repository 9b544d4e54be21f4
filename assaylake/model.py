"""Handles over sparse data: an assay is a set of lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Pct:
    """A threshold given as a percentile of the unfiltered totals."""

    q: float


@dataclass(frozen=True)
class LayerSpec:
    """What to do with a raw layer; applied by ``operators.layers.transform``.

    The steps run in the fixed order idf, row scaling (by the raw row sum or by
    the L2 norm, never both), log1p, rank scalars, feature choice, scalar,
    binarisation.
    """

    layer: str
    normalize_with_obs_counts: bool = False
    log_transform: bool = False
    norm_total: float = 1e4
    idf_transform: bool = False
    normalize_with_l2_norm: bool = False
    feature_active_threshold: float = 0.0
    scalar: float = 1.0
    features: DataFrame | None = field(default=None, compare=False)
    rank_scalars: DataFrame | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if self.normalize_with_obs_counts and self.normalize_with_l2_norm:
            raise ValueError("scale rows by their sum or by their L2 norm, not by both")
        if self.idf_transform and self.rank_scalars is not None:
            raise ValueError("rank scalars can't be combined with idf")

    def with_(self, **changes) -> "LayerSpec":
        return replace(self, **changes)


@dataclass(frozen=True)
class Assay:
    """Cells, features and sparse layers; every operation returns a new handle.

    obs     obs_id STRING plus metadata
    var     var_id STRING plus metadata
    layers  name -> (obs_id, var_id, value); an absent row is a zero
    obsm    name -> (obs_id, vec ARRAY<DOUBLE>)
    obsp    name -> (src, dst, weight)
    uns     named tables and scalars
    """

    obs: DataFrame
    var: DataFrame
    layers: dict[str, DataFrame] = field(default_factory=dict)
    obsm: dict[str, DataFrame] = field(default_factory=dict)
    obsp: dict[str, DataFrame] = field(default_factory=dict)
    uns: dict = field(default_factory=dict)

    def layer(self, name: str) -> DataFrame:
        if name not in self.layers:
            raise KeyError(f"no layer {name!r}; there are {sorted(self.layers)}")
        return self.layers[name]

    def with_layer(self, name: str, coo: DataFrame) -> "Assay":
        return replace(self, layers={**self.layers, name: coo})

    def with_obs(self, obs: DataFrame) -> "Assay":
        return replace(self, obs=obs)

    def with_var(self, var: DataFrame) -> "Assay":
        return replace(self, var=var)

    def with_uns(self, **tables) -> "Assay":
        return replace(self, uns={**self.uns, **tables})
