"""The numbers behind plots, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.operators.kernels import grouped_quantiles

#: Blocks of keys on each side of a table of pairs.
PAIR_BLOCKS = 8


def histogram(df: DataFrame, value: str, bins: int, *, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, n): bins of equal width over the overall range; the last holds its right end."""
    low, high = df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()
    b = F.coalesce(F.least(F.floor(F.try_divide((F.col(value) - low) * bins, high - low)), F.lit(bins - 1)), F.lit(0)).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def passing_fraction(df: DataFrame, value: str, low: float) -> DataFrame:
    return df.agg(F.avg((F.col(value) > low).cast("double")).alias("fraction"))


def whiskers(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by, q1, median, q3, low, high): quartiles, and the outermost values within 1.5 times their distance."""
    q = grouped_quantiles(df, by, value, q1=0.25, median=0.5, q3=0.75)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return df.join(q, list(by)).groupBy(*by, "q1", "median", "q3").agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"))


def density(df: DataFrame, value: str, *, points: int = 100, factor: float = 0.25, bins: int = 4_096) -> DataFrame:
    """(x, density): Gaussian kernel estimate from a histogram, so the driver sees ``bins`` numbers at most."""
    m = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.stddev_samp(value).alias("sd")).first()
    spark = df.sparkSession
    if m.lo is None or m.hi == m.lo:
        return spark.createDataFrame([], "x double, density double")
    h = histogram(df, value, bins).collect()
    centre = m.lo + (np.array([r.bin for r in h]) + 0.5) * (m.hi - m.lo) / bins
    n = np.array([r.n for r in h], float)
    band = m.sd * factor
    x = np.linspace(m.lo, m.hi, points)
    d = (np.exp(-0.5 * ((x[:, None] - centre) / band) ** 2) * n).sum(1) / (n.sum() * band * np.sqrt(2 * np.pi))
    return spark.createDataFrame(pd.DataFrame({"x": x, "density": d}))


def heatmap(means: DataFrame, row: str, column: str, *, value: str = "mean", scale: str = "max") -> DataFrame:
    """Values of each row divided by its maximum or sum, or moved to 0..1 (minmax)."""
    w = Window.partitionBy(row)
    v = F.col(value)
    out = {"max": lambda: F.try_divide(v, F.max(v).over(w)), "sum": lambda: F.try_divide(v, F.sum(v).over(w)), "minmax": lambda: F.try_divide(v - F.min(v).over(w), F.max(v).over(w) - F.min(v).over(w))}
    if scale not in out:
        raise ValueError(f"scale is one of {sorted(out)}")
    return means.select(row, column, F.coalesce(out[scale](), F.lit(0.0)).alias("z"))


def embedding_points(embedding: DataFrame, colour: DataFrame) -> DataFrame:
    """(obs_id, x, y, colour) to be drawn in the order of colour, null first."""
    return embedding.select("obs_id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y")).join(colour, "obs_id", "left")


def hex_to_rgb(df: DataFrame, column: str) -> DataFrame:
    part = lambda i: F.conv(F.substring(F.ltrim(F.col(column), F.lit("#")), 2 * i + 1, 2), 16, 10).cast("int")
    return df.withColumns({"r": part(0), "g": part(1), "b": part(2)})


def signed_power(z: DataFrame, value: str = "z") -> DataFrame:
    """sign(z) (10 |z|)^(1 / 1.3)."""
    return z.withColumn(value, F.signum(value) * F.pow(F.lit(10.0) * F.abs(value), F.lit(1 / 1.3)))


def dynamics_calls(df: DataFrame, group: str, *, res: str = "res", p: str = "pval", lfc: str = "lfc", activity: str = "activity", threshold: float = 0.0, lfc_threshold: float = 0.0, alpha: float = 0.05) -> DataFrame:
    """(group, up, down, ns): features that are active, significant and large enough, by sign."""
    hit = (F.col(activity) > threshold) & (F.col(p) < alpha) & (F.abs(lfc) > lfc_threshold)
    return df.groupBy(group).agg(F.count_if(hit & (F.col(res) > 0)).alias("up"), F.count_if(hit & (F.col(res) < 0)).alias("down"), F.count_if(~hit).alias("ns"))


def index_pairs(df: DataFrame, key: str) -> DataFrame:
    """(a, b) of all keys a < b of a list: every pair is a row of the result, so it is meant for short lists.

    Each key is sent to the cells of its row (or column) in a square of blocks,
    which makes the pairing an equi-join of cells of like size.
    """
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct()
    blocks = F.sequence(F.lit(0), F.lit(PAIR_BLOCKS - 1))
    mine = F.pmod(F.xxhash64("k"), F.lit(PAIR_BLOCKS)).cast("int")
    a = keys.select(F.col("k").alias("a"), mine.alias("i"), F.explode(blocks).alias("j"))
    b = keys.select(F.col("k").alias("b"), mine.alias("j"), F.explode(blocks).alias("i"))
    return a.join(b, ["i", "j"]).where("a < b").select("a", "b")
