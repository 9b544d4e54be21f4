"""Special functions that Spark SQL lacks, as Arrow-batched functions, and tail probabilities."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


@pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return pd.Series(_erfc(x.to_numpy(float)))


@pandas_udf(DoubleType())
def lgamma(x: pd.Series) -> pd.Series:
    return pd.Series(_lgamma(x.to_numpy(float)))


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz), vectorised."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        tiny = 1e-300
        c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        f = d.copy()
        for m in range(1, 400):
            for up in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + up * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + up / np.where(np.abs(c) < tiny, tiny, c)
                f = f * c * d
            if np.nanmax(np.abs(c * d - 1), initial=0) < 1e-14:
                break
    out = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, front * f))
    return np.where(swap, 1 - out, out)


@pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t; NaN where t or df is."""
    t, df = t.to_numpy(float), df.to_numpy(float)
    with np.errstate(all="ignore"):
        return pd.Series(np.where(np.isnan(t) | np.isnan(df), np.nan, beta_inc(df / 2, np.full_like(df, 0.5), df / (df + t * t))))


def chi2_sf_1(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return erfc(F.sqrt(F.greatest(x, F.lit(0.0)) / 2))


def normal_two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / F.sqrt(F.lit(2.0)))
