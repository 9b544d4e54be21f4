"""Landscapes on a pixel grid, image filters, and dynamics over them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.operators.kernels import midrank, order_statistic_quantile
from assaylake.operators.summaries import mode_by_group
from assaylake.plans.scratch import Scratch

RESOLUTION = (300, 300)


def grid_axes(points: DataFrame, resolution: tuple[int, int] = RESOLUTION) -> DataFrame:
    """(axis, i, line): evenly spaced lines from the least to the greatest coordinate of each axis; points is (obs_id, x, y)."""
    m = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).toDF("x0", "x1", "y0", "y1")
    out = []
    for axis, n in zip("xy", resolution):
        i = m.select(F.lit(axis).alias("axis"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), F.col(f"{axis}0").alias("a"), F.col(f"{axis}1").alias("b"))
        out.append(i.select("axis", "i", F.when(F.col("i") == n - 1, F.col("b")).otherwise(F.col("a") + F.col("i") * ((F.col("b") - F.col("a")) / max(n - 1, 1))).alias("line")))
    return out[0].unionByName(out[1])


def _index(x: Column, low: Column, high: Column, n: int) -> Column:
    """Number of the first n - 1 lines that lie strictly below x, safe at rounding edges."""
    step = (high - low) / max(n - 1, 1)
    line = lambda i: low + i * step
    guess = F.when(step > 0, F.ceil((x - low) / step)).otherwise(F.lit(0)).cast("long")
    down = F.when((guess > 0) & (line(guess - 1) >= x), guess - 1).otherwise(guess)
    up = F.when(line(down) < x, down + 1).otherwise(down)
    return F.greatest(F.least(up, F.lit(n - 1)), F.lit(0)).cast("int")


def assign_pixels(points: DataFrame, resolution: tuple[int, int] = RESOLUTION) -> DataFrame:
    """Adds ix and iy to (obs_id, x, y)."""
    ends = {f"_{c}{n}": points.agg(f(c)).scalar() for c in "xy" for n, f in ((0, F.min), (1, F.max))}
    with_ends = points.withColumns(ends)
    return with_ends.withColumns({f"i{c}": _index(F.col(c), F.col(f"_{c}0"), F.col(f"_{c}1"), n) for c, n in zip("xy", resolution)}).drop(*ends)


def grid_numerical(coo: DataFrame, pixels: DataFrame, min_cells: int) -> DataFrame:
    """(var_id, ix, iy, z, n_cells): pixel means over all cells of pixels with more than ``min_cells``; only non-zero sums are rows."""
    n = pixels.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n_cells")).where(F.col("n_cells") > min_cells)
    sums = coo.join(pixels.select("obs_id", "ix", "iy"), "obs_id").groupBy("var_id", "ix", "iy").agg(F.sum("value").alias("_s"))
    return sums.join(n, ["ix", "iy"]).select("var_id", "ix", "iy", (F.col("_s") / F.col("n_cells")).alias("z"), "n_cells")


def grid_categorical(pixels: DataFrame, labels: DataFrame, category: str, min_cells: int) -> DataFrame:
    """(ix, iy, category, n_cells): the most frequent category (the smallest at a tie); null where there are too few cells."""
    rows = pixels.join(labels.select("obs_id", category), "obs_id")
    n = rows.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n_cells"))
    return n.join(mode_by_group(rows, ["ix", "iy"], category), ["ix", "iy"], "left").select("ix", "iy", F.when(F.col("n_cells") > min_cells, F.col("mode")).alias(category), "n_cells")


def median_filter(z: np.ndarray, size: tuple[int, int] = (3, 3)) -> np.ndarray:
    """Median of the known values around each pixel; odd kernels; outside is unknown."""
    if size[0] % 2 == 0 or size[1] % 2 == 0:
        raise ValueError("kernels are odd")
    padded = np.pad(z, [(s // 2, s // 2) for s in size], constant_values=np.nan)
    windows = np.lib.stride_tricks.sliding_window_view(padded, size).reshape(*z.shape, -1)
    with np.errstate(all="ignore"):
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return np.nanmedian(windows, axis=-1)


def gaussian_filter_1d(z: np.ndarray, sigma: float, axis: int = -1, *, truncate: float = 4.0, mode: str = "edge") -> np.ndarray:
    """Convolution along one axis; ``mode`` is a padding of ``numpy.pad``."""
    r = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    z = np.moveaxis(z, axis, -1)
    padded = np.pad(z, [(0, 0)] * (z.ndim - 1) + [(r, r)], mode=mode)
    out = np.lib.stride_tricks.sliding_window_view(padded, 2 * r + 1, axis=-1) @ k
    return np.moveaxis(out, -1, axis)


def gaussian_filter(z: np.ndarray, sigma: float | tuple[float, float], *, truncate: float = 4.0, mode: str = "edge") -> np.ndarray:
    for axis, s in enumerate(sigma if isinstance(sigma, tuple) else (sigma,) * z.ndim):
        if s > 0:
            z = gaussian_filter_1d(z, s, axis, truncate=truncate, mode=mode)
    return z


def bilinear(z: np.ndarray, factor: int) -> np.ndarray:
    """The image with ``factor`` times as many lines on each axis, interpolated linearly."""
    for axis in (0, 1):
        n = z.shape[axis]
        at = np.linspace(0, n - 1, n * factor)
        i = np.minimum(at.astype(int), max(n - 2, 0))
        j = np.minimum(i + 1, n - 1)
        w = np.expand_dims(at - i, 1 - axis)
        z = np.take(z, i, axis) * (1 - w) + np.take(z, j, axis) * w
    return z


def smoothed_images(z: DataFrame, known: DataFrame, resolution: tuple[int, int], *, gauss: tuple[float, float] | float | None = None, median: tuple[int, int] | None = (3, 3), passes: int = 2, nan_fill: float = 0.0) -> DataFrame:
    """(var_id, image ARRAY<DOUBLE>): row by row, median passes and then a Gaussian over known pixels with its weights renormalised.

    ``z`` is (var_id, ix, iy, z) of non-zero pixels, ``known`` (ix, iy) all pixels
    that hold a value; both are as small as the grid. One task per feature. Unknown
    pixels are 0, but after the Gaussian those it doesn't reach are ``nan_fill``.
    """
    pairs = known.agg(F.collect_list(F.struct("ix", "iy"))).first()[0]  # at most resolution[0] * resolution[1]
    mask = np.zeros(resolution, bool)
    if pairs:
        mask[tuple(np.array([(p.ix, p.iy) for p in pairs]).T)] = True
    sigma = gauss if gauss is None or isinstance(gauss, tuple) else (gauss, gauss)
    norm = gaussian_filter(mask.astype(float), sigma) if sigma else None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.where(mask, 0.0, np.nan)
        image[pdf["ix"], pdf["iy"]] = pdf["z"]
        for _ in range(passes if median else 0):
            image = np.where(mask, median_filter(image, median), np.nan)
        image = np.where(mask, image, 0.0)
        if sigma:
            far = norm <= 1e-5
            image = np.where(far, nan_fill, gaussian_filter(image, sigma) / np.where(far, 1.0, norm))
        return pd.DataFrame({"var_id": [pdf["var_id"].iloc[0]], "image": [image.ravel()]})

    return z.select("var_id", "ix", "iy", "z").groupBy("var_id").applyInPandas(run, "var_id string, image array<double>")


def _ends(images: DataFrame) -> tuple[Column, Column]:
    """The least and the greatest value of all images, as scalar subqueries."""
    return images.agg(F.min(F.array_min("image"))).scalar(), images.agg(F.max(F.array_max("image"))).scalar()


def _quantile(images: DataFrame, q: float) -> Column:
    if q == 1:
        return _ends(images)[1]
    return order_statistic_quantile(images.select(F.explode("image").alias("v")), "v", q)


def _to_unit(images: DataFrame) -> DataFrame:
    """Values moved to 0..1; a constant becomes 0."""
    low, high = _ends(images)
    held = images.withColumns({"_lo": low, "_hi": high})
    return held.withColumn("image", F.transform("image", lambda x: F.coalesce(F.try_divide(x - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)))).drop("_lo", "_hi")


def transform_grid(
    z: DataFrame, known: DataFrame, resolution: tuple[int, int], *, gauss: tuple[float, float] | float | None = None, median: tuple[int, int] | None = (3, 3), passes: int = 2, upscale: int = 1, scalar: float = 1.0,
    max_up: float = 20.0, all_feature_q: float | None = None, range_q: float = 1.0, winsor_low: float | None = None, winsor_high: float | None = None, winsor_is_share_of_max: bool = False, winsor_low_to_zero: bool = False, nan_fill: float = 0.0,
) -> DataFrame:
    """(var_id, ix, iy, z) of every pixel: the whole chain of image transformations.

    Median passes and the Gaussian of :func:`smoothed_images`; with
    ``all_feature_q`` a cut at the ``range_q`` quantile of all values, a move to
    0..1 and a factor of 1 over each feature's quantile, at most ``max_up``;
    winsorising of all values together, at quantiles or at shares of the maximum,
    the lower values becoming the bound or 0; a move to 0..1; bilinear upscaling by
    a whole factor; ``scalar``. Quantiles run over all pixels of all features,
    unknown ones included.
    """
    if int(upscale) != upscale or upscale < 1:
        raise ValueError("upscale is a whole number")
    scratch = Scratch(z.sparkSession, "pixels")
    images = scratch.save(smoothed_images(z, known, resolution, gauss=gauss, median=median, passes=passes, nan_fill=nan_fill), "smoothed")
    if all_feature_q is not None:
        top = images.withColumn("_t", _quantile(images, range_q))
        images = scratch.save(top.withColumn("image", F.transform("image", lambda x: F.least(x, F.col("_t")))).drop("_t"), "cut")
        q = float(all_feature_q)

        @F.pandas_udf("array<double>")
        def stretch(image: pd.Series) -> pd.Series:
            out = []
            for x in image:
                at = np.quantile(x, q)
                out.append(x * (min(1 / at, max_up) if at > 0 else max_up))
            return pd.Series(out)

        images = scratch.save(_to_unit(images).withColumn("image", stretch("image")), "stretched")
    for name, q, low in (("high", winsor_high, False), ("low", winsor_low, True)):
        if q is not None:
            bound = _ends(images)[1] * F.lit(q) if winsor_is_share_of_max else _quantile(images, q)
            cut = (lambda x: F.when(x < F.col("_b"), F.lit(0.0) if winsor_low_to_zero else F.col("_b")).otherwise(x)) if low else (lambda x: F.least(x, F.col("_b")))
            images = scratch.save(images.withColumn("_b", bound).withColumn("image", F.transform("image", cut)).drop("_b"), name)
    images = _to_unit(images)
    shape = tuple(resolution)
    if upscale > 1:

        @F.pandas_udf("array<double>")
        def larger(image: pd.Series) -> pd.Series:
            return pd.Series([bilinear(np.asarray(x).reshape(shape), upscale).ravel() for x in image])

        images, shape = images.withColumn("image", larger("image")), (shape[0] * upscale, shape[1] * upscale)
    rows = images.select("var_id", F.posexplode("image").alias("_i", "_z"))
    return rows.select("var_id", F.floor(F.col("_i") / shape[1]).cast("int").alias("ix"), (F.col("_i") % shape[1]).alias("iy"), (F.col("_z") * scalar).alias("z"))


def landscape_dynamics(z: DataFrame, regions: DataFrame, axis_y: DataFrame, category: str, *, spearman: bool = False) -> DataFrame:
    """(category, var_id, res): correlation of a feature's pixels with time (minus the grid's y) within a region.

    ``regions`` (ix, iy, category) holds every pixel of a region; those a feature
    has no row for are zeros. With ``spearman`` the feature is ranked and time is
    taken as it is.
    """
    pixels = regions.where(F.col(category).isNotNull()).join(axis_y.where("axis = 'y'").select(F.col("i").alias("iy"), (-F.col("line")).alias("t")), "iy")
    n = pixels.groupBy(category).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("t").alias("st"), F.sum(F.col("t") * F.col("t")).alias("stt"))
    rows = z.select("var_id", "ix", "iy", "z").join(pixels, ["ix", "iy"])
    if spearman:
        k = rows.where("z > 0").groupBy(category, "var_id").agg(F.count(F.lit(1)).alias("_k"))
        ranked = midrank(rows.where("z > 0"), [category, "var_id"], "z").join(k, [category, "var_id"]).join(n.select(category, "n"), category)
        # zeros share the mean rank (n0 + 1) / 2; taking it off every value keeps the correlation and makes zeros 0 again
        n0 = F.col("n") - F.col("_k")
        rows = ranked.select(category, "var_id", "t", (F.col("rank") + n0 - F.when(n0 > 0, (n0 + 1) / 2).otherwise(F.lit(0.0))).alias("z"))
    s = rows.groupBy(category, "var_id").agg(F.sum("z").alias("sz"), F.sum(F.col("z") * F.col("z")).alias("szz"), F.sum(F.col("z") * F.col("t")).alias("szt")).join(n, category)
    cov = F.col("szt") - F.col("sz") * F.col("st") / F.col("n")
    vz, vt = F.col("szz") - F.col("sz") * F.col("sz") / F.col("n"), F.col("stt") - F.col("st") * F.col("st") / F.col("n")
    return s.select(category, "var_id", F.when((vz > 0) & (vt > 0), cov / F.sqrt(vz * vt)).alias("res"))


def weighted_correlation(pairs: DataFrame, by: Sequence[str], *, x: str = "x", y: str = "y", w: Column | None = None, raw: bool = False) -> DataFrame:
    """(by, res) or (by, cov, sd_x, sd_y): Pearson correlation with reliability weights."""
    rows = pairs.withColumn("_w", w if w is not None else F.lit(1.0)).where("_w > 0")
    s = rows.groupBy(*by).agg(
        F.sum("_w").alias("v1"), F.sum(F.col("_w") * F.col("_w")).alias("v2"), F.sum(F.col("_w") * F.col(x)).alias("sx"), F.sum(F.col("_w") * F.col(y)).alias("sy"),
        F.sum(F.col("_w") * F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col("_w") * F.col(y) * F.col(y)).alias("syy"), F.sum(F.col("_w") * F.col(x) * F.col(y)).alias("sxy"),
    )
    norm = F.col("v1") - F.col("v2") / F.col("v1")
    c = lambda a, p, q: F.try_divide(F.col(a) - F.col(p) * F.col(q) / F.col("v1"), norm)
    s = s.select(*by, c("sxy", "sx", "sy").alias("cov"), F.sqrt(F.greatest(c("sxx", "sx", "sx"), F.lit(0.0))).alias("sd_x"), F.sqrt(F.greatest(c("syy", "sy", "sy"), F.lit(0.0))).alias("sd_y"))
    return s if raw else s.select(*by, F.try_divide(F.col("cov"), F.col("sd_x") * F.col("sd_y")).alias("res"))


def grid_correlations(a: DataFrame, b: DataFrame, *, spearman: bool = True, ignore_zeros: bool = False, signal_weighting: bool = False, raw: bool = False) -> DataFrame:
    """(var_id, res): per feature the correlation of two pixel tables (var_id, ix, iy, z) over the pixels of either."""
    both = a.select("var_id", "ix", "iy", F.col("z").alias("x")).join(b.select("var_id", "ix", "iy", F.col("z").alias("y")), ["var_id", "ix", "iy"], "full").na.fill(0.0, ["x", "y"])
    weight = None
    if signal_weighting:
        e = F.least(F.col("x") * F.col("x") + F.col("y") * F.col("y"), F.lit(1.0))
        both, weight = both.withColumn("_e", e * e), F.col("_e")
    elif ignore_zeros:
        both = both.where("x <> 0 and y <> 0")
    if spearman:
        both = midrank(both, ["var_id"], "x", out="rx").drop("n_ties")
        both = midrank(both, ["var_id"], "y", out="ry").drop("x", "y").withColumnsRenamed({"rx": "x", "ry": "y"})
    return weighted_correlation(both, ["var_id"], w=weight, raw=raw)


def slice_pixels(z: DataFrame, axis: str, low: float, high: float, axes: DataFrame) -> DataFrame:
    """(var_id, i, z): sums over a band of one axis (x or y), along the other."""
    other = "y" if axis == "x" else "x"
    band = axes.where((F.col("axis") == axis) & F.col("line").between(low, high)).select(F.col("i").alias(f"i{axis}"))
    return z.join(band, f"i{axis}").groupBy("var_id", F.col(f"i{other}").alias("i")).agg(F.sum("z").alias("z"))


def trim_grid(regions: DataFrame, min_x: int, min_y: int = 0) -> DataFrame:
    """The pixels between the first and the last column (row) of more than ``min_x`` (``min_y``) cells."""
    out = regions
    for axis, least in (("ix", min_x), ("iy", min_y)):
        kept = regions.groupBy(axis).agg(F.sum("n_cells").alias("n")).where(F.col("n") > least)
        out = out.where(F.col(axis).between(kept.agg(F.min(axis)).scalar(), kept.agg(F.max(axis)).scalar()))
    return out


def color_summary(regions: DataFrame, category: str, min_x: int, min_y: int = 0, *, y_fraction: float = 1.0, rows: int | None = None) -> DataFrame:
    """(ix, mode): the most frequent category of each column of the trimmed grid, over the lower ``y_fraction`` of its ``rows``."""
    low = regions if rows is None else regions.where(F.col("iy") < int(rows * y_fraction))
    trimmed = trim_grid(regions, min_x, min_y).join(low.select("ix", "iy"), ["ix", "iy"], "left_semi")
    return mode_by_group(trimmed, ["ix"], category)


def binned_mean(df: DataFrame, x: str, y: str, size: float, *, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, mean, n): means of y in bins of fixed width from the least x; the last bin holds its right end."""
    low, high = df.agg(F.min(x)).scalar(), df.agg(F.max(x)).scalar()
    last = F.greatest(F.ceil((high - low) / size) - 1, F.lit(0))
    b = F.least(F.floor((F.col(x) - low) / size), last).cast("int")
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, b.alias("bin")).agg(F.avg(y).alias("mean"), F.count(F.lit(1)).alias("n"))


def smooth_bins(bins: DataFrame, sigma: float, *, by: Sequence[str] = (), value: str = "mean") -> DataFrame:
    """(by, bin, smoothed): Gaussian over consecutive bins, mirrored at both ends; there are few bins, so one task per group."""
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        return pdf[[*by, "bin"]].assign(smoothed=gaussian_filter_1d(pdf[value].to_numpy(float), sigma, mode="symmetric"))

    if by:
        schema = ", ".join(f"{c} {bins.schema[c].dataType.simpleString()}" for c in by)
        return bins.groupBy(*by).applyInPandas(run, f"{schema}, bin int, smoothed double")
    return bins.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(run, "bin int, smoothed double")


def order_by_membership(df: DataFrame, group: str, by: str, tie: str) -> DataFrame:
    """Adds place (within the group) and offset (rows of earlier groups)."""
    w = Window.partitionBy(group).orderBy(by, tie)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)  # one row a group
    offsets = sizes.select(group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("offset"))
    return df.withColumn("place", F.row_number().over(w)).join(offsets, group)


def add_expression(dynamics: DataFrame, means: DataFrame, group: str) -> DataFrame:
    """The dynamics (group, var_id, ...) with ``exp``, the feature's mean in the group (0 where it has none)."""
    return dynamics.join(means.select(group, "var_id", F.col("mean").alias("exp")), [group, "var_id"], "left").na.fill(0.0, ["exp"])


def time_curve(coo: DataFrame, obs: DataFrame, feature: str, category: str, value: str, size: float, *, sigma: float | None = None) -> DataFrame:
    """(bin, mean, n[, smoothed]): one feature over the time of one category's cells, zeros included."""
    cells = obs.where((F.col(category) == value) & F.col("time").isNotNull()).select("obs_id", "time")
    x = cells.join(coo.where(F.col("var_id") == feature).select("obs_id", "value"), "obs_id", "left").na.fill(0.0, ["value"])
    bins = binned_mean(x, "time", "value", size)
    return bins if sigma is None else bins.join(smooth_bins(bins, sigma), "bin")
