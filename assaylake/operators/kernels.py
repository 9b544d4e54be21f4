"""Sparse algebra, ranks, false-discovery control and the joins Catalyst has no operator for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.plans.scratch import Scratch


def matmul(a: DataFrame, b: DataFrame, *, row: str, inner: str, col: str, value: str = "value") -> DataFrame:
    """Sparse product: ``a`` is (row, inner, value), ``b`` is (inner, col, value)."""
    left = a.select(row, inner, F.col(value).alias("_a"))
    right = b.select(inner, col, F.col(value).alias("_b"))
    return left.join(right, inner).groupBy(row, col).agg(F.sum(F.col("_a") * F.col("_b")).alias(value))


def transposed(coo: DataFrame, a: str = "obs_id", b: str = "var_id") -> DataFrame:
    return coo.select(F.col(b).alias(a), F.col(a).alias(b), "value")


def _in_order(df: DataFrame, partition: Sequence[str], by: str, amount: str) -> tuple[DataFrame, list[str]]:
    """Adds ``_upto``, the running total of ``amount`` in the order of ``by``, and names the columns of a unit of work.

    Within partitions a window does it. A whole table is instead cut into ranges
    of ``by``, each summed by its own task; the totals of earlier ranges, one
    number each, are added. The cut table is written, so that all passes see the
    same ranges.
    """
    upto = lambda keys: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    if partition:
        return df.withColumn("_upto", F.sum(amount).over(upto(partition))), list(partition)
    cut = Scratch(df.sparkSession, "ordered").save(df.repartitionByRange(by).withColumn("_range", F.spark_partition_id()), "cut")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = cut.groupBy("_range").agg(F.sum(amount).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = cut.withColumn("_w", F.sum(amount).over(upto(["_range"])))
    return within.join(starts, "_range").withColumn("_upto", F.col("_w") + F.col("_start")).drop("_w", "_start"), ["_range"]


def midrank(df: DataFrame, partition: Sequence[str], value: str, *, n_zeros: Column | None = None, out: str = "rank") -> DataFrame:
    """Average rank of ties, within partitions, from the number of rows per distinct value.

    Rows are first counted per value, so ranking orders distinct values only, and
    the counts are combined map-side; without partitions the order is spread over
    ranges of the value. With ``n_zeros`` the partition also holds so many implicit
    zeros; ``value`` is then expected to be positive.
    """
    keys = [*partition, value]
    per_value = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_t"))
    upto, _ = _in_order(per_value, partition, value, "_t")
    ranked = upto.select(*keys, (F.col("_upto") - (F.col("_t") - 1) / 2).alias(out), F.col("_t").alias("n_ties"))
    joined = df.join(ranked, keys)
    return joined if n_zeros is None else joined.withColumn(out, F.col(out) + n_zeros)


def benjamini_hochberg(df: DataFrame, p: str, *, partition: Sequence[str] = (), out: str = "p_adj") -> DataFrame:
    """Adjusted p-values within each partition; NaN and null p-values count as 1.

    Equal p-values have the same adjusted one, that of the last of them, so only
    distinct values are put in order (in ranges, if there are no partitions).
    """
    clean = df.withColumn("_p", F.when(F.col(p).isNull() | F.isnan(p), F.lit(1.0)).otherwise(F.col(p)))
    keys = [*partition, "_p"]
    counts = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("_t"))
    ordered, unit = _in_order(counts, partition, "_p", "_t")
    if partition:
        total = F.sum("_t").over(Window.partitionBy(*partition))
    else:
        total = counts.agg(F.sum("_t")).scalar()
    raw = ordered.withColumn("_n", total).withColumn("_a", F.col("_p") * F.col("_n") / F.col("_upto"))
    later = Window.partitionBy(*unit).orderBy("_p").rowsBetween(0, Window.unboundedFollowing)
    best = raw.withColumn("_b", F.min("_a").over(later))
    if not partition:
        after = Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)  # one row a range
        beyond = raw.groupBy("_range").agg(F.min("_a").alias("_m")).select("_range", F.min("_m").over(after).alias("_beyond"))
        best = best.join(beyond, "_range").withColumn("_b", F.least("_b", "_beyond"))
    adjusted = best.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.least(F.lit(1.0), F.col("_b")).alias(out))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return clean.join(adjusted, same).drop("_p", *[f"_k{i}" for i in range(len(keys))])


def interval_join(a: DataFrame, b: DataFrame, *, width: int, on: str = "chr", start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of overlapping half-open intervals, as structs ``a`` and ``b``.

    Both sides are cut into windows of ``width``, which makes the join an equi-join.
    A pair is reported only in the window where its overlap begins, so nothing has
    to be made distinct afterwards. Rows with null ends never match.
    """

    def cut(df: DataFrame, name: str) -> DataFrame:
        ok = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) < F.col(end)))
        windows = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
        return ok.select(F.col(on).alias("_on"), F.struct("*").alias(name), F.explode(windows).alias("_w"))

    pairs = cut(a, "a").join(cut(b, "b"), ["_on", "_w"])
    s, e = (lambda n: F.col(f"{n}.{start}")), (lambda n: F.col(f"{n}.{end}"))
    overlap = (s("a") < e("b")) & (s("b") < e("a"))
    first = F.floor(F.greatest(s("a"), s("b")) / width) == F.col("_w")
    return pairs.where(overlap & first).select("a", "b")


def asof_join(left: DataFrame, right: DataFrame, *, on: str, at: str, start: str, width: int, carry: Sequence[str]) -> DataFrame:
    """For each row of ``left`` the row of ``right`` with the largest ``start`` <= ``at``.

    Both sides share a window per (``on``, block of ``width`` positions). The last
    row of each earlier block is carried over through a table with one row a
    block, so no task orders a whole chromosome. Adds the columns ``carry`` of the
    matched row, null where there is none.
    """
    payload = F.struct(F.col(start).alias("_s"), *[F.col(c) for c in carry])
    r = right.where(F.col(start).isNotNull()).select(F.col(on).alias("_on"), F.floor(F.col(start) / width).alias("_b"), F.col(start).alias("_pos"), payload.alias("_r"))
    l = left.select(F.col(on).alias("_on"), F.floor(F.col(at) / width).alias("_b"), F.col(at).alias("_pos"), F.struct("*").alias("_l"))
    blocks = r.groupBy("_on", "_b").agg(F.max("_r").alias("_last"))
    all_blocks = blocks.unionByName(l.select("_on", "_b").distinct(), allowMissingColumns=True).groupBy("_on", "_b").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy("_on").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = all_blocks.select("_on", "_b", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    both = r.withColumn("_tag", F.lit(0)).unionByName(l.withColumn("_tag", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy("_on", "_b").orderBy("_pos", "_tag", "_r").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_hit", F.last("_r", ignorenulls=True).over(upto)).where("_tag = 1")
    on_block = F.col("x._on").eqNullSafe(F.col("y._on")) & F.col("x._b").eqNullSafe(F.col("y._b"))
    out = seen.alias("x").join(carried.alias("y"), on_block, "left").withColumn("_m", F.coalesce("_hit", "_carry"))
    return out.select("_l.*", *[F.col(f"_m.{c}").alias(c) for c in carry])


def zero_aware_quantile(values: DataFrame, group: Sequence[str], n: Column, q: float, value: str = "value") -> DataFrame:
    """Linear-interpolated quantile of ``n`` numbers of which only the non-zero ones are rows.

    (group, quantile). Values must be >= 0. Only the two order statistics that
    matter are looked up, in a table of distinct values and their counts.
    """
    keys = list(group)
    per_value = values.where(F.col(value) != 0).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_t"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*keys)
    c = per_value.withColumns({"_upto": F.sum("_t").over(w), "_nz": F.sum("_t").over(total)}).withColumn("_n", n.cast("double"))
    c = c.withColumn("_h", (F.col("_n") - 1) * F.lit(q)).withColumn("_z", F.col("_n") - F.col("_nz"))
    low, high = F.floor("_h"), F.ceil("_h")
    at = lambda i: F.coalesce(F.min(F.when(F.col("_z") + F.col("_upto") > i, F.col(value))), F.lit(0.0))
    in_zero = lambda i: i < F.first("_z")
    lo = F.when(in_zero(F.first(low)), F.lit(0.0)).otherwise(at(low))
    hi = F.when(in_zero(F.first(high)), F.lit(0.0)).otherwise(at(high))
    agg = c.groupBy(*keys).agg(lo.alias("_lo"), hi.alias("_hi"), F.first(F.col("_h") - low).alias("_f"))
    return agg.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("quantile"))


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation as an aggregate; null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def order_statistic_quantile(df: DataFrame, value: str, q: float) -> Column:
    """The linear-interpolated quantile of a whole column, as a scalar subquery.

    Distinct values are counted map-side and put in order range by range; only the
    two order statistics that matter are looked up. Nulls don't count.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_t"))
    ordered, _ = _in_order(counts, [], "_v", "_t")
    n = ordered.agg(F.sum("_t")).scalar()
    h = (n - 1) * F.lit(q)
    at = lambda i: F.min(F.when(F.col("_upto") > i, F.col("_v")))
    two = ordered.agg(at(F.floor(h)).alias("_lo"), at(F.ceil(h)).alias("_hi"))
    return two.select(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (h - F.floor(h))).scalar()


def grouped_quantiles(df: DataFrame, by: Sequence[str], value: str, **quantiles: float) -> DataFrame:
    """(by, one column for each of ``quantiles``), linear-interpolated; nulls don't count.

    Distinct values are counted map-side and sorted, which spills; no task holds a
    group's values in memory.
    """
    keys = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_t"))
    order = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"_upto": F.sum("_t").over(order), "_n": F.sum("_t").over(Window.partitionBy(*keys))})
    h = {name: (F.col("_n") - 1) * F.lit(q) for name, q in quantiles.items()}
    at = lambda i: F.min(F.when(F.col("_upto") > i, F.col("_v")))
    two = ranked.groupBy(*keys).agg(*[c for name, x in h.items() for c in (at(F.floor(x)).alias(f"_l{name}"), at(F.ceil(x)).alias(f"_h{name}"), F.first(x - F.floor(x)).alias(f"_f{name}"))])
    return two.select(*keys, *[(F.col(f"_l{n}") + (F.col(f"_h{n}") - F.col(f"_l{n}")) * F.col(f"_f{n}")).alias(n) for n in quantiles])
