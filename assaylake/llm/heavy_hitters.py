"""The most frequent values of a column, in memory that doesn't grow with the column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of one summary. An estimate is off by at most n / (CAPACITY + 1) rows.
CAPACITY = 4_000
#: Summaries that one task merges in a level of the tree.
FAN_IN = 32

_SUMMARY = "node long, n long, error long, items array<string>, counts array<long>"


def merge_summaries(parts: list[tuple[int, int, pd.Series]], capacity: int) -> tuple[int, int, pd.Series]:
    """One summary of several: (rows, error, counters).

    A summary is a space-saving one in its mergeable form: a value's true number
    of rows lies between its counter (0 without one) and its counter plus
    ``error``. Counters are added; if more than ``capacity`` remain, the first
    one too many is subtracted from all and added to the error, which keeps
    error <= n / (capacity + 1) through any tree of merges.
    """
    n, error = sum(p[0] for p in parts), sum(p[1] for p in parts)
    counters = pd.concat([p[2] for p in parts]) if parts else pd.Series(dtype="int64")
    if len(parts) > 1:
        counters = counters.groupby(level=0, sort=False).sum()
    if len(counters) > capacity:
        cut = int(np.partition(counters.to_numpy(), len(counters) - capacity - 1)[len(counters) - capacity - 1])
        counters = counters[counters > cut] - cut
        error += cut
    return n, error, counters


def _row(node: int, summary: tuple[int, int, pd.Series]) -> dict:
    n, error, counters = summary
    return {"node": [node], "n": [n], "error": [error], "items": [list(counters.index)], "counts": [[int(c) for c in counters.to_numpy()]]}


_ARROW = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("error", pa.int64()), ("items", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def summarize(values: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One summary row for each partition of a one-column table of strings."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (0, 0, pd.Series(dtype="int64"))
        for batch in batches:
            counted = pc.value_counts(batch.column(0).drop_null())
            exact = pd.Series(counted.field("counts").to_numpy(zero_copy_only=False), index=counted.field("values").to_pandas(), dtype="int64")
            state = merge_summaries([state, (batch.num_rows, 0, exact)], capacity)
        if state[0]:
            yield pa.RecordBatch.from_pydict(_row(TaskContext.get().partitionId(), state), schema=_ARROW)

    return values.mapInArrow(scan, _SUMMARY)


def merge_tree(summaries: DataFrame, partitions: int, capacity: int = CAPACITY, fan_in: int = FAN_IN) -> DataFrame:
    """A single summary row, merged in levels of ``fan_in`` so that no task reads more than that."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(int(r.n), int(r.error), pd.Series(np.asarray(r.counts, dtype="int64"), index=list(r["items"]))) for _, r in pdf.iterrows()]
        return pd.DataFrame(_row(int(pdf["node"].iloc[0]), merge_summaries(parts, capacity)))

    while True:
        partitions = -(-partitions // fan_in)
        summaries = summaries.withColumn("node", F.floor(F.col("node") / fan_in)).groupBy("node").applyInPandas(merge, _SUMMARY)
        if partitions <= 1:
            return summaries


def frequent_values(df: DataFrame, value: Column, *, share: float, capacity: int = CAPACITY, fan_in: int = FAN_IN) -> DataFrame:
    """Every value that holds at least ``share`` of all rows: (value, n_rows, lower, upper, total).

    The first pass keeps ``capacity`` counters for each partition and merges them
    in a tree; ``lower`` and ``upper`` are its bounds. A second pass counts the
    values whose upper bound reaches the share; there are at most
    1 / (share - 1 / (capacity + 1)) of them, which bounds what is broadcast.
    ``n_rows`` and the choice are exact.

    Nulls are no values, but their rows count in the total. Blank strings are
    ordinary values. Equal counts need no rule, as nothing is cut off. An empty
    table gives no rows.
    """
    if not 1 / (capacity + 1) < share <= 1:
        raise ValueError(f"a share of {share} needs more than {capacity} counters")
    values = df.select(value.cast("string").alias("value"))
    top = merge_tree(summarize(values, capacity), values.rdd.getNumPartitions(), capacity, fan_in)
    bounds = top.select("n", "error", F.explode(F.arrays_zip("items", "counts")).alias("c")).select(
        F.col("c.items").alias("value"), F.col("c.counts").alias("lower"), (F.col("c.counts") + F.col("error")).alias("upper"), F.col("n").alias("total")
    )
    candidates = bounds.where(F.col("upper") >= F.lit(share) * F.col("total"))
    exact = values.join(F.broadcast(candidates), "value").groupBy("value", "lower", "upper", "total").agg(F.count(F.lit(1)).alias("n_rows"))
    return exact.where(F.col("n_rows") >= F.lit(share) * F.col("total")).select("value", "n_rows", "lower", "upper", "total")
