"""The first N items of every group, without ever holding a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def _first_rows(n: int, key: str, rank: str | None):
    """Arrow batches sorted by ``key`` -> the first ``n`` rows of each run of equal keys."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0  # the run that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key))
            starts = np.ones(batch.num_rows, bool)
            if batch.num_rows > 1:
                starts[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            carried = keys[0].as_py() == last
            at = np.flatnonzero(starts)
            run = np.cumsum(starts) - 1
            place = np.arange(batch.num_rows) - at[run]
            if carried:
                place[: at[1] if len(at) > 1 else batch.num_rows] += seen
            last, seen = keys[-1].as_py(), int(place[-1]) + 1
            keep = place < n
            if keep.any():
                out = batch.filter(pa.array(keep))
                yield out if rank is None else out.append_column(rank, pa.array(place[keep] + 1, pa.int32()))

    return emit


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """The ``n`` items of highest score in every group: (group, item, score, rank).

    An item's score is the highest of its rows. Equal scores are ordered by the
    item in byte order; a null item comes last among them. Rows with a null
    group, or a score that is null or NaN, are left out. A group with fewer items
    gives all of them; an empty table gives no rows; further columns are ignored.

    Rows are hashed by (group, item), which spreads a hot group over all tasks;
    each task sorts its part and streams the first ``n`` rows of each group on.
    Only these are hashed by group, sorted and streamed again, so no group is
    ever buffered and none meets more than n rows per task.
    """
    rows = df.select(F.col(group).alias("_g"), F.col(item).alias("_i"), (F.col(score).cast("double") + F.lit(0.0)).alias("_s"))
    rows = rows.where(F.col("_g").isNotNull() & F.col("_s").isNotNull() & ~F.isnan("_s"))
    best = rows.groupBy("_g", "_i").agg(F.max("_s").alias("_s"))
    order = [F.asc("_g"), F.desc("_s"), F.asc_nulls_last("_i")]
    kept = best.sortWithinPartitions(*order).mapInArrow(_first_rows(n, "_g", None), best.schema)
    final = kept.repartition("_g").sortWithinPartitions(*order)
    ranked = final.mapInArrow(_first_rows(n, "_g", "rank"), StructType([*best.schema.fields, StructField("rank", IntegerType())]))
    return ranked.select(F.col("_g").alias(group), F.col("_i").alias(item), F.col("_s").alias(score), "rank")
