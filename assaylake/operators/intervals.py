"""Merging of overlapping intervals, and the gaps between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Positions per tile. A tile is the unit of parallel work, so one entity that
#: holds a third of all rows is spread over as many tasks as it has tiles.
TILE = 1 << 20


def _as_time(c: Column) -> Column:
    return F.timestamp_micros(c)


def _changes(batch: pa.RecordBatch, n_keys: int) -> np.ndarray:
    """Where a row's keys differ from those of the row before; nulls are equal."""
    out = np.ones(batch.num_rows, bool)
    out[1:] = False
    for c in batch.columns[:n_keys]:
        a, b = c[1:], c[:-1]
        differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
        out[1:] |= differs.to_numpy(zero_copy_only=False)
    return out


def _merged_in_task(n_keys: int):
    """Sorted rows (keys, tile, s, e) -> the continuous stretches of each batch with their numbers of rows."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first = _changes(batch, n_keys + 1)
            start, end = (batch.column(n_keys + k).to_numpy(zero_copy_only=False) for k in (1, 2))
            reach = np.empty_like(end)
            at = np.flatnonzero(first)
            low, group = end.min(), np.cumsum(first) - 1
            span = int(end.max()) - int(low) + 1
            if span * (len(at) + 1) < 1 << 62:  # one running maximum for all groups, each on a level of its own
                reach = np.maximum.accumulate(end - low + group * span) - group * span + low
            else:
                for a, b in zip(at, [*at[1:], len(end)]):
                    reach[a:b] = np.maximum.accumulate(end[a:b])
            new = first.copy()
            new[1:] |= start[1:] > reach[:-1]
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(end)) - 1
            kept = batch.take(pa.array(heads))
            yield pa.RecordBatch.from_arrays([*kept.columns[: n_keys + 2], pa.array(reach[tails]), pa.array(tails - heads + 1)], names=[*batch.schema.names, "n"])

    return merge


def _tile_stretches(df: DataFrame, keys: list[str], start: str, end: str, tile: int) -> DataFrame:
    """(keys, _tile, s, e, n): the intervals of a tile merged by a native session window.

    An interval belongs to the tile of its start. The session's gap is the
    interval's own length, which makes overlapping and nested intervals one
    session. Sessions are merged while rows stream by in sorted order. Each task
    merges its own rows first, batch by batch, so that however many intervals of an
    entity lie in a tile, a batch sends no more than its continuous stretches.
    """
    rows = df.select(*keys, F.floor(F.col(start) / tile).alias("_tile"), F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"))
    rows = rows.sortWithinPartitions(*keys, "_tile", "_s")
    rows = rows.mapInArrow(_merged_in_task(len(keys)), StructType([*rows.schema.fields, StructField("n", LongType())]))
    gap = F.concat((F.col("_e") - F.col("_s")).cast("string"), F.lit(" microseconds"))
    session = F.session_window(_as_time(F.col("_s")), gap).alias("_w")
    return (
        rows.groupBy(*keys, "_tile", session)
        .agg(F.sum("n").alias("n"))
        .select(*keys, "_tile", F.unix_micros("_w.start").alias("s"), F.unix_micros("_w.end").alias("e"), "n")
    )


def _with_carry(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``carry``, the furthest end of all earlier tiles, and joins pieces that touch.

    Only one summary row a tile crosses tiles; the window over it holds as many
    rows as an entity has tiles, not as it has intervals.
    """
    ends = stretches.groupBy(*keys, "_tile").agg(F.max("e").alias("_max_e"))
    before = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "_tile", F.max("_max_e").over(before).alias("carry"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_tile"]]
    return stretches.alias("a").join(carry.alias("b"), on, "left").select("a.*", "b.carry")


def _pieces(df: DataFrame, keys: list[str], start: str, end: str, tile: int) -> DataFrame:
    """Stretches of a tile with ``reach``, the furthest end of anything that starts earlier."""
    valid = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) < F.col(end)))
    carried = _with_carry(_tile_stretches(valid, keys, start, end, tile), keys)
    earlier = Window.partitionBy(*keys, "_tile").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max("e").over(earlier)
    return carried.withColumns({"reach": F.greatest("carry", seen), "_first": seen.isNull()})


def interval_gaps(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", *, tile: int = TILE) -> DataFrame:
    """Gaps between consecutive continuous stretches of each entity: (keys, gap_start, gap_end).

    Intervals are half-open. Those of one entity that overlap, nest or touch form
    one stretch. Rows with a null start or end, or with start >= end, are no
    intervals and are left out. Null keys form an entity of their own. Repeated
    rows change nothing. An entity with one stretch, and an empty table, give no
    rows. Other columns of ``df`` are ignored.
    """
    carried = _pieces(df, keys, start, end, tile)
    order = Window.partitionBy(*keys, "_tile").orderBy("s", "e")
    # Within a tile sessions are disjoint, so a gap is an end and the next start (lead);
    # the gap before a tile's first stretch lies behind the carried end of earlier tiles.
    led = carried.withColumn("_next", F.lead("s").over(order))
    inside = F.struct(F.greatest("carry", F.col("e")).alias("gap_start"), F.col("_next").alias("gap_end"))
    first = F.struct(F.col("carry").alias("gap_start"), F.when(F.col("_first"), F.col("s")).alias("gap_end"))
    return (
        led.select(*keys, F.explode(F.array(inside, first)).alias("_g"))
        .where(F.col("_g.gap_start") < F.col("_g.gap_end"))
        .select(*keys, "_g.gap_start", "_g.gap_end")
    )


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", *, tile: int = TILE) -> DataFrame:
    """Continuous stretches of each entity: (keys, start, end, n_intervals).

    The rules of :func:`interval_gaps` hold. ``n_intervals`` counts the merged
    rows, repeated rows included. A stretch is numbered by the count of gaps
    before it, as a two-level prefix sum (within tiles, then over tiles).
    """
    pieces = _pieces(df, keys, start, end, tile).withColumn("_new", (F.col("reach").isNull() | (F.col("s") > F.col("reach"))).cast("long"))
    tiles = pieces.groupBy(*keys, "_tile").agg(F.sum("_new").alias("_k"))
    before = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tiles.select(*keys, "_tile", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_off"))
    upto = Window.partitionBy(*keys, "_tile").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_tile"]]
    numbered = (
        pieces.withColumn("_i", F.sum("_new").over(upto)).alias("a").join(offsets.alias("b"), on, "left")
        .select(*[F.col(f"a.{k}").alias(k) for k in keys], (F.col("_i") + F.col("_off")).alias("_id"), "a.s", "a.e", "a.n")
    )
    return numbered.groupBy(*keys, "_id").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.sum("n").alias("n_intervals")).drop("_id")
