"""Joins that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.plans.scratch import Scratch

#: A side is broadcast only if a count has shown it to hold at most so many keys
#: (measured: 150 bytes a barcode, so 150 MB); beyond, both sides are shuffled.
BROADCAST_KEYS = 1_000_000
SALTS = 16
#: A key is hot from this share of the rows on, so there are never more than its inverse.
HOT_SHARE = 1e-3
#: Rows of one key that a block of a crowded join holds, on each side, and pairs that a task of it makes.
BLOCK = 2_048
TASK_PAIRS = 4_000_000
#: Pairs from which on a further core is worth a task.
CORE_PAIRS = 65_536


def semi_join_skewed(df: DataFrame, keys: DataFrame, on: str, *, spread: Column, limit: int = BROADCAST_KEYS, salts: int = SALTS) -> DataFrame:
    """Rows of ``df`` whose ``on`` occurs in ``keys``, with no shuffle or with salted ones.

    The distinct keys are counted first. Up to ``limit`` they are broadcast, and
    ``df`` isn't shuffled at all. Beyond, every key is written once for each of
    ``salts`` salts and a row of ``df`` looks only under the salt that ``spread``
    gives it, so a hot key is divided over that many tasks. Null keys never match.
    """
    distinct = keys.select(on).where(F.col(on).isNotNull()).distinct()
    if distinct.limit(limit + 1).count() <= limit:
        return df.join(F.broadcast(distinct), on, "left_semi")
    salted = distinct.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return rows.join(salted, [on, "_salt"], "left_semi").drop("_salt")


def hot_keys(counts: DataFrame, on: Sequence[str], n: str, total: int, *, share: float = HOT_SHARE) -> DataFrame:
    """The keys of a table of counts (one row a key) that hold at least ``share`` of ``total`` rows; at most 1 / share."""
    return counts.where(F.col(n) >= F.lit(max(1.0, share * total))).select(*on).limit(int(1 / share) + 1)


def join_hot(df: DataFrame, table: DataFrame, on: Sequence[str], hot: DataFrame, *, spread: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``df`` joined with a ``table`` of one or few rows a key, hot keys divided over ``salts`` tasks.

    ``hot`` comes from :func:`hot_keys` and is small by construction, so it is
    broadcast. Only hot keys are salted; ``how`` is inner, left or left_semi.
    """
    mark = F.broadcast(hot.select(*on).withColumn("_hot", F.lit(True)))
    rows = df.join(mark, list(on), "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    keyed = table.join(mark, list(on), "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return rows.join(keyed, [*on, "_salt"], how).drop("_salt")


def join_crowded(left: DataFrame, right: DataFrame, on: Sequence[str], *, block: int = BLOCK) -> DataFrame:
    """Inner join of two tables that both hold many rows of the same few keys, as a plain join gives it.

    The result is far larger than what goes in, so neither the number of keys nor
    the bytes read tell Spark how many tasks it needs. Both sides are written and
    counted; the rows of a key are cut into blocks on either side, every pair of
    blocks is a key of its own, and the tasks are as many as the pairs of rows need.
    Blocks of ``right`` travel as one array, unfolded last. Null keys never match.
    """
    on, tables = list(on), Scratch(left.sparkSession, "crowded")
    known = lambda df: df.where(F.forall(F.array(*[F.col(c).isNotNull() for c in on]), lambda x: x))
    left, right = tables.save(known(left), "left"), tables.save(known(right), "right")
    count = lambda df, n: df.groupBy(*on).agg(F.count(F.lit(1)).alias(n))
    sizes = tables.save(count(left, "_nl").join(count(right, "_nr"), on), "sizes")
    of = sizes.agg(F.count(F.lit(1)).alias("keys"), F.sum(F.col("_nl").cast("double") * F.col("_nr")).alias("pairs"), F.sum("_nl").alias("left"), F.sum("_nr").alias("right")).first()
    pairs, cores = of["pairs"] or 0.0, left.sparkSession.sparkContext.defaultParallelism
    tasks = int(max(1, pairs // TASK_PAIRS, min(cores, pairs // CORE_PAIRS)))

    def sized(df: DataFrame, n: str, total: int) -> DataFrame:
        if of["keys"] <= BROADCAST_KEYS:
            return df.join(F.broadcast(sizes), on)
        return join_hot(df, sizes, on, hot_keys(sizes, on, n, total), spread=F.struct(*df.columns))

    blocks = lambda n: F.ceil(F.col(n) / block)
    mine = lambda df, n: F.pmod(F.xxhash64(*df.columns), blocks(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), blocks(n) - 1))
    rest = [c for c in right.columns if c not in on]
    rows = sized(left, "_nl", of["left"]).select(*left.columns, mine(left, "_nl").alias("_i"), each("_nr").alias("_j"))
    lists = sized(right, "_nr", of["right"]).groupBy(*on, mine(right, "_nr").alias("_j"), blocks("_nl").alias("_b")).agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    lists = lists.select(*on, "_j", "_rows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1)).alias("_i"))
    key = [*on, "_i", "_j"]
    met = rows.repartition(tasks, *key).join(lists.repartition(tasks, *key), key)
    return met.select(*left.columns, F.inline("_rows"))
