"""Mixing of sources to target shares of the total size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of a source by sampling key. A slice is the unit of parallel work, so a
#: source with a third of all rows is spread over as many tasks.
SLICES = 1_024
SEED = 20
#: Weights are raised to this at least; the sampling key divides by them.
LEAST_WEIGHT = 1e-6


@dataclass(frozen=True)
class Mixture:
    """``documents``: (key, source, n_tokens, copies), copies >= 1; ``shares``: one row per target."""

    documents: DataFrame
    shares: DataFrame


def clean_source(c: Column) -> Column:
    return F.lower(F.trim(c))


def quality_weight(text: Column) -> Column:
    """A document's weight in (0, 1]: its share of ASCII letters, less for very short texts."""
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    size = F.length(text)
    share = (size - F.length(F.translate(text, letters, ""))) / F.greatest(size, F.lit(1))
    return F.coalesce(F.greatest(share * size / (size + F.lit(200.0)), F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT))


def _uniform(key: Column, seed: int) -> Column:
    """In (0, 1), from the key alone: the same at any partitioning and after any lost executor."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def plan_sources(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target with its budget, whole epochs and the rest that a fraction must fill."""
    wanted = (
        targets.select(clean_source(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
        .where(F.col("source").isNotNull())
        .groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count(F.lit(1)).alias("n_documents"), F.avg("weight").alias("_w"))
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)))
    out = wanted.join(have, "source", "left").na.fill(0, ["available", "n_documents"])
    out = out.withColumn("all_tokens", total.scalar()).withColumn("budget", F.col("target_share") * F.col("all_tokens"))
    epochs = F.when(F.col("available") > 0, F.least(F.floor(F.col("budget") / F.col("available")), F.col("max_repeats"))).otherwise(F.lit(0))
    out = out.withColumn("epochs", epochs.cast("int"))
    return out.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(F.lit(0.0)))


def mix_sources(sizes: DataFrame, targets: DataFrame, key: str, *, seed: int = SEED, slices: int = SLICES) -> Mixture:
    """Each target source with its share of the tokens of all documents.

    ``sizes`` holds (key, source, n_tokens, weight) and should be a written table,
    as it is read several times. A source's budget is its target share of the
    tokens of all rows, those of sources without a target included. It is filled
    by complete epochs first, each of which takes every document once; what
    remains is filled by a fraction drawn without replacement with probabilities
    that follow the weights (exponential keys divided by the weight, smallest
    first), up to the document that comes nearest to the budget. No document is
    taken more than ``max_repeats`` times; a budget beyond that can't be met, and
    the share reached says so. A target without documents reaches 0. The report
    gives both the share of the mixture (``actual_share``) and of the tokens of
    all documents (``share_of_all``, what the target is meant for).

    The prefix sums run over slices of the key range and then within slices, so no
    task orders a whole source. Documents without a source, or with one that is no
    target, are not taken. Repeated rows are documents of their own. Null weights
    count as the least; null sizes as 0. A source named twice among the targets
    has the sum of its shares and the larger number of repeats.
    """
    sizes = sizes.select(key, clean_source(F.col("source")).alias("source"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(LEAST_WEIGHT)).alias("weight"))
    plan = plan_sources(sizes, targets)
    rows = sizes.join(plan.select("source", "epochs", "rest", "_w"), "source")
    drawn = -F.log(_uniform(F.col(key), seed)) / F.col("weight")
    rows = rows.withColumn("_key", drawn)
    rows = rows.withColumn("_slice", F.least(F.floor((1 - F.exp(-F.col("_key") * F.col("_w"))) * slices), F.lit(slices - 1)).cast("int"))
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source", "_slice").agg(F.sum("n_tokens").alias("_n")).select("source", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("source", "_slice").orderBy("_key", key).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.sum("n_tokens").over(within)).join(starts, ["source", "_slice"])
    end = F.col("_start") + F.col("_upto")
    over, under = end - F.col("rest"), F.col("rest") - (end - F.col("n_tokens"))
    taken = (F.col("rest") > 0) & ((over <= 0) | ((under > 0) & (over < under)))
    copies = (F.col("epochs") + F.when(taken, 1).otherwise(0)).cast("int")
    documents = rows.select(key, "source", "n_tokens", copies.alias("copies")).where("copies > 0")
    reached = documents.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    shares = plan.join(reached, "source", "left").na.fill(0, ["mixed_tokens", "most_copies"])
    whole = reached.agg(F.sum("mixed_tokens"))
    shares = shares.select(
        "source", "target_share", "max_repeats", "n_documents", F.col("available").alias("available_tokens"), F.col("budget").alias("budget_tokens"), "mixed_tokens", "most_copies",
        F.coalesce(F.try_divide(F.col("mixed_tokens"), F.col("all_tokens")), F.lit(0.0)).alias("share_of_all"), F.coalesce(F.try_divide(F.col("mixed_tokens"), whole.scalar()), F.lit(0.0)).alias("actual_share"), (F.col("available") * F.col("max_repeats") >= F.col("budget")).alias("can_be_met"),
    )
    return Mixture(documents, shares)
