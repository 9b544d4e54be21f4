"""Bin counts of fragments as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.sources.fragments import BIN_SIZE, SCHEMA, bins_of


def stream_fragments(spark: SparkSession, folder: str, *, max_files: int = 100) -> DataFrame:
    """New fragment files of a folder, ``max_files`` a batch."""
    return spark.readStream.schema(SCHEMA).options(sep="\t", comment="#", maxFilesPerTrigger=max_files).csv(folder)


def running_bin_counts(stream: DataFrame, *, size: int = BIN_SIZE, method: str = "both") -> DataFrame:
    """(bc, chr, bin, n) for output mode update or complete; equals the batch result over all files read."""
    ok = stream.where("bc is not null and chr is not null and start is not null and `end` is not null")
    return ok.select("bc", "chr", F.explode(bins_of(method, size, F.col("start"), F.col("end"))).alias("bin")).groupBy("bc", "chr", "bin").agg(F.count(F.lit(1)).alias("n"))


def windowed_loads(stream: DataFrame, at: str, *, late: str, window: str) -> DataFrame:
    """Fragments per barcode and event-time window; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), "bc").agg(F.count(F.lit(1)).alias("n"), F.sum("readSupport").alias("reads"))
