"""Tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.cleaning import clean_barcode, clean_chrom


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def current_rows(df: DataFrame, key: str, updated: str, *values: str) -> DataFrame:
    """The latest row of each non-null key: one ``max_by`` aggregate, combined map-side.

    Rows with a null time count as the oldest. Equal times are decided by the
    values themselves, so repeated rows never make the result uncertain.
    """
    order = F.struct(F.col(updated), *[F.col(v) for v in values])
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max(order).alias("_r"))
        .select(key, *[F.col(f"_r.{v}").alias(v) for v in values])
    )


def clean_fragments(df: DataFrame) -> DataFrame:
    """Barcodes and chromosomes in their compared form; other columns as they are."""
    return df.withColumns({"bc": clean_barcode("bc"), "chr": clean_chrom("chr")})
