"""Fragment files to a cell x bin layer, and back to per-category bulk files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.cleaning import CHROM_PREFIX
from assaylake.model import Assay

SCHEMA = "chr string, start long, end long, bc string, readSupport long"
BIN_SIZE = 5_000
METHODS = ("both", "start", "end")


def read_fragments(spark: SparkSession, path: str, **options) -> DataFrame:
    """A tab-separated fragment file without header; lines that start with # are comments."""
    return spark.read.schema(SCHEMA).options(sep="\t", comment="#", **options).csv(path)


def bins_of(method: str, size: int, start: Column, end: Column) -> Column:
    """The bins a fragment counts in: those of its ends, once if they are the same."""
    a, b = F.floor(start / size), F.floor(end / size)
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    return {"both": F.array_distinct(F.array(a, b)), "start": F.array(a), "end": F.array(b)}[method]


def bin_names(chrom: Column, bin_: Column, size: int) -> Column:
    return F.concat(chrom, F.lit(":"), (bin_ * size).cast("string"), F.lit("-"), ((bin_ + 1) * size).cast("string"))


def count_bins(fragments: DataFrame, *, size: int = BIN_SIZE, method: str = "both") -> DataFrame:
    """(bc, chr, bin, n): one count a fragment and bin, summed over repeated lines.

    Rows with a null in a needed column are no fragments. Hot cells and bins are
    combined map-side.
    """
    needed = {"both": ("start", "end"), "start": ("start",), "end": ("end",)}[method]
    ok = fragments.where(" and ".join(f"`{c}` is not null" for c in ("bc", "chr", *needed)))
    return ok.select("bc", "chr", F.explode(bins_of(method, size, F.col("start"), F.col("end"))).alias("bin")).groupBy("bc", "chr", "bin").agg(F.count(F.lit(1)).alias("n"))


def match_chrom_names(fragments: DataFrame, genome: DataFrame, chr_name_format: str = "auto") -> DataFrame:
    """Adds the prefix to all names if none of the file has it and all of the genome's do (``auto``)."""
    if chr_name_format == "full":
        return fragments
    prefixed = F.concat(F.lit(CHROM_PREFIX), F.col("chr"))
    if chr_name_format == "short":
        return fragments.withColumn("chr", prefixed)
    if chr_name_format != "auto":
        raise ValueError("chr_name_format is auto, full or short")
    in_file = fragments.agg(F.bool_or(F.col("chr").startswith(CHROM_PREFIX)))
    in_genome = genome.agg(F.bool_and(F.col("chr").startswith(CHROM_PREFIX)))
    add = ~F.coalesce(in_file.scalar(), F.lit(False)) & F.coalesce(in_genome.scalar(), F.lit(False))
    return fragments.withColumn("chr", F.when(add, prefixed).otherwise(F.col("chr")))


def fragments(source: DataFrame, genome: DataFrame, bin_size: int = BIN_SIZE, *, method: str = "both", ignore_missing_chr: bool = False, chr_name_format: str = "auto", layer: str = "X") -> Assay:
    """A cell x bin assay.

    Features are all bins of the chromosomes that occur; cells are all barcodes
    that occur, those seen only on an ignored chromosome included. A chromosome
    the genome lacks is an error unless ``ignore_missing_chr``.
    """
    named = match_chrom_names(source, genome, chr_name_format)
    seen = named.where("chr is not null").select("chr").distinct()
    if not ignore_missing_chr:
        missing = [r.chr for r in seen.join(genome, "chr", "left_anti").limit(20).collect()]
        if missing:
            raise ValueError(f"not in the genome: {missing}")
    known = genome.join(seen, "chr", "left_semi")
    last = F.floor(F.col("length") / bin_size)
    bins = known.select("chr", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("bin"))
    var = bins.select(bin_names(F.col("chr"), F.col("bin"), bin_size).alias("var_id"), "chr", (F.col("bin") * bin_size).alias("start"), ((F.col("bin") + 1) * bin_size).alias("end"))
    counts = count_bins(named.join(known.select("chr"), "chr", "left_semi"), size=bin_size, method=method)
    coo = counts.select(F.col("bc").alias("obs_id"), bin_names(F.col("chr"), F.col("bin"), bin_size).alias("var_id"), F.col("n").cast("double").alias("value"))
    obs = named.where("bc is not null").select(F.col("bc").alias("obs_id")).distinct()
    return Assay(obs, var, {layer: coo})


def bulk_fragments(fragments_: DataFrame, obs: DataFrame, category: str, *, whitelisted_chr: list[str] | None = None) -> DataFrame:
    """(category, chr, start, end, bc): the fragments of the cells of each category."""
    cats = obs.where(F.col(category).isNotNull()).select(F.col("obs_id").alias("bc"), F.col(category).alias("category"))
    rows = fragments_ if whitelisted_chr is None else fragments_.where(F.col("chr").isin(whitelisted_chr))
    return rows.join(cats, "bc").select("category", "chr", "start", "end", "bc")


def write_bulks(bulks: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """One folder of tab-separated files (chr, start, end, bc) for each category."""
    bulks.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("category").option("sep", "\t").csv(path)
