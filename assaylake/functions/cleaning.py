"""The reading rule of the fragment tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHROM_PREFIX = "chr"


def clean_barcode(c: Column | str) -> Column:
    """Barcodes are compared after trimming blanks and upper-casing; null stays null."""
    return F.upper(F.trim(F.col(c) if isinstance(c, str) else c))


def clean_chrom(c: Column | str) -> Column:
    """A chromosome name without the prefix ``chr`` means the one with it; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.startswith(CHROM_PREFIX), c).otherwise(F.concat(F.lit(CHROM_PREFIX), c))


def usable_vector(c: Column | str, dim: int | None = None) -> Column:
    """True for a vector (of ``dim`` elements, if given) whose elements are all finite."""
    c = F.col(c) if isinstance(c, str) else c
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    size = F.size(c) == dim if dim is not None else F.size(c) > 0
    return F.coalesce(c.isNotNull() & size & finite, F.lit(False))
