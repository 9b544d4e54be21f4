"""Loading of raw fragment lines: the valid rows, and the rest with the reason why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.cleaning import CHROM_PREFIX

FIELDS = ("chr", "start", "end", "bc", "readSupport")
REASONS = ("quoting", "column_count", "chr", "start", "readSupport")

#: One field of a conforming line: quoted, or without any double quote.
_FIELD = r'(?:"([^"\t]*)"|([^"\t]*))'
_LINE = "^" + r"\t".join([_FIELD] * len(FIELDS)) + r"\z"
_DIGITS = r"^[0-9]+\z"
_POSITIVE = r"^[0-9]*[1-9][0-9]*\z"
#: A field that breaks the quoting rule: any double quote but one pair around the whole field.
_BAD_QUOTES = r'^(?!"[^"]*"\z)[^"]*"'


def _without_cr(line: Column) -> Column:
    return F.regexp_replace(line, r"\r\z", "")


def _records(lines: DataFrame, line: str) -> DataFrame:
    """The lines that are records, without their carriage return."""
    text = _without_cr(F.col(line))
    return lines.withColumn("_text", text).where(F.col("_text").isNotNull() & (F.col("_text") != "") & ~F.col("_text").startswith("#"))


def _value(digits: Column) -> Column:
    """A string of digits as a number; null if it is longer than any BIGINT."""
    return F.regexp_replace(digits, r"^0+(?=[0-9])", "").try_cast("bigint")


def _genome(genome: DataFrame) -> DataFrame:
    """Every accepted spelling of a chromosome: (spelling, chr, length); one without a length isn't known."""
    short = F.when(F.col("chr").startswith(CHROM_PREFIX), F.expr(f"substring(chr, {len(CHROM_PREFIX) + 1})"))
    names = genome.where(F.col("chr").isNotNull() & F.col("length").isNotNull()).select("chr", "length", F.explode(F.array("chr", short)).alias("spelling"))
    return names.where(F.col("spelling").isNotNull()).groupBy("spelling").agg(F.min_by("chr", F.struct((F.col("chr") != F.col("spelling")), "chr")).alias("chr"), F.max("length").alias("length"))


def load_strict(lines: DataFrame, genome: DataFrame, *, line: str = "line") -> DataFrame:
    """Only the conforming records, typed: the columns of ``lines`` plus ``_rec`` (a struct of FIELDS).

    A line conforms if one pattern matches the whole of it, its chromosome is
    known, its start lies on the chromosome and its readSupport is a positive
    number. ``end`` and ``bc`` are not tested; an ``end`` that is no number, and
    a readSupport beyond BIGINT, load as null.
    """
    hits = _records(lines, line).where(F.col("_text").rlike(_LINE))
    field = [F.concat(F.regexp_extract("_text", _LINE, 2 * i + 1), F.regexp_extract("_text", _LINE, 2 * i + 2)) for i in range(len(FIELDS))]
    typed = hits.withColumns({f"_{n}": c for n, c in zip(FIELDS, field)}).where(F.col("_start").rlike(_DIGITS) & F.col("_readSupport").rlike(_POSITIVE))
    known = typed.join(_genome(genome).withColumnsRenamed({"chr": "_full", "length": "_length"}), F.col("_chr") == F.col("spelling"), "inner")
    rec = F.struct(
        F.col("_full").alias("chr"), _value(F.col("_start")).alias("start"), F.when(F.col("_end").rlike(_DIGITS), _value(F.col("_end"))).alias("end"),
        F.col("_bc").alias("bc"), _value(F.col("_readSupport")).alias("readSupport"),
    )
    return known.where(_value(F.col("_start")) < F.col("_length")).select(*lines.columns, rec.alias("_rec"))


def diagnose(lines: DataFrame, genome: DataFrame, *, line: str = "line") -> DataFrame:
    """Adds ``reason``, the first of REASONS that applies to a record, null if none does."""
    parts = _records(lines, line).withColumn("_raw", F.split("_text", "\t", -1))
    value = [F.regexp_replace(F.get("_raw", F.lit(i)), r'^"([^"]*)"\z', "$1") for i in range(len(FIELDS))]
    parts = parts.withColumns({f"_{n}": c for n, c in zip(FIELDS, value)})
    known = parts.join(_genome(genome).select("spelling", F.col("length").alias("_length")), F.col("_chr") == F.col("spelling"), "left")
    start = _value(F.col("_start"))
    reason = (
        F.when(F.exists("_raw", lambda f: f.rlike(_BAD_QUOTES)), "quoting")
        .when(F.size("_raw") != len(FIELDS), "column_count")
        .when(F.col("spelling").isNull(), "chr")
        .when(~F.col("_start").rlike(_DIGITS) | start.isNull() | (start >= F.col("_length")), "start")
        .when(~F.col("_readSupport").rlike(_POSITIVE), "readSupport")
    )
    return known.select(*lines.columns, reason.alias("reason"))


def valid_rows(lines: DataFrame, genome: DataFrame, *, offset: str = "line_id", line: str = "line") -> DataFrame:
    """The loaded fragments: (offset, chr, start, end, bc, readSupport)."""
    return load_strict(lines, genome, line=line).select(offset, *[F.col(f"_rec.{n}").alias(n) for n in FIELDS])


def failed_rows(lines: DataFrame, genome: DataFrame, *, offset: str = "line_id", line: str = "line") -> DataFrame:
    """(offset, line, reason) of every record that fails: raw offsets minus loaded ones, diagnosed.

    Null and empty lines and comments are no records and never fail. A record is
    known by its offset together with its text, both compared null-safe, so a
    null or repeated offset neither hides a failure nor makes a valid row fail;
    repeated lines come out as often as they occur. An empty table gives no rows;
    further columns are ignored. Valid and failed rows together are all records: a
    record that isn't loaded and has no reason would be an error, never a lost row.
    """
    raw = lines.select(offset, line)
    loaded = load_strict(raw, genome, line=line).select(F.col(offset).alias("_o"), F.xxhash64(line).alias("_h")).distinct()
    rest = raw.join(loaded, F.col(offset).eqNullSafe(F.col("_o")) & (F.xxhash64(line) == F.col("_h")), "left_anti")
    found = diagnose(rest, genome, line=line)
    return found.withColumn("reason", F.coalesce("reason", F.raise_error(F.lit("a record was not loaded and has no reason"))))
