"""Queries over the fragment tables: intervals, parsing, skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.cleaning import clean_barcode
from assaylake.operators.intervals import interval_gaps, merge_intervals
from assaylake.operators.keyed import aggregate_by_key, keys_with_share
from assaylake.operators.parsing import failed_rows, valid_rows
from assaylake.plans.joins import semi_join_skewed
from assaylake.sources.tables import clean_fragments, table

MAX_GAP = 2_000
HOT_SHARE = 0.01


def _cell_fragments(spark: SparkSession, d: str) -> DataFrame:
    rows = clean_fragments(table(spark, d, "fragments").select("chr", "start", "end", "bc"))
    rows = rows.where("chr is not null and start >= 0 and start < end")
    cells = table(spark, d, "obs").select(F.col("obs_id").alias("bc"))
    return semi_join_skewed(rows, cells, "bc", spread=F.col("start"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return interval_gaps(_cell_fragments(spark, d), ["bc", "chr"]).where(F.col("gap_end") - F.col("gap_start") <= MAX_GAP)


def p3_stretches(spark: SparkSession, d: str) -> DataFrame:
    return merge_intervals(_cell_fragments(spark, d), ["bc", "chr"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return failed_rows(table(spark, d, "fragment_lines"), table(spark, d, "genome_sizes")).select("line_id", "reason")


def p6_valid(spark: SparkSession, d: str) -> DataFrame:
    return valid_rows(table(spark, d, "fragment_lines"), table(spark, d, "genome_sizes"))


def _p7(spark: SparkSession, d: str) -> DataFrame:
    rows = clean_fragments(table(spark, d, "fragments").select("chr", "start", "end", "bc"))
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.min("start").alias("range_start"), F.max("end").alias("range_end")]
    return aggregate_by_key(rows, ["bc", "chr"], aggs)


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    total = table(spark, d, "fragments").agg(F.count(F.lit(1)))
    named = _p7(spark, d).where("bc is not null and bc <> '' and chr is not null")
    return keys_with_share(named, total, HOT_SHARE).select("bc", "chr")


QUERIES = {f.__name__: f for f in (p3_found, p3_stretches, p6_found, p6_valid, p7_found, p7_groups)}

_CLEAN = """f as (select upper(trim(bc)) as bc, case when starts_with(chr, 'chr') then chr else 'chr' || chr end as chr,
  "start" as s, "end" as e from fragments)"""
_STRETCHES = f"""with {_CLEAN},
c as (select f.* from f where chr is not null and s >= 0 and s < e and bc in (select obs_id from obs)),
r as (select *, max(e) over (partition by bc, chr order by s, e rows between unbounded preceding and 1 preceding) as reach from c)"""
_PARTS = """with g as (select chr, length, chr as spelling from genome_sizes union all
  select chr, length, substring(chr, 4) from genome_sizes where starts_with(chr, 'chr')),
t as (select line_id, regexp_replace(line, '\\r$', '') as text from fragment_lines),
r as (select line_id, text, string_split(text, chr(9)) as raw from t where text is not null and text <> '' and not starts_with(text, '#')),
v as (select line_id, raw, list_transform(raw, lambda x: case when len(x) >= 2 and starts_with(x, '"') and ends_with(x, '"') then substring(x, 2, len(x) - 2) else x end) as f from r),
w as (select v.*, g.chr as long_chr, g.length as length from v left join g on g.spelling = v.f[1]),
z as (select *, case
  when len(list_filter(f, lambda x: contains(x, '"'))) > 0 then 'quoting'
  when len(raw) <> 5 then 'column_count'
  when length is null then 'chr'
  when not regexp_full_match(f[2], '[0-9]+') or coalesce(try_cast(f[2] as hugeint) >= length, true) then 'start'
  when not regexp_full_match(f[5], '[0-9]*[1-9][0-9]*') then 'readSupport' end as reason from w)"""

SQL = {
    "p3_found": f"""{_STRETCHES} select bc, chr, reach as gap_start, s as gap_end from r where s > reach and s - reach <= {MAX_GAP}""",
    "p3_stretches": f"""{_STRETCHES}, i as (select *, sum(case when reach is null or s > reach then 1 else 0 end)
  over (partition by bc, chr order by s, e rows unbounded preceding) as k from r)
select bc, chr, min(s) as "start", max(e) as "end", count(*) as n_intervals from i group by bc, chr, k""",
    "p6_found": f"{_PARTS} select line_id, reason from z where reason is not null",
    "p6_valid": f"""{_PARTS} select line_id, long_chr as chr, cast(f[2] as bigint) as "start",
  case when regexp_full_match(f[3], '[0-9]+') then try_cast(f[3] as bigint) end as "end", f[4] as bc, try_cast(f[5] as bigint) as "readSupport" from z where reason is null""",
    "p7_groups": f"""with {_CLEAN} select bc, chr, count(*) as n_rows, min(s) as range_start, max(e) as range_end from f group by bc, chr""",
    "p7_found": f"""with {_CLEAN} select bc, chr from f where bc is not null and bc <> '' and chr is not null
  group by bc, chr having count(*) >= {HOT_SHARE} * (select count(*) from fragments)""",
}
