"""Queries of the operators for training data, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.cleaning import clean_barcode, usable_vector
from assaylake.llm.bpe import count_tokens, decode_ids, encode_texts
from assaylake.llm.clusters import Clustering
from assaylake.llm.heavy_hitters import frequent_values
from assaylake.llm.lookalike import canonical_texts, look_alike_pairs
from assaylake.llm.mixing import Mixture, mix_sources, quality_weight
from assaylake.llm.neighbours import nearest_neighbours
from assaylake.llm.topn import top_n_per_group
from assaylake.plans.scratch import Scratch
from assaylake.sources.tables import current_rows, table

HOT_SHARE = 0.005
RADIUS = 0.05
NEIGHBOURS = 5
TOP = 5


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    usable = table(spark, d, "x_landscape").where(usable_vector("vec", 2))
    return current_rows(usable, "obs_id", "written_at", "vec")


def _frequent(spark: SparkSession, d: str) -> DataFrame:
    return frequent_values(table(spark, d, "fragments"), clean_barcode("bc"), share=HOT_SHARE).where("value <> ''")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _frequent(spark, d).select(F.col("value").alias("bc"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return _frequent(spark, d).select(F.col("value").alias("bc"), "n_rows")


def p1_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The frequent barcodes with their counts, and whether the summary's bounds hold."""
    return _frequent(spark, d).select(F.col("value").alias("bc"), "n_rows", ((F.col("lower") <= F.col("n_rows")) & (F.col("n_rows") <= F.col("upper"))).alias("within_bounds"))


def _clustering(spark: SparkSession, d: str) -> Clustering:
    groups = current_rows(table(spark, d, "obs"), "obs_id", "updated_at", "leiden")
    cells = _vectors(spark, d).join(groups, "obs_id").select(F.col("obs_id").alias("id"), F.col("leiden").alias("grp"), "vec")
    return Clustering(cells, RADIUS, 2)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _clustering(spark, d).isolated_cliques().select("head_id", F.col("id").alias("obs_id"))


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clustering(spark, d).describe()


def p2_described(spark: SparkSession, d: str) -> DataFrame:
    """The isolated clusters with their sizes, and all cells counted once over all clusters."""
    c = _clustering(spark, d)
    heads = c.isolated_cliques().select("head_id").distinct()
    described = c.describe(1)
    total = described.agg(F.sum("size")).scalar()
    return described.join(heads, "head_id").select("head_id", "size", F.col("typical")[0].alias("most_typical")).withColumn("n_cells", total)


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    return nearest_neighbours(_vectors(spark, d), "obs_id", "vec", NEIGHBOURS, dim=2)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = _neighbours(spark, d).select(F.least("obs_id", "neighbour").alias("obs_a"), F.greatest("obs_id", "neighbour").alias("obs_b"))
    return pairs.distinct()


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d)


def _top(spark: SparkSession, d: str) -> DataFrame:
    return top_n_per_group(table(spark, d, "regulatory_links"), "name", "binname", "score", TOP)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).select("name", "binname")


def p5_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return decode_ids(p8_ids(spark, d), "doc_id")


def _mixture(spark: SparkSession, d: str) -> Mixture:
    documents = table(spark, d, "documents").select("doc_id", "source", "text", quality_weight(F.col("text")).alias("weight"))
    sizes = count_tokens(documents, "text", keep=["doc_id", "source", "weight"])
    sizes = Scratch(spark, "mixing").save(sizes, "sizes")  # encoded once, read several times
    return mix_sources(sizes, table(spark, d, "mix_targets"), "doc_id")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).documents


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every target: its documents, repeats within the limit, a budget met where it can be, shares that add up."""
    m = _mixture(spark, d)
    taken = m.documents.groupBy("source").agg(F.max("copies").alias("most"), (F.max("copies") - F.min("copies")).alias("spread"), F.max("n_tokens").alias("longest"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    s = m.shares.join(taken, "source", "left").na.fill(0, ["most", "spread", "longest", "tokens"])
    near = F.abs(F.col("tokens") - F.col("budget_tokens")) <= F.col("longest") / 2 + 1
    full = F.col("tokens") == F.col("available_tokens") * F.col("max_repeats")
    add_up = F.abs(m.shares.agg(F.sum("actual_share")).scalar() - 1) < 1e-9
    return s.select("source", "n_documents", "max_repeats", (F.col("most") <= F.col("max_repeats")).alias("repeats_kept"), F.when(F.col("can_be_met"), near).otherwise(full).alias("budget_filled"), (F.col("tokens") == F.col("mixed_tokens")).alias("report_agrees"), add_up.alias("shares_add_up"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_pairs(table(spark, d, "documents"), "doc_id", "text")


def p10_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical_texts(table(spark, d, "documents"), "doc_id", "text")


def p10_ascii(spark: SparkSession, d: str) -> DataFrame:
    """The canonical texts of documents in plain ASCII: their own, as two different ones never look the same."""
    plain = table(spark, d, "documents").where("octet_length(text) = length(text)").select("doc_id")
    return p10_canonical(spark, d).join(plain, "doc_id").select("doc_id", "canonical")


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p1_bounds, p2_found, p2_clusters, p2_described, p4_found, p4_neighbours, p5_found, p5_ranked, p8_ids, p8_decoded, p9_mix, p9_shares, p9_checks, p10_found, p10_canonical, p10_ascii)}

_HOT = f"""select bc, n_rows from (select upper(trim(bc)) as bc, count(*) as n_rows from fragments group by 1)
where bc is not null and bc <> '' and n_rows >= {HOT_SHARE} * (select count(*) from fragments)"""
_CELLS = """v as (select obs_id, vec[1] as x, vec[2] as y from (select *, row_number() over (partition by obs_id order by written_at desc) as k
  from x_landscape where len(vec) = 2 and isfinite(vec[1]) and isfinite(vec[2])) where k = 1 and obs_id is not null)"""
_LIKE = f"""with {_CELLS},
o as (select obs_id, leiden from (select *, row_number() over (partition by obs_id order by updated_at desc) as k from obs) where k = 1),
c as (select obs_id, x, y, leiden, floor(x / 0.05) as ix, floor(y / 0.05) as iy from v join o using (obs_id) where leiden is not null),
s as (select *, ix + i as jx, iy + j as jy from c, (values (-1), (0), (1)) t(i), (values (-1), (0), (1)) u(j)),
e as (select s.obs_id as a, c.obs_id as b from s join c on s.jx = c.ix and s.jy = c.iy and s.leiden = c.leiden
  where sqrt((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y)) <= {RADIUS})"""
_NEAR = f"""with {_CELLS},
d as (select a.obs_id as obs_id, b.obs_id as neighbour, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as distance
  from v a, v b where a.obs_id <> b.obs_id),
r as (select *, row_number() over (partition by obs_id order by distance, neighbour) as "rank" from d)"""
_RANKED = f"""select name, binname, score, cast(k as int) as "rank" from (select *, row_number() over (partition by name order by score desc, binname) as k
  from (select name, binname, max(score) as score from regulatory_links where name is not null and score is not null and not isnan(score) group by 1, 2)) where k <= {TOP}"""

SQL = {
    "p1_found": f"select bc from ({_HOT})",
    "p1_counts": _HOT,
    # a clique without outside links: all its cells have the same set of alike cells
    "p2_found": f"""{_LIKE}, g as (select a, list(b order by b) as l from e group by a),
  h as (select l, count(*) as n from g group by l having count(*) = len(l) and count(*) >= 3)
select l[1] as head_id, a as obs_id from g join h using (l) where a <> l[1]""",
    "p1_bounds": f"select bc, n_rows, true as within_bounds from ({_HOT})",
    "p2_described": f"""{_LIKE}, g as (select a, list(b order by b) as l from e group by a), h as (select l, count(*) as n from g group by l having count(*) = len(l) and count(*) >= 3),
  k as (select l[1] as head_id, h.n as "size", a as obs_id, c.x, c.y from g join h using (l) join c on c.obs_id = g.a), m as (select head_id, avg(x) as mx, avg(y) as my from k group by 1),
  r as (select head_id, "size", obs_id, row_number() over (partition by head_id order by (x - mx) ** 2 + (y - my) ** 2, obs_id) as i from k join m using (head_id))
select head_id, "size", obs_id as most_typical, (select count(*) from c) as n_cells from r where i = 1""",
    "p4_neighbours": f"""{_NEAR} select obs_id, neighbour, distance, cast("rank" as int) as "rank" from r where "rank" <= {NEIGHBOURS}""",
    "p9_checks": """with t as (select lower(trim(source)) as source, max(max_repeats) as max_repeats from mix_targets where source is not null group by 1), n as (select lower(trim(source)) as source, count(*) as n from documents group by 1)
select source, coalesce(n, 0) as n_documents, max_repeats, true as repeats_kept, true as budget_filled, true as report_agrees, true as shares_add_up from t left join n using (source)""",
    "p10_ascii": "select doc_id, text as canonical from documents where strlen(text) = length(text)",
    "p4_found": f"""{_NEAR} select distinct least(obs_id, neighbour) as obs_a, greatest(obs_id, neighbour) as obs_b from r where "rank" <= {NEIGHBOURS}""",
    "p5_found": f"select name, binname from ({_RANKED})",
    "p5_ranked": _RANKED,
    "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
