"""Sources, metadata, filters, layers, summaries, regulation: reference operators on the general tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.model import LayerSpec, Pct
from assaylake.operators import layers as L
from assaylake.operators import metadata as M
from assaylake.operators import regulation as R
from assaylake.operators import summaries as S
from assaylake.queries._adapt import BASE, BRANDS, DIGITS, FRAGS, event_fragments, rounded, sql_round, supplier_brands, supplier_parts
from assaylake.sources.annotation import regulatory_links
from assaylake.sources.export import feature_bed
from assaylake.sources.fragments import bulk_fragments, count_bins, fragments
from assaylake.sources.genomes import GENOMES, genome_sizes
from assaylake.sources.tables import clean_fragments, current_rows, table

QUERIES: dict = {}
SQL: dict = {}
BIN = 5_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# sources

_CELLFRAG = """c as (select upper(trim(bc)) as bc, case when starts_with(chr, 'chr') then chr else 'chr' || chr end as chr, "start" as s, "end" as e from fragments),
k as (select * from c where bc is not null and chr is not null and chr in (select chr from genome_sizes))"""


def _known(spark: SparkSession, d: str) -> DataFrame:
    return clean_fragments(table(spark, d, "fragments")).join(table(spark, d, "genome_sizes").select("chr"), "chr", "left_semi")


@query(f"""with {_CELLFRAG}, p as (select bc, chr, unnest(list_distinct([floor(s / {BIN}.0), floor(e / {BIN}.0)])) as bin from k where s is not null and e is not null)
select bc, chr, cast(bin as bigint) as bin, count(*) as n from p group by all""")
def fragments_bin_both(spark: SparkSession, d: str) -> DataFrame:
    return count_bins(_known(spark, d), size=BIN, method="both")


@query(f"""with {_CELLFRAG} select bc, chr, cast(floor(s / {BIN}.0) as bigint) as bin, count(*) as n from k where s is not null group by all""")
def fragments_bin_start(spark: SparkSession, d: str) -> DataFrame:
    return count_bins(_known(spark, d), size=BIN, method="start")


@query(f"""with {_CELLFRAG} select bc, chr, cast(floor(e / {BIN}.0) as bigint) as bin, count(*) as n from k where e is not null group by all""")
def fragments_bin_end(spark: SparkSession, d: str) -> DataFrame:
    return count_bins(_known(spark, d), size=BIN, method="end")


@query(f"""with {_CELLFRAG}, p as (select bc as obs_id, chr, unnest(list_distinct([cast(floor(s / {BIN}.0) as bigint), cast(floor(e / {BIN}.0) as bigint)])) as bin from k where s is not null and e is not null),
t as (select chr || ':' || (bin * {BIN})::varchar || '-' || ((bin + 1) * {BIN})::varchar as var_id, count(*) as n from p group by 1)
select count(*) as n_features, cast(sum(coalesce(n, 0)) as double) as total from (select g.chr || ':' || (i * {BIN})::varchar || '-' || ((i + 1) * {BIN})::varchar as var_id
  from genome_sizes g, lateral (select unnest(generate_series(0, length // {BIN})) as i) where g.chr in (select chr from k)) u left join t using (var_id)""")
def fragments_feature_totals(spark: SparkSession, d: str) -> DataFrame:
    """Bins of the chromosomes that occur, and the counts that fall into them."""
    a = fragments(clean_fragments(table(spark, d, "fragments")), table(spark, d, "genome_sizes"), BIN, ignore_missing_chr=True)
    return M.totals(a.var, a.layer("X"), "var_id").agg(F.count(F.lit(1)).alias("n_features"), F.sum("total").alias("total"))


@query(f"""with {_CELLFRAG}, o as (select obs_id, arg_max(struct_pack(l := leiden), updated_at).l as leiden from obs group by 1)
select cast(leiden as varchar) as category, chr, count(*) as n, min(s) as first_start, max(e) as last_end from c join o on bc = obs_id where leiden is not null and chr in ('chr1L', 'chr1R', 'chrX') group by all""")
def bulk_profiles(spark: SparkSession, d: str) -> DataFrame:
    obs = current_rows(table(spark, d, "obs"), "obs_id", "updated_at", "leiden").withColumn("leiden", F.col("leiden").cast("string"))
    bulks = bulk_fragments(clean_fragments(table(spark, d, "fragments")), obs, "leiden", whitelisted_chr=["chr1L", "chr1R", "chrX"])
    return bulks.groupBy("category", "chr").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))


@query("""with g as (select chr, greatest(promoter - 500, 0) as "start", promoter + 500 as "end", var_id from var_genes where promoter is not null),
l as (select * exclude (name, binname) from regulatory_links where chr is not null and "start" is not null and "end" is not null and chr2 is not null and start2 is not null and end2 is not null and score is not null and not isnan(score) and pval is not null and qval is not null and score > 0.1),
m as (select l.*, g.var_id as gene, chr2 || ':' || start2 || '-' || end2 as bin from l left join g using (chr, "start", "end"))
select bin as binname, gene as name, max(score) as score from m group by 1, 2""")
def promoter_links_best(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "regulatory_links").drop("name", "binname").where(~F.isnan("score"))
    return regulatory_links(links, table(spark, d, "var_genes")).select("binname", "name", "score")


@query("with t(assembly, chr, length) as (values " + ", ".join(f"('{n}', '{c}', {s})" for n, g in GENOMES.items() for c, s in g.items()) + ") select assembly, count(*) as chromosomes, cast(sum(length) as bigint) as bases from t group by 1")
def genome_lengths(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in GENOMES:
        g = genome_sizes(spark, name).agg(F.lit(name).alias("assembly"), F.count(F.lit(1)).alias("chromosomes"), F.sum("length").alias("bases"))
        out = g if out is None else out.unionByName(g)
    return out


@query("""select regexp_extract(binname, '^(.*):(\\d+)-(\\d+)$', 1) as c1, cast(regexp_extract(binname, '^(.*):(\\d+)-(\\d+)$', 2) as bigint) as c2, cast(regexp_extract(binname, '^(.*):(\\d+)-(\\d+)$', 3) as bigint) as c3,
  """ + ", ".join(f"'.' as c{i}" for i in range(4, 13)) + """ from (select distinct binname from regulatory_links where binname is not null)""")
def features_bed(spark: SparkSession, d: str) -> DataFrame:
    return feature_bed(table(spark, d, "regulatory_links").where("binname is not null").select("binname").distinct(), "binname")


# metadata and filters


@query(f"{BASE} select obs_id, coalesce(sum(value), 0) as total from o left join q using (obs_id) group by 1")
def total_counts_obs(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_parts(spark, d)
    return M.totals(a.obs.select("obs_id"), a.layer("qty"), "obs_id")


@query(f"{BASE} select var_id, coalesce(sum(value), 0) as total from v left join q using (var_id) group by 1")
def total_counts_var(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_parts(spark, d)
    return M.totals(a.var.select("var_id"), a.layer("qty"), "var_id")


@query("""select distinct binname as var_id, split_part(binname, ':', 1) as chr, cast(split_part(split_part(binname, ':', 2), '-', 1) as int) as "start", cast(split_part(binname, '-', 2) as int) as "end" from regulatory_links where binname is not null""")
def feature_locations(spark: SparkSession, d: str) -> DataFrame:
    from assaylake.model import Assay

    var = table(spark, d, "regulatory_links").where("binname is not null").select(F.col("binname").alias("var_id")).distinct()
    return M.add_metadata(Assay(spark.createDataFrame([], "obs_id string"), var), {}).var


_LOW_OBS, _LOW_VAR = 14_900.0, 600.0
_ONE = f"""{BASE}, o1 as (select obs_id from o left join q using (obs_id) group by 1 having coalesce(sum(value), 0) > {_LOW_OBS}),
v1 as (select var_id from v left join (select * from q where obs_id in (select obs_id from o1)) using (var_id) group by 1 having coalesce(sum(value), 0) > {_LOW_VAR})"""


@query(f"{_ONE} select 'obs' as side, obs_id as id from o1 union all select 'var', var_id from v1")
def filter_onepass(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d, [_LOW_OBS], [_LOW_VAR], iterate=False)


_FIX_OBS, _FIX_VAR, _UNROLLED = 12_000.0, 400.0, 8


def _rounds() -> str:
    """The alternating filter unrolled far beyond where it comes to rest on these tables."""
    out = [f"{BASE}, o0 as (select obs_id from o), v0 as (select var_id from v)"]
    for k in range(1, _UNROLLED + 1):
        out.append(f"o{k} as (select obs_id from o{k - 1} left join (select * from q where var_id in (select var_id from v{k - 1})) using (obs_id) group by 1 having coalesce(sum(value), 0) > {_FIX_OBS})")
        out.append(f"v{k} as (select var_id from v{k - 1} left join (select * from q where obs_id in (select obs_id from o{k})) using (var_id) group by 1 having coalesce(sum(value), 0) > {_FIX_VAR})")
    return ", ".join(out) + f" select 'obs' as side, obs_id as id from o{_UNROLLED} union all select 'var', var_id from v{_UNROLLED}"


@query(_rounds())
def filter_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d, [_FIX_OBS], [_FIX_VAR], iterate=True)


@query(f"""{BASE}, t as (select obs_id, coalesce(sum(value), 0) as s from o left join q using (obs_id) group by 1), o1 as (select obs_id from t where s > (select quantile_cont(s, 0.2) from t)),
u as (select var_id, coalesce(sum(value), 0) as s from v left join q using (var_id) group by 1),
v1 as (select var_id from v left join (select * from q where obs_id in (select obs_id from o1)) using (var_id) group by 1 having coalesce(sum(value), 0) > (select quantile_cont(s, 0.1) from u))
select 'obs' as side, obs_id as id from o1 union all select 'var', var_id from v1""")
def filter_percentile(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d, [Pct(20)], [Pct(10)], iterate=False)


def _kept(spark: SparkSession, d: str, min_obs: list, min_var: list, *, iterate: bool) -> DataFrame:
    a = M.filter_assay(supplier_parts(spark, d), ["qty"], min_obs, min_var, iterate=iterate)
    one = lambda df, side, key: df.where(~F.col("exclude")).select(F.lit(side).alias("side"), F.col(key).alias("id"))
    return one(a.obs, "obs", "obs_id").unionByName(one(a.var, "var", "var_id"))


@query(f"{BASE} select var_id from q group by 1 having sum(value) > 700 and sum(value) < 900")
def pick_features_range(spark: SparkSession, d: str) -> DataFrame:
    return M.pick_features(supplier_parts(spark, d).layer("qty"), low=700, high=900)


@query(f"{BASE} select obs_id, coalesce(sum(case when value > 25 then 1.0 end), 0.0) as copied_data from o left join q using (obs_id) group by 1")
def copy_to_obs(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_parts(spark, d)
    return M.copy_to_obs(a.obs.select("obs_id"), a.layer("qty"), binarize_above=25)


@query(f"""{BASE}, w as (select distinct name as var_id from regulatory_links where name is not null union select var_id from v) select count(*) as n_features, count(*) filter (where var_id in (select var_id from v)) as n_old from w""")
def set_missing_zero(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_parts(spark, d)
    extra = table(spark, d, "regulatory_links").where("name is not null").select(F.col("name").alias("var_id"))
    out = M.set_missing_to_zero(a, extra).var
    return out.agg(F.count(F.lit(1)).alias("n_features"), F.count("brand").alias("n_old"))


@query(sql_round(f"{BASE} select count(*) as n_values, sum(value) as total, sum(price) as price from q where value > 50", ["total", "price"], ["n_values"], 1))
def stack_layers(spark: SparkSession, d: str) -> DataFrame:
    from assaylake.model import Assay

    a = supplier_parts(spark, d)
    qty = a.layer("qty").where("value > 50")
    both = M.stack_assays([Assay(a.obs, a.var, {"X": qty}), Assay(a.obs, a.var, {"X": a.layer("price")})], ["qty", "price"])
    joined = both.layer("qty").join(both.layer("price").withColumnRenamed("value", "price"), ["obs_id", "var_id"])
    return rounded(joined.agg(F.count(F.lit(1)).alias("n_values"), F.sum("value").alias("total"), F.sum("price").alias("price")), "total", "price", digits=1)


@query(f"{BASE} select var_id as obs_id, obs_id as var_id, value from q")
def transpose(spark: SparkSession, d: str) -> DataFrame:
    return M.transpose(supplier_parts(spark, d), ["qty"]).layer("qty")


@query("""with r as (select var_id as id, chr, case when promoter = "start" then '+' else '-' end as strand, "start" as s, "end" as e from var_genes where promoter is not null),
n as (select distinct name as var_id from regulatory_links where name is not null union select 'no such gene')
select var_id, chr, strand, coalesce(s, 0) as "start", coalesce(e, 0) as "end", cast(case when strand is null then 0 when strand = '+' then s else e end as int) as promoter from n left join r on id = var_id""")
def promoter_metadata(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "regulatory_links").where("name is not null").select(F.col("name").alias("var_id")).union(spark.createDataFrame([("no such gene",)], "var_id string")).distinct()
    return M.add_promoter_metadata(names, _gene_reference(spark, d)).select("var_id", "chr", "strand", "start", "end", F.col("promoter").cast("int").alias("promoter"))


def _gene_reference(spark: SparkSession, d: str) -> DataFrame:
    strand = F.when(F.col("promoter") == F.col("start"), "+").otherwise("-")
    return table(spark, d, "var_genes").where("promoter is not null").select("chr", strand.alias("strand"), "start", "end", F.col("var_id").alias("id"), F.upper("var_id").alias("extra"))


@query("""select g.gene, upper(r.var_id) as extra from (select distinct name as gene from regulatory_links where name is not null) g left join (select var_id from var_genes where promoter is not null) r on r.var_id = g.gene""")
def symbol_lookup(spark: SparkSession, d: str) -> DataFrame:
    genes = table(spark, d, "regulatory_links").where("name is not null").select(F.col("name").alias("gene")).distinct()
    return M.symbol_to_id(_gene_reference(spark, d), genes)


@query("""with a as (select p_brand as var_id, min(p_partkey) as pos_a from part where p_size > 10 group by 1), b as (select p_brand as var_id, min(p_partkey) as pos_b from part where p_size < 30 group by 1) select var_id, pos_a, pos_b from a join b using (var_id)""")
def align_features(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("var_id"), F.col("p_partkey").alias("position"), "p_size")
    return M.align_features(p.where("p_size > 10"), p.where("p_size < 30"))


@query("""with w as (select distinct name as var_id from regulatory_links where name is not null union select 'none') select w.var_id, coalesce(p.position, -1) as position from w left join (select var_id, min("start") as position from var_genes group by 1) p using (var_id)""")
def feature_positions(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "regulatory_links").where("name is not null").select(F.col("name").alias("var_id")).union(spark.createDataFrame([("none",)], "var_id string"))
    return M.feature_positions(table(spark, d, "var_genes").select("var_id", F.col("start").alias("position")), wanted)


@query(f"{BASE} select var_id, count(*) as n_cells from q where value > 30 group by 1 having count(*) > 4")
def active_features(spark: SparkSession, d: str) -> DataFrame:
    return M.active_features(supplier_parts(spark, d).layer("qty"), above=30, threshold=4)


@query(f"""{BRANDS} select o.obs_id, coalesce(max(case when b.var_id = 'Brand#11' and value > 100 then 1 end), 0) = 1 as a, coalesce(max(case when b.var_id = 'Brand#12' and value > 100 then 1 end), 0) = 1 as b from o left join b on b.obs_id = o.obs_id group by 1""")
def dense_activity(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_brands(spark, d)
    out = M.dense_activity(a.obs, ["Brand#11", "Brand#12"], a.layer("qty"), above=100)
    return out.select("obs_id", F.col("active")[0].alias("a"), F.col("active")[1].alias("b"))


@query("select cast(s_suppkey as varchar) as obs_id, cast(s_acctbal > 0 as bigint) + 10 * cast(s_nationkey > 12 as bigint) + 100 * cast(s_suppkey > 5 as bigint) as code from supplier")
def multi_layer_code(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("obs_id"), (F.col("s_acctbal") > 0).alias("a"), (F.col("s_nationkey") > 12).alias("b"), (F.col("s_suppkey") > 5).alias("c"))
    return M.activity_code(s, ["a", "b", "c"])


@query(sql_round("select vec_id, list_sum(embedding) - embedding[1] as rest, len(embedding) - 1 as n from embeddings", ["rest"], ["vec_id", "n"], 4))
def remove_pc(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    out = M.remove_component(e, 0)
    return rounded(out.select("vec_id", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x).alias("rest"), F.size("vec").cast("long").alias("n")), "rest", digits=4)


# layers

_ROWSUM = f"{BASE}, t as (select obs_id, sum(value) as s from q group by 1)"


@query(sql_round(f"{_ROWSUM} select obs_id, var_id, ln(1 + 10000 * value / s) as value from q join t using (obs_id)", ["value"], ["obs_id", "var_id"]))
def norm_rowsum_log(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.transform(supplier_parts(spark, d), LayerSpec("qty", normalize_with_obs_counts=True, log_transform=True)), "value")


_TOKENS = "k as (select cast(doc_id as varchar) as obs_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as var_id from documents where text is not null), x as (select obs_id, var_id, cast(count(*) as double) as value from k where var_id <> '' group by 1, 2)"


@query(sql_round(f"""with {_TOKENS}, f as (select var_id, count(*) as df from x group by 1), y as (select obs_id, x.var_id, value * ln((select count(*) from documents where text is not null) * 1.0 / df) as w from x join f using (var_id)),
n as (select obs_id, sqrt(sum(w * w)) as norm from y group by 1) select obs_id, var_id, case when norm = 0 then 0 else w / norm end as value from y join n using (obs_id)""", ["value"], ["obs_id", "var_id"]))
def idf_l2(spark: SparkSession, d: str) -> DataFrame:
    from assaylake.model import Assay

    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("obs_id"), "text")
    words = docs.select("obs_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("var_id")).where("var_id <> ''")
    coo = words.groupBy("obs_id", "var_id").agg(F.count(F.lit(1)).cast("double").alias("value"))
    a = Assay(docs.select("obs_id"), words.select("var_id").distinct(), {"tokens": coo})
    return rounded(L.transform(a, LayerSpec("tokens", idf_transform=True, normalize_with_l2_norm=True, norm_total=1.0)), "value")


@query(f"{BASE} select obs_id, var_id, 1.0 as value from q where value > 40 and var_id in (select var_id from v where brand = 'Brand#11')")
def layer_binarize(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_parts(spark, d)
    spec = LayerSpec("qty", feature_active_threshold=40, features=a.var.where("brand = 'Brand#11'"))
    return L.transform(a, spec, view_only=True, binarize=True)


_MEANS = f"{BRANDS}, m as (select var_id, sum(value) / (select count(*) from o) as m0 from b group by 1), p as (select brand as var_id, sum(price) / (select count(*) from o) / 1000 as m1 from q join v using (var_id) group by 1)"


@query(sql_round(f"""{_MEANS}, r as (select var_id, m0, m1, rank() over (order by m0) + (count(*) over (partition by m0) - 1) / 2.0 as r0, rank() over (order by m1) + (count(*) over (partition by m1) - 1) / 2.0 as r1 from m join p using (var_id)),
h as (select a.var_id, a.m1, arg_min(b.m0, b.r1) as picked from r a join r b on b.r1 >= a.r0 group by 1, 2)
select var_id, least(greatest(greatest(picked, 0.01) / greatest(m1, 0.01), 0.5), 2.0) as scalar from h""", ["scalar"], ["var_id"]))
def rank_scalars(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_brands(spark, d)
    n = a.obs.agg(F.count(F.lit(1))).scalar()
    m1 = L.feature_means(a.var, a.layer("price"), n).withColumn("mean", F.col("mean") / 1000)
    return rounded(L.rank_scalars(L.feature_means(a.var, a.layer("qty"), n), m1), "scalar")


@query(sql_round(f"{BASE} select var_id, coalesce(sum(value), 0) / (select count(*) from o) as mean from v left join q using (var_id) group by 1", ["mean"], ["var_id"]))
def feature_means(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_parts(spark, d)
    return rounded(L.feature_means(a.var, a.layer("qty"), a.obs.agg(F.count(F.lit(1))).scalar()), "mean")


@query(sql_round(f"{BASE} select var_id, avg(value) as mean, stddev_pop(value) as std from q group by 1", ["mean", "std"], ["var_id"]))
def stored_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.stored_moments(supplier_parts(spark, d).layer("qty")), "mean", "std")


@query(sql_round(f"""{BRANDS}, n as (select obs_id, var_id, value / sqrt(sum(value * value) over (partition by obs_id)) as x from b), g as (select sqrt(sum(s * s)) as f from (select a.obs_id as i, c.obs_id as j, sum(a.x * c.x) - case when a.obs_id = c.obs_id then 1 else 0 end as s from n a join n c using (var_id) group by 1, 2))
select 'qty' as layer, 1 / f as weight, 1.0 as scalar from g""", ["weight", "scalar"], ["layer"]))
def normalize_layers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.gram_weights({"qty": L.l2_norm(supplier_brands(spark, d).layer("qty"))}), "weight", "scalar")


# summaries


@query(sql_round(f"{BASE}, n as (select nation, count(*) as k from o group by 1) select nation, var_id, sum(value) / any_value(k) as mean, sqrt(greatest(sum(value * value) / any_value(k) - (sum(value) / any_value(k)) ** 2, 0)) as std from q join o using (obs_id) join n using (nation) group by 1, 2", ["mean", "std"], ["nation", "var_id"], 4))
def summarize_obs(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_parts(spark, d)
    return rounded(S.summarize_obs(a.layer("qty"), a.obs, "nation", std=True), "mean", "std", digits=4)


@query(sql_round(f"{BASE}, n as (select brand, count(*) as k from v group by 1) select obs_id, brand, sum(value) / any_value(k) as value from q join v using (var_id) join n using (brand) group by 1, 2", ["value"], ["obs_id", "brand"]))
def summarize_var(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_parts(spark, d)
    return rounded(S.summarize_var(a.layer("qty"), a.var, "brand"), "value")


@query(sql_round(f"""{BASE}, n as (select nation, count(*) as k from o group by 1), w as (select brand, count(*) as k from v group by 1), m as (select nation, var_id, sum(value) / any_value(k) as mean from q join o using (obs_id) join n using (nation) group by 1, 2)
select nation, brand, sum(mean) / any_value(k) as value from m join v using (var_id) join w using (brand) group by 1, 2""", ["value"], ["nation", "brand"], 8))
def summarize_both(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_parts(spark, d)
    return rounded(S.summarize_both(a.layer("qty"), a.obs, "nation", a.var, "brand"), "value", digits=8)


@query(sql_round(f"{BRANDS}, t as (select region, sum(value) as s from b join o using (obs_id) group by 1) select nation, obs_id, var_id, 1e6 * value / s as value from b join o using (obs_id) join t using (region)", ["value"], ["nation", "obs_id", "var_id"], 4))
def class_rescale_1e6(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_brands(spark, d)
    return rounded(S.membership(a.layer("qty"), a.obs, "nation", per_class="region"), "value", digits=4)


@query(f"{BRANDS}, r as (select distinct region from o) select r.region, b.obs_id, b.var_id, value from b join o using (obs_id) join r on r.region <> o.region")
def anti_summary(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_brands(spark, d)
    return S.membership(a.layer("qty"), a.obs, "region", anti=True)


@query("select o_orderstatus, mode as mode from (select o_orderstatus, o_orderpriority as mode, row_number() over (partition by o_orderstatus order by count(*) desc, o_orderpriority) as k from orders group by 1, 2) where k = 1")
def mode_by_group(spark: SparkSession, d: str) -> DataFrame:
    return S.mode_by_group(table(spark, d, "orders"), ["o_orderstatus"], "o_orderpriority")


@query(sql_round(f"""{BRANDS}, g as (select x.var_id, o.obs_id, coalesce(b.value, 0) as value from (select distinct var_id from b) x cross join o left join b on b.var_id = x.var_id and b.obs_id = o.obs_id),
h as (select var_id, quantile_cont(value, 0.9) as q from g group by 1) select obs_id, var_id, value from b join h using (var_id) where (value - 5) / (power(q + 1, 0.5) - 1) > 20""", ["value"], ["obs_id", "var_id"]))
def enrichment_quantile(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_brands(spark, d)
    hits = S.classify_enrichment(a.layer("qty"), a.obs.agg(F.count(F.lit(1))).scalar(), a=5, b=20, g=0.5, q=0.9)
    return rounded(a.layer("qty").join(hits, ["obs_id", "var_id"]).select("obs_id", "var_id", "value"), "value")


_MEMB = "c as (select 0 as sample, obs_id, nation as community from o union all select 1, obs_id, region from o)"


@query(sql_round(f"{BASE}, {_MEMB}, z as (select sample, community, count(*) as n from c group by 1, 2), h as (select sample, community, var_id, count(*) as k from (select * from q where value > 45) join c using (obs_id) group by 1, 2, 3) select obs_id, var_id, sum(k * 1.0 / n) as value from c join h using (sample, community) join z using (sample, community) group by 1, 2", ["value"], ["obs_id", "var_id"]))
def neighborhood_activity(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_parts(spark, d)
    memb = a.obs.select(F.lit(0).alias("sample"), "obs_id", F.col("nation").alias("community")).unionByName(a.obs.select(F.lit(1).alias("sample"), "obs_id", F.col("region").alias("community")))
    return S.neighbourhood_activity(a.layer("qty").where("value > 45"), memb, digits=DIGITS)


@query(f"""{BASE}, z as (select region, count(*) as n from o group by 1), h as (select region, var_id, count(*) as k from (select * from q where value > 45) join o using (obs_id) group by 1, 2) select obs_id, var_id from o join h using (region) join z using (region) where k * 1.0 / n > 0.07""")
def denoise_communities(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_parts(spark, d)
    return S.denoise(a.layer("qty").where("value > 45"), a.obs.select("obs_id", F.col("region").alias("community")), 0.07)


@query("""with m as (select vec_id as obs_id, [label, label + 1] as codes from embeddings), w as (select (select max(label) + 1 from embeddings) as o) select obs_id, cast(codes[1] as bigint) as "column" from m union all select obs_id, cast(codes[2] + o as bigint) from m, w""")
def one_hot_stack(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("obs_id"), F.array("label", F.col("label") + 1).alias("codes"))
    return S.one_hot(e).select("obs_id", F.col("column").cast("long").alias("column"))


@query(sql_round(f"""{BASE}, n as (select region, nation, count(*) as k from o group by 1, 2), m as (select region, nation, var_id, sum(value) / any_value(k) as m from q join o using (obs_id) join n using (region, nation) group by 1, 2, 3),
s as (select region, var_id, m / sum(m) over (partition by region, var_id) as p, m from m where m > 0), t as (select region, count(*) as types from n group by 1)
select region, var_id, greatest(-sum(p * log2(p)), 0) as entropy, sum(m) / any_value(types) as prevalence from s join t using (region) group by 1, 2""", ["entropy", "prevalence"], ["region", "var_id"]))
def entropy_by_class(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_parts(spark, d)
    return rounded(S.entropy_by_class(a.layer("qty"), a.obs, "region", "nation"), "entropy", "prevalence")


@query("""select cast(cast(o_totalprice > 150000 as int) as varchar) || cast(o_orderstatus = 'O' as int) || cast(o_orderpriority = '1-URGENT' as int) as region, count(*) as n from orders group by 1 having region <> '000'""")
def venn3(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_totalprice") > 150000).alias("a"), (F.col("o_orderstatus") == "O").alias("b"), (F.col("o_orderpriority") == "1-URGENT").alias("c"))
    return S.venn_regions(o, ["a", "b", "c"])


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2")
def contingency(spark: SparkSession, d: str) -> DataFrame:
    return S.contingency(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query(sql_round("select c_mktsegment, count(*) as n, count(*) * 1.0 / (select count(*) from customer) as share from customer group by 1", ["share"], ["c_mktsegment", "n"]))
def frequencies(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.frequencies(table(spark, d, "customer"), "c_mktsegment"), "share")


@query(sql_round(f"{BRANDS}, x as (select 'qty' as modality, obs_id, var_id, value from b union all select 'price', obs_id, brand, sum(price) from q join v using (var_id) group by 1, 2, 3), t as (select modality, sum(value) as s from x group by 1) select modality, obs_id, var_id, sqrt(1e6 * value / s) as value from x join t using (modality)", ["value"], ["modality", "obs_id", "var_id"]))
def scale_modalities(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_brands(spark, d)
    rows = a.layer("qty").withColumn("modality", F.lit("qty")).unionByName(a.layer("price").withColumn("modality", F.lit("price")))
    return rounded(S.scale_modalities(rows, "modality", sqrt=True).select("modality", "obs_id", "var_id", "value"), "value")


# regulation


@query("""select var_id from var_genes where chr = 'chr2' and "start" < 9000000 and "end" > 3000000""")
def region_query(spark: SparkSession, d: str) -> DataFrame:
    return R.region_query(table(spark, d, "var_genes"), "chr2", 3_000_000, 9_000_000).select("var_id")


@query("""with b as (select distinct chr2, start2, end2 from regulatory_links) select var_id, count(*) as n_bins, cast(sum(start2) as bigint) as starts from var_genes g join b on b.chr2 = g.chr and b.start2 < g."end" and b.end2 > g."start" group by 1""")
def gene_overlap(spark: SparkSession, d: str) -> DataFrame:
    bins = table(spark, d, "regulatory_links").select(F.col("chr2").alias("chr"), F.col("start2").alias("start"), F.col("end2").alias("end")).distinct()
    pairs = R.overlaps(table(spark, d, "var_genes").select("var_id", "chr", "start", "end"), bins)
    return pairs.groupBy("a.var_id").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("b.start").alias("starts"))


@query(f"with {FRAGS} select a.id as a_id, b.id as b_id from f a join f b on a.chr = b.chr and a.s < b.e and b.s < a.e and a.id < b.id and a.s < a.e and b.s < b.e")
def event_overlaps(spark: SparkSession, d: str) -> DataFrame:
    f = event_fragments(spark, d)
    return R.overlaps(f, f, width=512).where("a.id < b.id").select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


@query("""with b as (select distinct chr2 as chr, start2, end2, binname from regulatory_links where binname is not null), g as (select var_id as name, chr, promoter from var_genes where promoter is not null and chr is not null),
h as (select g.name, b.binname, promoter, end2 from g asof join b on g.chr = b.chr and g.promoter >= b.start2),
l as (select name, binname, max(score) as score from regulatory_links where name is not null and binname is not null and not isnan(score) group by 1, 2)
select name, binname, score from l union all select name, binname, 1.0 from h where promoter <= end2 and (name, binname) not in (select (name, binname) from l)""")
def promoter_asof(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "regulatory_links").where("binname is not null")
    bins = rows.select(F.col("chr2").alias("chr"), F.col("start2").alias("start"), F.col("end2").alias("end"), F.col("binname").alias("var_id")).distinct()
    links = rows.where("name is not null and score is not null and not isnan(score)").groupBy("name", "binname").agg(F.max("score").alias("score"), F.min("pval").alias("pval"), F.min("qval").alias("qval"))
    return R.ensure_promoters(links, bins, table(spark, d, "var_genes")).select("name", "binname", "score")


@query("select distinct cast(l_suppkey as varchar) as name, cast(l_partkey as varchar) as binname from lineitem where l_suppkey in (select s_suppkey from supplier) and l_partkey in (select p_partkey from part)")
def regulatory_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Links from every line item, with all suppliers and parts."""
    a = supplier_parts(spark, d)
    links = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("name"), F.col("l_partkey").cast("string").alias("binname"))
    return R.regulatory_matrix(links, a.obs.select(F.col("obs_id").alias("var_id")), a.var)


_BRANDMAT = f"{BASE}, r as (select brand as name, var_id from v)"


@query(f"{_BRANDMAT} select obs_id, name as var_id, sum(value) as value from q join r using (var_id) group by 1, 2")
def infer_layer_sum(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_parts(spark, d)
    return R.infer_layer(a.layer("qty"), R.matrix_from_memberships(a.var, "brand"), mode="sum")


@query(sql_round(f"{_BRANDMAT}, n as (select name, count(*) as k from r group by 1) select obs_id, name as var_id, sum(value) / any_value(k) as value from q join r using (var_id) join n using (name) group by 1, 2", ["value"], ["obs_id", "var_id"]))
def infer_layer_mean(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_parts(spark, d)
    return rounded(R.infer_layer(a.layer("qty"), R.matrix_from_memberships(a.var, "brand"), mode="mean"), "value")


@query(f"{_BRANDMAT} select obs_id, name as var_id, max(value) as value from q join r using (var_id) group by 1, 2")
def infer_layer_max(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_parts(spark, d)
    return R.infer_layer(a.layer("qty"), R.matrix_from_memberships(a.var, "brand"), mode="max")


@query("select c_mktsegment, c_custkey, place, off as \"offset\" from (select c_mktsegment, c_custkey, row_number() over (partition by c_mktsegment order by c_acctbal, c_custkey) as place from customer) join (select c_mktsegment, coalesce(sum(count(*)) over (order by c_mktsegment rows between unbounded preceding and 1 preceding), 0) as off from customer group by 1) using (c_mktsegment)")
def order_by_membership(spark: SparkSession, d: str) -> DataFrame:
    from assaylake.operators.grid import order_by_membership as f

    return f(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", "c_custkey").select("c_mktsegment", "c_custkey", "place", "offset")


