"""Statistics, graphs, embeddings, landscapes, ontology and plot data: reference operators on the general tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.operators import clustering as U
from assaylake.operators import community as C
from assaylake.operators import embedding as E
from assaylake.operators import graph as G
from assaylake.operators import grid as D
from assaylake.operators import hmm as H
from assaylake.operators import ontology as O
from assaylake.operators import plotdata as P
from assaylake.operators import stats as T
from assaylake.operators.kernels import benjamini_hochberg, midrank
from assaylake.operators.layers import l2_norm
from assaylake.operators.summaries import summarize_obs
from assaylake.plans.scratch import Scratch
from assaylake.queries._adapt import BASE, BRANDS, points, rounded, sql_chi_tail, sql_round, sql_t_tail, sql_two_sided, supplier_brands, supplier_parts
from assaylake.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ranks and tests


@query("""with v as (select distinct o_custkey, round(o_totalprice) as value, o_orderkey, o_orderstatus from orders)
select o_orderkey, rank() over (partition by o_orderstatus order by value) + (count(*) over (partition by o_orderstatus, value) - 1) / 2.0 as "rank" from v""")
def mid_rank(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice").alias("value"))
    return midrank(o, ["o_orderstatus"], "value").select("o_orderkey", "rank")


_P = "p as (select l_returnflag as g, l_orderkey * 10 + l_linenumber as id, 0.001 + (l_orderkey * 7919 % 1000) / 1001.0 as p from lineitem)"


@query(sql_round(f"""with {_P}, r as (select *, row_number() over (partition by g order by p, id) as i, count(*) over (partition by g) as n from p)
select id, least(1, min(p * n / i) over (partition by g order by i desc rows unbounded preceding)) as p_adj from r""", ["p_adj"], ["id"], 9))
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.lit(0.001) + (F.col("l_orderkey") * 7919 % 1000) / 1001.0).alias("p"))
    out = benjamini_hochberg(li, "p", partition=["g"])
    # rows with equal p may take any order among themselves; the adjusted values are the same for all of them
    return rounded(out.select("id", "p_adj"), "p_adj", digits=9)


_TT = "select o_orderpriority as k, avg(o_totalprice) filter (o_orderstatus = 'F') as ma, avg(o_totalprice) filter (o_orderstatus = 'O') as mb, var_samp(o_totalprice) filter (o_orderstatus = 'F') as va, var_samp(o_totalprice) filter (o_orderstatus = 'O') as vb, count(*) filter (o_orderstatus = 'F') as na, count(*) filter (o_orderstatus = 'O') as nb from orders group by 1"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_orderstatus").alias("g"), F.col("o_totalprice").alias("value"))


@query(sql_round(f"select *, {sql_t_tail('t', 'df')} as pval from (select k, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)) as t, cast(na + nb - 2 as double) as df from ({_TT}))", ["t", "df", "pval"], ["k"]))
def ttest_student(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.t_test(_orders(spark, d), "g", "F", "O", by=["k"]).select("k", "t", "df", "pval"), "t", "df", "pval")


@query(sql_round(f"select *, {sql_t_tail('t', 'df')} as pval from (select k, (ma - mb) / sqrt(va / na + vb / nb) as t, power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1)) as df from ({_TT}))", ["t", "df", "pval"], ["k"]))
def ttest_welch(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.t_test(_orders(spark, d), "g", "F", "O", by=["k"], welch=True).select("k", "t", "df", "pval"), "t", "df", "pval")


@query(sql_round(f"""with r as (select o_orderpriority as k, o_orderstatus as g, rank() over (partition by o_orderpriority order by o_totalprice) + (count(*) over (partition by o_orderpriority, o_totalprice) - 1) / 2.0 as r, count(*) over (partition by o_orderpriority, o_totalprice) as t from orders where o_orderstatus in ('F', 'O')),
s as (select k, cast(sum(r) filter (g = 'F') as double) as r, cast(count(*) filter (g = 'F') as double) as a, cast(count(*) filter (g = 'O') as double) as b, cast(sum(t * t - 1) as double) as ties from r group by 1),
u as (select k, r - a * (a + 1) / 2 as u, greatest(abs(r - a * (a + 1) / 2 - a * b / 2) - 0.5, 0) / sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))) as z from s)
select k, u, {sql_two_sided('z')} as pval from u""", ["u", "pval"], ["k"]))
def mwu_u(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.mann_whitney(_orders(spark, d), "g", "F", "O", by=["k"]).select("k", "u", "pval"), "u", "pval")


@query(sql_round(f"""with p as (select l_returnflag as k, round(l_quantity) - round(l_extendedprice / 1000) as x from lineitem), r as (select k, x, rank() over (partition by k order by abs(x)) + (count(*) over (partition by k, abs(x)) - 1) / 2.0 as r, count(*) over (partition by k, abs(x)) as t from p where x <> 0),
s as (select k, cast(least(sum(r) filter (x > 0), sum(r) filter (x < 0)) as double) as w, cast(count(*) as double) as n, cast(sum(t * t - 1) as double) as ties from r group by 1), z as (select *, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) as z from s)
select k, w, n, {sql_two_sided('z')} as pval from z""", ["w", "n", "pval"], ["k"]))
def wilcoxon_w(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.round("l_quantity").alias("a"), F.round(F.col("l_extendedprice") / 1000).alias("b"))
    return rounded(T.wilcoxon(li, "a", "b", by=["k"]).select("k", "w", "n", "pval"), "w", "n", "pval")


_CHI = f"""{BRANDS}, s as (select region as g, count(*) as gn from o group by 1), x as (select var_id, count(*) as t from b where value > 60 group by 1), y as (select region as g, var_id, count(*) as c from b join o using (obs_id) where value > 60 group by 1, 2),
z as (select s.g as "group", x.var_id, coalesce(c, 0) as a, gn - coalesce(c, 0) as b, t - coalesce(c, 0) as c, (select count(*) from o) - gn - t + coalesce(c, 0) as d, gn, (select count(*) from o) - gn as rn from s cross join x left join y on y.g = s.g and y.var_id = x.var_id)"""


@query(sql_round(f"""{_CHI} select *, case when chi2 is null then 1.0 else {sql_chi_tail('chi2')} end as pval from (select "group", var_id, case when (a + b) * (c + d) * (a + c) * (b + d) > 0 then (a + b + c + d) * power(greatest(abs(a * d - b * c) - (a + b + c + d) / 2.0, 0), 2) / ((a + b) * (c + d) * (a + c) * (b + d)) end as chi2, log2(((1.0 + a) / gn) / ((1.0 + c) / rn)) as score from z)""", ["chi2", "score", "pval"], ['"group"', "var_id"]))
def chi2_yates(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_brands(spark, d)
    return rounded(T.enriched_binary(a.layer("qty"), a.obs, "region", above=60).select("group", "var_id", "chi2", "score", "pval"), "chi2", "score", "pval")


@query(f"""{BASE}, c as (select region as g, count(*) as n from o group by 1), x as (select q.var_id, o.region as g, value from q join o using (obs_id) where value > 0),
r as (select var_id, g, rank() over (partition by var_id order by value) + (count(*) over (partition by var_id, value) - 1) / 2.0 as r, (select count(*) from o) - count(*) over (partition by var_id) as z from x)
select var_id, g as region, cast(sum(r + z) + (any_value(c.n) - count(*)) * (any_value(z) + 1) / 2.0 as double) as rank_sum from r join c using (g) group by 1, 2""")
def sparse_rank_sums(spark: SparkSession, d: str) -> DataFrame:
    """Every part; the SQL counts the block of zeros instead of forming it."""
    a = supplier_parts(spark, d)
    return T.sparse_rank_sums(a.layer("qty"), a.obs, "region", a.obs.agg(F.count(F.lit(1))).scalar())


_RANKED = f"""{BASE}, s as (select region as g, count(*) as n from o group by 1), x as (select var_id, region as g, sum(value) as v from q join o using (obs_id) group by 1, 2)"""


@query(f"""{_RANKED}, p as (select g as "group", var_id, 1 / (1 + v) as pval from x) select "group", var_id, cast(k as int) as "rank" from (select *, row_number() over (partition by "group" order by pval, var_id) as k from p where pval < 0.05) where k <= 10""")
def top_markers(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_parts(spark, d)
    sums = a.layer("qty").join(a.obs.select("obs_id", F.col("region").alias("group")), "obs_id").groupBy("group", "var_id").agg(F.sum("value").alias("v"))
    m = sums.select("group", "var_id", (1 / (1 + F.col("v"))).alias("pval"), F.lit(1.0).alias("score"))
    return T.top_markers(m, 10).select("group", "var_id", "rank")


_PROFILE = f"""{BRANDS}, n as (select region, count(*) as k from o group by 1), m as (select region, var_id, sum(value) / any_value(k) as x from b join o using (obs_id) join n using (region) group by 1, 2),
f as (select n.region, y.var_id, coalesce(x, 0) as x from n cross join (select distinct var_id from b) y left join m using (region, var_id))"""


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_brands(spark, d)
    m = summarize_obs(a.layer("qty"), a.obs, "region")
    regions = a.obs.agg(F.sort_array(F.collect_set("region"))).scalar()
    grid = a.var.select("var_id", F.explode(regions).alias("region"))
    return grid.join(m, ["region", "var_id"], "left").select("region", "var_id", F.coalesce("mean", F.lit(0.0)).alias("value"))


@query(sql_round(f"""{_PROFILE}, r as (select region, var_id, rank() over (partition by region order by round(x, 6)) + (count(*) over (partition by region, round(x, 6)) - 1) / 2.0 as x from f) select a.region as a, c.region as b, corr(a.x, c.x) as r from r a join r c using (var_id) where a.region < c.region group by 1, 2""", ["r"], ["a", "b"]))
def spearman_groups(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.column_correlations(rounded(_profiles(spark, d), "value"), "region", "var_id", spearman=True), "r")


@query(sql_round(f"{_PROFILE} select a.region as a, c.region as b, corr(a.x, c.x) as r from f a join f c using (var_id) where a.region < c.region group by 1, 2", ["r"], ["a", "b"]))
def pearson_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.column_correlations(_profiles(spark, d), "region", "var_id"), "r")


@query(sql_round("""with x as (select vec_id, list_sum(list_transform(embedding, lambda z: abs(z))) as total, embedding from embeddings), y as (select total, unnest(embedding) as v, unnest(range(len(embedding))) as component from x) select cast(component as int) as component, corr(v, total) as r from y group by 1""", ["r"], ["component"], 5))
def depth_corr(spark: SparkSession, d: str) -> DataFrame:
    e = points(spark, d).select(F.col("id").alias("obs_id"), "vec")
    depth = e.select("obs_id", F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.abs(x)).alias("total"))
    return rounded(T.depth_correlation(e, depth), "r", digits=5)


@query(sql_round("""with m as (select s_acctbal > 4000 as r, s_nationkey > 12 as u from supplier), a as (select avg(cast(r as int)) as r, avg(cast(u as int)) as u from m), x(quadrant, r, u) as (values ('pp', true, true), ('pm', true, false), ('mp', false, true), ('mm', false, false))
select quadrant, (select count(*) from m where m.r = x.r and m.u = x.u) * 1.0 / (select count(*) from m) as observed, case when x.r then a.r else 1 - a.r end * case when x.u then a.u else 1 - a.u end as expected from x, a""", ["observed", "expected"], ["quadrant"]))
def quadrants(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.quadrants(table(spark, d, "supplier"), "s_acctbal", "s_nationkey", at_x=4000, at_y=12), "observed", "expected")


@query("""with p as (select l_suppkey, (l_orderkey * 7919 % 1000) / 5000.0 as p, l_quantity / 10 - 2.5 as lfc from lineitem) select case when p < 0.05 and abs(lfc) >= 1 and lfc > 0 then 'up' when p < 0.05 and abs(lfc) >= 1 and lfc < 0 then 'down' else 'ns' end as call, count(*) as n from p group by 1""")
def volcano_counts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select(((F.col("l_orderkey") * 7919 % 1000) / 5000.0).alias("p"), (F.col("l_quantity") / 10 - 2.5).alias("lfc"))
    return T.volcano(p, "p", "lfc").groupBy("call").agg(F.count(F.lit(1)).alias("n"))


@query("""with p as (select l_returnflag, (l_orderkey * 7919 % 1000) / 5000.0 as p, l_quantity / 10 - 2.5 as lfc, l_discount from lineitem), h as (select *, l_discount > 0.02 and p < 0.05 and abs(lfc) > 1 as hit from p) select l_returnflag, count(*) filter (hit and lfc > 0) as up, count(*) filter (hit and lfc < 0) as down, count(*) filter (not hit) as ns from h group by 1""")
def differential_counts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select("l_returnflag", ((F.col("l_orderkey") * 7919 % 1000) / 5000.0).alias("pval"), (F.col("l_quantity") / 10 - 2.5).alias("lfc"), F.col("l_discount").alias("activity"))
    return P.dynamics_calls(p, "l_returnflag", res="lfc", threshold=0.02, lfc_threshold=1)


@query(sql_round("select -avg(y * ln(p) + (1 - y) * ln(1 - p)) as loss from (select cast(o_orderstatus = 'F' as int) as y, 0.1 + 0.8 * (o_orderkey % 97) / 97.0 as p from orders)", ["loss"]))
def log_loss(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.lit(0.1) + 0.8 * (F.col("o_orderkey") % 97) / 97.0).alias("p"))
    return rounded(T.log_loss(o, "y", "p"), "loss")


@query()
def likelihood_markers(spark: SparkSession, d: str) -> DataFrame:
    """Likelihood-ratio tests of every brand, each region against all others."""
    a = supplier_brands(spark, d)
    totals = a.layer("qty").groupBy("obs_id").agg(F.log1p(F.sum("value")).alias("covariate"))
    regions = a.obs.agg(F.sort_array(F.collect_set("region"))).scalar()
    cells = a.obs.join(totals, "obs_id").select("obs_id", "region", "covariate", F.explode(regions).alias("group")).select("obs_id", "group", (F.col("region") == F.col("group")).cast("int").alias("y"), "covariate")
    return T.likelihood_test(a.layer("qty").withColumn("value", F.log1p("value")), cells, groups=a.layer("qty"), min_lfc=0.05)


@query(sql_round(f"""{BRANDS}, x as (select y.var_id, o.obs_id, o.region as g, coalesce(b.value, 0) as value from (select distinct var_id from b) y cross join o left join b on b.var_id = y.var_id and b.obs_id = o.obs_id),
r as (select var_id, g, value, rank() over (partition by var_id order by value) + (count(*) over (partition by var_id, value) - 1) / 2.0 as r from x),
t as (select var_id, g, sum(r) - count(*) * (count(*) + 1) / 2.0 as u1, count(*) * ((select count(*) from o) - count(*)) * 1.0 as nn from r group by 1, 2 having max(value) > 0),
z as (select *, (least(u1, nn - u1) - nn / 2) / sqrt(nn * ((select count(*) from o) + 1) / 12) as z from t)
select g as "group", var_id, least(u1, nn - u1) as u, case when u1 > 0 then ln(u1 / (nn / 2)) end as score, {sql_two_sided('z')} as pval from z""", ["u", "score", "pval"], ['"group"', "var_id"]))
def enriched_ranks(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_brands(spark, d)
    return rounded(T.enriched_ranks(a.layer("qty"), a.obs, "region").select("group", "var_id", "u", "score", "pval"), "u", "score", "pval")


# neighbours, communities

_DIST = """with e as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as vec, label from embeddings), d as (select a.id as src, b.id as dst, list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d2, b.label as label from e a, e b where a.id <> b.id),
r as (select src, dst, sqrt(d2) as distance, label, row_number() over (partition by src order by d2, dst) as "rank" from d)"""


@query(sql_round(f"""{_DIST} select src, dst, distance, cast("rank" as int) as "rank" from r where "rank" <= 10""", ["distance"], ["src", "dst", '"rank"']))
def knn_euclid(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return rounded(G.knn_exact(p, p, 10), "distance")


@query(sql_round("""with e as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as vec from embeddings), d as (select a.id as src, b.id as dst, 1 - list_cosine_similarity(a.vec, b.vec) as distance from e a, e b where a.id <> b.id)
select src, dst, distance from (select *, row_number() over (partition by src order by distance, dst) as k from d) where k <= 5""", ["distance"], ["src", "dst"]))
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return rounded(G.knn_exact(p, p, 5, metric_name="cosine").select("src", "dst", "distance"), "distance")


@query(f"""{_DIST} select src, count(*) as degree from d where d2 > 0 and sqrt(d2) <= 1.1 group by 1""")
def radius_graph(spark: SparkSession, d: str) -> DataFrame:
    return G.radius_graph(points(spark, d), 1.1).groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


@query(f"""{_DIST}, w as (select src, label, sum(1 / distance) as v from r where "rank" <= 3 group by 1, 2) select src, label as predicted from (select *, row_number() over (partition by src order by round(v, 9) desc, label) as k from w) where k = 1""")
def knn_classify(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return G.knn_classify(G.knn_exact(p, p, 3), p.select("id", "label"))


@query(sql_round(f"""{_DIST} select src, sum(label / distance) / sum(1 / distance) as predicted from r where "rank" <= 3 group by 1""", ["predicted"], ["src"]))
def knn_regress(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return rounded(G.knn_regress(G.knn_exact(p, p, 3), p.select("id", F.col("label").cast("double").alias("value"))), "predicted")


def _linked(neighbours: DataFrame) -> DataFrame:
    """Both directions of all pairs of a neighbour table, weighted by 1 / (1 + distance)."""
    u = G.undirected(neighbours.select("src", "dst", (1 / (1 + F.col("distance"))).alias("weight")))
    return Scratch(neighbours.sparkSession, "neighbours").save(u.unionByName(u.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), "graph")


def _neighbour_graph(spark: SparkSession, d: str) -> DataFrame:
    """Every embedding linked with its ten nearest."""
    p = points(spark, d)
    return _linked(G.knn_exact(p, p, 10))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("id", F.col("label").alias("community"))


_LINKED = """u as (select least(src, dst) as src, greatest(src, dst) as dst, max(1 / (1 + distance)) as weight from r where "rank" <= 10 group by 1, 2), g as (select * from u union all select dst, src, weight from u)"""
_NEAR = f"{_DIST}, {_LINKED}, m as (select id, label as community from e)"
_SUPPLIERS = f"""{BRANDS}, f as (select o.obs_id, y.var_id, coalesce(b.value, 0) as x from o cross join (select distinct brand as var_id from v) y left join b on b.obs_id = o.obs_id and b.var_id = y.var_id),
d as (select a.obs_id as src, c.obs_id as dst, sqrt(sum((a.x - c.x) ** 2)) as distance from f a join f c using (var_id) where a.obs_id <> c.obs_id group by 1, 2), r as (select *, row_number() over (partition by src order by distance, dst) as "rank" from d), {_LINKED}"""


@query(sql_round(f"""{_SUPPLIERS}, c as (select dst, sum(weight) as s from g group by 1), a as (select g.src, g.dst, weight / x.s / y.s as w from g join c x on x.dst = g.src join c y on y.dst = g.dst),
t as (select obs_id, sum(value) as s from b group by 1), n as (select obs_id, var_id, 1000 * value / s as value from b join t using (obs_id))
select obs_id, var_id, sum(value) as value from (select a.src as obs_id, n.var_id, 0.6 * w * n.value as value from a join n on n.obs_id = a.dst union all select obs_id, var_id, 0.4 * value from b) group by 1, 2""", ["value"], ["obs_id", "var_id"]))
def knn_impute(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier is smoothed over the ten suppliers with the most similar brands."""
    a = supplier_brands(spark, d)
    grid = a.obs.select("obs_id").join(a.var, how="cross").join(a.layer("qty"), ["obs_id", "var_id"], "left")
    vecs = grid.groupBy(F.col("obs_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("var_id", F.coalesce("value", F.lit(0.0)).alias("x"))))["x"].alias("vec"))
    return rounded(G.knn_impute(_linked(G.knn_exact(vecs, vecs, 10)), a.layer("qty")), "value")


@query(sql_round("""with e as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as vec, label from embeddings), n as (select label, count(*) as n from e group by 1),
d as (select a.id, a.label as own, b.label as other, sum(sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) as s from e a, e b group by 1, 2, 3),
x as (select id, own as cluster, max(case when own = other then s / nullif(n - 1, 0) end) as a, min(case when own <> other then s / n end) as b from d join n on n.label = d.other group by 1, 2)
select id, cluster, case when a is null then 0 else (b - a) / greatest(a, b) end as silhouette from x""", ["silhouette"], ["id", "cluster"]))
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.silhouettes(points(spark, d).select("id", "vec", F.col("label").alias("cluster"))), "silhouette")


@query(f"{_NEAR} select least(a.community, b.community) as ca, greatest(a.community, b.community) as cb, count(*) as n_edges from u join m a on a.id = src join m b on b.id = dst group by 1, 2")
def community_edges(spark: SparkSession, d: str) -> DataFrame:
    return C.contract(_neighbour_graph(spark, d), _labels(spark, d))


@query(sql_round(f"""{_NEAR}, t as (select sum(weight) as w from g), x as (select a.community as c, sum(case when a.community = b.community then weight else 0 end) as i, sum(weight) as k from g join m a on a.id = src join m b on b.id = dst group by 1)
select sum(i / w - (k / w) ** 2) as modularity from x, t""", ["modularity"]))
def partition_modularity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.modularity(_neighbour_graph(spark, d), _labels(spark, d)), "modularity")


@query(f"""with recursive e as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as vec from embeddings),
g as (select a.id as src, b.id as dst from e a, e b where a.id <> b.id and sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) <= 1.15),
k as (select src as id from g group by 1 having count(*) >= 3), h as (select src, dst from g where src in (select id from k) and dst in (select id from k)),
r(id, root) as (select id, id from k union select h.dst, r.root from r join h on h.src = r.id), c as (select id, min(root) as cluster from r group by 1) select e.id, c.cluster from e left join c using (id)""")
def dbscan_core(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return C.dbscan(p, G.radius_graph(p, 1.15), min_samples=3)


@query(sql_round(f"""{_NEAR}, c as (select src as id, count(*) as k from g group by 1), p as (select k, count(*) * 1.0 / (select count(*) from c) as p from c group by 1),
q as (select p.k, coalesce(x.k * x.p, 0) as q from p left join p x on x.k = p.k + 1), z as (select k, q / (select nullif(sum(q), 0) from q) as q from q), mm as (select sum(k * q) as m, sum(k * k * q) as m2 from z),
y as (select sum(a.q * b.q) as s from g join c i on i.id = g.src join c j on j.id = g.dst join z a on a.k = i.k join z b on b.k = j.k) select (s - m * m) / nullif(m2 - m * m, 0) as assortativity from y, mm""", ["assortativity"]))
def assortativity(spark: SparkSession, d: str) -> DataFrame:
    """With every node active."""
    return rounded(C.assortativity(_neighbour_graph(spark, d), points(spark, d).select("id")), "assortativity")


@query()
def leiden(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return C.leiden(p.select("id"), G.fuzzy_simplicial_set(G.knn_exact(p, p, 10)))


@query()
def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return C.label_propagation(p.select("id"), G.fuzzy_simplicial_set(G.knn_exact(p, p, 10)))


@query(sql_round(f"""{_DIST.replace("with e as", "with recursive e as")}, k as (select src, list(distance order by "rank") as ds, coalesce(min(distance) filter (distance > 0), 0) as rho, log2(count(*) + 1) as target from r where "rank" <= 10 group by 1),
it(src, i, lo, hi, mid, s) as (select src, 0, 0.0::double, 'inf'::double, 1.0::double, null::double from k
  union all select src, i + 1, case when v <= target then mid else lo end, case when v > target then mid else hi end, case when v > target then (lo + mid) / 2 when hi = 'inf'::double then mid * 2 else (mid + hi) / 2 end, v
    from (select it.*, k.target, list_sum(list_transform(k.ds, lambda x: exp(-greatest(x - k.rho, 0) / it.mid))) as v from it join k using (src)) where i < 64 and abs(v - target) >= 1e-5),
f as (select src, arg_max(mid, i) as mid from it group by 1), w as (select r.src, r.dst, exp(-greatest(distance - rho, 0) / mid) as w from r join k using (src) join f using (src) where "rank" <= 10), b as (select * from w union all select dst, src, w from w)
select src, dst, case when count(*) = 1 then max(w) else sum(w) - max(w) * min(w) end as weight from b group by 1, 2""", ["weight"], ["src", "dst"], 5))
def fuzzy_graph(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return rounded(G.fuzzy_simplicial_set(G.knn_exact(p, p, 10)), "weight", digits=5)


@query()
def kmeans(spark: SparkSession, d: str) -> DataFrame:
    return U.kmeans(points(spark, d), 5)


def _columns(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).select("var_id", F.col("region").alias("column"), "value")


@query()
def cluster_summaries(spark: SparkSession, d: str) -> DataFrame:
    return U.cluster_summaries(_columns(spark, d), 3, log_transform=True)


@query()
def cocluster_summaries(spark: SparkSession, d: str) -> DataFrame:
    return U.cocluster_summaries(_columns(spark, d))


@query(f"""{BRANDS}, a as (select var_id, obs_id, cast(obs_id as bigint) as k from b where value > 300), g as (select *, k - row_number() over (partition by var_id order by k) as island from a),
n as (select *, count(*) over (partition by var_id, island) as n, min(obs_id) over (partition by var_id, island) as cluster from g) select var_id, obs_id, cluster from n where n > 1""")
def active_subclusters(spark: SparkSession, d: str) -> DataFrame:
    """Connected groups of suppliers that sell much of a brand, on the graph of neighbouring keys."""
    a = supplier_brands(spark, d)
    edges = a.obs.select(F.col("obs_id").alias("src"), (F.col("obs_id").cast("long") + 1).cast("string").alias("dst"))
    active = a.layer("qty").where("value > 300").select("var_id", "obs_id")
    return U.active_subclusters(active, edges, min_degree=1, min_active=1)


# embeddings, diffusion, layouts


@query()
def pca(spark: SparkSession, d: str) -> DataFrame:
    return E.pca(points(spark, d).select(F.col("id").alias("obs_id"), "vec"), 10)[1]


@query()
def spectral(spark: SparkSession, d: str) -> DataFrame:
    return E.spectral(_positive_brands(spark, d), 4, skip_idf=True)[1]


@query()
def multiview_spectral(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_brands(spark, d)
    return E.multiview_spectral({"qty": a.layer("qty"), "price": a.layer("price")}, 3, skip_idf=True)[1]


def _positive_brands(spark: SparkSession, d: str) -> DataFrame:
    return l2_norm(supplier_brands(spark, d).layer("qty"))


@query(sql_round(f"""{_NEAR}, q as (select dst, sum(weight) as q from g group by 1), k as (select g.src, g.dst, weight / a.q / b.q as w from g join q a on a.dst = g.src join q b on b.dst = g.dst), z as (select dst, sqrt(sum(w)) as z from k group by 1) select k.src, k.dst, w / a.z / b.z as weight from k join z a on a.dst = k.src join z b on b.dst = k.dst""", ["weight"], ["src", "dst"]))
def diffusion_transitions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.diffusion_transitions(_neighbour_graph(spark, d)), "weight")


@query()
def diffusion_map(spark: SparkSession, d: str) -> DataFrame:
    return E.diffusion_map(_neighbour_graph(spark, d), 4)[1]


@query(sql_round("""with e as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), r as (select v as o from e where id = 0),
x as (select id, sqrt(list_sum(list_transform(list_zip(v, o, range(len(v))), lambda z: (z[1] - z[2]) ** 2 * case when z[3] = 0 then 1.0 else 1.0 / (z[3] + 1) ** 2 end))) as t from e, r) select id, t / (select max(t) from x) as pseudotime from x""", ["pseudotime"], ["id"]))
def dpt_given_basis(spark: SparkSession, d: str) -> DataFrame:
    """All components, with eigenvalues 1/2, 1/3, ... after the first: weights of 1/2^2, 1/3^2, ..."""
    basis = points(spark, d).select("id", "vec")
    width = basis.select(F.size("vec").alias("n")).first().n
    return rounded(E.diffusion_pseudotime(basis, [0.99995] + [1 / (i + 2) for i in range(1, width)], 0), "pseudotime")


@query(sql_round(f"""{_NEAR}, l as (select id, community * 1.0 / (select nullif(max(community), 0) from m) as position from m), x as (select community, avg(coalesce(position, 0)) as x from g join m on m.id = g.src join l on l.id = g.dst group by 1)
select e.id as obs_id, coalesce(x, 0) as x, -vec[1] as y from e join m using (id) left join x using (community)""", ["x", "y"], ["obs_id"]))
def landscape_coarse(spark: SparkSession, d: str) -> DataFrame:
    """Every label is a leaf community; the first component stands for time."""
    p = points(spark, d)
    cells = p.select(F.col("id").alias("obs_id"), F.col("label").alias("community"), F.get("vec", 0).alias("time"))
    order = p.select(F.col("label").alias("community"), F.col("label").alias("position")).distinct()
    return rounded(E.coarse_landscape(_neighbour_graph(spark, d), cells, E.scaffold(cells, order)), "x", "y")


@query()
def umap_layout(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    start = E.pca(p.select(F.col("id").alias("obs_id"), "vec"), 2)[1].withColumnRenamed("obs_id", "id")
    return E.umap(G.fuzzy_simplicial_set(G.knn_exact(p, p, 10)), start)


@query(sql_round("""with g as (select o_orderstatus as k, min(o_totalprice) as lo, case when max(o_totalprice) - min(o_totalprice) < 4e-5 then 1 else max(o_totalprice) - min(o_totalprice) end as span from orders group by 1), a as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders)
select o_orderkey, (o_totalprice - g.lo) / span * (a.hi - a.lo) + a.lo as normalized_time from orders join g on k = o_orderstatus, a""", ["normalized_time"], ["o_orderkey"], 4))
def time_per_cluster(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.time_per_cluster(table(spark, d, "orders"), "o_totalprice", "o_orderstatus").select("o_orderkey", "normalized_time"), "normalized_time", digits=4)


# landscapes

_RES = (20, 15)
_PIX = f"""{BASE}, p as (select o.obs_id, nation, region, cast(cast(o.obs_id as int) * 7919 % 97 as double) as x, time as y from o), m as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from p),
gx as (select unnest(range({_RES[0] - 1})) as i), gy as (select unnest(range({_RES[1] - 1})) as i),
i as (select p.*, (select count(*) from gx, m where x0 + i * ((x1 - x0) / {_RES[0] - 1}) < x) as ix, (select count(*) from gy, m where y0 + i * ((y1 - y0) / {_RES[1] - 1}) < y) as iy from p)"""


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_parts(spark, d)
    pts = a.obs.select("obs_id", (F.col("obs_id").cast("int") * 7919 % 97).cast("double").alias("x"), F.col("time").alias("y"))
    return D.assign_pixels(pts, _RES)


@query(sql_round(f"{_PIX}, n as (select ix, iy, count(*) as n_cells from i group by 1, 2), b as (select obs_id, brand as var_id, sum(value) as value from q join v using (var_id) group by 1, 2) select var_id, cast(ix as int) as ix, cast(iy as int) as iy, sum(value) / any_value(n_cells) as z, any_value(n_cells) as n_cells from b join i using (obs_id) join n using (ix, iy) where n_cells > 0 group by 1, 2, 3", ["z"], ["var_id", "ix", "iy", "n_cells"]))
def grid_numeric(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.grid_numerical(supplier_brands(spark, d).layer("qty"), _pixels(spark, d), 0), "z")


@query(f"""{_PIX}, c as (select ix, iy, region, count(*) as c from i group by 1, 2, 3), t as (select ix, iy, cast(sum(c) as bigint) as n_cells from c group by 1, 2), r as (select *, row_number() over (partition by ix, iy order by c desc, region) as k from c)
select cast(ix as int) as ix, cast(iy as int) as iy, case when n_cells > 1 then region end as region, n_cells from r join t using (ix, iy) where k = 1""")
def grid_mode(spark: SparkSession, d: str) -> DataFrame:
    return D.grid_categorical(_pixels(spark, d), supplier_parts(spark, d).obs, "region", 1)


_GZ = f"{_PIX}, n as (select ix, iy, count(*) as n from i group by 1, 2), b as (select obs_id, brand as var_id, sum(value) as value from q join v using (var_id) group by 1, 2), z as (select var_id, ix, iy, sum(value) / any_value(n) as z from b join i using (obs_id) join n using (ix, iy) group by 1, 2, 3), c as (select ix, iy, region, row_number() over (partition by ix, iy order by count(*) desc, region) as k from i group by 1, 2, 3), w as (select ix, iy, region, -(y0 + iy * ((y1 - y0) / {_RES[1] - 1})) as t from c, m where k = 1), f as (select w.*, u.var_id, coalesce(z, 0) as z from w cross join (select distinct var_id from z) u left join z on z.var_id = u.var_id and z.ix = w.ix and z.iy = w.iy)"


@query(sql_round(f"{_GZ} select region, var_id, case when isfinite(corr(z, t)) then corr(z, t) end as res from f group by 1, 2 having max(z) > 0", ["res"], ["region", "var_id"]))
def landscape_corr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_dynamics(spark, d, False), "res")


@query(sql_round(f"{_GZ}, r as (select region, var_id, t, rank() over (partition by region, var_id order by round(z, 9)) + (count(*) over (partition by region, var_id, round(z, 9)) - 1) / 2.0 as z, z as raw from f) select region, var_id, case when isfinite(corr(z, t)) then corr(z, t) end as res from r group by 1, 2 having max(raw) > 0", ["res"], ["region", "var_id"]))
def landscape_rank_corr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_dynamics(spark, d, True), "res")


def _dynamics(spark: SparkSession, d: str, spearman: bool) -> DataFrame:
    px, a = _pixels(spark, d), supplier_brands(spark, d)
    z = rounded(D.grid_numerical(a.layer("qty"), px, 0), "z", digits=9)
    axes = D.grid_axes(px, _RES)
    return D.landscape_dynamics(z, D.grid_categorical(px, a.obs, "region", 0), axes, "region", spearman=spearman)


@query(sql_round("""with p as (select l_returnflag as g, l_quantity as x, l_extendedprice / 1000 as y, 1 + l_discount * 10 as w from lineitem), s as (select g, sum(w) as v1, sum(w * w) as v2, sum(w * x) / sum(w) as mx, sum(w * y) / sum(w) as my from p group by 1)
select g, sum(w * (x - mx) * (y - my)) / sqrt(sum(w * (x - mx) ** 2) * sum(w * (y - my) ** 2)) as res from p join s using (g) group by 1""", ["res"], ["g"]))
def weighted_corr(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (1 + F.col("l_discount") * 10).alias("w"))
    return rounded(D.weighted_correlation(p, ["g"], w=F.col("w")), "res")


@query(sql_round(f"{_PIX}, n as (select ix, iy, count(*) as n from i group by 1, 2), b as (select obs_id, brand as var_id, sum(value) as value from q join v using (var_id) group by 1, 2), z as (select var_id, ix, iy, sum(value) / any_value(n) as z from b join i using (obs_id) join n using (ix, iy) group by 1, 2, 3) select var_id, cast(iy as int) as i, sum(z) as z from z, m where x0 + ix * ((x1 - x0) / {_RES[0] - 1}) between 20 and 60 group by 1, 2", ["z"], ["var_id", "i"], 5))
def grid_slice(spark: SparkSession, d: str) -> DataFrame:
    px = _pixels(spark, d)
    return rounded(D.slice_pixels(D.grid_numerical(supplier_brands(spark, d).layer("qty"), px, 0), "x", 20, 60, D.grid_axes(px, _RES)), "z", digits=5)


@query()
def grid_smoothed(spark: SparkSession, d: str) -> DataFrame:
    px = _pixels(spark, d)
    z = D.grid_numerical(supplier_brands(spark, d).layer("qty"), px, 0)
    return D.transform_grid(z, px.select("ix", "iy").distinct(), _RES, gauss=(1.0, 1.0), all_feature_q=0.99, winsor_low=0.05, winsor_high=0.95, upscale=2)


@query(sql_round("""with e as (select event_type, epoch(ts) as x, value from events where value is not null), m as (select min(x) as lo, max(x) as hi from e) select event_type, cast(least(floor((x - lo) / 86400), greatest(ceil((hi - lo) / 86400) - 1, 0)) as int) as bin, avg(value) as mean, count(*) as n from e, m group by 1, 2""", ["mean"], ["event_type", "bin", "n"]))
def binned_mean(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("x"), "value")
    return rounded(D.binned_mean(e, "x", "value", 86400.0, by=["event_type"]), "mean")


_KERNEL = "k as (select i, exp(-0.5 * (i / 2.0) ** 2) as w from (select unnest(range(-8, 9)) as i)), kn as (select i, w / (select sum(w) from k) as w from k)"


@query(sql_round(f"""with e as (select event_type, epoch(ts) as x, value from events where value is not null), m as (select min(x) as lo, max(x) as hi from e), c as (select event_type, cast(least(floor((x - lo) / 86400), greatest(ceil((hi - lo) / 86400) - 1, 0)) as int) as bin, avg(value) as y from e, m group by 1, 2),
r as (select *, row_number() over (partition by event_type order by bin) - 1 as i, count(*) over (partition by event_type) as n from c), {_KERNEL},
t as (select r.event_type, r.bin, r.n, kn.w, (r.i + kn.i) as j from r, kn), u as (select *, ((j % (2 * n)) + 2 * n) % (2 * n) as j2 from t)
select u.event_type, u.bin, sum(u.w * r.y) as smoothed from u join r on r.event_type = u.event_type and r.i = case when j2 < u.n then j2 else 2 * u.n - 1 - j2 end group by 1, 2""", ["smoothed"], ["event_type", "bin"]))
def smoothed_curve(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("x"), "value")
    return rounded(D.smooth_bins(D.binned_mean(e, "x", "value", 86400.0, by=["event_type"]), 2.0, by=["event_type"]), "smoothed")


@query(sql_round(f"{_GZ}, nr as (select region, count(*) as k from o group by 1), e as (select region, var_id, sum(b.value) / any_value(k) as exp from b join o using (obs_id) join nr using (region) group by 1, 2), c2 as (select region, var_id, case when isfinite(corr(z, t)) then corr(z, t) end as res from f group by 1, 2 having max(z) > 0) select region, var_id, res, coalesce(exp, 0) as exp from c2 left join e using (region, var_id)", ["res", "exp"], ["region", "var_id"]))
def dynamics_with_expression(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_brands(spark, d)
    return rounded(D.add_expression(_dynamics(spark, d, False), summarize_obs(a.layer("qty"), a.obs, "region"), "region"), "res", "exp")


@query(sql_round(f"{BRANDS}, e as (select o.time, coalesce(b.value, 0) as value from o left join (select * from b where var_id = 'Brand#11') b using (obs_id) where region = 'ASIA'), m as (select min(time) as lo, max(time) as hi from e) select cast(least(floor((time - lo) / 1000), greatest(ceil((hi - lo) / 1000) - 1, 0)) as int) as bin, avg(value) as mean, count(*) as n from e, m group by 1", ["mean"], ["bin", "n"]))
def time_curve(spark: SparkSession, d: str) -> DataFrame:
    a = supplier_brands(spark, d)
    return rounded(D.time_curve(a.layer("qty"), a.obs, "Brand#11", "region", "ASIA", 1000.0), "mean")


# ontology

# Three trees of terms with two ways up, one term for each ten parts: term i is number i // 3 of the tree i % 3,
# and lies below the numbers half and a third of its own.
_DAG = """i as (select unnest(range((select count(*) // 10 from part))) as i), t(go, name, ns) as (select 'T' || i, 'term ' || i, ['MF', 'CC', 'BP'][i % 3 + 1] from i),
g(child, parent) as (select distinct 'T' || i, 'T' || (3 * ((i // 3) // p) + i % 3) from i, (values (2), (3)) w(p) where i >= 3), r(go, ancestor) as (select go, go from t union select r.go, g.parent from r join g on g.child = r.ancestor)"""
_ASSOC = "a as (select distinct t.ns, cast(p_partkey as varchar) as gene, t.go from part join t on t.go = 'T' || (p_partkey % (select count(*) from i))), ap as (select distinct a.ns, a.gene, r.ancestor as go from a join r on r.go = a.go)"


def _ontology(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    part = table(spark, d, "part")
    n = part.count() // 10
    i = F.col("id")
    name = lambda c: F.concat(F.lit("T"), c.cast("string"))
    terms = spark.range(n).select(name(i).alias("go"), F.concat(F.lit("term "), i.cast("string")).alias("name"), F.element_at(F.array(F.lit("MF"), F.lit("CC"), F.lit("BP")), (i % 3 + 1).cast("int")).alias("ns"))
    up = lambda p: 3 * F.floor(F.floor(i / 3) / p) + i % 3
    edges = spark.range(3, n).select(name(i).alias("child"), F.explode(F.array_distinct(F.array(name(up(2)), name(up(3))))).alias("parent"))
    assoc = part.select(F.col("p_partkey").cast("string").alias("gene"), name(F.col("p_partkey") % n).alias("go")).join(terms.select("go", "ns"), "go").select("ns", "gene", "go").distinct()
    population = part.where("p_size <= 40").select(F.col("p_partkey").cast("string").alias("gene"))
    study = part.where("p_size < 12").select(F.col("p_brand").alias("study"), F.col("p_partkey").cast("string").alias("gene"))
    return terms, edges, assoc, population, study


@query(f"""with recursive {_DAG}, {_ASSOC}, pop as (select cast(p_partkey as varchar) as gene from part where p_size <= 40), s as (select p_brand as study, cast(p_partkey as varchar) as gene from part where p_size < 12),
p as (select ns, go, count(distinct gene) as pop_count from ap where gene in (select gene from pop) group by 1, 2), k as (select study, ns, go, count(distinct gene) as study_count from ap join s using (gene) group by 1, 2, 3), n as (select study, count(*) as study_n from s group by 1)
select study, ns, go, study_count, pop_count, study_n, (select count(*) from pop) as pop_n from k join p using (ns, go) join n using (study)""")
def go_counts(spark: SparkSession, d: str) -> DataFrame:
    terms, edges, assoc, population, study = _ontology(spark, d)
    return O.go_counts(O.propagate(assoc, O.closure(terms, edges)), population, study)


@query(f"with recursive {_DAG} select x.name as root, r.go from r join t x on x.go = r.ancestor where x.name in ('term 1', 'term 6')")
def go_descendants(spark: SparkSession, d: str) -> DataFrame:
    terms, edges, *_ = _ontology(spark, d)
    return O.descendants(terms, edges, spark.createDataFrame([("term 1",), ("term 6",)], "name string"))


@query(sql_round(f"""with recursive {_DAG}, {_ASSOC}, q as (select cast(l_suppkey as varchar) as obs_id, cast(l_partkey as varchar) as var_id, sum(l_quantity) as value from lineitem group by 1, 2),
m as (select distinct x.name || '_' || a.ns as name, a.gene from a join r on r.go = a.go join t x on x.go = r.ancestor where x.name in ('term 1', 'term 6') and a.gene in (select cast(p_partkey as varchar) from part where p_size <= 40)),
n as (select name, count(*) as k from m group by 1) select obs_id, name as var_id, sum(value) / any_value(k) as value from q join m on m.gene = q.var_id join n using (name) group by 1, 2""", ["value"], ["obs_id", "var_id"]))
def go_infer_layer(spark: SparkSession, d: str) -> DataFrame:
    terms, edges, assoc, population, _ = _ontology(spark, d)
    names = spark.createDataFrame([("term 1",), ("term 6",)], "name string")
    return rounded(O.go_infer_layer(supplier_parts(spark, d).layer("qty"), terms, edges, assoc, population, names), "value")


_LOG_CHOOSE = "(lgamma(pc + 1.0) - lgamma(x + 1.0) - lgamma(pc - x + 1.0) + lgamma(n - pc + 1.0) - lgamma(sn - x + 1.0) - lgamma(n - pc - sn + x + 1.0) - lgamma(n + 1.0) + lgamma(sn + 1.0) + lgamma(n - sn + 1.0))"


@query(sql_round(f"""with recursive {_DAG}, {_ASSOC}, pop as (select cast(p_partkey as varchar) as gene from part where p_size <= 40), s as (select p_brand as study, cast(p_partkey as varchar) as gene from part where p_size < 12),
p as (select ns, go, count(distinct gene) as pc from ap where gene in (select gene from pop) group by 1, 2), k as (select study, ns, go, count(distinct gene) as sc from ap join s using (gene) group by 1, 2, 3), m as (select study, count(*) as sn from s group by 1),
c as (select study, ns, go, sc, pc, sn, (select count(*) from pop) as n from k join p using (ns, go) join m using (study)), e as (select distinct sc, pc, sn, n from c),
w as (select e.*, x, {_LOG_CHOOSE} as lp from (select *, unnest(range(greatest(0, sn + pc - n), least(sn, pc) + 1)) as x from e) e), o as (select sc, pc, sn, n, lp as seen from w where x = sc),
f as (select sc, pc, sn, n, least(1, sum(exp(lp)) filter (lp <= seen + 1e-7)) as p from w join o using (sc, pc, sn, n) group by 1, 2, 3, 4), q as (select * from c join f using (sc, pc, sn, n)),
b as (select *, round(p, 12) as rp, rank() over (partition by study, ns order by round(p, 12)) + count(*) over (partition by study, ns, round(p, 12)) - 1 as i, count(*) over (partition by study, ns) as all_n from q),
up(go, depth) as (select go, 0 from t union select g.child, up.depth + 1 from up join g on g.parent = up.go)
select study, ns as "NS", b.go as "GO", 'term ' || substring(b.go, 2) as name, cast(z.depth as int) as depth, sc * 1.0 / sn > pc * 1.0 / n as enriched, pc as pop_count, sc as study_count, least(1, min(p * all_n / i) over (partition by study, ns order by rp range between current row and unbounded following)) as p_corrected, p as p_uncorrected
from b join (select go, max(depth) as depth from up group by 1) z using (go)""", ["p_corrected", "p_uncorrected"], ["study", '"NS"', '"GO"', "name", "depth", "enriched", "pop_count", "study_count"]))
def go_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return rounded(O.enrichment(*_ontology(spark, d), include_not_significant=True), "p_corrected", "p_uncorrected")


# hidden Markov models


def _tensor(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value > 0")
    day = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - e.agg(F.unix_micros(F.min("ts").cast("timestamp"))).scalar()) / 86_400_000_000).cast("int")
    return e.groupBy(F.col("event_type").alias("gene"), F.col("user_id").alias("cell_type"), day.alias("t")).agg(F.avg("value").alias("a"), F.count(F.lit(1)).cast("double").alias("b")).select("gene", "cell_type", "t", F.inline(F.array(F.struct(F.lit(0).alias("modality"), F.col("a").alias("value")), F.struct(F.lit(1).alias("modality"), F.col("b").alias("value")))))


@query()
def hmm_posteriors(spark: SparkSession, d: str) -> DataFrame:
    tensor = _tensor(spark, d)
    model, _ = H.fit_hmm(tensor, H.create_hmm(2, ["gamma", "exponential"], seed=1))
    return H.posteriors(tensor, model)


@query()
def hmm_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    tensor = _tensor(spark, d)
    model = H.Hmm(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[2.0, 1.0], [3.0, 1.0]]), np.array([[20.0, 5.0], [40.0, 20.0]]), ("gamma", "exponential"))
    made = H.predict_observations(H.posteriors(tensor, model), model).where("modality = 0")
    pairs = made.select("gene", "cell_type", "t", F.col("value").alias("x")).join(tensor.where("modality = 0").select("gene", "cell_type", "t", F.col("value").alias("y")), ["gene", "cell_type", "t"])
    return H.bootstrap_correlation(pairs, "gene")


# plot data


@query("""with m as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders) select o_orderstatus, cast(least(floor((o_totalprice - lo) * 50 / (hi - lo)), 49) as int) as bin, count(*) as n from orders, m group by 1, 2""")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return P.histogram(table(spark, d, "orders"), "o_totalprice", 50, by=["o_orderstatus"])


@query(sql_round("""with q as (select o_orderpriority as k, quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.5) as median, quantile_cont(o_totalprice, 0.75) as q3 from orders group by 1)
select k, q1, median, q3, min(o_totalprice) filter (o_totalprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as low, max(o_totalprice) filter (o_totalprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as high from orders join q on k = o_orderpriority group by 1, 2, 3, 4""", ["q1", "median", "q3", "low", "high"], ["k"], 4))
def quartile_whiskers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), "o_totalprice")
    return rounded(P.whiskers(o, "o_totalprice", ["k"]), "q1", "median", "q3", "low", "high", digits=4)


@query(sql_round(f"{_PROFILE} select region, var_id, x / nullif(max(x) over (partition by var_id), 0) as z from f", ["z"], ["region", "var_id"]))
def heatmap_scaled(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.heatmap(_profiles(spark, d), "var_id", "region", value="value").select("region", "var_id", "z"), "z")


@query(sql_round("select l_orderkey, l_linenumber, sign(l_quantity - 25) * power(10 * abs(l_quantity - 25), 1 / 1.3) as z from lineitem", ["z"], ["l_orderkey", "l_linenumber"]))
def signed_power(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("z"))
    return rounded(P.signed_power(li), "z")


@query("select p_partkey, cast(p_partkey * 7919 % 256 as int) as r, cast(p_partkey * 31 % 256 as int) as g, cast(p_partkey % 256 as int) as b from part")
def hex_colours(spark: SparkSession, d: str) -> DataFrame:
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("#"), two(k * 7919 % 256), two(k * 31 % 256), two(k % 256)).alias("colour"))
    return P.hex_to_rgb(p, "colour").select("p_partkey", "r", "g", "b")


@query("select a.n_name as a, b.n_name as b from nation a join nation b on a.n_name < b.n_name")
def index_pairs(spark: SparkSession, d: str) -> DataFrame:
    return P.index_pairs(table(spark, d, "nation"), "n_name")
