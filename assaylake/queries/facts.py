"""Operators whose raw results SQL can't give, by what must hold of them; files written and read again; further single operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylake.model import Assay
from assaylake.operators import clustering as U
from assaylake.operators import community as C
from assaylake.operators import embedding as E
from assaylake.operators import graph as G
from assaylake.operators import grid as D
from assaylake.operators import hmm as H
from assaylake.operators import layers as L
from assaylake.operators import metadata as M
from assaylake.operators import ontology as O
from assaylake.operators import regulation as R
from assaylake.operators import stats as T
from assaylake.operators import summaries as S
from assaylake.plans.scratch import shared_folder
from assaylake.queries import analysis as Q
from assaylake.queries._adapt import BASE, BRANDS, points, rounded, sql_round, sql_t_tail, supplier_brands, supplier_parts
from assaylake.sources import annotation as A
from assaylake.sources.export import load_sparse, save_sparse
from assaylake.sources.fragments import read_fragments
from assaylake.sources.tables import clean_fragments, table

QUERIES: dict = {}
SQL: dict = {}
SAMPLES = 3


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


# communities


def _above(graph: DataFrame, found: DataFrame, labels: DataFrame):
    return C.modularity(graph, found).scalar() > C.modularity(graph, labels).scalar()


@query("select count(*) as n_nodes, true as better_than_labels, true as connected from embeddings")
def leiden_quality(spark: SparkSession, d: str) -> DataFrame:
    """Leiden communities of all embeddings beat their labels, and each is connected."""
    graph = Q._neighbour_graph(spark, d)
    found = Q.Scratch(spark, "leiden").save(C.leiden(points(spark, d).select("id"), graph), "found")
    a, b = found.select(F.col("id").alias("src"), F.col("community").alias("_a")), found.select(F.col("id").alias("dst"), F.col("community").alias("_b"))
    inner = graph.join(a, "src").join(b, "dst").where("_a = _b").select("src", "dst")
    parts = C.connected_components(found.select("id"), inner).select("component").distinct().agg(F.count(F.lit(1))).scalar()
    return found.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("community").alias("_k")).select("n_nodes", _above(graph, found, Q._labels(spark, d)).alias("better_than_labels"), (F.col("_k") == parts).alias("connected"))


def _codes(matrix: DataFrame, sample: int) -> DataFrame:
    return matrix.select("id", F.col("codes")[sample].alias("community"))


@query(f"select s as sample, count(*) as n_nodes, true as better_than_labels from embeddings, range({SAMPLES}) t(s) group by 1")
def leiden_matrix(spark: SparkSession, d: str) -> DataFrame:
    graph, labels = Q._neighbour_graph(spark, d), Q._labels(spark, d)
    m = Q.Scratch(spark, "leiden").save(C.leiden_matrix(points(spark, d).select("id"), graph, [1.0, 1.5, 2.0]), "codes")
    out = None
    for k in range(SAMPLES):
        row = _codes(m, k).agg(F.lit(k).cast("long").alias("sample"), F.count(F.lit(1)).alias("n_nodes")).withColumn("better_than_labels", _above(graph, _codes(m, k), labels))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"with n as (select count(*) as n from embeddings) select s as sample, n // 7 as smallest, (n + 6) // 7 as largest from n, range({SAMPLES}) t(s)")
def random_neighbourhood_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Seven neighbourhoods of equal size in every sample."""
    m = C.random_neighbourhood_matrix(points(spark, d).select("id"), Q._neighbour_graph(spark, d), 7, SAMPLES)
    sizes = m.select(F.posexplode("codes").alias("sample", "c")).groupBy("sample", "c").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(F.col("sample").cast("long").alias("sample")).agg(F.min("n").alias("smallest"), F.max("n").alias("largest"))


@query("select count(*) as n_nodes, count(*) as labelled from embeddings")
def label_propagation_covers(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    found = C.label_propagation(p.select("id"), Q._neighbour_graph(spark, d), rounds=30)
    return found.join(p.select(F.col("id").alias("community")), "community", "left_semi").agg(F.count_distinct("id").alias("n_nodes"), F.count("community").alias("labelled"))


@query(sql_round(f"""{Q._NEAR}, e2 as (select least(a.community, b.community) as ca, greatest(a.community, b.community) as cb, count(*) as n from u join m a on a.id = src join m b on b.id = dst where a.community <> b.community group by 1, 2),
z as (select community, count(*) as k from m group by 1), h as (select max(n * 1.0 / (x.k + y.k)) as top from e2 join z x on x.community = ca join z y on y.community = cb)
select count(*) - 1 as n_steps, cast(sum(community) as bigint) as names, cast(count(*) * (count(*) - 1) // 2 as bigint) as places, 1 / any_value(top) as first_height, true as all_leaves from z, h""", ["first_height"], ["n_steps", "names", "places", "all_leaves"]))
def community_tree(spark: SparkSession, d: str) -> DataFrame:
    """The hierarchy of labels: its number of merges, the height of the densest pair, and an order that holds every label."""
    steps, order = C.community_tree(Q._neighbour_graph(spark, d), Q._labels(spark, d))
    n = order.agg(F.count(F.lit(1))).scalar()
    top = steps.agg(F.count(F.lit(1)).alias("n_steps"), F.min_by("height", "step").alias("first_height"), (F.max("n_leaves") == n).alias("all_leaves"))
    totals = order.agg(F.sum("community").cast("long").alias("names"), F.sum("position").cast("long").alias("places"))
    return rounded(top.withColumns({"names": totals.select("names").scalar(), "places": totals.select("places").scalar()}), "first_height")


@query(sql_round("""with e as (select vec_id as obs_id, label, cast(embedding[1] as double) as t from embeddings), m as (select min(t) as lo, max(t) as hi from e) select obs_id, cast(label as bigint) as slot, (t - lo) / (hi - lo) * 100 as y from e, m""", ["y"], ["obs_id", "slot"]))
def dendrogram(spark: SparkSession, d: str) -> DataFrame:
    """Every embedding in the slot of its label, jittered within it, at the height of its time."""
    p = points(spark, d).select(F.col("id").alias("obs_id"), F.col("label").alias("community"), F.get("vec", F.lit(0)).alias("time"))
    order = p.select("community", F.col("community").alias("position")).distinct()
    out = E.dendrogram_layout(p, order)
    return rounded(out.select("obs_id", F.floor(F.col("vec")[0] / 100 * order.agg(F.count(F.lit(1))).scalar()).alias("slot"), F.col("vec")[1].alias("y")), "y")


# clusterings of planted groups


def _planted(spark: SparkSession, d: str) -> DataFrame:
    """Customers around one place for each region."""
    places = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    r = F.col("n_regionkey")
    jitter = lambda m: (F.col("c_custkey") * m % 101) / 101.0
    return places.select(F.col("c_custkey").alias("id"), F.array(r * 100.0 + jitter(7919), (r * 2 % 5) * 100.0 + jitter(31)).alias("vec"))


@query("select c_custkey as id, min(c_custkey) over (partition by n_regionkey) as first_id from customer join nation on c_nationkey = n_nationkey")
def kmeans_planted(spark: SparkSession, d: str) -> DataFrame:
    found = U.kmeans(_planted(spark, d), 5)
    return found.select("id", F.min("id").over(Window.partitionBy("cluster")).alias("first_id"))


def _planted_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Parts that are high in one of four columns."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("var_id"), (F.col("p_partkey") % 4).alias("k"), ((F.col("p_partkey") * 7919 % 101) / 101.0).alias("x"))
    return p.select("var_id", F.explode(F.array(*map(F.lit, "abcd"))).alias("column"), "k", "x").select("var_id", "column", (F.when(F.ascii("column") - 97 == F.col("k"), 9.0).otherwise(0.3) + 0.1 * F.col("x")).alias("value"))


@query("select cast(p_partkey as varchar) as var_id, min(cast(p_partkey as varchar)) over (partition by p_partkey % 4) as first_id from part")
def cluster_summaries_planted(spark: SparkSession, d: str) -> DataFrame:
    found = U.cluster_summaries(_planted_profiles(spark, d), 4, n_components=3)
    return found.select("var_id", F.min("var_id").over(Window.partitionBy("cluster")).alias("first_id"))


@query("select cast(p_partkey as varchar) as var_id, cast(p_partkey % 4 as int) as cluster from part")
def cocluster_summaries_planted(spark: SparkSession, d: str) -> DataFrame:
    """Every part in the place of the column it is high in."""
    return U.cocluster_summaries(_planted_profiles(spark, d))


# embeddings


@query(sql_round("with y as (select unnest(embedding) as v, unnest(range(len(embedding))) as c from embeddings), s as (select c, var_pop(cast(v as double)) * count(*) as q, count(*) as n from y group by 1) select max(n) as n, sum(q) as total, 1.0 as ratios from s", ["total", "ratios"], ["n"], 4))
def pca_variance(spark: SparkSession, d: str) -> DataFrame:
    """All components together hold all of the variance."""
    p = points(spark, d).select(F.col("id").alias("obs_id"), "vec")
    ratios, scores = E.pca(p, 64)
    q = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    return rounded(scores.agg(F.count(F.lit(1)).alias("n"), F.sum(q).alias("total")).withColumn("ratios", F.lit(float(ratios.sum()))), "total", "ratios", digits=4)


def _residuals(vectors: DataFrame, image: DataFrame, values: np.ndarray) -> DataFrame:
    """(component, small): whether |A v - l v| is small beside l |v|; both tables are (id, i, x)."""
    l = F.array(*[F.lit(float(v)) for v in values])
    rows = vectors.join(image.withColumnRenamed("x", "y"), ["id", "i"], "left").withColumn("l", F.get(l, "i"))
    gap = F.coalesce("y", F.lit(0.0)) - F.col("l") * F.col("x")
    s = rows.groupBy(F.col("i").cast("long").alias("component")).agg(F.sqrt(F.sum(gap * gap)).alias("r"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"), F.abs(F.first("l")).alias("l"))
    return s.select("component", (F.col("r") <= 1e-4 * F.col("l") * F.col("n")).alias("small"))


@query("select i as component, true as small from range(4) t(i)")
def diffusion_residuals(spark: SparkSession, d: str) -> DataFrame:
    """The diffusion map solves its eigenproblem."""
    graph = Q._neighbour_graph(spark, d)
    values, vectors = E.diffusion_map(graph, 4)
    long = Q.Scratch(spark, "check").save(vectors.select("id", F.posexplode("vec").alias("i", "x")), "vectors")
    image = E.diffusion_transitions(graph).join(long.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "i").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
    return _residuals(long, image, values)


def _cosine_image(x: DataFrame, long: DataFrame) -> DataFrame:
    """D^-1/2 (X Xt - diag) D^-1/2 v, written out anew."""
    column = x.groupBy("var_id").agg(F.sum("value").alias("c"))
    d = x.join(column, "var_id").groupBy(F.col("obs_id").alias("id")).agg((F.sum(F.col("value") * F.col("c")) - F.sum(F.col("value") * F.col("value"))).alias("d"), F.sum(F.col("value") * F.col("value")).alias("s"))
    rows = x.withColumnRenamed("obs_id", "id").join(d, "id").withColumn("w", F.col("value") / F.sqrt("d"))
    inner = rows.join(long, "id").groupBy("var_id", "i").agg(F.sum(F.col("w") * F.col("x")).alias("u"))
    outer = rows.join(inner, "var_id").groupBy("id", "i").agg(F.sum(F.col("w") * F.col("u")).alias("y"))
    return outer.join(d, "id").join(long, ["id", "i"]).select("id", "i", (F.col("y") - F.col("s") / F.col("d") * F.col("x")).alias("x"))


@query("select i as component, true as small from range(4) t(i)")
def spectral_residuals(spark: SparkSession, d: str) -> DataFrame:
    coo = supplier_brands(spark, d).layer("qty")
    values, emb = E.spectral(coo, 4, skip_idf=True, weighted_by_sd=False)
    long = Q.Scratch(spark, "check").save(emb.select(F.col("obs_id").alias("id"), F.posexplode("vec").alias("i", "x")), "vectors")
    return _residuals(long, _cosine_image(L.l2_norm(coo), long), values)


@query("select count(*) as n, true as finite, true as neighbours_closer from embeddings")
def umap_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Linked embeddings lie closer in the layout than others."""
    layout = Q.Scratch(spark, "umap").save(Q.QUERIES["umap_layout"](spark, d).select("id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y")), "layout")
    far = lambda c: F.sqrt((F.col("a.x") - F.col("b.x")) ** 2 + (F.col("a.y") - F.col("b.y")) ** 2).alias(c)
    linked = Q._neighbour_graph(spark, d).join(layout.alias("a"), F.col("src") == F.col("a.id")).join(layout.alias("b"), F.col("dst") == F.col("b.id")).agg(F.avg(far("d"))).scalar()
    spread = F.sqrt(F.var_pop("x") + F.var_pop("y"))  # the usual distance from the middle
    return layout.agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.abs("x") < 1e9) & (F.abs("y") < 1e9)).alias("finite"), spread.alias("_s")).select("n", "finite", (linked < F.col("_s") * 1.2).alias("neighbours_closer"))


# metadata, layers, modalities


@query(f"{BASE} select var_id, brand as metabin from v")
def metabin_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Parts' clusters, as the cells of the transposed assay have them."""
    a = supplier_parts(spark, d)
    return M.add_metabin_metadata(a, M.transpose(a, ["qty"]), "brand", tree=None).var.select("var_id", "metabin")


@query(sql_round(f"""{Q._PIX} select 'x' as axis, cast(i as int) as i, case when i = {Q._RES[0] - 1} then x1 else x0 + i * ((x1 - x0) / {Q._RES[0] - 1}) end as line from m, range({Q._RES[0]}) t(i) union all select 'y', cast(i as int), case when i = {Q._RES[1] - 1} then y1 else y0 + i * ((y1 - y0) / {Q._RES[1] - 1}) end from m, range({Q._RES[1]}) t(i)""", ["line"], ["axis", "i"]))
def shared_grid(spark: SparkSession, d: str) -> DataFrame:
    """The grid of one assay, as another has it afterwards."""
    a = supplier_parts(spark, d)
    first = a.with_uns(grid=D.grid_axes(Q._pixels(spark, d), Q._RES), summary=a.obs.select("region"))
    return rounded(M.same_grid([first, Assay(a.obs, a.var)])[1].uns["grid"], "line")


@query(sql_round(f"{BASE} select count(*) as n, sum(value) as total, sqrt(sum(value * value)) as norm from q", ["total", "norm"], ["n"], 4))
def renamed_layer(spark: SparkSession, d: str) -> DataFrame:
    """A layer under another name, with its sum and its Frobenius norm."""
    coo = M.rename_layer(supplier_parts(spark, d), "qty", "X").layer("X")
    norm = L.frobenius(coo).scalar()
    return rounded(coo.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).withColumn("norm", norm), "total", "norm", digits=4)


@query(sql_round(f"{BRANDS}, x as (select 'qty' as modality, obs_id, var_id, value from b union all select 'price', obs_id, brand, sum(price) from q join v using (var_id) group by 1, 2, 3), y as (select * from x where var_id <> 'Brand#11'), t as (select modality, sum(value) as s from y group by 1), n as (select nation, count(*) as k from o group by 1) select var_id, modality || '|' || nation as \"column\", sum(sqrt(1e6 * value / s)) / any_value(k) * case modality when 'qty' then 2.0 else 1.0 end as value from y join t using (modality) join o using (obs_id) join n using (nation) group by var_id, modality, nation", ["value"], ["var_id", '"column"']))
def modality_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Mean profiles of two modalities side by side, the first with twice the weight."""
    a = supplier_brands(spark, d)
    summary = S.summarize_modalities({n: a.layer(n) for n in ("qty", "price")}, a.var.where("var_id <> 'Brand#11'"), a.obs, "nation", sqrt=True)
    return rounded(S.sortable_matrix(S.modality_means(summary, a.obs, "nation"), "modality", "nation", {"qty": 2.0}), "value")


@query("select * from (select name, binname, score from regulatory_links where name = (select min(name) from regulatory_links))")
def links_of_gene(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "regulatory_links")
    name = links.agg(F.min("name")).first()[0]
    return R.links_of(links, name).select("name", "binname", "score")


# tests


@query(sql_round(f"""{BRANDS}, t as (select var_id, region as "group", sum(value) as s1 from b join o using (obs_id) group by 1, 2), a as (select var_id, sum(value) as s from b group by 1), n as (select region as "group", count(*) as n1, (select count(distinct obs_id) from b) - count(*) as n0 from o where obs_id in (select obs_id from b) group by 1)
select "group", var_id, log2((s1 / n1) / ((s - s1) / n0)) as score, (s1 / n1 + (s - s1) / n0) / 2 as base_mean from t join a using (var_id) join n using ("group") where s1 > 0 and s - s1 > 0""", ["score", "base_mean"], ['"group"', "var_id"], 5))
def likelihood_effects(spark: SparkSession, d: str) -> DataFrame:
    """Effect sizes of the likelihood-ratio test; its p-values are tested against a fit of their own."""
    return rounded(Q.QUERIES["likelihood_markers"](spark, d).select("group", "var_id", "score", "base_mean"), "score", "base_mean", digits=5)


@query(sql_round(f"""with p(a, b) as (values ('F', 'O'), ('F', 'P'), ('O', 'P')), s as (select o_orderpriority as k, o_orderstatus as g, avg(o_totalprice) as m, var_samp(o_totalprice) as v, count(*) as n from orders group by 1, 2),
t as (select p.a as scheme_i, p.b as scheme_j, x.k, (x.m - y.m) / sqrt(((x.n - 1) * x.v + (y.n - 1) * y.v) / (x.n + y.n - 2) * (1.0 / x.n + 1.0 / y.n)) as statistic, cast(x.n + y.n - 2 as double) as df from p join s x on x.g = p.a join s y on y.g = p.b and y.k = x.k)
select scheme_i, scheme_j, k, statistic, {sql_t_tail('statistic', 'df')} as pval from t""", ["statistic", "pval"], ["scheme_i", "scheme_j", "k"]))
def statistic_test(spark: SparkSession, d: str) -> DataFrame:
    scheme = [("F", "O"), ("F", "P"), ("O", "P")]
    return rounded(T.pairwise_tests(Q._orders(spark, d), "g", scheme, by=["k"], test="ttest"), "statistic", "pval")


@query(f"{Q._DIST} select true as equal")
def equal_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Every embedding has as many neighbours as any other."""
    p = points(spark, d)
    return G.equal_degrees(G.knn_exact(p, p, 10))


@query(sql_round(f"""{Q._DIST}, y as (select id, x.* from e, lateral (values ('label', cast(label as double)), ('first', vec[1])) x(var_id, value)) select src as obs_id, var_id, sum(value / distance) / sum(1 / distance) as value from r join y on y.id = r.dst where "rank" <= 3 group by 1, 2""", ["value"], ["obs_id", "var_id"]))
def layer_transfer(spark: SparkSession, d: str) -> DataFrame:
    """Two features of every embedding from its three nearest others."""
    p = points(spark, d)
    coo = p.select(F.col("id").alias("obs_id"), F.inline(F.array(F.struct(F.lit("label").alias("var_id"), F.col("label").cast("double").alias("value")), F.struct(F.lit("first").alias("var_id"), F.col("vec")[0].alias("value")))))
    return rounded(G.knn_regress_layer(G.knn_exact(p, p, 3), coo), "value")


# landscapes


def _grids(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    px, a = Q._pixels(spark, d), supplier_brands(spark, d)
    return D.grid_numerical(a.layer("qty"), px, 0), D.grid_numerical(a.layer("price"), px, 0)


_TWO = f"{Q._PIX}, n as (select ix, iy, count(*) as n from i group by 1, 2), b as (select obs_id, brand as var_id, sum(value) as value, sum(price) as price from q join v using (var_id) group by 1, 2), z as (select var_id, ix, iy, round(sum(value) / any_value(n), 6) as x, round(sum(price) / any_value(n), 6) as y from b join i using (obs_id) join n using (ix, iy) group by 1, 2, 3)"


@query(sql_round(f"{_TWO} select var_id, case when isfinite(corr(x, y)) then corr(x, y) end as res from z group by 1", ["res"], ["var_id"]))
def grid_correlation(spark: SparkSession, d: str) -> DataFrame:
    a, b = (rounded(g, "z") for g in _grids(spark, d))
    return rounded(D.grid_correlations(a, b, spearman=False), "res")


@query(sql_round(f"{_TWO}, w as (select var_id, rank() over (partition by var_id order by x) + (count(*) over (partition by var_id, x) - 1) / 2.0 as x, rank() over (partition by var_id order by y) + (count(*) over (partition by var_id, y) - 1) / 2.0 as y from z) select var_id, case when isfinite(corr(x, y)) then corr(x, y) end as res from w group by 1", ["res"], ["var_id"]))
def grid_rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    a, b = (rounded(g, "z") for g in _grids(spark, d))
    return rounded(D.grid_correlations(a, b), "res")


@query(f"""{Q._PIX}, g as (select ix, iy, region, count(*) as c from i group by 1, 2, 3), r as (select *, row_number() over (partition by ix, iy order by c desc, region) as k, sum(c) over (partition by ix, iy) as n from g), w as (select ix, iy, region, n from r where k = 1),
cx as (select ix from w group by 1 having sum(n) > 0), cy as (select iy from w group by 1 having sum(n) > 0), t as (select w.* from w where ix between (select min(ix) from cx) and (select max(ix) from cx) and iy between (select min(iy) from cy) and (select max(iy) from cy))
select cast(ix as int) as ix, region as mode from (select ix, region, row_number() over (partition by ix order by count(*) desc, region) as k from t group by 1, 2) where k = 1""")
def color_summary(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent region of each column of the trimmed grid."""
    regions = D.grid_categorical(Q._pixels(spark, d), supplier_parts(spark, d).obs, "region", 0)
    return D.color_summary(regions, "region", 0, 0)


@query(f"select count(distinct p_brand) as n_features, count(distinct p_brand) * {Q._RES[0] * Q._RES[1] * 4} as n_pixels, 0.0 as lowest, 1.0 as highest from part")
def grid_chain_range(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain of image transformations gives every pixel of every feature, from 0 to 1."""
    z = Q.QUERIES["grid_smoothed"](spark, d)
    return z.agg(F.count_distinct("var_id").alias("n_features"), F.count(F.lit(1)).alias("n_pixels"), F.min("z").alias("lowest"), F.max("z").alias("highest"))


# hidden Markov models

_TENSOR = """e as (select event_type as gene, user_id as cell_type, cast(floor((epoch_us(ts) - (select min(epoch_us(ts)) from events where value > 0)) / 86400000000.0) as int) as t, value from events where value > 0),
x as (select gene, cell_type, t, avg(value) as a, count(*) * 1.0 as b from e group by 1, 2, 3)"""


@query(sql_round(f"""with recursive {_TENSOR}, l as (select gene, cell_type, max(t) as n from x group by 1, 2), f as (select l.gene, l.cell_type, s.t, n, coalesce(exp(-a / 20) / 20, 1) as e0, coalesce(exp(-a / 40) / 40, 1) as e1 from l, lateral (select unnest(range(n + 1)) as t) s left join x on x.gene = l.gene and x.cell_type = l.cell_type and x.t = s.t),
w(gene, cell_type, t, a0, a1, ll) as (select gene, cell_type, t, 0.5 * e0 / (0.5 * e0 + 0.5 * e1), 0.5 * e1 / (0.5 * e0 + 0.5 * e1), ln(0.5 * e0 + 0.5 * e1) from f where t = 0
  union all select gene, cell_type, t, p0 / (p0 + p1), p1 / (p0 + p1), ll + ln(p0 + p1) from (select f.gene, f.cell_type, f.t, (a0 * 0.9 + a1 * 0.2) * e0 as p0, (a0 * 0.1 + a1 * 0.8) * e1 as p1, ll from w join f on f.gene = w.gene and f.cell_type = w.cell_type and f.t = w.t + 1)),
v(gene, cell_type, t, b0, b1) as (select gene, cell_type, t, 0.5::double, 0.5::double from f where t = n
  union all select gene, cell_type, t, q0 / (q0 + q1), q1 / (q0 + q1) from (select v.gene, v.cell_type, v.t - 1 as t, 0.9 * e0 * b0 + 0.1 * e1 * b1 as q0, 0.2 * e0 * b0 + 0.8 * e1 * b1 as q1 from v join f on f.gene = v.gene and f.cell_type = v.cell_type and f.t = v.t where v.t > 0)),
z as (select gene, cell_type, arg_max(ll, t) as loglik from w group by 1, 2)
select w.gene, w.cell_type, w.t, a0 * b0 / (a0 * b0 + a1 * b1) as p0, z.loglik from w join v using (gene, cell_type, t) join z using (gene, cell_type)""", ["p0", "loglik"], ["gene", "cell_type", "t"]))
def hmm_fixed_posteriors(spark: SparkSession, d: str) -> DataFrame:
    """Posteriors of a stated model with exponential emissions."""
    tensor = Q._tensor(spark, d).where("modality = 0")
    model = H.Hmm(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.ones((2, 1)), np.array([[20.0], [40.0]]), ("exponential",))
    return rounded(H.posteriors(tensor, model).select("gene", "cell_type", "t", F.col("posterior")[0].alias("p0"), "loglik"), "p0", "loglik")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    t = Q._tensor(spark, d)
    a, b = (t.where(F.col("modality") == i).select("gene", "cell_type", "t", F.col("value").alias(n)) for i, n in enumerate("xy"))
    return a.join(b, ["gene", "cell_type", "t"])


@query(sql_round(f"""with {_TENSOR}, m as (select gene, min(a) as a0, min(b) as b0 from x group by 1) select gene, coalesce(case when isfinite(corr(a, b)) then corr(a, b) end, 0) as res from x join m using (gene) where a <> a0 or b <> b0 group by 1""", ["res"], ["gene"]))
def reconstruction_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Plain correlation of two modalities, the pairs of least values left out."""
    return rounded(H.bootstrap_correlation(_pairs(spark, d), "gene", q=None), "res")


@query(sql_round(f"""with {_TENSOR}, p as (select u.gene, u.cell_type, u.a as x, w.b as y from x u join x w on w.gene = u.gene and w.cell_type = u.cell_type and w.t = u.t - 1),
k as (select gene, cell_type, rank() over (partition by gene, cell_type order by round(x, 9)) + (count(*) over (partition by gene, cell_type, round(x, 9)) - 1) / 2.0 as x, rank() over (partition by gene, cell_type order by y) + (count(*) over (partition by gene, cell_type, y) - 1) / 2.0 as y from p)
select gene, cell_type, case when isfinite(corr(x, y)) then corr(x, y) end as res from k group by 1, 2""", ["res"], ["gene", "cell_type"]))
def lagged_rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Spearman correlation of one modality with the other a day before."""
    return rounded(H.lagged_correlation(rounded(_pairs(spark, d), "x", digits=9), ["gene", "cell_type"], lag=1), "res")


# ontology


@query(Q.SQL["go_enrichment"].replace("p_size < 12", "p_size < 6"))
def top_marker_goea(spark: SparkSession, d: str) -> DataFrame:
    terms, edges, assoc, population, _ = Q._ontology(spark, d)
    markers = table(spark, d, "part").where("p_size < 6").select(F.col("p_brand").alias("group"), F.col("p_partkey").cast("string").alias("var_id"))
    return rounded(O.top_marker_enrichment(terms, edges, assoc, population, markers, include_not_significant=True), "p_corrected", "p_uncorrected")


@query(f"""with z as ({Q.SQL["go_enrichment"]}), k as (select name from (select *, row_number() over (partition by "NS" order by p_corrected, "GO") as r from z) where r <= 3) select study, "GO" from z where name in (select name from k)""")
def terms_for_plot(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the terms of least p-values of each namespace."""
    return O.terms_for_plot(Q.QUERIES["go_enrichment"](spark, d), 3).select("study", "GO")


# files


@query("""select case when starts_with(chr, 'chr') then chr else 'chr' || chr end as chr, '+' as strand, cast("start" as bigint) as "start", cast("end" as bigint) as "end", var_id as id, upper(var_id) as extra from var_genes where chr is not null""")
def gtf_genes(spark: SparkSession, d: str) -> DataFrame:
    """The genes written as annotation and read again."""
    path = _folder(spark, "gtf")
    g = table(spark, d, "var_genes").where("chr is not null")
    attribute = F.format_string('gene_id "%s"; gene_symbol "%s";', F.upper("var_id"), F.col("var_id"))
    g.select(F.concat_ws("\t", F.regexp_replace("chr", "^chr", ""), F.lit("src"), F.lit("gene"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), F.lit("+"), F.lit("."), attribute)).write.text(path)
    return A.gtf(spark, path, extra_key="gene_id")


def _ontology_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    terms, edges, assoc, _, _ = Q._ontology(spark, d)
    long = F.create_map(*[F.lit(x) for k, v in A.NAMESPACES.items() for x in (v, k)])
    parents = edges.groupBy(F.col("child").alias("go")).agg(F.sort_array(F.collect_list("parent")).alias("p"))
    stanza = terms.join(parents, "go", "left").select(F.concat(F.lit("[Term]\nid: "), "go", F.lit("\nname: "), "name", F.lit("\nnamespace: "), long[F.col("ns")], F.coalesce(F.concat_ws("", F.transform("p", lambda x: F.concat(F.lit("\nis_a: "), x, F.lit(" ! parent")))), F.lit(""))))
    obo, gaf = _folder(spark, "obo"), _folder(spark, "gaf")
    stanza.write.option("lineSep", "\n\n").text(obo)
    read, ways = A.obodag(spark, obo)
    line = F.concat_ws("\t", F.lit("DB"), F.lit("id"), F.col("gene"), F.when(F.col("gene").cast("long") % 5 == 0, "NOT|involved_in").otherwise("involved_in"), F.col("go"), *[F.lit("x")] * 12)
    assoc.select(line).write.text(gaf)
    return read, ways, A.gaf(spark, gaf, read)


@query(f"with recursive {Q._DAG} select t.go, t.name, t.ns, (select count(*) from g where child = t.go) as n_parents from t")
def obo_terms(spark: SparkSession, d: str) -> DataFrame:
    terms, edges, _ = _ontology_files(spark, d)
    return terms.join(edges.groupBy(F.col("child").alias("go")).agg(F.count(F.lit(1)).alias("n_parents")), "go", "left").na.fill(0, ["n_parents"])


@query(f"with recursive {Q._DAG}, {Q._ASSOC} select ns, gene, go from a where cast(gene as bigint) % 5 <> 0")
def gaf_genes(spark: SparkSession, d: str) -> DataFrame:
    return _ontology_files(spark, d)[2]


@query(sql_round(f"{BASE} select obs_id, var_id, value from q", ["value"], ["obs_id", "var_id"]))
def sparse_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "sparse")
    save_sparse(supplier_parts(spark, d).layer("qty"), path)
    return rounded(load_sparse(spark, path), "value")


_WHOLE = """chr is not null and "start" is not null and "end" is not null and bc is not null and trim(bc) <> '' and "readSupport" is not null"""


@query(f"""select case when starts_with(chr, 'chr') then chr else 'chr' || chr end as chr, count(*) as n, cast(sum("start") as bigint) as starts, cast(sum("readSupport") as bigint) as support from fragments where {_WHOLE} group by 1""")
def fragments_file(spark: SparkSession, d: str) -> DataFrame:
    """The fragments without nulls written as a file and read again."""
    path = _folder(spark, "fragments")
    rows = clean_fragments(table(spark, d, "fragments").where(_WHOLE.replace('"', "`")))
    rows.select("chr", "start", "end", "bc", "readSupport").write.option("sep", "\t").csv(path)
    return read_fragments(spark, path).groupBy("chr").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum("readSupport").alias("support"))
