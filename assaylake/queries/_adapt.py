"""The general test tables seen as assays, and the same views in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.model import Assay
from assaylake.sources.tables import table

DIGITS = 6


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    """Sums of doubles depend on their order in the last digits; + 0.0 turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def sql_round(sql: str, columns: Sequence[str], others: Sequence[str] = (), digits: int = DIGITS) -> str:
    cols = ", ".join([*others, *[f"round({c}, {digits}) + 0.0 as {c}" for c in columns]])
    return f"select {cols} from ({sql})"


def supplier_parts(spark: SparkSession, d: str) -> Assay:
    """Suppliers x parts with layers qty, price and n; nation and region label suppliers, brand labels parts."""
    li = table(spark, d, "lineitem")
    base = li.groupBy(F.col("l_suppkey").cast("string").alias("obs_id"), F.col("l_partkey").cast("string").alias("var_id")).agg(F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"), F.count(F.lit(1)).cast("double").alias("n"))
    layers = {c: base.select("obs_id", "var_id", F.col(c).alias("value")) for c in ("qty", "price", "n")}
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    obs = table(spark, d, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("obs_id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("s_acctbal").alias("time"))
    var = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("var_id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return Assay(obs, var, layers)


def supplier_brands(spark: SparkSession, d: str) -> Assay:
    """Suppliers x brands: the same with parts summed up to brands."""
    a = supplier_parts(spark, d)
    brands = a.var.select("var_id", "brand")
    layers = {n: c.join(brands, "var_id").groupBy("obs_id", F.col("brand").alias("var_id")).agg(F.sum("value").alias("value")) for n, c in a.layers.items()}
    return Assay(a.obs, a.var.select(F.col("brand").alias("var_id")).distinct(), layers)


def event_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Events as fragments: bc = user, chr = event type, start in seconds since the first event, end = start + value."""
    ev = table(spark, d, "events")
    start = F.unix_timestamp("ts") - ev.agg(F.unix_timestamp(F.min("ts"))).scalar()
    return ev.select(F.col("event_type").alias("chr"), start.alias("start"), (start + F.floor("value")).alias("end"), F.col("user_id").cast("string").alias("bc"), F.col("event_id").alias("id"))


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


QTY = "q as (select cast(l_suppkey as varchar) as obs_id, cast(l_partkey as varchar) as var_id, sum(l_quantity) as value, sum(l_extendedprice) as price, count(*) as n from lineitem group by 1, 2)"
OBS = "o as (select cast(s_suppkey as varchar) as obs_id, n_name as nation, r_name as region, s_acctbal as time from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
VAR = "v as (select cast(p_partkey as varchar) as var_id, p_brand as brand, p_size as size from part)"
BASE = f"with {QTY}, {OBS}, {VAR}"
BRANDS = f"{BASE}, b as (select obs_id, brand as var_id, sum(value) as value from q join v using (var_id) group by 1, 2)"
FRAGS = """f as (select event_type as chr, cast(floor(epoch(ts)) - (select floor(min(epoch(ts))) from events) as bigint) as s,
  cast(floor(epoch(ts)) - (select floor(min(epoch(ts))) from events) as bigint) + cast(floor(value) as bigint) as e, cast(user_id as varchar) as bc, event_id as id from events)"""


def sql_two_sided(z: str) -> str:
    """Two-sided tail of the normal distribution: 1 - erf(|z| / sqrt 2), erf by its series of positive terms."""
    x = f"(abs({z}) / sqrt(2.0))"
    term = f"exp(-{x} * {x} + (2 * k + 1) * ln({x}) + 2 * k * ln(2.0) + lgamma(k + 1.0) - lgamma(2.0 * k + 2))"
    return f"case when {x} > 9 then 0.0 when {x} > 0 then greatest(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 400), lambda k: {term})), 0) else 1.0 end"


def sql_chi_tail(chi2: str) -> str:
    """Upper tail of chi-square with one degree of freedom."""
    return sql_two_sided(f"sqrt({chi2})")


def sql_t_tail(t: str, df: str) -> str:
    """Two-sided tail of Student's t: 1 - I_y(1/2, df/2) with y = t^2 / (df + t^2), by its series."""
    y, b = f"({t} * {t} / ({df} + {t} * {t}))", f"({df} / 2.0)"
    front = f"exp(0.5 * ln({y}) + {b} * ln(1 - {y}) - (lgamma(0.5) + lgamma({b}) - lgamma(0.5 + {b})) - ln(0.5))"
    term = f"exp(lgamma(1.5) + lgamma(0.5 + {b} + k) - lgamma(1.5 + k) - lgamma(0.5 + {b}) + k * ln({y}))"
    return f"case when {t} = 0 then 1.0 else greatest(1 - {front} * list_sum(list_transform(range(0, 400), lambda k: {term})), 0) end"
