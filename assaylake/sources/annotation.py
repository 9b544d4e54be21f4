"""Gene annotation, ontology and link files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.cleaning import CHROM_PREFIX

GTF_SCHEMA = "chr string, src string, feature string, start long, end long, score string, strand string, frame string, attribute string"
LINK_SCHEMA = "chr string, start int, end int, chr2 string, start2 int, end2 int, score double, pval double, qval double"
NAMESPACES = {"molecular_function": "MF", "cellular_component": "CC", "biological_process": "BP"}
PROMOTER_SIZE = 500
LEAST_SCORE = 0.1


def parse_gtf(rows: DataFrame, feature_name: str = "gene", name_key: str = "gene_symbol", *, extra_key: str | None = None) -> DataFrame:
    """(chr, strand, start, end, id, extra) of the rows of one feature kind.

    An attribute is found by its key wherever it stands; one that is missing is
    null. Names get the prefix ``chr`` where they lack it.
    """
    attribute = lambda k: F.nullif(F.regexp_extract("attribute", rf'(?:^|;\s*){k} "([^"]*)"', 1), F.lit(""))
    chrom = F.when(F.col("chr").startswith(CHROM_PREFIX), F.col("chr")).otherwise(F.concat(F.lit(CHROM_PREFIX), "chr"))
    extra = attribute(extra_key) if extra_key else F.lit(None).cast("string")
    return rows.where(F.col("feature") == feature_name).select(chrom.alias("chr"), "strand", "start", "end", attribute(name_key).alias("id"), extra.alias("extra"))


def gtf(spark: SparkSession, path: str, feature_name: str = "gene", name_key: str = "gene_symbol", *, extra_key: str | None = None) -> DataFrame:
    rows = spark.read.schema(GTF_SCHEMA).options(sep="\t", comment="#", quote="\0").csv(path)
    return parse_gtf(rows, feature_name, name_key, extra_key=extra_key)


def obodag(spark: SparkSession, path: str, namespaces: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(terms, edges) of an ontology file: (go, name, ns) and (child, parent); obsolete terms are left out."""
    names = namespaces or NAMESPACES
    if not set(names.values()) <= set(NAMESPACES.values()):
        raise ValueError(f"namespaces map to {sorted(NAMESPACES.values())}")
    stanzas = spark.read.text(path, lineSep="\n\n").where(F.ltrim("value").startswith("[Term]")).where(~F.col("value").rlike(r"(?m)^is_obsolete: true"))
    one = lambda k: F.regexp_extract("value", rf"(?m)^{k}: (.*?)\s*$", 1)
    short = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    terms = stanzas.select(one("id").alias("go"), one("name").alias("name"), short[one("namespace")].alias("ns")).where("ns is not null")
    parents = F.regexp_extract_all("value", F.lit(r"(?m)^is_a: (\S+)"), 1)
    return terms, stanzas.select(one("id").alias("child"), F.explode(parents).alias("parent"))


def parse_gaf(rows: DataFrame, terms: DataFrame, *, name_column: int = 3) -> DataFrame:
    """(ns, gene, go), distinct: annotations whose qualifiers don't hold NOT."""
    kept = rows.where(~F.array_contains(F.split(F.coalesce("_c3", F.lit("")), r"\|"), "NOT"))
    return kept.select(F.col(f"_c{name_column - 1}").alias("gene"), F.col("_c4").alias("go")).where("gene is not null").join(terms.select("go", "ns"), "go").select("ns", "gene", "go").distinct()


def gaf(spark: SparkSession, path: str, terms: DataFrame, *, name_column: int = 3) -> DataFrame:
    schema = ", ".join(f"_c{i} string" for i in range(17))
    return parse_gaf(spark.read.schema(schema).options(sep="\t", comment="!", quote="\0").csv(path), terms, name_column=name_column)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINK_SCHEMA).option("sep", "\t").csv(path)


def regulatory_links(links: DataFrame, genes: DataFrame, *, promoter: bool = True, promoter_size: int = PROMOTER_SIZE, least_score: float = LEAST_SCORE) -> DataFrame:
    """Link rows with ``name`` (the gene whose region they start from) and ``binname``.

    A gene's region is its promoter +- ``promoter_size`` (never below 0), or its
    body. Rows with a null are dropped; a region of several genes gives a row for
    each; an unmatched row keeps a null name. Of each (binname, name) the row of
    highest score stays, if it is above ``least_score``.
    """
    p = F.col("promoter")
    low, high = (F.greatest(p - promoter_size, F.lit(0)), p + promoter_size) if promoter else (F.col("start"), F.col("end"))
    regions = genes.select("chr", low.cast("int").alias("start"), high.cast("int").alias("end"), F.col("var_id").alias("name")).where("start is not null")
    named = links.dropna().join(regions, ["chr", "start", "end"], "left").where(F.col("score") > least_score)
    binname = F.concat("chr2", F.lit(":"), F.col("start2").cast("string"), F.lit("-"), F.col("end2").cast("string"))
    columns = [*links.columns, "name", "binname"]
    order = F.struct("score", *[F.col(c) for c in columns if c not in ("score",)])
    return named.withColumn("binname", binname).groupBy(F.col("binname").alias("_b"), F.col("name").alias("_n")).agg(F.max(order).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in columns])
