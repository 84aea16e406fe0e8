"""Projections of the star-schema tables to the engine's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import columns as C
from foliant.functions import vocab

TIERS = tuple(vocab.RELIABILITY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_tier(source):
    """The source class of ``srcN``: tiers in turn."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]+)", 1).try_cast("int")
    return F.coalesce(F.array(*[F.lit(t) for t in TIERS])[n % len(TIERS)], F.lit("unknown"))


def claims(spark, sf_dir) -> DataFrame:
    """Facts with sources that disagree: what orders say of their customer's priority."""
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "codex").when(F.col("o_orderstatus") == "O", "wiki").otherwise("ballad")
    rows = o.select(
        F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")).alias("subject_id"), F.lit("order_priority").alias("attribute"), F.col("o_orderpriority").alias("value_text"),
        C.value_key(F.col("o_orderpriority")).alias("value_key"), F.concat(F.lit("doc-"), F.col("o_orderkey").cast("string")).alias("document_id"), F.concat(F.lit("doc-"), (F.col("o_orderkey") % 7).cast("string")).alias("chunk_id"),
        kind.alias("source_class"), F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("value_number"),
    )
    return rows.withColumn("reliability", C.reliability(F.col("source_class")))


def attributes(spark, sf_dir) -> DataFrame:
    """EAV rows of customers, suppliers and parts."""
    of = lambda t, key, prefix, cols: table(spark, sf_dir, t).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("subject_id"), *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(["subject_id"], list(cols), "attribute", "value_text")
    parts = of("part", "p_partkey", "part_", ("p_brand", "p_type", "p_size"))
    return parts.unionByName(of("customer", "c_custkey", "customer_", ("c_mktsegment",)))


def edges(spark, sf_dir) -> DataFrame:
    """Typed edges: customers and suppliers in nations in regions, parts related to suppliers."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nation = n.select("n_nationkey", "n_regionkey", C.entity_id(F.col("n_name")).alias("nation_id"))
    place = lambda t, key, at, prefix: table(spark, sf_dir, t).join(nation, F.col(at) == F.col("n_nationkey")).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("subject_id"), F.lit("located_in").alias("predicate"), F.col("nation_id").alias("object_id"), F.lit("infobox").alias("method"), F.lit(0.9).alias("confidence"))
    region = nation.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("nation_id").alias("subject_id"), F.lit("located_in").alias("predicate"), C.entity_id(F.col("r_name")).alias("object_id"), F.lit("infobox").alias("method"), F.lit(0.9).alias("confidence"))
    made = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().select(F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("subject_id"), F.lit("related_to").alias("predicate"), F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")).alias("object_id"), F.lit("wikilink").alias("method"), F.lit(0.6).alias("confidence"))
    return place("customer", "c_custkey", "c_nationkey", "customer_").unionByName(place("supplier", "s_suppkey", "s_nationkey", "supplier_")).unionByName(region).unionByName(made)


def chunks(spark, sf_dir) -> DataFrame:
    """A chunk per non-blank line of documents."""
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", source_tier(F.col("source")).alias("source_class"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "content"))
    return rows.filter(F.trim("content") != "").withColumn("reliability", C.reliability(F.col("source_class")))


def files(spark, sf_dir) -> DataFrame:
    """Documents as discovered files, three formats to a stem."""
    d = table(spark, sf_dir, "documents")
    suffix = F.array(F.lit(".txt"), F.lit(".scan.pdf"), F.lit(".md"))[(F.col("doc_id") % 3).cast("int")]
    path = F.concat(F.lit("wiki/f"), F.floor(F.col("doc_id") / 3).cast("string"), suffix)
    return d.select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), path.alias("relative_path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("file_hash"), "text")


def turns(spark, sf_dir) -> DataFrame:
    """Conversations as documents of blocks, a turn a page."""
    c = table(spark, sf_dir, "conversations")
    none = F.lit(None).cast("string")
    sure = (F.lit(1.0) / (F.col("turn") + 2)).alias("ocr_confidence")
    return c.select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("ordinal"), F.coalesce("text", F.lit("")).alias("text"), F.lit("paragraph").alias("content_type"), F.col("turn").cast("int").alias("page"), F.array().cast("array<string>").alias("section_path"), none.alias("table_id"), none.alias("figure_id"), sure)
