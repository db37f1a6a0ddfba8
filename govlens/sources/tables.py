"""Loaders that turn the stored tables into facts, signals, edges, files and scan histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACT_METRICS = {"Discount": "l_discount", "Tax": "l_tax", "Quantity": "l_quantity", "UnitPrice": "l_extendedprice / l_quantity"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt by key over as many tasks as a shuffle has: before work that is far larger than the table it starts from.

    A small table lies in few files and would be read, and worked on, by as few tasks. A number that is asked for isn't coalesced.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts in long form: one row per measured metric of a line item."""
    pairs = ", ".join(f"'{k}', cast({v} as double)" for k, v in FACT_METRICS.items())
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as project", "l_suppkey as file", "concat(l_returnflag, '-', l_linestatus) as domain", "'File' as scope",
        "l_linenumber <= 5 as has_evidence", "l_linenumber = 7 as incomplete", f"stack({len(FACT_METRICS)}, {pairs}) as (metric_key, metric_value)",
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as security signals: category, score, and a number from the JSON metadata."""
    return read(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", F.lower("event_type").alias("category"), F.col("value").alias("score"), F.get_json_object("props", "$.k").cast("int").alias("k"), "props"
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files of a module, with a synthetic path."""
    docs = read(spark, sf_dir, "documents")
    folder = F.element_at(F.array(*map(F.lit, ("src", "src/app", "test", "node_modules/lib", "obj/debug", "docs"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return docs.select("doc_id", "text", "lang", F.col("source").alias("module"), F.concat(F.lit("repo/"), folder, F.lit("/"), F.col("source"), F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("path"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency edges: customers' nation to suppliers' nation, with the regions as layers; one row per observation."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("source"))
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("target"))
    layers = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    seen = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = seen.groupBy("source", "target").agg(F.count(F.lit(1)).alias("observed"))
    return (
        pairs.join(layers.select(F.col("n_nationkey").alias("source"), F.col("r_name").alias("source_layer")), "source")
        .join(layers.select(F.col("n_nationkey").alias("target"), F.col("r_name").alias("target_layer")), "target")
        .select("source", "source_layer", "target", "target_layer", "observed")
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the successive scan reports of a project, the customer."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("project"), F.col("o_orderdate").alias("scanned_at"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
