"""A vault seen in relational tables: rows are notes, columns their fields, foreign keys their links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_of(folder: str, key: Column) -> Column:
    return F.concat(F.lit(f"{folder}/"), key.cast("string"), F.lit(".md"))


def slug(s: Column) -> Column:
    """As a tag may be written."""
    return F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-")


def order_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        path_of("orders", F.col("o_orderkey")).alias("path"), F.col("o_orderkey").alias("key"), F.lit("orders").alias("folder"), path_of("customers", F.col("o_custkey")).alias("customer"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("timestamp").alias("date"),
        F.array(F.concat(F.lit("priority/"), slug(F.col("o_orderpriority")))).alias("tags"),
    )


def customer_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(
        path_of("customers", F.col("c_custkey")).alias("path"), F.col("c_custkey").alias("key"), F.lit("customers").alias("folder"), path_of("nations", F.col("c_nationkey")).alias("nation"),
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.array(F.concat(F.lit("segment/"), F.lower("c_mktsegment"))).alias("tags"),
    )


def document_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With quality and toxic, null without a label."""
    d, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    folder = F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("lang"))
    return d.join(labels, "doc_id", "left").select(
        F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("doc_id").alias("key"), folder.alias("folder"), "lang", "source", "n_chars", "quality", "toxic", "text",
        F.array(F.concat(F.lit("lang/"), F.col("lang"))).alias("tags"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and folder of every note but documents'."""
    kinds = {"orders": ("orders", "o_orderkey"), "customers": ("customer", "c_custkey"), "nations": ("nation", "n_nationkey"), "regions": ("region", "r_regionkey"), "suppliers": ("supplier", "s_suppkey"), "parts": ("part", "p_partkey")}
    parts = [read(spark, sf_dir, table).select(path_of(folder, F.col(key)).alias("path"), F.lit(folder).alias("folder")) for folder, (table, key) in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, ord: order to customer to nation to region, supplier to nation."""
    kinds = [("orders", "orders", "o_orderkey", "customers", "o_custkey"), ("customer", "customers", "c_custkey", "nations", "c_nationkey"), ("nation", "nations", "n_nationkey", "regions", "n_regionkey"), ("supplier", "suppliers", "s_suppkey", "nations", "s_nationkey")]
    parts = [read(spark, sf_dir, t).select(path_of(a, F.col(x)).alias("src"), path_of(b, F.col(y)).alias("dst"), F.lit(0).alias("ord")) for t, a, x, b, y in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tasks: done if the line status is F."""
    l = read(spark, sf_dir, "lineitem")
    return l.select(
        path_of("orders", F.col("l_orderkey")).alias("path"), F.col("l_orderkey").alias("key"), F.when(F.col("l_linestatus") == "F", "x").otherwise(" ").alias("status"),
        (F.col("l_linestatus") == "F").alias("completed"), F.col("l_returnflag").alias("text"), F.col("l_shipdate").cast("timestamp").alias("due"), F.col("l_quantity").alias("quantity"), F.col("l_linenumber").alias("line"),
    )


def day_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(path_of("events", F.col("event_id")).alias("path"), F.col("event_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id"), F.col("event_type"), F.col("value"), F.col("props"))
