"""The star-schema tables read as a fact store: customers are roots, orders encounters, line items tagged child facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def roots(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("fact_id"), "c_name", "c_mktsegment")


def encounters(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select(F.concat(F.lit("O"), "o_orderkey").alias("fact_id"), F.concat(F.lit("C"), "o_custkey").alias("patient_root"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts"), F.col("o_orderstatus").alias("order_status"), "o_orderpriority")


def children(spark: SparkSession, folder: str, more: tuple[str, ...] = ()) -> DataFrame:
    """fact_id, patient_root, parent_id, ts and tags of the child facts, and more columns of their parts; the first frame of an id wins."""
    li, o, p = table(spark, folder, "lineitem"), table(spark, folder, "orders").select("o_orderkey", "o_custkey"), table(spark, folder, "part").select("p_partkey", *dict.fromkeys(("p_brand", "p_type", "p_size", *more)))
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    # numbers move, ids and dates are written last; items move once, by order, for both their grouping and the join
    rows = li.select(*key, "l_shipdate").repartition("l_orderkey").groupBy(*key).agg(F.min("l_shipdate").alias("shipped"))
    tags = F.array(F.concat(F.lit("risk:"), "p_brand"), F.concat(F.lit("atc:"), "p_type"), F.concat(F.lit("loinc:"), "p_size"))
    found = rows.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return found.select(F.concat(F.lit("L"), F.concat_ws("-", *key)).alias("fact_id"), F.concat(F.lit("C"), "o_custkey").alias("patient_root"), F.concat(F.lit("O"), "l_orderkey").alias("parent_id"), F.date_format("shipped", "yyyy-MM-dd").alias("ts"), tags.alias("tags"), *more)


def tag_rows(facts: DataFrame) -> DataFrame:
    return facts.select(F.explode("tags").alias("tag"), "fact_id", "patient_root", "ts")


def notes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as facts; each turn's parent, and the one it amends, is the turn before."""
    c = table(spark, folder, "conversations")
    me = F.concat(F.lit("T"), "conv_id", F.lit("-"), "turn")
    return c.select(me.alias("fact_id"), F.when(F.col("turn") > 0, F.concat(F.lit("T"), "conv_id", F.lit("-"), F.col("turn") - 1)).alias("parent_id"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
