"""Incremental projection: what arrives after a watermark is folded into what is there; streams recompute the patients that they touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def catch_up(done: DataFrame, log: DataFrame, position: str, key: str) -> DataFrame:
    """Counts, positions and totals (key, n, upto, total) after the rows above the highest position in done are added."""
    mark = done.agg(F.max("upto")).first()[0]
    fresh = log.where(F.col(position) > mark) if mark is not None else log
    part = fresh.groupBy(key).agg(F.count("*").alias("n"), F.max(position).alias("upto"), F.sum("value").alias("total"))
    return done.select(key, "n", "upto", "total").unionByName(part).groupBy(key).agg(F.sum("n").alias("n"), F.max("upto").alias("upto"), F.sum("total").alias("total"))


def replace_patients(table: DataFrame, fresh: DataFrame, affected: DataFrame) -> DataFrame:
    """All rows of the affected patients are replaced by the fresh ones."""
    return table.join(affected.select("patient_root").distinct(), "patient_root", "left_anti").unionByName(fresh)


def project_batch(folder: str, project: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, DataFrame, int], None]:
    """A projection for `project_stream`: the facts of all batches go to folder/facts, and the rows of the patients that a batch touches are derived again from all their facts and written as a
    new generation, folder/rows/NUMBER; the last one counts. A batch that is replayed writes its own folders again, so that it changes nothing."""

    def run(batch: DataFrame, affected: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/facts/batch={number}")
        facts = spark.read.parquet(f"{folder}/facts").where(F.col("batch") <= number).drop("batch")
        fresh = project(facts.join(affected, "patient_root", "left_semi"))
        old = spark.read.schema(fresh.schema).parquet(f"{folder}/rows/{number - 1}") if number else spark.createDataFrame([], fresh.schema)
        replace_patients(old, fresh, affected).write.mode("overwrite").parquet(f"{folder}/rows/{number}")

    return run


def project_stream(spark: SparkSession, folder: str, schema, checkpoint: str, project: Callable[[DataFrame, DataFrame, int], None]) -> StreamingQuery:
    """Calls project(batch, affected patients, batch number) for each micro-batch of facts that arrives in a folder; a batch may be
    replayed after a failure, so project must be idempotent for a batch number."""
    facts = spark.readStream.schema(schema).parquet(folder)

    def each(batch: DataFrame, number: int) -> None:
        project(batch, batch.select("patient_root").distinct(), number)

    return facts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_stream(store, folder: str, schema, checkpoint: str, name: str) -> StreamingQuery:
    """Appends the facts that arrive in a folder to a store (as `FactStore.append_facts` takes them), a commit a micro-batch, with the links, status and activity that follow from them. A
    batch that is sent again after a failure has its number in the store already, or left nothing there: either way its facts and what follows from them are there once."""
    facts = store.spark.readStream.schema(schema).parquet(folder)

    def each(batch: DataFrame, number: int) -> None:
        store.append_facts(batch, stream=name, batch=number)

    return facts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
