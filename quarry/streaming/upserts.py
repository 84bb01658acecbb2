"""Resumable verification as streams (an extension): results upserted by key, and freshness by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def todo(targets: DataFrame, results: DataFrame, key: list[str], config: str) -> DataFrame:
    """Targets without a result under the present configuration."""
    return targets.join(results.where(F.col("config") == config), key, "left_anti")


def upsert(stream: DataFrame, path: str, key: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Keeps one row a key, the latest, as versions of a folder: batch n writes path/n from path/(n - 1). A batch that runs twice writes the same."""
    spark: SparkSession = stream.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        rows = batch
        if n:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/{n - 1}").unionByName(batch)
        latest(rows, key, order).write.mode("overwrite").parquet(f"{path}/{n}")
        # Batch n + 1 reads n, and n read n - 1 if it has to run again; older versions are of no use.
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, at: str, by: str, size: str, late: str) -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, size), by).agg(F.count("*").alias("n"))
