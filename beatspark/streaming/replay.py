"""Stored readings as a stream: what has arrived is taken in micro-batches until nothing is left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.stages import shared_dir


def arrivals(spark: SparkSession, path: str, sql: str, name: str) -> DataFrame:
    """The files below a path as a stream, through an input text that calls them `name`."""
    schema = spark.read.parquet(path).schema
    # a pattern, as a path without one has to be a folder for a stream
    spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").createOrReplaceTempView(name)
    return spark.sql(sql)


def finished(stream: DataFrame) -> DataFrame:
    """What a stream gives for all that is there now; its output and checkpoint lie in the shared directory."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/beatspark/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
