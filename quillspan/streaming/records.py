"""Record streams: the file sources on streaming tables, ending in one terminal row per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspan.sources.files import json_lines


def json_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Records of JSON-line files as they arrive, with their file and status."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path)
    return json_lines(lines.withColumn("source", F.col("_metadata.file_path")), schema)


def terminals(records: DataFrame, source: str = "source") -> DataFrame:
    """source, records, malformed and status of each source so far: ``partial`` once a record was malformed."""
    totals = records.where("status != 'blank'").groupBy(source).agg(F.count("*").alias("records"), F.count_if(F.col("status") == "malformed").alias("malformed"))
    return totals.withColumn("status", F.when(F.col("malformed") > 0, "partial").otherwise("complete"))


def run_to_memory(stream: DataFrame, name: str, mode: str) -> StreamingQuery:
    """Runs a stream over what is there and ends; its rows are in the in-memory table ``name``."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
