"""Incremental ingestion of board uploads with Structured Streaming.

The board is recomputed whenever a new workbook export lands.  Here each
upload is a file dropped into a folder; a file-source stream applies the
board cleaning (repeated header rows, numeric coercion, accident-free rows)
to new files only and appends the result to a parquet table, with
exactly-once bookkeeping in the stream's checkpoint.  The rate operators of
:mod:`vigia.operators.exposure` then run on that table as ordinary batch
queries.  ``availableNow`` processes everything present and stops, so the
same code serves scheduled runs and tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from vigia.operators.exposure import clean_exposure


def ingest_exposure(spark: SparkSession, source_dir: str, schema: StructType, sink_dir: str,
                    checkpoint: str, files_per_trigger: int | None = None,
                    keep_zero_incident_rows: bool = False) -> DataFrame:
    """Stream new exposure files from ``source_dir`` through the board
    cleaning into the parquet table at ``sink_dir``; returns the table."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = clean_exposure(reader.parquet(source_dir), keep_zero_incident_rows=keep_zero_incident_rows)
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True)
         .start(sink_dir))
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(stream.schema).parquet(sink_dir)
