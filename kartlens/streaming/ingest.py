"""S2 for files that keep arriving: incremental CSV -> parquet with Structured Streaming.

The analysis itself is batch only (no windows, watermarks or state), so
this is the single streaming piece: the bulk load run as a file stream.
Each run picks up the CSV files that landed in the folder since the last
run, checks them with the same strict reader settings as the batch load
(schema, header names, FAILFAST), appends them to the table's parquet
folder and records them in the query checkpoint, so a file is loaded
exactly once even when a run is retried after a failure.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from kartlens.sources.csv_load import OPTIONS, TEXT_TABLES
from kartlens.sources.schemas import TABLES


def start_csv_ingest(
    spark: SparkSession,
    in_folder: str,
    table: str,
    out_path: str,
    checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the file stream for one table. With ``available_now`` the query
    loads every file present now (in bounded micro-batches) and stops;
    otherwise it keeps polling the folder."""
    schema, _ = TABLES[table]
    reader = spark.readStream.schema(schema).options(**OPTIONS)
    if table in TEXT_TABLES:
        reader = reader.option("multiLine", "true")
    stream = reader.csv(in_folder)
    location = checkpoint or f"{out_path.rstrip('/')}_progress"
    writer = (
        stream.writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", location)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def ingest_available(spark: SparkSession, in_folder: str, table: str, out_path: str, checkpoint: str | None = None) -> None:
    """Load the files that arrived since the last run, then return."""
    query = start_csv_ingest(spark, in_folder, table, out_path, checkpoint, available_now=True)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
