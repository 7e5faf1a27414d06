"""Incremental ingest of newly arrived files into a region store.

There are no windowed or stateful stream semantics to reproduce; what is useful is that stores grow by files. A file
stream is parsed with the batch readers' expressions and appended, exactly once, by the file sink's log.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.functions.columns import region_lengths
from seqloom.sources.sequences import read_fasta


def ingest_region_fasta(spark: SparkSession, inbox: str, store: str, checkpoint: str) -> StreamingQuery:
    """Append the records of region-marked FASTA files that arrive in inbox to the Parquet store: source_file, ord, name,
    regions, lens. Runs until what is there is read; call again, or restart after a loss, to continue."""
    files = spark.readStream.format("text").option("wholetext", True).load(inbox).select(F.col("_metadata.file_path").alias("source_file"), "value")
    records = read_fasta(files).select("source_file", "ord", "name", F.split(F.translate("seq", "-", ""), "\\*").alias("regions"))
    lens = records.withColumn("lens", region_lengths(F.col("regions")))
    return lens.writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
