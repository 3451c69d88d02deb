"""Resumable ingest of dropped JSON-line files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from annals.sources.files import RECORD, plan, with_flags


def stream_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the files in folder as a stream, with the flags that the batch reader gives."""
    rows = spark.readStream.schema(f"{RECORD}, line string").option("columnNameOfCorruptRecord", "line").json(folder)
    return with_flags(rows)


def ingest(spark: SparkSession, folder: str, table: str, failed: str, checkpoint: str, language: str | None = None, subject: str | None = None) -> StreamingQuery:
    """Append new snapshots to the Parquet folder ``table`` and what can't be used to ``failed``, then stop.

    The checkpoint remembers the files read, so a second call takes only new ones. A snapshot is new
    if no row of the table has its id and content hash, so a batch that is run again adds nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = plan(batch, language, subject).withColumn("content_hash", F.sha2(F.encode("text", "utf-8"), 256)).persist()
        try:
            keys = ["external_id", "content_hash"]
            good = rows.filter("plan = 'ingest'").drop("line", "broken", "usable", "plan").dropDuplicates(keys)
            have = _existing(batch.sparkSession, table)
            if have is not None:
                good = good.join(have.select(*keys), keys, "left_anti")
            good.write.mode("append").parquet(table)
            bad = rows.filter("plan <> 'ingest'").select("external_id", "line", "plan", F.lit(number).alias("batch"))
            # a batch that is run again replaces its own folder
            bad.write.mode("overwrite").parquet(f"{failed}/batch={number}")
        finally:
            rows.unpersist()

    stream = stream_records(spark, folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, if the folder is there; a table that can't be read is an error and no empty table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.parquet(path) if there else None
