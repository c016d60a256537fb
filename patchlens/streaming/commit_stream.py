"""Incremental commit cleaning over a growing folder of commit files.

The batch path reads a bounded table; this is the same row-level work
(drop reasons, line counts, keyword flag, cleaned diff) applied to new
parquet files of *commit_raw* as they arrive.  All steps are stateless per
row, so no watermark or state store is needed; progress is kept in a
checkpoint under the shared folder, so a restarted query (or a lost
executor) resumes without loss or duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from patchlens.plans.commits import clean_commits
from patchlens.session import scratch_path

COMMIT_RAW_SCHEMA = T.StructType([
    T.StructField("commit_hash", T.StringType()),
    T.StructField("commit_message", T.StringType()),
    T.StructField("files_changed", T.IntegerType()),
    T.StructField("diff", T.StringType()),
])


def stream_clean_commits(spark: SparkSession, source_dir: str, sink_dir: str,
                         checkpoint: str | None = None, max_files: int = 100, once: bool = True):
    """Start the stream; returns the StreamingQuery."""
    src: DataFrame = (spark.readStream.schema(COMMIT_RAW_SCHEMA)
                      .option("maxFilesPerTrigger", max_files).parquet(source_dir))
    cleaned = clean_commits(src)
    w = (cleaned.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "commit-stream-ckpt"))
         .outputMode("append"))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")
    return w.start()
