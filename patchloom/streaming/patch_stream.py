"""Patch files that keep arriving in a folder.

Parsing and analysis are row-local, so they run on a stream as they are, with
no state and no watermark.  The roll-up groups by change set, and a change set
never spans two micro-batches, so each micro-batch is rolled up by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from patchloom.plans.reports import render_diffs
from patchloom.sources.patch_files import PATH, decoded

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def read_patch_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """New patch files as rows ``path``, ``diff_text``."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE)
    reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder).select("path", decoded(F.col("content")).alias("diff_text"))


def start_report_stream(
    diffs: DataFrame, out: str, checkpoint: str, format_name: str = "plain", **trigger
) -> StreamingQuery:
    """Write the rendered reports of each micro-batch.

    Every batch replaces a folder of its own number, so a batch that runs again
    after a failure leaves its reports once.
    """

    def write(batch: DataFrame, number: int) -> None:
        reports = render_diffs(batch, format_name, keys=PATH)
        reports.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = diffs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True})).start()
