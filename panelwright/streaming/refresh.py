"""Landing folder as a stream: each micro-batch of new files triggers one refresh.

The stream only says that something landed; which releases are new is decided against the ledger,
so a replayed batch finds nothing pending. Any case may be revised at any time, hence the batch
recompute and no watermark."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length long, content binary"


def landing_stream(spark: SparkSession, landing: str) -> DataFrame:
    """New files of the landing folder; their content is never read."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(landing)
    return files.select("path", "length", "modificationTime")


def refresh_stream(spark: SparkSession, landing: str, checkpoint: str, process: Callable[[], object], available_now: bool = True) -> StreamingQuery:
    """Run ``process`` once per micro-batch that holds new files."""

    def on_batch(files: DataFrame, batch: int) -> None:
        if files.take(1):
            process()

    writer = landing_stream(spark, landing).writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": "1 minute"}
    return writer.trigger(**trigger).start()
