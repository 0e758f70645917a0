"""The coalescing queue and its cadence over streams: micro-batches merged into a written state table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.lifecycle import coalesced, merge_queue

QUEUE = "source_key string, first_detected_at timestamp, detected_at timestamp, coalesced_count long, operation_id long, state string, attempts int, error string"


class QueueSink:
    """Merges each micro-batch of detections(source_key, detected_at, operation_id) into the queue at a path.

    A batch is coalesced by key before it meets the state. Every version is written beside the last and named by the
    batch, so a batch that is run again after a failure writes the same version from the same one before it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def version(self, batch: int) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], QUEUE)
        return self.spark.read.schema(QUEUE).parquet(f"{self.path}/v{batch}")

    def merge(self, detections: DataFrame, batch: int) -> None:
        merge_queue(self.version(batch - 1), coalesced(detections)).write.mode("overwrite").parquet(f"{self.path}/v{batch}")
        self._drop(batch - 2)  # a batch that runs again needs the version before it, not older ones

    def _drop(self, batch: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{batch}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def start(self, detections: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return detections.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
