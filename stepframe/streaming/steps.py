"""The step loop driven by a stream of forcing rows, and windowed series from raw events."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stepframe.plans.runtime import cut


class StreamedRun:
    """Each micro-batch of forcing rows (t, variables) steps the state once for each t, in order.

    With ``folder`` (shared storage) the state is written there after every batch, under the batch's number. A restarted driver
    starts from the last that is whole, and a batch that is replayed steps nothing twice.
    """

    def __init__(self, state: DataFrame, step: Callable[[DataFrame, DataFrame, int], DataFrame], folder: str | None = None):
        self.state, self.step, self.done, self.folder, self.last = state, step, -1, folder, -1
        if folder:
            self._resume(state.sparkSession)

    def _resume(self, spark) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        for name in sorted((n for n in names if n.startswith("batch-")), key=lambda n: int(n.split("-")[1]), reverse=True):
            if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")):
                _, batch, done = name.split("-")
                self.state, self.last, self.done = spark.read.parquet(f"{self.folder}/{name}"), int(batch), int(done) - 1
                return

    def batch(self, forcing: DataFrame, number: int) -> None:
        if number <= self.last:
            return
        forcing = forcing.persist()
        try:
            for r in forcing.select("t").distinct().orderBy("t").toLocalIterator():
                if r.t > self.done:
                    self.state, self.done = cut(self.step(self.state, forcing, r.t)), r.t
        finally:
            forcing.unpersist()
        if self.folder:
            path = f"{self.folder}/batch-{number}-{self.done + 1}"
            self.state.write.mode("overwrite").parquet(path)
            self.state, self.last = self.state.sparkSession.read.parquet(path), number

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str, length: str, late: str, sums: Mapping[str, str], *keys: str) -> DataFrame:
    """Sums over tumbling windows of event time; rows later than ``late`` are left out once the watermark has passed."""
    source = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    out = source.groupBy(F.window(time, length), *keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return out.select(F.col("window.start").alias("start"), *keys, *sums)
