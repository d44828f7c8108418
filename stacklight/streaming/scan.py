"""Incremental scans: files that arrived since the last run become occurrences, and new contents become assets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from stacklight.functions import paths
from stacklight.sources.files import local_path

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arrivals(spark: SparkSession, root: str, suffixes: Sequence[str] = paths.IMAGE_SUFFIXES, per_batch: int = 1000) -> DataFrame:
    """A stream of source_path, asset_id, size, modified."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)
    fine = files.where(paths.suffix("path").isin(*suffixes))
    return fine.select(local_path("path").alias("source_path"), F.sha2("content", 256).alias("asset_id"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


class Counters(StreamingQueryListener):
    """Sums, over all batches, what streams observe under some names: progress without another pass."""

    def __init__(self):
        self.sums: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            own = self.sums.setdefault(name, {})
            for k, v in row.asDict().items():
                own[k] = own.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def scan(spark: SparkSession, root: str, out: str, checkpoint: str, suffixes: Sequence[str] = paths.IMAGE_SUFFIXES, per_batch: int = 1000) -> StreamingQuery:
    """Appends to out/occurrences and then to out/assets what is new; the query returned is the second one, which stops by itself.

    Contents are read once. Which assets are known is the state of a stream over the occurrences
    (a key for each asset, so a store on disk suits large libraries), not a join with
    all earlier assets; both sinks commit whole batches, so one that is repeated after a failure adds
    nothing. An asset has the path with which it was first seen.
    """
    found = arrivals(spark, root, suffixes, per_batch).observe("scan", F.count(F.lit(1)).alias("discovered"), F.sum("size").alias("bytes"))
    sink = lambda rows, name: rows.writeStream.format("parquet").option("path", f"{out}/{name}").option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True)
    sink(found, "occurrences").start().awaitTermination()
    known = spark.readStream.schema("source_path string, asset_id string, size bigint, modified timestamp").parquet(f"{out}/occurrences")
    fresh = known.dropDuplicates(["asset_id"]).observe("assets", F.count(F.lit(1)).alias("enqueued"))
    return sink(fresh, "assets").start()
