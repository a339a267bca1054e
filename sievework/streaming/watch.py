"""Watch mode: new rule hits in files as they land, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import classify
from sievework.functions.text import extension
from sievework.operators import findings
from sievework.plans import scan, snapshots
from sievework.sources import files as source
from sievework.sources.pack import Pack


def watch(spark: SparkSession, root: str, pack: Pack, out: str, checkpoint: str):
    """Match each file once when it appears below ``root`` and append its findings to ``out``; what has arrived is handled
    and the query ends. The source tracks paths, so a file changed in place needs a snapshot scan."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)

    @snapshots.scratched
    def each(batch: DataFrame, epoch: int) -> None:
        rows = source.hashed(batch.select(source.relative_path(root).alias("path"), F.col("length").alias("size"), "content"))
        rows = snapshots.cut(rows.withColumn("kind", classify.content_kind(classify.head_of(F.col("content")), extension(F.col("path")))))
        found = findings.assemble(scan.match(rows, pack)).withColumn("epoch", F.lit(epoch))
        found.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # the same epoch again writes the same place

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Watermarked counts and sums of an event stream by window and type."""
    return (
        events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )
