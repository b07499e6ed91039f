"""Event counters as streams: watermarked windows, replayed from files, checkpointed in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stages


def _base(spark: SparkSession) -> str:
    return f"{stages.folder(spark)}/streams-{uuid.uuid4().hex}"


def counted(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by window and type; events later than ``late`` behind the newest are not counted. Works on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def hourly(spark: SparkSession, path: str) -> DataFrame:
    """All events of a table of files through a stream that ends when they are read; a second start would go on from the checkpoint."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).parquet(path) if _is_folder(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    base = _base(spark)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")  # a batch that is run again replaces itself

    events = source.withColumn("ts", F.col("ts").cast("timestamp"))
    q = counted(events).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    last = out.agg(F.max("epoch")).first()[0]
    return out.filter(F.col("epoch") == last).drop("epoch")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
