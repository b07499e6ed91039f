"""Stage tables that are written batch by batch: a batch replaces the items that it names, a batch written again changes nothing, and readers see whole batches alone.

Rows lie in partitions ``batch=N``. A batch is first written to its own partition, by dynamic partition overwrite, so that a try that broke off is replaced, and then
named in the list of commits, again in a partition of its own. Readers take the partitions that are named there, and of every item its latest batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.utils import AnalysisException


class Store:
    """A table at ``path`` with rows of ``schema``; ``key`` names an item."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: list[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _write(self, rows: DataFrame, part: str) -> None:
        rows.write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/{part}")

    def _commits(self) -> DataFrame:
        try:
            return self.spark.read.schema("rows long, batch long").parquet(f"{self.path}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "rows long, batch long")

    def _put(self, rows: DataFrame, batch: int, gone: Column) -> None:
        if self._commits().filter(F.col("batch") == batch).isEmpty():  # else a replay
            whole = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields], gone.alias("gone"), F.lit(batch).cast("long").alias("batch"))
            self._write(whole, "rows")
            count = self.spark.read.schema(StructType([*self.schema.fields])).parquet(f"{self.path}/rows/batch={batch}").agg(F.count("*").alias("rows")) if not whole.isEmpty() else self.spark.createDataFrame([(0,)], "rows long")
            self._write(count.withColumn("batch", F.lit(batch).cast("long")), "commits")

    def put(self, rows: DataFrame, batch: int) -> None:
        """Writes items; an item that is there already is replaced. Of an item that the batch names twice the reader takes one. A batch number that is committed is not written again."""
        self._put(rows, batch, F.lit(False))

    def remove(self, keys: DataFrame, batch: int) -> None:
        """Takes the items named in ``keys`` away, as a batch of its own."""
        have = set(keys.columns)
        self._put(keys.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]), batch, F.lit(True))

    def read(self) -> DataFrame:
        """Every item as its latest committed batch left it."""
        commits = self._commits().select("batch").distinct()
        schema = StructType([*self.schema.fields, *StructType.fromDDL("gone boolean").fields, StructField("batch", LongType())])
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/rows")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)
        seen = rows.join(commits, "batch", "left_semi")
        others = [f.name for f in self.schema.fields if f.name not in self.key]
        order = Window.partitionBy(*self.key).orderBy(F.desc("batch"), *others)
        latest = seen.withColumn("_n", F.row_number().over(order)).filter("_n = 1 and not gone")
        return latest.select(*[f.name for f in self.schema.fields])
