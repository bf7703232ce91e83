"""Tables in folders of hash buckets: a batch of changes rewrites only the buckets that it touches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Buckets:
    """A Parquet table with a folder for each bucket of its key, in a folder that all executors share.

    Batches are numbered upwards and applied by one writer at a time. A bucket remembers the last batch that
    rewrote it in a row of its own, so a repeated batch changes nothing. What a batch writes is staged first: a
    writer that is lost before the staged rows are complete leaves the table as it was, and one lost later is
    made up for by the next call, which puts the staged rows in place again. A batch reads and writes the touched
    buckets only, so ``count`` should grow with the table (some 100 MB each); a bucket with a hot key is
    written as several files by the tasks that AQE splits it into.
    """

    spark: SparkSession
    path: str
    key: tuple[str, ...]
    count: int = 1024

    @property
    def staged(self) -> str:
        return f"{self.path}.staged"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.count)).cast("int")

    def _marks(self, batch: int) -> DataFrame:
        return self.spark.range(self.count).select(F.col("id").cast("int").alias("__bucket"), F.lit(batch).cast("long").alias("__batch"))

    def _with_marks(self, rows: DataFrame, marks: DataFrame) -> DataFrame:
        return rows.withColumn("__bucket", self._bucket()).withColumn("__batch", F.lit(None).cast("long")).unionByName(marks, allowMissingColumns=True)

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.staged)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _put(self) -> None:
        rows = self.spark.read.parquet(self.staged).hint("rebalance", "__bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(self.path)
        path, files = self._files()
        files.delete(path, True)

    def create(self, rows: DataFrame) -> None:
        """Writes a new table; it is an error if there is one."""
        self._with_marks(rows, self._marks(-1)).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(self.path)

    def recover(self) -> None:
        """Puts the rows of a batch in place whose writer was lost after they had been staged."""
        path, files = self._files()
        if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
            self._put()

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path).where("__batch IS NULL").drop("__batch", "__bucket")

    def rewrite(self, batch: int, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Applies change to the rows of the buckets in which keys of touched lie, and returns these buckets.

        change gets whole buckets and returns all rows that are to stay in them, new ones included. Buckets that
        saw this batch or a later one are left alone; a batch that touches nothing writes nothing.
        """
        self.recover()
        table = self.spark.read.parquet(self.path)
        # A hash depends on the type, so keys take the types of the table.
        keys = touched.select(*(F.col(k).cast(table.schema[k].dataType) for k in self.key))
        behind = table.where(F.col("__batch") < batch).select("__bucket")
        buckets = sorted(r[0] for r in keys.select(self._bucket().alias("__bucket")).distinct().join(behind, "__bucket", "left_semi").collect())
        if not buckets:
            return []
        inside = F.col("__bucket").isin(buckets)
        old = table.where(inside & F.col("__batch").isNull()).drop("__batch", "__bucket")
        new = change(old).select(*(F.col(f.name).cast(f.dataType) for f in old.schema))
        self._with_marks(new, self._marks(batch)).where(inside).write.mode("overwrite").parquet(self.staged)
        self._put()
        return buckets
