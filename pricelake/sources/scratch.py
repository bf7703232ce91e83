"""Tables in the folder that all executors share: cut lineage, and numbers of rows in a distributed order."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of a written table up to which its joins may broadcast it.
BROADCAST_ROWS = 200_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; on one machine without that setting, a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pricelake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back.

    A file of many alike rows is a hundredth of what they take in memory, so a table of more than BROADCAST_ROWS rows
    is kept from being broadcast by its file's size, which would gather it in the driver.
    """
    table, rows = _counted(df, name)
    return table if rows <= BROADCAST_ROWS else table.hint("merge")


def lookup(df: DataFrame, name: str) -> DataFrame:
    """As written, for narrow rows that others are looked up in: up to BROADCAST_ROWS rows are broadcast, however large the other side."""
    table, rows = _counted(df, name)
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table.hint("merge")


def _counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    path, rows = scratch_path(df.sparkSession, name), Observation()
    df.observe(rows, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), rows.get.get("rows", 0)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "__n") -> DataFrame:
    """df with the place of each row (from 1) among the rows of its keys, in an order without ties.

    Rows are sorted by ranges of keys and order, so a key with very many rows lies in many tasks; a row
    for each key and range then tells how many rows of the key come before.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(c) if isinstance(c, str) else c for c in (*keys, *order)]
    ordered = df.repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
    table = written(ordered.withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    sizes = table.groupBy(*keys, "__range").agg(F.count("*").alias("__rows"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    starts = lookup(starts.toDF(*(f"__k{i}" for i in range(len(keys))), "__r", "__first", "__before"), "starts")
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    place = (F.col("__at") - F.col("__first") + F.col("__before") + 1).cast("long")
    return table.join(starts, same).withColumn(name, place).select(*df.columns, name)
