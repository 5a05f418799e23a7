"""What the operators share: scratch tables in the shared folder, distributed prefix sums, checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a table that was counted may be broadcast.
BROADCAST_ROWS = 20_000
#: Rows of an Arrow batch.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, one of our own if the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared folder and reads it back: a cut in the lineage that lost executors do not undo."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_join(df: DataFrame, side: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """df joined with side: broadcast if side was counted at no more than `rows`, else a shuffle join, whose hot keys AQE splits."""
    side = table(side, "side")
    return df.join(F.broadcast(side) if side.count() <= rows else side, on, how)


def bounded_batches(spark: SparkSession) -> None:
    """Sessions that leave the rows of an Arrow batch at Spark's 10,000 get BATCH_ROWS: texts of some kilobytes each, in both processes, are most of what a task holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def text_of(column: Column | str) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def partitions_for(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)


def running_sum(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df with `out` = the sum of `value` over all rows before this one in `order`, without one task that sees all rows.

    Range partitions are sorted and written; each sums itself; the sums of the partitions before (one row a
    partition) are broadcast and the running sum goes on inside each partition.
    """
    spark = df.sparkSession
    held = table(
        df.repartitionByRange(partitions_for(df), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()),
        "ranges",
    )
    totals = held.groupBy("_part").agg(F.sum(value).alias("_sum"))
    # one row for each partition that has rows: as many as there are partitions at most
    before, acc = [], 0
    for part, total in sorted((r["_part"], r["_sum"]) for r in totals.collect()):
        before.append((part, acc))
        acc += total or 0
    base = spark.createDataFrame(before, "_part int, _base long")
    earlier = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.join(F.broadcast(base), "_part").withColumn(out, F.col("_base") + earlier).drop("_part", "_base")
