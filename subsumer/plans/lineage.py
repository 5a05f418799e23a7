"""Cuts in the lineage of iterative plans, in the folder that the cluster shares, and jobs that run side by side."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; where there is none, one of our own if the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


class _Writers:
    """Writes that are running, and the session's setting before the first of them."""

    lock, running, before = threading.Lock(), 0, "false"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind: a plan of many writes needs the disk of the largest one, not of all. Threads may do so side by side."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _Writers.lock:
        if not _Writers.running:
            _Writers.before = spark.conf.get(key, "false")
            spark.conf.set(key, "true")
        _Writers.running += 1
    try:
        yield
    finally:
        with _Writers.lock:
            _Writers.running -= 1
            if not _Writers.running:
                spark.conf.set(key, _Writers.before)


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    path = new_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, *jobs: Callable[[], T]) -> list[T]:
    """What the jobs return; each starts from a thread of its own, so that Spark runs one while it plans another."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


class Growing:
    """A set of rows that grows by written deltas, each read from its own files; every MOST_PATHS of them become one."""

    MOST_PATHS = 16

    def __init__(self, like: DataFrame, name: str) -> None:
        self.spark, self.schema, self.name, self.paths = like.sparkSession, like.schema, name, []

    def add(self, delta: DataFrame) -> DataFrame:
        if len(self.paths) >= self.MOST_PATHS:
            self.paths = [self._write(self.all())]
        path = self._write(delta)
        self.paths.append(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def _write(self, df: DataFrame) -> str:
        path = new_path(self.spark, self.name)
        with shuffles_removed(self.spark):
            df.write.parquet(path)
        return path

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths) if self.paths else self.spark.createDataFrame([], self.schema)


class Buckets:
    """A set of rows that grows by deltas, in a table bucketed by some columns: joins on these, or on more, leave it in place. Each delta is read back by its number."""

    def __init__(self, like: DataFrame, name: str, by: list[str], buckets: int) -> None:
        self.spark, self.schema, self.by, self.buckets = like.sparkSession, like.schema, by, buckets
        self.path, self.table = new_path(self.spark, name), f"{re.sub(r'[^a-z]', '_', name)}_{uuid.uuid4().hex}"
        self.deltas = self.rows = 0

    def add(self, delta: DataFrame) -> tuple[DataFrame, int]:
        """Adds the delta; it, as it stands in the table, and its number of rows."""
        return self._put(delta.repartition(self.buckets, *self.by))

    def merge(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """Adds the rows, which may repeat, that are not there yet; these, and their number. Rows are dealt once: what is known stays in place."""
        new = rows.repartition(self.buckets, *self.by).distinct()
        return self._put(new.join(self.all(), self.schema.fieldNames(), "left_anti") if self.deltas else new)

    def _put(self, dealt: DataFrame) -> tuple[DataFrame, int]:
        rows = dealt.select(*self.schema.fieldNames(), F.lit(self.deltas).alias("_delta"))
        with shuffles_removed(self.spark):
            rows.write.mode("append").bucketBy(self.buckets, *self.by).option("path", self.path).saveAsTable(self.table)
        own = self.spark.table(self.table).where(F.col("_delta") == self.deltas).drop("_delta")
        self.deltas += 1
        n = own.count()
        self.rows += n
        return own, n

    def all(self) -> DataFrame:
        return self.spark.table(self.table).drop("_delta") if self.deltas else self.spark.createDataFrame([], self.schema)

    def plain(self, least: int = 0) -> DataFrame:
        """The rows from delta number `least` on, read without the table."""
        if not self.deltas:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.parquet(self.path).where(F.col("_delta") >= least).select(*self.schema.fieldNames())

    def forget(self) -> None:
        """Takes the table out of the catalog; its files stay, and plain() with them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
