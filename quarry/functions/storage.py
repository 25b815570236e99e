"""The folder that driver and executors share, and tables written to it to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own in local runs."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="quarry-")
    return _own_dir[app]


def keep(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df to the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what keep() wrote; for tables that no later plan reads."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._quarry_path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Grown:
    """A table that grows by appended parts, read as one folder: its plan does not grow."""

    def __init__(self, df: DataFrame, label: str):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        self.parts = 0
        self.last = self.add(df)

    def add(self, df: DataFrame) -> DataFrame:
        """Append df's rows; a reader of them alone."""
        part = f"{self.path}/part-{self.parts:05d}"
        self.parts += 1
        df.write.parquet(part)
        self.last = self.spark.read.schema(self.schema).parquet(part)
        return self.last

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)


SMALL_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores: its file may be one row group, which is one task's. Larger tables have tasks
    enough and stay as they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else df
