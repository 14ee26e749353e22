"""Tables in the folder that driver and executors share: cuts of a plan's lineage that outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names.

    Where it is unset, a temporary folder serves a session in one process (master `local`); any
    other session is refused, as its executors would write to disks of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="orgweave-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def written(df: DataFrame, name: str = "table", folder: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """df as a Parquet table in the shared folder, read back. by: columns that divide it, so that readers of few values read few files."""
    path = f"{folder or shared_dir(df.sparkSession) + '/orgweave'}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str, least: int = 1) -> DataFrame:
    """df's rows dealt by columns to all cores, `least` tasks or more: a small file is read by one task, however much is computed of each of its rows."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism, least)
    return df.repartition(tasks, *by)


class Scratch:
    """A folder of tables that are deleted together once what was made of them is written: `with Scratch(spark) as scratch`."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_dir(spark)}/orgweave/scratch-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, name: str = "table") -> DataFrame:
        return written(df, name, self.folder)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
