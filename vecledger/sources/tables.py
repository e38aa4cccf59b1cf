"""Reading input tables and writing intermediate tables that outlive an executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, from spark.checkpoint.dir.

    Only a local-mode session without that setting gets a folder of its own; on a
    cluster a machine-local folder would lose data, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="vecledger-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    This cuts the lineage like checkpoint(), but compressed and columnar, and lost
    executors cost nothing. The table is removed by freed() or when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vecledger-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    schema = df.schema
    writer.parquet(path)
    _written.append(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever file system it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def freed(spark: SparkSession) -> None:
    """Delete the intermediate tables of this process; results that read them must be used up."""
    while _written:
        removed(spark, _written.pop())


def _drop(spark: SparkSession, path: str) -> None:
    try:
        if path in _written:
            _written.remove(path)
            removed(spark, path)
    except Exception:  # the session is gone already
        pass
