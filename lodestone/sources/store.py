"""Folders and written tables that outlive an executor."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """A new folder for a query's tables: in the shared folder the session names; without one, a local folder where all runs locally."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lodestone-")
    return f"{base}/{uuid.uuid4().hex}"


def durable(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, written once and read from there. The table stays until the owner of the shared folder clears it."""
    path = path or shared(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a written table (or file) is complete; asked of the file system that Spark uses."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers N of the complete tables path/number=N, in order."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(p):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("number=") and exists(spark, f"{path}/{n}/_SUCCESS"))
