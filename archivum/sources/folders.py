"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below ``spark.checkpoint.dir``.

    Where nobody set it, a session on one machine gets a temporary folder; a cluster, whose machines
    share none, gets an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return f"{sc.getCheckpointDir()}/archivum-{uuid.uuid4().hex}"


def landed(lines: DataFrame) -> str:
    """The folder to which the lines (one text column) were written, compressed, in files of bounded numbers of lines."""
    path = shared_folder(lines.sparkSession)
    lines.write.option("compression", "snappy").option("maxRecordsPerFile", 100_000).text(path)
    return path


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, for frames that several others read."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
