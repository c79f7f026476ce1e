"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a new local folder; on a cluster it is an
    error, since its machines do not share local folders.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="cotejo-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that is not used yet."""
    return f"{shared_folder(spark)}/cotejo-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Is there something at a path of any store that Spark knows?"""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read on from there.

    The rows survive the loss of executors and are computed once.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same by a Parquet table: smaller than a checkpoint, read by columns, and of known size."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
