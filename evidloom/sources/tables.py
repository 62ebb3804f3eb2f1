"""Tables in the shared folder: lineage cuts that outlive an executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local master, whose executors are the driver, gets a temporary folder; a cluster is refused."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="evidloom-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its plan starts anew."""
    df.write.parquet(path := f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by cut()."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
