"""Tables written between the stages of a long plan, so that a stage with several readers runs once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set; else a folder of its own for a local session, the warehouse on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local["):
            root = tempfile.mkdtemp(prefix="chaffsieve-")
            spark.conf.set("spark.checkpoint.dir", root)
        else:
            root = spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder as Parquet and read back; the files go when the driver ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
