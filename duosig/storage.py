"""Tables in the folder that driver and executors share: what several later steps read is computed once, and plans stay short."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in the folder named by spark.checkpoint.dir, removed when the session's JVM ends; a local one only where all runs on one machine."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(root)
    path = f"{root}/store-{uuid.uuid4().hex}"
    jpath = context._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
