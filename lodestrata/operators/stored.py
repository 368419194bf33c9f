"""Tables that are used more than once, written and read back.

Spark would make such a relation again for each use, and a lost executor would make it again with all that
comes before. The folder is that of spark.checkpoint.dir, which driver and executors share; a local session
without one gets a temporary folder. What is written stays there as checkpoints do."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written once as Parquet."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/lodestrata/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
