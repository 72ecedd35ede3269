"""Intermediates that cut lineage: Parquet tables in the folder `spark.checkpoint.dir` names, gone when the application ends."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where that is unset, a temporary folder, and only if all tasks run on the driver's machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(spark.sparkContext, "_corvane_tables", None)
        if not found:
            found = tempfile.mkdtemp(prefix="corvane-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
            spark.sparkContext._corvane_tables = found
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, written once and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
