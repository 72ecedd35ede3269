"""What the operators of this subpackage share: table access, durable intermediates, token rules."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one Arrow batch; a batch of the longest texts stays well under a worker's memory.
BATCH_ROWS = 512

#: Words between ASCII white space, as a Java regular expression.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir`, read by Spark alone (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for very long texts, and let Python workers find this package where the driver did.

    The size is lowered, never raised, and stays for the session: results are lazy, so a caller may run them at any later time.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def plus(df: DataFrame, **columns: str) -> StructType:
    """The schema of `df` with more columns, given as name=type."""
    more = StructType()
    for name, kind in columns.items():
        more = more.add(name, kind)
    return StructType([*df.schema.fields, *more.fields])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`; where that is unset, a temporary one, and only if all tasks run in this process's machine."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(spark.sparkContext, "_corvane_dir", None)
        if not found:
            found = tempfile.mkdtemp(prefix="corvane-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
            spark.sparkContext._corvane_dir = found
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation. The table goes with `release`, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote and nothing reads any more."""
    for t in tables:
        where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._corvane_path)
        where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it a table's shuffle files go as soon as it is written, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo `n`; a null id is in no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)
