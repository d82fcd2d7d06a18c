"""Shared storage for intermediate tables, and small helpers of the operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode a temporary one of this process, if none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="relforge-")
            atexit.register(shutil.rmtree, _OWN["dir"], True)
        where = _OWN["dir"]
    return f"{where.rstrip('/')}/{spark.sparkContext.applicationId}"


#: Bytes of one Arrow batch between the JVM and Python, in place of Spark's 64 MB: a batch is in memory several times.
BATCH_SETTING, BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "4m", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Have the session pass texts to Python in small batches, unless it has a size of its own set."""
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once no table that reads them is still to be computed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Written:
    """A table written to the shared folder: lineage ends here, and an executor's loss costs nothing that was written."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files, once no table that is still to be computed reads them."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo divisor; 0 counts for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % divisor, F.lit(0))
