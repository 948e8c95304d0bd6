"""Intermediate tables in the folder that all executors share.

A lineage is cut by writing a table below ``spark.checkpoint.dir``; it survives the loss of any executor.
The setting is read from the session; only where it is unset (local tests) a folder of our own is made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, or in local runs without that setting a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back; the columns keep their names and types."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Deletes the tables that `materialize` wrote in this session. Call it once their readers are done."""
    for path in [p for p, s in _written.items() if s is spark]:
        discard(spark, path)
        del _written[path]


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s in _written.values()}.values():
        try:
            release(spark)
        except Exception:  # noqa: BLE001, S110 - the session may have ended already
            pass
