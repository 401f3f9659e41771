"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
#: Where each table of `materialize` lies.
_stored: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a folder of our own where it is unset and all runs on one machine."""
    global _own_dir
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: lineage is cut, and a lost executor loses nothing.

    The table goes when the driver's JVM ends, or earlier by `release`."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "snappy", **options}).parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    stored = spark.read.schema(df.schema).parquet(at)
    _stored[stored] = at
    return stored


def release(*tables: DataFrame | None) -> None:
    """Delete stored tables whose last reader has run; results that are still lazy must not need them."""
    for table in tables:
        at = _stored.pop(table, None) if table is not None else None
        if at:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
