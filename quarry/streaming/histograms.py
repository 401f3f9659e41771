"""Histograms that grow with a stream, and summaries taken from them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_histogram(events: DataFrame, time: str, value: str, window: str = "1 hour", late: str = "2 hours", width: float = 1.0) -> DataFrame:
    """(window, bin, n): counts of value bins in tumbling windows; rows later than the watermark are dropped by it."""
    v = F.col(value).cast("double")
    bins = F.floor(v / width).cast("long").alias("bin")
    return events.filter(v.isNotNull() & ~F.isnan(v)).withWatermark(time, late).groupBy(F.window(time, window), bins).agg(F.count(F.lit(1)).alias("n"))


def running_histogram(events: DataFrame, value: str, *band: str) -> DataFrame:
    """(band, value, n) over all rows so far; its state is the value domain."""
    v = F.col(value).cast("double")
    return events.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*band, v.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def append_unique(batch: DataFrame, path: str, key: str) -> int:
    """For foreachBatch: appends the rows whose key the table at `path` lacks; returns how many. The same batch twice adds nothing."""
    spark = batch.sparkSession
    new = batch.dropDuplicates([key])
    try:
        known = spark.read.parquet(path)
        new = new.join(known.select(key), key, "left_anti")
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
    new = new.persist()
    try:
        n = new.count()
        if n:
            new.write.mode("append").parquet(path)
        return n
    finally:
        new.unpersist()
