"""Folders that streams and iterations keep their tables in, under the one that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; a session on one machine without the setting gets a temporary one, any other is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/seqloom/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """df, written once and read again."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a file that a stream is fed with.
A_FILE = 100_000


def feed(df: DataFrame, time: str, parts: int, label: str = "feed", files: int = 1) -> str:
    """The rows of df as a folder for a file stream: ``parts`` spans of equal length of its time column (a number), written one after the other as ``files``
    files each (empty ones where there are too few rows), so that a stream of so many files at a time gets them in order. Rows without a time come first."""
    path = folder(df.sparkSession, label)
    least, most = df.agg(F.min(time), F.max(time)).first()
    edges = [least + (most - least) * i / parts for i in range(1, parts)] if least is not None else []
    span = sum((F.when(F.col(time) > e, 1).otherwise(0) for e in edges), F.lit(0))
    written = 0
    for i in range(parts if edges else 1):
        rows = df.where(span == i)
        (rows.repartition(files) if files > 1 else rows.coalesce(1)).write.mode("append").parquet(path)
        if files > 1:
            there = len(df.sparkSession.read.schema(df.schema).parquet(path).inputFiles())
            for _ in range(written + files - there):
                df.where(F.lit(False)).coalesce(1).write.mode("append").parquet(path)
            written += files
    return path


def files_for(df: DataFrame, parts: int) -> int:
    """Files for each of ``parts`` spans of df, of about A_FILE rows in the mean."""
    return max(1, -(-df.count() // (parts * A_FILE)))
