"""Where a plan has to be cut: one copy of rows that all later branches read."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; an own one only where it is unset and Spark runs in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-seqlab-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Data frames that are made and run inside leave none of their shuffle files behind."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def pinned(df: DataFrame) -> DataFrame:
    """A checkpoint of df in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    with released(df.sparkSession):
        return df.select("*").checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As pinned(), in columns and compressed: for large tables, which a checkpoint would hold as plain rows."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/seqlab-rows-{uuid.uuid4().hex}"
    with released(spark):
        df.select("*").write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
