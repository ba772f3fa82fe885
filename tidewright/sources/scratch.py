"""Intermediate tables in the folder that driver and executors share: lineage ends there, and lost executors lose nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode, where none is set, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df as a table that is written now, read from then on, and goes with the application. Its columns are named by place in the files."""
    spark, names = df.sparkSession, df.columns
    kept = df.toDF(*[f"c{i}" for i in range(len(names))])
    # a column of nothing but nulls has no type that files know
    kept = kept.withColumns({f.name: F.col(f.name).cast("string") for f in kept.schema if isinstance(f.dataType, T.NullType)})
    path = new_path(spark, what)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    kept.write.parquet(path)
    return spark.read.schema(kept.schema).parquet(path).toDF(*names)
