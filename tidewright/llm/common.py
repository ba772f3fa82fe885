"""What the operators share: tables, scratch columns, written intermediates, batch sizes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that become Python objects at a time: texts can be long.
BATCH_ROWS = 256
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the innermost scope of intermediates, and the scope around it.
_SCOPE: ContextVar[tuple | None] = ContextVar("scope", default=None)
#: In a Python worker: the operator whose memos it keeps, and how they are dropped.
_HOLDER: dict[str, Callable[[], None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a temporary one, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def _where(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def expire(spark: SparkSession, path: str) -> None:
    """What was written at path goes when the application ends."""
    store, at = _where(spark, path)
    store.deleteOnExit(at)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go at the end of the block, unless they were written to outlive it."""
    outer = _SCOPE.get()
    made: list[str] = []
    token = _SCOPE.set((made, outer))
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in made:
            store, at = _where(spark, path)
            store.delete(at, True)


@contextmanager
def action_settings(spark: SparkSession) -> Iterator[None]:
    """Settings of an action inside: short Arrow batches, and shuffle files go when it ends (what it wrote stands for them). The session's own come back."""
    wanted = {_RELEASE: "true", _BATCH: str(BATCH_ROWS)}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def written(df: DataFrame, what: str, outlive: bool = False) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut and survives lost executors.

    Its size is known to the optimizer, so later joins broadcast it only if it is small. It goes with
    the scope that it is written in (outlive: with the one around that), at the latest with the application.
    """
    spark = df.sparkSession
    path = scratch_path(spark, what)
    scope = _SCOPE.get()
    if outlive and scope:
        scope = scope[1]
    if scope:
        scope[0].append(path)
    else:
        expire(spark, path)
    with action_settings(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator, rows: int = BATCH_ROWS) -> Iterator:
    """Arrow arrays or record batches, cut into slices of at most `rows` rows."""
    for batch in batches:
        for i in range(0, len(batch) or 1, rows):
            yield batch.slice(i, rows)
    _give_back()


def _give_back() -> None:
    """What was freed in this process goes back to the system, for the executor's other processes."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def alone(owner: str, forget: Callable[[], None] = lambda: None) -> None:
    """Called where a task begins in a Python worker. Workers are reused: what another operator keeps in the process goes first."""
    if _HOLDER and owner not in _HOLDER:
        for drop in _HOLDER.values():
            drop()
        _HOLDER.clear()
        gc.collect()
        _give_back()
    _HOLDER[owner] = forget


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col(quoted(name))


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(*cols: Column) -> Column:
    """128 bits of the given columns' values; nulls differ from every text."""
    parts = [F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(c.cast("string")), F.lit(":"), c.cast("string"))) for c in cols]
    return F.unhex(F.md5(F.concat(*parts).cast("binary")))
