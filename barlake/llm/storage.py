"""Tables that cut lineage: written to the folder all executors share, then read back."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: set[str] = set()
_local: dict[str, str] = {}  # the temporary folder of each application on one machine
_scopes = threading.local()  # of each thread: the tables of what it is making now


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set and one machine runs all."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _local:
            _local[application] = "file://" + tempfile.mkdtemp(prefix="barlake-shared-")
        folder = _local[application]
    return folder.rstrip("/")


def durable(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a frame that reads it.

    The table is removed by ``discard``, by ``clear``, or at the end of the driver's process. ``tidy``
    has Spark remove the files of the write's own shuffles as soon as the table is there.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    if tidy:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if not _written:
        atexit.register(_at_exit)
    _written.add(path)
    for scope in getattr(_scopes, "open", [])[-1:]:
        scope.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def finished(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that ``make`` gives, written; what it wrote on the way is removed."""
    stack = _scopes.open = getattr(_scopes, "open", [])
    stack.append([])
    try:
        df = make()
        own, stack[-1] = stack[-1], []
        out = durable(df, name)
    finally:
        stack.pop()
    _remove(out.sparkSession, [path for path in own if path in _written])
    for scope in stack[-1:]:
        scope.append(out._durable_path)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``durable`` returned and that nothing reads any more."""
    for table in tables:
        _remove(table.sparkSession, [table._durable_path])


def clear(spark: SparkSession) -> None:
    """Remove all tables written so far; frames that still read them become unusable."""
    _remove(spark, list(_written))


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _written.discard(path)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            clear(spark)
        except Exception as problem:  # the session is going down; what is left is the folder owner's
            print(f"intermediate tables were left behind: {problem}")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shards(spark: SparkSession, rows: int = 0, rows_each: int = 1) -> int:
    """Number of hash shards: the session's shuffle partitions, more where rows would crowd them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))
