"""Files through Spark's own file systems, so that any store it reads will do."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def path_of(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    return path_of(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def rename(spark: SparkSession, source, target, overwrite: bool) -> bool:
    """Rename in one step; without ``overwrite`` False where the target is there already."""
    jvm = spark._jvm
    option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE if overwrite else option.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(context.makeQualified(source), context.makeQualified(target), options)
    except Exception as problem:
        if "FileAlreadyExistsException" in str(problem):
            return False
        raise
    return True


def read_text(spark: SparkSession, path: str) -> str:
    stream = file_system(spark, path).open(path_of(spark, path))
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a whole file that is not there yet, or nothing: False if another writer was first."""
    fs, target = file_system(spark, path), path_of(spark, path)
    beside = path_of(spark, f"{path}.{spark._jvm.java.util.UUID.randomUUID()}.tmp")
    out = fs.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    done = rename(spark, beside, target, overwrite=False)
    if not done:
        fs.delete(beside, False)
    return done


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; nothing if it is not there."""
    fs, at = file_system(spark, path), path_of(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    file_system(spark, path).delete(path_of(spark, path), True)


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or a pattern names anything."""
    found = file_system(spark, pattern).globStatus(path_of(spark, pattern))
    return found is not None and len(found) > 0


def parquet_files(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, str]]:
    """(path given, file) of every Parquet file in the folders or at the paths, from their listing."""
    out = []
    for path in paths:
        fs, root = file_system(spark, path), path_of(spark, path)
        found = fs.listFiles(root, True) if fs.exists(root) else None
        while found is not None and found.hasNext():
            at = found.next().getPath()
            if at.getName().endswith(".parquet"):
                out.append((path, at.toString()))
    return out


FOOTER = "folder string, file string, row_group int, n_rows long, n_bytes long, column string, least string, most string, nulls long"


def footers(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """Row groups of the Parquet files in folders: rows, bytes, and of each named column the bounds and nulls.

    Tasks read the footers, one file a row; the driver lists names. A file without row groups gives a row
    with none. Without columns a row group is one row.
    """
    wanted = list(columns)
    listed = spark.createDataFrame(parquet_files(spark, paths), "folder string, file string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in FOOTER.split(", ")]
        for batch in batches:
            rows = [row for folder, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in _groups(folder, file, wanted)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)

    return listed.repartition("file").mapInArrow(read, FOOTER)


def _groups(folder: str, file: str, columns: Sequence[str]) -> Iterator[tuple]:
    """Rows of ``footers`` of one file."""
    store, path = pa_fs.FileSystem.from_uri(file)
    with store.open_input_file(path) as source:
        footer = pq.ParquetFile(source).metadata
        place = {footer.schema.column(i).path: i for i in range(footer.num_columns)}
        if not footer.num_row_groups:
            yield folder, file, None, 0, 0, None, None, None, None
        for i in range(footer.num_row_groups):
            group = footer.row_group(i)
            for name in columns or [None]:
                stats = group.column(place[name]).statistics if name in place else None
                held = stats is not None and stats.has_min_max
                yield folder, file, i, group.num_rows, group.total_byte_size, name, str(stats.min) if held else None, str(stats.max) if held else None, stats.null_count if stats is not None else None


def footer_counts(spark: SparkSession, folders: Sequence[str]) -> dict[str, int]:
    """Rows in each folder's Parquet files by their footers."""
    return {r.folder: int(r.n) for r in footers(spark, folders).groupBy("folder").agg(F.sum("n_rows").alias("n")).collect()}
