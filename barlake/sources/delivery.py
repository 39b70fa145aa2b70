"""A vendor's CSV answers, read on executors: good rows in known columns, all others with the reason why not.

Answers are read line by line, so that files of any size and number are dealt among tasks. A file's
header is the line that holds exactly the expected names, in any order. Fields may be quoted, but hold no
line breaks.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAGGED, REPEATED, JSON, HEADLESS, UNREADABLE = "ragged_row", "repeated_header", "json_answer", "no_header", "unreadable_archive"
REJECTED = "file string, line string, reason string"


def lines_of(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, line) of text files; a byte-order mark and carriage returns go, blank lines too."""
    rows = spark.read.option("lineSep", "\n").text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return rows.withColumn("line", F.regexp_replace("line", "^\\x{FEFF}|\\r$", "")).filter("trim(line) <> ''")


def lines_of_archives(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, line) of the one CSV in each zip archive, an archive a task at a time; one that can't be read gives null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(*(batch.column(i) for i in range(2)), strict=True):
                name, lines = file.as_py(), []
                try:
                    with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
                        (member,) = [n for n in archive.namelist() if n.lower().endswith(".csv")]
                        with archive.open(member) as stream:
                            for line in io.TextIOWrapper(stream, encoding="utf-8-sig"):
                                if line.strip():
                                    lines.append(line.rstrip("\r\n"))
                                if len(lines) == 10_000:
                                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array(lines)], names=["file", "line"])
                                    lines = []
                except (zipfile.BadZipFile, ValueError):
                    lines = [None]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), pa.array(lines, pa.string())], names=["file", "line"])

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInArrow(read, "file string, line string")


def answers(lines: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of lines: the columns as text with the file, and (file, line, reason).

    A file without header is rejected whole: ``json_answer`` if a line of it opens as JSON, as a vendor's
    errors do, else ``no_header``. A row with another number of fields than the header is ``ragged_row``,
    a second header ``repeated_header``. Empty fields are null.
    """
    n = len(columns)
    schema = ", ".join([*(f"c{i} string" for i in range(n)), "bad string"])
    parsed = lines.withColumn("p", F.from_csv("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad", "quote": '"', "escape": '"'}))
    fields = F.array(*[F.col(f"p.c{i}") for i in range(n)])
    parsed = parsed.select("file", "line", F.col("p.bad").isNotNull().alias("ragged"), fields.alias("fields"))
    names = F.array_sort(F.lit(list(columns)))
    is_header = F.coalesce(~F.col("ragged") & (F.array_sort(F.transform("fields", lambda x: F.trim(x))) == names), F.lit(False))
    parsed = parsed.withColumn("is_header", is_header)
    files = parsed.groupBy("file").agg(
        F.first(F.when(F.col("is_header"), F.transform("fields", lambda x: F.trim(x))), ignorenulls=True).alias("header"), F.bool_or(F.col("line").isNull()).alias("unreadable"), F.bool_or(F.trim("line").rlike(r"^[\[{]")).alias("json")
    )
    placed = parsed.join(files, "file")
    reason = (
        F.when(F.col("unreadable"), UNREADABLE).when(F.col("header").isNull() & F.col("json"), JSON).when(F.col("header").isNull(), HEADLESS).when(F.col("ragged"), RAGGED)
    )
    placed = placed.withColumn("reason", reason)
    good = placed.filter("reason IS NULL AND NOT is_header")
    value = lambda c: F.nullif(F.get("fields", F.array_position("header", F.lit(c)).cast("int") - 1), F.lit(""))
    rows = good.select(*[value(c).alias(c) for c in columns], "file")
    # Of several headers of a file all but one are rejected.
    again = placed.filter("reason IS NULL AND is_header").groupBy("file", "line").agg(F.count("*").alias("n")).filter("n > 1")
    again = again.select("file", "line", F.explode(F.array_repeat(F.lit(REPEATED), (F.col("n") - 1).cast("int"))).alias("reason"))
    return rows, placed.filter("reason IS NOT NULL").select("file", "line", "reason").unionByName(again)
