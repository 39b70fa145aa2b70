"""Coverage rebuilt from what a warehouse's files hold, and what is wrong with them.

Files are known by their own path and the partition values in it. An instrument's rows in a file of
another bucket, or of an instrument nobody knows, are reported and count nowhere; an instrument whose
years have a hole between them, or whose bars all lie after the last completed day, has no coverage.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions import exprs
from barlake.sources.warehouse import DATASETS, Warehouse, time_column

OK = "ok"
COLUMNS = ["instrument_id", "dataset_key", "status", "first_date", "last_date", "n_rows"]


def judged(store: Warehouse, known: DataFrame, cap: date, datasets: tuple[str, ...] = tuple(DATASETS)) -> DataFrame:
    """(instrument_id, dataset_key, status, first_date, last_date, n_rows) of all published files.

    ``ok`` rows are the coverage: first day, and the last one or for intraday bars ``cap`` if that is earlier.
    Others name what is wrong: unknown_instrument, wrong_bucket (its rows in such files), disconnected_years,
    current_day_only. A dataset that doesn't exist has no rows.
    """
    out = store.spark.createDataFrame([], "instrument_id string, dataset_key string, status string, first_date date, last_date date, n_rows long")
    for dataset in datasets:
        if not store.exists(dataset):
            continue
        bars = store.pin([dataset]).read(dataset)
        day, path = F.col(time_column(bars)).cast("date"), F.col("_metadata.file_path")
        part = lambda name: F.nullif(F.regexp_extract(path, f"/{name}=([^/]+)/", 1), F.lit(""))  # noqa: B023, E731
        held = bars.select("instrument_id", day.alias("day"), part("bucket").alias("bucket"), part("year").cast("int").alias("year"))
        held = held.groupBy("instrument_id", "bucket", "year").agg(F.min("day").alias("first_date"), F.max("day").alias("last_date"), F.count("*").alias("n_rows"))
        held = held.join(known.select("instrument_id", F.lit(True).alias("known")).distinct(), "instrument_id", "left")
        fault = F.when(F.col("known").isNull(), "unknown_instrument").when(F.col("bucket") != exprs.bucket(), "wrong_bucket")
        # Faulty files of an instrument are one row beside that of its good ones.
        each = held.withColumn("fault", fault).groupBy("instrument_id", "fault").agg(
            F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.sum("n_rows").alias("n_rows"), F.countDistinct("year").alias("years"), (F.max("year") - F.min("year") + 1).alias("span")
        )
        last = F.col("last_date") if dataset == "eod" else F.least("last_date", F.lit(cap))
        own = F.when(F.col("years") < F.col("span"), "disconnected_years").when(F.col("first_date") > last, "current_day_only").otherwise(OK)
        status = F.coalesce("fault", own)
        rows = each.select("instrument_id", F.lit(dataset).alias("dataset_key"), status.alias("status"), "first_date", F.when(status == OK, last).otherwise(F.col("last_date")).alias("last_date"), "n_rows")
        out = out.unionByName(rows)
    return out


def replace_coverage(store: Warehouse, known: DataFrame, cap: date) -> DataFrame:
    """Make the ``ok`` rows the warehouse's coverage, in one new version; returns what is wrong with the others."""
    found = judged(store, known, cap).persist()
    try:
        store.put_metadata("coverage", found.filter(F.col("status") == OK).select("instrument_id", "dataset_key", "first_date", "last_date"))
        bad = [tuple(r) for r in found.filter(F.col("status") != OK).orderBy(*COLUMNS).limit(1000).collect()]  # a report to read; ``judged`` has them all
    finally:
        found.unpersist()
    return store.spark.createDataFrame(bad, found.schema)
