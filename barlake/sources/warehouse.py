"""The bar warehouse on Parquet: buckets by id hash, loaders that fail closed, publishing by manifest.

A dataset is split by bucket, intraday ones by year and bucket. A publication of one or several
relations, bars and metadata alike, writes the buckets it touches to folders of its own, then one
numbered manifest that says for all relations where their rows are. The manifest's file appears in
one step and only once for each number: readers see all of a publication or nothing of it, and a
failed one leaves the old rows. Of two writers of one relation one fails; writers of different ones
follow one another. Reads take only the folders that ids and dates select, with an explicit schema.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import uuid
import zipfile
from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.functions import calendar, exprs
from barlake.operators import identity, ingest
from barlake.sources import files

DATASETS = {"eod": ingest.EOD_SCHEMA, "intraday_1hour": ingest.INTRADAY_SCHEMA, "intraday_5min": ingest.INTRADAY_SCHEMA}

BUCKET_BYTES = 256 << 20  # of a layout's bucket, before compression


class SelectorError(ValueError):
    """A selection names something the warehouse cannot resolve."""


class ConflictError(RuntimeError):
    """Another publication of the dataset came first."""


def bucket_of(instrument: str) -> str:
    return hashlib.sha256(instrument.encode()).hexdigest()[:2]


class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, dataset: str) -> str:
        return f"{self.root}/{dataset}"

    def _last(self) -> tuple[int, dict[str, dict]]:
        """(number, manifest) of the last publication; 0 and empty relations before the first."""
        numbers = self.publications()
        return (numbers[-1], self._manifest(numbers[-1])) if numbers else (0, {"datasets": {}, "metadata": {}, "layouts": {}})

    def _manifest(self, number: int) -> dict[str, dict]:
        """Where a publication's rows are: of each dataset a folder by partition and its layout, of each metadata relation a folder."""
        if number not in self.publications():
            raise SelectorError(f"no publication {number}")
        return json.loads(files.read_text(self.spark, f"{self.root}/_manifests/{number}.json"))

    def publications(self) -> list[int]:
        """The numbers of the publications that can be read, the last one at the end."""
        return sorted(int(n.removesuffix(".json")) for n in files.names(self.spark, f"{self.root}/_manifests") if n.endswith(".json"))

    def exists(self, dataset: str) -> bool:
        return dataset in self._last()[1]["datasets"]

    def _selected(self, dataset: str, partitions: Mapping[str, str], ids: Sequence[str] | None, start: str | None, end: str | None) -> list[str]:
        """Folders of the partitions that may hold rows of the ids and dates."""
        buckets = None if ids is None else {bucket_of(i) for i in ids}
        out = []
        for name, folder in sorted(partitions.items()):
            part = dict(p.split("=") for p in name.split("/"))
            if buckets is not None and part["bucket"] not in buckets:
                continue
            if "year" in part and ((start and part["year"] < start[:4]) or (end and part["year"] > end[:4])):
                continue
            out.append(f"{self.path(dataset)}/{folder}/{name}")
        return out

    def _read_folders(self, dataset: str, folders: Sequence[str]) -> DataFrame:
        schema = DATASETS[dataset]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, dataset: str, ids: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """A dataset in canonical columns; ids and dates choose the folders, so that others are not read."""
        return self._read_at(dataset, self._last()[1]["datasets"].get(dataset, {}), ids, start, end)

    def _read_at(self, dataset: str, partitions: Mapping[str, str], ids: Sequence[str] | None, start: str | None, end: str | None) -> DataFrame:
        df = self._read_folders(dataset, self._selected(dataset, partitions, ids, start, end))
        if ids is not None:
            df = df.filter(F.col("instrument_id").isin(list(ids)))
        return in_range(df, start, end)

    def pin(self, datasets: Sequence[str] | None = None, metadata: Sequence[str] | None = None, number: int | None = None) -> Snapshot:
        """Relations as of one publication, the last or the given one, for reads that later ones don't change.

        Without names, all that the publication holds; a dataset not yet published is empty.
        """
        if number is None:
            number, held = self._last()
        else:
            held = self._manifest(number)
        partitions = {d: held["datasets"].get(d, {}) for d in (held["datasets"] if datasets is None else datasets)}
        missing = [m for m in metadata or () if m not in held["metadata"]]
        if missing:
            raise SelectorError(f"no metadata relation {', '.join(missing)}")
        versions = {m: f"{self.root}/meta/{held['metadata'][m]}" for m in (held["metadata"] if metadata is None else metadata)}
        return Snapshot(self, number, partitions, versions, {d: held["layouts"][d] for d in partitions if d in held["layouts"]})

    def read_files(self, paths: Sequence[str], dataset: str = "eod") -> DataFrame:
        """Exactly the given files."""
        return self.spark.read.schema(DATASETS[dataset]).parquet(*paths)

    def register_views(self, number: int | None = None) -> list[str]:
        """A temporary view for each dataset that exists, and ``meta_<name>`` for each metadata relation, all of one publication."""
        held = self.pin(number=number)
        names = [d for d in DATASETS if d in held.partitions]
        for d in names:
            held.read(d).createOrReplaceTempView(d)
        for name in sorted(held.versions):
            held.metadata(name).createOrReplaceTempView(f"meta_{name}")
            names.append(f"meta_{name}")
        return names

    def metadata_names(self) -> list[str]:
        return sorted(self._last()[1]["metadata"])

    def put_metadata(self, name: str, rows: DataFrame) -> None:
        """Replace a metadata relation (aliases, coverage, universes, ...)."""
        self.commit(metadata={name: rows})

    def metadata(self, name: str) -> DataFrame:
        """A metadata relation as last published."""
        return self.pin([], [name]).metadata(name)

    def register_frame(self, name: str, rows: Sequence[tuple], schema: str) -> DataFrame:
        """A view of rows in the driver's memory, for lists that a query joins."""
        df = self.spark.createDataFrame(list(rows), schema)
        df.createOrReplaceTempView(name)
        return df

    def sql(self, text: str, **args) -> DataFrame:
        self.register_views()
        return self.spark.sql(text, args=args or None)

    def validated(self, dataset: str, ids: Sequence[str]) -> list[str]:
        """Selected ids; blank or unknown ones are an error."""
        if any(not i or not i.strip() for i in ids):
            raise SelectorError("an instrument id is blank")
        ids = list(dict.fromkeys(ids))
        wanted = self.spark.createDataFrame([(i,) for i in ids], "instrument_id string")
        unknown = [r[0] for r in wanted.join(self.read(dataset, ids).select("instrument_id").distinct(), "instrument_id", "left_anti").collect()]
        if unknown:
            raise SelectorError(f"unknown instruments: {sorted(unknown)}")
        return ids

    def load(self, dataset: str, ids: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """Bars of the ids between inclusive UTC dates, in key order; no ids give an empty frame."""
        if ids is not None and not list(ids):
            return self.spark.createDataFrame([], DATASETS[dataset])
        df = self.read(dataset, self.validated(dataset, ids) if ids is not None else None, start, end)
        return df.orderBy("instrument_id", time_column(df))

    def load_sessions(self, dataset: str, ids: Sequence[str] | None, start, end) -> DataFrame:
        bars = self.load(dataset, ids, str(start), str(end))
        return calendar.label_sessions(bars, calendar.session_schedule(self.spark, start, end), dataset.removeprefix("intraday_"))

    def load_by_ticker(self, dataset: str, tickers: Sequence[str], aliases: DataFrame, start: str, end: str) -> DataFrame:
        """Bars by what a ticker meant each day; any day with no owner or several is an error."""
        names = list(dict.fromkeys(t.strip().upper() for t in tickers))
        segments = identity.alias_segments(aliases.filter(F.col("ticker").isin(names)), start, end)
        states = {r.ticker: r.bad for r in segments.groupBy("ticker").agg(F.count_if(F.col("status") != "resolved").alias("bad")).collect()}
        bad = [t for t in names if states.get(t, 1)]
        if bad:
            raise SelectorError(f"tickers that do not resolve over the whole span: {bad}")
        return by_segments(self.read(dataset, start=start, end=end), segments)

    def publish(self, dataset: str, incoming: DataFrame, replace_instruments: bool = False) -> None:
        """Merge rows into the buckets they touch, or replace all their instruments had, in one step."""
        self.commit({dataset: incoming}, replace_instruments=replace_instruments)

    def commit(self, datasets: Mapping[str, DataFrame] | None = None, metadata: Mapping[str, DataFrame] | None = None, replace_instruments: bool = False) -> int:
        """Publish rows of several datasets and new versions of metadata relations together; returns the publication's number.

        A fault in any of them leaves all as they were. If another writer published meanwhile, this
        publication follows it, unless both touch one relation: then it fails. What a failed one has
        written is named by no manifest and goes with ``vacuum``.
        """
        number, base = self._last()
        own = uuid.uuid4().hex
        new: dict[str, dict] = {"datasets": {}, "metadata": {}, "layouts": dict.fromkeys(datasets or {})}  # a layout holds what it was made of
        for dataset, incoming in (datasets or {}).items():
            new["datasets"][dataset] = self._merged(dataset, incoming, base["datasets"].get(dataset, {}), own, replace_instruments)
        for name, rows in (metadata or {}).items():
            new["metadata"][name] = f"{name}/{own}"
            rows.write.parquet(f"{self.root}/meta/{name}/{own}")
        return self._numbered(number, base, new)

    def _numbered(self, number: int, base: dict[str, dict], new: dict[str, dict]) -> int:
        """Write the manifest that follows ``base`` with the new relations in it; None takes one out."""
        while True:
            now = {kind: {name: at for name, at in (base[kind] | new[kind]).items() if at is not None} for kind in new}
            if files.write_new(self.spark, f"{self.root}/_manifests/{number + 1}.json", json.dumps(now, sort_keys=True)):
                return number + 1
            number, held = self._last()
            both = [name for kind in new for name in new[kind] if held[kind].get(name) != base[kind].get(name)]
            if both:
                raise ConflictError(f"{', '.join(both)}: published by another writer meanwhile")
            base = held

    def _merged(self, dataset: str, incoming: DataFrame, partitions: Mapping[str, str], own: str, replace_instruments: bool) -> dict[str, str]:
        """Write the buckets that rows touch, merged with what they hold, to a folder of their own; the folder of each partition then."""
        schema = DATASETS[dataset]
        key = ["instrument_id", "date" if dataset == "eod" else "ts"]
        parts = ["bucket"] if dataset == "eod" else ["year", "bucket"]
        staged = f"{self.root}/.staging-{own}-{dataset}"
        try:
            # Written once: it is read for its faults, for the buckets it touches, and for the merge.
            located(ingest.canonical(incoming, schema), parts).write.parquet(staged)
            rows = self.spark.read.schema(located(self.spark.createDataFrame([], schema), parts).schema).parquet(staged)
            counts = ingest.repeated_keys(rows, key).first()
            # Whole rows are compared only where keys repeat.
            conflicting = ingest.duplicate_conflicts(rows.select(schema.names), key).first().conflicting_keys if counts.repeated_keys else 0
            if conflicting or counts.null_keys:
                raise ValueError(f"{conflicting} keys conflict and {counts.null_keys} are null")
            touched = {"/".join(f"{p}={r[p]}" for p in parts) for r in rows.select(*parts).distinct().collect()}  # at most 256 a year
            if replace_instruments:
                buckets = {name.split("bucket=")[1] for name in touched}
                touched |= {name for name in partitions if name.split("bucket=")[1] in buckets}
            held = {name: folder for name, folder in partitions.items() if name in touched}
            stored = self._read_folders(dataset, self._selected(dataset, held, None, None, None))
            fresh = rows.select(schema.names).distinct() if counts.repeated_keys else rows.select(schema.names)
            if not held:
                merged = fresh  # nothing to merge with
            else:
                merged = ingest.snapshot_replace(stored, fresh) if replace_instruments else ingest.merge_upsert(stored, fresh, key)
            merged = located(merged, parts)
            # Rebalancing splits a bucket that outgrows a task and joins small ones.
            folder = f"data-{own}"
            merged.hint("rebalance", *parts).sortWithinPartitions(*parts, *key).write.partitionBy(*parts).option("compression", "zstd").parquet(f"{self.path(dataset)}/{folder}")
            written = set(self._partitions(f"{self.path(dataset)}/{folder}", len(parts)))
            return {name: at for name, at in partitions.items() if name not in touched} | dict.fromkeys(written, folder)
        finally:
            files.remove(self.spark, staged)

    def colocate(self, dataset: str, buckets: int | None = None) -> int:
        """Add to a dataset a copy in buckets of ``instrument_id`` that Spark's plans know; returns the publication's number.

        Windows, aggregates and joins by instrument over ``Snapshot.colocated`` move no bars. The next
        publication of the dataset ends the layout. Without ``buckets`` there is a power of two, so that two
        layouts' buckets fit into one another, of some ``BUCKET_BYTES`` each.
        """
        number, base = self._last()
        if dataset not in base["datasets"]:
            raise SelectorError(f"{dataset} was not published")
        bars = self._read_at(dataset, base["datasets"][dataset], None, None, None)
        if buckets is None:
            size = files.footers(self.spark, self._selected(dataset, base["datasets"][dataset], None, None, None)).agg(F.sum("n_bytes").alias("n")).first().n
            buckets = 1 << max(0, -(-(size or 0) // BUCKET_BYTES) - 1).bit_length()
        layout = {"folder": f"layout-{uuid.uuid4().hex}", "buckets": buckets}
        by = ["instrument_id", time_column(bars)]
        # One task a bucket, so that a bucket is one sorted file.
        write = bars.repartition(buckets, "instrument_id").write.bucketBy(buckets, "instrument_id").sortBy(*by)
        write.option("path", f"{self.path(dataset)}/{layout['folder']}").option("compression", "zstd").saveAsTable(_table(layout))
        # The dataset stands among what is new, unchanged: rows published meanwhile make the layout fail.
        return self._numbered(number, base, {"datasets": {dataset: base["datasets"][dataset]}, "metadata": {}, "layouts": {dataset: layout}})

    def _partitions(self, folder: str, depth: int) -> list[str]:
        own = [n for n in files.names(self.spark, folder) if "=" in n]
        return own if depth == 1 else [f"{n}/{m}" for n in own for m in self._partitions(f"{folder}/{n}", depth - 1)]

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove all but the last ``keep`` manifests and the folders that these don't name.

        Readers must be done with what goes, and no writer may be at work.
        """
        if keep < 1:
            raise ValueError("the last publication stays")
        numbers = self.publications()
        kept = [self._manifest(n) for n in numbers[-keep:]]
        stale = [f"_manifests/{n}.json" for n in numbers[:-keep]]
        for dataset in DATASETS:
            named = {folder for m in kept for folder in m["datasets"].get(dataset, {}).values()} | {m["layouts"][dataset]["folder"] for m in kept if dataset in m["layouts"]}
            gone = [n for n in files.names(self.spark, self.path(dataset)) if n.startswith(("data-", "layout-")) and n not in named]
            stale += [f"{dataset}/{n}" for n in gone]
            for name in gone:
                if name.startswith("layout-"):
                    self.spark.sql(f"DROP TABLE IF EXISTS {_table({'folder': name})}")
        named = {folder for m in kept for folder in m["metadata"].values()}
        for name in files.names(self.spark, f"{self.root}/meta"):
            stale += [f"meta/{name}/{n}" for n in files.names(self.spark, f"{self.root}/meta/{name}") if f"{name}/{n}" not in named]
        for name in stale:
            files.remove(self.spark, f"{self.root}/{name}")
        return stale

    def quarantine(self, rows: DataFrame, run: str, reason: str | None = None) -> None:
        """Set rows aside under the run that found them; a repetition of the run replaces what it had set aside.

        ``reason`` stands for a column quarantine_reason that the rows don't have.
        """
        if not run or any(c in run for c in "/=\\"):
            raise ValueError(f"a run's name is part of a path: {run!r}")
        rows = rows.withColumn("quarantine_reason", F.lit(reason)) if reason is not None else rows
        rows.write.mode("overwrite").parquet(f"{self.root}/quarantine/run={run}")

    def quarantined(self) -> DataFrame:
        """All rows set aside, with their run."""
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/quarantine")


class Snapshot:
    """Datasets and metadata relations of one publication."""

    def __init__(self, store: Warehouse, number: int, partitions: Mapping[str, Mapping[str, str]], versions: Mapping[str, str], layouts: Mapping[str, Mapping]):
        self.store, self.spark, self.number, self.partitions, self.versions, self.layouts = store, store.spark, number, dict(partitions), dict(versions), dict(layouts)

    def read(self, dataset: str, ids: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """As ``Warehouse.read``, of the pinned publication."""
        return self.store._read_at(dataset, self.partitions[dataset], ids, start, end)

    def metadata(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.versions[name])

    def colocated(self, dataset: str) -> DataFrame:
        """The dataset's bars from its layout, whose buckets Spark knows; without one an error."""
        if dataset not in self.layouts:
            raise SelectorError(f"{dataset} has no layout of this publication")
        layout, schema = self.layouts[dataset], DATASETS[dataset]
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        by = f"CLUSTERED BY (instrument_id) SORTED BY (instrument_id, {schema.names[1]}) INTO {int(layout['buckets'])} BUCKETS"
        # The table of a catalog that another session wrote with is made known to this one.
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {_table(layout)} ({columns}) USING parquet {by} LOCATION '{self.store.path(dataset)}/{layout['folder']}'")
        return self.spark.table(_table(layout))

    def files(self, dataset: str) -> list[str]:
        """The folders of the pinned publication."""
        return self.store._selected(dataset, self.partitions[dataset], None, None, None)


def _table(layout: Mapping) -> str:
    """The catalog's name of a layout."""
    return "bars_" + layout["folder"].replace("-", "_")


def located(rows: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Rows with the partition columns they belong to."""
    if "year" in parts:
        rows = rows.withColumn("year", F.year("ts"))
    return rows.withColumn("bucket", exprs.bucket())


def time_column(bars: DataFrame) -> str:
    return "date" if "date" in bars.columns else "ts"


def in_range(bars: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Bars between inclusive UTC dates; times are compared as they are stored, so that the scan filters them."""
    column = time_column(bars)
    kind = "date" if column == "date" else "timestamp_ntz"
    if start:
        bars = bars.filter(F.col(column) >= F.lit(start).cast(kind))
    if end:
        after = (date.fromisoformat(end) + timedelta(1)).isoformat()
        bars = bars.filter(F.col(column) < F.lit(after).cast(kind))
    return bars


def select_range(bars: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """``in_range`` in key order."""
    return in_range(bars, start, end).orderBy("instrument_id", time_column(bars))


def by_segments(bars: DataFrame, segments: DataFrame) -> DataFrame:
    """Bars within resolved segments of their instrument, with the segment's ticker; segments stand as their days."""
    days = segments.filter("status = 'resolved'").select(F.col("owner").alias("instrument_id"), "ticker", F.explode(F.sequence("first", "last")).alias("_day"))
    return bars.withColumn("_day", exprs.utc_date(F.col(time_column(bars)))).join(days, ["instrument_id", "_day"]).drop("_day")


def file_bounds(df: DataFrame, column: str) -> DataFrame:
    """(file, n_rows, first_value, last_value) of each file read, from one scan of one column."""
    return df.select(F.col("_metadata.file_name").alias("file"), column).groupBy("file").agg(F.count("*").alias("n_rows"), F.min(column).alias("first_value"), F.max(column).alias("last_value"))


def vendor_csv(spark: SparkSession, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows of a vendor's CSV answer as text columns; errors in place of CSV, ragged rows and repeated headers fail."""
    text = text.removeprefix("﻿")
    if text.lstrip().startswith(("{", "[")):
        raise ValueError(f"the answer is JSON, not CSV: {json.loads(text)}")
    rows = list(csv.reader(io.StringIO(text)))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not rows:
        return spark.createDataFrame([], schema)
    header = rows[0]
    if len(set(header)) != len(header) or set(header) != set(columns):
        raise ValueError(f"unexpected header {header}")
    if any(len(r) != len(header) for r in rows[1:]):
        raise ValueError("a row has another number of fields than the header")
    at = [header.index(c) for c in columns]
    return spark.createDataFrame([tuple(r[i] or None for i in at) for r in rows[1:]], schema)


#: fixed values: names of a volume column in universe lists, case and underscores aside
VOLUME_NAMES = ("avgdollarvolume", "mediandollarvolume", "dollarvolume", "adv")


def universe_csv(spark: SparkSession, text: str, year: int | None = None) -> DataFrame:
    """Lines of a universe list for ``universe_import``: (line, year, ticker, rank, dollar_volume).

    Names of columns count without case and underscores. A ticker column is needed, and a year column
    or ``year``; rank and volume are optional. A field that is no number is an error with its line.
    """
    reader = csv.DictReader(io.StringIO(text.removeprefix("\ufeff")))
    names = {c.lower().replace("_", "").strip(): c for c in reader.fieldnames or []}
    if "ticker" not in names:
        raise ValueError("a universe list needs a ticker column")
    if "year" not in names and year is None:
        raise ValueError("the list has no year column, so a year must be given")
    volume = next((names[n] for n in VOLUME_NAMES if n in names), None)
    rows = []
    for line, row in enumerate(reader, start=2):
        try:
            own = int(row[names["year"]]) if "year" in names else year
            rank = int(row[names["rank"]]) if row.get(names.get("rank")) else None
            rows.append((line, own, row[names["ticker"]], rank, float(row[volume]) if volume and row.get(volume) else None))
        except ValueError as problem:
            raise ValueError(f"line {line}: {problem}") from None
    return spark.createDataFrame(rows, "line long, year int, ticker string, rank int, dollar_volume double")


def zipped_csv(spark: SparkSession, data: bytes, columns: Sequence[str], tickers: Sequence[str] | None = None) -> DataFrame:
    """The one CSV in a zip archive, restricted to tickers."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        (name,) = [n for n in z.namelist() if n.endswith(".csv")]
        df = vendor_csv(spark, z.read(name).decode("utf-8"), columns)
    return df.filter(F.col("ticker").isin([t.upper() for t in tickers])) if tickers is not None else df


def group_tags(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, group) rows of a file with or without a header."""
    df = spark.read.schema("ticker string, group string").csv(path)
    return df.filter(F.lower("ticker") != "ticker").select(F.upper(F.trim("ticker")).alias("ticker"), F.trim("group").alias("group"))
