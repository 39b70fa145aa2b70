"""Research runs: input manifests with fingerprints, write-once publication, and their reading back.

A run is a folder. It is created exclusively, holds its observations, metrics and manifest, and
counts as published once its record says so; a published run is never written again. The small
records are JSON, read and written through Spark's own file system so that any store will do.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from barlake.sources.files import footer_counts, matches, names, remove, rename
from barlake.sources.warehouse import Snapshot, Warehouse


def canonical_json(value) -> str:
    """Sorted keys, no spaces, finite numbers only."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


MANIFEST = "path string, size_bytes long, n_rows long, content string"
#: a dataset's folder, a publication's own folder, the partition, the file
PARTITION = r"([^/]+)/data-[0-9a-f]+/(.+)/[^/]+$"


def _hashed(*salt) -> Column:
    return F.sum(F.xxhash64(*salt, "row").cast("decimal(20,0)"))


def input_manifest(spark: SparkSession, inputs: Sequence[str] | Mapping[str, Sequence[str]], by_partition: bool = False) -> DataFrame:
    """(path, size_bytes, n_rows, content) of each Parquet file; of files by dataset, each dataset has its own columns.

    ``content`` is the sum of two 64-bit hashes of each row, so that it needs no order and no more memory
    than a row: Spark splits a large file among tasks and adds up what they found. Files that hold no row
    are not listed. By partition, a dataset's partitions stand in place of the files that a publication chose.
    """
    out = None
    for paths in inputs.values() if isinstance(inputs, Mapping) else [inputs]:
        if not paths:
            continue
        rows = spark.read.parquet(*paths)
        columns = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() == "map" else F.col(f.name) for f in rows.schema.fields]
        own = rows.select(F.struct(*columns).alias("row"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size_bytes"))
        own = own.groupBy("path", "size_bytes").agg(F.count("*").alias("n_rows"), _hashed().alias("a"), _hashed(F.lit(7)).alias("b"))
        out = own if out is None else out.unionByName(own)
    if out is None:
        return spark.createDataFrame([], MANIFEST)
    if by_partition:
        name = F.concat_ws("/", F.regexp_extract("path", PARTITION, 1), F.regexp_extract("path", PARTITION, 2))
        out = out.groupBy(name.alias("path")).agg(*[F.sum(c).alias(c) for c in ("size_bytes", "n_rows", "a", "b")])
    return out.select("path", "size_bytes", "n_rows", F.concat_ws("/", F.col("a").cast("string"), F.col("b").cast("string")).alias("content"))


def manifest_diff(stored: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """(key, status, rows_before, rows_after) of two manifests: unchanged, changed, missing or added."""
    side = lambda df, name: df.select(key, F.struct("n_rows", "content").alias(f"{name}_print"), F.col("n_rows").alias(f"rows_{name}"))
    both = side(stored, "before").join(side(current, "after"), key, "full")
    before, after = F.col("before_print"), F.col("after_print")
    status = F.when(after.isNull(), "missing").when(before.isNull(), "added").when(before == after, "unchanged").otherwise("changed")
    return both.select(key, status.alias("status"), "rows_before", "rows_after")


def rows_digest(rows: DataFrame) -> str:
    """A digest of a relation's rows in any order, for the metadata that a run depends on."""
    hashed = F.xxhash64(*sorted(rows.columns)).cast("decimal(20,0)")
    found = rows.agg(F.count("*").alias("n"), F.sum(hashed).cast("string").alias("h"), F.sum(F.xxhash64(F.lit(7), *sorted(rows.columns)).cast("decimal(20,0)")).cast("string").alias("g")).first()
    return f"{found.n}/{found.h}/{found.g}"


def fingerprint(manifest: DataFrame, parameters: Mapping, metadata: Mapping[str, str] | None = None) -> str:
    """One hash of all inputs, parameters and metadata digests; the order of files has no part in it."""
    text = canonical_json({"inputs": rows_digest(manifest.select("path", "n_rows", "content")), "metadata": dict(metadata or {}), "parameters": parameters})
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass(frozen=True)
class FingerprintStatus:
    """What changed among the inputs of a published run."""

    counts: dict[str, int]
    metadata_changed: tuple[str, ...]

    @property
    def matches(self) -> bool:
        return not self.metadata_changed and not any(self.counts.get(s) for s in ("changed", "missing", "added"))


@dataclass
class Draft:
    """A run that is being written: its folder, and what its record will say."""

    run_id: str
    folder: str
    record: dict


class RunError(RuntimeError):
    pass


@dataclass
class Catalog:
    spark: SparkSession
    root: str

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _write(self, path: str, record: Mapping, overwrite: bool) -> None:
        """Write beside the file, then rename: a reader sees the old record or the new, never a part."""
        fs, p = self._fs(path)
        _, beside = self._fs(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(beside, False)
        out.write(bytearray(canonical_json(record).encode()))
        out.close()
        if not rename(self.spark, beside, p, overwrite):
            fs.delete(beside, False)
            raise RunError(f"{path} is there already")

    def record(self, run_id: str) -> dict:
        fs, p = self._fs(f"{self.root}/{run_id}/run.json")
        if not fs.exists(p):
            raise RunError(f"no run {run_id}")
        stream = fs.open(p)
        text = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        stream.close()
        return json.loads(text)

    @contextmanager
    def publication(self, study: str, version: int, parameters: Mapping) -> Iterator[Draft]:
        """A new run's folder. It counts as published once the block ends; a failure removes all but its record."""
        run_id = uuid.uuid4().hex
        draft = Draft(run_id, f"{self.root}/{run_id}", {})
        base = {"run_id": run_id, "study": study, "version": version, "parameters": dict(parameters)}
        self._write(f"{draft.folder}/run.json", base | {"status": "running"}, overwrite=False)
        try:
            yield draft
        except Exception as error:
            for part in names(self.spark, draft.folder):
                if part != "run.json":
                    remove(self.spark, f"{draft.folder}/{part}")
            self._write(f"{draft.folder}/run.json", base | {"status": "failed", "error": str(error)[:500]}, overwrite=True)
            raise
        self._write(f"{draft.folder}/run.json", base | {"status": "succeeded"} | draft.record, overwrite=True)

    def publish(self, study: str, version: int, parameters: Mapping, inputs: Sequence[str], produce: Callable[[], tuple[DataFrame, DataFrame]]) -> str:
        """Run ``produce`` for (observations, metrics) and publish both; a failure leaves a failed record."""
        with self.publication(study, version, parameters) as draft:
            self.put_inputs(draft, inputs, parameters)
            observations, metrics = produce()
            observations, seen = written(observations, f"{draft.folder}/observations")
            written(metrics, f"{draft.folder}/metrics")
            draft.record |= {"rows": seen["rows"], "schema": json.loads(observations.schema.json())}
        return draft.run_id

    def put_inputs(self, draft: Draft, inputs: Sequence[str] | Snapshot, parameters: Mapping, metadata: Mapping[str, DataFrame] | None = None) -> None:
        """Write the manifest of a run's inputs, and record its fingerprint and where its inputs come from.

        Inputs are paths and patterns, or a warehouse's datasets as they are pinned; their names are recorded.
        """
        manifest, _ = written(self._manifest(inputs), f"{draft.folder}/manifest")
        digests = {name: rows_digest(rows) for name, rows in sorted((metadata or {}).items())}
        where = {"datasets": sorted(inputs.partitions)} if isinstance(inputs, Snapshot) else {"paths": list(inputs)}
        draft.record |= {"fingerprint": fingerprint(manifest, parameters, digests), "metadata": digests, "inputs": where}

    def _manifest(self, inputs: Sequence[str] | Snapshot) -> DataFrame:
        if isinstance(inputs, Snapshot):
            return input_manifest(self.spark, {d: inputs.files(d) for d in inputs.partitions}, by_partition=True)
        return input_manifest(self.spark, [p for p in inputs if matches(self.spark, p)])

    def differences(self, run_id: str, store: Warehouse | None = None) -> DataFrame:
        """(path, status, rows_before, rows_after) of a published run's inputs then and now; datasets are looked up in ``store``."""
        record = self.record(run_id)
        if record["status"] != "succeeded":
            raise RunError("only published runs can be verified")
        where = record["inputs"]
        if "datasets" in where and store is None:
            raise RunError("the run read datasets of a warehouse, which must be given")
        stored = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/{run_id}/manifest")
        return manifest_diff(stored, self._manifest(store.pin(where["datasets"]) if "datasets" in where else where["paths"]))

    def verify(self, run_id: str, store: Warehouse | None = None, metadata: Mapping[str, DataFrame] | None = None) -> FingerprintStatus:
        """Whether a published run's inputs are what they were: its files or partitions, and the metadata given here."""
        found = self.differences(run_id, store).groupBy("status").agg(F.count("*").alias("n")).collect()
        then = self.record(run_id).get("metadata", {})
        changed = tuple(sorted(name for name, rows in (metadata or {}).items() if then.get(name) != rows_digest(rows)))
        return FingerprintStatus({r.status: r.n for r in found}, changed)

    def load_observations(self, run_ids: Sequence[str]) -> DataFrame:
        """Observations of published runs of one study and version, whose schemas and counts agree."""
        records = [self.record(r) for r in dict.fromkeys(run_ids)]
        if not records:
            raise RunError("no runs are given")
        if any(r["status"] != "succeeded" for r in records):
            raise RunError("only published runs can be loaded")
        if len({(r["study"], r["version"], canonical_json(r["schema"])) for r in records}) != 1:
            raise RunError("the runs differ in study, version or schema")
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(records[0]["schema"])
        out = None
        for r in records:
            df = self.spark.read.schema(schema).parquet(f"{self.root}/{r['run_id']}/observations").withColumn("run_id", F.lit(r["run_id"]))
            out = df if out is None else out.unionByName(df)
        folders = {f"{self.root}/{r['run_id']}/observations": r["rows"] for r in records}
        counts = footer_counts(self.spark, list(folders))
        if any(counts.get(folder, 0) != rows for folder, rows in folders.items()):
            raise RunError("a run's rows differ from its record")
        return out

    def metrics(self, run_id: str) -> DataFrame:
        """The metrics of a published run."""
        if self.record(run_id)["status"] != "succeeded":
            raise RunError("only published runs can be read")
        return self.spark.read.parquet(f"{self.root}/{run_id}/metrics")

    def abandoned(self) -> list[str]:
        """Runs that began and never ended; remove them with ``drop``."""
        return [run_id for run_id, problem in self.reconcile().items() if problem == "running"]

    def reconcile(self, apply: bool = False) -> dict[str, str]:
        """What is wrong with the folders of runs: ``running`` records, folders ``without_record``, published runs with a ``missing_artifact``.

        Nothing is touched unless ``apply``: then running records become failed ones without their tables, and
        folders without record go. A published run is never removed.
        """
        found = {}
        for run_id in sorted(names(self.spark, self.root)):
            held = set(names(self.spark, f"{self.root}/{run_id}"))
            if "run.json" not in held:
                found[run_id] = "without_record"
                if apply:
                    remove(self.spark, f"{self.root}/{run_id}")
                continue
            record = self.record(run_id)
            if record["status"] == "running":
                found[run_id] = "running"
                if apply:
                    for part in held - {"run.json"}:
                        remove(self.spark, f"{self.root}/{run_id}/{part}")
                    self._write(f"{self.root}/{run_id}/run.json", record | {"status": "failed", "error": "abandoned"}, overwrite=True)
            elif record["status"] == "succeeded" and not {"observations", "metrics", "manifest"} <= held:
                found[run_id] = "missing_artifact"
        return found

    def drop(self, run_id: str) -> None:
        if self.record(run_id)["status"] == "succeeded":
            raise RunError("a published run stays")
        remove(self.spark, f"{self.root}/{run_id}")


def written(df: DataFrame, path: str, **counts) -> tuple[DataFrame, dict]:
    """Write a table once, counting ``rows`` and the given aggregates while it is written; (table, counts)."""
    seen = Observation()
    df.observe(seen, F.count("*").alias("rows"), *[c.alias(name) for name, c in counts.items()]).write.mode("error").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), dict(seen.get)
