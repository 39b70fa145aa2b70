"""Continuous upsert: each micro-batch of bars is merged like a delivery, later rows winning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barlake.operators.ingest import canonical
from barlake.sources.warehouse import DATASETS, Warehouse


def upsert_stream(stream: DataFrame, warehouse: Warehouse, dataset: str, checkpoint: str, sequence: str, once: bool = False) -> StreamingQuery:
    """Publish a stream of bars; within a batch the row with the highest ``sequence`` of a key stays.

    A batch that is replayed after a failure merges to the same result.
    """
    key = ["instrument_id", "date" if dataset == "eod" else "ts"]

    def merge(batch: DataFrame, _: int) -> None:
        last = Window.partitionBy(*key).orderBy(F.desc(sequence))
        rows = batch.withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n", sequence)
        warehouse.publish(dataset, canonical(rows, DATASETS[dataset]))

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
