"""Continuous sync: chunk files that arrive are merged into the versioned vector table batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from palmleaf.config import Settings
from palmleaf.plans.service import sync_vectors
from palmleaf.sources.writers import VersionedTable


def stream_sync(spark: SparkSession, source: str, schema: str, table: VersionedTable, embed_fn: Callable, checkpoint: str, settings: Settings = Settings()):
    """Start a query that takes all new Parquet files under `source`, then stops.

    Every micro-batch is an idempotent merge by id and time, so one that is repeated after a failure changes nothing.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    merge = lambda batch, _: sync_vectors(batch, table, embed_fn, settings)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
