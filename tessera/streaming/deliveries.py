"""Webhook deliveries and their ledgers as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tessera.operators import ledgers
from tessera.sources import buckets as table
from tessera.sources import schemas


def stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Deliveries from JSON files as they arrive."""
    return spark.readStream.schema(schemas.DELIVERY).option("maxFilesPerTrigger", files).json(path)


def actionable(deliveries: DataFrame) -> DataFrame:
    """Deliveries that start work; stateless."""
    return deliveries.where(ledgers.is_actionable())


def once(deliveries: DataFrame, within: str | None = None) -> DataFrame:
    """Each delivery id once, ever. `within` bounds the state by a watermark on ts, and forgets older ids."""
    if within is None:
        return deliveries.dropDuplicates(["delivery_id"])
    return deliveries.withWatermark("ts", within).dropDuplicatesWithinWatermark(["delivery_id"])


def latest_per_pull(deliveries: DataFrame) -> DataFrame:
    """The latest delivery of each pull, for update or complete output."""
    return deliveries.where("repo is not null and pr is not null").groupBy("repo", "pr").agg(F.max_by("delivery_id", F.struct("ts", "arrival")).alias("delivery_id"), F.count("*").alias("n"))


def into_ledger(rows: DataFrame, root: str, empty: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], keys: tuple[str, ...] = ("repo", "pr"), buckets: int = 64, merge_at: int = 8) -> DataStreamWriter:
    """A writer that applies step(batch, ledger) to each micro-batch and keeps its rows in a table of buckets at root.

    A batch that is run again is applied to the version before it, so redelivery and restarts change nothing.
    The step must be one of each key by itself: rows are kept in buckets by `keys`, and a batch reads only the
    buckets of its own keys, not the whole ledger. Buckets are compacted, see sources.buckets. empty has the
    ledger's schema; read the ledger with buckets.read.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # its buckets are asked for before its rows
        try:
            own = [r.bucket for r in batch.select(table.bucket_of(keys, buckets).alias("bucket")).distinct().collect()]  # at most `buckets` numbers
            ledger = table.read(batch.sparkSession, root, empty, own, batch_id)
            table.write(step(batch, ledger), root, batch_id, keys, buckets, merge_at=merge_at)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(apply)


def claim_step(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """Claims (claim_batch, repo, pr, run_id) won in a micro-batch: the first run of each (batch, repo, pr)."""
    return ledgers.claims(batch, ledger.withColumnRenamed("claim_batch", "batch")).select(F.col("batch").alias("claim_batch"), "repo", "pr", "run_id")


def slot_step(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """Slots taken in a micro-batch."""
    return ledgers.slots(batch, ledger).where("slot is not null").select("repo", "pr", "path", "line", "slot")
