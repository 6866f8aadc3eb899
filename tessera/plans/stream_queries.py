"""Stream forms of the delivery queries, run over the tables until they are read whole, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.views import SQL, ctes, view
from tessera.session import shared_dir
from tessera.sources import buckets
from tessera.streaming import deliveries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deliveries view over the events table, read as a stream."""
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern, since the table may be one file
    return spark.sql(SQL["deliveries"].replace("FROM events", "FROM {events}"), events=events)


def _whole(frame: DataFrame, mode: str) -> DataFrame:
    """What the stream says when its input is read: each micro-batch replaces (complete) or adds (append)."""
    spark = frame.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        part = "all" if mode == "complete" else batch_id
        batch.write.mode("overwrite").parquet(f"{root}/out/part={part}")

    frame.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{root}/out").select(*frame.columns)


@query(ctes("deliveries") + " SELECT DISTINCT delivery_id, repo FROM deliveries WHERE event = 'pull_request' AND action IN ('opened', 'synchronize', 'reopened', 'ready_for_review') AND repo IS NOT NULL AND pr IS NOT NULL")
def stream_actionable_once(spark, sf_dir):
    return _whole(deliveries.once(deliveries.actionable(_stream(spark, sf_dir))).select("delivery_id", "repo"), "append")


@query(ctes("deliveries") + " SELECT repo, pr, arg_max(delivery_id, struct_pack(ts := ts, a := arrival)) AS delivery_id, count(*) AS n FROM deliveries WHERE repo IS NOT NULL AND pr IS NOT NULL GROUP BY 1, 2")
def stream_latest_per_pull(spark, sf_dir):
    return _whole(deliveries.latest_per_pull(_stream(spark, sf_dir)), "complete")


def _ledger(spark: SparkSession, waves: list[DataFrame], empty: DataFrame, step) -> DataFrame:
    """The ledger after a stream that is stopped after each wave of rows and started again from its checkpoint."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for rows in waves:
        rows.write.mode("append").parquet(f"{root}/in")
        arriving = spark.readStream.schema(waves[0].schema).parquet(f"{root}/in")
        deliveries.into_ledger(arriving, f"{root}/out", empty, step).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return buckets.read(spark, f"{root}/out", empty).select(*empty.columns)


@query(ctes("runs") + " SELECT batch AS claim_batch, repo, pr, coalesce(min(run_id) FILTER (run_id % 2 = 1), min(run_id)) AS run_id FROM runs GROUP BY 1, 2, 3")
def stream_claims(spark, sf_dir):
    runs = view(spark, sf_dir, "runs").select("batch", "repo", "pr", "run_id")
    empty = runs.limit(0).select(F.col("batch").alias("claim_batch"), "repo", "pr", "run_id")
    return _ledger(spark, [runs.where("run_id % 2 = 1"), runs.where("run_id % 2 = 0")], empty, deliveries.claim_step)


@query(ctes("offers") + """, f AS (SELECT *, row_number() OVER (PARTITION BY repo, pr, path, line ORDER BY nth) = 1 AS free FROM offers),
s AS (SELECT *, CAST(sum(free::INT) OVER (PARTITION BY repo, pr ORDER BY nth) AS BIGINT) AS slot FROM f) SELECT repo, pr, path, line, slot FROM s WHERE free AND slot <= 3""")
def stream_slots(spark, sf_dir):
    offers = view(spark, sf_dir, "offers").select("repo", "pr", "path", "line", "nth")
    empty = offers.limit(0).select("repo", "pr", "path", "line", F.lit(0).cast("long").alias("slot"))
    return _ledger(spark, [offers.where("nth <= 2"), offers.where("nth > 2")], empty, deliveries.slot_step)
