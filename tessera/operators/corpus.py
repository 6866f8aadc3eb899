"""The corpus index: idempotent upserts, pruning, shard placement and shard changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import rolling
from tessera.operators.places import numbered

SHARD_ROWS, SHARD_BYTES = 20_000, 32 << 20


def first_of_each(units: DataFrame, order: str) -> DataFrame:
    """One row for each unit_id, the first in ingest order, with how many came in all.

    The winner is found on ids and order alone, by a partial aggregate; texts are not sorted.
    """
    first = units.groupBy("unit_id").agg(F.min(order).alias(order), F.count("*").alias("copies"))
    return units.join(first, ["unit_id", order])


def upsert_actions(index: DataFrame, units: DataFrame) -> DataFrame:
    """(unit_id, action, ref, content_hash): inserted, updated or unchanged for each unit of this ingest.

    An unchanged unit is not written at all: it keeps the index's old ref. Only hashes travel through the join.
    """
    old = index.select("unit_id", F.col("content_hash").alias("old_hash"), F.col("ref").alias("old_ref"))
    joined = units.select("unit_id", "content_hash", "ref").join(old, "unit_id", "left")
    action = F.when(F.col("old_hash").isNull(), "inserted").when(F.col("old_hash") != F.col("content_hash"), "updated").otherwise("unchanged")
    return joined.select("unit_id", action.alias("action"), F.when(action == "unchanged", F.col("old_ref")).otherwise(F.col("ref")).alias("ref"), "content_hash")


def upserted(index: DataFrame, units: DataFrame, now: Column) -> DataFrame:
    """The index after the ingest: rows (unit_id, repo, kind, content_hash, ref, updated_at)."""
    cols = ("repo", "kind", "content_hash", "ref")
    old = index.select("unit_id", *[F.col(c).alias(f"old_{c}") for c in (*cols, "updated_at")])
    joined = old.join(units.select("unit_id", *cols), "unit_id", "full_outer")
    same = F.col("content_hash").isNull() | F.coalesce(F.col("old_content_hash") == F.col("content_hash"), F.lit(False))
    pick = lambda c, new: F.when(same, F.col(f"old_{c}")).otherwise(new).alias(c)
    return joined.select("unit_id", *[pick(c, F.col(c)) for c in cols], pick("updated_at", now))


def prunable(index: DataFrame, live: DataFrame) -> DataFrame:
    """Indexed source and doc units that the current tree lacks, in repositories of which some unit was fetched.

    Kinds that come from windowed listings are never pruned, and an empty fetch prunes nothing.
    """
    trees = live.where(F.col("kind").isin("source", "doc"))
    fetched = trees.select("repo").distinct()
    held = index.where(F.col("kind").isin("source", "doc")).join(fetched, "repo", "left_semi")
    return held.join(trees.select("repo", "unit_id"), ["repo", "unit_id"], "left_anti")


def resolved(hits: DataFrame, index: DataFrame) -> DataFrame:
    """Retrieved (query_id, rank, unit_id) with their index rows, unknown ids dropped."""
    return hits.join(index, "unit_id")


def ingest_report(actions: DataFrame, pruned: DataFrame) -> DataFrame:
    """Per repository: inserted, updated, unchanged, pruned, and whether nothing was written."""
    count = lambda a: F.count(F.when(F.col("action") == a, 1)).alias(a)
    rows = actions.select("repo", "action").unionByName(pruned.select("repo", F.lit("pruned").alias("action")))
    out = rows.groupBy("repo").agg(*map(count, ("inserted", "updated", "unchanged", "pruned")))
    return out.withColumn("wrote_nothing", (F.col("inserted") == 0) & (F.col("updated") == 0))


def latest(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The most recent rows of each key: how far back a listing is walked."""
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__nth") <= most).drop("__nth")


def shard_name(repo: Column, kind: Column, number: Column) -> Column:
    return F.concat(kind, F.lit("/"), F.replace(repo, F.lit("/"), F.lit("__")), F.format_string("-%05d.jsonl.gz", number))


def shards_by_rows(units: DataFrame, rows: int = SHARD_ROWS) -> DataFrame:
    """units (repo, kind, unit_id) with shard: a new one every `rows` units in id order."""
    placed = numbered(units, ["repo", "kind"], ["unit_id"])
    return placed.withColumn("shard", shard_name(F.col("repo"), F.col("kind"), F.floor((F.col("place") - 1) / rows).cast("int"))).drop("place")


def shards(units: DataFrame, rows: int = SHARD_ROWS, size: int = SHARD_BYTES) -> DataFrame:
    """(repo, kind, unit_id, shard): rolls to a new shard when it holds `rows` units or would pass `size` bytes.

    Only ids and line lengths (unit_id, bytes) are moved; texts are joined on placement by the writer. A large
    (repo, kind) rolls in chunks, see rolling.
    """
    return rolling.rolled(units, rows, size).select("repo", "kind", "unit_id", shard_name(F.col("repo"), F.col("kind"), F.col("number")).alias("shard"))


def shard_digests(placed: DataFrame) -> DataFrame:
    """(shard, rows, digest): the digest of a shard's record hashes in id order; at most SHARD_ROWS of them."""
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_id", "content_hash"))), lambda x: x["content_hash"]), "\n"), 256).alias("digest"))


def shard_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(shard, change): written, unchanged or gone, from the manifests before and after."""
    o, n = old.select("shard", F.col("digest").alias("old")), new.select("shard", F.col("digest").alias("new"))
    change = F.when(F.col("new").isNull(), "gone").when(F.col("old").isNull() | (F.col("old") != F.col("new")), "written").otherwise("unchanged")
    return o.join(n, "shard", "full_outer").select("shard", change.alias("change"))
