"""A stored tree of digests over a manifest, so that two large manifests are told apart from their roots down.

A shard's node is the start of its name's hash, one hexadecimal digit a level; a node's digest is that of its
children. Two trees are compared level by level, only below nodes that differ, so what is joined grows with the
changes and not with the manifests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import corpus
from tessera.session import materialized


def _combined(key: str):
    """The digest of (key, digest) children in order; a node has 16, and a leaf the shards of one start."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "digest"))), lambda x: F.concat_ws("=", x[key], x["digest"])), "\n"), 256).alias("digest")


def write_tree(manifest: DataFrame, path: str, depth: int = 3) -> None:
    """Levels 0 to depth of a manifest (shard, digest) under path, and its shards by leaf. shard is a key."""
    named = manifest.select(F.substring(F.sha2("shard", 256), 1, depth).alias("node"), "shard", "digest")
    named.repartition("node").sortWithinPartitions("node", "shard").write.parquet(f"{path}/shards")
    level = manifest.sparkSession.read.parquet(f"{path}/shards").groupBy("node").agg(_combined("shard"))
    for d in range(depth, -1, -1):
        level = level if d == depth else level.select(F.substring("node", 1, d).alias("parent"), "node", "digest").groupBy(F.col("parent").alias("node_")).agg(_combined("node")).withColumnRenamed("node_", "node")
        level.write.parquet(f"{path}/level{d}")
        level = manifest.sparkSession.read.schema("node string, digest string").parquet(f"{path}/level{d}")


def differing(spark: SparkSession, old: str, new: str, depth: int = 3) -> list[DataFrame]:
    """For each level the nodes (node) whose digests differ, or that one tree lacks; below nodes that agree nothing is looked at."""
    read = lambda path, d: spark.read.schema("node string, digest string").parquet(f"{path}/level{d}")
    out: list[DataFrame] = []
    for d in range(depth + 1):
        a, b = read(old, d), read(new, d)
        if out:
            below = out[-1].select(F.col("node").alias("above"))
            a, b = (x.join(below, F.substring(x["node"], 1, d - 1) == F.col("above"), "left_semi") for x in (a, b))
        both = a.select("node", F.col("digest").alias("was")).join(b.select("node", F.col("digest").alias("is")), "node", "full_outer")
        out.append(materialized(both.where(~F.col("was").eqNullSafe(F.col("is"))).select("node")))
    return out


def changes(spark: SparkSession, old: str, new: str, depth: int = 3) -> DataFrame:
    """(shard, change) of the shards that are written or gone between two stored trees of one depth."""
    leaves = differing(spark, old, new, depth)[-1]
    kept = [spark.read.schema("node string, shard string, digest string").parquet(f"{p}/shards").join(leaves, "node", "left_semi").select("shard", "digest") for p in (old, new)]
    return corpus.shard_changes(*kept).where("change <> 'unchanged'")
