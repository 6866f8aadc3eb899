"""A keyed table in hash buckets, changed bucket by bucket and read through a manifest.

A version is a manifest: which folders hold each bucket. A change writes new folders for the buckets it touches
and then the next manifest; readers see the old version until that is complete. Appended folders of a bucket
are merged into one when there are `merge_at` of them, and folders that neither of the last two versions names
are removed, so the number of files does not grow with the number of changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "bucket int, path string"


def bucket_of(keys: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _listed(spark: SparkSession, folder: str) -> dict[str, str]:
    """{name: path} of what is in a folder, in any store Spark writes to; empty where it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName(): s.getPath().toString() for s in files.listStatus(path)} if files.exists(path) else {}


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def manifest(spark: SparkSession, root: str, before: int | None = None) -> tuple[int, dict[int, list[str]]]:
    """(version, {bucket: folders}) of the last complete version, or of the last one below `before`; -1 where there is none."""
    for version in sorted((int(n.split("=")[1]) for n in _listed(spark, f"{root}/manifest")), reverse=True):
        folder = f"{root}/manifest/version={version}"
        if (before is None or version < before) and "_SUCCESS" in _listed(spark, folder):
            held: dict[int, list[str]] = {}
            for row in spark.read.schema(MANIFEST).parquet(folder).orderBy("bucket", "path").collect():  # at most merge_at a bucket
                held.setdefault(row.bucket, []).append(row.path)
            return version, held
    return -1, {}


def read(spark: SparkSession, root: str, empty: DataFrame, only: list[int] | None = None, before: int | None = None) -> DataFrame:
    """The rows of a version, of some buckets or all; `empty` has their schema."""
    held = manifest(spark, root, before)[1]
    paths = [p for bucket, folders in held.items() if only is None or bucket in only for p in folders]
    return spark.read.schema(empty.schema).parquet(*paths) if paths else empty.limit(0)


def write(rows: DataFrame, root: str, version: int, keys: tuple[str, ...], buckets: int, replace: list[int] | None = None, merge_at: int = 8) -> None:
    """The next version: rows are appended to their buckets, or become all of the buckets listed in `replace`.

    A version that is written again is made anew from the one before it.
    """
    spark = rows.sparkSession
    _, held = manifest(spark, root, version)
    own = rows.withColumn("__bucket", bucket_of(keys, buckets))
    if replace is not None:
        held = {b: paths for b, paths in held.items() if b not in replace}
    elif full := [b for b, paths in held.items() if len(paths) >= merge_at - 1]:
        old = spark.read.schema(rows.schema).parquet(*[p for b in full for p in held[b]])
        own = own.unionByName(old.withColumn("__bucket", bucket_of(keys, buckets)))
        held = {b: paths for b, paths in held.items() if b not in full}
    data = f"{root}/data/version={version}"
    own.repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(data)
    for name, path in _listed(spark, data).items():
        if name.startswith("__bucket="):
            held.setdefault(int(name.split("=")[1]), []).append(path)
    listed = [(b, p) for b, paths in sorted(held.items()) for p in paths]
    spark.createDataFrame(listed, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/version={version}")
    _clear(spark, root, version)


def _clear(spark: SparkSession, root: str, version: int) -> None:
    """Remove what the last two versions do not name."""
    kept, last = set(), []
    for name, path in _listed(spark, f"{root}/manifest").items():
        last.append((int(name.split("=")[1]), path))
    last.sort()
    for _, path in last[:-2]:
        _remove(spark, path)
    for _, path in last[-2:]:
        kept |= {r.path for r in spark.read.schema(MANIFEST).parquet(path).collect()}
    for name, folder in _listed(spark, f"{root}/data").items():
        if int(name.split("=")[1]) > version:
            continue
        parts = {n: p for n, p in _listed(spark, folder).items() if n.startswith("__bucket=")}
        gone = [p for p in parts.values() if p not in kept]
        if len(gone) == len(parts):
            _remove(spark, folder)
        else:
            for p in gone:
                _remove(spark, p)
