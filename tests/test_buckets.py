import glob
import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import buckets, corpus_files, digest_tree, schemas
from tessera.streaming import deliveries

ROWS = "k long, v string"


def files(root):
    return {p: os.path.getmtime(p) for p in glob.glob(f"{root}/data/*/*/*.parquet")}


def test_appends_are_compacted_and_old_folders_go(spark, tmp_path):
    root, empty = str(tmp_path / "t"), spark.createDataFrame([], ROWS)
    most = 0
    for version in range(14):
        buckets.write(spark.createDataFrame([(k, f"v{version}") for k in range(version, version + 6)], ROWS), root, version, ("k",), 3, merge_at=4)
        most = max(most, len(files(root)))
    # two versions of three buckets with at most three folders each, and what they share
    assert most <= 2 * 3 * 4 and len(os.listdir(f"{root}/manifest")) == 2
    got = sorted(map(tuple, buckets.read(spark, root, empty).collect()))
    assert got == sorted((k, f"v{v}") for v in range(14) for k in range(v, v + 6))


def test_a_version_written_again_starts_from_the_one_before(spark, tmp_path):
    root, empty = str(tmp_path / "t"), spark.createDataFrame([], ROWS)
    for version, k in ((0, 1), (1, 2), (1, 3)):
        buckets.write(spark.createDataFrame([(k, "x")], ROWS), root, version, ("k",), 2)
    assert sorted(r.k for r in buckets.read(spark, root, empty).collect()) == [1, 3]
    assert [r.k for r in buckets.read(spark, root, empty, before=1).collect()] == [1]
    assert buckets.read(spark, str(tmp_path / "none"), empty).collect() == []
    os.remove(f"{root}/manifest/version=1/_SUCCESS")  # a version that was not finished is not there
    assert [r.k for r in buckets.read(spark, root, empty).collect()] == [1]


def test_a_stream_of_many_batches_keeps_few_files(spark, tmp_path):
    empty = spark.createDataFrame([], "repo string, pr int, path string, line int, slot long")
    offers = "repo string, pr int, path string, line int, nth int"
    for i in range(12):
        spark.createDataFrame([("r", pr, f"p{i}", 1, i) for pr in range(4)], offers).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(offers).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    root = str(tmp_path / "ledger")
    deliveries.into_ledger(stream, root, empty, deliveries.slot_step, buckets=4, merge_at=3).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    found = buckets.read(spark, root, empty).groupBy("pr").agg(F.sort_array(F.collect_list("slot")).alias("slots"), F.countDistinct("path").alias("n")).collect()
    assert sorted((r.pr, r.slots, r.n) for r in found) == [(pr, [1, 2, 3], 3) for pr in range(4)]
    assert len(files(root)) <= 2 * 4 * 3 and buckets.manifest(spark, root)[0] == 11


def test_an_ingest_leaves_other_buckets_files_alone(spark, tmp_path):
    root, empty = str(tmp_path / "index"), spark.createDataFrame([], schemas.INDEX)
    units = lambda ids, said, ref: spark.createDataFrame([(f"u{i}", "r", "doc", said, ref) for i in ids], "unit_id string, repo string, kind string, content_hash string, ref string")
    n = lambda df: {r.action: r.n for r in df.groupBy("action").agg(F.count("*").alias("n")).collect()}
    assert n(corpus_files.upsert_index(units(range(200), "a", "one"), root, F.lit(1), 32)) == {"inserted": 200}
    before = files(root)
    assert n(corpus_files.upsert_index(units(range(200), "a", "two"), root, F.lit(2), 32)) == {"unchanged": 200} and files(root) == before
    assert n(corpus_files.upsert_index(units([3, 7, 500], "b", "three"), root, F.lit(3), 32)) == {"updated": 2, "inserted": 1}
    now = buckets.manifest(spark, root)[1]
    old = buckets.manifest(spark, root, 1)[1]
    assert sum(now[b] != old.get(b) for b in now) <= 3 and {p: t for p, t in files(root).items() if p in before} == before
    got = {r.unit_id: (r.content_hash, r.ref, r.updated_at) for r in buckets.read(spark, root, empty).collect()}
    assert len(got) == 201 and got["u3"] == ("b", "three", 3) and got["u4"] == ("a", "one", 1)


def test_only_the_manifest_s_shards_are_opened(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = [(f"u{i:03d}", "o/r", ("source", "doc")[i % 2], "p", None, 1, 2, 4, "text", {"k": "v"}, f"h{i}") for i in range(60)]
    manifest = corpus_files.write_corpus(spark.createDataFrame(rows, schemas.UNIT).orderBy(F.rand(1)), root).cache()
    one = manifest.where("shard like 'doc%'").select("shard")
    for folder in glob.glob(f"{tmp_path}/shards/*source*"):
        for name in glob.glob(f"{folder}/*.gz"):
            with open(name, "wb") as out:
                out.write(b"no gzip at all")
    back = corpus_files.read_corpus(spark, root, one)
    assert [r.unit_id for r in back.collect()] == [f"u{i:03d}" for i in range(1, 60, 2)] and all("doc" in f for f in back.inputFiles())
    assert corpus_files.read_corpus(spark, root, one.limit(0)).collect() == []
    with pytest.raises(FileNotFoundError):
        corpus_files.read_corpus(spark, root, one.union(spark.createDataFrame([("doc/gone",)], "shard string")))


def test_trees_are_compared_where_they_differ(spark, tmp_path):
    old = {f"s{i}": f"d{i}" for i in range(3000)}
    new = {**old, "s7": "other", "added": "x"}
    del new["s9"]
    frame = lambda shards: spark.createDataFrame(sorted(shards.items()), "shard string, digest string").repartition(4)
    for name, shards in (("old", old), ("new", new), ("same", old), ("none", {})):
        digest_tree.write_tree(frame(shards) if shards else frame(old).limit(0), str(tmp_path / name), 3)
    at = lambda name: str(tmp_path / name)
    assert {tuple(r) for r in digest_tree.changes(spark, at("old"), at("new")).collect()} == {("s7", "written"), ("added", "written"), ("s9", "gone")}
    assert [n.count() for n in digest_tree.differing(spark, at("old"), at("new"))] == [1, 3, 3, 3]
    assert [n.count() for n in digest_tree.differing(spark, at("old"), at("same"))] == [0, 0, 0, 0]
    assert digest_tree.changes(spark, at("none"), at("old")).count() == 3000 and digest_tree.changes(spark, at("none"), at("none")).count() == 0
