import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import balls, dense

ROWS = "doc_id int, repo string, vector array<double>"


def clustered(spark, n=2000, dim=12, spread=0.05):
    r = np.random.default_rng(6)
    heart = r.normal(size=(25, dim))
    x = heart[r.integers(0, 25, n)] + spread * r.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, f"g{i % 3}", v.tolist()) for i, v in enumerate(x)] + [(n + i, "g0", x[i].tolist()) for i in range(30)] + [(9999, "g1", None)]
    docs = spark.createDataFrame(rows, ROWS).repartition(5)
    return docs, docs.where("doc_id % 40 = 0").withColumnRenamed("doc_id", "query_id")


@pytest.mark.parametrize(("same", "spread", "k"), [(None, 0.05, 7), ("repo", 0.05, 7), (None, 5.0, 3), (None, 0.01, 300)])
def test_equals_the_full_search(spark, tmp_path, same, spread, k):
    docs, queries = clustered(spark, spread=spread)
    balls.write_index(docs, str(tmp_path / "ix"), same, shell=32, sample=500)
    key = lambda r: (r.query_id, r["rank"], r.doc_id, round(r.score, 9))
    got = sorted(map(key, balls.search(spark, str(tmp_path / "ix"), queries, k, same).collect()))
    assert got == sorted(map(key, dense.top_k(docs, queries, k, same).collect())) and got


def test_shells_that_cannot_matter_are_skipped(spark, tmp_path):
    docs, queries = clustered(spark)
    balls.write_index(docs, str(tmp_path / "ix"), shell=32)
    shells = spark.read.parquet(str(tmp_path / "ix" / "shells"))
    assert shells.select(F.max(F.size("ids"))).first()[0] <= 32 and shells.select(F.sum(F.size("ids"))).first()[0] == 2030
    plan, _ = balls.shell_plan(spark, str(tmp_path / "ix"), queries.where("vector is not null"), 5)
    n = {r.part: r.n for r in plan.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert n[2] > 0.8 * sum(n.values())


def test_no_documents(spark, tmp_path):
    docs, queries = clustered(spark, 100)
    balls.write_index(docs.limit(0), str(tmp_path / "ix"))
    assert balls.search(spark, str(tmp_path / "ix"), queries, 3).collect() == []


@pytest.mark.parametrize(("same", "spread", "k", "rows"), [(None, 0.05, 7, 300), ("repo", 0.05, 7, 20), (None, 5.0, 3, 1 << 16), (None, 0.01, 300, 500)])
def test_blocks_of_queries_and_shells_give_the_full_search(spark, tmp_path, monkeypatch, same, spread, k, rows):
    monkeypatch.setattr(dense, "BLOCK_ROWS", rows)
    docs, queries = clustered(spark, spread=spread)
    balls.write_index(docs, str(tmp_path / "ix"), same, shell=32, sample=500)
    key = lambda r: (r.query_id, r["rank"], r.doc_id, round(r.score, 9))
    got = sorted(map(key, balls.search_all(spark, str(tmp_path / "ix"), queries, k, same).collect()))
    assert got == sorted(map(key, dense.top_k(docs, queries, k, same).collect())) and got


def test_no_documents_in_blocks(spark, tmp_path):
    docs, queries = clustered(spark, 100)
    balls.write_index(docs.limit(0), str(tmp_path / "ix"))
    assert balls.search_all(spark, str(tmp_path / "ix"), queries, 3).collect() == []
