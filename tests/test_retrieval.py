import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import bm25, dense, fusion, metrics

RANKED = "query_id int, doc_id int, rank int"


def ranked(spark, lists):
    return spark.createDataFrame([(q, d, i + 1) for q, docs in enumerate(lists) for i, d in enumerate(docs)], RANKED)


def test_top_k_ties(spark):
    rows = spark.createDataFrame([(0, i, s) for i, s in enumerate((0.5, 0.9, 0.9, 0.1, 0.9))], "query_id int, doc_id int, score double")
    assert [r.doc_id for r in bm25.top_k(rows, 3).orderBy("rank").collect()] == [1, 2, 4]


def test_recall(spark):
    gold = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "query_id int, doc_id int")
    got = metrics.recall_at(metrics.gold_ranks(ranked(spark, [(3, 1, 2), (9, 8, 7), (5, 4, 0)]), gold), ks=(1, 2, 3)).first()
    assert (got.n, got.recall_1, got.recall_2, got.recall_3) == (3, 0.0, pytest.approx(1 / 3), pytest.approx(2 / 3))


def test_fusion_ties_by_first_appearance(spark):
    a, b = ranked(spark, [(1, 2, 3)]), ranked(spark, [(3, 4, 1)])
    got = [r.doc_id for r in fusion.reciprocal_rank_fusion([a, b]).orderBy("rank").collect()]
    assert got[:2] == [1, 3] and set(got) == {1, 2, 3, 4}


@pytest.mark.parametrize("block", [32 << 20, 2000])
def test_dense_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_BYTES", block)
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    docs = spark.createDataFrame([(i, f"g{i % 3}", x[i].tolist()) for i in range(500)], "doc_id int, repo string, vector array<double>").repartition(5)
    queries = docs.where("doc_id < 30").withColumnRenamed("doc_id", "query_id")
    for same in (None, "repo"):
        got = {}
        for row in dense.top_k(docs, queries, 7, same).collect():
            got.setdefault(row.query_id, {})[row["rank"]] = row.doc_id
        for q in range(30):
            s = x @ x[q]
            want = [i for i in np.lexsort((np.arange(500), -s)) if same is None or i % 3 == q % 3][:7]
            assert [got[q][i] for i in range(1, 8)] == want


def test_the_best_found_count_towards_a_block(spark, monkeypatch):
    """Few queries with deep lists are no broadcast block: their lists would fill every worker."""
    monkeypatch.setattr(dense, "BLOCK_BYTES", 30 * 8 * 8)
    monkeypatch.setattr(dense, "_one_pass", lambda *a: pytest.fail("all lists in one task"))
    docs = spark.createDataFrame([(i, [float(i % 7), *[1.0] * 7]) for i in range(200)], "doc_id int, vector array<double>")
    got = dense.top_k(docs, docs.where("doc_id < 30").withColumnRenamed("doc_id", "query_id"), 40)
    assert got.count() == 30 * 40 and {tuple(r) for r in got.where("rank = 1 and query_id = 6").select("doc_id", "score").collect()} == {(6, 43.0)}


@pytest.mark.parametrize("k", [1, 5, 60])
def test_best_of_batches_is_the_best_of_all(k):
    r = np.random.default_rng(3)
    x, ids = np.round(r.normal(size=(400, 3)), 1), r.permutation(400)  # many ties
    q = np.round(r.normal(size=(20, 3)), 1)
    x[17] = np.nan
    for rows in (np.arange(400), np.delete(np.arange(400), 17)):
        kept = None
        for part in np.array_split(rows, 9):
            kept = dense.best(q, ids[part], x[part], k, kept)
        s = np.round(q @ x[rows].T, 12)
        order = np.lexsort((np.broadcast_to(ids[rows], s.shape), -s))[:, :k]
        assert (kept[0] == ids[rows][order]).all() and (kept[1] == np.take_along_axis(s, order, 1)).all()


def test_post_filter_needs_deep_candidates(spark):
    docs = spark.createDataFrame([(i, "a" if i == 59 else "b") for i in range(100)], "doc_id int, repo string")
    queries = spark.createDataFrame([(0, "a")], "query_id int, repo string")
    kept = dense.after_filter(ranked(spark, [range(100)]), docs, queries, "repo", [10, 40, 100])
    got = {r.budget: r.recall for r in metrics.filter_rows(kept, spark.createDataFrame([(0, 59)], "query_id int, doc_id int"), [10, 40, 100], spark.createDataFrame([(0, 0.01)], "query_id int, share double")).collect()}
    assert got == {10: 0.0, 40: 0.0, 100: 1.0}


def test_plateau(spark):
    scored = ranked(spark, [range(30)]).withColumn("score", F.when(F.col("doc_id") == 20, 9.0).otherwise(0.0))
    gold = spark.createDataFrame([(0, 20)], "query_id int, doc_id int")
    got = {r.depth: r.recall_1 for r in metrics.recall_at(metrics.gold_ranks(fusion.reranked(scored, [10, 25]), gold, "depth"), "depth", ks=(1,)).collect()}
    assert got == {10: 0.0, 25: 1.0}


def test_ndcg(spark):
    qrels = spark.createDataFrame([("q", "d1", 1)], "query_id string, doc_id string, gain int")
    found = spark.createDataFrame([("q", "d9", 1), ("q", "d1", 2)], "query_id string, doc_id string, rank int")
    assert metrics.ndcg(found.join(qrels, ["query_id", "doc_id"]), metrics.ideal_gains(qrels)).first().ndcg == pytest.approx(1 / math.log2(3))


def test_percentiles_round_half_even(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(31)] + [("b", 4.0), ("a", None), ("a", 0.0)], "g string, v double")
    got = {r.g: (r.p50, r.p95, r.most, r.n) for r in metrics.percentiles(rows, "v", "g", skip_zero=True).collect()}
    assert got == {"a": (15.5, 29.0, 30.0, 30), "b": (4.0, 4.0, 4.0, 1)}  # 0.95 * 29 = 27.55


def test_bm25_weights_and_padding(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha"), (3, "gamma delta"), (4, "")], "doc_id int, text string")
    queries = spark.createDataFrame([(0, "beta beta"), (1, "nothing")], "query_id int, query string")
    top = bm25.top_k(bm25.scores(bm25.index(docs), queries), 3)
    mean, idf = 6 / 4, math.log1p((4 - 1 + 0.5) / 1.5)
    assert [(r.doc_id, r.score) for r in top.collect()] == [(1, pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / mean)), abs=1e-8))]
    full = bm25.padded(top, queries, docs, 3)
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in full.collect()) == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 1, 1), (1, 2, 2), (1, 3, 3)]


def test_end_to_end_with_hunk_and_bag_of_words(spark):
    said = [f"word{i} token{i * 7} thing{i * 13} more{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, s, s) for i, s in enumerate(said)], "id int, text string, query string")
    found = bm25.top_k(bm25.scores(bm25.index(docs, "id"), docs.withColumnRenamed("id", "query_id"), key="id"), 1, key="id")
    assert all(r.query_id == r.id for r in found.collect()) and found.count() == 60
    vectors = dense.embed(docs, dense.bag_of_words(256)).withColumn("vector", F.transform("vector", lambda x: x.cast("double")))
    top = dense.top_k(vectors.withColumnRenamed("id", "doc_id"), vectors.withColumnRenamed("id", "query_id"), 10)
    assert top.where("query_id = doc_id").count() >= 54


def test_vector_store_faults(spark):
    wanted = spark.createDataFrame([("a", "f1"), ("b", "f1"), ("c", "f1"), ("d", "f1")], "id string, fingerprint string")
    stored = spark.createDataFrame([("a", [1.0], "f1"), ("b", [float("nan")], "f1"), ("c", [1.0], "f0"), ("x", [1.0], "f1"), ("a", [1.0], "f1")], "id string, vector array<float>, fingerprint string")
    assert sorted(tuple(r) for r in dense.faults(wanted, stored).collect()) == [("a", "doubled"), ("b", "not finite"), ("c", "stale"), ("d", "missing"), ("x", "unexpected")]
    assert sorted(r.id for r in dense.stale(wanted, stored).collect()) == ["c", "d"]


def test_document_matrix_takes_body_vectors_of_comments(spark):
    vectors = spark.createDataFrame([("u1", [1.0]), ("u2", [2.0]), ("body/u2", [3.0])], "id string, vector array<float>")
    docs = spark.createDataFrame([("u1", "doc"), ("u2", "review_comment")], "id string, kind string")
    assert {r.id: r.vector[0] for r in dense.document_matrix(vectors, docs, True).collect()} == {"u1": 1.0, "u2": 3.0}
    assert {r.id: r.vector[0] for r in dense.document_matrix(vectors, docs, False).collect()} == {"u1": 1.0, "u2": 2.0}


def test_model_scores_and_best_model(spark):
    rows = spark.createDataFrame([(0, 1, "a b", "a c"), (0, 2, "a b", "a b")], "query_id int, doc_id int, query string, text string")
    make = lambda: lambda pairs: [len(set(q.split()) & set(t.split())) for q, t in pairs]
    assert {r.doc_id: r.score for r in fusion.model_scores(rows, make).collect()} == {1: 1.0, 2: 2.0}
    recalls = spark.createDataFrame([("m1", "rrf", 0.2), ("m1", "rrf", 0.4), ("m2", "rrf", 0.35), ("m2", "dense", 0.9)], "model string, retriever string, recall_20 double")
    assert metrics.best_model(recalls).first().model == "m2"


def clustered(spark):
    """Documents of twenty topics in key order, and queries of one topic's words."""
    r = np.random.default_rng(3)
    said = [" ".join([f"t{i // 100}w{r.integers(30)}" for _ in range(12)] + [f"common{r.integers(5)}" for _ in range(6)]) for i in range(2000)]
    docs = spark.createDataFrame([(i * 7, t) for i, t in enumerate(said)] + [(1, ""), (3, None)], "doc_id long, text string").repartition(6)
    queries = spark.createDataFrame([(q, f"t{q}w1 t{q}w2 T{q}w3 common1 common2 t{q}w1") for q in range(12)] + [(50, "unheard"), (51, "common3"), (52, "")], "query_id int, query string")
    return docs, queries


@pytest.mark.parametrize(("k", "first"), [(5, 4), (150, 2), (1, 1)])
def test_search_of_a_stored_index_equals_all_scores(spark, tmp_path, k, first):
    docs, queries = clustered(spark)
    bm25.write_index(docs, str(tmp_path / "ix"), width=50)
    row = lambda r: (r.query_id, r.doc_id, r.score, r["rank"])
    got = sorted(map(row, bm25.search(spark, str(tmp_path / "ix"), queries, k, first=first).collect()))
    assert got == sorted(map(row, bm25.top_k(bm25.scores(bm25.index(docs), queries), k).collect())) and got


@pytest.mark.parametrize(("k", "group", "held", "asked"), [(5, 16, 400_000, 4096), (150, 3, 900, 4), (1, 1, 50, 4)])
def test_blocks_met_as_matrices_give_the_rows_of_all_scores(spark, tmp_path, monkeypatch, k, group, held, asked):
    monkeypatch.setattr(bm25, "QUERIES", asked)
    docs, queries = clustered(spark)
    bm25.write_index(docs, str(tmp_path / "ix"), width=50)
    postings = bm25.index(docs)
    row = lambda df: sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in df.collect())
    want = row(bm25.top_k(bm25.scores(postings, queries), k))
    assert row(bm25.search_all(spark, str(tmp_path / "ix"), queries, k, group=group)) == want and want
    assert row(bm25.top_scores(postings, queries, k, held=held)) == want


def test_blocks_that_cannot_matter_are_not_scored(spark, tmp_path):
    docs, queries = clustered(spark)
    bm25.write_index(docs, str(tmp_path / "ix"), width=50)
    asked = queries.select("query_id", F.explode(F.array_distinct(bm25.text.tokens(F.col("query")))).alias("term"))
    plan, _ = bm25.block_plan(spark, str(tmp_path / "ix"), asked, 5)
    n = {r.part: r.n for r in plan.where("query_id < 12").groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert n[0] == 48 and n[2] > 0.85 * sum(n.values())
    blocks = spark.read.parquet(str(tmp_path / "ix" / "blocks"))
    assert blocks.select(F.max(F.size("postings"))).first()[0] <= 50


def test_scores_of_a_block_are_summed_where_its_postings_lie(spark, tmp_path):
    docs, queries = clustered(spark)
    bm25.write_index(docs, str(tmp_path / "ix"), width=50)
    asked = queries.select("query_id", F.explode(F.array_distinct(bm25.text.tokens(F.col("query")))).alias("term"))
    plan, scored = bm25.block_plan(spark, str(tmp_path / "ix"), asked, 5)
    weighed = bm25._weighed(spark, str(tmp_path / "ix"), asked)
    rest = bm25._block_scores(spark, str(tmp_path / "ix"), weighed, plan.select("query_id", "block"), "query_id", "doc_id")
    dealt = [line for line in rest._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in line]
    assert dealt and not [line for line in dealt if "doc_id" in line.split("hashpartitioning(")[1]]  # one row a query and document never travels
    assert rest.count() == rest.select("query_id", "doc_id").distinct().count() > scored.count()


def test_terms_counted_inside_a_row_are_those_counted_over_rows(spark):
    docs = clustered(spark)[0].unionByName(spark.createDataFrame([(5, "b a b aB a_1 b"), (9, "x")], "doc_id long, text string"))
    counted = bm25.term_arrays(docs)
    row = lambda df: {tuple(r) for r in df.select("doc_id", "term", "tf", "length").collect()}
    inside = counted.select("doc_id", "length", F.inline("terms"))
    assert row(inside) == row(bm25.term_counts(docs).where("term <> ''")) and counted.count() == docs.count()


def test_tokens_are_parts_of_identifiers(spark):
    said = ["parseHTTPHeader", "snake_case_name", "__init__", "_", "ABC", "ABc", "x1y", "v2", "Hello hello", "12ab", "a_1", "éa", "_x_Y_", ""]
    got = [r.t for r in spark.createDataFrame([(s,) for s in said], "s string").select(bm25.text.tokens(F.col("s")).alias("t")).collect()]
    assert got == [["parsehttpheader", "parse", "http", "header"], ["snake_case_name", "snake", "case", "name"], ["init"], [], ["abc"], ["abc", "a", "bc"], ["x1y", "x", "1", "y"], ["v2", "v", "2"], ["hello", "hello"], ["12", "ab"], ["a_1", "a", "1"], ["a"], ["x_y", "x", "y"], []]


def test_gold_places_are_those_of_all_scores(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    said = [" ".join(r.choices(words, [1 / (i + 1) for i in range(60)], k=r.randrange(1, 30))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(said + said[:40])), "doc_id long, text string")
    queries = docs.select(F.col("doc_id").alias("query_id"), F.concat_ws(" ", F.slice(F.split("text", " "), 1, 6), F.lit("w0 w1 w59")).alias("query"))
    gold = queries.select("query_id", F.pmod(F.col("query_id") * 7, F.lit(190)).alias("doc_id")).where("query_id % 3 = 0").unionByName(queries.select("query_id", F.col("query_id").alias("doc_id")).where("query_id % 3 <> 0"))
    asked = queries.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("query")))).alias("term"))
    postings = bm25.index(docs, only=asked)
    all_ranks = bm25.top_k(bm25.scores(postings, queries), 20).join(gold, ["query_id", "doc_id"]).select("query_id", "rank")
    wanted = {tuple(x) for x in all_ranks.collect()}
    assert 20 < len(wanted) < 190
    for budgets in ((), (3,), (5, 40)):
        assert {tuple(x) for x in bm25.gold_places(postings, asked, gold, 20, budgets).collect()} == wanted


def test_gold_places_move_no_row_for_a_query_and_a_document(spark):
    """All queries share words with all documents, and few documents come before the gold one."""
    r = random.Random(6)
    said = [" ".join(r.choices([f"w{i}" for i in range(12)], k=20)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    queries = docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    gold = queries.select("query_id", F.col("query_id").alias("doc_id"))
    asked = queries.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("query")))).alias("term"))
    postings = bm25.materialized(bm25.index(docs))
    wanted = {tuple(x) for x in bm25.top_k(bm25.scores(postings, queries), 20).join(gold, ["query_id", "doc_id"]).select("query_id", "rank").collect()}
    store, new = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def moved() -> int:
        stages = store.stageList(None, False, False, new.new_array(new.jvm.double, 0), new.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = moved()
    assert {tuple(x) for x in bm25.gold_places(postings, asked, gold, 20).collect()} == wanted
    assert moved() - before < 400 * 400 / 2


def test_rows_of_one_key_are_one_document(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "b c"), (2, "a"), (3, None)], "doc_id long, text string")
    shares, rarity = bm25.share_arrays(docs)
    assert {r.term: round(r.weight, 9) for r in rarity.collect()} == {t: round(math.log1p((4 - df + 0.5) / (df + 0.5)), 9) for t, df in (("a", 2), ("b", 1), ("c", 1))}
    got = {(r.doc_id, t): round(w, 9) for r in shares.collect() for t, w in zip(r.terms, r.weights)}
    share = lambda tf, length: round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 1.25)), 9)
    assert got == {(1, "a"): share(1, 4), (1, "b"): share(2, 4), (1, "c"): share(1, 4), (2, "a"): share(1, 1)}


def test_documents_ahead_are_counted_over_blocks(monkeypatch):
    import numpy as np

    from tessera.operators import products

    monkeypatch.setattr(products, "COUNTED", 7)
    r = np.random.default_rng(1)
    q, d = (r.random((9, 30)) < 0.4).astype(float), (r.random((50, 30)) < 0.4) * r.integers(1, 4, (50, 30)).astype(float)
    d[20] = d[3]
    own = np.array([3, 20, 5, 6, 49, 0, 7, 8, 33])
    scores, (qr, qc), (dr, dc) = q @ d.T, np.nonzero(q), np.nonzero(d)
    counted = products.ahead((qc, qr, q[qr, qc]), (dc, dr, d[dr, dc]), 9, 50, 99, scores[np.arange(9), own], own, np.arange(50))
    assert counted.tolist() == [sum((s, -i) > (scores[j, own[j]], -own[j]) for i, s in enumerate(scores[j])) for j in range(9)]
