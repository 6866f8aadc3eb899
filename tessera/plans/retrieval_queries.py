"""Retrieval queries: BM25, dense search, filters, fusion, reranking and their metrics, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import balls, bm25, dense, fusion, metrics
from tessera.plans.views import TOKENS, ctes, view
from tessera.session import materialized, shared_dir

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BM25 = f"""WITH tok AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents),
stats AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM tok) / (SELECT count(*) FROM documents) AS mean),
len AS (SELECT doc_id, count(*) AS length FROM tok GROUP BY 1), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
post AS (SELECT tf.doc_id, tf.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS weight FROM tf JOIN len USING (doc_id) JOIN df USING (term), stats),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark),
scored AS (SELECT query_id, doc_id, round(sum(weight), 9) AS score FROM asked JOIN post USING (term) GROUP BY 1, 2),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 100),
gold AS (SELECT item_id AS query_id, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1)"""


_INDEXES: dict[tuple, str] = {}


def documents_index(spark, sf_dir) -> str:
    """The folder of the documents' stored index; built once an application and set of files."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = (spark.sparkContext.applicationId, *sorted(docs.inputFiles()))
    if held not in _INDEXES:
        path = f"{shared_dir(spark)}/tessera-index-{uuid.uuid4().hex}"
        least = spark.sparkContext.defaultParallelism
        bm25.write_index(docs.repartition(least) if docs.rdd.getNumPartitions() < least else docs, path)  # few row groups are few tasks
        _INDEXES[held] = path
    return _INDEXES[held]


def _bm25(spark, sf_dir, k=100):
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return bm25.search_all(spark, documents_index(spark, sf_dir), queries, k)


def _passage_gold(spark, sf_dir):
    """The first document that holds each benchmark passage, found by five of its words.

    Hashes of five words meet, with ids; texts are fetched once for the pairs that are left, and decide.
    """
    passages = _table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    first = passages.select("item_id", F.xxhash64(F.slice(F.split("passage", " "), 2, 5)).alias("h"))
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, 5)))
    spots = docs.select("doc_id", F.split("text", " ").alias("w")).select("doc_id", F.explode(F.array_distinct(grams(F.col("w")))).alias("h"))
    pairs = materialized(spots.join(first, "h").select("doc_id", "item_id").distinct())
    met = pairs.join(docs, "doc_id").join(passages, "item_id").where(F.col("text").contains(F.col("passage")))
    return met.groupBy(F.col("item_id").alias("query_id")).agg(F.min("doc_id").alias("doc_id"))


@query(_BM25 + " SELECT query_id, doc_id, rank FROM bm25 WHERE rank <= 20")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 20).select("query_id", "doc_id", "rank")


_RECALL = "count(*) AS n, " + ", ".join(f"round(avg(coalesce((rank <= {k})::INT, 0)), 9) AS recall_{k}" for k in metrics.KS)


@query(_BM25 + f" SELECT {_RECALL} FROM gold g LEFT JOIN bm25 b ON b.query_id = g.query_id AND b.doc_id = g.doc_id")
def bm25_recall(spark, sf_dir):
    return metrics.recall_at(metrics.gold_ranks(_bm25(spark, sf_dir), _passage_gold(spark, sf_dir)))


@query(_BM25 + """, lens AS (SELECT item_id AS query_id, len(string_split(text, ' ')) <= 25 AS fits FROM benchmark)
SELECT fits, count(*) AS n, round(avg(coalesce((rank <= 10)::INT, 0)), 9) AS recall FROM gold g LEFT JOIN bm25 b ON b.query_id = g.query_id AND b.doc_id = g.doc_id JOIN lens l ON l.query_id = g.query_id GROUP BY fits""")
def length_buckets(spark, sf_dir):
    lengths = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.size(F.split("text", " ")).alias("tokens"))
    return metrics.length_buckets(metrics.gold_ranks(_bm25(spark, sf_dir), _passage_gold(spark, sf_dir)), lengths, 25)


# ---- dense: queries are every tenth vector; gold is the next id of the same label

_DENSE = """WITH v AS (SELECT vec_id AS id, 'r' || label AS repo, 'k' || (vec_id % 3) AS kind, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS e FROM embeddings),
q AS (SELECT * FROM v WHERE id % 10 = 0),
gold AS (SELECT q.id AS query_id, min(v.id) AS doc_id FROM q JOIN v ON v.repo = q.repo AND v.id > q.id GROUP BY 1),
s AS (SELECT q.id AS query_id, v.id AS doc_id, v.repo = q.repo AS same, round(list_inner_product(q.e, v.e), 12) AS score FROM q, v WHERE v.id <> q.id),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 400),
pre AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE same) WHERE rank <= 10),
post AS (SELECT query_id, budget, doc_id, row_number() OVER (PARTITION BY query_id, budget ORDER BY rank) AS rank FROM dense, (VALUES (10), (40), (100), (400)) b(budget) WHERE rank <= budget AND same),
kind AS (SELECT * FROM (SELECT s.query_id, s.doc_id, row_number() OVER (PARTITION BY s.query_id ORDER BY (v.kind = 'k0') DESC, s.score DESC, s.doc_id) AS rank FROM s JOIN v ON v.id = s.doc_id) WHERE rank <= 100),
fused AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 12) AS score, min(l * 1000 + rank) AS first FROM (SELECT query_id, doc_id, rank, 0 AS l FROM dense WHERE rank <= 100 UNION ALL SELECT query_id, doc_id, rank, 1 FROM kind) GROUP BY 1, 2),
rrf AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM fused) WHERE rank <= 100)"""


def _vectors(spark, sf_dir):
    rows = view(spark, sf_dir, "vectors").select(F.col("vec_id").alias("doc_id"), "repo", "kind", dense.unit(F.col("embedding")).alias("vector"))
    return rows, rows.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")


def _others(ranked, k):
    """Without the query's own row, ranks closed up."""
    own = ranked.where("query_id <> doc_id")
    return bm25.top_k(own.drop("rank"), k)


def _dense(spark, sf_dir, k, same=None):
    docs, queries = _vectors(spark, sf_dir)
    return _others(dense.top_k(docs, queries, k + 1, same), k)


def _gold(spark, sf_dir):
    docs, queries = _vectors(spark, sf_dir)
    d, q = docs.alias("d"), queries.alias("q")
    # the next id of the label: a window over ids, not a join of all with all
    after = F.lead("doc_id").over(dense.Window.partitionBy("repo").orderBy("doc_id"))
    return docs.select("doc_id", after.alias("next")).where("doc_id % 10 = 0 and next is not null").select(F.col("doc_id").alias("query_id"), F.col("next").alias("doc_id"))


@query(_DENSE + " SELECT query_id, doc_id, rank FROM dense WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 10).select("query_id", "doc_id", "rank")


@query(_DENSE + " SELECT query_id, doc_id, rank FROM pre")
def dense_prefilter(spark, sf_dir):
    return _dense(spark, sf_dir, 10, "repo").select("query_id", "doc_id", "rank")


def _ball_search(spark, sf_dir, k, same=None):
    """The same search over a stored index of balls, built once an application and set of files."""
    docs, queries = _vectors(spark, sf_dir)
    held = (spark.sparkContext.applicationId, same, *sorted(_table(spark, sf_dir, "embeddings").inputFiles()))
    if held not in _INDEXES:
        path = f"{shared_dir(spark)}/tessera-index-{uuid.uuid4().hex}"
        balls.write_index(docs, path, same)
        _INDEXES[held] = path
    return _others(balls.search_all(spark, _INDEXES[held], queries, k + 1, same), k)


@query(ORACLE_SQL["dense_topk"])
def dense_balls(spark, sf_dir):
    return _ball_search(spark, sf_dir, 10).select("query_id", "doc_id", "rank")


@query(ORACLE_SQL["dense_prefilter"])
def dense_balls_prefilter(spark, sf_dir):
    return _ball_search(spark, sf_dir, 10, "repo").select("query_id", "doc_id", "rank")


@query(_DENSE + """, share AS (SELECT query_id, avg(same::INT) AS share FROM s GROUP BY 1),
got AS (SELECT query_id, budget, count(*) AS returned, list(doc_id) AS docs FROM post WHERE rank <= 10 GROUP BY 1, 2)
SELECT budget, round(avg(coalesce(list_contains(docs, doc_id)::INT, 0)), 9) AS recall, round(avg(coalesce(returned, 0)), 9) AS mean_returned, round(avg((coalesce(returned, 0) < 10)::INT), 9) AS share_short, round(avg(share), 9) AS selectivity
FROM (SELECT * FROM gold, (VALUES (10), (40), (100), (400)) b(budget)) LEFT JOIN got USING (query_id, budget) LEFT JOIN share USING (query_id) GROUP BY budget""")
def dense_postfilter(spark, sf_dir):
    docs, queries = _vectors(spark, sf_dir)
    budgets = [10, 40, 100, 400]
    kept = dense.after_filter(_dense(spark, sf_dir, 400), docs, queries, "repo", budgets)
    sizes = docs.groupBy("repo").agg(F.count("*").alias("m"))
    total = docs.agg(F.count("*").alias("t"))
    share = queries.select("query_id", "repo").join(sizes, "repo").crossJoin(F.broadcast(total)).select("query_id", ((F.col("m") - 1) / (F.col("t") - 1)).alias("share"))
    return metrics.filter_rows(kept, _gold(spark, sf_dir), budgets, share)


def _by_kind(spark, sf_dir, k=100):
    """A second list: documents of kind k0 first, each part by score."""
    docs, queries = _vectors(spark, sf_dir)
    first = docs.where("kind = 'k0'")
    rest = docs.where("kind <> 'k0'")
    a = _others(dense.top_k(first, queries, k + 1), k).withColumn("part", F.lit(0))
    b = _others(dense.top_k(rest, queries, k + 1), k).withColumn("part", F.lit(1))
    order = dense.Window.partitionBy("query_id").orderBy("part", "rank")
    both = a.unionByName(b).withColumn("new", F.row_number().over(order))
    return both.where(F.col("new") <= k).select("query_id", "doc_id", F.col("new").alias("rank"))


def _lists(spark, sf_dir):
    """Both lists, written once, and their fusion."""
    both = [materialized(ranked.select("query_id", "doc_id", "rank")) for ranked in (_dense(spark, sf_dir, 100), _by_kind(spark, sf_dir))]
    return both, fusion.reciprocal_rank_fusion(both)


@query(_DENSE + " SELECT query_id, doc_id, rank FROM rrf WHERE rank <= 20")
def rrf_fuse(spark, sf_dir):
    return _lists(spark, sf_dir)[1].where("rank <= 20").select("query_id", "doc_id", "rank")


_ALL = "(SELECT 'dense' AS retriever, query_id, doc_id, rank FROM dense WHERE rank <= 100 UNION ALL SELECT 'bm25', query_id, doc_id, rank FROM kind UNION ALL SELECT 'rrf', query_id, doc_id, rank FROM rrf)"
_BY_CONFIG = _DENSE + f""", r AS (SELECT c.retriever, g.query_id, a.rank FROM gold g CROSS JOIN (VALUES ('dense'), ('bm25'), ('rrf')) c(retriever) LEFT JOIN {_ALL} a ON a.retriever = c.retriever AND a.query_id = g.query_id AND a.doc_id = g.doc_id)"""


def _ranks(spark, sf_dir):
    """Gold ranks of three retrievers; the list by kind stands in for the word index."""
    (near, by_kind), fused = _lists(spark, sf_dir)
    lists = {"dense": near, "bm25": by_kind, "rrf": fused}
    rows = None
    for name, ranked in lists.items():
        own = ranked.select(F.lit(name).alias("retriever"), "query_id", "doc_id", "rank")
        rows = own if rows is None else rows.unionByName(own)
    return metrics.gold_ranks(rows, _gold(spark, sf_dir), "retriever")


@query(_BY_CONFIG + f", t AS (SELECT retriever, {_RECALL} FROM r GROUP BY retriever) SELECT *, round(1.96 * sqrt(recall_10 * (1 - recall_10) / n), 9) AS half_width FROM t")
def recall_by_config(spark, sf_dir):
    recalls = metrics.recall_at(_ranks(spark, sf_dir), "retriever")
    return recalls.withColumn("half_width", F.round(metrics.interval(F.col("recall_10"), F.col("n")), 9))


@query(_BY_CONFIG + " SELECT retriever, v.repo, count(*) AS n, round(avg(coalesce((rank <= 10)::INT, 0)), 9) AS recall_10 FROM r JOIN v ON v.id = r.query_id GROUP BY 1, 2")
def recall_per_repo(spark, sf_dir):
    _, queries = _vectors(spark, sf_dir)
    return metrics.recall_at(_ranks(spark, sf_dir).join(queries.select("query_id", "repo"), "query_id"), "retriever", "repo", ks=(10,))


@query(_BY_CONFIG + """, t AS (SELECT retriever, count(*) AS n, round(avg(coalesce((rank <= 10)::INT, 0)), 9) AS r10 FROM r GROUP BY 1),
w AS (SELECT max(r10) FILTER (retriever = 'bm25') AS b, max(r10) FILTER (retriever = 'dense') AS d, max(r10) FILTER (retriever = 'rrf') AS f, max(n) AS n FROM t),
g AS (SELECT round(f - greatest(b, d), 9) AS gap, round(1.96 * sqrt(greatest(b, d) * (1 - greatest(b, d)) / n), 9) AS margin FROM w)
SELECT 'm64' AS model, gap, margin, CASE WHEN gap > margin THEN 'earns it' WHEN gap < -margin THEN 'loses' ELSE 'no clear gain' END AS verdict FROM g""")
def fusion_verdict(spark, sf_dir):
    recalls = metrics.recall_at(_ranks(spark, sf_dir), "retriever").withColumn("model", F.when(F.col("retriever") != "bm25", "m64"))
    return metrics.fusion_verdict(recalls)


@query(_DENSE + """, top AS (SELECT query_id, doc_id, rank, (doc_id % 17) / 17.0 AS score FROM dense WHERE rank <= 30),
d AS (SELECT depth, t.*, row_number() OVER (PARTITION BY depth, query_id ORDER BY score DESC, rank) AS new_rank FROM top t, (VALUES (5), (10), (20), (30)) x(depth) WHERE rank <= depth)
SELECT x.depth, count(*) AS n, round(avg(coalesce((new_rank <= 5)::INT, 0)), 9) AS recall_5, round(avg(coalesce((new_rank <= 10)::INT, 0)), 9) AS recall_10
FROM gold g CROSS JOIN (VALUES (5), (10), (20), (30)) x(depth) LEFT JOIN d ON d.depth = x.depth AND d.query_id = g.query_id AND d.doc_id = g.doc_id GROUP BY x.depth""")
def rerank_plateau(spark, sf_dir):
    scored = _dense(spark, sf_dir, 30).withColumn("score", (F.col("doc_id") % 17) / 17.0)
    return metrics.recall_at(metrics.gold_ranks(fusion.reranked(scored, [5, 10, 20, 30]), _gold(spark, sf_dir), "depth"), "depth", ks=(5, 10))


@query(_BM25 + """, w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS q FROM benchmark),
s AS (SELECT b.query_id, b.doc_id, b.rank, len(list_intersect(q, list_distinct(regexp_split_to_array(lower(d.text), '\\s+')))) / len(q) AS overlap FROM bm25 b JOIN documents d USING (doc_id) JOIN w ON w.item_id = b.query_id WHERE rank <= 10)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank) AS rank FROM s""")
def rerank_by_overlap(spark, sf_dir):
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = _bm25(spark, sf_dir, 10).join(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(queries, "query_id")
    scored = found.select("query_id", "doc_id", "rank", fusion.word_overlap(F.col("query"), F.col("text")).alias("score"))
    return fusion.reranked(scored, [10]).select("query_id", "doc_id", "rank")


@query(_DENSE + """, rel AS (SELECT q.id AS query_id, v.id AS doc_id, v.id % 4 AS gain FROM q JOIN v ON v.repo = q.repo AND v.id <> q.id AND v.id % 5 = 1),
dcg AS (SELECT query_id, sum(gain / log2(rank + 1)) AS dcg, count(*) FILTER (gain > 0) AS hits FROM dense JOIN rel USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1),
ideal AS (SELECT query_id, sum(gain / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS r FROM rel) WHERE r <= 10 GROUP BY 1),
e AS (SELECT CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END AS v, (coalesce(hits, 0) > 0)::INT AS hit FROM ideal LEFT JOIN dcg USING (query_id))
SELECT round(avg(v), 9) AS ndcg, round(1.96 * stddev_samp(v) / sqrt(count(*)), 9) AS half_width, round(avg(hit), 9) AS hit_rate, count(*) AS n FROM e""")
def ndcg_at_10(spark, sf_dir):
    docs, queries = _vectors(spark, sf_dir)
    judged = docs.where("doc_id % 5 = 1").select("doc_id", "repo", (F.col("doc_id") % 4).alias("gain"))
    asked = queries.select("query_id", "repo")
    # the ideal comes from the 11 best of a label, less the query itself; only ranked rows meet their judgements
    best = judged.withColumn("r", F.row_number().over(dense.Window.partitionBy("repo").orderBy(F.col("gain").desc(), "doc_id"))).where("r <= 11")
    best = best.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("r", "doc_id", "gain"))).alias("best"))  # 11 entries
    own = F.filter("best", lambda x: x["doc_id"] != F.col("query_id"))
    ideal = asked.join(best, "repo").select("query_id", F.slice(F.transform(own, lambda x: x["gain"]), 1, 10).alias("gains")).where(F.size("gains") > 0)
    found = _dense(spark, sf_dir, 10).join(asked, "query_id").join(judged, ["doc_id", "repo"]).select("query_id", "rank", "gain")
    return metrics.ndcg(found, ideal)


@query(ctes("units") + """, t AS (SELECT kind, len(regexp_extract_all(text, '[^ \\n\\t]+')) AS tokens FROM units)
SELECT kind, count(*) AS n, round(avg((tokens > 512)::INT), 9) AS over_512, round(avg((tokens > 1000)::INT), 9) AS over_window, median(tokens) AS median_tokens FROM t GROUP BY GROUPING SETS ((kind), ())""")
def overflow_by_kind(spark, sf_dir):
    counted = view(spark, sf_dir, "units").select("kind", F.regexp_count("text", F.lit("[^ \\n\\t]+")).alias("tokens"))
    return metrics.overflow(counted, 1000)


@query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS nth, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value <> 0)
SELECT event_type, median(value) AS p50, max(value) FILTER (nth = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) AS p95, max(value) AS most, count(*) AS n FROM s GROUP BY 1""")
def latency_percentiles(spark, sf_dir):
    return metrics.percentiles(_table(spark, sf_dir, "events"), "value", "event_type", skip_zero=True)
