"""Queries that write to the shared folder and read back: corpora, listings, benchmarks, vectors, frozen sets, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import ids, text
from tessera.operators import assembly, bm25, corpus, fusion
from tessera.plans.retrieval_queries import _BM25, _DENSE, _bm25, _dense, _gold, _passage_gold, _table
from tessera.plans.views import ctes, view
from tessera.session import shared_dir
from tessera.sources import corpus_files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


def _units(spark, sf_dir):
    rows = view(spark, sf_dir, "units").withColumn("unit_id", ids.unit_id(F.col("repo"), F.col("kind"), F.col("identity")))
    return rows.select("unit_id", "repo", "kind", "path", "identity", "text", ids.body_fingerprint(F.col("text")).alias("content_hash"), F.col("doc_id").alias("nth"))


_UNITS = ctes("units") + ", u AS (SELECT doc_id, repo, kind, path, sha256(repo || chr(0) || kind || chr(0) || identity) AS unit_id, text FROM units)"


@query(_UNITS + " SELECT unit_id, repo, kind, path, sha256(text) AS body_hash FROM u")
def corpus_round_trip(spark, sf_dir):
    """Shards written and read back through their manifest."""
    root = _folder(spark)
    manifest = corpus_files.write_corpus(_units(spark, sf_dir).drop("identity", "nth"), root)
    found = corpus_files.read_corpus(spark, root, manifest)
    return found.select("unit_id", "repo", "kind", "path", ids.body_fingerprint(F.col("text")).alias("body_hash"))


@query(_UNITS + """, old AS (SELECT repo, kind, unit_id FROM u WHERE doc_id % 7 <> 0), new AS (SELECT repo, kind, unit_id, doc_id % 9 = 0 AS changed FROM u WHERE doc_id % 8 <> 0),
a AS (SELECT n.repo, CASE WHEN o.unit_id IS NULL THEN 'inserted' WHEN changed THEN 'updated' ELSE 'unchanged' END AS action FROM new n LEFT JOIN old o USING (unit_id)
  UNION ALL SELECT o.repo, 'pruned' FROM old o WHERE kind IN ('source', 'doc') AND unit_id NOT IN (SELECT unit_id FROM new) AND repo IN (SELECT repo FROM new WHERE kind IN ('source', 'doc')))
SELECT repo, count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'unchanged') AS unchanged, count(*) FILTER (action = 'pruned') AS pruned,
 count(*) FILTER (action IN ('inserted', 'updated')) = 0 AS wrote_nothing FROM a GROUP BY repo""")
def ingest_twice(spark, sf_dir):
    """Two ingests in order: the first into an empty index, the second over the snapshot that the first wrote."""
    root, units = _folder(spark), _units(spark, sf_dir)
    empty = units.limit(0).select("unit_id", "repo", "kind", "content_hash", F.lit("").alias("ref"), F.lit(0).alias("updated_at"))
    manifest, index, _ = corpus_files.ingest(units.where("nth % 7 <> 0").withColumn("ref", F.lit("ref1")), empty, root, F.lit(1))
    corpus_files.write_index(index, f"{root}/index")
    changed = F.when(F.col("nth") % 9 == 0, ids.body_fingerprint(F.concat("text", F.lit("!")))).otherwise(F.col("content_hash"))
    again = units.where("nth % 8 <> 0").withColumn("content_hash", changed).withColumn("ref", F.lit("ref2"))
    return corpus_files.ingest(again, corpus_files.read_index(spark, f"{root}/index"), root, F.lit(2), manifest)[2]


@query(ctes("comments") + """ SELECT sha256('one' || chr(0) || 'review_comment' || chr(0) || 'review_comment/' || id) AS unit_id, path, turn AS start_line,
 sha256(array_to_string(list_filter([coalesce(path || ':' || turn, ''), trim(diff_hunk, ' ' || chr(10)), trim(body, ' ' || chr(10))], lambda x: x <> ''), chr(10) || chr(10))) AS said FROM comments WHERE body <> '' AND turn > 0""")
def comment_listing(spark, sf_dir):
    """Comments written as a listing of payloads, read by its schema, made to units."""
    root = _folder(spark)
    rows = view(spark, sf_dir, "comments").where("turn > 0").select("id", "path", "diff_hunk", "body", F.struct("login", F.col("user_type").alias("type")).alias("user"), "pull_request_url", F.col("turn").cast("int").alias("line"))
    rows.write.json(root)
    return corpus_files.comment_units(corpus_files.read_comments(spark, root, "one")).select("unit_id", "path", "start_line", F.sha2("text", 256).alias("said"))


@query(_BM25 + """, d AS (SELECT doc_id FROM documents), judged AS (SELECT DISTINCT query_id FROM gold)
SELECT b.query_id, b.doc_id, b.rank, CAST(CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS gain FROM bm25 b JOIN judged USING (query_id) LEFT JOIN gold g ON g.query_id = b.query_id AND g.doc_id = b.doc_id WHERE rank <= 10""")
def benchmark_run(spark, sf_dir):
    """A benchmark written as corpus, queries and judgements, read back, and ranked; queries without judgements are left out."""
    root = _folder(spark)
    _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"), F.lit(None).cast("string").alias("title"), "text").write.parquet(f"{root}/corpus")
    _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("_id"), "text", F.lit("test").alias("partition")).write.parquet(f"{root}/queries")
    _passage_gold(spark, sf_dir).select(F.col("query_id").alias("query-id"), F.col("doc_id").alias("corpus-id"), F.lit(1).alias("score")).write.parquet(f"{root}/qrels")
    docs, queries, qrels = corpus_files.read_benchmark(spark, root)
    asked = queries.select(F.explode(text.tokens(F.col("query"))).alias("term"))
    found = bm25.top_scores(bm25.index(docs, only=asked), queries, 10)
    return found.join(qrels, ["query_id", "doc_id"], "left").select("query_id", "doc_id", "rank", F.coalesce("gain", F.lit(0)).alias("gain"))


@query("SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dim, CAST(vec_id % 3 AS INTEGER) AS tokens FROM embeddings WHERE vec_id % 2 = 0")
def vector_store(spark, sf_dir):
    """Vectors of two models written, one of them twice; a store that lacks nothing is read."""
    root = _folder(spark)
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("vector"), (F.col("vec_id") % 3).cast("int").alias("tokens"), F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd").alias("model"), F.lit("f").alias("fingerprint"))
    corpus_files.write_vectors(rows, root)
    corpus_files.write_vectors(rows.where("model = 'even'"), root, held=corpus_files.read_vectors(spark, root, "even"))
    held = corpus_files.read_vectors(spark, root, "even", wanted=rows.where("model = 'even'").select("id", "fingerprint"))
    return held.select(F.col("id").cast("long").alias("id"), F.size("vector").alias("dim"), "tokens")


@query("SELECT doc_id, sha256(text) AS said FROM documents")
def frozen_set(spark, sf_dir):
    """A set frozen, frozen again with other rows, which changes nothing, and read back by its digest."""
    path, docs = _folder(spark), _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("said"))
    corpus_files.freeze(docs, path, ["doc_id"])
    corpus_files.freeze(docs.withColumn("said", F.lit("")), path, ["doc_id"])
    return corpus_files.read_frozen(spark, path, ["doc_id"])


@query(_BM25 + """, few AS (SELECT item_id AS query_id FROM benchmark), own AS (SELECT query_id, doc_id, score, rank FROM bm25 WHERE rank <= 2 AND doc_id % 3 = 0),
fill AS (SELECT query_id, doc_id, 0.0::DOUBLE AS score FROM few, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 5) WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM own)),
every AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY own DESC, rank, doc_id) AS rank FROM (SELECT query_id, doc_id, rank, 1 AS own FROM own UNION ALL SELECT query_id, doc_id, 0, 0 FROM fill))
SELECT query_id, doc_id, rank FROM every WHERE rank <= 5""")
def padded_topk(spark, sf_dir):
    """Lists that are too short are filled up with unmatched documents."""
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    found = _bm25(spark, sf_dir, 2).where("doc_id % 3 = 0")
    return bm25.padded(found, queries, _table(spark, sf_dir, "documents"), 5).select("query_id", "doc_id", "rank")


@query(_DENSE + """, s10 AS (SELECT id AS query_id FROM q ORDER BY sha256('rerank|' || id), id LIMIT 10)
SELECT d.query_id, array_to_string(list(d.doc_id ORDER BY d.rank), ',') AS candidates, any_value(g.doc_id) AS gold FROM dense d JOIN s10 USING (query_id) LEFT JOIN gold g ON g.query_id = d.query_id WHERE d.rank <= 30 GROUP BY 1""")
def rerank_candidates(spark, sf_dir):
    """A fixed sample's first 30 candidates with what they should find: what a reranker is given."""
    asked = _table(spark, sf_dir, "embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"))
    lists = fusion.candidate_lists(_dense(spark, sf_dir, 30), _gold(spark, sf_dir), ids.sample(asked, "rerank", "query_id", 10))
    return lists.select("query_id", F.array_join(F.transform("candidates", lambda x: x.cast("string")), ",").alias("candidates"), "gold")


@query(ctes("units") + " SELECT repo, doc_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY doc_id DESC) AS nth FROM units) WHERE nth <= 30")
def listing_window(spark, sf_dir):
    """The most recent rows of each repository."""
    return corpus.latest(view(spark, sf_dir, "units"), "repo", [F.col("doc_id").desc()], 30).select("repo", "doc_id", "kind")


@query(ctes("drafts") + """, l AS (SELECT run_id, path, line, min(body) AS code FROM drafts WHERE position % 2 = 0 GROUP BY 1, 2, 3) SELECT run_id, position, coalesce(code, '') AS code FROM drafts LEFT JOIN l USING (run_id, path, line)""")
def drafted_code(spark, sf_dir):
    """Drafts beside the code of their line, empty where the diff lacks it."""
    drafts = view(spark, sf_dir, "drafts")
    lines = drafts.where("position % 2 = 0").select("run_id", "path", "line", F.col("body").alias("code"))
    return assembly.drafted_code(drafts.select("run_id", "position", "path", "line"), lines).select("run_id", "position", "code")


@query(ctes("drafts") + " SELECT run_id, CAST(sum(CASE WHEN line % 2 = 0 THEN position ELSE 0 END) AS BIGINT) AS past_shown FROM drafts GROUP BY run_id")
def past_comments_shown(spark, sf_dir):
    """Past comments that reached each run's prompt, from its renderings."""
    title = F.when(F.col("line") % 2 == 0, F.concat(F.lit("Past review comments in this repository, nearest first:\n"), "body")).otherwise(F.col("body"))
    return assembly.past_shown(view(spark, sf_dir, "drafts").select("run_id", title.alias("rendering"), F.col("position").alias("n_past")))
