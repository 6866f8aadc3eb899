"""Queries from texts to units, vectors and models, and over files that are written and read back, with SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F


from tessera.operators import assembly, chunking, dense, fusion
from tessera.operators.places import block_digest
from tessera.plans.retrieval_queries import _BM25, _bm25, _table
from tessera.plans.store_queries import rerank_candidates
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


# ---- texts to vectors to hits


def word_lengths(dim: int = 16):
    """An encoder that SQL can follow: how many words have each length, modulo dim, at length 1."""

    def make():
        def encode(texts: list[str]) -> list[list[float]]:
            out = []
            for said in texts:
                counts = [0] * dim
                for word in said.split(" "):
                    if word:
                        counts[len(word) % dim] += 1
                norm = math.sqrt(sum(x * x for x in counts)) or 1.0
                out.append([x / norm for x in counts])
            return out

        return encode

    return make


_VECTORS = ctes("comments") + """, c AS (SELECT id, turn, CASE WHEN turn % 2 = 0 THEN body ELSE diff_hunk || ' ' || body END AS said, diff_hunk FROM comments WHERE body <> ''),
told AS (SELECT id, 'd' AS part, said FROM c UNION ALL SELECT id, 'q', diff_hunk FROM c WHERE turn = 1),
n AS (SELECT id, part, list_transform(range(0, 16), lambda d: len(list_filter(string_split(said, ' '), lambda w: w <> '' AND length(w) % 16 = d))) AS v FROM told),
e AS (SELECT id, part, list_transform(v, lambda x: CAST(CAST(x / coalesce(nullif(sqrt(list_sum(list_transform(v, lambda y: y * y))), 0), 1) AS FLOAT) AS DOUBLE)) AS e FROM n)"""


@query(_VECTORS + """, s AS (SELECT q.id AS query_id, d.id AS doc_id, round(list_inner_product(q.e, d.e), 12) AS score FROM e q JOIN e d ON q.part = 'q' AND d.part = 'd')
SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def embedded_search(spark, sf_dir):
    """Comments embedded and stored, the missing ones in a second run; comments are found by the vectors of their bodies."""
    root, rows = _folder(spark), view(spark, sf_dir, "comments").where("body <> ''")
    key = F.col("id").cast("string").alias("id")
    whole = rows.select(key, F.concat("diff_hunk", F.lit(" "), "body").alias("text"))
    bodies = rows.select(F.concat(F.lit("body/"), F.col("id").cast("string")).alias("id"), F.col("body").alias("text"))
    texts = whole.unionByName(bodies)
    wanted = texts.select("id", F.lit("words").alias("fingerprint"))
    stored = lambda df: dense.embed(df, word_lengths()).withColumns({"model": F.lit("m"), "fingerprint": F.lit("words")})
    corpus_files.write_vectors(stored(texts.where("crc32(id) % 5 <> 0")), root)
    todo = dense.stale(wanted, corpus_files.read_vectors(spark, root, "m", "words"))
    corpus_files.write_vectors(stored(texts.join(todo.select("id"), "id", "left_semi")), root)
    vectors = corpus_files.read_vectors(spark, root, "m", "words", wanted=wanted)
    docs = rows.select(key, F.when(F.col("turn") % 2 == 0, "review_comment").otherwise("doc").alias("kind"))
    exact = lambda df: df.withColumn("vector", F.transform("vector", lambda x: x.cast("double")))
    matrix = exact(dense.document_matrix(vectors, docs, True)).select(F.col("id").cast("long").alias("doc_id"), "vector")
    asked = dense.embed(rows.where("turn = 1").select("id", F.col("diff_hunk").alias("text")), word_lengths())
    return dense.top_k(matrix, exact(asked).select(F.col("id").alias("query_id"), "vector"), 5).select("query_id", "doc_id", "rank")


@query(_BM25 + """, w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS q FROM benchmark),
s AS (SELECT b.query_id, b.doc_id, b.rank, len(list_intersect(q, list_distinct(regexp_split_to_array(lower(d.text), '\\s+')))) AS score FROM bm25 b JOIN documents d USING (doc_id) JOIN w ON w.item_id = b.query_id WHERE rank <= 20),
d AS (SELECT depth, s.*, row_number() OVER (PARTITION BY depth, query_id ORDER BY score DESC, rank) AS new_rank FROM s, (VALUES (5), (20)) x(depth) WHERE rank <= depth)
SELECT depth, query_id, doc_id, new_rank AS rank FROM d""")
def rerank_by_model(spark, sf_dir):
    """A reranker behind the model protocol, loaded once a worker: it counts common words."""
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = _bm25(spark, sf_dir, 20).select("query_id", "doc_id", "rank")
    pairs = found.join(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(queries, "query_id").select("query_id", "doc_id", "query", "text")
    scored = fusion.model_scores(pairs, lambda: lambda told: [len(set(q.lower().split()) & set(t.lower().split())) for q, t in told])
    return fusion.reranked(found.join(scored, ["query_id", "doc_id"]), [5, 20])


def _candidates_sql() -> str:
    from tessera.plans.store_queries import ORACLE_SQL as sql

    return sql["rerank_candidates"]


@query("SELECT sha256(sha256(sha256(string_agg(sha256(query_id || '|' || candidates || '|' || coalesce(CAST(gold AS VARCHAR), '')), chr(10) ORDER BY query_id)))) AS digest FROM (" + _candidates_sql() + ")")
def rerank_fingerprint(spark, sf_dir):
    """The digest of what a reranker is given, so that two rounds can be told to have had the same."""
    lists = rerank_candidates(spark, sf_dir)
    return block_digest(lists, ["query_id"], F.concat_ws("|", F.col("query_id").cast("string"), "candidates", F.coalesce(F.col("gold").cast("string"), F.lit(""))))


# ---- units and files

_UNIT = "sha256('one' || chr(0) || '{0}' || chr(0) || {1}) AS unit_id, '{0}' AS kind"


@query(ctes("comments") + f""", p AS (SELECT DISTINCT conv_id FROM conversations), recent AS (SELECT conv_id FROM p ORDER BY conv_id DESC LIMIT 40)
SELECT {_UNIT.format('source', "'pkg/d' || doc_id || '.cfg##0'")}, sha256('said ' || doc_id) AS said FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT {_UNIT.format('doc', "'pkg/d' || doc_id || '.rst##0'")}, sha256('said ' || doc_id) FROM documents WHERE doc_id % 2 = 1
UNION ALL SELECT {_UNIT.format('review_comment', "'review_comment/' || id")}, sha256(trim(body, ' ' || chr(10))) FROM comments WHERE trim(body, ' ' || chr(10)) <> '' AND turn > 0
UNION ALL SELECT {_UNIT.format('pull_request', "'pull/' || conv_id")}, sha256('change ' || conv_id || chr(10) || chr(10) || 'why') FROM recent WHERE conv_id % 7 <> 0
UNION ALL SELECT {_UNIT.format('issue', "'issue/' || conv_id")}, sha256('fault ' || conv_id) FROM recent WHERE conv_id % 3 <> 0""")
def all_units(spark, sf_dir):
    """The five kinds of units in one table: files, comments, merged pulls and issues of the most recent forty."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat(F.lit("pkg/d"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".cfg").otherwise(".rst"))
    files = chunking.file_units(docs.select(F.lit("one").alias("repo"), path.alias("path"), F.concat(F.lit("said "), "doc_id").alias("content")))
    none = F.lit(None).cast("string")
    comments = view(spark, sf_dir, "comments").where("turn > 0").select(
        "id", none.alias("path"), none.alias("diff_hunk"), "body", "login", "pull_request_url", F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("original_line"), none.alias("commit_id"), F.lit("one").alias("repo"),
    )
    n = F.col("conv_id")
    pulls = _table(spark, sf_dir, "conversations").select("conv_id").distinct().select(n.cast("int").alias("number"), F.lpad(n.cast("string"), 12, "0").alias("updated_at"), F.when(n % 7 != 0, "2024").otherwise("").alias("merged_at"), F.when(n % 3 == 0, F.struct(F.lit("u").alias("url"))).alias("pull_request"))
    changes = pulls.select("number", "updated_at", "merged_at", F.concat(F.lit("change "), "number").alias("title"), F.lit(" why\n").alias("body"), none.alias("merge_commit_sha"))
    faults = pulls.select("number", "updated_at", "pull_request", F.concat(F.lit("fault "), "number").alias("title"), none.alias("body"))
    kinds = [files, corpus_files.comment_units(comments).where("text <> ''"), corpus_files.pull_units(changes, "one", 40), corpus_files.issue_units(faults, "one", 40)]
    rows = [df.select("unit_id", "kind", F.sha2("text", 256).alias("said")) for df in kinds]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("""SELECT 'r' || s_nationkey AS repo, CASE WHEN s_nationkey % 4 = 0 THEN 'timeout' WHEN s_nationkey % 4 = 1 THEN 'failed' ELSE 'passed' END AS outcome, CASE WHEN s_nationkey % 5 <> 0 THEN 'pytest' END AS framework,
 CAST(count(*) AS DOUBLE) AS run_seconds, CAST(s_nationkey % 3 AS INTEGER) AS dropped FROM supplier GROUP BY s_nationkey""")
def result_rows(spark, sf_dir):
    """Result rows of repositories, written one JSON object a file and read back."""
    root, n = _folder(spark), F.col("s_nationkey")
    rows = _table(spark, sf_dir, "supplier").groupBy(n).agg(F.count("*").cast("double").alias("run_seconds")).select(
        n.alias("file"), F.concat(F.lit("r"), n).alias("repo"), F.when(n % 4 == 0, "timeout").when(n % 4 == 1, "failed").otherwise("passed").alias("outcome"), F.when(n % 5 != 0, "pytest").alias("framework"), "run_seconds",
        F.array_repeat(F.lit("dependency"), (n % 3).cast("int")).alias("dropped"),
    )
    rows.repartition("file").write.partitionBy("file").json(root)
    return corpus_files.read_results(spark, root).select("repo", "outcome", "framework", "run_seconds", F.size("dropped").alias("dropped"))


@query("""WITH t AS (SELECT doc_id % 97 AS folder, string_agg(text || chr(10), '' ORDER BY doc_id) AS content FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT CAST(folder AS INTEGER) AS folder, sha256(content) AS said FROM t WHERE strlen(content) <= 30000""")
def tree_files(spark, sf_dir):
    """Documents written as a tree of text files, and the files of at most 30,000 bytes read from it."""
    root = _folder(spark)
    rows = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", (F.col("doc_id") % 97).alias("folder"), F.col("text").alias("value"))
    rows.repartition("folder").sortWithinPartitions("folder", "doc_id").select("folder", "value").write.partitionBy("folder").text(root)
    tree = corpus_files.read_tree(spark, root, "one", max_bytes=30_000)
    return tree.select(F.regexp_extract("path", "folder=([0-9]+)/", 1).cast("int").alias("folder"), F.sha2("content", 256).alias("said"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, 'd' || doc_id || '.py' || chr(10) || array_to_string(list_transform(range(1, least(len(l), 80) + 1), lambda i: lpad(CAST(i AS VARCHAR), 5, ' ') || ' + ' || CASE WHEN length(l[i]) > 200 THEN substr(l[i], 1, 200) || ' [cut]' ELSE l[i] END), chr(10))
 || CASE WHEN len(l) > 80 THEN chr(10) || '      ... ' || (len(l) - 80) || ' more lines of this hunk not shown' ELSE '' END AS t FROM l)
SELECT doc_id, md5(t) AS rendering, CAST(length(t) AS INTEGER) AS chars FROM r""")
def long_lines(spark, sf_dir):
    """Whole documents as hunks of added lines: lines of over 200 characters are clipped, and hunks of over 80 lines are cut."""
    docs = _table(spark, sf_dir, "documents").where("text is not null")
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("+"), x))
    hunks = docs.select("doc_id", F.concat(F.lit("d"), "doc_id", F.lit(".py")).alias("path"), F.lit(1).cast("long").alias("new_start"), lines.alias("lines")).withColumns({"new_lines": F.size("lines"), "position": F.col("doc_id")})
    return assembly.rendered(hunks, "doc_id").select("doc_id", F.md5("rendering").alias("rendering"), F.length("rendering").alias("chars"))
