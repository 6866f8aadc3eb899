"""Queries on leakage, model choice, stored vectors, splits and ledger rules, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import bm25, dense, ledgers, metrics, pairs
from tessera.operators.places import parts
from tessera.plans.views import TOKENS, ctes, view
from tessera.session import materialized

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _bm25(name: str, docs: str) -> str:
    """CTEs that rank the documents (id, said) for the queries (id, query); the best 50 are in <name>."""
    return f""", {name}_tok AS (SELECT id, unnest({TOKENS.format('said')}) AS term FROM {docs}),
{name}_stats AS (SELECT (SELECT count(*) FROM {docs}) AS n, (SELECT count(*) FROM {name}_tok) / (SELECT count(*) FROM {docs}) AS mean),
{name}_tf AS (SELECT id, term, count(*) AS tf FROM {name}_tok GROUP BY 1, 2),
{name}_post AS (SELECT tf.id, tf.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS weight FROM {name}_tf tf
  JOIN (SELECT id, count(*) AS length FROM {name}_tok GROUP BY 1) USING (id) JOIN (SELECT term, count(*) AS df FROM {name}_tf GROUP BY 1) USING (term), {name}_stats),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, round(sum(weight), 9) AS score FROM asked JOIN {name}_post USING (term) GROUP BY 1, 2)) WHERE rank <= 50)"""


_LEAK = (
    ctes("comments")
    + f""", body_docs AS (SELECT id, body AS said FROM comments WHERE body <> ''), hunk_docs AS (SELECT id, coalesce(path || ' ', '') || diff_hunk || ' ' || body AS said FROM comments WHERE body <> ''),
asked AS (SELECT DISTINCT id AS query_id, unnest({TOKENS.format('diff_hunk')}) AS term FROM comments WHERE turn = 1 AND body <> '')"""
    + _bm25("b", "body_docs")
    + _bm25("h", "hunk_docs")
    + """, r AS (SELECT q.id, b.rank AS b, h.rank AS h FROM comments q LEFT JOIN b ON b.query_id = q.id AND b.id = q.id LEFT JOIN h ON h.query_id = q.id AND h.id = q.id WHERE turn = 1 AND body <> '')"""
)


def _serialised(spark, sf_dir):
    rows = materialized(view(spark, sf_dir, "comments").where("body <> ''").select("id", "turn", "path", "diff_hunk", "body"))
    queries = rows.where("turn = 1").select(F.col("id").alias("query_id"), F.col("diff_hunk").alias("query"))
    said = {"body_only": F.col("body"), "with_hunk": F.concat(F.coalesce(F.concat("path", F.lit(" ")), F.lit("")), "diff_hunk", F.lit(" "), "body")}
    gold = queries.select("query_id", F.col("query_id").alias("doc_id"))
    asked = queries.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("query")))).alias("term"))
    out = None
    for name, body in said.items():
        shares, rarity = bm25.share_arrays(rows.select(F.col("id").alias("doc_id"), body.alias("text")))
        places = bm25.gold_places(shares, asked.join(rarity, "term"), gold, 20)
        recalls = metrics.recall_at(gold.join(places, "query_id", "left"), ks=(10, 20)).select(F.lit("reviewed").alias("variant"), F.lit("bm25").alias("retriever"), F.lit(name).alias("serialisation"), "n", "recall_10", "recall_20")
        out = recalls if out is None else out.unionByName(recalls)
    return out


@query(_LEAK + """, t AS (SELECT round(avg(coalesce((h <= 10)::INT, 0)), 9) AS with_hunk, round(avg(coalesce((b <= 10)::INT, 0)), 9) AS body_only FROM r)
SELECT 'reviewed' AS variant, 'bm25' AS retriever, with_hunk, body_only, round(with_hunk - body_only, 9) AS gap FROM t""")
def leakage_gap(spark, sf_dir):
    return metrics.leakage_gap(_serialised(spark, sf_dir))


@query(_LEAK + """ SELECT CASE WHEN avg(coalesce((h <= 20)::INT, 0)) > avg(coalesce((b <= 20)::INT, 0)) THEN 'with_hunk' ELSE 'body_only' END AS model FROM r""")
def best_model(spark, sf_dir):
    """The serialisations stand for two models."""
    return metrics.best_model(_serialised(spark, sf_dir).select(F.col("serialisation").alias("model"), F.lit("rrf").alias("retriever"), "recall_20"))


@query("""SELECT 'v' || vec_id AS id, CASE WHEN vec_id % 10 = 1 THEN 'missing' WHEN vec_id % 10 = 2 THEN 'stale' WHEN vec_id % 10 = 3 THEN 'not finite' ELSE 'doubled' END AS fault FROM embeddings WHERE vec_id % 10 BETWEEN 1 AND 4
UNION ALL SELECT 'x' || vec_id, 'unexpected' FROM embeddings WHERE vec_id % 10 = 5""")
def vector_faults(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("m", F.col("vec_id") % 10)
    name = lambda p: F.concat(F.lit(p), F.col("vec_id").cast("string")).alias("id")
    wanted = rows.select(name("v"), F.lit("f1").alias("fingerprint"))
    vector = F.when(F.col("m") == 3, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding")).alias("vector")
    held = rows.where("m <> 1").select(name("v"), vector, F.when(F.col("m") == 2, "f0").otherwise("f1").alias("fingerprint"))
    more = rows.where("m = 4").select(name("v"), vector, F.lit("f1").alias("fingerprint")).unionByName(rows.where("m = 5").select(name("x"), vector, F.lit("f1").alias("fingerprint")))
    return dense.faults(wanted, held.unionByName(more))


@query("SELECT doc_id, source AS repo, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 4 AS part FROM documents")
def corpus_parts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("repo"))
    return parts(docs, ["doc_id"], ["repo"], 4)


@query(ctes("pulls") + " SELECT repo, number, CASE WHEN number % 3 = 0 THEN NOT merged ELSE merged END AS merged, author FROM pulls WHERE number % 2 = 0 AND number % 5 <> 0")
def pull_facts(spark, sf_dir):
    pulls = view(spark, sf_dir, "pulls")
    listed = pulls.where("number % 3 <> 0 and number % 5 <> 0")
    single = pulls.where("number % 5 <> 0").withColumn("merged", ~F.col("merged"))
    return pairs.pull_facts(pulls.where("number % 2 = 0"), listed, single)


@query("WITH r AS (SELECT DISTINCT source AS repo FROM documents) SELECT repo FROM r WHERE upper(repo) NOT IN (SELECT upper(source) FROM documents WHERE doc_id % 20 < 5)")
def refused_repos(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pairs.refused(docs.select(F.col("source").alias("repo")).distinct(), docs.where("doc_id % 20 < 5").select(F.upper("source").alias("repo")))


_MODES = ctes("runs") + """, m AS (SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 'live' ELSE 'replay' END AS mode, CASE WHEN run_id % 3 = 0 THEN 'd' || run_id END AS delivery_id, CASE WHEN run_id % 2 = 1 THEN batch END AS batch FROM runs)"""


@query(_MODES + " SELECT run_id, mode FROM m WHERE (mode = 'live') <> (delivery_id IS NOT NULL) OR (mode = 'replay') <> (batch IS NOT NULL)")
def mode_violations(spark, sf_dir):
    runs = view(spark, sf_dir, "runs")
    n = F.col("run_id")
    rows = runs.select("run_id", F.when(n % 2 == 0, "live").otherwise("replay").alias("mode"), F.when(n % 3 == 0, F.concat(F.lit("d"), n.cast("string"))).alias("delivery_id"), F.when(n % 2 == 1, F.col("batch")).alias("batch"))
    return ledgers.violations(rows).select("run_id", "mode")


@query(ctes("runs") + " SELECT run_id, batch FROM runs WHERE NOT (run_id % 4 = 1 AND run_id % 3 = 0)")
def released_claims(spark, sf_dir):
    held = view(spark, sf_dir, "runs").select("run_id", "batch", F.when(F.col("run_id") % 3 != 0, F.col("started")).alias("finished_at"))
    return ledgers.released(held, held.where("run_id % 4 = 1")).select("run_id", "batch")


@query(ctes("changed_files") + """ SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'own/r' || (doc_id % 5) || '#' || (doc_id + 1) END AS seed, CASE WHEN doc_id % 6 = 0 THEN 'draft' WHEN doc_id % 6 = 1 THEN 'bot' END AS skip_reason,
 CASE WHEN path LIKE 'tests/%' OR path LIKE 'docs/%' OR path LIKE '%.md' THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM changed_files""")
def pull_rules(spark, sf_dir):
    rows = view(spark, sf_dir, "changed_files")
    n = F.col("doc_id")
    branch = F.concat(F.lit("seed/own__r"), (n % 5).cast("string"), F.lit("/"), (n + 1).cast("string"), F.when(n % 4 == 1, "/base").otherwise("/head"))
    repo = F.when(n % 2 == 0, F.when(n % 4 == 0, "Own/Testbed").otherwise("own/other")).otherwise("own/testbed")
    seed = text.seed_source(F.when(n % 4 == 3, F.lit("x/y")).otherwise(repo), branch, "own/testbed")
    skip = text.pull_skip_reason(n % 6 == 0, F.when(n % 6 == 1, "renovate[bot]").otherwise("ann"))
    return rows.select("doc_id", F.concat(seed["repo"], F.lit("#"), seed["number"].cast("string")).alias("seed"), skip.alias("skip_reason"), text.path_weight(F.col("path")).alias("weight"))
