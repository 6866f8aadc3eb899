"""Review-shaped views of the driver's tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL: dict[str, str] = {}

SQL["units"] = """
SELECT doc_id, source AS repo,
       CASE doc_id % 5 WHEN 0 THEN 'source' WHEN 1 THEN 'doc' WHEN 2 THEN 'pull_request' WHEN 3 THEN 'review_comment' ELSE 'issue' END AS kind,
       'doc/' || doc_id AS identity,
       CASE WHEN doc_id % 11 = 0 THEN 'vendor/' WHEN doc_id % 13 = 0 THEN 'pkg.egg-info/' ELSE 'pkg/' END || 'd' || doc_id
         || CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.rst' WHEN 3 THEN '.cfg' WHEN 4 THEN '' ELSE '.JSON' END AS path,
       text
FROM documents"""

# A hunk is the whole text before, in parts of q characters.
_TURNS = """
SELECT *, CAST(ceil(length(prev) / 4.0) AS INTEGER) AS q FROM (SELECT conv_id, turn, role, text, replace(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), text), chr(10), ' ') AS prev FROM conversations) AS said"""

SQL["comments"] = f"""
SELECT conv_id * 100 + turn AS id, 'r' || (conv_id % 10) AS repo,
       CASE WHEN turn % 3 = 2 THEN conv_id * 100 END AS in_reply_to_id,
       CASE WHEN role = 'system' THEN 'ci[bot]' WHEN role = 'assistant' THEN 'Rev' || (conv_id % 7) WHEN conv_id % 23 = 4 THEN 'CodeCov' ELSE 'dev' || (conv_id % 5) END AS login,
       CASE WHEN conv_id % 17 = 3 THEN 'Bot' ELSE 'User' END AS user_type,
       CASE WHEN turn % 11 <> 10 THEN 'src/m' || (conv_id % 13) || '.py' END AS path,
       CASE WHEN conv_id % 19 = 7 THEN '   '
            WHEN turn % 5 = 4 THEN '@@ -0,0 +1,2 @@' || chr(10) || '+' || substr(prev, 1, 2 * q) || chr(10) || '+' || substr(prev, 2 * q + 1, 2 * q)
            ELSE '@@ -' || (turn + 3) || ',3 +' || (turn + 3) || ',3 @@ def f' || (conv_id % 9) || chr(10) || ' ' || substr(prev, 1, q) || chr(10) || '-' || substr(prev, q + 1, q)
                 || chr(10) || '+' || substr(prev, 2 * q + 1, q) || chr(10) || ' ' || substr(prev, 3 * q + 1, q) END AS diff_hunk,
       CASE WHEN conv_id % 6 = 1 AND turn = 1 THEN '  LGTM, thanks for this!' WHEN conv_id % 6 = 2 AND turn = 1 THEN '!!! ???' WHEN conv_id % 6 = 3 AND turn = 1 THEN 'Please rename this.'
            WHEN conv_id % 6 = 4 AND turn = 1 THEN 'Nice, but ' || text WHEN conv_id % 12 = 5 AND turn = 1 THEN text || chr(10) || '```suggestion' || chr(10) || 'x = 1' || chr(10) || '```' ELSE text END AS body,
       'https://api.example.org/pulls/' || CASE WHEN conv_id % 29 = 11 THEN 'x' ELSE '' END || conv_id AS pull_request_url,
       conv_id, turn
FROM ({_TURNS}) AS turns"""

SQL["pulls"] = """
SELECT DISTINCT 'r' || (conv_id % 10) AS repo, conv_id AS number, conv_id % 7 <> 0 AS merged,
       CASE WHEN conv_id % 4 = 0 THEN 'REV' || (conv_id % 7) ELSE 'author' || (conv_id % 5) END AS author
FROM conversations"""

SQL["vectors"] = "SELECT vec_id, embedding, 'r' || label AS repo, 'k' || (vec_id % 3) AS kind FROM embeddings"

SQL["deliveries"] = """
SELECT event_id * 2 AS arrival, 'd' || event_id AS delivery_id, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'pull_request' ELSE 'issues' END AS event,
       CASE event_type WHEN 'view' THEN 'opened' WHEN 'click' THEN 'synchronize' WHEN 'purchase' THEN 'closed' ELSE 'created' END AS action,
       CASE WHEN event_id % 31 <> 0 THEN 'r' || (user_id % 20) END AS repo, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS pr, ts
FROM events
UNION ALL
SELECT event_id * 2 + 1, 'd' || event_id, 'pull_request', 'reopened', 'r' || (user_id % 20), 0, ts FROM events WHERE event_id % 10 = 0"""

SQL["runs"] = """
SELECT o_orderkey AS run_id, 'b' || (o_orderkey % 4) AS batch, 'r' || (o_custkey % 10) AS repo, o_custkey % 97 AS pr, 'sha' || o_custkey AS head_sha,
       CASE WHEN o_orderkey % 9 = 0 THEN 'nothing to say' END AS no_comment, o_orderdate AS started
FROM orders"""

SQL["drafts"] = """
SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS position,
       'src/m' || (l_partkey % 5) || '.py' AS path, CAST(l_suppkey % 7 + 1 AS INTEGER) AS line, l_quantity > 5 AS specific, l_discount >= 0.01 AS non_obvious,
       l_linenumber <> 7 AS grounded, l_returnflag, l_linestatus, l_quantity, 'body ' || l_partkey AS body
FROM lineitem"""

SQL["offers"] = """
SELECT 'r' || (l_suppkey % 10) AS repo, l_orderkey % 500 AS pr, 'src/m' || (l_partkey % 3) || '.py' AS path, CAST(l_suppkey % 5 + 1 AS INTEGER) AS line,
       row_number() OVER (PARTITION BY 'r' || (l_suppkey % 10), l_orderkey % 500 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nth
FROM lineitem"""

SQL["changed_files"] = """
SELECT doc_id, 'r' || (doc_id % 7) AS repo, doc_id % 50 AS pr,
       CASE doc_id % 9 WHEN 0 THEN 'tests/test_m' WHEN 1 THEN 'docs/d' WHEN 2 THEN 'vendor/lib/v' ELSE 'src/m' END || (doc_id % 40)
         || CASE doc_id % 8 WHEN 0 THEN '.md' WHEN 1 THEN '.lock' WHEN 2 THEN '.ts' ELSE '.py' END AS path,
       CASE doc_id % 12 WHEN 0 THEN 'removed' WHEN 1 THEN 'renamed' ELSE 'modified' END AS status, doc_id % 3 AS changes,
       CASE WHEN doc_id % 10 <> 3 THEN text END AS text, doc_id % 90 + 1 AS new_start
FROM documents"""


# DuckDB has no lookahead: a break is put between an acronym and the word after it first.
TOKENS = """list_filter(flatten(list_transform(regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), lambda w: list_concat([trim(lower(w), '_')],
  CASE WHEN len(regexp_extract_all(regexp_replace(w, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')) > 1 AND trim(lower(w), '_') <> ''
  THEN list_transform(regexp_extract_all(regexp_replace(w, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: lower(p)) ELSE [] END))), lambda t: t <> '')"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over sf_dir's tables."""
    sql = SQL[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "conversations", "embeddings", "events", "orders", "lineitem") if f"FROM {t}" in sql}
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **tables)


def ctes(*names: str) -> str:
    """WITH clauses of the views, for DuckDB."""
    return "WITH " + ", ".join(f"{name} AS ({SQL[name]})" for name in names)
