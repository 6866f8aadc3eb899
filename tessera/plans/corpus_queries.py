"""Queries on text, identity, pair mining and the corpus index, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ids, text
from tessera.operators import pairs
from tessera.plans.views import ctes, view

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- SQL twins of the text rules (DuckDB's \w is ASCII, so classes are spelt out)

_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_STATE = """array_to_string(list_filter(list_transform(string_split(diff_hunk, chr(10)), lambda x:
  CASE WHEN x[:2] = '@@' THEN nullif(trim(regexp_replace(x, '^@@(.*?@@)?', '')), '') WHEN x[1] IN ('+', '\\') THEN NULL WHEN x[1] IN ('-', ' ') THEN x[2:] ELSE x END), lambda x: x IS NOT NULL), chr(10))"""
_SCREEN_CTE = rf"""
, said AS (SELECT *, {_STRIP.format('body')} AS s, {_STATE} AS state0 FROM comments),
nits AS (SELECT *, CASE WHEN trim(coalesce(state0, '')) = '' THEN '' ELSE state0 END AS state,
  regexp_replace(s, '^[^\p{{L}}\p{{N}}_]*(lgtm|\+1|nice|thanks|thank you|done|fixed|ship it|good catch|looks good)([^\p{{L}}\p{{N}}_]+|$)', '', 'i') AS rest FROM said),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(s, '[\p{{L}}\p{{N}}_]') AND s[:2] <> '+1' THEN 'emoji_only' WHEN rest <> s AND length(trim(rest)) < 40 THEN 'acknowledgement' WHEN length(s) < 40 THEN 'short' END AS nit FROM nits),
screened AS (SELECT *, CASE WHEN coalesce(path, '') = '' OR trim(coalesce(diff_hunk, '')) = '' THEN 'no_path_or_hunk' WHEN in_reply_to_id IS NOT NULL THEN 'reply'
  WHEN user_type = 'Bot' OR lower(login) LIKE '%[bot]' OR lower(login) IN ('codecov', 'coderabbitai', 'dependabot', 'pre-commit-ci', 'sonarcloud', 'sonarqubecloud', 'kramlipi', 'copilot') THEN 'bot'
  WHEN nit IS NOT NULL THEN nit WHEN state = '' THEN 'empty_before_state' WHEN contains(body, state) OR contains(body, trim(diff_hunk)) THEN 'body_quotes_hunk' END AS reason0,
  coalesce(try_cast(regexp_extract(pull_request_url, '/([0-9]+)$', 1) AS BIGINT), 0) AS pull_request,
  regexp_matches(body, '(?m)^```\s*suggestion([^\p{{L}}\p{{N}}_]|$)') AS has_suggestion FROM judged)"""
_MINED_CTE = (
    _SCREEN_CTE
    + """, facts AS (SELECT s.*, sha256(s.repo || chr(0) || 'review_comment' || chr(0) || 'review_comment/' || s.id) AS unit_id,
  coalesce(reason0, CASE WHEN s.id % 37 = 5 THEN 'gold_not_in_corpus' END, CASE WHEN NOT coalesce(p.merged, false) THEN 'not_merged' WHEN lower(p.author) = lower(s.login) THEN 'self_review' END) AS reason1
  FROM screened s LEFT JOIN pulls p ON p.repo = s.repo AND p.number = s.pull_request),
per_pull AS (SELECT *, CASE WHEN reason1 IS NULL AND row_number() OVER (PARTITION BY repo, pull_request, reason1 IS NULL ORDER BY id) > 3 THEN 'per_pr_cap' ELSE reason1 END AS reason2 FROM facts),
cap AS (SELECT floor(median(n)) AS cap FROM (SELECT repo, count(*) FILTER (reason2 IS NULL) AS n FROM per_pull GROUP BY repo)),
mined AS (SELECT *, CASE WHEN reason2 IS NULL AND row_number() OVER (PARTITION BY repo, reason2 IS NULL ORDER BY sha256(CAST(id AS VARCHAR)), id) > (SELECT cap FROM cap) THEN 'per_repo_cap' ELSE reason2 END AS drop_reason FROM per_pull)"""
)


def _mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = view(spark, sf_dir, "comments")
    in_corpus = comments.where("id % 37 <> 5").select(ids.unit_id(F.col("repo"), F.lit("review_comment"), F.concat(F.lit("review_comment/"), F.col("id").cast("string"))).alias("unit_id"))
    return pairs.mined(comments, in_corpus, view(spark, sf_dir, "pulls"))


@query(ctes("comments") + _SCREEN_CTE + " SELECT id, repo, reason0 AS drop_reason, pull_request, has_suggestion FROM screened")
def screen_comments(spark, sf_dir):
    return pairs.screened(view(spark, sf_dir, "comments")).select("id", "repo", "drop_reason", "pull_request", "has_suggestion")


@query(ctes("comments") + _SCREEN_CTE + " SELECT id, state AS before_state, nit AS nit_reason FROM judged")
def before_state_and_nits(spark, sf_dir):
    return view(spark, sf_dir, "comments").select("id", F.coalesce(text.before_state(F.col("diff_hunk")), F.lit("")).alias("before_state"), text.nit_reason(F.col("body")).alias("nit_reason"))


@query(ctes("comments") + " SELECT login, user_type, count(*) AS n FROM comments WHERE user_type = 'Bot' OR lower(login) LIKE '%[bot]' OR lower(login) IN ('codecov', 'coderabbitai', 'dependabot', 'pre-commit-ci', 'sonarcloud', 'sonarqubecloud', 'kramlipi', 'copilot') GROUP BY 1, 2")
def bots(spark, sf_dir):
    bot = text.is_bot(F.col("login"), F.col("user_type"), F.col("login").isNotNull())
    return view(spark, sf_dir, "comments").where(bot).groupBy("login", "user_type").agg(F.count("*").alias("n"))


@query(ctes("comments", "pulls") + _MINED_CTE + " SELECT repo, id, unit_id, pull_request, drop_reason FROM mined")
def pair_mining(spark, sf_dir):
    return _mined(spark, sf_dir).select("repo", "id", "unit_id", "pull_request", "drop_reason")


@query(ctes("comments", "pulls") + _MINED_CTE + " SELECT repo, drop_reason, count(*) AS n FROM mined WHERE drop_reason IS NOT NULL GROUP BY GROUPING SETS ((repo, drop_reason), (drop_reason))")
def drop_rollup(spark, sf_dir):
    return pairs.dropped(_mined(spark, sf_dir)).select("repo", "drop_reason", "n")


@query(ctes("comments", "pulls") + _MINED_CTE + " SELECT repo, count(*) AS seen, count(*) FILTER (drop_reason IS NULL) AS pairs, count(*) FILTER (drop_reason IS NULL AND has_suggestion) AS suggestions FROM mined GROUP BY repo")
def pair_manifest(spark, sf_dir):
    return pairs.manifest(_mined(spark, sf_dir))


@query(ctes("comments", "pulls") + _MINED_CTE + """, q AS (SELECT repo, id, body, unnest([{'variant': 'before', 'query': state}, {'variant': 'reviewed', 'query': diff_hunk}], recursive := true) FROM mined WHERE drop_reason IS NULL)
SELECT variant, count(*) AS queries, count(*) FILTER (contains(diff_hunk_text, trim(query)) AND trim(query) <> '') AS leaks_with_hunk, count(*) FILTER (contains(body, trim(query)) AND trim(query) <> '') AS leaks_body_only
FROM (SELECT q.*, m.diff_hunk || chr(10) || m.body AS diff_hunk_text FROM q JOIN mined m USING (id)) GROUP BY variant""")
def leakage(spark, sf_dir):
    rows = _mined(spark, sf_dir)
    queries = pairs.queries_of(rows)
    leaking = lambda said, name: pairs.leaks(queries, rows.select("unit_id", said.alias("text"))).groupBy("variant").agg(F.count("*").alias(name))
    counts = queries.groupBy("variant").agg(F.count("*").alias("queries"))
    for name, said in (("leaks_with_hunk", F.concat("diff_hunk", F.lit("\n"), "body")), ("leaks_body_only", F.col("body"))):
        counts = counts.join(leaking(said, name), "variant", "left").fillna(0, [name])
    return counts


@query("""WITH c AS (SELECT o_orderkey AS id, 'c' || (o_custkey % 30) AS repo, o_custkey AS pull_request, o_orderdate AS created_at FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, id DESC) AS nth FROM c),
v AS (SELECT repo, count(*) AS n, greatest(date_diff('day', CAST(min(created_at) AS DATE), CAST(max(created_at) AS DATE)), 1) AS days, count(DISTINCT pull_request) AS pulls FROM r WHERE nth <= 100 GROUP BY repo)
SELECT repo, n, days, pulls, CASE WHEN row_number() OVER (ORDER BY n / days DESC, repo) % 3 = 0 THEN 'holdout' ELSE 'tune' END AS split FROM v""")
def velocity_and_split(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    comments = orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey") % 30).alias("repo"), F.col("o_custkey").alias("pull_request"), F.col("o_orderdate").alias("created_at"))
    return pairs.holdout(pairs.velocity(comments)).select("repo", "n", F.col("days").cast("long").alias("days"), "pulls", "split")


@query(ctes("units") + """ SELECT doc_id, sha256(repo || chr(0) || kind || chr(0) || identity) AS unit_id, sha256(text) AS body_hash,
 CASE WHEN lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.py', '.pyi', '.cfg', '.toml', '.ini') THEN 'source' WHEN lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.md', '.markdown', '.mdx', '.rst', '.txt') THEN 'doc' END AS file_kind,
 path LIKE 'vendor/%' OR path LIKE '%.egg-info/%' AS skipped,
 CASE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) WHEN '.py' THEN 'python' WHEN '.md' THEN 'docs' WHEN '.rst' THEN 'docs' WHEN '.cfg' THEN 'config' WHEN '' THEN 'none' ELSE 'other' END AS language FROM units""")
def unit_identity(spark, sf_dir):
    path = F.col("path")
    return view(spark, sf_dir, "units").select(
        "doc_id", ids.unit_id(F.col("repo"), F.col("kind"), F.col("identity")).alias("unit_id"), ids.body_fingerprint(F.col("text")).alias("body_hash"),
        text.file_kind(path).alias("file_kind"), text.is_skipped_path(path).alias("skipped"), text.language(path).alias("language"),
    )


@query(ctes("comments") + rf""" SELECT id, array_to_string(list_filter([coalesce(path || ':' || turn, ''), {_STRIP.format("coalesce(diff_hunk, '')")}, {_STRIP.format('body')}], lambda x: x <> ''), chr(10) || chr(10)) AS text, {_STRIP.format('body')} AS body FROM comments""")
def comment_text_round_trip(spark, sf_dir):
    built = view(spark, sf_dir, "comments").withColumn("unit_text", text.joined(F.concat("path", F.lit(":"), F.col("turn").cast("string")), F.col("diff_hunk"), F.col("body")))
    return built.select("id", F.col("unit_text").alias("text"), text.body_only(F.col("unit_text"), F.col("path"), F.col("diff_hunk")).alias("body"))


@query(ctes("comments", "pulls") + _MINED_CTE + """ SELECT id, repo FROM mined WHERE drop_reason IS NULL ORDER BY sha256('rerank|' || id), id LIMIT 40""")
def rerank_sample(spark, sf_dir):
    return ids.sample(_mined(spark, sf_dir).where("drop_reason is null").select("id", "repo"), "rerank", "id", 40)


@query(ctes("comments", "pulls") + _MINED_CTE + """, l AS (SELECT row_number() OVER (ORDER BY lower(repo), id) - 1 AS nth,
  sha256(CAST(to_json({'body': body, 'diff_hunk': diff_hunk, 'id': id, 'login': login, 'path': path, 'pull_request': pull_request, 'repo': repo}) AS VARCHAR)) AS h FROM mined WHERE drop_reason IS NULL),
b AS (SELECT nth // 4096 AS nth, sha256(string_agg(h, chr(10) ORDER BY nth)) AS h FROM l GROUP BY 1), c AS (SELECT nth // 4096 AS nth, sha256(string_agg(h, chr(10) ORDER BY nth)) AS h FROM b GROUP BY 1)
SELECT sha256(coalesce(string_agg(h, chr(10) ORDER BY nth), '')) AS digest FROM c""")
def frozen_pairs(spark, sf_dir):
    rows = _mined(spark, sf_dir)
    return pairs.frozen_digest(rows).select("digest")
