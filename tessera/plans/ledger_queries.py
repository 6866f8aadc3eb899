"""Queries on the corpus index and the ledgers, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import ids
from tessera.operators import corpus, ledgers
from tessera.plans.views import ctes, view
from tessera.session import materialized, shared_dir
from tessera.sources import buckets, corpus_files, digest_tree, schemas

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- the index: version 1 misses every 7th document; version 2 changes every 9th and loses every 8th

_INDEX = ctes("units") + """, u AS (SELECT doc_id, repo, kind, sha256(repo || chr(0) || kind || chr(0) || identity) AS unit_id, text FROM units),
v1 AS (SELECT unit_id, repo, kind, sha256(text) AS content_hash, 'ref1' AS ref, 1 AS updated_at, doc_id FROM u WHERE doc_id % 7 <> 0),
v2 AS (SELECT unit_id, repo, kind, sha256(CASE WHEN doc_id % 9 = 0 THEN text || '!' ELSE text END) AS content_hash, 'ref2' AS ref, doc_id, text FROM u WHERE doc_id % 8 <> 0),
acts AS (SELECT v2.repo, v2.unit_id, CASE WHEN v1.unit_id IS NULL THEN 'inserted' WHEN v1.content_hash <> v2.content_hash THEN 'updated' ELSE 'unchanged' END AS action, v1.ref AS old_ref, v2.ref, v2.content_hash FROM v2 LEFT JOIN v1 USING (unit_id)),
gone AS (SELECT v1.repo, v1.unit_id FROM v1 WHERE kind IN ('source', 'doc') AND unit_id NOT IN (SELECT unit_id FROM v2) AND repo IN (SELECT repo FROM v2 WHERE kind IN ('source', 'doc')))"""


def _versions(spark, sf_dir):
    units = view(spark, sf_dir, "units").withColumn("unit_id", ids.unit_id(F.col("repo"), F.col("kind"), F.col("identity")))
    hashed = lambda said: ids.body_fingerprint(said).alias("content_hash")
    v1 = units.where("doc_id % 7 <> 0").select("unit_id", "repo", "kind", hashed(F.col("text")), F.lit("ref1").alias("ref"), F.lit(1).alias("updated_at"), "doc_id")
    changed = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    v2 = units.where("doc_id % 8 <> 0").select("unit_id", "repo", "kind", hashed(changed), F.lit("ref2").alias("ref"), "doc_id", F.octet_length("text").alias("bytes"))
    return v1, v2


@query(_INDEX + " SELECT unit_id, action, CASE WHEN action = 'unchanged' THEN old_ref ELSE ref END AS ref, content_hash FROM acts")
def upsert_actions(spark, sf_dir):
    v1, v2 = _versions(spark, sf_dir)
    twice = v2.unionByName(v2.where("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000_000))
    return corpus.upsert_actions(v1, corpus.first_of_each(twice, "doc_id"))


@query(_INDEX + """ SELECT unit_id, coalesce(v2.repo, v1.repo) AS repo, coalesce(v2.kind, v1.kind) AS kind, CASE WHEN v2.unit_id IS NULL OR v1.content_hash = v2.content_hash THEN v1.content_hash ELSE v2.content_hash END AS content_hash,
 CASE WHEN v2.unit_id IS NULL OR v1.content_hash = v2.content_hash THEN v1.ref ELSE v2.ref END AS ref, CASE WHEN v2.unit_id IS NULL OR v1.content_hash = v2.content_hash THEN 1 ELSE 2 END AS updated_at FROM v1 FULL JOIN v2 USING (unit_id)""")
def upsert_snapshot(spark, sf_dir):
    v1, v2 = _versions(spark, sf_dir)
    return corpus.upserted(v1, v2, F.lit(2))


@query(ORACLE_SQL["upsert_snapshot"])
def upsert_buckets(spark, sf_dir):
    """The same snapshot, from an index in buckets that both versions were ingested into."""
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    v1, v2 = _versions(spark, sf_dir)
    corpus_files.upsert_index(v1, root, F.lit(1), 64)
    corpus_files.upsert_index(v2, root, F.lit(2), 64)
    return buckets.read(spark, root, spark.createDataFrame([], schemas.INDEX))


@query(_INDEX + " SELECT repo, unit_id FROM gone")
def prune(spark, sf_dir):
    v1, v2 = _versions(spark, sf_dir)
    return corpus.prunable(v1, v2).select("repo", "unit_id")


@query(_INDEX + """ SELECT repo, count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'unchanged') AS unchanged, count(*) FILTER (action = 'pruned') AS pruned,
 count(*) FILTER (action IN ('inserted', 'updated')) = 0 AS wrote_nothing FROM (SELECT repo, action FROM acts UNION ALL SELECT repo, 'pruned' FROM gone) GROUP BY repo""")
def ingest_report(spark, sf_dir):
    v1, v2 = _versions(spark, sf_dir)
    actions = corpus.upsert_actions(v1, v2).join(v2.select("unit_id", "repo"), "unit_id")
    return corpus.ingest_report(actions, corpus.prunable(v1, v2))


@query(_INDEX + " SELECT doc_id % 100 AS query_id, row_number() OVER (PARTITION BY doc_id % 100 ORDER BY doc_id) AS rank, unit_id, content_hash FROM (SELECT u.doc_id, u.unit_id, v1.content_hash FROM u JOIN v1 USING (unit_id))")
def resolve_units(spark, sf_dir):
    v1, v2 = _versions(spark, sf_dir)
    hits = view(spark, sf_dir, "units").select((F.col("doc_id") % 100).alias("query_id"), "doc_id", ids.unit_id(F.col("repo"), F.col("kind"), F.col("identity")).alias("unit_id"))
    found = corpus.resolved(hits, v1.select("unit_id", "content_hash"))
    return found.withColumn("rank", F.row_number().over(corpus.Window.partitionBy("query_id").orderBy("doc_id"))).select("query_id", "rank", "unit_id", "content_hash")


_SHARD = "kind || '/' || repo || '-' || lpad(CAST((row_number() OVER (PARTITION BY repo, kind ORDER BY unit_id) - 1) // 40 AS VARCHAR), 5, '0') || '.jsonl.gz'"


@query(_INDEX + f" SELECT shard, count(*) AS rows, min(unit_id) AS first FROM (SELECT unit_id, {_SHARD} AS shard FROM v2) GROUP BY shard")
def shard_layout(spark, sf_dir):
    _, v2 = _versions(spark, sf_dir)
    return corpus.shards_by_rows(v2, 40).groupBy("shard").agg(F.count("*").alias("rows"), F.min("unit_id").alias("first"))


@query(_INDEX + f""", d1 AS (SELECT shard, sha256(string_agg(content_hash, chr(10) ORDER BY unit_id)) AS d FROM (SELECT unit_id, content_hash, {_SHARD} AS shard FROM v1) GROUP BY 1),
d2 AS (SELECT shard, sha256(string_agg(content_hash, chr(10) ORDER BY unit_id)) AS d FROM (SELECT unit_id, content_hash, {_SHARD} AS shard FROM v2) GROUP BY 1)
SELECT shard, CASE WHEN d2.d IS NULL THEN 'gone' WHEN d1.d IS NULL OR d1.d <> d2.d THEN 'written' ELSE 'unchanged' END AS change FROM d1 FULL JOIN d2 USING (shard)""")
def shard_diff(spark, sf_dir):
    v1, v2 = _versions(spark, sf_dir)
    return corpus.shard_changes(*(corpus.shard_digests(corpus.shards_by_rows(v, 40)) for v in (v1, v2)))


@query("SELECT shard, change FROM (" + ORACLE_SQL["shard_diff"] + ") WHERE change <> 'unchanged'")
def shard_diff_tree(spark, sf_dir):
    """The shards that changed, from two stored trees of digests."""
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    for name, units in zip(("old", "new"), _versions(spark, sf_dir)):
        digest_tree.write_tree(corpus.shard_digests(corpus.shards_by_rows(units, 40)), f"{root}/{name}", 2)
    return digest_tree.changes(spark, f"{root}/old", f"{root}/new", 2)


@query(_INDEX.replace("WITH", "WITH RECURSIVE", 1) + """, o AS (SELECT repo, kind, strlen(text) AS bytes, row_number() OVER (PARTITION BY repo, kind ORDER BY unit_id) AS n FROM v2),
r AS (SELECT repo, kind, n, 1 AS held, bytes AS filled, 0 AS number FROM o WHERE n = 1
  UNION ALL SELECT o.repo, o.kind, o.n, CASE WHEN filled + bytes > 200000 OR held >= 100 THEN 1 ELSE held + 1 END, CASE WHEN filled + bytes > 200000 OR held >= 100 THEN bytes ELSE filled + bytes END,
  CASE WHEN filled + bytes > 200000 OR held >= 100 THEN number + 1 ELSE number END FROM r JOIN o ON o.repo = r.repo AND o.kind = r.kind AND o.n = r.n + 1)
SELECT kind || '/' || repo || '-' || lpad(CAST(number AS VARCHAR), 5, '0') || '.jsonl.gz' AS shard, count(*) AS rows FROM r GROUP BY 1""")
def exact_shards(spark, sf_dir):
    _, v2 = _versions(spark, sf_dir)
    return corpus.shards(v2, rows=100, size=200_000).groupBy("shard").agg(F.count("*").alias("rows"))


# ---- deliveries


@query(ctes("deliveries") + " SELECT delivery_id, event, action, repo, pr FROM (SELECT *, row_number() OVER (PARTITION BY delivery_id ORDER BY arrival) AS nth FROM deliveries) WHERE nth = 1")
def delivery_dedup(spark, sf_dir):
    return ledgers.first_deliveries(view(spark, sf_dir, "deliveries")).select("delivery_id", "event", "action", "repo", "pr")


@query(ctes("deliveries") + " SELECT arrival, delivery_id, repo, pr FROM deliveries WHERE event = 'pull_request' AND action IN ('opened', 'synchronize', 'reopened', 'ready_for_review') AND repo IS NOT NULL AND pr IS NOT NULL")
def actionable(spark, sf_dir):
    return view(spark, sf_dir, "deliveries").where(ledgers.is_actionable()).select("arrival", "delivery_id", "repo", "pr")


@query(ctes("deliveries") + " SELECT repo, pr, arg_max(delivery_id, struct_pack(ts := ts, a := arrival)) AS delivery_id, count(*) AS n FROM deliveries WHERE repo IS NOT NULL AND pr IS NOT NULL GROUP BY 1, 2")
def latest_per_pull(spark, sf_dir):
    return ledgers.latest_per_pull(view(spark, sf_dir, "deliveries"))


_PAYLOAD = """'{"action":' || CASE WHEN event_id % 13 = 0 THEN '7' ELSE '"' || event_type || '"' END || ',"repository":{"full_name":"r' || (user_id % 20) || '"},"pull_request":{"number":' || CASE WHEN event_id % 11 = 0 THEN 'true' WHEN event_id % 17 = 0 THEN '"5"' ELSE CAST(user_id AS VARCHAR(20)) END || ',"head":{"sha":"s' || event_id || '"}}' || CASE WHEN event_id % 5 = 0 THEN ',"installation":{"id":' || event_id || '}' ELSE '' END || '}'"""


@query(f"""WITH p AS (SELECT 'd' || event_id AS delivery_id, 'pull_request' AS event, {_PAYLOAD} AS j FROM events)
SELECT delivery_id, event, CASE WHEN json_type(j, '$.action') = 'VARCHAR' THEN json_extract_string(j, '$.action') END AS action, json_extract_string(j, '$.repository.full_name') AS repo,
 CASE WHEN json_type(j, '$.pull_request.number') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract_string(j, '$.pull_request.number') AS BIGINT) END AS pr, json_extract_string(j, '$.pull_request.head.sha') AS head_sha,
 CAST(json_extract_string(j, '$.installation.id') AS BIGINT) AS installation_id FROM p""")
def webhook_payloads(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.selectExpr("'d' || event_id AS delivery_id", "'pull_request' AS event", f"{_PAYLOAD} AS payload")
    return ledgers.from_webhook(rows)


# ---- claims, drafts and slots

_GATES = ctes("runs", "drafts") + """, gated AS (SELECT *, specific AND non_obvious AND grounded AS praised, line <> 3 AS allowed, line = 5 AND run_id % 2 = 0 AS old FROM drafts),
fates AS (SELECT *, CASE WHEN NOT praised THEN 'self_critique' WHEN NOT allowed THEN 'not_commentable' WHEN old THEN 'already_commented'
  WHEN row_number() OVER (PARTITION BY run_id, path, line, praised AND allowed ORDER BY position) > 1 THEN 'duplicate' ELSE 'unjudged' END AS fate FROM gated),
kept AS (SELECT *, fate = 'unjudged' AND l_returnflag <> 'R' AND l_linestatus = 'F' AS keep FROM fates),
final AS (SELECT run_id, position, CASE WHEN fate <> 'unjudged' THEN fate WHEN NOT keep THEN 'filtered' WHEN sum(keep::INT) OVER (PARTITION BY run_id ORDER BY position) > 3 THEN 'over_cap' ELSE 'kept' END AS fate FROM kept)"""


def _gated(spark, sf_dir):
    drafts = view(spark, sf_dir, "drafts")
    spots = drafts.select("run_id", "path", "line").distinct()
    return ledgers.draft_gates(drafts, spots.where("line <> 3"), spots.where("line = 5 and run_id % 2 = 0"))


def _final(spark, sf_dir):
    gated = _gated(spark, sf_dir)
    verdicts = view(spark, sf_dir, "drafts").where("l_returnflag <> 'R'").select("run_id", "position", (F.col("l_linestatus") == "F").alias("keep"))
    return ledgers.filter_verdicts(gated, verdicts).select("run_id", "position", "fate")


@query(_GATES + " SELECT run_id, position, fate FROM fates")
def draft_gates(spark, sf_dir):
    return _gated(spark, sf_dir).select("run_id", "position", "fate")


@query(_GATES + " SELECT run_id, position, fate FROM final")
def filter_verdicts(spark, sf_dir):
    return _final(spark, sf_dir)


_DONE = _GATES + """, c AS (SELECT run_id, count(*) AS drafts, count(*) FILTER (fate = 'kept') AS kept FROM final GROUP BY 1),
t AS (SELECT run_id, sum(position + 100) AS prompt_tokens, sum(line) AS completion_tokens, round(sum(line * 0.25), 3) AS seconds, max(CASE WHEN run_id % 3 = 0 THEN 'new' || run_id ELSE '' END) AS new_head FROM drafts GROUP BY 1),
done AS (SELECT r.run_id, batch, repo, pr, coalesce(nullif(new_head, ''), head_sha) AS head_sha, coalesce(drafts, 0) AS drafts, coalesce(kept, 0) AS kept, coalesce(prompt_tokens, 0) AS prompt_tokens, coalesce(completion_tokens, 0) AS completion_tokens, seconds FROM runs r LEFT JOIN c USING (run_id) LEFT JOIN t USING (run_id))"""


def _done(spark, sf_dir):
    calls = view(spark, sf_dir, "drafts").select(
        "run_id", (F.col("position") + 100).alias("prompt_tokens"), F.col("line").alias("completion_tokens"), (F.col("line") * 0.25).alias("seconds"),
        F.when(F.col("run_id") % 3 == 0, F.concat(F.lit("new"), "run_id")).otherwise(F.lit("")).alias("new_head"),
    )
    return ledgers.finished(view(spark, sf_dir, "runs"), _final(spark, sf_dir), calls)


@query(_DONE + " SELECT run_id, head_sha, drafts, kept, CAST(prompt_tokens AS BIGINT) AS prompt_tokens, CAST(completion_tokens AS BIGINT) AS completion_tokens, CAST(seconds AS DOUBLE) AS seconds FROM done")
def finish_runs(spark, sf_dir):
    return _done(spark, sf_dir).select("run_id", "head_sha", "drafts", "kept", "prompt_tokens", "completion_tokens", "seconds")


@query(_DONE + " SELECT repo, pr, count(*) AS runs, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, CAST(sum(drafts) AS BIGINT) AS drafts, CAST(sum(kept) AS BIGINT) AS kept, count(*) FILTER (drafts = 0) AS silent FROM done WHERE batch = 'b1' GROUP BY GROUPING SETS ((repo, pr), ())")
def replay_summary(spark, sf_dir):
    return ledgers.replay_summary(_done(spark, sf_dir), "b1")


@query(_GATES + """, v AS (SELECT doc_id AS run_id, CASE quality WHEN 1 THEN 'keep' ELSE 'kill' END AS verdict FROM labels)
SELECT batch, fate, count(*) FILTER (verdict = 'keep') AS keep, count(*) FILTER (verdict = 'kill') AS kill, count(*) FILTER (verdict IS NULL) AS unjudged FROM final JOIN runs USING (run_id) LEFT JOIN v ON v.run_id = final.run_id AND final.position = 0 GROUP BY 1, 2""")
def verdict_table(spark, sf_dir):
    said = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("run_id"), F.lit(0).cast("bigint").alias("position"), F.when(F.col("quality") == 1, "keep").otherwise("kill").alias("verdict"))
    return ledgers.verdict_table(_final(spark, sf_dir), view(spark, sf_dir, "runs"), said)


@query(ctes("runs") + " SELECT batch, repo, pr, min(run_id) AS run_id FROM runs WHERE (batch, repo, pr) NOT IN (SELECT (batch, repo, pr) FROM runs WHERE run_id % 50 = 0) AND run_id % 50 <> 0 GROUP BY 1, 2, 3")
def claims(spark, sf_dir):
    runs = view(spark, sf_dir, "runs")
    return ledgers.claims(runs.where("run_id % 50 <> 0"), runs.where("run_id % 50 = 0"))


@query(ctes("runs", "drafts") + " SELECT run_id, repo, pr, position, body FROM drafts JOIN runs USING (run_id) WHERE batch = 'b2'")
def batch_drafts(spark, sf_dir):
    return ledgers.batch_drafts(view(spark, sf_dir, "drafts"), view(spark, sf_dir, "runs"), "b2").select("run_id", "repo", "pr", "position", "body")


@query(ctes("runs", "drafts") + " SELECT run_id, repo, pr, no_comment FROM runs WHERE batch = 'b2' AND run_id NOT IN (SELECT run_id FROM drafts)")
def silent_runs(spark, sf_dir):
    return ledgers.silent_runs(view(spark, sf_dir, "runs"), view(spark, sf_dir, "drafts"), "b2").select("run_id", "repo", "pr", "no_comment")


@query(ctes("runs") + " SELECT DISTINCT repo, pr FROM runs WHERE batch NOT IN ('b0', 'b1') AND (repo, pr) NOT IN (SELECT (repo, pr) FROM runs WHERE batch IN ('b0', 'b1'))")
def replayed_elsewhere(spark, sf_dir):
    return ledgers.replayed_elsewhere(view(spark, sf_dir, "runs"), "b0", ["b1"])


@query(ctes("runs") + """, l AS (SELECT DISTINCT repo, pr FROM runs WHERE (repo, pr) NOT IN (SELECT (repo, pr) FROM runs WHERE batch = 'b3'))
SELECT repo, pr, turn FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY sha256('b9|' || repo || '|' || pr), pr) AS turn FROM l) ORDER BY turn, sha256('b9|' || repo || '|0') LIMIT 15""")
def replay_choice(spark, sf_dir):
    runs = view(spark, sf_dir, "runs")
    return ledgers.replay_choice(runs, runs.where("batch = 'b3'").select("repo", "pr").distinct(), "b9", 15)


@query(ctes("offers") + """, held AS (SELECT DISTINCT repo, pr, path, line FROM offers WHERE pr % 3 = 0 AND line = 2), used AS (SELECT repo, pr, count(*) AS used FROM held GROUP BY 1, 2),
f AS (SELECT o.*, h.line IS NULL AND row_number() OVER (PARTITION BY o.repo, o.pr, o.path, o.line ORDER BY nth) = 1 AS free, coalesce(used, 0) AS used FROM offers o LEFT JOIN held h USING (repo, pr, path, line) LEFT JOIN used u USING (repo, pr)),
s AS (SELECT *, used + sum(free::INT) OVER (PARTITION BY repo, pr ORDER BY nth) AS slot FROM f)
SELECT repo, pr, path, line, nth, CASE WHEN free AND slot <= 3 THEN CAST(slot AS BIGINT) END AS slot FROM s""")
def slot_ledger(spark, sf_dir):
    offers = materialized(view(spark, sf_dir, "offers"))  # numbered once
    return ledgers.slots(offers, offers.where("pr % 3 = 0 and line = 2").select("repo", "pr", "path", "line").distinct())


@query(ctes("offers") + """, ledger AS (SELECT repo, pr, nth AS slot FROM offers WHERE nth <= 2)
SELECT repo, pr, slot, CASE WHEN pr % 2 = 0 THEN 'posted' WHEN slot = 1 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN pr % 2 = 1 AND slot = 1 THEN repeat('e', 500) END AS error FROM ledger""")
def settled_slots(spark, sf_dir):
    held = view(spark, sf_dir, "offers").where("nth <= 2").select("repo", "pr", F.col("nth").alias("slot"), F.lit("pending").alias("status"))
    results = held.where("pr % 2 = 0 or slot = 1").select("repo", "pr", "slot", F.when(F.col("pr") % 2 == 0, F.lit(1)).alias("comment_id"), F.when(F.col("pr") % 2 == 1, F.repeat(F.lit("e"), 600)).alias("error"))
    return ledgers.settled(held, results).select("repo", "pr", "slot", "status", "error")


@query(ctes("drafts") + """ SELECT run_id, max(position + 1) AS turns, count(*) FILTER (specific) AS answered, coalesce(string_agg('grep ' || path, '; ' ORDER BY position) FILTER (specific), '') AS summary FROM drafts GROUP BY run_id""")
def grounding(spark, sf_dir):
    return ledgers.grounding(view(spark, sf_dir, "drafts").select("run_id", (F.col("position") + 1).alias("turn"), F.col("specific").alias("ok"), F.lit("grep").alias("tool"), F.col("path").alias("summary")))
