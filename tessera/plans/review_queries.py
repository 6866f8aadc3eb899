"""Queries on diffs, review assembly, files, tests and chunks, with SQL where it can say them."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import assembly, chunking, diffs, evidence, ledgers, line_index, manifests
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


# A document's words become the lines of one hunk: every 3rd is added, every 5th removed, others unchanged.
_FILES = ctes("changed_files") + """, w AS (SELECT *, string_split(coalesce(text, ''), ' ') AS words FROM changed_files),
cut AS (SELECT *, list_transform(range(1, len(words) + 1), lambda i: (CASE WHEN i % 3 = 0 THEN '+' WHEN i % 5 = 0 THEN '-' ELSE ' ' END) || replace(words[i], chr(10), '_')) AS lines,
  CASE WHEN status = 'removed' THEN 'deleted' WHEN status = 'renamed' AND changes = 0 THEN 'renamed without changes' WHEN path LIKE '%.lock' THEN 'lockfile or generated'
       WHEN path LIKE 'vendor/%' THEN 'vendored' WHEN coalesce(text, '') = '' THEN 'no patch: binary or too large' END AS skip_reason FROM w),
hl0 AS (SELECT doc_id, repo, pr, path, new_start, skip_reason, unnest(lines) AS raw, generate_subscripts(lines, 1) AS pos FROM cut WHERE skip_reason IS NULL),
hl AS (SELECT doc_id, repo, pr, path, pos - 1 AS pos, raw[1] AS marker, raw[2:] AS code, CASE WHEN raw[1] <> '-' THEN new_start + coalesce(sum((raw[1] <> '-')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS line FROM hl0),
added AS (SELECT doc_id, any_value(repo) AS repo, any_value(pr) AS pr, any_value(path) AS path, count(*) FILTER (marker = '+') AS added FROM hl GROUP BY doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo, pr ORDER BY added * CASE WHEN path LIKE 'tests/%' OR path LIKE 'docs/%' OR path LIKE '%.md' THEN 0.5 ELSE 1 END DESC, doc_id) AS rank FROM added),
golds AS (SELECT doc_id AS gold_id, repo, pr, path, new_start + doc_id % 5 AS line FROM cut WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id + 1000000, repo, pr, path, 1000 FROM cut WHERE doc_id % 40 = 2),
hit AS (SELECT g.gold_id, min(r.rank) AS rank, max(CASE WHEN r.rank <= 8 AND r.rank % 3 <> 0 THEN 3 WHEN r.rank <= 8 THEN 2 ELSE 1 END) AS best FROM golds g JOIN hl USING (repo, pr, path, line) JOIN ranked r ON r.doc_id = hl.doc_id GROUP BY 1),
fate AS (SELECT g.*, h.rank, CASE h.best WHEN 3 THEN 'shown' WHEN 2 THEN 'dropped' WHEN 1 THEN 'unconsidered' ELSE CASE WHEN EXISTS (SELECT 1 FROM cut c WHERE c.skip_reason IS NOT NULL AND c.repo = g.repo AND c.pr = g.pr AND c.path = g.path) THEN 'skipped' ELSE 'not_in_diff' END END AS outcome
  FROM golds g LEFT JOIN hit h USING (gold_id))"""


def _changed(spark, sf_dir):
    files = view(spark, sf_dir, "changed_files")
    words = F.split(F.coalesce("text", F.lit("")), " ")
    lines = F.transform(words, lambda w, i: F.concat(F.when((i + 1) % 3 == 0, "+").when((i + 1) % 5 == 0, "-").otherwise(" "), F.replace(w, F.lit("\n"), F.lit("_"))))
    return files.select("*", lines.alias("lines"), text.file_skip_reason(F.col("path"), F.col("status"), F.col("changes"), F.col("text")).alias("skip_reason"))


def _hunks(spark, sf_dir):
    return _changed(spark, sf_dir).where("skip_reason is null").select("doc_id", "repo", "pr", "path", "new_start", "lines", F.size("lines").alias("new_lines"), F.col("doc_id").alias("position"))


@query(_FILES + " SELECT doc_id, skip_reason FROM cut")
def file_skip_reasons(spark, sf_dir):
    return _changed(spark, sf_dir).select("doc_id", "skip_reason")


@query(_FILES + " SELECT doc_id, pos AS place, marker, code, CAST(line AS BIGINT) AS line FROM hl")
def hunk_lines(spark, sf_dir):
    return diffs.hunk_lines(_hunks(spark, sf_dir), "doc_id").select("doc_id", F.col("at").cast("long").alias("place"), "marker", "code", "line")


@query(_FILES + " SELECT doc_id, repo, pr, rank, rank <= 8 AS considered FROM ranked")
def hunk_rank(spark, sf_dir):
    return assembly.ranked_hunks(_hunks(spark, sf_dir), "repo", "pr").select("doc_id", "repo", "pr", "rank", "considered")


@query(_FILES + """, f AS (SELECT repo, pr, path, min(rank) AS first FROM ranked WHERE rank <= 8 GROUP BY 1, 2, 3)
SELECT repo, pr, path, place FROM (SELECT *, row_number() OVER (PARTITION BY repo, pr ORDER BY first) AS place FROM f) WHERE place <= 8""")
def window_files(spark, sf_dir):
    return assembly.window_files(assembly.ranked_hunks(_hunks(spark, sf_dir), "repo", "pr"), "repo", "pr").select("repo", "pr", "path", "place")


def _fates(spark, sf_dir):
    changed, hunks = _changed(spark, sf_dir), _hunks(spark, sf_dir)
    ranked = assembly.ranked_hunks(hunks, "repo", "pr")
    lines = diffs.new_lines(hunks, "doc_id", "repo", "pr", "position")
    taken = ranked.where("considered").select("repo", "pr", "position", F.when(F.col("rank") % 3 != 0, F.lit(0)).alias("variant"))
    near = changed.where("doc_id % 4 = 0").select(F.col("doc_id").alias("gold_id"), "repo", "pr", "path", (F.col("new_start") + F.col("doc_id") % 5).alias("line"))
    far = changed.where("doc_id % 40 = 2").select((F.col("doc_id") + 1_000_000).alias("gold_id"), "repo", "pr", "path", F.lit(1000).cast("long").alias("line"))
    return assembly.outcomes(near.unionByName(far), lines, ranked, taken, changed.where("skip_reason is not null"), "repo", "pr")


@query(_FILES + " SELECT gold_id, rank, outcome FROM fate")
def assembly_outcomes(spark, sf_dir):
    return _fates(spark, sf_dir).select("gold_id", "rank", "outcome")


@query(_FILES + """ SELECT repo, count(*) FILTER (outcome = 'shown') AS shown, count(*) FILTER (outcome = 'dropped') AS dropped, count(*) FILTER (outcome = 'unconsidered') AS unconsidered, count(*) FILTER (outcome = 'skipped') AS skipped,
 count(*) FILTER (outcome = 'not_in_diff') AS not_in_diff, count(*) AS total, count(*) FILTER (outcome <> 'not_in_diff') AS reachable,
 round(CASE WHEN count(*) FILTER (outcome <> 'not_in_diff') > 0 THEN count(*) FILTER (outcome = 'shown') / count(*) FILTER (outcome <> 'not_in_diff') ELSE 0 END, 9) AS retention FROM fate GROUP BY GROUPING SETS ((repo), ())""")
def assembly_table(spark, sf_dir):
    return assembly.summary(_fates(spark, sf_dir))


@query(_FILES + " SELECT rank, count(*) AS n, round(sum(count(*)) OVER (ORDER BY rank) / sum(count(*)) OVER (), 9) AS cumulative, rank > 8 AS past_ceiling FROM fate WHERE rank IS NOT NULL GROUP BY rank")
def rank_histogram(spark, sf_dir):
    return assembly.rank_histogram(_fates(spark, sf_dir))


@query(_FILES + r""", r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth, lpad(coalesce(CAST(CAST(line AS BIGINT) AS VARCHAR), ''), 5, ' ') || ' ' || marker || ' ' || code AS row FROM hl),
t AS (SELECT doc_id, string_agg(row, chr(10) ORDER BY nth) FILTER (nth <= 80) || CASE WHEN count(*) > 80 THEN chr(10) || '      ... ' || (count(*) - 80) || ' more lines of this hunk not shown' ELSE '' END AS body FROM r GROUP BY 1) SELECT cut.doc_id, md5(cut.path || coalesce(chr(10) || body, '')) AS rendering, CAST(ceil(length(cut.path || coalesce(chr(10) || body, '')) / 3) AS BIGINT) AS tokens FROM cut LEFT JOIN t USING (doc_id) WHERE skip_reason IS NULL""")
def rendered_hunks(spark, sf_dir):
    told = assembly.rendered(_hunks(spark, sf_dir), "doc_id")
    return told.select("doc_id", F.md5("rendering").alias("rendering"), text.token_estimate(F.col("rendering")).alias("tokens"))


_CLIP = "CASE WHEN length({0}) > 200 THEN substr({0}, 1, 200) || ' [cut]' ELSE {0} END"


@query(_FILES.replace("WITH", "WITH RECURSIVE", 1) + f""", rows_ AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth, lpad(coalesce(CAST(CAST(line AS BIGINT) AS VARCHAR), ''), 5, ' ') || ' ' || marker || ' ' || {_CLIP.format('code')} AS row FROM hl),
body AS (SELECT doc_id, string_agg(row, chr(10) ORDER BY nth) FILTER (nth <= 80) || CASE WHEN count(*) > 80 THEN chr(10) || '      ... ' || (count(*) - 80) || ' more lines of this hunk not shown' ELSE '' END AS body FROM rows_ GROUP BY 1),
above AS (SELECT doc_id, path, lines, greatest(1, new_start - 10) AS a, least(new_start - 1, len(lines)) AS b FROM cut WHERE skip_reason IS NULL),
blocks AS (SELECT r.repo, r.pr, r.rank, CAST(ceil(length('Hunk ' || r.rank || chr(10) || a.path || CASE WHEN b >= a.a THEN chr(10) || array_to_string(list_transform(range(a.a, b + 1), lambda i: lpad(CAST(i AS VARCHAR), 5, ' ') || ' . ' || {_CLIP.format('lines[i][2:]')}), chr(10)) ELSE '' END || chr(10) || body) / 3) AS BIGINT) AS wide,
  CAST(ceil(length('Hunk ' || r.rank || chr(10) || a.path || chr(10) || body) / 3) AS BIGINT) AS bare FROM ranked r JOIN above a ON a.doc_id = r.doc_id JOIN body ON body.doc_id = r.doc_id WHERE r.rank <= 8),
first_ AS (SELECT DISTINCT repo, pr, CAST(0 AS BIGINT) AS rank, CAST(3500 AS BIGINT) AS room, false AS taken FROM blocks
  UNION ALL SELECT b.repo, b.pr, b.rank, CASE WHEN b.bare <= f.room THEN f.room - b.bare ELSE f.room END, b.bare <= f.room FROM first_ f JOIN blocks b ON b.repo = f.repo AND b.pr = f.pr AND b.rank = f.rank + 1),
second_ AS (SELECT repo, pr, CAST(0 AS BIGINT) AS rank, arg_max(room, rank) AS room, CAST(NULL AS INTEGER) AS variant FROM first_ GROUP BY 1, 2
  UNION ALL SELECT b.repo, b.pr, b.rank, CASE WHEN t.taken AND b.wide - b.bare <= s.room THEN s.room - (b.wide - b.bare) ELSE s.room END, CASE WHEN t.taken AND b.wide - b.bare <= s.room THEN 0 WHEN t.taken THEN 1 END
  FROM second_ s JOIN blocks b ON b.repo = s.repo AND b.pr = s.pr AND b.rank = s.rank + 1 JOIN first_ t ON t.repo = b.repo AND t.pr = b.pr AND t.rank = b.rank)
SELECT s.repo, s.pr, s.rank AS position, s.variant, CASE s.variant WHEN 0 THEN b.wide WHEN 1 THEN b.bare END AS tokens FROM second_ s JOIN blocks b ON b.repo = s.repo AND b.pr = s.pr AND b.rank = s.rank""")
def packed_blocks(spark, sf_dir):
    hunks = _hunks(spark, sf_dir)
    ranked = materialized(assembly.ranked_hunks(hunks, "repo", "pr").where("considered").select("doc_id", "repo", "pr", "rank"))
    # all hunks are ranked; those that are considered, a few of each pull, are rendered
    hunks = materialized(hunks.join(ranked.select("doc_id"), "doc_id", "left_semi"))
    files = hunks.select("doc_id", "path", F.transform("lines", lambda x: F.substring(x, 2, 1 << 20)).alias("lines"))
    bare, windowed = assembly.rendered(hunks, "doc_id"), assembly.rendered(hunks, "doc_id", files=files)
    both = ranked.join(bare.select("doc_id", F.col("rendering").alias("bare")), "doc_id").join(windowed.select("doc_id", F.col("rendering").alias("wide")), "doc_id")
    variants = assembly.block_variants(F.col("rank"), F.col("bare"), F.col("wide"), F.lit(None).cast("string"))
    budget = assembly.hunk_budget(F.lit(600).cast("long"), F.lit(900).cast("long"))
    sized = both.select("repo", "pr", F.col("rank").alias("position"), F.transform(variants, text.token_estimate).alias("costs"), budget.alias("budget"))
    return assembly.fitted(sized, "repo", "pr")


@query()
def import_blocks(spark, sf_dir):
    files = view(spark, sf_dir, "changed_files").select("repo", "pr", "path", "doc_id", text.split_lines(F.concat(F.lit("import os\nfrom a import (\n  b,\n)\n"), F.coalesce("text", F.lit("")))).alias("lines"))
    placed = assembly.imports(files).withColumn("place", F.row_number().over(assembly.Window.partitionBy("repo", "pr").orderBy("doc_id"))).where(F.col("place") <= assembly.WINDOW_FILES)
    return assembly.import_sections(placed, "repo", "pr")


_LINES = """WITH f AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"""


@query(_LINES + r""", m AS (SELECT doc_id % 20 AS request_id, doc_id, 'd' || doc_id AS path, unnest(l) AS raw, generate_subscripts(l, 1) AS line FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY doc_id, line) AS nth FROM m WHERE regexp_matches(raw, 'th(e|at) [a-z]+ion'))
SELECT request_id, path, line, substr(regexp_replace(raw, '^\s+|\s+$', '', 'g'), 1, 200) AS said FROM n WHERE nth <= 20""")
def grep_lines(spark, sf_dir):
    return assembly.grep(_requested(spark, sf_dir), "th(e|at) [a-z]+ion").withColumn("line", F.col("line").cast("long"))


def _requested(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select((F.col("doc_id") % 20).alias("request_id"), F.col("doc_id").alias("position"), F.concat(F.lit("d"), "doc_id").alias("path"), F.split("text", "\n").alias("lines"))


_LINE_INDEXES: dict[tuple, str] = {}


def _line_index(spark, sf_dir) -> str:
    """The folder of the documents' stored lines; built once an application and set of files."""
    files = _requested(spark, sf_dir)
    held = (spark.sparkContext.applicationId, *sorted(files.inputFiles()))
    if held not in _LINE_INDEXES:
        path, least = f"{shared_dir(spark)}/tessera-lines-{uuid.uuid4().hex}", spark.sparkContext.defaultParallelism
        line_index.write_index(files.repartition(least) if files.rdd.getNumPartitions() < least else files, path)  # few row groups are few tasks
        _LINE_INDEXES[held] = path
    return _LINE_INDEXES[held]


#: Plain words, a letter that may lack, a group, a set, and alternatives, which the index cannot narrow.
_PATTERNS = ["disgusting", "Licensed? ", "th(e|at) [a-z]+ation", "cióna?que [dl]", "einheit$|^Anquean"]


@query(_LINES + f""", m AS (SELECT pattern, doc_id % 20 AS request_id, doc_id, 'd' || doc_id AS path, raw, line
  FROM (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS line FROM f), (SELECT unnest({_PATTERNS}) AS pattern) WHERE regexp_matches(raw, pattern)),
n AS (SELECT *, row_number() OVER (PARTITION BY pattern, request_id ORDER BY doc_id, line) AS nth FROM m)""" + r"""
SELECT pattern, request_id, path, line, substr(regexp_replace(raw, '^\s+|\s+$', '', 'g'), 1, 200) AS said FROM n WHERE nth <= 20""")
def grep_indexed(spark, sf_dir):
    path = _line_index(spark, sf_dir)
    found = [line_index.search(spark, path, p).select(F.lit(p).alias("pattern"), "request_id", "path", F.col("line").cast("long").alias("line"), "said") for p in _PATTERNS]
    return reduce(DataFrame.unionByName, found)


@query(_LINES + """, r AS (SELECT doc_id AS request_id, 'd' || doc_id AS path, l, greatest(1, least(doc_id % 9, len(l))) AS a FROM f),
b AS (SELECT *, greatest(a, least(CASE WHEN request_id % 3 = 0 THEN a + 59 ELSE doc_b END, len(l), a + 59)) AS b FROM (SELECT *, request_id % 70 AS doc_b FROM r))
SELECT request_id, path, a + i AS line, l[a + i] AS raw FROM b, unnest(range(0, b - a + 1)) AS t(i)""")
def file_windows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first, last = (F.col("doc_id") % 9).cast("int"), F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 70).cast("int"))
    files = docs.select(F.col("doc_id").alias("request_id"), F.concat(F.lit("d"), "doc_id").alias("path"), F.split("text", "\n").alias("lines"), first.alias("first"), last.alias("last"))
    return assembly.file_window(files).withColumn("line", F.col("line").cast("long"))


@query(ctes("comments") + f""", c AS (SELECT id, conv_id, repo, body, login FROM comments WHERE body <> '' AND login <> 'ci[bot]' AND login <> 'CodeCov'),
w AS (SELECT DISTINCT id AS comment_id, repo, conv_id, unnest({TOKENS.format('body')}) AS word FROM c),
q AS (SELECT DISTINCT id AS query_id, repo, conv_id, unnest({TOKENS.format('diff_hunk')}) AS word FROM comments WHERE turn = 1),
s AS (SELECT query_id, comment_id, count(*) AS score FROM q JOIN w USING (repo, word) WHERE w.conv_id < q.conv_id GROUP BY 1, 2)
SELECT query_id, rank, comment_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, comment_id) AS rank FROM s) WHERE rank <= 5""")
def past_comments(spark, sf_dir):
    rows = view(spark, sf_dir, "comments")
    comments = rows.select(F.col("id").alias("comment_id"), "repo", F.col("conv_id").alias("pr"), "body", "login")
    queries = rows.where("turn = 1").select(F.col("id").alias("query_id"), "repo", F.col("conv_id").alias("pr"), F.col("diff_hunk").alias("query"))
    return assembly.past_comments(queries, comments).select("query_id", "rank", "comment_id", "score")


# ---- test runs: events are test results of a user's run, twice: head and base


_RUNS = """WITH e AS (SELECT user_id AS run_id, 't' || (event_id % 40) AS test, event_type, event_id % 2 = 0 AS head FROM events),
runs AS (SELECT run_id, bool_or(event_type = 'error' AND head) AS he, run_id % 7 <> 0 AS head_ok, run_id % 5 <> 0 AS base_ok FROM e GROUP BY run_id)"""


@query(_RUNS + """ SELECT DISTINCT run_id, test FROM e JOIN runs USING (run_id) WHERE head AND event_type = 'error' AND head_ok AND base_ok
 AND (run_id, test) NOT IN (SELECT (run_id, test) FROM e WHERE NOT head AND event_type = 'error')""")
def regressions(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("run_id"), F.concat(F.lit("t"), F.col("event_id") % 40).alias("test"), "event_type", (F.col("event_id") % 2 == 0).alias("head"))
    failed = events.where("event_type = 'error'").select("run_id", "test", "head").distinct()
    outcome = lambda by: F.when(F.col("run_id") % by != 0, "failed").otherwise("timeout")
    runs = events.select("run_id").distinct().select("run_id", evidence.usable(outcome(7), F.lit(0)).alias("head_ok"), evidence.usable(outcome(5), F.lit(0)).alias("base_ok"))
    return evidence.regressions(failed.where("head").drop("head"), failed.where("not head"), runs)


@query(ctes("changed_files") + """, c AS (SELECT DISTINCT repo, pr, path, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '([^/]*)\\.py$', 1) AS stem FROM changed_files),
tree AS (SELECT DISTINCT repo, CASE WHEN doc_id % 2 = 0 THEN 'tests/test_m' || (doc_id % 40) || '.py' ELSE 'src/m' || (doc_id % 40) || '_test.py' END AS path FROM changed_files),
w AS (SELECT repo, pr, path FROM c WHERE regexp_matches(name, '^test_.*\\.py$|_test\\.py$')
  UNION SELECT c.repo, c.pr, t.path FROM c JOIN tree t ON t.repo = c.repo AND c.stem <> '' AND regexp_extract(t.path, '[^/]*$') IN ('test_' || c.stem || '.py', c.stem || '_test.py'))
SELECT repo, pr, path FROM (SELECT *, row_number() OVER (PARTITION BY repo, pr ORDER BY path) AS nth FROM w) WHERE nth <= 20""")
def near_tests(spark, sf_dir):
    changed = view(spark, sf_dir, "changed_files")
    n = (F.col("doc_id") % 40).cast("string")
    tree = changed.select("repo", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("tests/test_m"), n, F.lit(".py"))).otherwise(F.concat(F.lit("src/m"), n, F.lit("_test.py"))).alias("path")).distinct()
    return evidence.near_tests(changed, tree)


@query("""WITH r AS (SELECT o_orderstatus AS outcome, o_totalprice AS run_s, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 2 ELSE 0 END AS fetch_s FROM orders),
l AS (SELECT 'run_s' AS stage, run_s AS s FROM r UNION ALL SELECT 'fetch_s', fetch_s FROM r WHERE fetch_s <> 0), n AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY s) - 1 AS nth, count(*) OVER (PARTITION BY stage) AS n FROM l)
SELECT stage, median(s) AS p50, max(s) FILTER (nth = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) AS p95, max(s) AS most, count(*) AS n FROM n GROUP BY stage""")
def run_latencies(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return evidence.stage_latencies(orders.select(F.col("o_totalprice").alias("run_s"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") / 2).otherwise(0.0).alias("fetch_s")), "run_s", "fetch_s")


@query("SELECT o_orderstatus AS outcome, count(*) AS repositories FROM orders GROUP BY 1")
def run_outcomes(spark, sf_dir):
    return evidence.outcome_table(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderstatus").alias("outcome")))


@query()
def chunked_files(spark, sf_dir):
    units = view(spark, sf_dir, "units").select("repo", "path", F.when(F.col("path").endswith(".md"), F.concat(F.lit("# Title\n"), F.replace("text", F.lit("\n"), F.lit("\n## Part\n")))).otherwise(F.col("text")).alias("content"))
    return chunking.file_units(units).select("unit_id", "repo", "kind", "path", "symbol", "start_line", "end_line", "char_count", "content_hash")


@query(ctes("comments") + """, h AS (SELECT *, diff_hunk LIKE '@@ -0,0%' AS fresh, string_split(diff_hunk, chr(10)) AS l FROM comments WHERE trim(diff_hunk) <> '')
SELECT id, 0 AS place, path, CASE WHEN fresh THEN 0 ELSE turn + 3 END AS old_start, CASE WHEN fresh THEN 0 ELSE 3 END AS old_lines, CASE WHEN fresh THEN 1 ELSE turn + 3 END AS new_start, CASE WHEN fresh THEN 2 ELSE 3 END AS new_lines,
 CASE WHEN NOT fresh THEN 'def f' || (conv_id % 9) END AS section, len(l) - 1 AS n_lines, array_to_string(l[2:], chr(10)) AS lines, diff_hunk AS text FROM h""")
def diff_hunks(spark, sf_dir):
    found = diffs.with_hunks(view(spark, sf_dir, "comments").select("id", "path", "diff_hunk"), "diff_hunk", "path")
    return found.select("id", F.col("at").alias("place"), "path", "old_start", "old_lines", "new_start", "new_lines", "section", F.size("lines").alias("n_lines"), F.array_join("lines", "\n").alias("lines"), diffs.hunk_text().alias("text"))


@query(ctes("comments") + """ SELECT id, CASE WHEN diff_hunk LIKE '@@ -0%' THEN 2 ELSE turn + 5 END AS line FROM comments WHERE trim(diff_hunk) <> '' AND path IS NOT NULL""")
def commented_lines(spark, sf_dir):
    hunks = diffs.with_hunks(view(spark, sf_dir, "comments").where("path is not null").select("id", "path", "diff_hunk"), "diff_hunk", "path")
    return diffs.commented_line(hunks, "id").withColumn("line", F.col("line").cast("long"))


@query(ctes("drafts") + """ SELECT run_id, 'pytest' AS parser, path || '::t' || line AS test, 'failed' AS kind, path AS file, CAST(NULL AS INTEGER) AS line, body AS message FROM drafts WHERE position < 25""")
def failures(spark, sf_dir):
    rows = view(spark, sf_dir, "drafts").groupBy("run_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.concat(F.lit("FAILED "), "path", F.lit("::t"), "line", F.lit(" - "), "body").alias("s")))), lambda x: x["s"]), "\n").alias("said"), F.count("*").alias("n")
    )
    runs = rows.select("run_id", F.lit("pytest").alias("framework"), F.concat(F.lit("==== short test summary info ====\n"), "said", F.lit("\n==== "), "n", F.lit(" failed in 0.1s ====")).alias("stdout"), F.lit("").alias("stderr"))
    return evidence.failures(evidence.evidence(runs)).select("run_id", "parser", "test", "kind", "file", "line", "message")


def _trees(spark, sf_dir):
    """Every five documents are a repository of five files, made of all their words."""
    units = view(spark, sf_dir, "units")
    manifest = F.when(F.col("doc_id") % 5 == 0, "pyproject.toml").when(F.col("doc_id") % 5 == 1, "requirements.txt").when(F.col("doc_id") % 5 == 2, "tests/test_a.py").when(F.col("doc_id") % 5 == 3, "package.json").otherwise("web/a.test.ts")
    words = F.filter(F.split(F.regexp_replace("text", "[^A-Za-z \\n]", ""), "[ \\n]+"), lambda w: w != "")
    listed = F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), ", ")
    content = F.when(manifest == "pyproject.toml", F.concat(F.lit('[project]\nname = "p"\ndependencies = ['), listed, F.lit("]\n[tool.pytest]\n"))).when(manifest == "package.json", '{"scripts": {"test": "vitest run"}}').otherwise(F.array_join(words, "\n"))
    return units.select(F.concat(F.lit("t"), F.floor(F.col("doc_id") / 5)).alias("repo"), manifest.alias("path"), content.alias("content"))


@query(ctes("drafts") + """ SELECT run_id, CASE run_id % 4 WHEN 0 THEN 'jest' WHEN 1 THEN 'vitest' WHEN 2 THEN 'node-test-spec' ELSE 'node-test-tap' END AS parser,
 CASE WHEN run_id % 4 < 2 THEN 'case ' || line || ' > step ' || position ELSE 'case ' || line || ' step ' || position END AS test, 'failed' AS kind, path AS file, line, body AS message FROM drafts WHERE position < 25""")
def runner_failures(spark, sf_dir):
    """Failures as four other runners print them, read back; a run's output says by itself which runner it was."""
    kind, rows = F.col("run_id") % 4, view(spark, sf_dir, "drafts")
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    name, path, at, said = F.concat(F.lit("case "), "line"), F.col("path"), F.col("line").cast("string"), F.col("body")
    step = F.concat(F.lit("step "), "position")
    told = (
        F.when(kind == 0, line("FAIL ./", path, "\n  ● ", name, " › ", step, "\n\n    ", said, "\n\n      at check (node_modules/lib/run.js:9:1)\n      at Object.<anonymous> (", path, ":", at, ":7)\n"))
        .when(kind == 1, line(" FAIL  ", path, " > ", name, " > ", step, "\n", said, "\n ❯ ", path, ":", at, ":5\n⎯⎯⎯⎯\n"))
        .when(kind == 2, line("test at ", path, ":", at, ":1\n✖ ", name, " ", step, " (0.4ms)\n  ", said, "\n"))
        .otherwise(line("not ok 1 - ", name, " ", step, "\n  ---\n  location: '/work/", path, ":", at, ":1'\n  error: '", said, "'\n  ...\n"))
    )
    joined = rows.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", told.alias("s")))), lambda x: x["s"]), "").alias("said"), F.count("*").cast("string").alias("n"))
    head = F.when(kind == 2, F.concat(F.lit("ℹ fail "), "n", F.lit("\n✖ failing tests:\n\n"))).otherwise("")
    tail = F.when(kind == 0, F.concat(F.lit("Test Suites: 1 failed\nTests:       "), "n", F.lit(" failed"))).when(kind == 1, F.concat(F.lit("      Tests  "), "n", F.lit(" failed"))).when(kind == 3, F.concat(F.lit("# fail "), "n")).otherwise("")
    runs = joined.select("run_id", F.lit("unknown").alias("framework"), F.concat(head, "said", tail).alias("stdout"), F.lit("").alias("stderr"))
    return evidence.failures(evidence.evidence(runs)).select("run_id", "parser", "test", "kind", "file", "line", "message")


_TREES = ctes("units") + r""", r AS (SELECT 't' || (doc_id // 5) AS repo, doc_id % 5 AS m, list_filter(string_split_regex(regexp_replace(text, '[^A-Za-z \n]', '', 'g'), '[ \n]+'), lambda w: w <> '') AS w FROM units)"""


@query(_TREES + """, asked AS (SELECT repo, 1 AS step, 0 AS place, 'setuptools>=40.8.0' AS said FROM r WHERE m = 0 UNION ALL SELECT repo, 1, 1, 'wheel' FROM r WHERE m = 0
  UNION ALL SELECT repo, CASE m WHEN 0 THEN 2 ELSE 7 END, generate_subscripts(w, 1), unnest(w) FROM r WHERE m IN (0, 1)),
once AS (SELECT repo, said, min(struct_pack(step := step, place := place)) AS first FROM asked WHERE NOT (lower(said) = 'p' AND repo IN (SELECT repo FROM r WHERE m = 0)) GROUP BY 1, 2)
SELECT repo, nth - 1 AS "at", said AS requirement FROM (SELECT repo, said, row_number() OVER (PARTITION BY repo ORDER BY first, said) AS nth FROM once) WHERE nth <= 300""")
def requirements(spark, sf_dir):
    return manifests.requirements(_trees(spark, sf_dir))


@query(_TREES + """, c AS (SELECT repo, count(*) FILTER (m = 2) AS py, count(*) FILTER (m = 4) AS js, count(*) FILTER (m = 0) > 0 AS config, count(*) FILTER (m = 3) > 0 AS script FROM r GROUP BY 1),
d AS (SELECT *, config OR py > 0 AS python, script AND (NOT (config OR py > 0) OR js > py) AS wins FROM c)
SELECT repo, CASE WHEN wins THEN 'vitest' WHEN python THEN 'pytest' END AS framework, py AS python_tests, js AS js_tests,
 CASE WHEN wins THEN 'package.json scripts.test: vitest run' WHEN config AND py > 0 THEN 'pytest: [tool.pytest] in pyproject.toml, ' || py || ' test files' WHEN config THEN 'pytest: [tool.pytest] in pyproject.toml, no test file'
  WHEN python THEN 'pytest: no configuration, ' || py || ' test files' ELSE 'no tests found' END AS reason,
 CASE WHEN python AND script THEN 'two suites: ' || py || ' Python and ' || js || ' JavaScript test files; the larger one is run, Python where they are as many' ELSE '' END AS notes FROM d""")
def frameworks(spark, sf_dir):
    return manifests.frameworks(_trees(spark, sf_dir)).withColumn("notes", F.array_join("notes", "; "))


@query(ctes("units") + r""", r AS (SELECT doc_id AS report_id, CASE WHEN doc_id % 3 = 0 THEN 'intro' || chr(10) || 'VERDICT ' || doc_id || ': Keep, ' || regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g') || chr(10) || 'VERDICT 9:' WHEN doc_id % 3 = 1 THEN '> VERDICT 1: kill' ELSE 'VERDICT ' || doc_id || ': maybe' END AS t FROM units)
SELECT report_id, CASE WHEN report_id % 3 = 0 THEN 2 ELSE 1 END AS number, report_id AS draft_id, CASE WHEN report_id % 3 = 0 THEN 'keep' END AS verdict, report_id % 3 <> 0 AS refused FROM r WHERE report_id % 3 <> 1""")
def verdict_lines(spark, sf_dir):
    kind = F.col("doc_id") % 3
    said = F.when(kind == 0, F.concat(F.lit("intro\nVERDICT "), "doc_id", F.lit(": Keep, "), F.regexp_replace("text", "[^A-Za-z0-9 ]", " "), F.lit("\nVERDICT 9:"))).when(kind == 1, "> VERDICT 1: kill").otherwise(F.concat(F.lit("VERDICT "), "doc_id", F.lit(": maybe")))
    return ledgers.verdict_lines(view(spark, sf_dir, "units").select(F.col("doc_id").alias("report_id"), said.alias("text"))).select("report_id", "number", "draft_id", "verdict", "refused")
