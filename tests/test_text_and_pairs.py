import pytest
from pyspark.sql import functions as F

from tessera.functions import ids, text
from tessera.operators import pairs


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"]).select(expr.alias("out")).first().out


@pytest.mark.parametrize("said,lines", [("a\r\nb\nc\r", ["a", "b", "c"]), ("", []), ("\n", [""]), ("a b\x0bc\x85d", ["a", "b", "c", "d"]), ("a\n\nb", ["a", "", "b"])])
def test_split_lines(spark, said, lines):
    assert one(spark, text.split_lines(F.col("t")), t=said) == lines == said.splitlines()


@pytest.mark.parametrize(
    "body,reason",
    [("LGTM", "acknowledgement"), ("+1", "acknowledgement"), ("Thank you! Done in the last push.", "acknowledgement"), ("\U0001f680\U0001f680", "emoji_only"), ("Why not a set?", "short"),
     ("Great work, yet the retry loop never ends once the socket has been closed by the peer.", None), ("このループは接続が閉じた後も終わらないようです。終了条件を確かめる処理を先に置いたほうが安全だと思います。", None)],
)
def test_nit_reason(spark, body, reason):
    assert one(spark, text.nit_reason(F.col("b")), b=body) == reason


def test_before_state(spark):
    hunk = "@@ -1,3 +1,3 @@ def f():\n context\n-old\n+new\n\\ No newline at end of file"
    assert one(spark, text.before_state(F.col("h")), h=hunk) == "def f():\ncontext\nold"
    assert one(spark, text.before_state(F.col("h")), h="@@ -0,0 +1,2 @@\n+a\n+b") == ""


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="max_row_sum(readBlockSize) XMLWriter __q__ 7") == ["max_row_sum", "max", "row", "sum", "readblocksize", "read", "block", "size", "xmlwriter", "xml", "writer", "q", "7"]


def test_paths(spark):
    rows = spark.createDataFrame([("a/b.py",), ("README.MD",), ("x/node_modules/y.py",), ("p.egg-info/z.txt",), ("Makefile",), ("a.tar/b",), (None,)], "path string")
    got = [tuple(r) for r in rows.select(text.file_kind(F.col("path")), text.is_skipped_path(F.col("path")), text.language(F.col("path"))).collect()]
    assert got == [("source", False, "python"), ("doc", False, "docs"), ("source", True, "python"), ("doc", True, "docs"), (None, False, "none"), (None, False, "none"), (None, None, "none")]


def test_file_and_pull_skips(spark):
    rows = spark.createDataFrame([("a.py", "removed", 1, "x"), ("a.py", "renamed", 0, None), ("yarn.lock", "modified", 1, "x"), ("vendor/a.py", "modified", 1, "x"), ("a.png", "added", 0, None), ("vendor", "added", 1, "x")], "p string, s string, c int, t string")
    assert [r[0] for r in rows.select(text.file_skip_reason(*map(F.col, "psct"))).collect()] == ["deleted", "renamed without changes", "lockfile or generated", "vendored", "no patch: binary or too large", None]
    assert one(spark, text.pull_skip_reason(F.col("d"), F.col("a")), d=False, a="renovate[bot]") == "bot"


def test_seed_source(spark):
    got = one(spark, text.seed_source(F.col("r"), F.col("b"), "own/testbed"), r="Own/Testbed", b="seed/psf__black/17/head")
    assert (got.repo, got.number) == ("psf/black", 17)
    assert one(spark, text.seed_source(F.col("r"), F.col("b"), "own/testbed"), r="other/repo", b="seed/psf__black/17/head") is None
    assert one(spark, text.seed_source(F.col("r"), F.col("b"), "own/testbed"), r="own/testbed", b="seed/psf__black/0/head") is None


def test_body_only_takes_only_what_was_put_in_front(spark):
    built = text.joined(F.lit("a.py:3"), F.col("h"), F.col("b"))
    assert one(spark, text.body_only(built, F.lit("a.py"), F.col("h")), h="@@ x\n+y", b="body\n\n@@ x\n+y") == "body\n\n@@ x\n+y"
    assert one(spark, text.body_only(F.col("b"), F.lit(None).cast("string"), F.lit("")), b="a.py:3\n\nbody") == "a.py:3\n\nbody"


def test_ids(spark):
    import hashlib

    assert one(spark, ids.unit_id(F.lit("r"), F.lit("k"), F.lit("i"))) == hashlib.sha256(b"r\0k\0i").hexdigest()
    a = ids.content_hash(b=F.lit(1), a=F.lit(None).cast("string"))
    assert one(spark, a) == hashlib.sha256(b'{"a":null,"b":1}').hexdigest()


COMMENT = "id bigint, in_reply_to_id bigint, path string, diff_hunk string, body string, login string, user_type string, pull_request_url string, repo string"
HUNK, SAID = "@@ -1 +1 @@ f\n old line\n-gone\n+new", "This needs a guard for the empty list, else it raises here."


def comment(i, pr, **more):
    row = {"id": i, "in_reply_to_id": None, "path": "a.py", "diff_hunk": HUNK, "body": SAID, "login": "ann", "user_type": "User", "pull_request_url": f"https://x/pulls/{pr}", "repo": "r", **more}
    return tuple(row.values())


def test_first_rule_wins(spark):
    rows = [comment(1, 1), comment(2, 1, path=None, in_reply_to_id=5), comment(3, 1, in_reply_to_id=5, login="x[bot]"), comment(4, 1, login=None, body=None), comment(5, 1, body=None), comment(6, 1, user_type="Bot"), comment(7, 1, login="Copilot"),
            comment(8, 1, diff_hunk="@@ -0,0 +1 @@\n+x"), comment(9, 1, body=f"You wrote\n{HUNK}\nwhich is wrong in more than one way."), comment(10, 1, diff_hunk="  ")]
    got = {r.id: r.drop_reason for r in pairs.screened(spark.createDataFrame(rows, COMMENT)).collect()}
    assert got == {1: None, 2: "no_path_or_hunk", 3: "reply", 4: "bot", 5: "short", 6: "bot", 7: "bot", 8: "empty_before_state", 9: "body_quotes_hunk", 10: "no_path_or_hunk"}


def test_mining_example(spark):
    rows = [comment(1, 10), comment(2, 11), comment(3, 12), comment(4, 13), comment(5, 14), comment(6, 10, body="LGTM"), comment(7, 10, in_reply_to_id=1)]
    comments = spark.createDataFrame(rows, COMMENT)
    pulls = spark.createDataFrame([("r", 10, True, "bob"), ("r", 11, True, "ANN"), ("r", 12, False, "bob"), ("r", 13, True, "bob"), ("r", 14, True, "bob")], "repo string, number bigint, merged boolean, author string")
    gold = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 6, 7)], "id bigint").select(ids.unit_id(F.lit("r"), F.lit("review_comment"), F.concat(F.lit("review_comment/"), F.col("id").cast("string"))).alias("unit_id"))
    got = {r.id: r.drop_reason for r in pairs.mined(comments, gold, pulls).collect()}
    assert got == {1: None, 4: None, 2: "self_review", 3: "not_merged", 5: "gold_not_in_corpus", 6: "acknowledgement", 7: "reply"}


def test_caps(spark):
    rows = spark.createDataFrame([("r", 1, i, None) for i in (50, 10, 40, 30, 20)], "repo string, pull_request int, id bigint, drop_reason string")
    assert sorted(r.id for r in pairs.capped_per_pull(rows).where("drop_reason is null").collect()) == [10, 20, 30]
    many = spark.createDataFrame([(f"r{n}", i, i, None) for n in (100, 10, 4) for i in range(n)], "repo string, pull_request int, id bigint, drop_reason string")
    kept = pairs.capped_per_repo(many).where("drop_reason is null")
    assert {r.repo: r["count"] for r in kept.groupBy("repo").count().collect()} == {"r100": 10, "r10": 10, "r4": 4}
    assert sorted(r.id for r in kept.where("repo = 'r100'").collect()) != list(range(10))
    zero = many.unionByName(spark.createDataFrame([("none", 1, 1, "short")], many.schema))
    assert pairs.repo_cap(zero).first().cap == 7


def test_split_guard(spark):
    rows, allowed = spark.createDataFrame([("A/x",), ("b/y",)], "repo string"), spark.createDataFrame([("a/X",)], "repo string")
    assert [r.repo for r in pairs.refused(rows, allowed).collect()] == ["b/y"]


def test_pull_facts_and_frozen_digest(spark):
    facts = "repo string, number bigint, merged boolean, author string"
    got = pairs.pull_facts(spark.createDataFrame([("r", 1), ("r", 2)], "repo string, number bigint"), spark.createDataFrame([("r", 1, True, "a"), ("r", 9, True, "z")], facts), spark.createDataFrame([("r", 1, False, "no"), ("r", 2, True, "b")], facts))
    assert sorted(tuple(r) for r in got.collect()) == [("r", 1, True, "a"), ("r", 2, True, "b")]
    rows = pairs.screened(spark.createDataFrame([comment(i, 1) for i in range(9)], COMMENT))
    assert pairs.frozen_digest(rows.repartition(5)).first() == pairs.frozen_digest(rows.orderBy(F.col("id").desc())).first()
