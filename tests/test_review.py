import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import assembly, diffs, evidence, manifests

PATCH = "@@ -10,3 +10,4 @@ class Reader:\n context\n-removed\n+added one\n+added two\n tail"


def test_hunks_and_lines(spark):
    rows = spark.createDataFrame([(1, "a.py", PATCH), (2, "b.py", "@@ -5 +5 @@\n-x\n+y\n\\ No newline at end of file"), (3, "c.py", "nothing"), (4, "d.py", None)], "id int, path string, patch string")
    hunks = diffs.with_hunks(rows, "patch", "path").cache()
    got = {r.id: r for r in hunks.collect()}
    assert set(got) == {1, 2} and (got[1].section, got[1].old_lines, got[1].new_lines) == ("class Reader:", 3, 4) and (got[2].old_lines, got[2].new_lines) == (1, 1)
    lines = diffs.hunk_lines(hunks, "id")
    assert [r.line for r in lines.where("id = 1 and marker = '+'").orderBy("at").collect()] == [11, 12]
    assert [(r.marker, r.line) for r in lines.where("id = 2").orderBy("at").collect()] == [("-", None), ("+", 5), ("\\", None)]
    assert {r.id: r.line for r in diffs.commented_line(hunks, "id").collect()} == {1: 13, 2: 5}
    assert hunks.where("id = 1").select(diffs.hunk_text().alias("t")).first().t == PATCH


def test_counts_decide_what_is_content():
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,3 +1,3 @@\n--- note\n+++ more\n same\n\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\n--- a/z\n+++ b/z\n@@ -1 +1 @@\n-a\n+b"
    got = [(h["path"], h["lines"]) for h in diffs.hunks_of(diff, None)]
    assert got == [("x", ["--- note", "+++ more", " same", ""]), ("z", ["-a", "+b"])]


def fit(spark, costs, budget):
    rows = spark.createDataFrame([(1, i, c, budget) for i, c in enumerate(costs)], "pr int, position int, costs array<bigint>, budget bigint")
    return [r.variant for r in assembly.fitted(rows, "pr").orderBy("position").collect()]


def test_fit(spark):
    assert fit(spark, [[1000, 100]] * 3, 1100) == [1, 1, 1]
    assert fit(spark, [[100], [5000], [100]], 300) == [0, None, 0]
    assert fit(spark, [[400, 67]] * 2, 500) == [0, 1]


def test_rank_weights_tests_and_docs(spark):
    rows = spark.createDataFrame([(1, "tests/test_a.py", ["+x"] * 3, 0), (1, "a.py", ["+x"] * 2, 1), (1, "b.py", ["+x"] * 2, 2), (1, "docs/c.md", ["+x"] * 5, 3)], "pr int, path string, lines array<string>, position int")
    assert [r.path for r in assembly.ranked_hunks(rows, "pr").orderBy("rank").collect()] == ["docs/c.md", "a.py", "b.py", "tests/test_a.py"]


def test_rendering_with_a_window(spark):
    hunks = spark.createDataFrame([(1, "a.py", 3, 2, ["-old", "+new", " same"]), (2, "b.py", 1, 100, ["+" + "x" * 250] * 100)], "id int, path string, new_start int, new_lines int, lines array<string>")
    files = spark.createDataFrame([(1, [f"l{i}" for i in range(1, 7)])], "id int, lines array<string>")
    got = {r.id: r.rendering for r in assembly.rendered(hunks, "id", files=files).collect()}
    assert got[1] == "a.py\n    1 . l1\n    2 . l2\n      - old\n    3 + new\n    4   same\n    5 . l5\n    6 . l6"
    assert got[2].count("\n") == 81 and got[2].endswith("      ... 20 more lines of this hunk not shown") and " [cut]" in got[2]


def test_imports(spark):
    module = ["# doc", "import os", "from a import (", "    b,", ")", "x = 1", "from c import d, \\", "    e", "def f():", "    import late", "import later"]
    script = ["const a = require('b')", "export { x } from 'y'", "export const z = 1"]
    files = spark.createDataFrame([("a.py", module), ("b.js", script), ("c.md", module), ("d.py", []), ("e.py", None)], "path string, lines array<string>")
    got = {r.path: [(x.number, x.line) for x in r.imports] for r in assembly.imports(files).collect()}
    assert [n for n, _ in got["a.py"]] == [2, 3, 4, 5, 7, 8] and got["b.js"] == [(1, script[0]), (2, script[1])]
    assert got["c.md"] == got["d.py"] == got["e.py"] == []


def test_import_budget(spark):
    small, large, other = [{"number": 1, "line": "import a"}], [{"number": i, "line": "import " + "b" * 90} for i in range(40)], [{"number": i, "line": "import " + "c" * 60} for i in range(30)]
    rows = spark.createDataFrame([(1, "a.py", 1, small), (1, "b.py", 2, large), *((1, f"c{i}.py", 3 + i, other) for i in range(4)), (1, "z.py", 9, small)], "pr int, path string, place int, imports array<struct<number:int,line:string>>")
    got = [r.path for r in assembly.import_sections(rows, "pr").orderBy("place").collect()]
    assert got == ["a.py", "c0.py", "c1.py", "c2.py", "z.py"]


def test_past_comments_stop_below_the_pull(spark):
    comments = spark.createDataFrame([(i, "r", pr, "parse header value " + "x" * 700, "ann") for i, pr in enumerate((10, 20, 30, 40))] + [(9, "r", 10, "parse header", "ci[bot]"), (8, "q", 10, "parse header", "ann")], "comment_id int, repo string, pr int, body string, login string")
    queries = spark.createDataFrame([(1, "r", 30, "parse_header(value)")], "query_id int, repo string, pr int, query string")
    got = assembly.past_comments(queries, comments).orderBy("rank").collect()
    assert [r.comment_id for r in got] == [0, 1] and got[0].body.endswith(" [cut]") and len(got[0].body) == 606


def test_variants_and_past_text(spark):
    past = F.array(F.struct(F.lit("a.py").alias("path"), F.lit(7).alias("pr"), F.lit("why").alias("body")))
    row = spark.range(1).select(assembly.past_text(F.lit(2), past).alias("p")).first()
    assert row.p == "Past review comments in this repository, nearest first:\n[2.1] a.py (#7) why"
    none = F.lit(None).cast("string")
    got = spark.range(1).select(assembly.block_variants(F.lit(1), F.lit("b"), F.lit("w"), F.lit("p")).alias("a"), assembly.block_variants(F.lit(1), F.lit("b"), F.lit("w"), none).alias("b"), assembly.block_variants(F.lit(1), F.lit("b"), none, none).alias("c")).first()
    assert list(got) == [["Hunk 1\nw\np", "Hunk 1\nb\np", "Hunk 1\nb"], ["Hunk 1\nw", "Hunk 1\nb"], ["Hunk 1\nb"]]


def test_openrafted_code_and_past_shown(spark):
    lines = spark.createDataFrame([(1, "a", 3, "x = 1"), (1, "a", None, "gone")], "run_id int, path string, line int, code string")
    drafts = spark.createDataFrame([(1, "a", 3), (1, "a", 4)], "run_id int, path string, line int")
    assert {r.line: r.code for r in assembly.drafted_code(drafts, lines).collect()} == {3: "x = 1", 4: ""}
    chosen = spark.createDataFrame([(1, "Past review comments in this repository, nearest first:\n..", 3), (1, "bare", 4)], "run_id int, rendering string, n_past int")
    assert assembly.past_shown(chosen).first().past_shown == 3


def test_grep_takes_bad_patterns_literally(spark):
    files = spark.createDataFrame([(1, 0, "a", ["x (", "y", " x ( z "])], "request_id int, position int, path string, lines array<string>")
    assert [(r.line, r.said) for r in assembly.grep(files, "x (").orderBy("line").collect()] == [(1, "x ("), (3, "x ( z")]


# ---- test output

PYTEST = """=== ERRORS ===
___ ERROR at setup of test_open ___
checks/test_cart.py:22: in fixture
E   OSError: disk
=== FAILURES ===
___ test_total ___
checks/test_cart.py:13: in test_total
E   assert 'k' in {}
E    +  and more of it
___ Cart.test_tax ___
money.py:3: in round_up
checks/test_cart.py:31: in test_tax
E   KeyError: 'z'
=== short test summary info ===
FAILED checks/test_cart.py::test_total - assert 'k' in {}
FAILED checks/test_cart.py::Cart::test_tax
ERROR checks/test_cart.py::test_open - OSError: disk
=== 2 failed, 1 passed, 1 error in 0.02s ==="""
JEST = """FAIL ./cart.spec.js
  ● cart › totals
    expect(element).toHaveLength(3)
      at Object.<anonymous> (node_modules/x/y.js:1:2)
      at fn (helper.js:4:5)
      at Object.<anonymous> (cart.spec.js:8:20)
  ● Test suite failed to run
    Cannot find module
Test Suites: 1 failed
Tests:       2 failed, 1 skipped, 3 passed, 6 total"""
VITEST = """ FAIL  web/price.test.ts > cart > totals
TypeError: price is null
 ❯ helper.ts:1:1
 ❯ web/price.test.ts:9:3
⎯⎯⎯⎯
 FAIL  web/load.test.ts [ web/load.test.ts ]
Error: cannot open it
 Test Files  2 failed
      Tests  1 failed | 4 passed (5)"""
SPEC = """ℹ pass 1
ℹ fail 1
✖ failing tests:

test at a.test.js:5:1
✖ rounds up (1.5ms)
  RangeError: too far"""
TAP = """# Subtest: g
    not ok 1 - rounds down
      ---
      location: '/work/a.test.js:5:1'
      error: |-
        off by one
      ...
not ok 1 - g
  ---
  error: '1 subtest failed'
  ...
# pass 0
# fail 2
# skipped 0"""


@pytest.mark.parametrize(
    "framework,out,parser,failures,counts",
    [
        ("pytest", PYTEST, "pytest", [("checks/test_cart.py::test_total", "failed", "checks/test_cart.py", 13, "assert 'k' in {}"), ("checks/test_cart.py::Cart::test_tax", "failed", "checks/test_cart.py", 31, "KeyError: 'z'"), ("checks/test_cart.py::test_open", "error", "checks/test_cart.py", 22, "OSError: disk")], (1, 2, 1, None)),
        ("pytest", "\x1b[1mResults (0.4s):\n  41 passed\n   2 skipped\n", "pytest", [], (41, None, None, 2)),
        ("jest", JEST, "jest", [("cart > totals", "failed", "cart.spec.js", 8, "expect(element).toHaveLength(3)"), ("Test suite failed to run", "error", "cart.spec.js", None, "Cannot find module")], (3, 2, None, 1)),
        ("vitest", VITEST, "vitest", [("cart > totals", "failed", "web/price.test.ts", 9, "TypeError: price is null"), ("web/load.test.ts", "error", "web/load.test.ts", None, "Error: cannot open it")], (4, 1, None, None)),
        ("node-test", SPEC, "node-test-spec", [("rounds up", "failed", "a.test.js", 5, "RangeError: too far")], (1, 1, None, None)),
        ("unknown", TAP, "node-test-tap", [("rounds down", "failed", "a.test.js", 5, "off by one")], (0, 2, None, 0)),
    ],
)
def test_output_readers(spark, framework, out, parser, failures, counts):
    got = evidence.evidence(spark.createDataFrame([(1, framework, out, "")], "run_id int, framework string, stdout string, stderr string")).first()
    assert got.parser == parser and [tuple(f) for f in got.failures] == failures and tuple(got.counts) == counts


def test_output_is_split_into_lines_once(spark):
    runs = spark.createDataFrame([(1, "unknown", "✖ other\ntest at a.js:3:4\n✖ t (1ms)\n  bad\nℹ fail 1", "")], "run_id int, framework string, stdout string, stderr string")
    found = evidence.evidence(runs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate ") <= 1  # the titles of a summary's entries
    assert [tuple(r) for r in evidence.failures(found).collect()] == [(1, "node-test-spec", "t", "failed", "a.js", 3, "bad")]


def test_output_is_read_inside_its_row(spark):
    """Nothing of a run's output is shuffled, and a failure's array is not computed for a filter of its own."""
    rows = [(i, "unknown", out, "") for i, out in enumerate((PYTEST, JEST, VITEST, SPEC, TAP))]
    found = evidence.failures(evidence.evidence(spark.createDataFrame(rows, "run_id int, framework string, stdout string, stderr string")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Filter (size(" not in plan
    assert found.where("run_id = 0").count() == 3


def test_output_of_a_known_framework_is_read_as_its_own(spark):
    rows = [(i, framework, f"{PYTEST}\n{VITEST}", "") for i, framework in enumerate(("vitest", "pytest", "jest", None))]
    found = evidence.evidence(spark.createDataFrame(rows, "run_id int, framework string, stdout string, stderr string"))
    assert {r.run_id: r.parser for r in found.collect()} == {0: "vitest", 1: "pytest", 2: "pytest", 3: "pytest"}


def test_output_is_bounded_and_never_fails(spark):
    many = "short test summary info\n" + "\n".join(f"FAILED t.py::t{i} - no" for i in range(4000)) + "\n== 4000 failed in 1s"
    r = random.Random(1)
    rows = [(0, "pytest", many, ""), (1, None, None, None)]
    for i, whole in enumerate((PYTEST, JEST, VITEST, SPEC, TAP) * 8):
        cut = whole[: r.randrange(len(whole))]
        rows.append((10 + i, "jest", "".join(r.sample(cut, len(cut))) if i % 2 else cut, "x" * 9000))
    rows.append((99, "node-test", "    not ok 1 - a\n" * 4000, None))
    found = evidence.evidence(spark.createDataFrame(rows, "run_id int, framework string, stdout string, stderr string")).cache()
    assert found.count() == len(rows) and all(len(r.excerpt) <= 4000 for r in found.collect())
    assert evidence.failures(found).where("run_id = 0").count() == 25 and {r.run_id: r.omitted for r in found.where("omitted > 0").collect()} == {0: 3975, 99: 3975}
    assert found.where("run_id = 1").first().parser is None


def test_manifests_are_parsed_once(spark):
    files = spark.createDataFrame([("r", "pyproject.toml", '[project]\nname = "p"\ndependencies = ["a"]\n')], "repo string, path string, content string")
    found = manifests.requirements(files)
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.requirement for r in found.orderBy("at").collect()] == ["setuptools>=40.8.0", "wheel", "a"]


def test_requirements(spark):
    files = {
        "pyproject.toml": '[build-system]\nrequires = ["flit_core"]\n[project]\nname = "Cart_Tools"\ndependencies = ["attrs>=23", "cart-tools[dev]"]\n[project.optional-dependencies]\ndev = ["pyflakes", "x @ https://e.org/y.zip"]\n[dependency-groups]\ntest = ["pytest", {include-group = "more"}]\nmore = ["pyright"]\nlint = ["black"]\n',
        "requirements.txt": "a==1 # why\n-r requirements/test.txt\n-e .\n# no\nb \\\n  >=2 --hash=sha256:00\n-r ../outside.txt\n", "requirements/test.txt": "c\n-r ../requirements.txt\n", "setup.cfg": "[options]\ninstall_requires =\n  d\n  e[x]>=1; python_version < '3'\n",
    }
    odd = {"a": '[tool.poetry]\ngroup = "x"\n', "b": '[tool.poetry.group]\ntest = "x"\n', "c": '[project]\noptional-dependencies = ["a"]\n', "d": "x = " + "[" * 3000, "e": "broken ["}
    rows = [("r", p, c) for p, c in files.items()] + [("s", "setup.py", "")] + [(k, "pyproject.toml", v) for k, v in odd.items()]
    rows += [("p", "pyproject.toml", '[tool.poetry.dependencies]\npython = "^3.9"\nattrs = "*"\nslow = {version = "1", optional = true}\n[tool.poetry.group.dev.dependencies]\npyflakes = "*"\n')]
    got: dict[str, list[str]] = {}
    for row in manifests.requirements(spark.createDataFrame(rows, "repo string, path string, content string")).orderBy("repo", "at").collect():
        got.setdefault(row.repo, []).append(row.requirement)
    assert got["r"] == ["flit_core", "attrs>=23", "pyflakes", "pytest", "pyright", "d", "e[x]>=1; python_version < '3'", "a==1", "b    >=2", "c"]
    assert got["s"] == got["c"] == ["setuptools>=40.8.0", "wheel"] and got["p"] == ["attrs", "pyflakes"] and not set("abde") & set(got)


def test_frameworks(spark):
    rows = [("py", "tests/test_a.py", "x"), ("py", "pytest.ini", "[pytest]"), ("js", "package.json", '{"scripts": {"test": "vitest run"}}'), ("both", "package.json", '{"scripts": {"test": "node --test"}}'), ("both", "a_test.py", ""), ("both", "x.test.ts", ""), ("both", "__tests__/y.js", ""),
            ("tie", "package.json", '{"scripts": {"test": "jest"}}'), ("tie", "test_a.py", ""), ("tie", "x.spec.js", ""), ("go", "go.mod", ""), ("none", "a.c", ""), ("fake", "package.json", '{"scripts": {"test": "echo no test specified"}}'), ("vendored", "node_modules/test_a.py", "")]
    got = {r.repo: r.framework for r in manifests.frameworks(spark.createDataFrame(rows, "repo string, path string, content string")).collect()}
    assert got == {"py": "pytest", "js": "vitest", "both": "node-test", "tie": "pytest", "go": None, "none": None, "fake": None, "vendored": None}


def test_regressions_need_clean_runs(spark):
    head = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "run_id int, test string")
    base = spark.createDataFrame([(1, "b")], "run_id int, test string")
    runs = spark.createDataFrame([(1, True, True), (2, True, False)], "run_id int, head_ok boolean, base_ok boolean")
    assert [tuple(r) for r in evidence.regressions(head, base, runs).collect()] == [(1, "a")]


def test_lines_of_the_new_file_are_found_without_moving_them(spark):
    from tessera.operators import diffs

    rows = [(1, "a", 5, ["+x", "-y", " z", "", "\\\\ no end", "+w"]), (2, "b", 1, ["-only"]), (3, "c", 9, []), (4, "d", 1, ["+1"] * 50)]
    hunks = spark.createDataFrame(rows, "doc_id int, path string, new_start int, lines array<string>")
    found = diffs.new_lines(hunks, "doc_id")
    want = diffs.hunk_lines(hunks, "doc_id").where("line is not null").select("doc_id", "path", "line")
    assert found.schema["line"].dataType == want.schema["line"].dataType
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == 54
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_only_considered_hunks_are_rendered(spark, monkeypatch):
    from tessera.operators import assembly
    from tessera.plans import review_queries

    seen, plain = [], assembly.rendered
    monkeypatch.setattr(assembly, "rendered", lambda hunks, *a, **b: seen.append(hunks.groupBy("repo", "pr").count().agg({"count": "max"}).first()[0]) or plain(hunks, *a, **b))
    rows = [(350 * i, "+a " * 9, "en", "s", 5) for i in range(1, 40)]
    monkeypatch.setattr(review_queries, "view", lambda *a: spark.createDataFrame([(d, "r", 1, "src/m.py", "modified", 1, t, 3) for d, t, *_ in rows], "doc_id long, repo string, pr long, path string, status string, changes long, text string, new_start long"))
    assert review_queries.packed_blocks(spark, "").count() == assembly.CANDIDATES
    assert seen == [assembly.CANDIDATES] * 2
