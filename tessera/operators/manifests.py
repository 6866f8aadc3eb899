"""What a repository's manifests say: its test framework, and what it asks a package index for.

Manifests become rows (repo, source, place, said): one helper flattens a TOML or INI text into (key, value)
pairs, everything after it is column work: choosing keys, following includes by joins, and ordering.
"""

from __future__ import annotations

import configparser
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.session import materialized

MAX_REQUIREMENTS, INCLUDES_DEEP, GROUPS_DEEP = 300, 3, 5
# Files of requirements, groups that tests need, folders that hold no tests of the project, other languages' manifests.
REQUIREMENT_FILES = (
    "requirements.txt", "requirements-test.txt", "requirements_test.txt", "requirements-tests.txt", "test-requirements.txt", "test_requirements.txt", "requirements-dev.txt",
    "requirements_dev.txt", "dev-requirements.txt", "dev_requirements.txt", "requirements/test.txt", "requirements/tests.txt", "requirements/testing.txt", "requirements/dev.txt",
)
GROUP_KEYS = ("test", "tests", "testing", "dev")
UNSCANNED = (".git", "node_modules", ".venv", "venv", ".tox", ".nox", "__pycache__", "site-packages", "dist", "build", ".mypy_cache", ".pytest_cache")
OTHER_LANGUAGES = {"go.mod": "Go", "Cargo.toml": "Rust", "pom.xml": "Java", "build.gradle": "Java or Kotlin", "build.gradle.kts": "Kotlin", "Gemfile": "Ruby", "composer.json": "PHP", "mix.exs": "Elixir", "Package.swift": "Swift"}


def pairs_of(path: str, content: str) -> list[tuple[str, int, str | None]]:
    """(dotted key, place in its list, value) of every leaf of a TOML or INI text; nothing where it does not parse.

    Keys of tables are leaves too, without a value where the table has more in it.
    """
    out: list[tuple[str, int, str | None]] = []
    try:
        if path.endswith(".toml"):
            todo = [("", 0, tomllib.loads(content))]
        else:
            ini = configparser.ConfigParser(interpolation=None)
            ini.read_string(content)
            todo = [("", 0, {s: {k: v.splitlines() for k, v in ini.items(s)} for s in ini.sections()})]
    except (tomllib.TOMLDecodeError, configparser.Error, RecursionError, UnicodeError, ValueError):
        return []
    while todo:
        key, place, value = todo.pop()
        if isinstance(value, dict):
            out.append((key, place, None))
            todo += [(f"{key}.{k}" if key else k, i, v) for i, (k, v) in enumerate(value.items())]
        elif isinstance(value, list):
            todo += [(f"{key}[]" if isinstance(v, dict) else key, i, v) for i, v in enumerate(value)]
        else:
            out.append((key, place, str(value)))
    return out


def flattened(files: DataFrame) -> DataFrame:
    """(repo, path, key, place, value) of (repo, path, content); a file is one row, and nothing is shuffled."""
    kind = pa.list_(pa.struct([("key", pa.string()), ("place", pa.int32()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"key": k, "place": i, "value": v} for k, i, v in pairs_of(path, content or "")] for path, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["repo", "path", "pairs"])

    flat = files.select("repo", "path", "content").mapInArrow(run, "repo string, path string, pairs array<struct<key:string,place:int,value:string>>")
    return flat.select("repo", "path", F.inline("pairs"))


def _listed(files: DataFrame) -> DataFrame:
    """(repo, rank, place, said): lines of the requirement files, and of what they include, a file's own before those it includes."""
    lines = files.select("repo", "path", F.posexplode(F.split(F.regexp_replace("content", r"\\\r?\n", " "), r"\r?\n")).alias("place", "line"))
    said = F.trim(F.regexp_replace("line", r"(^| )#.*$", ""))
    include = r"^(?:-r|--requirement)[ =]\s*(\S+)$"
    lines = materialized(lines.withColumn("said", said).where("said <> ''").withColumn("include", F.when(F.col("said").rlike(include), F.regexp_extract("said", include, 1))))
    folded = lambda p: F.regexp_replace(F.regexp_replace(p, r"(^|/)\./", "$1"), r"(^|/)[^/.][^/]*/\.\./", "$1")
    target = folded(folded(F.concat(F.regexp_replace("path", "[^/]*$", ""), "include")))
    own = lines.where("include is null and said not like '-%'").select("repo", "path", "place", F.trim(F.regexp_replace("said", r" --.*$", "")).alias("said"))
    edges = lines.where("include is not null").select("repo", "path", target.alias("to")).distinct()
    rank = F.array_position(F.array(*map(F.lit, REQUIREMENT_FILES)), F.col("path"))
    level = files.where(F.col("path").isin(*REQUIREMENT_FILES)).select("repo", "path", rank.alias("rank"))
    out = level.withColumn("deep", F.lit(0))
    for deep in range(1, INCLUDES_DEEP + 1):
        level = level.join(edges, ["repo", "path"]).select("repo", F.col("to").alias("path"), "rank").distinct()
        out = out.unionByName(level.withColumn("deep", F.lit(deep)))
    return out.join(own, ["repo", "path"]).select("repo", F.concat_ws("/", F.lpad(F.col("rank").cast("string"), 3, "0"), "deep", "path").alias("rank"), "place", "said")


def _grouped(pairs: DataFrame) -> DataFrame:
    """(repo, rank, place, said): entries of the dependency groups that tests need, and of the groups these include."""
    key = F.regexp_extract("key", r"^dependency-groups\.(.+?)(\[\]\.include-group)?$", 1)
    groups = pairs.where("path = 'pyproject.toml' and key like 'dependency-groups.%' and value is not null").select("repo", key.alias("group"), F.col("key").like("%[].include-group").alias("includes"), "place", "value")
    named = groups.select("repo", "group").where(F.col("group").isin(*GROUP_KEYS)).distinct()
    uv = pairs.where("path = 'pyproject.toml' and key = 'tool.uv.default-groups'").select("repo", F.col("value").alias("group"))
    level = named.union(uv).distinct().select("repo", "group", F.col("group").alias("top"))
    out = level.withColumn("deep", F.lit(0))
    for deep in range(1, GROUPS_DEEP + 1):
        level = level.join(groups.where("includes").select("repo", "group", F.col("value").alias("next")), ["repo", "group"]).select("repo", F.col("next").alias("group"), "top").distinct()
        out = out.union(level.withColumn("deep", F.lit(deep)))
    rank = F.lpad(F.coalesce(F.array_position(F.array(*map(F.lit, GROUP_KEYS)), F.col("top")).cast("string"), F.lit("9")), 3, "0")
    return out.join(groups.where("not includes"), ["repo", "group"]).select("repo", F.concat_ws("/", rank, "top", "deep", "group").alias("rank"), "place", F.col("value").alias("said"))


def requirements(files: DataFrame) -> DataFrame:
    """(repo, at, requirement) from (repo, path, content): what a Python project's manifests ask an index for, each once, in order, at most MAX_REQUIREMENTS.

    A manifest that does not parse says nothing. A project's own extras stand for what they list.
    """
    manifests = files.where(F.col("path").isin("pyproject.toml", "setup.py", "setup.cfg", *REQUIREMENT_FILES) | F.col("path").rlike(r"^requirements[^/]*/?[^/]*\.(txt|in)$"))
    pairs = materialized(flattened(manifests.where(F.col("path").isin("pyproject.toml", "setup.cfg"))))  # read in many steps, parsed once
    about = pairs.where("path = 'pyproject.toml'")
    builds = about.where("key = 'build-system'").select("repo").distinct()
    installable = about.where("key = 'project'").select("repo").union(manifests.where("path in ('setup.py', 'setup.cfg')").select("repo")).distinct()
    default = installable.join(builds, "repo", "left_anti").select("repo", F.posexplode(F.array(F.lit("setuptools>=40.8.0"), F.lit("wheel"))).alias("place", "said"))
    value = lambda step, where, rank=F.lit(""): pairs.where(where).where("value is not null").select("repo", F.lit(step).alias("step"), rank.alias("rank"), "place", F.col("value").alias("said"))
    of_step = lambda step, rows: rows.select("repo", F.lit(step).alias("step"), "rank", "place", "said")
    extras = value(3, "path = 'pyproject.toml' and key like 'project.optional-dependencies.%'", F.col("key"))
    optional = about.where("key like 'tool.poetry.%.optional' and value = 'True'").select("repo", F.regexp_replace("key", r"\.optional$", "").alias("entry")).distinct()
    poetry = rf"^(tool\.poetry\.(?:dependencies|dev-dependencies|group\.(?:{'|'.join(GROUP_KEYS)})\.dependencies)\.[^.]+)(?:\..*)?$"
    locked = about.where(F.col("key").rlike(poetry)).select("repo", F.regexp_extract("key", poetry, 1).alias("entry")).distinct().join(optional, ["repo", "entry"], "left_anti")
    locked = locked.select("repo", F.regexp_replace("entry", r"\.[^.]+$", "").alias("rank"), F.lit(0).alias("place"), F.substring_index("entry", ".", -1).alias("said")).where("lower(said) <> 'python'")
    asked = (
        value(1, "path = 'pyproject.toml' and key = 'build-system.requires'").unionByName(of_step(1, default.withColumn("rank", F.lit(""))))
        .unionByName(value(2, "path = 'pyproject.toml' and key = 'project.dependencies'")).unionByName(extras).unionByName(of_step(4, _grouped(pairs)))
        .unionByName(value(5, "path = 'setup.cfg' and (key = 'options.install_requires' or key like 'options.extras\\_require.%')", F.when(F.col("key") == "options.install_requires", "").otherwise(F.col("key"))))
        .unionByName(of_step(6, locked)).unionByName(of_step(7, _listed(manifests)))
    ).withColumn("said", text.strip(F.col("said")))
    canonical = lambda c: F.lower(F.regexp_replace(c, "[-_.]+", "-"))
    name = about.where("key = 'project.name'").select("repo", canonical(F.col("value")).alias("project"))
    wanted = F.regexp_extract("said", r"^[A-Za-z0-9][A-Za-z0-9._-]*", 0)
    #: A dependency specifier that an index can serve: name, extras, version clauses, marker; no direct reference.
    served = F.col("said").rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?\s*(?:\[[^\]]*\])?\s*\(?(?:\s*(?:===|~=|==|!=|<=|>=|<|>)[^;,()]+,?)*\)?\s*(?:;.*)?$")
    kept = asked.join(name, "repo", "left").where("said <> ''").where(served & ~F.coalesce(canonical(wanted) == F.col("project"), F.lit(False)))
    once = kept.groupBy("repo", "said").agg(F.min(F.struct("step", "rank", "place")).alias("first"))
    at = F.row_number().over(Window.partitionBy("repo").orderBy("first", "said")) - 1  # one repository's manifests
    return once.withColumn("at", at).where(F.col("at") < MAX_REQUIREMENTS).select("repo", "at", F.col("said").alias("requirement"))


#: What JavaScript's runners take for test files, a word and a kind of module.
JS_TEST_SUFFIXES = tuple(f".{word}.{kind}{x}" for word in ("test", "spec") for kind in ("js", "ts", "cjs", "cts", "mjs", "mts") for x in ("", "x"))


def frameworks(files: DataFrame) -> DataFrame:
    """(repo, framework, reason, python_tests, js_tests, notes): what to run in each repository of (repo, path, content).

    notes is an array of what else was seen: a second suite that is not run.
    """
    folder = F.regexp_replace("path", "[^/]*$", "")
    name = text.basename(F.col("path"))
    seen = ~folder.rlike("(^|/)(" + "|".join(x.replace(".", "[.]") for x in UNSCANNED) + ")/")
    python_test = seen & (name.endswith("_test.py") | name.startswith("test_") & name.endswith(".py"))
    folders = F.split(folder, "/")
    js_test = seen & ~python_test & (text.any_of(*[name.endswith(x) for x in JS_TEST_SUFFIXES]) | (F.array_contains(folders, "__tests__") & (name.endswith(".js") | name.endswith(".ts"))))
    count = lambda c: F.count(F.when(c, 1))
    of = lambda path: F.max(F.when(F.col("path") == path, F.col("content")))
    has = lambda said, section: F.coalesce(said.rlike(rf"(?m)^\[{section}\]"), F.lit(False))
    rows = files.groupBy("repo").agg(
        count(python_test).alias("python_tests"), count(js_test).alias("js_tests"), of("pyproject.toml").alias("pyproject"), of("pytest.ini").alias("ini"), of("setup.cfg").alias("cfg"), of("tox.ini").alias("tox"), of("package.json").alias("package"),
        F.min(F.when(F.col("path").isin(*OTHER_LANGUAGES), F.col("path"))).alias("other"),
    )
    config = (
        F.when(F.coalesce(F.col("pyproject").rlike(r"(?m)^\[tool\.pytest(\.|\])"), F.lit(False)), "[tool.pytest] in pyproject.toml")
        .when(F.col("ini").isNotNull(), "pytest.ini").when(has(F.col("cfg"), "tool:pytest"), "[tool:pytest] in setup.cfg").when(has(F.col("tox"), "pytest"), "[pytest] in tox.ini")
    )
    script = F.get_json_object("package", "$.scripts.test")
    words = F.split(script, " ")
    js = F.coalesce((text.strip(script) != "") & ~script.contains("no test specified"), F.lit(False))
    uses = lambda tool: F.coalesce(F.get_json_object("package", f"$.devDependencies.{tool}"), F.get_json_object("package", f"$.dependencies.{tool}")).isNotNull()
    js_framework = F.when(script.contains("vitest"), "vitest").when(script.contains("jest") | script.contains("react-scripts test"), "jest").when(F.array_contains(words, "node") & F.exists(words, lambda w: text.any_of(w == "--test", w.startswith("--test="), w.startswith("--test-"))), "node-test").when(uses("vitest"), "vitest").when(uses("jest"), "jest").otherwise("unknown")
    python = config.isNotNull() | (F.col("python_tests") > 0)
    wins = js & (~python | (F.col("js_tests") > F.col("python_tests")))
    language = F.element_at(F.create_map(*[F.lit(x) for kv in OTHER_LANGUAGES.items() for x in kv]), F.col("other"))
    reason = (
        F.when(wins, F.concat(F.lit("package.json scripts.test: "), F.substring(script, 1, 120)))
        .when(python & config.isNotNull() & (F.col("python_tests") > 0), F.concat(F.lit("pytest: "), config, F.lit(", "), F.col("python_tests").cast("string"), F.lit(" test files")))
        .when(python & config.isNotNull(), F.concat(F.lit("pytest: "), config, F.lit(", no test file")))
        .when(python, F.concat(F.lit("pytest: no configuration, "), F.col("python_tests").cast("string"), F.lit(" test files")))
        .when(F.col("package").isNotNull(), "package.json without a test script").when(F.col("other").isNotNull(), F.concat("other", F.lit(": "), language)).otherwise("no tests found")
    )
    both = F.when(python & js, F.concat(F.lit("two suites: "), "python_tests", F.lit(" Python and "), "js_tests", F.lit(" JavaScript test files; the larger one is run, Python where they are as many")))
    return rows.select("repo", F.when(wins, js_framework).when(python, "pytest").alias("framework"), reason.alias("reason"), "python_tests", "js_tests", F.array_compact(F.array(both)).alias("notes"))
