"""Search over indexed lines gives the rows of the plain search, and leaves most blocks alone."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import assembly, line_index

SCHEMA = "request_id int, position int, path string, lines array<string>"
PATTERNS = [
    "harbour", "har.our", "harbours?", "harbou{0,1}r", "(har|lan)tern", "harb+our", "^lantern", "lantern$", "lan[st]ern", "lan[^t]ern", "[a-z]+tern [0-9]", r"lantern\.", r"\blantern\b",
    r"lan\x74ern", r"\Qlan.\Eharbour", "(?i)HARBOUR", "lan|har", "x (", "naïve", "🦊🦊fox", "a*b*", ".", "la{2}n", "((lan)tern)+ 7", "q#[lan]tern", "[]l]antern", "",
]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    pick = random.Random(5)
    words = ["harbour", "harbours", "hartern", "lantern", "lansern", "lantern.", "lan.harbour", "HARBOUR", "x (", "naïve", "🦊🦊fox", "b", "laan", "7", "q#lantern", "]antern", "\u2028", "a\rb"]
    rows = [(r, p, f"f{p}", [" ".join(pick.choice(words) for _ in range(pick.randrange(4))) for _ in range(150)]) for r in range(3) for p in range(4)]
    rows += [(None, 0, "n", ["harbour", None, ""]), (4, None, None, ["lantern 7"]), (5, 0, "none", None), (6, 0, "empty", []), (7, 0, "same", ["harbour"]), (7, 0, "same", ["harbour"]), (8, 0, "long", ["é" * 60_000 + "harbour"])]
    files = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path_factory.mktemp("spark-lines") / "index")
    line_index.write_index(files, path)
    return files, path


@pytest.mark.parametrize("pattern", PATTERNS)
def test_same_rows_as_reading_every_line(spark, stored, pattern):
    files, path = stored
    got = line_index.search(spark, path, pattern, 50).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, assembly.grep(files, pattern, 50).collect()))


def test_parts_are_those_that_every_match_holds():
    assert line_index.plain_parts("harbours? of(a|b)nine") == ["harbour", " of", "nine"]
    assert line_index.plain_parts("one{2}two+three") == ["on", "two", "three"]
    assert line_index.plain_parts(r"a\.b\dc[a-z]d") == ["a", "b", "c", "d"]
    assert line_index.plain_parts("x (") == ["x ("]
    assert line_index.plain_parts(r"\Qabc") == [r"\Qabc"]  # no such escape where grep asks: taken literally
    for doubtful in ["a|b", "(?i)abc", r"\x61bc", r"(a)\1", "[[:a]bc"]:
        assert line_index.plain_parts(doubtful) == []


def test_blocks_without_the_parts_are_not_read(spark, tmp_path):
    lines = [f"line {i} says nothing new" for i in range(64 * 50)]
    lines[1000] = "here a quokka sleeps"
    files = spark.createDataFrame([(1, 0, "a", lines)], SCHEMA)
    line_index.write_index(files, str(tmp_path / "i"))
    assert line_index.candidates(spark, str(tmp_path / "i"), "quok+a [a-z]+s").count() == 64
    assert [r.line for r in line_index.search(spark, str(tmp_path / "i"), "quok+a [a-z]+s").collect()] == [1001]
    assert line_index.candidates(spark, str(tmp_path / "i"), "nothing new").count() == len(lines)


def test_empty_files_give_no_rows(spark, tmp_path):
    line_index.write_index(spark.createDataFrame([], SCHEMA), str(tmp_path / "i"))
    assert line_index.search(spark, str(tmp_path / "i"), "abc").count() == 0
    assert line_index.search(spark, str(tmp_path / "i"), "a|b").count() == 0
