"""Unified diffs as rows: a small state machine finds the hunks, the rest is column work."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text

# What opens a hunk and names a file.
_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(?: (.*))?$")
_FILE = re.compile(r"\+\+\+ (?:b/)?(.+)$")
HUNK_TYPE = "array<struct<path:string,old_start:int,old_lines:int,new_start:int,new_lines:int,section:string,lines:array<string>>>"


def hunks_of(diff: str, path: str | None) -> list[dict]:
    """Hunks of a patch of one file, or of a whole diff when path is None.

    The header's counts say how many lines belong to a hunk, so a deleted line that looks like a file
    header is content. Hunks of no file are left out.
    """
    found: list[dict] = []
    hunk: dict | None = None
    old = new = 0
    for line in diff.splitlines():
        if hunk is not None and (old > 0 or new > 0 or line.startswith("\\")):
            hunk["lines"].append(line)
            old -= line[:1] not in ("+", "\\")
            new -= line[:1] not in ("-", "\\")
            continue
        opened = _HUNK.match(line)
        hunk = None
        if opened:
            a, b, c, d, section = opened.groups()
            old, new = int(b or 1), int(d or 1)
            hunk = {"path": path, "old_start": int(a), "old_lines": old, "new_start": int(c), "new_lines": new, "section": section or None, "lines": []}
            if path is not None:
                found.append(hunk)
        elif named := _FILE.match(line):
            path = None if named[1] == "/dev/null" else named[1]
    return found


def with_hunks(rows: DataFrame, diff: str, path: str | None = None) -> DataFrame:
    """One row for each hunk: rows' columns (but the diff) with at (from 0) and the hunk's fields."""
    kept = [f for f in rows.schema.fields if f.name != diff]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("path", pa.string()), ("old_start", pa.int32()), ("old_lines", pa.int32()), ("new_start", pa.int32()), ("new_lines", pa.int32()), ("section", pa.string()), ("lines", pa.list_(pa.string()))]))
        for batch in batches:
            paths = batch.column("__path").to_pylist()
            found = [hunks_of(d or "", p) for d, p in zip(batch.column("__diff").to_pylist(), paths)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(found, kind)], names=[*(f.name for f in kept), "__hunks"])

    own = rows.select(*[f.name for f in kept], F.col(diff).alias("__diff"), (F.col(path) if path else F.lit(None).cast("string")).alias("__path"))
    schema = rows.select(*[f.name for f in kept]).schema.add("__hunks", _parsed(HUNK_TYPE))
    opened = own.mapInArrow(run, schema).select("*", F.posexplode("__hunks").alias("at", "h")).drop("__hunks")
    return opened.select(*[c for c in opened.columns if c not in ("h", "path")], "h.*")


def _parsed(ddl: str):
    from pyspark.sql.types import DataType

    return DataType.fromDDL(ddl)


def marker(line: Column) -> Column:
    """+, -, backslash or a space: an empty line is unchanged code."""
    return F.when(line == "", " ").otherwise(F.substring(line, 1, 1))


def hunk_lines(hunks: DataFrame, *key: str) -> DataFrame:
    """(key.., path, at, marker, code, line): every line of a hunk with its number in the new file; null for removed ones.

    key must name a hunk. Lines that only say a file has no final line end count for nothing.
    """
    rows = hunks.select(*key, "path", "new_start", F.posexplode("lines").alias("at", "raw")).withColumn("marker", marker(F.col("raw")))
    counts = ~F.col("marker").isin("-", "\\")
    before = F.sum(counts.cast("int")).over(Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(
        *key, "path", "at", "marker", text.after(F.col("raw"), F.lit(1)).alias("code"), F.when(counts, F.col("new_start") + F.coalesce(before, F.lit(0))).alias("line")
    )


def new_lines(hunks: DataFrame, *key: str) -> DataFrame:
    """(key.., path, line): the lines of hunk_lines that have a number, found inside each hunk's row, so nothing is moved or sorted."""
    counted = F.filter("lines", lambda x: ~marker(x).isin("-", "\\"))
    rows = hunks.select(*key, "path", "new_start", F.size(counted).alias("n")).where("n > 0")
    return rows.select(*key, "path", F.explode(F.sequence(F.col("new_start").cast("long"), F.col("new_start") + F.col("n") - 1)).alias("line"))


def added_lines(hunk: Column) -> Column:
    return F.size(F.filter(hunk, lambda x: x.startswith("+")))


def hunk_text(hunk: str = "") -> Column:
    """The hunk's header and lines as text again."""
    c = lambda n: F.col(f"{hunk}{n}")
    head = F.format_string("@@ -%d,%d +%d,%d @@", c("old_start"), c("old_lines"), c("new_start"), c("new_lines"))
    return F.concat_ws("\n", F.concat_ws(" ", head, c("section")), F.when(F.size(c("lines")) > 0, F.array_join(c("lines"), "\n")))


def commented_line(rows: DataFrame, *key: str) -> DataFrame:
    """(key.., line): the last line of the new file in each comment's first hunk; null when there is none."""
    numbered = hunk_lines(rows.where("at = 0").drop("at"), *key)
    return numbered.groupBy(*key).agg(F.max("line").alias("line"))
