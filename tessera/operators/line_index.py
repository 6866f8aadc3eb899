"""Pattern search over a stored index of lines.

Lines lie in blocks of 64, each with the hashes of the runs of three characters in it. A pattern is asked
for the plain characters that every match must hold; only the lines of blocks that hold all their runs of
three are tried against it. A pattern that gives none, such as one of alternatives, is tried against
every line, so the rows are those of assembly.grep for every pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import assembly

BLOCK = 64


def plain_parts(pattern: str) -> list[str]:
    """Runs of plain characters that every match of the pattern holds; none where that is in doubt.

    Escaped signs and character classes, simple sets and groups stand for something unknown. Alternatives,
    flags and other escapes leave everything in doubt. A pattern that is no regular expression is
    plain as a whole, as grep takes it.
    """
    try:
        re.compile(pattern)
    except re.error:
        return [pattern]
    if "(?" in pattern or re.search(r"\\[^bBdDsSwW\W]", pattern):
        return []
    left = re.sub(r"\\.", ".", pattern, flags=re.S)
    left = re.sub(r"\[\^?[\w .-]+\]", ".", left)
    while (less := re.sub(r"\([^()\[\]]*\)", ".", left)) != left:
        left = less
    left = re.sub(r"\{[0-9, ]*\}", "*", left)
    if re.search(r"[|()\[\]{}\\]", left):
        return []
    return [part for part in re.split(r"[.^$+*?]", re.sub(r"[^.^$+*?](?=[*?])", ".", left, flags=re.S)) if part]


def triples(part: str) -> set[str]:
    """Runs of three characters in one part."""
    return {part[i : i + 3] for i in range(len(part) - 2)}


def write_index(files: DataFrame, path: str) -> None:
    """Store files (request_id, position, path, lines) in blocks of lines, each with the hashes of its runs of three characters.

    Null lines match nothing; repeated rows are each kept. Hashes that collide only keep a block that could have been left alone.
    """
    starts = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1, F.lit(BLOCK)))
    cut = F.transform(starts, lambda first: F.slice("lines", first + 1, F.lit(BLOCK)))
    blocks = files.select("request_id", "position", "path", F.posexplode(cut).alias("nth", "lines"))
    # A look-ahead takes every position in one walk, long lines included; runs over a line's end do no harm.
    runs = F.array_distinct(F.regexp_extract_all(F.array_join("lines", "\n"), F.lit("(?s)(?=(...))"), 1))
    blocks.withColumn("triples", F.transform(runs, lambda run: F.hash(run))).write.parquet(path)


def candidates(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The stored lines (request_id, position, path, at, raw) of blocks that may hold a match."""
    blocks = spark.read.parquet(path)
    for triple in sorted(set().union(*map(triples, plain_parts(pattern)))):
        blocks = blocks.where(F.array_contains("triples", F.hash(F.lit(triple))))
    lines = blocks.select("request_id", "position", "path", "nth", F.posexplode("lines").alias("within", "raw"))
    return lines.where("raw is not null").select("request_id", "position", "path", (F.col("nth") * BLOCK + F.col("within")).alias("at"), "raw")


def search(spark: SparkSession, path: str, pattern: str, most: int = 20) -> DataFrame:
    """(request_id, path, line, said): the rows of assembly.grep over the indexed files. An empty index gives none."""
    return assembly.first_hits(candidates(spark, path, pattern).where(assembly.matches(F.col("raw"), pattern)), most)
