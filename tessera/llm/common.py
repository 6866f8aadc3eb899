"""What the operators of this subpackage share: tables, materialisation and text helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import materialized  # noqa: F401

#: Bytes that separate words: [\x20\x09-\x0D].
BLANKS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few of them are Python objects at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def utf8(text: Column) -> Column:
    """A text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def row_hash(text: Column) -> Column:
    """Tells rows of one id with different texts apart; null and empty agree."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like the given one that df lacks, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
