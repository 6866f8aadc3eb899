"""A training-corpus pipeline over `documents`: quality rules, line, document and passage dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; run() writes every stage's result
as Parquet and the next stage reads it. All but the last return the columns of documents, with n_chars
counted anew where a stage changes texts. Extra columns stay as they are, whatever their names. An empty
table gives an empty result in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, near_dup, packing, quality, substring_dedup
from tessera.llm.common import table
from tessera.session import shared_dir

#: SQL cannot express the estimates, windows and token merges of these stages.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where it has that column, counted from its text."""
    return docs.withColumns({c: F.length("text").cast(kind) for c, kind in docs.dtypes if c == "n_chars"})


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, weighed by their estimated accuracies, take for good.

    A null, empty or very short text fails the base rules and goes. A null id is judged like any other.
    Repeated rows are judged alike and stay or go together; different texts of one id are judged each.
    """
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that five documents or more hold stay in the one of the largest id, with all their repeats there.

    Every row stays: a null text stays null unless lines of it go, and a text whose every line is held
    elsewhere becomes empty. A null id counts as the smallest. Repeated rows lose the same lines.
    """
    return _counted(line_dedup.drop_repeated_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id.

    Rows with a null id, and texts that are null or have no words, are linked with nothing and stay.
    Repeated rows are one document: all rows of the id that stays do. See near_dup.keep_first.
    """
    return near_dup.keep_first(docs, width=5, percent=80)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the document of the smallest id that holds them.

    Every row stays. Null, empty and short texts and rows with a null id are left as they are; repeated
    rows lose the same words. See substring_dedup.repeated_passages for edits and for rows of one id.
    """
    return _counted(substring_dedup.drop_repeats(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids: one row for each piece of a document.

    A null or empty text is one end id. Repeated rows and rows with a null id are packed each.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup_stage),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.

    Each stage's result, and what the operators write on the way, goes to the shared folder and is left
    there: the returned frame reads it, and a lost executor's work is read again from it. Whoever runs the
    job removes `pipeline-*` and `tessera-*` from that folder once the result is stored.
    """
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
