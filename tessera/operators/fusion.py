"""Rank fusion and reranking of candidate lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 60, top: int = 100) -> DataFrame:
    """(query_id, doc_id, score, rank) of ranked lists (query_id, doc_id, rank); ties by first appearance, list by list."""
    rows = None
    for i, ranked in enumerate(lists):
        own = ranked.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.lit(i).alias("list"))
        rows = own if rows is None else rows.unionByName(own)
    fused = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 12).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "first")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "doc_id", "score", "rank")


def word_overlap(query: Column, text: Column) -> Column:
    """A reranker without a model: the share of the query's distinct words that the text holds."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "\\s+"), lambda w: w != ""))
    return F.size(F.array_intersect(words(query), words(text))) / F.greatest(F.size(words(query)), F.lit(1))


def model_scores(pairs: DataFrame, make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> DataFrame:
    """pairs (query_id, doc_id, query, text) with score, by a model that `make` loads once in each worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            told = list(zip(batch.column("query").to_pylist(), batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("doc_id"), pa.array([float(x) for x in score(told)], pa.float64())], names=["query_id", "doc_id", "score"])

    types = dict(pairs.dtypes)
    return pairs.mapInArrow(run, f"query_id {types['query_id']}, doc_id {types['doc_id']}, score double")


def reranked(candidates: DataFrame, depths: list[int]) -> DataFrame:
    """(depth, query_id, doc_id, rank): for each depth the first candidates in order of score, ties as they were.

    candidates: query_id, doc_id, rank, score; scored once, to the largest depth.
    """
    rows = candidates.withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).where("rank <= depth")
    order = Window.partitionBy("depth", "query_id").orderBy(F.col("score").desc(), "rank")
    return rows.select("depth", "query_id", "doc_id", F.row_number().over(order).alias("new_rank")).withColumnRenamed("new_rank", "rank")


def candidate_lists(ranked: DataFrame, gold: DataFrame, sample: DataFrame, depth: int = 30) -> DataFrame:
    """(query_id, candidates, gold): the sampled queries' first candidates in order, and what they should find."""
    own = ranked.join(sample.select("query_id"), "query_id", "left_semi").where(F.col("rank") <= depth)
    lists = own.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("candidates"))
    return lists.join(gold.select("query_id", F.col("doc_id").alias("gold")), "query_id", "left")
