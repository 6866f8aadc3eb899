"""Nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample and hold every row: a row goes down each tree to a leaf, and
leaves of any size are cut into blocks of bounded size. A query searches all trees through one priority
queue, ordered by the squared distances to the planes crossed so far, until the leaves taken hold enough
rows, a number that grows more slowly than the rows do; leaves
then meet their queries by an equi-join on (leaf, block, query block), each pair of blocks is reranked
exactly with one matrix product, and the best of the blocks are merged. For the largest inner product,
vectors get one more component that makes their norms equal.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialized


@dataclass
class Forest:
    """Complete binary trees: node i of a tree has the children 2i + 1 and 2i + 2."""

    normals: np.ndarray  # trees x inner nodes x components
    offsets: np.ndarray  # trees x inner nodes
    depth: int
    norm: float  # the largest norm of any row

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Rows with one more component, so that all have the largest norm."""
        rest = np.sqrt(np.maximum(self.norm**2 - (x**2).sum(1), 0.0))
        return np.hstack([x, rest[:, None]])

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """Rows x trees: the leaf of each row, numbered over all trees."""
        x = self.lift(x)
        out = np.empty((len(x), len(self.normals)), np.int64)
        for t in range(len(self.normals)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                margin = np.einsum("ij,ij->i", x, self.normals[t][node]) - self.offsets[t][node]
                node = 2 * node + 1 + (margin > 0)
            out[:, t] = t * self.leaves + node - (self.leaves - 1)
        return out

    def search(self, queries: np.ndarray, counts: np.ndarray, enough: int) -> list[list[int]]:
        """For each query the leaves to look into: nearest first over all trees, until they hold enough rows."""
        q = np.hstack([queries, np.zeros((len(queries), 1))])
        inner = self.leaves - 1
        out = []
        for a in range(0, len(q), 128):
            margins = np.einsum("ij,tnj->itn", q[a : a + 128], self.normals, optimize=True) - self.offsets
            for own in margins:
                heap = [(0.0, t, 0) for t in range(len(self.normals))]
                heapq.heapify(heap)
                taken, held = [], 0
                while heap and held < enough:
                    bound, t, node = heapq.heappop(heap)
                    if node >= inner:
                        leaf = t * self.leaves + node - inner
                        if counts[leaf]:
                            taken.append(leaf)
                            held += int(counts[leaf])
                        continue
                    m = own[t, node]
                    heapq.heappush(heap, (bound + min(m, 0.0) ** 2, t, 2 * node + 2))
                    heapq.heappush(heap, (bound + max(m, 0.0) ** 2, t, 2 * node + 1))
                out.append(taken)
        return out


def fit_forest(sample: np.ndarray, norm: float, trees: int, depth: int, seed: int = 1) -> Forest:
    """Splits halve the sample: the plane between two random rows, moved to the median."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1] if len(sample) else 1
    forest = Forest(np.zeros((trees, (1 << depth) - 1, dim + 1)), np.zeros((trees, (1 << depth) - 1)), depth, norm)
    x = forest.lift(sample) if len(sample) else np.zeros((0, dim + 1))
    for t in range(trees):
        parts = {0: np.arange(len(x))}
        for node in range((1 << depth) - 1):
            own = parts.pop(node, np.arange(0))
            normal = np.zeros(dim + 1)
            if len(own) > 1:
                a, b = x[rng.choice(own, 2, replace=False)]
                normal = a - b
            if not normal.any():
                normal = rng.normal(size=dim + 1)
            normal /= np.linalg.norm(normal)
            at = x[own] @ normal
            cut = float(np.median(at)) if len(own) else 0.0
            forest.normals[t, node], forest.offsets[t, node] = normal, cut
            parts[2 * node + 1], parts[2 * node + 2] = own[at <= cut], own[at > cut]
    return forest


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def nearest(rows: DataFrame, is_query: Column, k: int = 20, trees: int = 16, visits: int = 72, most_depth: int = 10, effort: float = 10.0, growth: float = 0.75, sample_rows: int = 10_000, block_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found, by largest inner product.

    The index holds every usable row and is fitted on about sample_rows of them, chosen by a hash of the
    id. A search stops when the leaves taken hold effort * n ** growth rows, counted with repeats, or
    50 * k if that is more. Trees are so deep that this takes about `visits` leaves, or up to twice fewer,
    whatever n is, and no deeper than most_depth, which bounds what is broadcast. Ties go to the smaller id. Vectors that are null, zero or not
    finite, null ids, and vectors of another length than most take no part. A row is not its own
    neighbour; rows that repeat an id are one row, with the least of their vectors in Spark's order. With
    fewer than k other rows all that were found are returned. An empty table gives no rows.
    """
    spark = rows.sparkSession
    own = rows.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    facts = own.agg(F.count("*").alias("n"), F.mode(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("square")).first()
    n, dim = facts.n, facts.dim or 1
    own = own.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    sampled = own.where(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // sample_rows)))) == 0).orderBy(F.xxhash64("id"), "id").limit(2 * sample_rows)
    sample = np.array([r.v for r in sampled.select("v").collect()]).reshape(-1, dim)
    enough = max(int(effort * n**growth), 50 * k)
    depth = int(np.clip(np.floor(np.log2(max(n, 1) * visits / enough)), 1, most_depth))
    forest = fit_forest(np.unique(sample, axis=0) if len(sample) else sample, float(np.sqrt(facts.square or 0.0)), trees, depth)
    shared = spark.sparkContext.broadcast(forest)  # trees * 2^most_depth planes at most

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = shared.value.leaves_of(_matrix(batch.column(1))).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, leaves.size + 1, leaves.shape[1]), pa.int32()), pa.array(leaves.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=["id", "v", "q", "leaves"])

    indexed = materialized(own.mapInArrow(index, "id long, v array<double>, q boolean, leaves array<int>"))
    held = indexed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).collect()  # trees * 2^depth rows at most
    counts = np.zeros(trees * forest.leaves, np.int64)
    for r in held:
        counts[r.leaf] = r.n

    def taken_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken = shared.value.search(_matrix(batch.column(1)), counts, enough)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken, pa.list_(pa.int32()))], names=["id", "v", "taken"])

    looking = materialized(indexed.where("q").select("id", "v").mapInArrow(taken_by, "id long, v array<double>, taken array<int>"))
    looks = looking.select(F.explode("taken").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).collect()  # trees * 2^depth rows at most
    asked = np.zeros_like(counts)
    for r in looks:
        asked[r.leaf] = r.n
    sizes = spark.createDataFrame(
        [(i, int(max(1, -(-c // block_rows))), int(-(-a // block_rows))) for i, (c, a) in enumerate(zip(counts, asked)) if a],
        "leaf int, blocks int, q_blocks int",
    )  # trees * 2^depth rows at most
    data = (
        indexed.select("id", "v", F.explode("leaves").alias("leaf"))
        .join(F.broadcast(sizes), "leaf")
        .select("id", "v", "leaf", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q_block"))
    )
    asking = (
        looking.select("id", "v", F.explode("taken").alias("leaf"))
        .join(F.broadcast(sizes), "leaf")
        .select("id", "v", "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), "q_blocks").cast("int").alias("q_block"))
    )

    def rerank(asking: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(data):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        data = data.sort_values("id")
        ids, x = data["id"].to_numpy(), np.vstack(data["v"].to_numpy())
        found = []
        for a in range(0, len(asking), 512):
            part = asking.iloc[a : a + 512]
            scores = np.vstack(part["v"].to_numpy()) @ x.T
            for query, score in zip(part["id"].tolist(), scores):
                score = np.where(ids == query, -np.inf, score)
                top = np.arange(len(ids))
                if len(ids) > k:
                    least = np.partition(score, len(ids) - k)[len(ids) - k]
                    top = np.flatnonzero(score >= least)
                top = top[np.lexsort((ids[top], -score[top]))][: k + 1]
                top = top[score[top] > -np.inf][:k]
                found.append((np.full(len(top), query), ids[top], score[top]))
        q, v, s = (np.concatenate(c) for c in zip(*found))
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    keys = ["leaf", "block", "q_block"]
    found = asking.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(rerank, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")  # leaves taken * k rows for a query
    return (
        found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
