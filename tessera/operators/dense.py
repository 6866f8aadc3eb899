"""Exact dense search: blocks of queries against every document, a partial top-k in each task, then one merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of one block, vectors and the best found for them: what is broadcast at most, and what a task holds of either side.
BLOCK_BYTES = 32 << 20
#: Vectors of a block at most, so that short ones are many blocks too.
BLOCK_ROWS = 1 << 16


def unit(vector: Column) -> Column:
    """The vector at length 1, in double precision; null for a zero vector."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm))


def top_k(docs: DataFrame, queries: DataFrame, k: int, same: str | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k nearest documents by dot product; ties to the smaller id.

    docs (doc_id, vector, and `same` where given), queries likewise. `same` names a key both must share: the filter
    before ranking. Rows without a vector take no part. Queries that fit one block are broadcast to one pass over
    the documents; more of them are dealt, like the documents, to blocks of bounded size that meet in tasks.
    """
    extra = [same] if same else []
    docs, queries = docs.where("vector is not null").select("doc_id", "vector", *extra), queries.where("vector is not null").select("query_id", "vector", *extra)
    n, dim = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    found = _one_pass(docs, queries, k, same) if n * (dim + 2 * k) * 8 <= BLOCK_BYTES else _by_blocks(docs, queries, k, same, n, dim)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _found(docs: DataFrame, queries: DataFrame) -> str:
    return f"query_id {dict(queries.dtypes)['query_id']}, doc_id {dict(docs.dtypes)['doc_id']}, score double"


def _matrix(vectors: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in vectors.chunks]) if isinstance(vectors, pa.ChunkedArray) else vectors.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(n, -1) if n else np.zeros((0, 1))


def best(q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, held: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best documents of each query, those held before included.

    Only scores that reach the k-th best are rounded and sorted.
    """
    s = q @ x.T
    n = s.shape[1]
    if s.size and np.isnan(s.min()):
        d, s = np.broadcast_to(ids, s.shape), np.round(s, 12)
        if held is not None:
            d, s = np.hstack([held[0], d]), np.hstack([held[1], s])
        order = np.lexsort((d, -s))[:, :k]
        return np.take_along_axis(d, order, 1), np.take_along_axis(s, order, 1)
    if full := held is not None and held[0].shape[1] >= k:
        least = held[1][:, k - 1, None]
        if np.isnan(least).any():
            least, full = np.full(least.shape, -np.inf), False
    elif n > k:
        least = np.partition(s, n - k, axis=1)[:, n - k, None]
    else:
        least = np.full((len(s), 1), -np.inf)
    r, c = np.nonzero(s >= least - (1e-12 + 1e-15 * np.where(np.isfinite(least), np.abs(least), 0)))
    score = np.round(s[r, c], 12)
    if full:
        first = (score > least[r, 0]) | (score == least[r, 0]) & (ids[c] < held[0][r, k - 1])
        r, c, score = r[first], c[first], score[first]
        if not len(r):
            return held
    d = ids[c]
    if held is not None:
        r, d, score = np.concatenate([np.repeat(np.arange(len(s)), held[0].shape[1]), r]), np.concatenate([held[0].ravel(), d]), np.concatenate([held[1].ravel(), score])
    order = np.lexsort((d, -score, r))
    r, d, score = r[order], d[order], score[order]
    first = np.arange(len(r)) - np.searchsorted(r, r) < k
    return d[first].reshape(len(s), -1), score[first].reshape(len(s), -1)


def _one_pass(docs: DataFrame, queries: DataFrame, k: int, same: str | None) -> DataFrame:
    rows = queries.toPandas()  # BLOCK_BYTES or little more
    groups = [None] if same is None else list(dict.fromkeys(rows[same]))
    blocks = {}
    for g in groups:
        own = rows if same is None else rows[rows[same] == g]
        blocks[g] = (own["query_id"].to_numpy(), np.array(own["vector"].tolist(), float).reshape(len(own), -1))
    shared = docs.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}  # (group, first query) -> ids and scores of the best k so far
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = _matrix(batch.column(1), len(ids))
            names = np.array(batch.column(2).to_pylist(), dtype=object) if same else None
            for g, (qids, q) in shared.value.items():
                rows = slice(None) if names is None else np.flatnonzero(names == g)
                own_ids, own = ids[rows], x[rows]
                if not len(own_ids):
                    continue
                for a in range(0, len(qids), 256):
                    kept[g, a] = best(q[a : a + 256], own_ids, own, k, kept.get((g, a)))
        for (g, a), (d, s) in kept.items():
            q = np.repeat(shared.value[g][0][a : a + 256], d.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(d.ravel()), pa.array(s.ravel())], names=["query_id", "doc_id", "score"])

    return docs.mapInArrow(run, _found(docs, queries))


def blocks(n: int, width: int) -> int:
    """Blocks of n rows of `width` numbers each."""
    return max(1, -(-n // max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))))


def _by_blocks(docs: DataFrame, queries: DataFrame, k: int, same: str | None, n: int, dim: int) -> DataFrame:
    """Blocks of queries meet blocks of documents, each pair of blocks in one group of a task."""
    q_blocks, d_blocks = blocks(n, dim + 2 * k), blocks(docs.count(), dim)
    key = ["qb", "db", *([same] if same else [])]
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).withColumn("db", every(d_blocks))
    held = docs.withColumn("db", F.pmod(F.xxhash64("doc_id"), F.lit(d_blocks)).cast("int")).withColumn("qb", every(q_blocks))
    schema = pa.schema([("query_id", _arrow(queries, "query_id")), ("doc_id", _arrow(docs, "doc_id")), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            qids, ids = left["query_id"].to_numpy(), right["doc_id"].to_numpy()
            q, x = _matrix(left["vector"], len(qids)), _matrix(right["vector"], len(ids))
            for a in range(0, len(qids), 256):
                kept = None
                for b in range(0, len(ids), 4096):
                    kept = best(q[a : a + 256], ids[b : b + 4096], x[b : b + 4096], k, kept)
                out.append(pa.table([np.repeat(qids[a : a + 256], kept[0].shape[1]), kept[0].ravel(), kept[1].ravel()], names=schema.names).cast(schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(run, _found(docs, queries))


def _arrow(rows: DataFrame, column: str) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[dict(rows.dtypes)[column]]


def after_filter(ranked: DataFrame, docs: DataFrame, queries: DataFrame, same: str, budgets: list[int], k: int = 10) -> DataFrame:
    """(query_id, budget, doc_id, rank): the first `budget` unfiltered candidates, then the filter, then k."""
    both = ranked.join(docs.select("doc_id", F.col(same).alias("d")), "doc_id").join(queries.select("query_id", F.col(same).alias("q")), "query_id")
    kept = both.withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).where("rank <= budget and d = q")
    order = Window.partitionBy("query_id", "budget").orderBy("rank")
    return kept.select("query_id", "budget", "doc_id", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def embed(texts: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], tokens: Callable[[str], int] | None = None) -> DataFrame:
    """(id, vector, tokens) of (id, text): `encoder` is called once in each Python worker and gives unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, count = encoder(), tokens or (lambda t: len(t.split()))
        for batch in batches:
            said = [t or "" for t in batch.column(1).to_pylist()]
            found = encode(said) if said else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(map(float, v)) for v in found], pa.list_(pa.float32())), pa.array([count(t) for t in said], pa.int32())], names=["id", "vector", "tokens"])

    return texts.select("id", "text").mapInArrow(run, f"id {dict(texts.dtypes)['id']}, vector array<float>, tokens int")


def bag_of_words(dim: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """An encoder without a model: hashed words, at length 1."""
    import zlib

    def make():
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for i, t in enumerate(texts):
                for word in t.lower().split():
                    out[i, zlib.crc32(word.encode()) % dim] += 1
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norm == 0, 1, norm)

        return encode

    return make


def stale(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows (id, fingerprint) of wanted that stored vectors do not cover."""
    return wanted.join(stored.select("id", "fingerprint"), ["id", "fingerprint"], "left_anti")


def faults(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, fault): missing, unexpected, doubled, stale or not finite vectors; callers refuse a store that has any."""
    w, s = wanted.select("id", "fingerprint"), stored.select("id", "vector", F.col("fingerprint").alias("has"))
    both = w.withColumn("wanted", F.lit(True)).join(s, "id", "full_outer")
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fault = (
        F.when(F.col("has").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("has") != F.col("fingerprint"), "stale").when(odd, "not finite")
    )
    doubled = s.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("doubled").alias("fault"))
    return both.select("id", fault.alias("fault")).where("fault is not null").unionByName(doubled).distinct()


def document_matrix(vectors: DataFrame, docs: DataFrame, body_only: bool) -> DataFrame:
    """(id, vector) of docs (id, kind); comments take the vector stored under body/<id> when body_only."""
    plain = docs.join(vectors.select("id", "vector"), "id", "left")
    if not body_only:
        return plain.select("id", "vector")
    bodies = vectors.where(F.col("id").startswith("body/")).select(F.col("id").substr(6, 1 << 20).alias("id"), F.col("vector").alias("body"))
    return plain.join(bodies, "id", "left").select("id", F.when(F.col("kind") == "review_comment", F.coalesce("body", "vector")).otherwise(F.col("vector")).alias("vector"))
