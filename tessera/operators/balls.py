"""Exact dense search over a stored index of balls.

Unit vectors are assigned to the nearest of a bounded number of centres, and each centre's vectors, in order of
their angle to it, are cut into blocks: shells. By the triangle inequality of angles no vector of a shell from
`near` to `far` is closer to a query at angle a from the centre than max(0, a - far, near - a). Shells that
cannot hold one of a query's k best are not scored; the result is that of the full search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators import dense
from tessera.operators.places import numbered
from tessera.session import materialized

#: Vectors of a shell, centres at most, and rows that centres are fitted on.
SHELL, CENTRES, SAMPLE = 128, 512, 20_000
#: Scores are rounded to 12 digits, and angles to about 8.
MARGIN = 1e-6


def centres_of(sample: np.ndarray, most: int = CENTRES, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Unit centres by a few rounds of assigning and averaging; about the square root of the sample's size."""
    rng = np.random.default_rng(seed)
    n = min(most, max(1, int(len(sample) ** 0.5)))
    centres = sample[rng.choice(len(sample), n, replace=False)]
    for _ in range(rounds):
        own = np.argmax(sample @ centres.T, 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.where(norms > 1e-12, norms, 1), centres)
    return centres


def _vectors(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def _angles(rows: DataFrame, key: str, centres: np.ndarray, nearest: bool, extra: list[str]) -> DataFrame:
    """(key, extra, ball, angle[, vector]): of each vector the nearest centre, or all of them."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # CENTRES vectors at most
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                x = _vectors(part.column(1), part.num_rows)
                angle = np.arccos(np.clip(x @ c.T, -1, 1)) if len(x) else np.zeros((0, len(c)))
                if nearest:
                    ball = np.argmin(angle, 1) if len(x) else np.zeros(0, np.int64)
                    columns = [*part.columns, pa.array(ball.astype(np.int32)), pa.array(np.take_along_axis(angle, ball[:, None], 1)[:, 0])]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "vector", *extra, "ball", "angle"])
                else:
                    at = pa.array(np.repeat(np.arange(len(x)), len(c)))
                    columns = [part.column(i).take(at) for i in (0, *range(2, 2 + len(extra)))] + [pa.array(np.tile(np.arange(len(c), dtype=np.int32), len(x))), pa.array(angle.ravel())]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, *extra, "ball", "angle"])

    schema = f"{key} {kinds[key]}, " + ("vector array<double>, " if nearest else "") + "".join(f"{e} {kinds[e]}, " for e in extra) + "ball int, angle double"
    return rows.select(key, "vector", *extra).mapInArrow(run, schema)


def write_index(docs: DataFrame, path: str, same: str | None = None, shell: int = SHELL, sample: int = SAMPLE) -> None:
    """A stored index of docs (doc_id, vector of length 1, and `same` where given) under path: centres and shells.

    Centres are fitted on about `sample` rows, every row is indexed. Rows without a vector take no part.
    """
    extra = [same] if same else []
    own = docs.where("vector is not null").select("doc_id", "vector", *extra)
    n = own.count()
    some = own.orderBy(F.xxhash64("doc_id")).limit(sample) if n > sample else own
    rows = [r.vector for r in some.select("vector").collect()]  # `sample` rows
    centres = centres_of(np.array(rows, float)) if rows else np.zeros((1, 1))
    spark = docs.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "ball int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    group = [*extra, "ball"]
    placed = numbered(_angles(own, "doc_id", centres, True, extra), group, ["angle", "doc_id"])
    shells = placed.withColumn("shell", F.expr(f"(place - 1) div {shell}")).groupBy(*group, "shell").agg(
        F.min("angle").alias("near"), F.max("angle").alias("far"), F.collect_list(F.struct("doc_id", "vector")).alias("held")
    )
    shells.select(*group, "shell", "near", "far", F.transform("held", lambda x: x["doc_id"]).alias("ids"), F.flatten(F.transform("held", lambda x: x["vector"])).alias("flat")).write.parquet(f"{path}/shells")


def shell_plan(spark: SparkSession, path: str, queries: DataFrame, k: int, same: str | None = None, first: int = 4) -> tuple[DataFrame, DataFrame]:
    """(query_id, [same], ball, shell, bound, part) of every shell for every query, and the best of part 0.

    The `first` shells of a query by bound are scored at once (0), the others where they can reach its k-th
    best score (1) or not at all (2).
    """
    extra = [same] if same else []
    centres = np.array([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("ball").collect()], float)  # CENTRES at most
    angles = _angles(queries, "query_id", centres, False, extra)
    heads = spark.read.parquet(f"{path}/shells").select(*extra, "ball", "shell", "near", "far")
    gap = F.greatest(F.lit(0.0), F.col("angle") - F.col("far"), F.col("near") - F.col("angle"))
    bounds = materialized(angles.join(heads, [*extra, "ball"]).select("query_id", *extra, "ball", "shell", F.cos(gap).alias("bound")))
    order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "ball", "shell")
    early = materialized(bounds.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= first).select("query_id", *extra, "ball", "shell"))
    found = materialized(shell_scores(spark, path, queries, early, k, extra))
    nth = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    least = found.withColumn("rank", F.row_number().over(nth)).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    judged = bounds.join(early.withColumn("early", F.lit(True)), ["query_id", *extra, "ball", "shell"], "left").join(least, "query_id", "left")
    part = F.when(F.col("early"), 0).when(F.col("least").isNull() | (F.col("bound") + MARGIN >= F.col("least")), 1).otherwise(2)
    return judged.select("query_id", *extra, "ball", "shell", "bound", part.alias("part")), found


def shell_scores(spark: SparkSession, path: str, queries: DataFrame, chosen: DataFrame, k: int, extra: list[str]) -> DataFrame:
    """(query_id, doc_id, score): the k best of each chosen shell for its query; queries of a shell meet it 256 at a time or so."""
    key = [*extra, "ball", "shell"]
    asked = chosen.join(queries.select("query_id", "vector"), "query_id")
    many = asked.groupBy(*key).agg(F.count("*").alias("n"))
    parts = asked.join(many, key).withColumn("part", F.pmod(F.xxhash64("query_id"), F.ceil(F.col("n") / 256)))
    lists = parts.groupBy(*key, "part").agg(F.collect_list(F.struct("query_id", "vector")).alias("asked"))
    met = lists.join(spark.read.parquet(f"{path}/shells").select(*key, "ids", "flat"), key)
    rows = met.select(F.transform("asked", lambda x: x["query_id"]).alias("qids"), F.flatten(F.transform("asked", lambda x: x["vector"])).alias("q"), "ids", "flat")
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qids, ids = batch.column(0)[i].values, batch.column(2)[i].values
                q, x = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(len(of), -1) for c, of in ((1, qids), (3, ids)))
                s = np.round(q @ x.T, 12)
                order = np.lexsort((np.broadcast_to(ids.to_numpy(zero_copy_only=False), s.shape), -s))[:, :k]
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(np.repeat(np.arange(len(qids)), order.shape[1]))), ids.take(pa.array(order.ravel())), pa.array(np.take_along_axis(s, order, 1).ravel())], names=["query_id", "doc_id", "score"])

    of = lambda c: kinds[c][len("array<") : -1]
    return rows.mapInArrow(run, f"query_id {of('qids')}, doc_id {of('ids')}, score double")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, same: str | None = None, first: int = 4) -> DataFrame:
    """(query_id, doc_id, score, rank) as dense.top_k gives them, from a stored index. queries: query_id, vector, and `same` where given."""
    extra = [same] if same else []
    own = materialized(queries.where("vector is not null").select("query_id", "vector", *extra))
    plan, found = shell_plan(spark, path, own, k, same, first)
    rest = shell_scores(spark, path, own, plan.where("part = 1").select("query_id", *extra, "ball", "shell"), k, extra)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return found.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_all(spark: SparkSession, path: str, queries: DataFrame, k: int, same: str | None = None) -> DataFrame:
    """search, for queries that grow with the documents: blocks of queries meet blocks of shells, and no row stands for a query and a shell.

    In a task a query's shells come in order of their bounds, and those that cannot reach its k-th best score are passed over.
    """
    extra = [same] if same else []
    own = materialized(queries.where("vector is not null").select("query_id", "vector", *extra))
    shells = spark.read.parquet(f"{path}/shells").select(*extra, "ball", "near", "far", "ids", "flat")
    shared = spark.sparkContext.broadcast(np.array([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("ball").collect()], float))  # CENTRES at most
    n, dim = own.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    n_qb, n_db = dense.blocks(n, dim + 2 * k), dense.blocks(shells.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0], dim)
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    left = own.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_qb))).withColumn("db", every(n_db))
    right = shells.withColumn("db", F.pmod(F.xxhash64("ball"), F.lit(n_db))).withColumn("qb", every(n_qb))
    kinds = {"query_id": own.schema["query_id"].dataType, "doc_id": shells.schema["ids"].dataType.elementType}
    schema = pa.schema([*((name, to_arrow_type(kind)) for name, kind in kinds.items()), ("score", pa.float64())])

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and held.num_rows:
            qids, q = asked["query_id"].to_numpy(), np.array(asked["vector"].to_pylist(), float)
            ball, near, far = (held[c].to_numpy() for c in ("ball", "near", "far"))
            ids = [x.values.to_numpy(zero_copy_only=False) for x in held["ids"]]
            flat = [x.values.to_numpy(zero_copy_only=False).reshape(len(i), -1) for x, i in zip(held["flat"], ids)]
            for a in range(0, len(qids), 256):
                part = q[a : a + 256]
                angle = np.arccos(np.clip(part @ shared.value.T, -1, 1))[:, ball]
                bound = np.cos(np.maximum(0, np.maximum(angle - far, near - angle))) + MARGIN
                kept = None
                for i in np.argsort(-bound.mean(0), kind="stable"):
                    if kept is None or kept[0].shape[1] < k:
                        kept = dense.best(part, ids[i], flat[i], k, kept)
                    elif len(reach := np.flatnonzero(bound[:, i] >= kept[1][:, -1])):
                        kept[0][reach], kept[1][reach] = dense.best(part[reach], ids[i], flat[i], k, (kept[0][reach], kept[1][reach]))
                out.append(pa.table([np.repeat(qids[a : a + 256], kept[0].shape[1]), kept[0].ravel(), kept[1].ravel()], names=schema.names).cast(schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    key = [*extra, "qb", "db"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, f"query_id {kinds['query_id'].simpleString()}, doc_id {kinds['doc_id'].simpleString()}, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
