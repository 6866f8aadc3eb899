"""A greedy roll over a long ordered group, in parallel: each shard takes units until it holds `rows` or would pass `size`.

Where a shard starts depends on where the one before it did. A group is cut into chunks of a fixed number of
units; inside one, the next start after every possible start is known from running sums, so a chunk is a map
from the place at which a shard enters it to the place at which one enters the next chunk, and the number of
shards between. No shard holds more than `rows` units, so a map has `rows` entries, whatever the group. Maps
are composed 64 at a time, level by level, until one row a group is left; then the entries are told downwards
again, and every chunk rolls on its own. No task holds more than a chunk or 64 maps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.places import numbered
from tessera.session import materialized

#: Units of a chunk, in shards; maps that are composed at once.
CHUNK_SHARDS, FAN = 8, 64
_MAP = "repo string, kind string, chunk long, exits array<int>, counts array<int>"
_ENTRY = "repo string, kind string, chunk long, entry int, number long"


def next_starts(lengths: np.ndarray, rows: int, size: int) -> np.ndarray:
    """For each unit, where the shard after the one that it starts would start; the number of units where none does."""
    ends = np.cumsum(lengths)
    at = np.arange(len(lengths))
    full = np.searchsorted(ends, ends - lengths + size, side="right")
    return np.minimum(np.maximum(full, at + 1), np.minimum(at + rows, len(lengths)))


def chunk_map(lengths: np.ndarray, own: int, rows: int, size: int) -> tuple[list[int], list[int]]:
    """(exits, counts) for entries 0 to rows - 1 of a chunk of `own` units, whose lengths are followed by those of the next units.

    An exit counts from the next chunk's first unit. An entry beyond the chunk leaves it as it came.
    """
    follow = next_starts(lengths, rows, size).tolist()
    exits, counts = list(range(own + rows)), [0] * (own + rows)
    for i in range(own - 1, -1, -1):
        j = follow[i]
        exits[i], counts[i] = (exits[j], counts[j] + 1) if j < own else (j, 1)
    return [max(x - own, 0) for x in exits[:rows]], counts[:rows]


def rolled(units: DataFrame, rows: int, size: int, fan: int = FAN, chunk_shards: int = CHUNK_SHARDS) -> DataFrame:
    """(repo, kind, unit_id, number) of (repo, kind, unit_id, bytes): which shard of its (repo, kind) a unit is in, in unit_id order."""
    own = rows * chunk_shards
    narrow = units.select("repo", "kind", "unit_id", F.col("bytes").cast("long").alias("bytes"))
    placed = materialized(numbered(narrow, ["repo", "kind"], ["unit_id"]).withColumn("at", F.col("place") - 1).drop("place").withColumn("chunk", F.expr(f"at div {own}")))
    # a chunk also sees the first `rows` units after it
    ahead = placed.where((F.col("chunk") > 0) & (F.col("at") % own < rows)).withColumn("chunk", F.col("chunk") - 1)

    def to_map(table: pa.Table) -> pa.Table:
        lengths = table.sort_by("at")["bytes"].to_numpy()
        chunk = table["chunk"][0].as_py()
        exits, counts = chunk_map(lengths, min(len(lengths), own), rows, size)
        first = [table[c][0].as_py() for c in ("repo", "kind")]
        return pa.table({"repo": pa.array([first[0]], pa.string()), "kind": pa.array([first[1]], pa.string()), "chunk": pa.array([chunk], pa.int64()), "exits": pa.array([exits], pa.list_(pa.int32())), "counts": pa.array([counts], pa.list_(pa.int32()))})

    def compose(table: pa.Table) -> pa.Table:
        entry, total = np.arange(rows), np.zeros(rows, np.int64)
        for exits, counts in _maps(table):
            total += counts[entry]
            entry = exits[entry]
        first = [table[c][0].as_py() for c in ("repo", "kind")]
        return pa.table({"repo": pa.array([first[0]], pa.string()), "kind": pa.array([first[1]], pa.string()), "chunk": pa.array([table["chunk"][0].as_py() // fan], pa.int64()), "exits": pa.array([entry.astype(np.int32)], pa.list_(pa.int32())), "counts": pa.array([total.astype(np.int32)], pa.list_(pa.int32()))})

    def tell(table: pa.Table) -> pa.Table:
        """Entries of the chunks of one parent, from the parent's."""
        entry, number = table["entry"][0].as_py(), table["number"][0].as_py()
        chunks, entries, numbers = sorted(table["chunk"].to_pylist()), [], []
        for exits, counts in _maps(table):
            entries.append(entry)
            numbers.append(number)
            number += int(counts[entry])
            entry = int(exits[entry])
        n = len(chunks)
        return pa.table({"repo": pa.array([table["repo"][0].as_py()] * n, pa.string()), "kind": pa.array([table["kind"][0].as_py()] * n, pa.string()), "chunk": pa.array(chunks, pa.int64()), "entry": pa.array(entries, pa.int32()), "number": pa.array(numbers, pa.int64())})

    most = placed.agg(F.max("chunk")).first()[0]
    if most is None:
        return placed.select("repo", "kind", "unit_id", F.lit(0).alias("number"))
    keys = ["repo", "kind"]
    zero = lambda df: df.select(*keys, "chunk", F.lit(0).alias("entry"), F.lit(0).cast("long").alias("number"))
    small = placed.where("chunk = 0").select(*keys, "chunk").distinct()
    entries = zero(small)
    if most:  # maps only of the groups that have several chunks
        several = placed.where("chunk > 0").select(F.col("repo").alias("r"), F.col("kind").alias("k")).distinct()
        same = F.col("repo").eqNullSafe(F.col("r")) & F.col("kind").eqNullSafe(F.col("k"))
        levels = [materialized(placed.unionByName(ahead).join(several, same, "left_semi").groupBy(*keys, "chunk").applyInArrow(to_map, _MAP))]
        while most:
            levels.append(materialized(levels[-1].withColumn("parent", F.expr(f"chunk div {fan}")).groupBy(*keys, "parent").applyInArrow(compose, _MAP)))
            most //= fan
        told = zero(levels[-1])
        for level in reversed(levels[:-1]):
            above = told.select(F.col("repo").alias("r"), F.col("kind").alias("k"), F.col("chunk").alias("parent"), "entry", "number")
            below = level.withColumn("of", F.expr(f"chunk div {fan}"))
            met = below.join(above, same & (F.col("of") == F.col("parent"))).drop("r", "k", "of")
            told = materialized(met.groupBy(*keys, "parent").applyInArrow(tell, _ENTRY))
        entries = entries.join(several, same, "left_anti").unionByName(told)

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their chunks; a shard under way is three numbers."""
        key = None
        for batch in batches:
            out = []
            for repo, kind, chunk, at, length, entry, number in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6, 7))):
                if (repo, kind, chunk) != key:
                    key, n, filled, current = (repo, kind, chunk), rows, 0, number - 1
                    start = chunk * own + entry
                if at >= start and (n >= rows or filled + length > size):
                    n, filled, current = 0, 0, current + 1
                n, filled = (n + 1, filled + length) if at >= start else (n, filled)
                out.append(current)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int32())], names=["repo", "kind", "unit_id", "number"])

    e = entries.select(F.col("repo").alias("r"), F.col("kind").alias("k"), F.col("chunk").alias("c"), "entry", "number")
    known = placed.join(e, F.col("repo").eqNullSafe(F.col("r")) & F.col("kind").eqNullSafe(F.col("k")) & (F.col("chunk") == F.col("c")))
    known = known.select("repo", "kind", "unit_id", "chunk", "at", "bytes", "entry", "number")
    ordered = known.repartition("repo", "kind", "chunk").sortWithinPartitions("repo", "kind", "chunk", "at")
    return ordered.mapInArrow(roll, "repo string, kind string, unit_id string, number int")


def _maps(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(exits, counts) of a table's chunks in order."""
    ordered = table.sort_by("chunk")
    for exits, counts in zip(ordered["exits"], ordered["counts"]):
        yield np.array(exits.as_py(), np.int64), np.array(counts.as_py(), np.int64)
