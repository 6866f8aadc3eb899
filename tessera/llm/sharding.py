"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into a fixed number of arcs. Spark sums the bytes of each arc (a partial aggregate,
at most `arcs` rows reach the driver whatever the input), the walk around the ring gives every arc
to the shard of the next virtual node clockwise, and what a full shard cannot take goes on clockwise.
An arc that meets a full shard part-way is split at a byte offset, so rows are placed by their running
sum inside their own arc; no window spans a whole shard.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialized
from tessera.operators.places import running

#: Arcs of the ring: a power of two, so that an arc is the top bits of a key's hash.
ARC_BITS = 16


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise; positions are 64-bit."""
    spots = []
    for shard in range(shards):
        for v in range(vnodes):
            spot = hashlib.blake2b(f"shard-{shard}/vnode-{v}".encode(), digest_size=8).digest()
            spots.append((int.from_bytes(spot, "big"), shard))
    return sorted(spots)


def walk(loads: list[tuple[int, int]], large: list[tuple[int, int]], shards: int, vnodes: int, slack: float, arc_bits: int = ARC_BITS) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Give keys to shards, each shard holding at most its capacity, (1 + slack) times the mean.

    Keys that are larger than the mean, with the shards they fill, are left out of it.

    loads: (arc, bytes) of the small keys of an arc, which may be split between shards: the first result
    has (arc, from_byte, to_byte, shard). large: (arc, bytes) of single keys, placed before the others
    and the largest first; the second result has their shards. A key that fits nowhere goes to the
    emptiest shard.
    """
    left, taking = sum(size for _, size in loads) + sum(size for _, size in large), shards
    for _, size in sorted(large, key=lambda x: -x[1]):  # a key above the mean fills a shard of its own
        if taking == 1 or size * taking <= left:
            break
        left, taking = left - size, taking - 1
    capacity = math.ceil(left * (1 + slack) / taking)
    spots = ring(shards, vnodes)
    positions = [p for p, _ in spots]
    known: dict[int, list[int]] = {}
    room = [capacity] * shards

    def clockwise(arc: int) -> list[int]:
        at = bisect_left(positions, arc << (64 - arc_bits)) % len(spots)
        if at not in known:
            known[at] = list(dict.fromkeys(shard for _, shard in spots[at:] + spots[:at]))
        return known[at]

    places = [0] * len(large)
    for i in sorted(range(len(large)), key=lambda i: (-large[i][1], i)):
        arc, size = large[i]
        places[i] = next((s for s in clockwise(arc) if room[s] >= size), None)
        if places[i] is None:
            places[i] = max(range(shards), key=lambda s: room[s])
        room[places[i]] -= size
    out = []
    for arc, size in sorted(loads):
        start = 0
        order = clockwise(arc)
        for shard in [*order, max(range(shards), key=lambda s: room[s])]:
            take = min(size - start, max(0, room[shard]))
            if start + take < size and shard is order[-1] and sum(max(0, r) for r in room) <= take:
                take = size - start  # nothing is left anywhere: large keys took more than their share
            if take > 0:
                out.append((arc, start, start + take, shard))
                room[shard] -= take
                start += take
            if start == size:
                break
    return out, places


def bounded_load_shards(rows: DataFrame, key: str, size: Column, shards: int = 8, vnodes: int = 256, slack: float = 0.0005, arc_bits: int = ARC_BITS, carry: dict[str, Column] | None = None) -> DataFrame:
    """Place every row in a shard of the ring; the sizes of shards are near equal.

    Returns key, size, shard, slot (gapless from 0 inside a shard) and the carried columns. Rows larger
    than a thousandth of a shard (at most 1000 * shards of them) are placed one by one, all others by
    their running byte offset inside their arc. A null key hashes like any other value. Rows with equal
    keys are placed one by one, however many they are. An empty input gives an empty result. `size` must be positive.
    """
    spark = rows.sparkSession
    extra = [f"c_{name}" for name in carry or {}]
    narrow = materialized(
        rows.select(
            F.col(key).alias("k"),
            size.cast("long").alias("bytes"),
            F.xxhash64(F.col(key)).alias("h"),
            *[c.alias(f"c_{name}") for name, c in (carry or {}).items()],
        ).withColumn("arc", F.shiftrightunsigned("h", 64 - arc_bits).cast("int")).withColumn("tie", F.monotonically_increasing_id())
    )
    loads = {r.arc: r.bytes for r in narrow.groupBy("arc").agg(F.sum("bytes").alias("bytes")).collect()}  # at most 2^arc_bits rows
    least = sum(loads.values()) // (1000 * shards)
    nth = Window.partitionBy("h", "bytes").orderBy("k", *extra)
    large = narrow.where(F.col("bytes") > least).withColumn("nth", F.row_number().over(nth))
    singles = sorted((r.arc, r.bytes, r.h, r.nth) for r in large.select("arc", "bytes", "h", "nth").collect())  # at most 1000 * shards rows
    for arc, n, _, _ in singles:
        loads[arc] -= n
    spans, places = walk([(arc, n) for arc, n in loads.items() if n], [(arc, n) for arc, n, _, _ in singles], shards, vnodes, slack, arc_bits)
    taken = [0] * shards
    single_plan = []
    for (_, n, h, i), shard in zip(singles, places):
        single_plan.append((h, n, i, shard, taken[shard]))
        taken[shard] += 1
    out = [F.col("k").alias(key), F.col("bytes").alias("size"), "shard", "slot", *[F.col(f"c_{name}").alias(name) for name in carry or {}]]
    placed_large = large.join(F.broadcast(spark.createDataFrame(single_plan, "h long, bytes long, nth int, shard int, slot long")), ["h", "bytes", "nth"])

    plan = spark.createDataFrame([(arc, a, b, shard, i) for i, (arc, a, b, shard) in enumerate(spans)], "arc int, from_byte long, to_byte long, shard int, segment int")
    # running offsets come from range partitions, so an arc that holds one key very often lies in many
    small = narrow.where(F.col("bytes") <= least).withColumn("one", F.lit(1).cast("long"))
    order = running(small, ["arc"], ["h", "k", "bytes", *extra, "tie"], {"upto": "bytes", "nth": "one"})
    placed = materialized(
        order.withColumn("start", F.col("upto") - F.col("bytes"))
        .join(F.broadcast(plan), "arc")  # at most arcs + shards rows
        .where("start >= from_byte and start < to_byte")
    )
    counts = placed.groupBy("segment", "shard").agg(F.count("*").alias("n"), F.min("nth").alias("first_nth"))  # at most arcs + shards rows
    first = spark.createDataFrame(list(enumerate(taken)), "shard int, taken long")
    so_far = F.sum("n").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0))
    offsets = counts.join(F.broadcast(first), "shard").select("segment", (F.col("taken") + so_far - F.col("n") - F.col("first_nth")).alias("before"))
    placed_small = placed.join(F.broadcast(offsets), "segment").withColumn("slot", F.col("before") + F.col("nth"))
    return placed_large.select(*out).unionByName(placed_small.select(*out))
