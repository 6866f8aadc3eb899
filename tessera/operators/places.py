"""Places of rows in an order, and values carried along it, for groups of any size: range partitions and offsets, never one task a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialized


def _fresh(taken: list[str], *names: str) -> list[str]:
    """The names, longer where a column has one of them already, whatever the case."""
    low = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name += "_"
        out.append(name)
    return out


def running(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None) -> DataFrame:
    """rows with running values along each group's order: `sums` {name: column} up to and with a row, `lasts` {name:
    column} the last value that is not null at or before it.

    Rows are range-partitioned by group and order and written, so a large group lies in many partitions. Values
    inside a partition are found there; what comes before it is one row a partition and group. A null group
    is a group. Rows that tie on `order` lie in one partition, in any order: where there may be many, `order` ends with a
    column that tells them apart.
    """
    sums, lasts = sums or {}, lasts or {}
    part, of_part, *of = _fresh(rows.columns, "at_part", "of_part", *[f"of_{i}" for i in range(len(group))])
    before = dict(zip([*sums, *lasts], _fresh(rows.columns, *[f"before_{n}" for n in (*sums, *lasts)])))
    keys = [*group, *order]
    cut = materialized(rows.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()))
    place = F.struct(*order)
    own = cut.groupBy(part, *group).agg(
        *[F.sum(v).alias(before[n]) for n, v in sums.items()], *[F.max_by(v, F.when(F.col(v).isNotNull(), place)).alias(before[n]) for n, v in lasts.items()]
    )
    across = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = own.select(
        F.col(part).alias(of_part), *[F.col(g).alias(o) for g, o in zip(group, of)],
        *[F.coalesce(F.sum(before[n]).over(across), F.lit(0)).alias(before[n]) for n in sums], *[F.last(before[n], True).over(across).alias(before[n]) for n in lasts],
    )
    inside = Window.partitionBy(part, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = cut.withColumns({**{n: F.sum(v).over(inside) for n, v in sums.items()}, **{n: F.last(v, True).over(inside) for n, v in lasts.items()}})
    same = [F.col(part) == F.col(of_part), *[F.col(g).eqNullSafe(F.col(o)) for g, o in zip(group, of)]]
    both = here.join(offsets, reduce(lambda a, b: a & b, same))
    return both.select(
        *rows.columns, *[(F.col(before[n]) + F.col(n)).alias(n) for n in sums], *[F.coalesce(F.col(n), F.col(before[n])).alias(n) for n in lasts]
    )


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "place") -> DataFrame:
    """rows with `name`: each row's place, from 1, among the rows of its group; see running()."""
    one = _fresh([*rows.columns, name], "one")[0]
    return running(rows.withColumn(one, F.lit(1).cast("long")), group, order, {name: one}).drop(one)


def block_digest(rows: DataFrame, order: list[str], line: Column, block: int = 4096, levels: int = 3) -> DataFrame:
    """One row, digest: SHA-256 over all lines in order, in `levels` of blocks.

    Each line is hashed; `block` hashes in order, joined by line feeds, are hashed to one, and so on; the last
    level joins what is left. With 4,096 a block and three levels, a billion rows leave one entry, and no task
    holds more than a block of hashes. Order keys must be unique. No rows give the hash of an empty text.
    """
    keys = [f"k{i}" for i in range(len(order))]
    hashed = rows.select(*[F.col(c).alias(k) for c, k in zip(order, keys)], F.sha2(line, 256).alias("h"))
    at = numbered(hashed, [], keys, "at").select((F.col("at") - 1).alias("at"), "h")
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "\n"), 256)
    for _ in range(levels - 1):
        at = at.groupBy(F.floor(F.col("at") / block).alias("at")).agg(joined.alias("h"))
    return at.agg(joined.alias("digest"))


def parts(rows: DataFrame, order: list[str], group: list[str], n: int) -> DataFrame:
    """rows with `part`, dealt in turn in a fixed order inside each group."""
    return numbered(rows, group, order, "__place").withColumn("part", F.pmod(F.col("__place") - 1, F.lit(n))).drop("__place")
