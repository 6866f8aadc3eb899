"""URL filtering against lists that change over time.

Dated list entries become validity intervals; every capture is judged by the entries that were active
when it was fetched (an as-of join). A capture is looked up under its host, every parent domain and
host/first-path-segment. Captures and the starts of the intervals of a key and category are put in one order of
time, dealt to range partitions, and each capture is in the interval of the last start at or before it, which
may lie in an earlier partition: work grows with captures plus changes, also where one key has many of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialized
from tessera.operators.places import running


def host_of(url: Column) -> Column:
    """Lower-case host without user info, port and a trailing dot; empty where there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@|:[0-9]*$", "")), r"\.$", "")


def lookup_keys(url: Column) -> Column:
    """Host, parent domains and host/first-path-segment, as an array; empty for a url without host."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    first = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]+)", 1)
    both = F.when(first != "", F.concat(parents, F.array(F.concat(host, first)))).otherwise(parents)
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<string>")).otherwise(both)


def interval_starts(entries: DataFrame) -> DataFrame:
    """(key, category, valid_from, active) from dated entries (key, listed_at, action, category).

    action is add or remove; the state of a key's category holds from an entry to its next one. At one
    instant a removal beats an addition. A removal without a category is one of each of the key's
    categories. Rows with a null key or time are ignored, other actions too; repeated entries are one.
    """
    known = entries.where("key is not null and listed_at is not null and action in ('add', 'remove')").select("key", "listed_at", (F.col("action") == "remove").alias("removed"), "category")
    whole = F.col("removed") & F.col("category").isNull()
    ended = known.where(whole).select("key", "listed_at", "removed").distinct().join(known.where(~whole).select("key", "category").distinct(), "key")
    return known.where(~whole).unionByName(ended).groupBy("key", "category", F.col("listed_at").alias("valid_from")).agg((~F.max("removed")).alias("active"))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(key, category, valid_from, valid_to) of the times in which a key is listed; the last interval is open (null end)."""
    later = Window.partitionBy("key", "category").orderBy("valid_from")
    ended = interval_starts(entries).withColumn("valid_to", F.lead("valid_from").over(later))
    return ended.where("active").select("key", "category", "valid_from", "valid_to")


def url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Judge captures (capture_id, url, fetched_at) against dated entries.

    Returns capture_id, url, fetched_at, blocked and the longest active key (ties by text) with its
    category, the last in order where several are active. A null url or fetch time is never blocked. Repeated
    captures are each returned; a null id is an id like others. Other columns, whatever their names, are not
    looked at. An empty table of captures gives no rows, an empty list blocks nothing.
    """
    own = captures.select("capture_id", "url", "fetched_at")
    starts = materialized(interval_starts(entries))  # its size is then known, and a hot key's captures can be dealt anew
    looked_up = own.where("url is not null and fetched_at is not null").distinct().select("*", F.explode(lookup_keys(F.col("url"))).alias("key"))
    listed = looked_up.join(starts.select("key", "category").distinct(), "key")
    asked = listed.select("key", "category", F.col("fetched_at").alias("at"), F.lit(1).alias("step"), F.xxhash64("capture_id", "url").alias("tie"), F.lit(None).cast("boolean").alias("active"), F.struct("capture_id", "url", "fetched_at").alias("capture"))
    began = starts.select("key", "category", F.col("valid_from").alias("at"), F.lit(0).alias("step"), F.lit(0).cast("long").alias("tie"), "active", F.lit(None).cast(asked.schema["capture"].dataType).alias("capture"))
    judged = running(began.unionByName(asked), ["key", "category"], ["at", "step", "tie"], lasts={"state": "active"})
    hits = judged.where("step = 1 and state").select("capture.*", "key", "category").groupBy("capture_id", "url", "fetched_at").agg(F.max(F.struct(F.length("key").alias("n"), "key", "category")).alias("best"))
    a, b = own.alias("a"), hits.alias("b")
    same = F.col("a.capture_id").eqNullSafe(F.col("b.capture_id")) & (F.col("a.url") == F.col("b.url")) & (F.col("a.fetched_at") == F.col("b.fetched_at"))
    return a.join(b, same, "left").select(
        "a.capture_id",
        "a.url",
        "a.fetched_at",
        F.col("b.best").isNotNull().alias("blocked"),
        F.col("b.best.key").alias("matched_key"),
        F.col("b.best.category").alias("category"),
    )
