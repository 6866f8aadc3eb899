"""Retrieval metrics: recall, intervals, fusion and leakage verdicts, truncation, percentiles, nDCG."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.places import numbered

KS = (1, 5, 10, 20, 50)


def gold_ranks(ranked: DataFrame, gold: DataFrame, *config: str) -> DataFrame:
    """(config.., query_id, gold_rank): where each query's gold document came; null when it did not."""
    configs = ranked.select(*config).distinct() if config else None
    wanted = gold.select("query_id", F.col("doc_id").alias("wanted"))
    wanted = wanted.crossJoin(F.broadcast(configs)) if config else wanted  # one row a configuration
    found = ranked.select(*config, "query_id", F.col("doc_id").alias("wanted"), F.col("rank").alias("gold_rank"))
    return wanted.join(found, [*config, "query_id", "wanted"], "left").select(*config, "query_id", "gold_rank")


def recall_at(ranks: DataFrame, *config: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """n and recall@k for each configuration."""
    hit = lambda k: F.avg(F.coalesce((F.col("gold_rank") <= k).cast("int"), F.lit(0)))
    return ranks.groupBy(*config).agg(F.count("*").alias("n"), *[F.round(F.coalesce(hit(k), F.lit(0.0)), 9).alias(f"recall_{k}") for k in ks])


def interval(p: Column, n: Column) -> Column:
    """Half-width of the 95% Wald interval."""
    return F.when(n > 0, 1.96 * F.sqrt(p * (1 - p) / n)).otherwise(0.0)


def length_buckets(ranks: DataFrame, lengths: DataFrame, window: int, k: int = 10) -> DataFrame:
    """(fits, n, recall): recall@k of the queries (query_id, tokens) that fit the window and of those that do not."""
    return recall_at(ranks.join(lengths, "query_id").withColumn("fits", F.col("tokens") <= window), "fits", ks=(k,)).select("fits", "n", F.col(f"recall_{k}").alias("recall"))


def filter_rows(kept: DataFrame, gold: DataFrame, budgets: list[int], allowed: DataFrame, k: int = 10) -> DataFrame:
    """Per budget: recall@k, mean rows returned, share short of k; selectivity is the mean share allowed (query_id, share)."""
    every = gold.select("query_id", F.col("doc_id").alias("wanted")).withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    got = kept.groupBy("query_id", "budget").agg(F.count("*").alias("returned"), F.collect_list("doc_id").alias("docs"))  # k ids
    rows = every.join(got, ["query_id", "budget"], "left").join(allowed, "query_id", "left")
    n = F.coalesce("returned", F.lit(0))
    return rows.groupBy("budget").agg(
        F.round(F.avg(F.coalesce(F.array_contains("docs", F.col("wanted")).cast("int"), F.lit(0))), 9).alias("recall"),
        F.round(F.avg(n), 9).alias("mean_returned"), F.round(F.avg((n < k).cast("int")), 9).alias("share_short"), F.round(F.avg("share"), 9).alias("selectivity"),
    )


def fusion_verdict(recalls: DataFrame) -> DataFrame:
    """(model, gap, margin, verdict) from (model, retriever, n, recall_10); bm25 rows have a null model."""
    of = lambda name, value: F.max(F.when(F.col("retriever") == name, F.col(value)))
    word = recalls.agg(of("bm25", "recall_10").alias("bm25"))  # one row
    wide = recalls.where("model is not null").groupBy("model").agg(of("dense", "recall_10").alias("dense"), of("rrf", "recall_10").alias("rrf"), of("rrf", "n").alias("asked"))
    best = F.greatest("dense", "bm25")
    judged = wide.crossJoin(F.broadcast(word)).select("model", F.round(F.col("rrf") - best, 9).alias("gap"), F.round(interval(best, F.col("asked")), 9).alias("margin"))
    return judged.withColumn("verdict", F.when(F.col("gap") > F.col("margin"), "earns it").when(F.col("gap") < -F.col("margin"), "loses").otherwise("no clear gain"))


def leakage_gap(recalls: DataFrame) -> DataFrame:
    """(variant, retriever, with_hunk, body_only, gap) from rows of both serialisations."""
    wide = recalls.groupBy("variant", "retriever").pivot("serialisation", ["with_hunk", "body_only"]).agg(F.max("recall_10"))
    return wide.withColumn("gap", F.round(F.col("with_hunk") - F.col("body_only"), 9))


def best_model(recalls: DataFrame) -> DataFrame:
    """(model): the model of the best mean fused recall@20 over the variants, ties to the first name."""
    means = recalls.where("retriever = 'rrf'").groupBy("model").agg(F.avg("recall_20").alias("mean"))
    return means.agg(F.min_by("model", F.struct(-F.col("mean"), "model")).alias("model"))


def overflow(rows: DataFrame, window: int) -> DataFrame:
    """(kind, n, over_512, over_window, median_tokens) for each kind, and for all with a null kind."""
    share = lambda at: F.round(F.avg((F.col("tokens") > at).cast("int")), 9)
    aggs = [F.count("*").alias("n"), share(512).alias("over_512"), share(window).alias("over_window"), F.median("tokens").alias("median_tokens")]
    return rows.groupBy("kind").agg(*aggs).unionByName(rows.agg(*aggs).withColumn("kind", F.lit(None).cast("string")))


def percentiles(samples: DataFrame, value: str, *group: str, skip_zero: bool = False) -> DataFrame:
    """(group.., p50, p95, most, n): exact median and nearest-rank p95 at round-half-even(0.95 (n - 1)).

    Both come from places, so a large group is neither gathered in one array nor sorted in one task.
    """
    rows = samples.where(F.col(value).isNotNull() & (F.col(value) != 0)) if skip_zero else samples.where(F.col(value).isNotNull())
    placed = numbered(rows.select(*group, value), list(group), [value], "__at").withColumn("__at", F.col("__at") - 1)
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n"), F.max(value).alias("most"))  # one row a group
    keyed = placed.join(sizes, [*group]) if group else placed.crossJoin(F.broadcast(sizes))
    p95 = F.max(F.when(F.col("__at") == F.bround(0.95 * (F.col("n") - 1), 0).cast("long"), F.col(value)))
    middle = F.col("__at").isin(F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2))
    return keyed.groupBy(*group).agg(F.avg(F.when(middle, F.col(value).cast("double"))).alias("p50"), p95.alias("p95"), F.max("most").alias("most"), F.max("n").alias("n"))


def ideal_gains(qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, gains): each query's k largest gains, largest first."""
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("gain").desc(), "doc_id"))
    best = qrels.withColumn("r", nth).where(F.col("r") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("r", "gain"))).alias("x"))  # k entries
    return best.select("query_id", F.transform("x", lambda x: x["gain"]).alias("gains"))


def ndcg(found: DataFrame, ideal: DataFrame, k: int = 10) -> DataFrame:
    """One row: mean nDCG@k with linear gain, its 95% half-width, hit rate and n, over the queries with judgements.

    found: ranked documents that are judged (query_id, rank, gain); ideal: (query_id, gains) of the judged queries.
    """
    discount = lambda rank: F.log2(rank + 1.0)
    gained = found.where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(F.col("gain") / discount(F.col("rank"))).alias("dcg"), F.count(F.when(F.col("gain") > 0, 1)).alias("hits"))
    best = F.aggregate(F.transform("gains", lambda gain, i: gain / discount(i + 1)), F.lit(0.0), lambda s, x: s + x)
    judged = ideal.select("query_id", best.alias("ideal")).join(gained, "query_id", "left")
    each = judged.select(F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("v"), (F.coalesce("hits", F.lit(0)) > 0).cast("int").alias("hit"))
    return each.agg(
        F.round(F.avg("v"), 9).alias("ndcg"), F.round(1.96 * F.coalesce(F.stddev_samp("v"), F.lit(0.0)) / F.sqrt(F.count("*")), 9).alias("half_width"), F.round(F.avg("hit"), 9).alias("hit_rate"), F.count("*").alias("n")
    )
