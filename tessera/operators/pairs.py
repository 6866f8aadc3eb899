"""Query/answer pairs from raw review comments: ordered screening rules, joins with pull facts, deterministic caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ids, text
from tessera.operators.places import block_digest, numbered
from tessera.session import materialized

MAX_PAIRS_PER_PR = 3


def drop_reason() -> Column:
    """Why a raw comment makes no pair: the first rule that fires, else null.

    Reads path, diff_hunk, in_reply_to_id, login, user_type and body; a null login is a missing user.
    """
    body, hunk = F.col("body"), F.col("diff_hunk")
    state = text.before_state(hunk)
    return (
        F.when(F.coalesce(F.col("path"), F.lit("")) == "", "no_path_or_hunk")
        .when(text.strip(F.coalesce(hunk, F.lit(""))) == "", "no_path_or_hunk")
        .when(F.col("in_reply_to_id").isNotNull(), "reply")
        .when(text.is_bot(F.col("login"), F.col("user_type"), F.col("login").isNotNull()), "bot")
        .when(body.isNull(), "short")
        .when(text.nit_reason(body).isNotNull(), text.nit_reason(body))
        .when(state == "", "empty_before_state")
        .when(body.contains(state) | body.contains(text.strip(hunk)), "body_quotes_hunk")
    )


def screened(comments: DataFrame) -> DataFrame:
    """comments with drop_reason, pull_request (0 where the url has no number) and has_suggestion."""
    return comments.select(
        "*",
        drop_reason().alias("drop_reason"),
        F.coalesce(text.url_number(F.col("pull_request_url")), F.lit(0)).alias("pull_request"),
        text.has_suggestion(F.col("body")).alias("has_suggestion"),
    )


def with_gold(rows: DataFrame, gold_units: DataFrame) -> DataFrame:
    """Marks candidates whose comment unit is not in the corpus (unit_id)."""
    gold = ids.unit_id(F.col("repo"), F.lit("review_comment"), F.concat(F.lit("review_comment/"), F.col("id").cast("string")))
    known = gold_units.select("unit_id", F.lit(True).alias("in_corpus")).distinct()
    joined = rows.withColumn("unit_id", gold).join(known, "unit_id", "left")
    return joined.withColumn("drop_reason", F.coalesce("drop_reason", F.when(F.col("in_corpus").isNull(), "gold_not_in_corpus"))).drop("in_corpus")


def with_pull_facts(rows: DataFrame, pulls: DataFrame) -> DataFrame:
    """Marks candidates of pulls that are unknown or unmerged, or written by the commenter."""
    facts = pulls.select("repo", F.col("number").alias("pull_request"), "merged", F.col("author").alias("pull_author"))
    joined = rows.join(facts, ["repo", "pull_request"], "left")
    reason = F.when(~F.coalesce("merged", F.lit(False)), "not_merged").when(F.lower("pull_author") == F.lower("login"), "self_review")
    return joined.withColumn("drop_reason", F.coalesce("drop_reason", reason)).drop("merged", "pull_author")


def capped_per_pull(rows: DataFrame, most: int = MAX_PAIRS_PER_PR) -> DataFrame:
    """Keeps a pull's earliest comments."""
    standing = F.col("drop_reason").isNull()
    place = F.row_number().over(Window.partitionBy("repo", "pull_request", standing).orderBy("id"))
    return rows.withColumn("drop_reason", F.when(standing & (place > most), "per_pr_cap").otherwise(F.col("drop_reason")))


def repo_cap(rows: DataFrame) -> DataFrame:
    """One row, cap: the whole part of the median of pairs a repository, repositories without any included."""
    counts = rows.groupBy("repo").agg(F.count(F.when(F.col("drop_reason").isNull(), 1)).alias("n"))
    return counts.agg(F.floor(F.median("n")).cast("long").alias("cap"))


def capped_per_repo(rows: DataFrame) -> DataFrame:
    """Keeps, in each repository, the pairs whose comment id hashes lowest, up to the cap; rows that repeat an id are one."""
    standing = F.col("drop_reason").isNull()
    own = materialized(rows)  # read by the cap, by the places and by their join
    keys = own.where(standing).select("repo", "id", F.sha2(F.col("id").cast("string"), 256).alias("drawn")).distinct()
    places = numbered(keys, ["repo"], ["drawn", "id"]).select(F.col("repo").alias("__repo"), F.col("id").alias("__id"), "place")  # ids alone are sorted
    return (
        own.join(places, standing & F.col("repo").eqNullSafe(F.col("__repo")) & (F.col("id") == F.col("__id")), "left").drop("__repo", "__id")
        .crossJoin(F.broadcast(repo_cap(own)))  # one row
        .withColumn("drop_reason", F.when(standing & (F.col("place") > F.col("cap")), "per_repo_cap").otherwise(F.col("drop_reason")))
        .drop("place", "cap")
    )


def mined(comments: DataFrame, gold_units: DataFrame, pulls: DataFrame) -> DataFrame:
    """Every comment with its drop_reason after all rules; pairs are those without one."""
    return capped_per_repo(capped_per_pull(with_pull_facts(with_gold(screened(comments), gold_units), pulls)))


def dropped(rows: DataFrame) -> DataFrame:
    """Counts by rule, for each repository (null: all)."""
    return (
        rows.where("drop_reason is not null").rollup("repo", "drop_reason").agg(F.count("*").alias("n"), F.grouping("drop_reason").alias("g"))
        .where("g = 0").drop("g")
        .unionByName(rows.where("drop_reason is not null").groupBy("drop_reason").agg(F.count("*").alias("n")).withColumn("repo", F.lit(None).cast("string")))
    )


def manifest(rows: DataFrame) -> DataFrame:
    """Seen, kept and suggestion counts of each repository."""
    kept = F.col("drop_reason").isNull()
    return rows.groupBy("repo").agg(F.count("*").alias("seen"), F.count(F.when(kept, 1)).alias("pairs"), F.count(F.when(kept & F.col("has_suggestion"), 1)).alias("suggestions"))


def queries_of(rows: DataFrame) -> DataFrame:
    """Both query texts of every pair: the code before, and the hunk as reviewed."""
    variants = F.array(
        F.struct(F.lit("before").alias("variant"), text.before_state(F.col("diff_hunk")).alias("query")),
        F.struct(F.lit("reviewed").alias("variant"), F.col("diff_hunk").alias("query")),
    )
    return rows.where("drop_reason is null").select("repo", "id", "unit_id", F.inline(variants))


def leaks(queries: DataFrame, gold_texts: DataFrame) -> DataFrame:
    """Queries that their own gold text (unit_id, text) contains; joined on the id, never all with all."""
    said = text.strip(F.col("query"))
    return queries.join(gold_texts, "unit_id").where((said != "") & F.col("text").contains(said)).select("repo", "id", "variant")


def velocity(comments: DataFrame, most: int = 100) -> DataFrame:
    """Comments a day over the days the latest comments of a repository span, and their pulls."""
    latest = F.row_number().over(Window.partitionBy("repo").orderBy(F.col("created_at").desc(), F.col("id").desc()))
    return (
        comments.withColumn("nth", latest).where(F.col("nth") <= most).groupBy("repo")
        .agg(F.count("*").alias("n"), F.greatest(F.datediff(F.max("created_at"), F.min("created_at")), F.lit(1)).alias("days"), F.count_distinct("pull_request").alias("pulls"))
    )


def holdout(rates: DataFrame, every: int = 3) -> DataFrame:
    """rates with split: every third repository by rate, the fastest first, is held out. One row a repository."""
    place = F.row_number().over(Window.orderBy((F.col("n") / F.col("days")).desc(), "repo"))
    return rates.withColumn("split", F.when(place % every == 0, "holdout").otherwise("tune"))


def refused(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows whose repository, whatever its case, is not allowed; callers raise if there are any."""
    return rows.join(allowed.select(F.lower("repo").alias("low")).distinct(), F.lower(rows["repo"]) == F.col("low"), "left_anti")


def frozen_digest(rows: DataFrame) -> DataFrame:
    """One row: pairs and the digest of their records in the frozen order."""
    kept = rows.where("drop_reason is null").withColumn("low", F.lower("repo"))
    line = ids.canonical_json(**{c: F.col(c) for c in ("repo", "id", "pull_request", "path", "diff_hunk", "body", "login")})
    return block_digest(kept, ["low", "id"], line)


def pull_facts(needed: DataFrame, listed: DataFrame, looked_up: DataFrame) -> DataFrame:
    """Facts of the needed pulls: from the listing where it has them, from single look-ups for the rest."""
    keys = ["repo", "number"]
    known = listed.join(needed.select(*keys).distinct(), keys, "left_semi")
    rest = looked_up.join(needed.select(*keys).distinct(), keys, "left_semi").join(known, keys, "left_anti")
    return known.unionByName(rest)
