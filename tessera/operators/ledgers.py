"""Deliveries, claims, comment slots and verdicts: the batch forms of the ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialized

# Pull request actions that start work.
ACTIONS = ("opened", "synchronize", "reopened", "ready_for_review")
MAX_COMMENTS = 3


def from_webhook(payloads: DataFrame) -> DataFrame:
    """Deliveries of (delivery_id, event, payload JSON); a value of the wrong type becomes null, true is no number."""
    part = lambda path: F.try_variant_get(F.try_parse_json("payload"), f"$.{path}", "variant")
    of = lambda path, kind, target: F.when(F.schema_of_variant(part(path)) == kind, F.try_variant_get(part(path), "$", target))
    text = lambda path: of(path, "STRING", "string")
    number = lambda path: of(path, "BIGINT", "long")
    return payloads.select(
        "delivery_id", "event", text("action").alias("action"), text("repository.full_name").alias("repo"), number("pull_request.number").alias("pr"),
        text("pull_request.head.sha").alias("head_sha"), number("installation.id").alias("installation_id"),
    )


def is_actionable() -> Column:
    return (F.col("event") == "pull_request") & F.col("action").isin(*ACTIONS) & F.col("repo").isNotNull() & F.col("pr").isNotNull()


def first_deliveries(deliveries: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The first delivery of each id; ids the ledger has are dropped. Later data never overwrites."""
    rows = deliveries.groupBy("delivery_id").agg(F.min_by(F.struct(*[c for c in deliveries.columns if c != "delivery_id"]), "arrival").alias("x")).select("delivery_id", "x.*")
    return rows if ledger is None else rows.join(ledger.select("delivery_id"), "delivery_id", "left_anti")


def latest_per_pull(deliveries: DataFrame) -> DataFrame:
    return deliveries.where("repo is not null and pr is not null").groupBy("repo", "pr").agg(F.max_by("delivery_id", F.struct("ts", "arrival")).alias("delivery_id"), F.count("*").alias("n"))


def claims(wanted: DataFrame, ledger: DataFrame) -> DataFrame:
    """The runs that win their claim: the first of each (batch, repo, pr) that no earlier run holds."""
    first = wanted.groupBy("batch", "repo", "pr").agg(F.min("run_id").alias("run_id"))
    return first.join(ledger.select("batch", "repo", "pr").distinct(), ["batch", "repo", "pr"], "left_anti")


def released(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """The ledger without claims of the given runs that were never finished."""
    gone = ledger.where("finished_at is null").join(runs.select("run_id"), "run_id", "left_semi")
    return ledger.join(gone.select("run_id"), "run_id", "left_anti")


def slots(offers: DataFrame, ledger: DataFrame, most: int = MAX_COMMENTS) -> DataFrame:
    """(repo, pr, path, line, nth, slot): a slot for each offered comment, in order, or null.

    One comment a line, `most` a pull. A line of the ledger gives no slot and uses none; a slot whose
    posting failed stays spent. Offers are read three times and neither sorted nor moved: only each line's first
    goes on, and what is granted, at most `most` a pull, is joined back.
    """
    place = ["repo", "pr", "path", "line"]
    taken = ledger.select(*place).distinct()
    used = ledger.groupBy("repo", "pr").agg(F.count("*").alias("used"))
    # a number that is null comes first
    least = F.when(F.max(F.col("nth").isNull().cast("int")) == 0, F.min("nth")).alias("first")
    first = offers.groupBy(*place).agg(least).join(taken, place, "left_anti").join(used, ["repo", "pr"], "left")
    slot = F.coalesce("used", F.lit(0)) + F.row_number().over(Window.partitionBy("repo", "pr").orderBy("first"))
    granted = materialized(first.select(*[F.col(c).alias(f"of_{c}") for c in place], F.col("first").alias("of_nth"), slot.alias("slot")).where(F.col("slot") <= most))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*place, "nth")])
    told = [*place, "nth"]
    # offers that are alike share a line and a number: one of them has the slot
    alike = F.row_number().over(Window.partitionBy(*place).orderBy("nth"))
    hits = offers.select(told).join(granted, same).select(*told, F.when(alike == 1, F.col("slot")).alias("slot"))
    return hits.unionByName(offers.select(told).join(granted, same, "left_anti").withColumn("slot", F.lit(None).cast("long")))


def settled(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """Pending slots with the outcome of posting (repo, pr, slot, comment_id, error): posted, or failed with 500 characters of why."""
    joined = ledger.join(results, ["repo", "pr", "slot"], "left")
    status = F.when(F.col("comment_id").isNotNull(), "posted").when(F.col("error").isNotNull(), "failed").otherwise(F.col("status"))
    return joined.withColumn("status", status).withColumn("error", F.substring("error", 1, 500))


def draft_gates(drafts: DataFrame, commentable: DataFrame, existing: DataFrame) -> DataFrame:
    """drafts with fate: self_critique, not_commentable, already_commented, duplicate of a standing draft, or unjudged.

    A line with a comment gives all its drafts already_commented: none of them stands, so none is a duplicate.
    """
    line = ["run_id", "path", "line"]
    ok = commentable.select(*line, F.lit(True).alias("allowed")).distinct()
    old = existing.select(*line, F.lit(True).alias("old")).distinct()
    joined = drafts.join(ok, line, "left").join(old, line, "left")
    praised = F.col("specific") & F.col("non_obvious") & F.col("grounded")
    passing = praised & F.col("allowed").isNotNull()
    nth = F.row_number().over(Window.partitionBy(*line, passing).orderBy("position"))
    fate = F.when(~praised, "self_critique").when(F.col("allowed").isNull(), "not_commentable").when(F.col("old").isNotNull(), "already_commented").when(nth > 1, "duplicate").otherwise("unjudged")
    return joined.withColumn("fate", fate).drop("allowed", "old")


def filter_verdicts(gated: DataFrame, verdicts: DataFrame, most: int = MAX_COMMENTS) -> DataFrame:
    """Fates after the filter: a draft without a verdict, or a false one, is filtered; kept ones past `most` are over_cap."""
    joined = gated.join(verdicts.select("run_id", "position", "keep"), ["run_id", "position"], "left")
    keep = (F.col("fate") == "unjudged") & F.coalesce("keep", F.lit(False))
    nth = F.sum(keep.cast("int")).over(Window.partitionBy("run_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    fate = F.when(F.col("fate") != "unjudged", F.col("fate")).when(~keep, "filtered").when(nth > most, "over_cap").otherwise("kept")
    return joined.withColumn("fate", fate).drop("keep")


def batch_drafts(drafts: DataFrame, runs: DataFrame, batch: str) -> DataFrame:
    return drafts.join(runs.where(F.col("batch") == batch).select("run_id", "repo", "pr", "head_sha"), "run_id")


def silent_runs(runs: DataFrame, drafts: DataFrame, batch: str) -> DataFrame:
    return runs.where(F.col("batch") == batch).join(drafts.select("run_id").distinct(), "run_id", "left_anti")


def replayed_elsewhere(runs: DataFrame, batch: str, compare: list[str]) -> DataFrame:
    """Pulls that other batches replayed, but for this batch's and the compared ones' own."""
    others = runs.where(~F.col("batch").isin(batch, *compare)).select("repo", "pr").distinct()
    return others.join(runs.where(F.col("batch").isin(batch, *compare)).select("repo", "pr").distinct(), ["repo", "pr"], "left_anti")


def replay_choice(pulls: DataFrame, used: DataFrame, batch: str, n: int) -> DataFrame:
    """(repo, pr, turn): n pulls in turn over repositories, in an order the batch's name fixes."""
    key = lambda pr: F.sha2(F.concat(F.lit(f"{batch}|"), "repo", F.lit("|"), pr.cast("string")), 256)
    left = pulls.select("repo", "pr").distinct().join(used, ["repo", "pr"], "left_anti")
    turn = F.row_number().over(Window.partitionBy("repo").orderBy(key(F.col("pr")), "pr"))
    return left.select("repo", "pr", turn.alias("turn"), key(F.lit(0)).alias("h")).orderBy("turn", "h").limit(n).drop("h")


def finished(runs: DataFrame, fates: DataFrame, calls: DataFrame) -> DataFrame:
    """Runs with their draft counts, kept comments, summed tokens and rounded seconds; an empty new head keeps the old."""
    counts = fates.groupBy("run_id").agg(F.count("*").alias("drafts"), F.count(F.when(F.col("fate") == "kept", 1)).alias("kept"))
    spent = calls.groupBy("run_id").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("seconds"), 3).alias("seconds"), F.max("new_head").alias("new_head"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return runs.join(counts, "run_id", "left").join(spent, "run_id", "left").select(
        "run_id", "batch", "repo", "pr", F.coalesce(F.nullif("new_head", F.lit("")), "head_sha").alias("head_sha"), *map(zero, ("drafts", "kept", "prompt_tokens", "completion_tokens")), "seconds",
    )


def replay_summary(done: DataFrame, batch: str) -> DataFrame:
    """Per pull of a batch, and in all (null): runs, tokens, drafts, kept, silent."""
    aggs = [F.count("*").alias("runs"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.sum("drafts").alias("drafts"), F.sum("kept").alias("kept"), F.count(F.when(F.col("drafts") == 0, 1)).alias("silent")]
    own = done.where(F.col("batch") == batch)
    return own.groupBy("repo", "pr").agg(*aggs).unionByName(own.agg(*aggs).withColumn("repo", F.lit(None).cast("string")).withColumn("pr", F.lit(None).cast("bigint")))


def verdict_table(fates: DataFrame, runs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(batch, fate, keep, kill, unjudged) from verdicts (run_id, position, verdict)."""
    rows = fates.join(runs.select("run_id", "batch"), "run_id").join(verdicts, ["run_id", "position"], "left")
    said = lambda v: F.count(F.when(F.col("verdict") == v, 1)).alias(v)
    return rows.groupBy("batch", "fate").agg(said("keep"), said("kill"), F.count(F.when(F.col("verdict").isNull(), 1)).alias("unjudged"))


def verdict_lines(reports: DataFrame) -> DataFrame:
    """(report_id, number, draft_id, verdict, reason, refused) from the filled VERDICT lines of (report_id, text)."""
    from tessera.functions.text import split_lines, strip

    line = r"^VERDICT ([0-9]+):[ \t]*(.*)$"
    decision = r"(?i)^(keep|kill)\b[\s,:;.]*(.*)$"
    said = strip(F.regexp_extract("line", line, 2))
    lines = reports.select("report_id", F.posexplode(split_lines(F.col("text"))).alias("at", "line")).where(F.col("line").rlike(line)).withColumn("said", said).where("said <> ''")
    return lines.select(
        "report_id", (F.col("at") + 1).alias("number"), F.regexp_extract("line", line, 1).cast("long").alias("draft_id"),
        F.when(F.col("said").rlike(decision), F.lower(F.regexp_extract("said", decision, 1))).alias("verdict"),
        F.when(F.col("said").rlike(decision), strip(F.regexp_extract("said", decision, 2))).alias("reason"), (~F.col("said").rlike(decision)).alias("refused"),
    )


def violations(runs: DataFrame) -> DataFrame:
    """Runs whose mode disagrees with their keys: live if and only if a delivery, replay if and only if a batch."""
    return runs.where(((F.col("mode") == "live") != F.col("delivery_id").isNotNull()) | ((F.col("mode") == "replay") != F.col("batch").isNotNull()))


def grounding(lookups: DataFrame) -> DataFrame:
    """(run_id, turns, answered, summary): the answered look-ups in order."""
    return lookups.groupBy("run_id").agg(
        F.max("turn").alias("turns"), F.count(F.when(F.col("ok"), 1)).alias("answered"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("turn", F.concat_ws(" ", "tool", "summary").alias("s"))))), lambda x: x["s"]), "; ").alias("summary"),
    )
