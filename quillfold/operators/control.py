"""The control plane of the ledger as relational operators: cursors and queues, pending claims with an expiry, suppression, digests, audit and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def advance_cursor(queue: DataFrame, account: str, order: list[str], done: str) -> DataFrame:
    """(account, cursor, waiting): how far each account's queue is done without a gap, and how many entries wait.

    ``order`` are the columns of the queue's order, the first one is the cursor.
    An entry that is done behind one that isn't doesn't move the cursor.
    """
    first_open = F.min(F.when(~F.col(done), F.struct(*order)))
    per = queue.groupBy(account).agg(first_open.alias("_open"), F.count_if(~F.col(done)).alias("waiting"))
    before = F.struct(*order) < F.col("_open")
    reached = queue.join(per, account).filter(F.col("_open").isNull() | before).groupBy(account).agg(F.max(order[0]).alias("cursor"))
    return per.select(account, "waiting").join(reached, account, "left").select(account, "cursor", "waiting")


def sweep(pending: DataFrame, resolutions: DataFrame, key: str, born: str, as_of: Column, ttl_days: int) -> DataFrame:
    """Adds ``outcome`` to claims whose owner isn't clear: ``superseded`` by a later resolution of the key within the time, ``promoted_unconfirmed`` when it ran out (the owner stays null), else ``waiting``.

    ``resolutions`` has (key, resolved_at).
    """
    end = F.col(born) + F.make_interval(days=F.lit(ttl_days))
    met = pending.select(key, "claim_id", born).join(resolutions, key).filter((F.col("resolved_at") > F.col(born)) & (F.col("resolved_at") <= end)).groupBy("claim_id").agg(F.min("resolved_at").alias("resolved_at"))
    outcome = F.when(F.col("resolved_at").isNotNull() & (F.col("resolved_at") <= as_of), "superseded").when(end <= as_of, "promoted_unconfirmed").otherwise("waiting")
    return pending.join(met, "claim_id", "left").withColumn("outcome", outcome).drop("resolved_at")


def not_suppressed(items: DataFrame, suppressions: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Items without a suppression that holds at the time; one without an end holds for good."""
    active = suppressions.filter(F.col("suppressed_until").isNull() | (F.col("suppressed_until") > as_of)).select(key).distinct()
    return items.join(active, key, "left_anti")


def digest_windows(runs: DataFrame, key: str, at: str) -> DataFrame:
    """(key, window_start, window_end): each run covers all since the run before it, so a missed run widens the next window and leaves no gap. The first run has no start."""
    w = Window.partitionBy(key).orderBy(at)
    return runs.select(key, at).distinct().select(key, F.lag(at).over(w).alias("window_start"), F.col(at).alias("window_end"))


def in_windows(changes: DataFrame, windows: DataFrame, key: str, at: str) -> DataFrame:
    """Changes with the window they fall in: the first run at or after them. A union sorted by key and time, not a range join."""
    runs = windows.select(key, F.col("window_end").alias("_at"), F.lit(1).alias("_run"), *[F.lit(None).cast(t).alias(c) for c, t in changes.dtypes if c not in (key,)])
    rows = changes.withColumn("_at", F.col(at)).withColumn("_run", F.lit(0)).unionByName(runs)
    w = Window.partitionBy(key).orderBy("_at", "_run").rowsBetween(0, Window.unboundedFollowing)
    out = rows.withColumn("window_end", F.first(F.when(F.col("_run") == 1, F.col("_at")), ignorenulls=True).over(w))
    return out.filter("_run = 0 and window_end is not null").drop("_at", "_run")


def field_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, prior_value, new_value, change_type): what differs between two states of a table, field by field, null-safe. Keys of one state only are ``created`` or ``removed``."""
    text = lambda df, tag: df.select(key, F.lit(True).alias(tag), *[F.col(f).cast("string").alias(f"{tag}_{f}") for f in fields])
    both = text(before, "b").join(text(after, "a"), key, "full_outer")
    kind = F.when(F.col("b").isNull(), "created").when(F.col("a").isNull(), "removed").otherwise("updated")
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"b_{f}").alias("prior_value"), F.col(f"a_{f}").alias("new_value")) for f in fields]))
    out = both.select(key, kind.alias("change_type"), parts.alias("p")).select(key, "p.*", "change_type")
    return out.filter(~F.col("prior_value").eqNullSafe(F.col("new_value")))


def with_priors(features: DataFrame, priors: DataFrame, entity: str, role: str) -> DataFrame:
    """(entity, prior): the sum of its role's weights of its features; a feature without a weight counts 0."""
    return features.join(priors, [role, "feature"], "left").groupBy(entity).agg(F.sum(F.coalesce("prior_weight", F.lit(0.0))).alias("prior"))


def click_rates(feedback: DataFrame, by: list[str]) -> DataFrame:
    """Impressions, actions and their rate by rank shown or other columns; what was never shown has no rate."""
    seen, acted = F.count_if(F.col("event_type") == "impression"), F.count_if(F.col("event_type").isin("open", "reply"))
    return feedback.groupBy(*by).agg(seen.alias("impressions"), acted.alias("actions")).withColumn("rate", F.round(F.try_divide("actions", "impressions"), 6))


def backfill_plan(messages: DataFrame, account: str, at: str, key: str, page: int) -> DataFrame:
    """(account, page_no, from, to, messages): pages of a backfill, newest first, each a checkpoint."""
    no = F.floor((F.row_number().over(Window.partitionBy(account).orderBy(F.col(at).desc(), key)) - 1) / page)
    return messages.withColumn("page_no", no).groupBy(account, "page_no").agg(F.max(at).alias("newest"), F.min(at).alias("oldest"), F.count("*").alias("messages"))


def dead_letters(failures: DataFrame, most_attempts: int) -> DataFrame:
    """(stage, entity_id, error_class, attempts, first_failed_at, last_failed_at): work that failed too often and isn't done."""
    per = failures.groupBy("stage", "entity_id").agg(
        F.count_if("failed").alias("attempts"), F.bool_or(~F.col("failed")).alias("done"), F.min(F.when(F.col("failed"), F.col("at"))).alias("first_failed_at"), F.max(F.when(F.col("failed"), F.col("at"))).alias("last_failed_at"),
        F.max_by("error_class", F.when(F.col("failed"), F.struct("at", "error_class"))).alias("error_class"),
    )
    return per.filter((F.col("attempts") >= most_attempts) & ~F.col("done")).drop("done")


def still_to_do(work: DataFrame, state: DataFrame, stage: str, version: str) -> DataFrame:
    """Work without a finished entry of this stage and version: what a restarted run goes on with."""
    done = state.filter((F.col("stage") == stage) & (F.col("stage_version") == version) & F.col("status").isin("done", "skipped")).select("entity_id").distinct()
    return work.join(done, "entity_id", "left_anti")


def evaluate(labels: DataFrame, results: DataFrame, slices: list[str]) -> DataFrame:
    """Per slice: matches, mismatches, misses and spurious results, with precision, recall and F1.

    ``labels`` has (entity_id, expected, *slices), ``results`` (entity_id,
    actual, *slices).
    """
    j = labels.alias("l").join(results.alias("r"), ["entity_id", *slices], "full_outer")
    outcome = F.when(F.col("actual").isNull(), "miss").when(F.col("expected").isNull(), "spurious").when(F.col("expected") == F.col("actual"), "match").otherwise("mismatch")
    g = j.withColumn("outcome", outcome).groupBy(*slices).agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("match", "matches"), ("mismatch", "mismatches"), ("miss", "misses"), ("spurious", "spurious"))])
    p = F.try_divide(F.col("matches"), F.col("matches") + F.col("mismatches") + F.col("spurious"))
    r = F.try_divide(F.col("matches"), F.col("matches") + F.col("mismatches") + F.col("misses"))
    return g.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(F.try_divide(2 * p * r, p + r), 6)})
