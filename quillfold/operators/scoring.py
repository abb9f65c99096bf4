"""Answers scored against gold items by the messages that attest both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def message_sets(evidence: DataFrame, anchors: DataFrame) -> DataFrame:
    """(work_item_id, message_id): the messages of an item's claims, and its first one."""
    return evidence.select("work_item_id", "message_id").unionByName(anchors.select("work_item_id", "message_id")).filter("work_item_id is not null and message_id is not null").distinct()


def hits(answers: DataFrame, item_messages: DataFrame, gold_messages: DataFrame) -> DataFrame:
    """(user_id, question, gold_id, work_item_id): for each gold item the first answer in rank order that shares a message with it."""
    mine = answers.select("user_id", "question", "work_item_id", "rank").join(item_messages, "work_item_id")
    met = gold_messages.join(mine, ["user_id", "question", "message_id"])
    return met.groupBy("user_id", "question", "gold_id").agg(F.min_by("work_item_id", F.struct("rank", "work_item_id")).alias("work_item_id"))


def ratio(a: Column, b: Column) -> Column:
    """a / b to six places; null where b is 0."""
    return F.round(F.try_divide(a, b), 6)


def score(answers: DataFrame, item_messages: DataFrame, gold: DataFrame, gold_messages: DataFrame) -> DataFrame:
    """Per mailbox and question: gold items, answers, covered, recall, precision, leaked.

    ``gold`` has (user_id, question, gold_id, tier). Recall counts the
    ``must_include`` items, precision the answers that cover one, leakage the
    ``must_not_include`` items that an answer hits. Ratios of nothing are null.
    """
    tier = gold.join(hits(answers, item_messages, gold_messages), ["user_id", "question", "gold_id"], "left")
    must, trap = F.col("tier") == "must_include", F.col("tier") == "must_not_include"
    g = tier.groupBy("user_id", "question").agg(
        F.count_if(must).alias("gold_items"), F.count_if(must & F.col("work_item_id").isNotNull()).alias("covered"), F.count_distinct(F.when(must, F.col("work_item_id"))).alias("matched"), F.count_if(trap & F.col("work_item_id").isNotNull()).alias("leaked")
    )
    n = answers.groupBy("user_id", "question").agg(F.count("*").alias("answers"))
    out = g.join(n, ["user_id", "question"], "left").withColumn("answers", F.coalesce("answers", F.lit(0)))
    return out.select("user_id", "question", "gold_items", "answers", "covered", "matched", "leaked", ratio(F.col("covered"), F.col("gold_items")).alias("recall"), ratio(F.col("matched"), F.col("answers")).alias("precision"))


def totals(scores: DataFrame) -> DataFrame:
    """Sums per question over all mailboxes, and of all questions (``all``), with their recall."""
    s = scores.rollup("question").agg(*[F.sum(c).alias(c) for c in ("gold_items", "answers", "covered", "leaked")])
    return s.select(F.coalesce("question", F.lit("all")).alias("question"), "gold_items", "answers", "covered", "leaked", ratio(F.col("covered"), F.col("gold_items")).alias("recall"))


def misses_by_tag(gold: DataFrame, found: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag, n, rank): tags of the must-include items that no answer covers, most common first."""
    lost = gold.filter("tier = 'must_include'").join(found, ["user_id", "question", "gold_id"], "left_anti").join(tags, "gold_id")
    n = lost.groupBy("tag").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "tag")))  # one row a tag


def recall_at(answers: DataFrame, item_messages: DataFrame, gold: DataFrame, gold_messages: DataFrame, depths: tuple[int, ...] = (1, 5, 10, 25)) -> DataFrame:
    """(question, k, covered, gold_items, recall): how recall grows with the number of answers looked at."""
    mine = answers.join(item_messages, "work_item_id")
    first = gold_messages.join(mine, ["user_id", "question", "message_id"]).groupBy("user_id", "question", "gold_id").agg(F.min("rank").alias("rank"))
    rows = gold.filter("tier = 'must_include'").join(first, ["user_id", "question", "gold_id"], "left").withColumn("k", F.explode(F.array(*[F.lit(k) for k in depths])))
    g = rows.groupBy("question", "k").agg(F.count_if(F.col("rank") <= F.col("k")).alias("covered"), F.count("*").alias("gold_items"))
    return g.withColumn("recall", ratio(F.col("covered"), F.col("gold_items")))
