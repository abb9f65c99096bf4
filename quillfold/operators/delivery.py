"""At-least-once deliveries: exactly one row of each message stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def message_key(c: Column) -> Column:
    """Provider ids agree without regard to case and outer blanks."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def kept_deliveries(emails: DataFrame) -> DataFrame:
    """One column ``id``: the row kept of each message.

    Hash aggregation by (account_id, provider_message_id) with ``min_by`` over
    (ingested_at, id): partial on the map side, so a message delivered a
    million times sends one row per task. A null ``ingested_at`` comes last. A
    row without account or provider id can't be a repetition and is kept.
    """
    rows = emails.select("id", "ingested_at", F.col("account_id").alias("account"), message_key(F.col("provider_message_id")).alias("message"))
    known = rows.filter("account is not null and message is not null")
    order = F.struct(F.col("ingested_at").isNull().alias("late"), F.col("ingested_at"), F.col("id"))
    kept = known.groupBy("account", "message").agg(F.min_by("id", order).alias("id")).select("id")
    return kept.unionByName(rows.filter("account is null or message is null").select("id"))


def surplus_deliveries(emails: DataFrame) -> DataFrame:
    """One column ``email_id``: every row but the kept ones.

    The anti join is on the row id, which is spread evenly however often one
    message was delivered.
    """
    return emails.select("id").join(kept_deliveries(emails), "id", "left_anti").select(F.col("id").alias("email_id"))


def unique_emails(emails: DataFrame) -> DataFrame:
    """The kept rows with all their columns."""
    return emails.join(kept_deliveries(emails), "id", "left_semi")
