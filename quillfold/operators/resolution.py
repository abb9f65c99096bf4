"""From the addresses of a mailbox to its people, identities and conflicts, and the scan for imitated domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfold.functions.identity import LOOKALIKE, domain_of, may_merge, registrable, with_relation
from quillfold.functions.jsonfns import hash16
from quillfold.operators.changefeed import instant
from quillfold.operators.lookalike import lookalikes


def observed_addresses(emails: DataFrame, participants: DataFrame) -> DataFrame:
    """(user_id, address, name, messages, first_at, last_at): each address of a mailbox with the first name it was seen with."""
    mail = emails.select(F.col("id").alias("email_id"), "user_id", instant(F.col("provider_ts")).alias("at"))
    named = F.when(F.trim("raw_name") != "", F.col("raw_name"))
    rows = participants.join(mail, "email_id").withColumn("address", F.lower(F.trim("raw_address"))).filter("address != ''")
    return rows.groupBy("user_id", "address").agg(
        F.min_by(named, F.when(named.isNotNull(), F.struct("at", "email_id", "part_role", "part_no"))).alias("name"), F.count("*").alias("messages"), F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )


def owner_addresses(users: DataFrame, accounts: DataFrame) -> DataFrame:
    """(user_id, address): the addresses that are the mailbox owner's own."""
    own = users.select(F.col("id").alias("user_id"), "address").unionByName(accounts.select("user_id", F.col("email_address").alias("address")))
    return own.select("user_id", F.lower(F.trim("address")).alias("address")).filter("address is not null").distinct()


def _severity(relation: Column) -> Column:
    out = F.lit(len(LOOKALIKE))
    for i, r in enumerate(LOOKALIKE):
        out = F.when(relation == r, i).otherwise(out)
    return out


def resolve(addresses: DataFrame, owners: DataFrame) -> DataFrame:
    """Adds person_id, is_self, method, confidence, and for split addresses the anchor and relation.

    The busiest address of a name (ties by the alphabet) is its anchor. Others
    of the name join its person, unless their domain looks like the anchor's:
    then they stay apart. The owner's addresses are one person and no anchors;
    an address without a name is a person of its own. Ids are hashes, so they
    are the same in each run.
    """
    own = owners.withColumn("is_self", F.lit(True))
    rows = addresses.join(own, ["user_id", "address"], "left").withColumn("is_self", F.coalesce("is_self", F.lit(False)))
    key = F.lower(F.trim("name"))
    rows = rows.withColumn("name_key", F.when(~F.col("is_self") & (key != ""), key))
    # The anchor of each name by an aggregation: a busy name never meets in one task.
    anchors = rows.filter("name_key is not null").groupBy("user_id", "name_key").agg(F.min_by(F.struct("address", "messages"), F.struct(-F.col("messages"), "address")).alias("a"))
    rows = rows.join(anchors.select("user_id", "name_key", F.col("a.address").alias("anchor"), F.col("a.messages").alias("anchor_messages")), ["user_id", "name_key"], "left")
    rows = with_relation(rows, domain_of(F.col("anchor")), domain_of(F.col("address")))
    method = F.when(F.col("is_self") | F.col("name_key").isNull() | (F.col("address") == F.col("anchor")), "exact").when(may_merge(F.col("relation")), "name_match").otherwise("lookalike_split")
    rows = rows.withColumn("method", method)
    who = F.when(F.col("is_self"), F.lit("self")).when(F.col("name_key").isNull() | (F.col("method") == "lookalike_split"), F.concat(F.lit("address|"), F.col("address"))).otherwise(F.concat(F.lit("name|"), F.col("name_key")))
    return rows.withColumns({"person_id": hash16(F.concat_ws("|", "user_id", who)), "confidence": F.when(F.col("method") == "name_match", 0.85).otherwise(1.0)})


def people(resolved: DataFrame) -> DataFrame:
    """(person_id, user_id, canonical_name, is_self, addresses, messages)."""
    return resolved.groupBy("person_id", "user_id").agg(F.min_by("name", F.struct(-F.col("messages"), "address")).alias("canonical_name"), F.bool_or("is_self").alias("is_self"), F.count("*").alias("addresses"), F.sum("messages").alias("messages"))


def name_conflicts(resolved: DataFrame) -> DataFrame:
    """(user_id, observed_name, address_a, address_b, relation, messages_a, messages_b): split addresses against their name's anchor."""
    return resolved.filter("method = 'lookalike_split'").select(
        "user_id", F.col("name").alias("observed_name"), F.col("anchor").alias("address_a"), F.col("address").alias("address_b"), "relation", F.col("anchor_messages").alias("messages_a"), F.col("messages").alias("messages_b")
    )


def domain_conflicts(addresses: DataFrame, owners: DataFrame, known: DataFrame, established: int = 3) -> DataFrame:
    """Conflicts of domains seen less than ``established`` times with established ones of the mailbox, in the same columns.

    The owner's domains are established. Candidates meet by equal, contained or
    near brands, never all pairs. Each domain has one conflict, with the
    strongest relation, then the busiest domain; addresses of ``known``
    conflicts are left out. A domain is shown by its first address.
    """
    at = addresses.filter("address like '%@%'").withColumn("domain", domain_of(F.col("address")))
    own = owners.select("user_id", domain_of(F.col("address")).alias("domain"), F.lit(True).alias("own")).distinct()
    domains = at.groupBy("user_id", "domain").agg(F.sum("messages").alias("n"), F.min_by("address", F.struct("first_at", "address")).alias("shown"), F.min_by("name", F.struct("first_at", "address")).alias("name"))
    domains = domains.join(own, ["user_id", "domain"], "left").withColumn("reg", registrable(F.col("domain"))).withColumn("old", (F.col("n") >= established) | F.coalesce("own", F.lit(False)))
    pairs = lookalikes(domains.select("user_id", "reg").distinct(), "user_id", "reg")
    new = domains.filter("not old").select("user_id", F.col("reg").alias("a"), F.col("domain").alias("da"), F.col("n").alias("na"), F.col("shown").alias("sa"), "name")
    old = domains.filter("old").select("user_id", F.col("reg").alias("b"), F.col("domain").alias("db"), F.col("n").alias("nb"), F.col("shown").alias("sb"))
    met = pairs.join(new, ["user_id", "a"]).join(old, ["user_id", "b"])
    best = met.groupBy("user_id", "da").agg(F.min_by(F.struct("name", "sb", "sa", "relation", "nb", "na"), F.struct(_severity(F.col("relation")), -F.col("nb"), "db")).alias("r")).select("user_id", "r.*")
    out = best.select("user_id", F.col("name").alias("observed_name"), F.col("sb").alias("address_a"), F.col("sa").alias("address_b"), "relation", F.col("nb").alias("messages_a"), F.col("na").alias("messages_b"))
    return out.join(known.select("user_id", "address_b").distinct(), ["user_id", "address_b"], "left_anti").select(out.columns)


def by_severity(conflicts: DataFrame) -> DataFrame:
    """Adds ``rank`` within the mailbox: the strongest relation first, then the busier imitated address."""
    w = Window.partitionBy("user_id").orderBy(_severity(F.col("relation")), F.col("messages_a").desc(), "address_b")
    return conflicts.withColumn("rank", F.row_number().over(w))
