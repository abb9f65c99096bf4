"""Reading canonical messages, flattening and checking them, and read-only SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillfold.functions.text import snippet_matches, split_novel
from quillfold.operators.threads import upper_median

PERSON = "struct<name:string,email:string>"
EVENT = (
    f"struct<uid:string,method:string,sequence:int,summary:string,description:string,location:string,conference_url:string,organizer:{PERSON},attendees:array<struct<email:string,name:string,role:string,partstat:string,rsvp:boolean>>,"
    "dtstart:timestamp_ntz,dtend:timestamp_ntz,timezone:string,all_day:boolean,rrule:string,status:string>"
)
#: What is only known of a message for evaluation.
META = "struct<email_class:string,tricky_tags:array<string>,is_actionable_for_user:boolean,action_owner:string,action_summary:string,due_date:string,commitment_made_by_user:string,commitment_is_conditional:boolean,commitment_condition:string,superseded_by_message_id:string,notes:string>"
#: Schema of a canonical message, one JSON object a line.
MESSAGE = (
    f"id string, thread_id string, profile_id string, history_id string, message_id_header string, in_reply_to string, references array<string>, thread_position int, thread_length int, `from` {PERSON}, sender {PERSON}, reply_to {PERSON}, to array<{PERSON}>, cc array<{PERSON}>, bcc array<{PERSON}>, delivered_to string, "
    "subject string, snippet string, body_text string, body_html string, date string, internal_date_ms long, folder string, category string, is_unread boolean, is_starred boolean, is_important boolean, user_labels array<string>, "
    "attachments array<struct<attachment_id:string,filename:string,mime_type:string,size_bytes:long,is_inline:boolean,content_id:string,extracted_text:string>>, "
    f"calendar_event {EVENT}, extra_headers map<string,string>, size_estimate long, meta {META}, _rejected string"
)
# The words that some fields may hold.
FOLDERS = ("INBOX", "SENT", "DRAFT", "SPAM", "TRASH", "ARCHIVE")
CATEGORIES = ("CATEGORY_PERSONAL", "CATEGORY_SOCIAL", "CATEGORY_PROMOTIONS", "CATEGORY_UPDATES", "CATEGORY_FORUMS")


def read_messages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(messages, rejects) of JSON lines; lines that don't fit the schema are rejects with their text. Blank lines are skipped."""
    rows = spark.read.schema(MESSAGE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_rejected").json(path)
    bad = F.col("_rejected").isNotNull() | F.col("id").isNull()
    return rows.filter(~bad).drop("_rejected"), rows.filter(bad).select(F.col("_rejected").alias("text"))


def read_batches(spark: SparkSession, path: str, expected: int = 50) -> tuple[DataFrame, DataFrame]:
    """(messages, problems) of files that each hold one JSON array of messages.

    ``problems`` has (file, rule, records): files that aren't readable JSON
    (``unreadable``) or hold another number of records than expected
    (``record_count``).
    """
    rows = spark.read.schema(MESSAGE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_rejected").json(path).withColumn("_file", F.input_file_name())
    good = F.col("_rejected").isNull() & F.col("id").isNotNull()
    per = rows.groupBy(F.col("_file").alias("file")).agg(F.count_if(good).alias("records"), F.count_if(~good).alias("bad"))
    rule = F.when(F.col("bad") > 0, "unreadable").when(F.col("records") != expected, "record_count")
    return rows.filter(good).drop("_rejected", "_file"), per.select("file", rule.alias("rule"), "records").filter("rule is not null")


def read_mailboxes(spark: SparkSession, path: str, profiles: list[str] | None = None, tag: str | None = None, tagged: bool = False) -> DataFrame:
    """Canonical messages of all or some profiles, on request only those with a tag, or with any."""
    m = read_messages(spark, path)[0]
    m = m if profiles is None else m.filter(F.col("profile_id").isin(*profiles))
    tags = F.coalesce("meta.tricky_tags", F.array().cast("array<string>"))
    m = m if tag is None else m.filter(F.array_contains(tags, tag))
    return m.filter(F.size(tags) > 0) if tagged else m


def flatten(messages: DataFrame, owners: DataFrame) -> DataFrame:
    """One relational row per message; ``owners`` has (profile_id, address). Outbound: sent, or from the owner."""
    m = messages.join(owners.select("profile_id", F.lower("address").alias("_owner")), "profile_id", "left")
    sender = F.lower("from.email")
    return m.select(
        "id", "profile_id", "thread_id", "message_id_header", "in_reply_to", "subject", "snippet", split_novel(F.col("body_text")).alias("body_text_novel"), F.col("body_text").alias("body_text_full"), F.length("body_text").alias("body_char_count"),
        F.when((F.col("folder") == "SENT") | (sender == F.col("_owner")), "outbound").otherwise("inbound").alias("direction"), F.col("date").alias("provider_ts"), "folder", "category", "is_unread", F.coalesce(F.size("attachments"), F.lit(0)).alias("n_attachments"), "extra_headers",
    )


def explode_roles(messages: DataFrame) -> DataFrame:
    """(email_id, part_role, part_no, address, name): single roles at 0, lists by place; blank addresses are left out."""
    one = [F.transform(F.array(F.col(f"`{r}`")), lambda p: F.struct(F.lit(r).alias("part_role"), F.lit(0).alias("part_no"), F.lower(p["email"]).alias("address"), p["name"].alias("name"))) for r in ("from", "sender", "reply_to")]
    many = [F.transform(F.coalesce(F.col(r), F.array()), lambda p, i: F.struct(F.lit(r).alias("part_role"), i.cast("int").alias("part_no"), F.lower(p["email"]).alias("address"), p["name"].alias("name"))) for r in ("to", "cc", "bcc")]
    return messages.select(F.col("id").alias("email_id"), F.explode(F.concat(*one, *many)).alias("p")).select("email_id", "p.*").filter("address is not null and trim(address) != ''")


def violations(messages: DataFrame) -> DataFrame:
    """(id, rule): broken rules of single messages."""
    c = F.col
    rules = {
        "root_has_parent": (c("thread_position") == 1) & c("in_reply_to").isNotNull(),
        "reply_without_parent": (c("thread_position") > 1) & c("in_reply_to").isNull(),
        "parent_not_referenced": c("in_reply_to").isNotNull() & ~F.array_contains(F.coalesce("references", F.array()), c("in_reply_to")),
        "position_beyond_length": c("thread_position") > c("thread_length"),
        "sent_with_category": c("folder").isin("SENT", "DRAFT") & c("category").isNotNull(),
        "sent_unread": c("folder").isin("SENT", "DRAFT") & c("is_unread"),
        "inbox_without_category": (c("folder") == "INBOX") & c("category").isNull(),
        "bad_id": ~c("id").rlike("^[0-9a-f]{16}$"),
        "bad_message_id": ~c("message_id_header").rlike("^<.+>$"),
        "unknown_folder": ~c("folder").isin(*FOLDERS),
        "unknown_category": ~c("category").isin(*CATEGORIES),
        "delivered_without_attachment": F.array_contains("meta.tricky_tags", "delivered_attachment") & (F.coalesce(F.size("attachments"), F.lit(0)) <= 0),
        "promised_with_attachment": F.array_contains("meta.tricky_tags", "promised_attachment") & (F.coalesce(F.size("attachments"), F.lit(0)) > 0),
        "newsletter_without_unsubscribe": F.array_contains("meta.tricky_tags", "newsletter_unsubscribe") & ~F.coalesce(F.map_contains_key("extra_headers", "List-Unsubscribe"), F.lit(False)),
        "absence_without_header": F.array_contains("meta.tricky_tags", "out_of_office") & (c("folder") != "SENT") & ~c("extra_headers")["Auto-Submitted"].eqNullSafe("auto-replied"),
        "condition_missing": c("meta.commitment_is_conditional") & (F.coalesce(c("meta.commitment_condition"), F.lit("")) == ""),
        "snippet_not_from_body": c("snippet").isNotNull() & ~snippet_matches(c("snippet"), c("body_text")),
        "clock_drift": F.abs(c("internal_date_ms") / 1000 - F.unix_timestamp(F.try_to_timestamp("date"))) > 120,
    }
    found = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]))
    return messages.select("id", F.explode(found).alias("rule"))


def thread_violations(messages: DataFrame) -> DataFrame:
    """(thread_id, rule): threads of several profiles, with unlike or wrong declared lengths, with gaps in their positions, without a root at position 1."""
    w = Window.partitionBy("thread_id").orderBy("thread_position", "id")
    placed = messages.withColumn("_place", F.row_number().over(w))
    per = placed.groupBy("thread_id").agg(
        F.count_distinct("profile_id").alias("profiles"), F.count_distinct("thread_length").alias("lengths"), F.max("thread_length").alias("length"), F.count("*").alias("n"), F.count_if(F.col("_place") != F.col("thread_position")).alias("gaps"),
        F.min(F.when(F.col("id") == F.col("thread_id"), F.col("thread_position"))).alias("root"),
    )
    c = F.col
    rules = {"several_profiles": c("profiles") > 1, "unlike_lengths": c("lengths") > 1, "wrong_length": (c("lengths") == 1) & (c("length") != c("n")), "position_gap": c("gaps") > 0, "no_root": c("root").isNull(), "root_not_first": c("root") != 1}
    return per.select("thread_id", F.explode(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]))).alias("rule"))


def reply_violations(messages: DataFrame) -> DataFrame:
    """(id, rule): replies whose parent isn't in the thread, comes later or isn't older, or whose references aren't the parent's and the parent's id."""
    p = messages.select(F.col("thread_id").alias("pt"), F.col("message_id_header").alias("pm"), F.col("thread_position").alias("pp"), F.try_to_timestamp("date").alias("pd"), F.coalesce("references", F.array().cast("array<string>")).alias("pr"))
    j = messages.filter("thread_position > 1").join(p, (F.col("thread_id") == F.col("pt")) & (F.col("in_reply_to") == F.col("pm")), "left")
    c = F.col
    rules = {
        "parent_unknown": c("pm").isNull(), "parent_later": c("pp") >= c("thread_position"), "not_after_parent": F.try_to_timestamp("date") <= c("pd"),
        "wrong_references": c("pm").isNotNull() & (F.coalesce("references", F.array().cast("array<string>")) != F.concat("pr", F.array("pm"))),
    }
    return j.select("id", F.explode(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]))).alias("rule"))


def corpus_statistics(messages: DataFrame, recent_from: str) -> DataFrame:
    """One row per profile: messages, threads, longest thread, counts by folder and tag as maps, attachments, actionable, share since ``recent_from``, upper median of words."""
    tally = lambda c: messages.select("profile_id", F.explode(c).alias("k")).groupBy("profile_id", "k").agg(F.count("*").alias("n")).groupBy("profile_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("m"))
    words = F.size(F.filter(F.split(F.coalesce("body_text", F.lit("")), r"\s+"), lambda x: x != ""))
    at = F.try_to_timestamp("date")
    per = messages.groupBy("profile_id").agg(
        F.count("*").alias("messages"), F.count_distinct("thread_id").alias("threads"), F.max("thread_length").alias("longest_thread"), F.count_if(F.coalesce(F.size("attachments"), F.lit(0)) > 0).alias("with_attachments"), F.count_if(F.col("calendar_event").isNotNull()).alias("with_event"), F.count_if("is_unread").alias("unread"),
        F.count_if(F.coalesce("meta.is_actionable_for_user", F.lit(False))).alias("actionable"), F.round(100 * F.count_if(at >= F.lit(recent_from).cast("timestamp")) / F.count("*"), 1).alias("recent_pct"), F.min(F.substring("date", 1, 10)).alias("first_day"), F.max(F.substring("date", 1, 10)).alias("last_day"),
        upper_median(words).alias("median_words"),
    )
    folders, tags = tally(F.array("folder")).withColumnRenamed("m", "folders"), tally(F.coalesce("meta.tricky_tags", F.array().cast("array<string>"))).withColumnRenamed("m", "tags")
    return per.join(folders, "profile_id", "left").join(tags, "profile_id", "left")


_READ = re.compile(r"\s*(select|with)\b", re.I)
#: Plan nodes that are no query: commands, and statements such as an insert.
_PLANS = "org.apache.spark.sql.catalyst.plans.logical"
_REFUSED = (f"{_PLANS}.Command", f"{_PLANS}.ParsedStatement")


def guarded_sql(spark: SparkSession, statement: str, rows: int = 50) -> tuple[DataFrame, Callable[[], int]]:
    """A read-only statement's first rows, and a function that counts all of them; anything else is refused.

    The statement is parsed, so quotes, comments and words inside texts don't
    matter: it must be one query, and no node of its plan may be a command.
    """
    s = re.sub(r"[;\s]+$", "", statement or "")
    if not _READ.match(s):
        raise ValueError("only a single SELECT or WITH is allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(s)
    except Exception as e:  # more than one statement doesn't parse either
        raise ValueError(f"only a single readable query is allowed: {str(e)[:200]}") from None
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        if any(is_instance_of(spark._sc._gateway, node, kind) for kind in _REFUSED):
            raise ValueError("only queries are allowed")
        below = node.children()
        nodes += [below.apply(i) for i in range(below.size())]
    df = spark.sql(s)
    return df.limit(rows), df.count


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite one table, compressed."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
