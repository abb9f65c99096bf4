"""Round trips through files, and checks of threads and replies over canonical messages, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillfold.operators import ledger
from quillfold.operators.threads import latest
from quillfold.plans.ledgerq import AS_OF, CHANGES, CLAIMS, ITEMS, _claims, _items
from quillfold.plans.shapeq import _C, _messages
from quillfold.plans.toolq import TABLES
from quillfold.session import load, shared_path
from quillfold.sources import export, mailbox


def corpus_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The corpus written as compressed JSON lines and read back by its schema: messages, people addressed and characters by mailbox."""
    path = shared_path(spark, "corpus")
    export.emit_corpus(_messages(spark, d), path)
    m = mailbox.read_mailboxes(spark, f"{path}/canonical")
    return m.groupBy("profile_id").agg(F.count("*").alias("messages"), F.sum(F.size("to")).alias("addressed"), F.sum(F.length(F.coalesce("body_text", F.lit("")))).alias("chars"), F.min("history_id").alias("first_history_id"), F.count("from.email").alias("senders"))


def batch_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Messages written as one JSON array for each mailbox and read back as batches: those that don't hold a hundred records are reported."""
    path = shared_path(spark, "batches")
    m = _messages(spark, d).withColumn("j", F.to_json(F.struct("id", "thread_id", "profile_id", "subject", "body_text", "folder")))
    arrays = m.groupBy("profile_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value"))
    arrays.write.partitionBy("profile_id").text(path)
    good, problems = mailbox.read_batches(spark, path, expected=100)
    files = problems.withColumn("profile_id", F.regexp_extract("file", "profile_id=([^/]+)/", 1)).select("profile_id", "rule", F.col("records").alias("reported"))
    return good.groupBy("profile_id").agg(F.count("*").alias("messages"), F.count_if(F.col("folder") == "SENT").alias("sent")).join(files, "profile_id", "left")


def exported_tables(spark: SparkSession, d: str) -> DataFrame:
    """All tables exported by mailbox, and what was written."""
    counts = export.export_tables({t: load(spark, d, t) for t in TABLES}, shared_path(spark, "export"))
    return spark.createDataFrame(sorted(counts.items()), "table_name string, rows long")


def thread_rules(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules of threads, counted."""
    return mailbox.thread_violations(_messages(spark, d)).groupBy("rule").agg(F.count("*").alias("threads"))


def reply_rules(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules of replies, counted; the chain of references is that of one step."""
    return mailbox.reply_violations(_messages(spark, d)).groupBy("rule").agg(F.count("*").alias("replies"))


def item_tags(spark: SparkSession, d: str) -> DataFrame:
    """Open items with what a list shows beside them: quiet for a week or more, overdue, unconfirmed."""
    as_of = F.lit(AS_OF).cast("timestamp")
    days = F.round((F.unix_micros(as_of) - F.unix_micros("last_at")) / F.lit(86_400_000_000.0))
    i = _items(spark, d).filter("status = 'OPEN'")
    return i.select("item_id", (days >= 7).alias("quiet"), F.coalesce(F.col("due") < as_of.cast("date"), F.lit(False)).alias("overdue"), (~F.col("owner_resolved")).alias("unconfirmed"))


def change_counts(spark: SparkSession, d: str) -> DataFrame:
    """Change rows by month and kind, without openings."""
    c = ledger.exact_changes(_claims(spark, d)).filter("change_type != 'opened'")
    return c.groupBy(F.date_format("changed_at", "yyyy-MM").alias("month"), "change_type").agg(F.count("*").alias("changes"))


def replay_order(spark: SparkSession, d: str) -> DataFrame:
    """The place of each claim in the replay of its mailbox: by the message's time, then id."""
    w = Window.partitionBy("user_id").orderBy("at", "id")
    return _claims(spark, d).select("id", "user_id", F.row_number().over(w).alias("place"))


def thread_facts(spark: SparkSession, d: str) -> DataFrame:
    """The current claim of each thread and attribute: by the message's time, then by when it was observed."""
    c = _claims(spark, d).filter("thread_id is not null").select("user_id", "thread_id", "attribute", "id", "title", "at", "observed_at")
    return latest(c, ["user_id", "thread_id", "attribute"], [F.col("at"), F.try_to_timestamp("observed_at"), F.col("id")]).select("user_id", "thread_id", "attribute", "id", "title")


def delegation_edges(spark: SparkSession, d: str) -> DataFrame:
    """Who asks whom: requests by requester and owner, with those that are still open."""
    i = _items(spark, d).filter("act = 'request' and owner_person_id is not null and requester_person_id is not null")
    return i.groupBy("user_id", "requester_person_id", "owner_person_id").agg(F.count("*").alias("requests"), F.count_if(F.col("status") == "OPEN").alias("open"))


_PLACED = _C + ", p AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY us, id) AS pos, count(*) OVER (PARTITION BY thread_id) AS len FROM m)"
_T = f"epoch_us(TIMESTAMPTZ '{AS_OF}+00')"
QUERIES = {
    "corpus_roundtrip": (
        corpus_roundtrip,
        _C + "SELECT user_id AS profile_id, count(*) AS messages, CAST(sum(n) AS BIGINT) AS addressed, CAST(sum(length(coalesce(body_text_full, ''))) AS BIGINT) AS chars, '1000007' AS first_history_id, count(f.e) AS senders FROM (SELECT m.*, coalesce(t.n, 0) AS n FROM m LEFT JOIN (SELECT email_id, count(*) AS n FROM email_participants WHERE part_role = 'to' GROUP BY 1) t ON t.email_id = m.id) GROUP BY 1",
    ),
    "batch_roundtrip": (batch_roundtrip, _C + "SELECT user_id AS profile_id, count(*) AS messages, count(*) FILTER (folder = 'SENT') AS sent, CASE WHEN count(*) <> 100 THEN 'record_count' END AS rule, CASE WHEN count(*) <> 100 THEN count(*) END AS reported FROM m GROUP BY 1"),
    "exported_tables": (exported_tables, " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in TABLES)),
    "thread_rules": (
        thread_rules,
        _PLACED + ", t AS (SELECT thread_id, count(DISTINCT user_id) AS u, min(CASE WHEN id = thread_id THEN pos END) AS root FROM p GROUP BY 1), v AS (SELECT unnest(list_filter([CASE WHEN u > 1 THEN 'several_profiles' END, CASE WHEN root IS NULL THEN 'no_root' END, CASE WHEN root <> 1 THEN 'root_not_first' END], lambda x: x IS NOT NULL)) AS rule FROM t) SELECT rule, count(*) AS threads FROM v GROUP BY 1",
    ),
    "reply_rules": (
        reply_rules,
        _PLACED + """, j AS (SELECT a.pos, a.us, a.in_reply_to, b.id AS bid, b.pos AS bp, b.us AS bus, b.in_reply_to AS br, b.rfc_message_id AS bm FROM p a LEFT JOIN p b ON b.thread_id = a.thread_id AND b.rfc_message_id = a.in_reply_to WHERE a.pos > 1),
v AS (SELECT unnest(list_filter([CASE WHEN bid IS NULL THEN 'parent_unknown' END, CASE WHEN bp >= pos THEN 'parent_later' END, CASE WHEN us <= bus THEN 'not_after_parent' END, CASE WHEN bid IS NOT NULL AND br IS NOT NULL THEN 'wrong_references' END], lambda x: x IS NOT NULL)) AS rule FROM j) SELECT rule, count(*) AS replies FROM v GROUP BY 1""",
    ),
    "item_tags": (item_tags, ITEMS + f"SELECT item_id, round(({_T} - last_at) / 86400000000.0) >= 7 AS quiet, coalesce(due < DATE '{AS_OF[:10]}', false) AS overdue, owner_id IS NULL AS unconfirmed FROM items WHERE status = 'OPEN'"),
    "change_counts": (change_counts, CHANGES + "SELECT strftime(make_timestamp(changed_at), '%Y-%m') AS month, change_type, count(*) AS changes FROM changes WHERE change_type <> 'opened' GROUP BY 1, 2"),
    "replay_order": (replay_order, CLAIMS + "SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS place FROM claims"),
    "thread_facts": (thread_facts, CLAIMS + "SELECT user_id, thread_id, attribute, id, title FROM (SELECT *, row_number() OVER (PARTITION BY user_id, thread_id, attribute ORDER BY ts DESC, epoch_us(CAST(observed_at AS TIMESTAMPTZ)) DESC, id DESC) AS n FROM claims WHERE thread_id IS NOT NULL) WHERE n = 1"),
    "delegation_edges": (delegation_edges, ITEMS + "SELECT user_id, requester_id AS requester_person_id, owner_id AS owner_person_id, count(*) AS requests, count(*) FILTER (status = 'OPEN') AS open FROM items WHERE act = 'request' AND owner_id IS NOT NULL AND requester_id IS NOT NULL GROUP BY 1, 2, 3"),
}
