"""The lookup tools of a mailbox: threads, messages, people, schema; and the router that calls them by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillfold.functions.text import excerpt
from quillfold.operators.changefeed import instant
from quillfold.operators.delivery import unique_emails
from quillfold.session import load

#: The tables of a mailbox database.
TABLES = ("users", "accounts", "people", "person_identities", "threads", "emails", "email_participants", "evidence")


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return unique_emails(load(spark, d, "emails")).withColumn("at", instant(F.col("provider_ts")))


def _sender(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "email_participants").filter("part_role = 'from'")
    return p.groupBy(F.col("email_id").alias("id")).agg(F.min_by("raw_address", F.struct("part_no", "raw_address")).alias("sender"))


def read_thread(spark: SparkSession, d: str, thread_id: str | None = None) -> DataFrame:
    """The messages of a thread, oldest first, with their senders; without an id, of every thread."""
    m = _kept(spark, d)
    if thread_id is not None:
        m = m.filter(F.col("thread_id") == thread_id)
    place = F.row_number().over(Window.partitionBy("thread_id").orderBy("at", "id"))
    return m.join(_sender(spark, d), "id", "left").select("thread_id", place.alias("place"), F.col("id").alias("email_id"), F.col("provider_message_id").alias("message_id"), "subject", F.unix_micros("at").alias("sent_at"), "direction", "sender", F.md5(F.coalesce("body_text_novel", F.lit(""))).alias("body_md5"))


def message_card(spark: SparkSession, d: str, message_id: str | None = None) -> DataFrame:
    """A message with its thread's subject and its participants by role and place; without an id, every message."""
    m = _kept(spark, d)
    if message_id is not None:
        m = m.filter(F.col("provider_message_id") == message_id)
    t = load(spark, d, "threads").select(F.col("id").alias("thread_id"), "normalized_subject")
    who = F.concat_ws(" ", "part_role", F.coalesce("raw_name", F.lit("-")), "raw_address", F.col("is_user").cast("string"))
    p = load(spark, d, "email_participants").groupBy(F.col("email_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_role", "part_no", who.alias("w")))), lambda x: x["w"]), "; ").alias("participants"))
    return m.join(t, "thread_id", "left").join(p, "id", "left").select(F.col("id").alias("email_id"), F.col("provider_message_id").alias("message_id"), "subject", "normalized_subject", "folder", "is_unread", F.md5("participants").alias("participants_md5"))


def person_matches(spark: SparkSession, d: str, needle: str = "oskar", limit: int = 8, user_id: str | None = None) -> DataFrame:
    """People and addresses that contain the needle (two letters at least, in any case): of each mailbox the first ``limit`` by name and address."""
    n = (needle or "").strip().lower()
    p = load(spark, d, "people").select(F.col("id").alias("person_id"), "user_id", F.col("canonical_name").alias("name"))
    rows = p.join(load(spark, d, "person_identities").select("person_id", "address"), "person_id")
    rows = rows.filter(F.lit(len(n) >= 2) & (F.lower("name").contains(n) | F.lower("address").contains(n))).select("user_id", "name", "address").distinct()
    rows = rows if user_id is None else rows.filter(F.col("user_id") == user_id)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("name", "address"))).filter(F.col("rank") <= limit)


def person_messages(spark: SparkSession, d: str, needle: str = "oskar", limit: int = 15, user_id: str | None = None) -> DataFrame:
    """Messages that involve the person, newest first, at most ``limit`` a mailbox, with the role."""
    n = (needle or "").strip().lower()
    p = load(spark, d, "email_participants").filter(F.lit(len(n) >= 2) & (F.lower("raw_name").contains(n) | F.lower("raw_address").contains(n)))
    m = _kept(spark, d).select(F.col("id").alias("email_id"), "user_id", "subject", "thread_id", "direction", "at")
    m = m if user_id is None else m.filter(F.col("user_id") == user_id)
    w = Window.partitionBy("user_id").orderBy(F.col("at").desc(), "email_id", "part_role", "part_no")
    rows = p.join(m, "email_id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return rows.select("user_id", "rank", "email_id", "part_role", F.col("raw_address").alias("address"), "direction", F.unix_micros("at").alias("sent_at"))


def search_rows(spark: SparkSession, d: str) -> DataFrame:
    """What a search shows of a message: the slim columns and an excerpt."""
    return _kept(spark, d).join(_sender(spark, d), "id", "left").select("provider_message_id", "subject", F.unix_micros("at").alias("sent_at"), "direction", "sender", F.length(excerpt(F.col("body_text_novel"))).alias("excerpt_chars"), F.md5(excerpt(F.col("body_text_novel"))).alias("excerpt_md5"))


def table_schema(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, column_name, place) of the mailbox tables."""
    rows = [(t, c, i) for t in TABLES for i, c in enumerate(load(spark, d, t).columns, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, place int")


def table_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table: the status of the database."""
    counts = [load(spark, d, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("table_name"), "rows") for t in TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def stats_card(spark: SparkSession, d: str) -> DataFrame:
    """Six counts of each mailbox: mails, threads, people, claims, open items, conflicts."""
    from quillfold.plans.identityq import identity_conflicts
    from quillfold.plans.ledgerq import ledger_items

    parts = {
        "emails": load(spark, d, "emails"), "threads": load(spark, d, "threads"), "people": load(spark, d, "people"), "evidence": load(spark, d, "evidence").select("user_id", "id").distinct(),
        "open_items": ledger_items(spark, d).filter("status = 'OPEN'"), "conflicts": identity_conflicts(spark, d),
    }
    out = load(spark, d, "users").select(F.col("id").alias("user_id"))
    for name, df in parts.items():
        out = out.join(df.groupBy("user_id").agg(F.count("*").alias(name)), "user_id", "left")
    return out.na.fill(0, list(parts))


# --- router ---------------------------------------------------------------------


def tools() -> dict[str, tuple[Callable[..., DataFrame], str]]:
    """The tools by name, with what to try when one finds nothing: the six questions, the lookups, and ad-hoc SQL."""
    from quillfold.plans import identityq, ledgerq, mailq
    from quillfold.sources.mailbox import guarded_sql

    def run_sql(spark: SparkSession, d: str, statement: str) -> DataFrame:
        for t in TABLES:
            load(spark, d, t).createOrReplaceTempView(t)
        return guarded_sql(spark, statement)[0]

    asked = {q: ((lambda spark, d, q=q, **kw: ledgerq.ask(spark, d, q, **kw)), "nothing open of that kind; try search_mail") for q in ledgerq.QUESTIONS}
    return asked | {
        "search_mail": (mailq.search_mail, "try fewer words, or mail_from_person for a name"),
        "mail_from_person": (person_messages, "try a part of the name or the address"),
        "read_thread": (read_thread, "take the thread id from a search result"),
        "suspected_impersonation": (identityq.identity_conflicts, "no look-alike domains were seen"),
        "run_sql": (run_sql, "see get_schema for tables and columns"),
        "get_schema": (table_schema, ""),
    }


def call_tool(spark: SparkSession, d: str, name: str, trace: list[dict] | None = None, **args) -> tuple[DataFrame | None, str]:
    """(rows, hint): what the named tool finds, and a hint where that is nothing. An unknown tool or refused arguments give no rows and the reason. Each call is added to ``trace``."""
    known = tools()
    rows, hint = None, f"unknown tool {name}; there are {', '.join(known)}"
    if name in known:
        try:
            rows = known[name][0](spark, d, **args)
            hint = known[name][1] if rows.isEmpty() else ""
        except (TypeError, ValueError) as e:
            rows, hint = None, str(e)
    if trace is not None:
        trace.append({"tool": name, "args": args, "ok": rows is not None, "hint": hint})
    return rows, hint


_KEPT = r"""
WITH kept AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY account_id, lower(trim(provider_message_id, E' \t\n\r')) ORDER BY ingested_at NULLS LAST, id) AS n FROM emails) WHERE n = 1),
m AS (SELECT *, epoch_us(CAST(provider_ts AS TIMESTAMPTZ)) AS us FROM kept), s AS (SELECT email_id, arg_min(raw_address, {'n': part_no, 'a': raw_address}) AS sender FROM email_participants WHERE part_role = 'from' GROUP BY 1)
"""


def _stats_sql() -> str:
    from quillfold.plans.identityq import _CONFLICTS
    from quillfold.plans.ledgerq import ITEMS

    conflicts = _CONFLICTS.strip()[4:]
    head, tail = conflicts.rsplit("SELECT user_id, observed_name", 1)
    n = lambda t, w="": f"(SELECT count(*) FROM {t} x WHERE x.user_id = us.id{w})"
    return ITEMS + ", " + head.rstrip() + f", conf AS (SELECT user_id, observed_name{tail}) SELECT us.id AS user_id, {n('emails')} AS emails, {n('threads')} AS threads, {n('people')} AS people, (SELECT count(DISTINCT id) FROM evidence x WHERE x.user_id = us.id) AS evidence, {n('items', ' AND status = ' + chr(39) + 'OPEN' + chr(39))} AS open_items, {n('conf')} AS conflicts FROM users us"


QUERIES = {
    "read_thread": (read_thread, _KEPT + "SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY us, id) AS place, id AS email_id, provider_message_id AS message_id, subject, us AS sent_at, direction, sender, md5(coalesce(body_text_novel, '')) AS body_md5 FROM m LEFT JOIN s ON s.email_id = m.id"),
    "message_card": (
        message_card,
        _KEPT + ", p AS (SELECT email_id, string_agg(concat_ws(' ', part_role, coalesce(raw_name, '-'), raw_address, CAST(is_user AS VARCHAR)), '; ' ORDER BY part_role, part_no) AS w FROM email_participants GROUP BY 1) SELECT m.id AS email_id, provider_message_id AS message_id, subject, normalized_subject, folder, is_unread, md5(w) AS participants_md5 FROM m LEFT JOIN threads t ON t.id = m.thread_id LEFT JOIN p ON p.email_id = m.id",
    ),
    "person_matches": (
        person_matches,
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY name NULLS FIRST, address) AS rank FROM (SELECT DISTINCT p.user_id, p.canonical_name AS name, i.address FROM people p JOIN person_identities i ON i.person_id = p.id WHERE contains(lower(p.canonical_name), 'oskar') OR contains(lower(i.address), 'oskar'))) WHERE rank <= 8",
    ),
    "person_messages": (
        person_messages,
        _KEPT + "SELECT * FROM (SELECT m.user_id, row_number() OVER (PARTITION BY m.user_id ORDER BY us DESC, m.id, part_role, part_no) AS rank, m.id AS email_id, part_role, raw_address AS address, direction, us AS sent_at FROM email_participants p JOIN m ON m.id = p.email_id WHERE contains(lower(raw_name), 'oskar') OR contains(lower(raw_address), 'oskar')) WHERE rank <= 15",
    ),
    "search_rows": (search_rows, _KEPT + "SELECT provider_message_id, subject, us AS sent_at, direction, sender, length(substr(body_text_novel, 1, 260)) AS excerpt_chars, md5(substr(body_text_novel, 1, 260)) AS excerpt_md5 FROM m LEFT JOIN s ON s.email_id = m.id"),
    "table_schema": (table_schema, "SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS place FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")"),
    "table_counts": (table_counts, " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in TABLES)),
    "stats_card": (stats_card, _stats_sql()),
}
