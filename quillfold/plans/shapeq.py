"""Mails of the tables as canonical messages, in the shape of a mail API, and checks of the corpus, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillfold.functions import message
from quillfold.operators.changefeed import instant
from quillfold.operators.delivery import unique_emails
from quillfold.session import load
from quillfold.sources import mailbox


def canonical_messages(emails: DataFrame, participants: DataFrame) -> DataFrame:
    """Stored mails as canonical messages; what the tables don't keep (HTML, attachments, calendar, raw headers) is null.

    The place and length in the thread, and the chain of references, follow
    from time: each message refers to its parent.
    """
    person = lambda: F.struct(F.col("raw_name").alias("name"), F.lower(F.trim("raw_address")).alias("email"))
    one = lambda role: F.min_by(person(), F.when(F.col("part_role") == role, F.struct("part_no", "raw_address"))).alias(role)
    many = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("part_role") == role, F.struct("part_no", "raw_address", person().alias("p"))))), lambda x: x["p"]).alias(role)
    p = participants.groupBy(F.col("email_id").alias("id")).agg(one("from"), one("reply_to"), many("to"), many("cc"))
    w = Window.partitionBy("thread_id")
    at = instant(F.col("provider_ts"))
    rows = emails.withColumn("at", at).withColumns({"thread_position": F.row_number().over(w.orderBy("at", "id")), "thread_length": F.count("*").over(w).cast("int")}).join(p, "id", "left")
    none = {"sender": mailbox.PERSON, "bcc": f"array<{mailbox.PERSON}>", "delivered_to": "string", "body_html": "string", "history_id": "string", "attachments": "array<struct<attachment_id:string,filename:string,mime_type:string,size_bytes:bigint,is_inline:boolean,content_id:string,extracted_text:string>>", "calendar_event": mailbox.EVENT, "extra_headers": "map<string,string>", "size_estimate": "bigint", "meta": mailbox.META, "user_labels": "array<string>"}
    return rows.select(
        "id", "thread_id", F.col("user_id").alias("profile_id"), F.col("rfc_message_id").alias("message_id_header"), "in_reply_to", F.array_compact(F.array("in_reply_to")).alias("references"), "thread_position", "thread_length", "from", "reply_to", "to", "cc", "subject", "snippet", F.col("body_text_full").alias("body_text"),
        F.trim("provider_ts").alias("date"), F.unix_millis("at").alias("internal_date_ms"), "folder", "category", "is_unread", F.lit(False).alias("is_starred"), F.lit(False).alias("is_important"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()],
    )


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return canonical_messages(unique_emails(load(spark, d, "emails")), load(spark, d, "email_participants"))


def api_shape(spark: SparkSession, d: str) -> DataFrame:
    """Each message as the API shows it: labels, a hash of the header list, the parts, the size."""
    lines = F.array_join(F.transform("payload.headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    m = message.api_messages(_messages(spark, d))
    return m.select("id", F.array_join("labelIds", ",").alias("labels"), F.size("payload.headers").alias("headers"), F.md5(lines).alias("headers_md5"), F.col("payload.parts")[0]["mime_type"].alias("mime_type"), F.col("payload.parts")[0]["size"].alias("body_bytes"), F.col("sizeEstimate").alias("size_estimate"))


def api_thread_list(spark: SparkSession, d: str) -> DataFrame:
    """Threads with their messages in order and the largest history id after numbering."""
    t = message.api_threads(message.resequenced(_messages(spark, d)))
    return t.select("id", F.col("historyId").alias("history_id"), F.size("messages").alias("messages"), F.md5(F.array_join(F.transform("messages", lambda m: m["id"]), ",")).alias("order_md5"))


def history_ids(spark: SparkSession, d: str) -> DataFrame:
    """Messages numbered within their mailbox by time: a million plus seven for each place."""
    return message.resequenced(_messages(spark, d)).select("id", "history_id")


def role_rows(spark: SparkSession, d: str) -> DataFrame:
    """Canonical messages exploded into their roles again."""
    return mailbox.explode_roles(_messages(spark, d)).groupBy("part_role").agg(F.count("*").alias("rows"), F.count_distinct("address").alias("addresses"), F.sum("part_no").alias("places"))


def flat_messages(spark: SparkSession, d: str) -> DataFrame:
    """Canonical messages flattened into relational rows: direction and the characters of the text, by folder."""
    owners = load(spark, d, "users").select(F.col("id").alias("profile_id"), "address")
    return mailbox.flatten(_messages(spark, d), owners).groupBy("folder", "direction").agg(F.count("*").alias("mails"), F.sum("body_char_count").alias("chars"))


def record_violations(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules of single messages, counted."""
    return mailbox.violations(_messages(spark, d)).groupBy("rule").agg(F.count("*").alias("n"))


def corpus_report(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of each mailbox."""
    s = mailbox.corpus_statistics(_messages(spark, d), "2026-06-01")
    return s.select("profile_id", "messages", "threads", "longest_thread", "unread", "recent_pct", "first_day", "last_day", "median_words", F.col("folders")["INBOX"].alias("inbox"))


def window_and_drift(spark: SparkSession, d: str) -> DataFrame:
    """Per mailbox: messages outside 2026, taken in more than two days after they were sent, and the share since June."""
    e = load(spark, d, "emails").withColumn("at", instant(F.col("provider_ts")))
    inside = (F.col("at") >= F.lit("2026-01-01").cast("timestamp")) & (F.col("at") < F.lit("2027-01-01").cast("timestamp"))
    drift = F.abs(F.unix_timestamp("ingested_at") - F.unix_timestamp("at"))
    return e.groupBy("user_id").agg(F.count_if(~inside).alias("outside"), F.count_if(drift > 172_800).alias("late"), F.round(F.count_if(F.col("at") >= F.lit("2026-06-01").cast("timestamp")) / F.count("*"), 6).alias("recent_share"))


def sequence_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Participants whose place doesn't follow the one before in its role without a gap."""
    w = Window.partitionBy("email_id", "part_role").orderBy("part_no", "raw_address")
    p = load(spark, d, "email_participants").withColumn("want", F.row_number().over(w) - 1)
    return p.groupBy("part_role").agg(F.count("*").alias("rows"), F.count_if(F.col("part_no") != F.col("want")).alias("gaps"))


def thread_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Threads by the number of mailboxes and subjects (reply prefixes aside) in them."""
    from quillfold.functions.text import normalize_subject

    e = load(spark, d, "emails").groupBy("thread_id").agg(F.count_distinct("user_id").alias("mailboxes"), F.count_distinct(normalize_subject(F.col("subject"))).alias("subjects"))
    return e.groupBy("mailboxes", "subjects").agg(F.count("*").alias("threads"))


def enum_violations(spark: SparkSession, d: str) -> DataFrame:
    """Values outside their vocabulary, by column and value."""
    vocabulary = {"folder": mailbox.FOLDERS, "category": mailbox.CATEGORIES[:3], "direction": ("inbound", "outbound")}
    wide = load(spark, d, "emails").select(*[F.col(c).cast("string").alias(c) for c in vocabulary])
    long = wide.unpivot([], list(vocabulary), "field", "value").filter("value is not null")
    bad = F.lit(False)
    for c, words in vocabulary.items():
        bad = bad | ((F.col("field") == c) & ~F.col("value").isin(*words))
    return long.filter(bad).groupBy("field", "value").agg(F.count("*").alias("n"))


_C = r"""
WITH kept AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY account_id, lower(trim(provider_message_id, E' \t\n\r')) ORDER BY ingested_at NULLS LAST, id) AS n FROM emails) WHERE n = 1),
who AS (SELECT email_id, arg_min({'n': raw_name, 'e': lower(trim(raw_address))}, {'o': part_no, 'a': raw_address}) FILTER (part_role = 'from') AS f, arg_min({'n': raw_name, 'e': lower(trim(raw_address))}, {'o': part_no, 'a': raw_address}) FILTER (part_role = 'reply_to') AS r,
  string_agg(CASE WHEN raw_name IS NULL OR trim(raw_name) = '' THEN lower(trim(raw_address)) ELSE raw_name || ' <' || lower(trim(raw_address)) || '>' END, ', ' ORDER BY part_no, raw_address) FILTER (part_role = 'to') AS tos,
  string_agg(CASE WHEN raw_name IS NULL OR trim(raw_name) = '' THEN lower(trim(raw_address)) ELSE raw_name || ' <' || lower(trim(raw_address)) || '>' END, ', ' ORDER BY part_no, raw_address) FILTER (part_role = 'cc') AS ccs FROM email_participants GROUP BY 1),
m AS (SELECT k.*, trim(provider_ts) AS d, epoch_us(CAST(provider_ts AS TIMESTAMPTZ)) AS us, w.f, w.r, w.tos, w.ccs FROM kept k LEFT JOIN who w ON w.email_id = k.id),
s AS (SELECT *, strftime(CAST(replace(substr(d, 1, 19), 'T', ' ') AS TIMESTAMP), '%a, %d %b %Y %H:%M:%S ') || CASE WHEN regexp_extract(d, '(Z|[+-]\d{2}:?\d{2})$', 1) IN ('', 'Z') THEN '+0000' ELSE replace(regexp_extract(d, '(Z|[+-]\d{2}:?\d{2})$', 1), ':', '') END AS rfc,
  CASE WHEN f.e IS NOT NULL THEN CASE WHEN f.n IS NULL OR trim(f.n) = '' THEN f.e ELSE f.n || ' <' || f.e || '>' END END AS fr, CASE WHEN r.e IS NOT NULL THEN CASE WHEN r.n IS NULL OR trim(r.n) = '' THEN r.e ELSE r.n || ' <' || r.e || '>' END END AS rt FROM m),
h AS (SELECT *, list_filter(['MIME-Version: 1.0', 'Date: ' || rfc, 'Message-ID: ' || nullif(rfc_message_id, ''), 'In-Reply-To: ' || nullif(in_reply_to, ''), 'References: ' || nullif(in_reply_to, ''), 'Subject: ' || nullif(subject, ''), 'From: ' || fr, 'Reply-To: ' || rt, 'To: ' || nullif(tos, ''), 'Cc: ' || nullif(ccs, ''), 'Content-Type: text/plain; charset="UTF-8"'], lambda x: x IS NOT NULL) AS hs FROM s)
"""
QUERIES = {
    "api_shape": (
        api_shape,
        _C + "SELECT id, array_to_string(list_filter([CASE WHEN folder <> 'ARCHIVE' THEN folder END, CASE WHEN is_unread THEN 'UNREAD' END, category], lambda x: x IS NOT NULL), ',') AS labels, len(hs)::INTEGER AS headers, md5(array_to_string(hs, chr(10))) AS headers_md5, 'text/plain' AS mime_type, octet_length(encode(coalesce(body_text_full, ''))) AS body_bytes, octet_length(encode(coalesce(body_text_full, ''))) + CAST(list_sum(list_transform(hs, lambda x: length(x))) AS BIGINT) + 512 AS size_estimate FROM h",
    ),
    "api_thread_list": (
        api_thread_list,
        _C + ", n AS (SELECT id, thread_id, us, CAST(1000000 + 7 * row_number() OVER (PARTITION BY user_id ORDER BY us // 1000, id) AS VARCHAR) AS hid FROM m) SELECT thread_id AS id, max(hid) AS history_id, count(*)::INTEGER AS messages, md5(string_agg(id, ',' ORDER BY us, id)) AS order_md5 FROM n GROUP BY 1",
    ),
    "history_ids": (history_ids, _C + "SELECT id, CAST(1000000 + 7 * row_number() OVER (PARTITION BY user_id ORDER BY us // 1000, id) AS VARCHAR) AS history_id FROM m"),
    "role_rows": (
        role_rows,
        _C + """, e AS (SELECT CASE WHEN part_role IN ('to', 'cc') THEN part_role ELSE part_role END AS part_role, lower(trim(raw_address)) AS a, CASE WHEN part_role IN ('to', 'cc') THEN row_number() OVER (PARTITION BY email_id, part_role ORDER BY part_no, raw_address) - 1 ELSE 0 END AS place, row_number() OVER (PARTITION BY email_id, part_role ORDER BY part_no, raw_address) AS k FROM email_participants WHERE email_id IN (SELECT id FROM kept))
SELECT part_role, count(*) AS rows, count(DISTINCT a) AS addresses, CAST(sum(place) AS BIGINT) AS places FROM e WHERE (part_role IN ('to', 'cc') OR k = 1) AND trim(a) <> '' GROUP BY 1""",
    ),
    "flat_messages": (flat_messages, _C + "SELECT folder, CASE WHEN folder = 'SENT' OR f.e = lower(u.address) THEN 'outbound' ELSE 'inbound' END AS direction, count(*) AS mails, CAST(sum(length(body_text_full)) AS BIGINT) AS chars FROM m LEFT JOIN users u ON u.id = m.user_id GROUP BY 1, 2"),
    "record_violations": (
        record_violations,
        _C + r""", p AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY us, id) AS pos FROM m),
v AS (SELECT unnest(list_filter([CASE WHEN pos = 1 AND in_reply_to IS NOT NULL THEN 'root_has_parent' END, CASE WHEN pos > 1 AND in_reply_to IS NULL THEN 'reply_without_parent' END, CASE WHEN folder IN ('SENT', 'DRAFT') AND category IS NOT NULL THEN 'sent_with_category' END, CASE WHEN folder IN ('SENT', 'DRAFT') AND is_unread THEN 'sent_unread' END,
  CASE WHEN folder = 'INBOX' AND category IS NULL THEN 'inbox_without_category' END, CASE WHEN NOT regexp_matches(id, '^[0-9a-f]{16}$') THEN 'bad_id' END, CASE WHEN NOT regexp_matches(rfc_message_id, '^<.+>$') THEN 'bad_message_id' END, CASE WHEN folder NOT IN ('INBOX', 'SENT', 'DRAFT', 'SPAM', 'TRASH', 'ARCHIVE') THEN 'unknown_folder' END,
  CASE WHEN category NOT LIKE 'CATEGORY_%' THEN 'unknown_category' END, CASE WHEN snippet IS NOT NULL AND NOT (snippet = '' OR contains(substr(trim(regexp_replace(coalesce(body_text_full, ''), '\s+', ' ', 'g')), 1, 80), trim(substr(snippet, 1, 20)))) THEN 'snippet_not_from_body' END], lambda x: x IS NOT NULL)) AS rule FROM p)
SELECT rule, count(*) AS n FROM v GROUP BY 1""",
    ),
    "corpus_report": (
        corpus_report,
        _C + r""", w AS (SELECT *, len(list_filter(regexp_split_to_array(coalesce(body_text_full, ''), '\s+'), lambda x: x <> '')) AS words, count(*) OVER (PARTITION BY thread_id) AS tl FROM m)
SELECT user_id AS profile_id, count(*) AS messages, count(DISTINCT thread_id) AS threads, max(tl)::INTEGER AS longest_thread, count(*) FILTER (is_unread) AS unread, round(100.0 * count(*) FILTER (us >= epoch_us(TIMESTAMPTZ '2026-06-01 00:00:00+00')) / count(*), 1) AS recent_pct, min(substr(d, 1, 10)) AS first_day, max(substr(d, 1, 10)) AS last_day,
  list_sort(list(words))[1 + count(*) // 2] AS median_words, count(*) FILTER (folder = 'INBOX') AS inbox FROM w GROUP BY 1""",
    ),
    "window_and_drift": (
        window_and_drift,
        "SELECT user_id, count(*) FILTER (NOT (us >= epoch_us(TIMESTAMPTZ '2026-01-01 00:00:00+00') AND us < epoch_us(TIMESTAMPTZ '2027-01-01 00:00:00+00'))) AS outside, count(*) FILTER (abs(epoch_us(ingested_at) // 1000000 - us // 1000000) > 172800) AS late, round(count(*) FILTER (us >= epoch_us(TIMESTAMPTZ '2026-06-01 00:00:00+00')) / count(*), 6) AS recent_share FROM (SELECT *, epoch_us(CAST(provider_ts AS TIMESTAMPTZ)) AS us FROM emails) GROUP BY 1",
    ),
    "sequence_gaps": (sequence_gaps, "SELECT part_role, count(*) AS rows, count(*) FILTER (part_no <> want) AS gaps FROM (SELECT *, row_number() OVER (PARTITION BY email_id, part_role ORDER BY part_no, raw_address) - 1 AS want FROM email_participants) GROUP BY 1"),
    "thread_consistency": (thread_consistency, r"SELECT mailboxes, subjects, count(*) AS threads FROM (SELECT thread_id, count(DISTINCT user_id) AS mailboxes, count(DISTINCT lower(trim(regexp_replace(regexp_replace(coalesce(subject, ''), '(?i)^\s*((re|fw|fwd|aw|sv)\s*(\[\d+\])?\s*:\s*)+', ''), '\s+', ' ', 'g')))) AS subjects FROM emails GROUP BY 1) GROUP BY 1, 2"),
    "enum_violations": (enum_violations, "SELECT 'category' AS field, category AS value, count(*) AS n FROM emails WHERE category NOT IN ('CATEGORY_PERSONAL', 'CATEGORY_SOCIAL', 'CATEGORY_PROMOTIONS') GROUP BY 2 UNION ALL SELECT 'folder', folder, count(*) FROM emails WHERE folder NOT IN ('INBOX', 'SENT', 'DRAFT', 'SPAM', 'TRASH', 'ARCHIVE') GROUP BY 2 UNION ALL SELECT 'direction', direction, count(*) FROM emails WHERE direction NOT IN ('inbound', 'outbound') GROUP BY 2"),
}
