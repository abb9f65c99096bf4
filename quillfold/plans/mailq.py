"""Threads, participants, identities, search and checks over the mailbox tables, each with its SQL twin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillfold.functions import identity as ident
from quillfold.functions import text
from quillfold.functions.jsonfns import canonical_json, hash16
from quillfold.operators.changefeed import instant
from quillfold.operators.delivery import unique_emails
from quillfold.operators.lookalike import lookalikes
from quillfold.operators.threads import rate_limited, thread_positions, thread_rollup
from quillfold.session import load

KEPT = """
WITH kept AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY account_id, lower(trim(provider_message_id, E' \\t\\n\\r')) ORDER BY ingested_at NULLS LAST, id) AS n FROM emails) WHERE n = 1),
m AS (SELECT *, epoch_us(CAST(provider_ts AS TIMESTAMPTZ)) AS us FROM kept)
"""


def _mails(spark: SparkSession, d: str) -> DataFrame:
    return unique_emails(load(spark, d, "emails")).withColumn("at", instant(F.col("provider_ts")))


def thread_position_latency(spark, d):
    return thread_positions(_mails(spark, d).select("id", "thread_id", "at"), ["thread_id"], "at", "id").select("id", "position", "latency_s")


def thread_rollup_upper_median(spark, d):
    return thread_rollup(_mails(spark, d).select("id", "thread_id", "at"), ["thread_id"], "at", "id").select("thread_id", "messages", F.unix_micros("first_at").alias("first_at"), F.unix_micros("last_at").alias("last_at"), "root", "median_gap_s")


def thread_count_check(spark, d):
    """Threads by the difference between their stored message count and their messages."""
    n = _mails(spark, d).groupBy("thread_id").agg(F.count("*").alias("found"))
    t = load(spark, d, "threads").select(F.col("id").alias("thread_id"), "message_count")
    return t.join(n, "thread_id", "left").groupBy((F.coalesce("found", F.lit(0)) - F.col("message_count")).alias("difference")).agg(F.count("*").alias("threads"))


def normalized_subjects(spark, d):
    return load(spark, d, "emails").select("id", text.normalize_subject(F.col("subject")).alias("subject_key"))


def split_novel_mails(spark, d):
    novel = text.split_novel(F.col("body_text_full"))
    return load(spark, d, "emails").select("id", F.length(novel).alias("novel_chars"), F.md5(novel).alias("novel_md5"))


def word_counts_by_folder(spark, d):
    return load(spark, d, "emails").groupBy("folder").agg(F.count("*").alias("mails"), F.sum(text.word_count(F.col("body_text_full"))).alias("words"), F.max(text.word_count(F.col("body_text_full"))).alias("most_words"))


def folder_pivot(spark, d):
    return load(spark, d, "emails").groupBy("user_id").pivot("folder", ["INBOX", "SENT", "ARCHIVE", "SPAM", "TRASH"]).agg(F.count("id")).na.fill(0)


def contains_question_rate(spark, d):
    q = text.contains_question(F.col("subject"), F.col("body_text_novel"))
    return load(spark, d, "emails").groupBy("direction").agg(F.count("*").alias("mails"), F.count_if(q).alias("asking"))


def participant_roles(spark, d):
    p = load(spark, d, "email_participants")
    return p.groupBy("email_id").agg(F.count_if(F.expr("part_role = 'to'")).alias("n_to"), F.count_if(F.expr("part_role = 'cc'")).alias("n_cc"), F.bool_or((F.col("part_role") == "to") & F.col("is_user")).alias("user_in_to"), F.bool_or((F.col("part_role") == "cc") & F.col("is_user")).alias("user_in_cc"))


def participant_blob(spark, d):
    """Names and addresses of a message as one text, by role and place; null names are left out."""
    p = load(spark, d, "email_participants")
    part = F.concat_ws(" ", "raw_name", "raw_address")
    return p.groupBy("email_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_role", "part_no", part.alias("x")))), lambda s: s["x"]), " ").alias("blob")).select("email_id", F.md5(F.lower("blob")).alias("blob_md5"))


def address_rollup(spark, d):
    p = load(spark, d, "email_participants").join(load(spark, d, "emails").select(F.col("id").alias("email_id"), "user_id", instant(F.col("provider_ts")).alias("at")), "email_id")
    a = F.lower(F.trim("raw_address"))
    named = F.when(F.trim("raw_name") != "", F.col("raw_name"))
    return p.groupBy("user_id", a.alias("address")).agg(F.count("*").alias("seen"), F.min_by(named, F.when(named.isNotNull(), F.struct("at", "email_id", "part_role", "part_no"))).alias("first_name"), F.unix_micros(F.min("at")).alias("first_at"), F.unix_micros(F.max("at")).alias("last_at"))


def registrable_rollup(spark, d):
    i = load(spark, d, "person_identities")
    return i.groupBy(ident.registrable(ident.domain_of(F.col("address"))).alias("domain")).agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("addresses"), F.sum("message_count").alias("messages"))


def domain_impersonation_scan(spark, d):
    """Domains with few messages that look like an established one of the same mailbox; strongest relation first, then the busier domain."""
    i = load(spark, d, "person_identities").groupBy("user_id", ident.registrable(ident.domain_of(F.col("address"))).alias("domain")).agg(F.sum("message_count").alias("n"), F.count("*").alias("people"))
    new = i.filter("people < 3").select("user_id", F.col("domain").alias("a"))
    old = i.filter("people >= 3").select("user_id", F.col("domain").alias("b"), "n")
    pairs = lookalikes(i, "user_id", "domain").join(new, ["user_id", "a"]).join(old, ["user_id", "b"]).select("user_id", F.col("a").alias("domain"), F.col("b").alias("like"), "n", "relation")
    severity = F.when(F.col("relation") == "embedded_brand", 0).when(F.col("relation") == "typosquat", 1).otherwise(2)
    best = pairs.groupBy("user_id", "domain").agg(F.min_by(F.struct("like", "relation"), F.struct(severity.alias("s"), (-F.col("n")).alias("n"), "like")).alias("r"))
    return best.select("user_id", "domain", F.col("r.like").alias("looks_like"), F.col("r.relation").alias("relation"))


def person_anchors(spark, d):
    """Addresses of one name merge with the name's busiest address unless their domains look alike."""
    i = load(spark, d, "person_identities").withColumn("name", F.lower(F.trim("observed_name"))).filter("name != '' and address is not null")
    w = Window.partitionBy("user_id", "name").orderBy(F.col("message_count").desc(), F.col("address"))
    a = i.withColumn("anchor", F.first("address").over(w))
    a = ident.with_relation(a.select("user_id", "address", "anchor"), ident.domain_of(F.col("anchor")), ident.domain_of(F.col("address")))
    return a.select("user_id", "address", "anchor", F.when(F.col("address") == F.col("anchor"), "anchor").when(ident.may_merge(F.col("relation")), "merged").otherwise("split").alias("outcome"))


def search_mail(spark, d, query: str = "the spare budget for Ravelin", limit: int = 15):
    """Per mailbox the newest mails with all terms, where none has all those with any."""
    terms = text.search_terms(query)
    blob = F.lower(F.concat_ws(" ", "subject", "body_text_novel"))
    m = _mails(spark, d).select("id", "user_id", "at", blob.alias("blob"))
    hits = [F.col("blob").contains(t) for t in terms]
    m = m.filter(reduce(lambda a, b: a | b, hits)).withColumn("tier", F.when(reduce(lambda a, b: a & b, hits), 0).otherwise(1))
    w = Window.partitionBy("user_id")
    m = m.withColumn("best", F.min("tier").over(w)).filter("tier = best")
    return m.withColumn("rank", F.row_number().over(w.orderBy(F.col("at").desc(), "id"))).filter(F.col("rank") <= limit).select("user_id", "id", "tier", "rank")


def mail_from_person(spark, d, needle: str = "oskar"):
    p = load(spark, d, "email_participants").filter(F.lower("raw_name").like(f"%{needle}%") | F.lower("raw_address").like(f"%{needle}%"))
    return p.join(_mails(spark, d).select(F.col("id").alias("email_id"), "user_id"), "email_id").groupBy("user_id").agg(F.count_distinct("email_id").alias("mails"), F.count_distinct(F.lower(F.trim("raw_address"))).alias("addresses"))


def mailbox_stats(spark, d):
    m = _mails(spark, d).groupBy("user_id").agg(F.count("*").alias("mails"), F.count_if(F.expr("direction = 'outbound'")).alias("sent"), F.count_if("is_unread").alias("unread"), F.count_distinct("thread_id").alias("threads"))
    e = load(spark, d, "evidence").groupBy("user_id").agg(F.count_distinct("id").alias("claims"))
    p = load(spark, d, "people").groupBy("user_id").agg(F.count("*").alias("people"))
    u = load(spark, d, "users").select(F.col("id").alias("user_id"))
    return u.join(m, "user_id", "left").join(e, "user_id", "left").join(p, "user_id", "left").na.fill(0)


def reply_reciprocity(spark, d):
    """Of each counterparty's messages: how many the owner answered later in the thread."""
    m = _mails(spark, d).select("user_id", "thread_id", "direction", "at", "id")
    w = Window.partitionBy("user_id", "thread_id").orderBy(F.col("at"), F.col("id")).rowsBetween(1, Window.unboundedFollowing)
    a = m.withColumn("answered", F.coalesce(F.bool_or(F.col("direction") == "outbound").over(w), F.lit(False)))
    return a.filter("direction = 'inbound'").groupBy("user_id").agg(F.count("*").alias("received"), F.count_if("answered").alias("answered"))


def parent_child_order(spark, d):
    """Replies whose parent is known, and those that come before it."""
    m = _mails(spark, d).select("user_id", "thread_id", "rfc_message_id", "in_reply_to", "at", "id")
    p = m.select("user_id", F.col("thread_id").alias("pt"), F.col("rfc_message_id").alias("in_reply_to"), F.col("at").alias("pat"))
    j = m.filter("in_reply_to is not null").join(p, ["user_id", "in_reply_to"])
    return j.groupBy("user_id").agg(F.count("*").alias("replies"), F.count_if(F.col("pat") > F.col("at")).alias("before_parent"), F.count_if(F.col("pt") != F.col("thread_id")).alias("other_thread"))


def orphan_checks(spark, d):
    e = load(spark, d, "emails").select(F.col("id").alias("k"))
    checks = [
        ("evidence_without_email", load(spark, d, "evidence").select(F.col("source_email_id").alias("k")).filter("k is not null").join(e, "k", "left_anti")),
        ("participant_without_email", load(spark, d, "email_participants").select(F.col("email_id").alias("k")).join(e, "k", "left_anti")),
        ("email_without_thread", load(spark, d, "emails").select(F.col("thread_id").alias("k")).filter("k is not null").join(load(spark, d, "threads").select(F.col("id").alias("k")), "k", "left_anti")),
        ("identity_without_person", load(spark, d, "person_identities").select(F.col("person_id").alias("k")).join(load(spark, d, "people").select(F.col("id").alias("k")), "k", "left_anti")),
    ]
    return reduce(DataFrame.unionByName, [x.agg(F.count("*").alias("orphans")).select(F.lit(n).alias("rule"), "orphans") for n, x in checks])


def self_person_check(spark, d):
    """People rows that are the owner's own, by mailbox; one each is right."""
    return load(spark, d, "people").groupBy("user_id").agg(F.count_if("is_self").alias("selves"), F.count("*").alias("people"))


def duplicate_ids(spark, d):
    t = load(spark, d, "documents").filter("text is not null and text != ''")
    return t.groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


def duplicate_messages(spark, d):
    return load(spark, d, "emails").groupBy("account_id", F.lower(F.regexp_replace("provider_message_id", r"^\s+|\s+$", "")).alias("message")).agg(F.count("*").alias("deliveries"), F.count_distinct("batch_id").alias("batches")).filter("deliveries > 1")


def tag_coverage(spark, d):
    """Categories that a mailbox has fewer than twenty mails of (the vocabulary is fixed, so the product is small)."""
    kinds = F.explode(F.array(*[F.lit(f"CATEGORY_{x}") for x in ("PERSONAL", "SOCIAL", "PROMOTIONS", "UPDATES", "FORUMS")])).alias("category")
    want = load(spark, d, "users").select(F.col("id").alias("user_id"), kinds)
    have = load(spark, d, "emails").groupBy("user_id", "category").agg(F.count("*").alias("n"))
    return want.join(have, ["user_id", "category"], "left").select("user_id", "category", F.coalesce("n", F.lit(0)).alias("n")).filter("n < 20")


def rate_limit_hourly(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", "ts")
    return rate_limited(e, "user_id", "ts", "hour", 2, "event_id").groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if("accepted").alias("accepted"))


def running_budget(spark, d, cap: float = 1_000_000.0):
    o = load(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = o.withColumn("spent", F.sum("o_totalprice").over(w)).filter(F.col("spent") <= cap)
    return s.groupBy("o_custkey").agg(F.count("*").alias("within"), F.round(F.max("spent"), 2).alias("spent"))


def resume_anti_join(spark, d):
    """Work that is still to do: orders without any line."""
    return load(spark, d, "orders").join(load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


def canonical_json_hash(spark, d):
    """Events as JSON objects with sorted keys and no blanks, and their hashes."""
    e = load(spark, d, "events").withColumn("text", canonical_json({"user_id": F.col("user_id"), "event_type": F.col("event_type"), "event_id": F.col("event_id"), "props": F.col("props")}))
    return e.select("event_id", "text", hash16(F.col("text")).alias("hash16"))


def urlsafe_ids(spark, d):
    return load(spark, d, "documents").filter("text is not null and text != ''").select("doc_id", text.urlsafe_b64(F.md5("text")).alias("b64"))


def recall_rollup(spark, d):
    """Share of mails with a claim, by mailbox and in all."""
    c = load(spark, d, "evidence").select(F.col("source_email_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    m = load(spark, d, "emails").select("id", "user_id").join(c, "id", "left")
    r = m.rollup("user_id").agg(F.count("*").alias("mails"), F.count_if(F.coalesce("hit", F.lit(False))).alias("hits"))
    return r.select(F.coalesce("user_id", F.lit("all")).alias("user_id"), "mails", "hits", F.round(F.try_divide("hits", "mails"), 6).alias("recall"))


def rank_spearman(spark, d):
    """Rank correlation of a mailbox's threads by messages and by claims."""
    t = load(spark, d, "threads").select(F.col("id").alias("thread_id"), "user_id", "message_count")
    c = load(spark, d, "evidence").groupBy("thread_id").agg(F.count_distinct("id").alias("claims"))
    j = t.join(c, "thread_id", "left").na.fill(0)
    r = j.select("user_id", F.rank().over(Window.partitionBy("user_id").orderBy("message_count")).alias("a"), F.rank().over(Window.partitionBy("user_id").orderBy("claims")).alias("b"))
    return r.groupBy("user_id").agg(F.count("*").alias("threads"), F.round(F.corr("a", "b"), 5).alias("rho"))


def title_jaccard(spark, d):
    """Pairs of neighbouring claims of a thread whose titles agree to 0.2."""
    from quillfold.operators.ledger import claims

    c = claims(load(spark, d, "evidence"), load(spark, d, "emails"), load(spark, d, "email_participants")).filter("thread_id is not null")
    w = Window.partitionBy("thread_id").orderBy("at", "id")
    n = c.select("id", F.lead("id").over(w).alias("next_id"), "words", F.lead("words").over(w).alias("next_words")).filter("next_id is not null")
    return n.withColumn("agree", F.round(text.jaccard(F.col("words"), F.col("next_words")), 6)).filter("agree >= 0.2").select("id", "next_id", "agree")


_REG = "CASE WHEN len(string_split({0}, '.')) < 2 THEN {0} ELSE array_to_string(string_split({0}, '.')[-2:], '.') END"
_DOM = "lower(trim(regexp_replace(address, '^.*@', '')))"
_RELATED = """CASE WHEN a.domain = b.domain THEN 'same'
  WHEN a.s <> b.s AND least(length(a.s), length(b.s)) >= 4 AND list_contains(regexp_split_to_array(CASE WHEN length(a.s) >= length(b.s) THEN a.s ELSE b.s END, '[-_.]+'), CASE WHEN length(a.s) >= length(b.s) THEN b.s ELSE a.s END) THEN 'embedded_brand'
  WHEN a.s <> b.s AND least(length(a.s), length(b.s)) >= 6 AND levenshtein(a.s, b.s) <= 2 THEN 'typosquat' WHEN a.s = b.s THEN 'sibling_tld' ELSE 'unrelated' END"""

QUERIES = {
    "thread_position_latency": (thread_position_latency, KEPT + "SELECT id, row_number() OVER w AS position, us // 1000000 - lag(us) OVER w // 1000000 AS latency_s FROM m WINDOW w AS (PARTITION BY thread_id ORDER BY us, id)"),
    "thread_rollup_upper_median": (thread_rollup_upper_median, KEPT + ", g AS (SELECT *, us // 1000000 - lag(us) OVER (PARTITION BY thread_id ORDER BY us, id) // 1000000 AS gap FROM m) SELECT thread_id, count(*) AS messages, min(us) AS first_at, max(us) AS last_at, arg_min(id, {'u': us, 'i': id}) AS root, list_sort(list(gap) FILTER (gap IS NOT NULL))[1 + (count(gap) // 2)] AS median_gap_s FROM g GROUP BY thread_id"),
    "thread_count_check": (thread_count_check, KEPT + "SELECT coalesce(n, 0) - t.message_count AS difference, count(*) AS threads FROM threads t LEFT JOIN (SELECT thread_id, count(*) AS n FROM m GROUP BY 1) c ON c.thread_id = t.id GROUP BY 1"),
    "normalized_subjects": (normalized_subjects, "SELECT id, lower(trim(regexp_replace(regexp_replace(coalesce(subject, ''), '(?i)^\\s*((re|fw|fwd|aw|sv)\\s*(\\[\\d+\\])?\\s*:\\s*)+', ''), '\\s+', ' ', 'g'))) AS subject_key FROM emails"),
    "split_novel_mails": (
        split_novel_mails,
        r"WITH h AS (SELECT id, regexp_split_to_array(coalesce(body_text_full, ''), '" + text.QUOTE_HEADER + r"')[1] AS t FROM emails), n AS (SELECT id, regexp_replace(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT starts_with(ltrim(x), '>')), chr(10)), '^\s+|\s+$', '', 'g') AS t FROM h) SELECT id, length(t) AS novel_chars, md5(t) AS novel_md5 FROM n",
    ),
    "word_counts_by_folder": (word_counts_by_folder, "SELECT folder, count(*) AS mails, CAST(sum(w) AS BIGINT) AS words, max(w) AS most_words FROM (SELECT folder, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS w FROM (SELECT folder, trim(regexp_replace(coalesce(body_text_full, ''), '\\s+', ' ', 'g')) AS t FROM emails)) GROUP BY folder"),
    "folder_pivot": (folder_pivot, "SELECT user_id, " + ", ".join(f"count(*) FILTER (folder = '{x}') AS \"{x}\"" for x in ("INBOX", "SENT", "ARCHIVE", "SPAM", "TRASH")) + " FROM emails GROUP BY user_id"),
    "contains_question_rate": (contains_question_rate, "SELECT direction, count(*) AS mails, count(*) FILTER (regexp_matches(concat_ws(chr(10), subject, body_text_novel), '" + text.ASKS + "')) AS asking FROM emails GROUP BY direction"),
    "participant_roles": (participant_roles, "SELECT email_id, count(*) FILTER (part_role = 'to') AS n_to, count(*) FILTER (part_role = 'cc') AS n_cc, bool_or(part_role = 'to' AND is_user) AS user_in_to, bool_or(part_role = 'cc' AND is_user) AS user_in_cc FROM email_participants GROUP BY email_id"),
    "participant_blob": (participant_blob, "SELECT email_id, md5(lower(string_agg(concat_ws(' ', raw_name, raw_address), ' ' ORDER BY part_role, part_no))) AS blob_md5 FROM email_participants GROUP BY email_id"),
    "address_rollup": (address_rollup, "SELECT user_id, lower(trim(raw_address)) AS address, count(*) AS seen, arg_min(raw_name, {'a': u, 'b': email_id, 'c': part_role, 'd': part_no}) FILTER (trim(raw_name) <> '') AS first_name, min(u) AS first_at, max(u) AS last_at FROM (SELECT p.*, e.user_id, epoch_us(CAST(e.provider_ts AS TIMESTAMPTZ)) AS u FROM email_participants p JOIN emails e ON e.id = p.email_id) GROUP BY 1, 2"),
    "registrable_rollup": (registrable_rollup, f"SELECT {_REG.format(_DOM)} AS domain, count(DISTINCT user_id) AS users, count(*) AS addresses, CAST(sum(message_count) AS BIGINT) AS messages FROM person_identities GROUP BY 1"),
    "domain_impersonation_scan": (domain_impersonation_scan, f"""
WITH i AS (SELECT user_id, {_REG.format(_DOM)} AS domain, sum(message_count) AS n, count(*) AS people FROM person_identities GROUP BY 1, 2), s AS (SELECT *, split_part(domain, '.', 1) AS s FROM i),
p AS (SELECT a.user_id, a.domain, b.domain AS l, b.n AS n, {_RELATED} AS relation FROM s a JOIN s b ON a.user_id = b.user_id WHERE a.people < 3 AND b.people >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, domain ORDER BY CASE relation WHEN 'embedded_brand' THEN 0 WHEN 'typosquat' THEN 1 ELSE 2 END, n DESC, l) AS k FROM p WHERE relation IN ('embedded_brand', 'typosquat', 'sibling_tld'))
SELECT user_id, domain, l AS looks_like, relation FROM r WHERE k = 1"""),
    "person_anchors": (person_anchors, f"""
WITH i AS (SELECT *, lower(trim(observed_name)) AS name FROM person_identities WHERE trim(observed_name) <> '' AND address IS NOT NULL),
w AS (SELECT user_id, address, first_value(address) OVER (PARTITION BY user_id, name ORDER BY message_count DESC, address) AS anchor FROM i),
x AS (SELECT *, {_REG.format(_DOM)} AS bd, {_REG.format(_DOM.replace('address', 'anchor'))} AS ad FROM w),
a AS (SELECT x.user_id, x.address, x.anchor, {{'domain': ad, 's': split_part(ad, '.', 1)}} AS a, {{'domain': bd, 's': split_part(bd, '.', 1)}} AS b FROM x)
SELECT user_id, address, anchor, CASE WHEN address = anchor THEN 'anchor' WHEN ({_RELATED}) NOT IN ('embedded_brand', 'typosquat', 'sibling_tld') THEN 'merged' ELSE 'split' END AS outcome FROM a"""),
    "search_mail": (search_mail, KEPT + """, b AS (SELECT id, user_id, us, lower(concat_ws(' ', subject, body_text_novel)) AS blob FROM m),
h AS (SELECT *, contains(blob, 'spare')::INT + contains(blob, 'budget')::INT + contains(blob, 'ravelin')::INT AS n FROM b), t AS (SELECT *, CASE WHEN n = 3 THEN 0 ELSE 1 END AS tier FROM h WHERE n > 0),
u AS (SELECT *, min(tier) OVER (PARTITION BY user_id) AS best FROM t)
SELECT user_id, id, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, id) AS rank FROM u WHERE tier = best) WHERE rank <= 15"""),
    "mail_from_person": (mail_from_person, KEPT + "SELECT user_id, count(DISTINCT email_id) AS mails, count(DISTINCT lower(trim(raw_address))) AS addresses FROM email_participants p JOIN m ON m.id = p.email_id WHERE lower(raw_name) LIKE '%oskar%' OR lower(raw_address) LIKE '%oskar%' GROUP BY user_id"),
    "mailbox_stats": (mailbox_stats, KEPT + """SELECT u.id AS user_id, coalesce(mails, 0) AS mails, coalesce(sent, 0) AS sent, coalesce(unread, 0) AS unread, coalesce(threads, 0) AS threads, coalesce(claims, 0) AS claims, coalesce(people, 0) AS people FROM users u
LEFT JOIN (SELECT user_id, count(*) AS mails, count(*) FILTER (direction = 'outbound') AS sent, count(*) FILTER (is_unread) AS unread, count(DISTINCT thread_id) AS threads FROM m GROUP BY 1) a ON a.user_id = u.id
LEFT JOIN (SELECT user_id, count(DISTINCT id) AS claims FROM evidence GROUP BY 1) e ON e.user_id = u.id LEFT JOIN (SELECT user_id, count(*) AS people FROM people GROUP BY 1) p ON p.user_id = u.id"""),
    "reply_reciprocity": (reply_reciprocity, KEPT + ", a AS (SELECT *, coalesce(bool_or(direction = 'outbound') OVER (PARTITION BY user_id, thread_id ORDER BY us, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS ok FROM m) SELECT user_id, count(*) AS received, count(*) FILTER (ok) AS answered FROM a WHERE direction = 'inbound' GROUP BY user_id"),
    "parent_child_order": (parent_child_order, KEPT + "SELECT c.user_id, count(*) AS replies, count(*) FILTER (p.us > c.us) AS before_parent, count(*) FILTER (p.thread_id <> c.thread_id) AS other_thread FROM m c JOIN m p ON p.user_id = c.user_id AND p.rfc_message_id = c.in_reply_to GROUP BY 1"),
    "orphan_checks": (orphan_checks, """SELECT 'evidence_without_email' AS rule, count(*) AS orphans FROM evidence WHERE source_email_id IS NOT NULL AND source_email_id NOT IN (SELECT id FROM emails)
UNION ALL SELECT 'participant_without_email', count(*) FROM email_participants WHERE email_id NOT IN (SELECT id FROM emails) UNION ALL SELECT 'email_without_thread', count(*) FROM emails WHERE thread_id IS NOT NULL AND thread_id NOT IN (SELECT id FROM threads)
UNION ALL SELECT 'identity_without_person', count(*) FROM person_identities WHERE person_id NOT IN (SELECT id FROM people)"""),
    "self_person_check": (self_person_check, "SELECT user_id, count(*) FILTER (is_self) AS selves, count(*) AS people FROM people GROUP BY 1"),
    "duplicate_ids": (duplicate_ids, "SELECT md5(text) AS text_md5, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY 1 HAVING count(*) > 1"),
    "duplicate_messages": (duplicate_messages, "SELECT account_id, lower(trim(provider_message_id, E' \\t\\n\\r')) AS message, count(*) AS deliveries, count(DISTINCT batch_id) AS batches FROM emails GROUP BY 1, 2 HAVING count(*) > 1"),
    "tag_coverage": (tag_coverage, "SELECT u.id AS user_id, c AS category, count(e.id) AS n FROM users u CROSS JOIN (SELECT unnest(['CATEGORY_PERSONAL','CATEGORY_SOCIAL','CATEGORY_PROMOTIONS','CATEGORY_UPDATES','CATEGORY_FORUMS']) AS c) LEFT JOIN emails e ON e.user_id = u.id AND e.category = c GROUP BY 1, 2 HAVING count(e.id) < 20"),
    "rate_limit_hourly": (rate_limit_hourly, "SELECT user_id, count(*) AS requests, count(*) FILTER (n <= 2) AS accepted FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events) GROUP BY user_id"),
    "running_budget": (running_budget, "SELECT o_custkey, count(*) AS within, round(max(s), 2) AS spent FROM (SELECT o_custkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS s FROM orders) WHERE s <= 1000000.0 GROUP BY 1"),
    "resume_anti_join": (resume_anti_join, "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "canonical_json_hash": (canonical_json_hash, "SELECT event_id, text, substr(sha256(text), 1, 16) AS hash16 FROM (SELECT event_id, CAST(json_object('event_id', event_id, 'event_type', event_type, 'props', props, 'user_id', user_id) AS VARCHAR) AS text FROM events)"),
    "urlsafe_ids": (urlsafe_ids, "SELECT doc_id, rtrim(replace(replace(base64(encode(md5(text))), '+', '-'), '/', '_'), '=') AS b64 FROM documents WHERE text IS NOT NULL AND text <> ''"),
    "recall_rollup": (recall_rollup, "SELECT coalesce(user_id, 'all') AS user_id, count(*) AS mails, count(*) FILTER (h) AS hits, round(count(*) FILTER (h) / count(*), 6) AS recall FROM (SELECT user_id, id IN (SELECT source_email_id FROM evidence WHERE source_email_id IS NOT NULL) AS h FROM emails) GROUP BY ROLLUP (user_id)"),
    "rank_spearman": (rank_spearman, "SELECT user_id, count(*) AS threads, round(corr(a, b), 5) AS rho FROM (SELECT t.user_id, rank() OVER (PARTITION BY t.user_id ORDER BY message_count) AS a, rank() OVER (PARTITION BY t.user_id ORDER BY coalesce(c, 0)) AS b FROM threads t LEFT JOIN (SELECT thread_id, count(DISTINCT id) AS c FROM evidence GROUP BY 1) e ON e.thread_id = t.id) GROUP BY user_id"),
}


def _title_sql() -> str:
    from quillfold.plans.ledgerq import CLAIMS

    return CLAIMS + """, n AS (SELECT id, lead(id) OVER w AS next_id, string_split(k, ' ') AS a, string_split(lead(k) OVER w, ' ') AS b, k, lead(k) OVER w AS nk FROM claims WHERE thread_id IS NOT NULL WINDOW w AS (PARTITION BY thread_id ORDER BY ts, id)),
j AS (SELECT *, CASE WHEN k = '' OR nk = '' THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS agree FROM n WHERE next_id IS NOT NULL) SELECT id, next_id, round(agree, 6) AS agree FROM j WHERE round(agree, 6) >= 0.2"""


QUERIES["title_jaccard"] = (title_jaccard, _title_sql())
