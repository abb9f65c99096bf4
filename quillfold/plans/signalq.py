"""Signals of messages, the noise gate and what it lets through, each with its SQL twin.

The test tables have no raw headers. Every query here therefore derives the same
header map from the message (:func:`with_headers`): a stand-in for the map that
canonical messages carry, so that each rule of the chain has rows to decide on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.functions import signals, text
from quillfold.functions.timefns import local_date, with_mentions
from quillfold.operators.changefeed import instant
from quillfold.operators.delivery import unique_emails
from quillfold.session import load

#: Stand-in headers: name, value, SQL condition on the message.
HEADERS = (
    ("List-ID", "<list.example>", "category = 'CATEGORY_FORUMS'"),
    ("List-Unsubscribe", "<mailto:out@list.example>", "category = 'CATEGORY_PROMOTIONS' AND body_char_count % 3 = 0"),
    ("Precedence", "Bulk", "body_char_count % 7 = 0"),
    ("Auto-Submitted", "auto-replied", "direction = 'inbound' AND body_char_count % 11 = 0"),
    ("Feedback-ID", "x", "direction = 'inbound' AND body_char_count % 13 = 0"),
    ("X-Campaign-ID", "c", "category = 'CATEGORY_PROMOTIONS' AND body_char_count % 5 = 0"),
)


def with_headers(emails: DataFrame, participants: DataFrame) -> DataFrame:
    """Messages with ``headers`` and ``sender`` (the address in the from role)."""
    entries = F.array_compact(F.array(*[F.when(F.expr(cond), F.struct(F.lit(n).alias("key"), F.lit(v).alias("value"))) for n, v, cond in HEADERS]))
    sender = participants.filter("part_role = 'from'").groupBy(F.col("email_id").alias("id")).agg(F.min_by(F.lower(F.trim("raw_address")), F.struct("part_no", "raw_address")).alias("sender"))
    return emails.withColumn("headers", F.map_from_entries(entries)).join(sender, "id", "left")


def email_signals(emails: DataFrame, participants: DataFrame) -> DataFrame:
    """One row per message: automation and noise with their reasons, the owner's role, recipients, place and latency in the thread, novel characters, asking."""
    from quillfold.operators.threads import thread_positions

    reason = signals.automation(F.col("headers"), F.col("sender"))
    m = with_headers(emails, participants).withColumn("automation_reason", reason)
    m = m.withColumn("noise_reason", signals.noise(F.col("headers"), F.col("category"), F.col("automation_reason").isNotNull(), F.col("subject")))
    p = participants.groupBy(F.col("email_id").alias("id")).agg(
        F.bool_or((F.col("part_role") == "to") & F.col("is_user")).alias("user_in_to"), F.bool_or((F.col("part_role") == "cc") & F.col("is_user")).alias("user_in_cc"), F.count_if(F.col("part_role").isin("to", "cc", "bcc")).alias("recipient_count")
    )
    placed = thread_positions(emails.select("id", "thread_id", instant(F.col("provider_ts")).alias("at")), ["thread_id"], "at", "id").select("id", F.col("position").alias("thread_position"), F.col("latency_s").alias("reply_latency_sec"))
    return (
        m.join(p, "id", "left").join(placed, "id", "left")
        .select(
            "id", "user_id", "automation_reason", "noise_reason", F.coalesce("user_in_to", F.lit(False)).alias("user_in_to"), F.coalesce("user_in_cc", F.lit(False)).alias("user_in_cc"), (F.col("direction") == "outbound").alias("user_is_sender"), F.coalesce("recipient_count", F.lit(0)).alias("recipient_count"),
            "thread_position", "reply_latency_sec", F.length(F.coalesce("body_text_novel", F.lit(""))).alias("novel_char_count"), text.contains_question(F.col("subject"), F.col("body_text_novel")).alias("contains_question"),
        )
    )


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return unique_emails(load(spark, d, "emails"))


def classifier_chain_flags(spark: SparkSession, d: str) -> DataFrame:
    return email_signals(_kept(spark, d), load(spark, d, "email_participants"))


def automation_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Messages by mechanism and by what the gate says of them."""
    s = classifier_chain_flags(spark, d)
    return s.groupBy(F.coalesce("automation_reason", F.lit("none")).alias("automation"), F.coalesce("noise_reason", F.lit("none")).alias("noise")).agg(F.count("*").alias("mails"))


def gate_variants_study(spark: SparkSession, d: str) -> DataFrame:
    """For each candidate gate: messages it drops, those among them that a verified claim comes from, and what is left to extract."""
    from quillfold.operators import ledger

    gold = ledger.gate(load(spark, d, "evidence"), load(spark, d, "emails")).filter("reason is null").select(F.col("source_email_id").alias("id")).distinct().withColumn("gold", F.lit(True))
    m = with_headers(_kept(spark, d), load(spark, d, "email_participants")).withColumn("auto", signals.automation(F.col("headers"), F.col("sender")).isNotNull()).join(gold, "id", "left")
    rules = signals.gate_variants(F.col("headers"), F.col("category"), F.col("auto"), F.col("subject"))
    wide = m.select(F.coalesce("gold", F.lit(False)).alias("gold"), *[r.alias(k) for k, r in rules.items()])
    return wide.unpivot(["gold"], list(rules), "rule", "drops").groupBy("rule").agg(F.count_if("drops").alias("gated"), F.count_if(F.col("drops") & F.col("gold")).alias("gold_lost"), F.count_if(~F.col("drops")).alias("to_extract"))


def extraction_queue(spark: SparkSession, d: str) -> DataFrame:
    """Messages to extract: past the gate and without any claim yet, with thread, owner and account, in the order of the work."""
    s = classifier_chain_flags(spark, d).filter("noise_reason is null").select("id", "thread_position")
    done = load(spark, d, "evidence").select(F.col("source_email_id").alias("id")).filter("id is not null")
    m = _kept(spark, d).join(s, "id").join(done, "id", "left_anti").withColumn("at", instant(F.col("provider_ts")))
    t = load(spark, d, "threads").select(F.col("id").alias("thread_id"), F.col("message_count").alias("thread_messages"))
    u = load(spark, d, "users").select(F.col("id").alias("user_id"), F.col("address").alias("owner_address"))
    a = load(spark, d, "accounts").select(F.col("id").alias("account_id"), "provider")
    out = m.join(t, "thread_id").join(u, "user_id").join(a, "account_id")
    return out.select("id", "user_id", "thread_position", "thread_messages", "owner_address", "provider", F.unix_micros("at").alias("at"))


def prompt_projection(spark: SparkSession, d: str) -> DataFrame:
    """What an extractor reads of a message: people with the owner marked, new text up to 8000 characters, the quoted rest up to 4000, as a hash."""
    who = F.concat(F.rpad("part_role", 9, " "), F.lit(" "), F.coalesce("raw_name", F.lit("(no name)")), F.lit(" <"), F.coalesce("raw_address", F.lit("")), F.lit(">"), F.when(F.col("is_user"), "   [MAILBOX OWNER]").otherwise(""))
    p = load(spark, d, "email_participants").groupBy(F.col("email_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_role", "part_no", who.alias("w")))), lambda x: x["w"]), "\n").alias("people"))
    novel, full = F.coalesce("body_text_novel", F.lit("")), F.coalesce("body_text_full", F.lit(""))
    rest = F.when(F.length(full) > F.length(novel), F.substring(full, F.length(novel) + 1, F.lit(4000))).otherwise("")
    prompt = F.concat_ws("\n--\n", F.coalesce("people", F.lit("")), F.coalesce("subject", F.lit("")), F.substring(novel, 1, 8000), rest)
    return _kept(spark, d).join(p, "id", "left").select("id", F.length(prompt).alias("chars"), F.md5(prompt).alias("prompt_md5"))


def date_mention_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Dates mentioned in new text, by kind; the Arrow stage of the offsets."""
    e = load(spark, d, "emails").select("id", "body_text_novel", local_date(F.col("provider_ts")).alias("day"))
    m = with_mentions(e, "body_text_novel", "day").select("id", F.explode("mentions").alias("m"))
    return m.groupBy(F.col("m.kind").alias("kind")).agg(F.count("*").alias("n"), F.count("m.resolved").alias("resolved"))


def quote_highlight(spark: SparkSession, d: str) -> DataFrame:
    """Verified quotes cut out of their mail's new text: the lengths before and after, and what was cut."""
    from quillfold.operators import ledger

    e = ledger.first_deliveries(load(spark, d, "evidence")).select("id", "source_email_id", "evidence_quote")
    m = load(spark, d, "emails").select(F.col("id").alias("source_email_id"), "body_text_novel")
    h: Column = text.highlight(F.col("body_text_novel"), F.trim("evidence_quote"))
    j = e.join(m, "source_email_id").filter("body_text_novel is not null and trim(evidence_quote) != ''").select("id", h.alias("h"))
    return j.select("id", F.length("h.before").alias("before"), F.md5("h.hit").alias("hit_md5"), F.length("h.after").alias("after"))


def snippet_check(spark: SparkSession, d: str) -> DataFrame:
    """Messages whose snippet isn't drawn from the body, by mailbox, and the longest excerpt shown."""
    m = load(spark, d, "emails").filter("snippet is not null")
    ok = text.snippet_matches(F.col("snippet"), F.col("body_text_full"))
    return m.groupBy("user_id").agg(F.count("*").alias("snippets"), F.count_if(~ok).alias("strange"), F.max(F.length(text.excerpt(F.col("body_text_full")))).alias("longest_excerpt"))


def claim_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What native patterns find to extract in new text."""
    from quillfold.operators.extract import claim_candidates as candidates

    return candidates(_kept(spark, d)).groupBy("email_id", "attribute").agg(F.count("*").alias("n"), F.min("summary").alias("first_summary"))


def attribute_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary of claims with its use: attributes of the registry without any claim show 0."""
    from quillfold.operators import ledger
    from quillfold.operators.changefeed import clean_key

    words = spark.createDataFrame(sorted(ledger.VOCABULARY.items()), "attribute string, act string")
    used = load(spark, d, "evidence").groupBy(clean_key(F.col("attribute")).alias("attribute")).agg(F.count_distinct("id").alias("claims"))
    return words.join(used, "attribute", "left").select("attribute", "act", F.coalesce("claims", F.lit(0)).alias("claims"))


# --- SQL twins ------------------------------------------------------------------

_H = {n: f"coalesce({c}, false)" for n, _, c in HEADERS}
_AUTO = (
    f"CASE WHEN {_H['Auto-Submitted']} THEN 'auto_submitted' WHEN {_H['List-Unsubscribe']} THEN 'list_unsubscribe' WHEN {_H['Precedence']} THEN 'precedence_bulk' WHEN {_H['Feedback-ID']} THEN 'esp_return_path' "
    rf"WHEN regexp_matches(split_part(coalesce(sender, ''), '@', 1), '{signals.NO_REPLY}') THEN 'noreply_local' END"
)
_STATE = "regexp_matches(coalesce(subject, ''), '" + text.TRANSACTIONAL + "')"
_KEPT = r"""
WITH kept AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY account_id, lower(trim(provider_message_id, E' \t\n\r')) ORDER BY ingested_at NULLS LAST, id) AS n FROM emails) WHERE n = 1),
senders AS (SELECT email_id, arg_min(lower(trim(raw_address)), {'n': part_no, 'a': raw_address}) AS sender FROM email_participants WHERE part_role = 'from' GROUP BY 1)
"""
_SIGNALS = (
    _KEPT
    + f""",
a AS (SELECT k.*, {_AUTO} AS automation_reason FROM kept k LEFT JOIN senders s ON s.email_id = k.id),
n AS (SELECT *, CASE WHEN {_STATE} THEN NULL WHEN {_H['List-ID']} THEN 'list_archive' WHEN category = 'CATEGORY_PROMOTIONS' AND automation_reason IS NOT NULL THEN 'promotion' WHEN category = 'CATEGORY_SOCIAL' AND automation_reason IS NOT NULL THEN 'advert' END AS noise_reason,
  epoch_us(CAST(provider_ts AS TIMESTAMPTZ)) AS us FROM a),
p AS (SELECT email_id, bool_or(part_role = 'to' AND is_user) AS user_in_to, bool_or(part_role = 'cc' AND is_user) AS user_in_cc, count(*) FILTER (part_role IN ('to', 'cc', 'bcc')) AS recipient_count FROM email_participants GROUP BY 1),
flags AS (SELECT n.id, n.user_id, automation_reason, noise_reason, coalesce(user_in_to, false) AS user_in_to, coalesce(user_in_cc, false) AS user_in_cc, direction = 'outbound' AS user_is_sender, coalesce(recipient_count, 0) AS recipient_count, row_number() OVER w AS thread_position, us // 1000000 - lag(us) OVER w // 1000000 AS reply_latency_sec,
  length(coalesce(body_text_novel, '')) AS novel_char_count, regexp_matches(concat_ws(chr(10), subject, body_text_novel), '{text.ASKS}') AS contains_question FROM n LEFT JOIN p ON p.email_id = n.id WINDOW w AS (PARTITION BY thread_id ORDER BY us, n.id))
"""
)


def _variants_sql() -> str:
    from quillfold.plans.ledgerq import GATED

    listed, auto = f"({_H['List-ID']} OR {_H['List-Unsubscribe']})", "automation_reason IS NOT NULL"
    promo = f"(coalesce(category IN ('CATEGORY_PROMOTIONS', 'CATEGORY_SOCIAL'), false) AND {auto})"
    rules = {
        "category_or_bulk": f"coalesce(category IN ('CATEGORY_PROMOTIONS', 'CATEGORY_SOCIAL', 'CATEGORY_UPDATES'), false) OR {_H['Precedence']} OR {_H['X-Campaign-ID']} OR {listed}", "list_or_promo": f"{listed} OR {promo}", "override_second": f"{listed} OR (NOT {_STATE} AND {promo})",
        "override_first": f"NOT {_STATE} AND ({listed} OR {promo})", "list_only": listed, "none": "false",
    }
    gold = ", " + GATED.strip()[4:] + ", gold AS (SELECT DISTINCT source_email_id AS id FROM gated WHERE reason IS NULL)"
    each = " UNION ALL ".join(f"SELECT '{k}' AS rule, ({r}) AS drops, id IN (SELECT id FROM gold) AS g FROM a" for k, r in rules.items())
    return _KEPT + f", a AS (SELECT k.*, {_AUTO} AS automation_reason FROM kept k LEFT JOIN senders s ON s.email_id = k.id)" + gold + f", u AS ({each}) SELECT rule, count(*) FILTER (drops) AS gated, count(*) FILTER (drops AND g) AS gold_lost, count(*) FILTER (NOT drops) AS to_extract FROM u GROUP BY rule"


def _candidates_sql() -> str:
    from quillfold.operators.extract import PATTERNS

    quoted = [(a, p.replace("'", "''").replace("\\n", "\n")) for a, p in PATTERNS]
    each = " UNION ALL ".join(f"SELECT id, '{a}' AS attribute, unnest(regexp_extract_all(coalesce(body_text_novel, ''), '{p}', 0)) AS q, '{p}' AS p FROM kept" for a, p in quoted)
    first = "CASE attribute " + " ".join(f"WHEN '{a}' THEN regexp_extract(q, '{p}', 1)" for a, p in quoted) + " END"
    return _KEPT + f", c AS ({each}) SELECT id AS email_id, attribute, count(*) AS n, min({first}) AS first_summary FROM c GROUP BY 1, 2"


def _vocabulary_sql() -> str:
    from quillfold.operators import ledger

    rows = ", ".join(f"('{a}', '{b}')" for a, b in ledger.VOCABULARY.items())
    return rf"SELECT attribute, act, coalesce(n, 0) AS claims FROM (VALUES {rows}) v(attribute, act) LEFT JOIN (SELECT lower(trim(attribute, E' \t\n\r')) AS a, count(DISTINCT id) AS n FROM evidence GROUP BY 1) ON a = attribute"


QUERIES = {
    "claim_candidates": (claim_candidates, _candidates_sql()),
    "attribute_vocabulary": (attribute_vocabulary, _vocabulary_sql()),
    "classifier_chain_flags": (classifier_chain_flags, _SIGNALS + "SELECT * FROM flags"),
    "automation_reasons": (automation_reasons, _SIGNALS + "SELECT coalesce(automation_reason, 'none') AS automation, coalesce(noise_reason, 'none') AS noise, count(*) AS mails FROM flags GROUP BY 1, 2"),
    "gate_variants_study": (gate_variants_study, _variants_sql()),
    "extraction_queue": (
        extraction_queue,
        _SIGNALS + "SELECT n.id, n.user_id, f.thread_position, t.message_count AS thread_messages, u.address AS owner_address, c.provider, n.us AS at FROM n JOIN flags f ON f.id = n.id AND f.noise_reason IS NULL JOIN threads t ON t.id = n.thread_id JOIN users u ON u.id = n.user_id JOIN accounts c ON c.id = n.account_id WHERE n.id NOT IN (SELECT source_email_id FROM evidence WHERE source_email_id IS NOT NULL)",
    ),
    "prompt_projection": (
        prompt_projection,
        _KEPT + """, w AS (SELECT email_id, string_agg(rpad(part_role, 9, ' ') || ' ' || coalesce(raw_name, '(no name)') || ' <' || coalesce(raw_address, '') || '>' || CASE WHEN is_user THEN '   [MAILBOX OWNER]' ELSE '' END, chr(10) ORDER BY part_role, part_no) AS people FROM email_participants GROUP BY 1),
x AS (SELECT id, concat_ws(chr(10) || '--' || chr(10), coalesce(people, ''), coalesce(subject, ''), substr(coalesce(body_text_novel, ''), 1, 8000), CASE WHEN length(coalesce(body_text_full, '')) > length(coalesce(body_text_novel, '')) THEN substr(body_text_full, length(coalesce(body_text_novel, '')) + 1, 4000) ELSE '' END) AS prompt FROM kept LEFT JOIN w ON w.email_id = kept.id)
SELECT id, length(prompt) AS chars, md5(prompt) AS prompt_md5 FROM x""",
    ),
    "date_mention_kinds": (date_mention_kinds, None),
    "quote_highlight": (
        quote_highlight,
        """WITH e AS (SELECT id, arg_min({'m': source_email_id, 'q': evidence_quote}, ingest_seq) AS r FROM evidence WHERE id IS NOT NULL AND user_id IS NOT NULL GROUP BY id),
x AS (SELECT e.id, body_text_novel AS t, trim(e.r.q) AS q FROM e JOIN emails m ON m.id = e.r.m WHERE body_text_novel IS NOT NULL AND trim(e.r.q) <> '')
SELECT id, CASE WHEN strpos(t, q) > 0 THEN strpos(t, q) - 1 ELSE length(t) END AS before, CASE WHEN strpos(t, q) > 0 THEN md5(q) END AS hit_md5, CASE WHEN strpos(t, q) > 0 THEN length(t) - strpos(t, q) - length(q) + 1 END AS after FROM x""",
    ),
    "snippet_check": (
        snippet_check,
        r"SELECT user_id, count(*) AS snippets, count(*) FILTER (NOT (snippet = '' OR contains(substr(trim(regexp_replace(coalesce(body_text_full, ''), '\s+', ' ', 'g')), 1, 80), trim(substr(snippet, 1, 20))))) AS strange, max(length(substr(body_text_full, 1, 260))) AS longest_excerpt FROM emails WHERE snippet IS NOT NULL GROUP BY 1",
    ),
}
