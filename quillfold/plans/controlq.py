"""Control-plane operators over the mailbox and event tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillfold.operators import control, ledger
from quillfold.operators.changefeed import instant
from quillfold.operators.delivery import unique_emails
from quillfold.plans import ledgerq
from quillfold.plans.ledgerq import AS_OF
from quillfold.session import load


def _as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp")


def _us(c: str) -> F.Column:
    return F.unix_micros(c).alias(c)


def ingestion_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Each account's deliveries as a queue by batch; a delivery is done unless it came within the last 30 days of its account."""
    e = load(spark, d, "emails").select("account_id", "batch_id", "id", "ingested_at")
    last = e.groupBy("account_id").agg(F.max("ingested_at").alias("last"))
    queue = e.join(last, "account_id").withColumn("done", F.col("ingested_at") < F.col("last") - F.make_interval(days=F.lit(30)))
    return control.advance_cursor(queue, "account_id", ["batch_id", "id"], "done").select("account_id", F.col("cursor").cast("long").alias("cursor"), "waiting")


def pending_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims without an owner, swept after 14 days: another claim of the thread that has one resolves them."""
    c = ledgerq._claims(spark, d).select(F.col("id").alias("claim_id"), "user_id", "thread_id", "at", "owner_person_id")
    resolved = c.filter("owner_person_id is not null and thread_id is not null").select("thread_id", F.col("at").alias("resolved_at"))
    pending = c.filter("owner_person_id is null and thread_id is not null")
    return control.sweep(pending, resolved, "thread_id", "at", _as_of(), 14).select("claim_id", "user_id", "outcome")


def sweeper_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counters of a sweep."""
    p = pending_claims(spark, d)
    return p.agg(F.count("*").alias("scanned"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("superseded", "promoted_unconfirmed", "waiting")])


def suppression_anti(spark: SparkSession, d: str) -> DataFrame:
    """Open items that aren't suppressed: those whose first mail lies in the trash are muted for good, in the archive snoozed for 90 days."""
    items = ledgerq._items(spark, d).filter("status = 'OPEN'")
    mail = load(spark, d, "emails").select(F.col("id").alias("source_email_id"), "folder")
    until = F.when(F.col("folder") == "ARCHIVE", F.col("last_at") + F.make_interval(days=F.lit(90)))
    sup = items.join(mail, "source_email_id").filter("folder in ('TRASH', 'ARCHIVE')").select("item_id", until.alias("suppressed_until"))
    return control.not_suppressed(items, sup, "item_id", _as_of()).select("item_id", "user_id", "title")


def digest_sections(spark: SparkSession, d: str) -> DataFrame:
    """Change rows in their digest windows, by section. A mailbox's digest ran on the days that a message of its own was sent, so windows differ in width."""
    m = unique_emails(load(spark, d, "emails")).filter("direction = 'outbound'").select("user_id", F.date_trunc("day", instant(F.col("provider_ts"))).alias("at")).filter("at is not null")
    windows = control.digest_windows(m, "user_id", "at")
    changes = ledger.exact_changes(ledgerq._claims(spark, d)).select("user_id", "change_type", "changed_at", "evidence_id")
    placed = control.in_windows(changes, windows, "user_id", "changed_at").join(windows, ["user_id", "window_end"])
    section = F.when(F.col("change_type") == "opened", "owed_or_awaited").when(F.col("change_type").isin("resolved", "cancelled"), "closed").otherwise("changed")
    days = F.datediff("window_end", "window_start")
    return placed.groupBy("user_id", "window_end", section.alias("section")).agg(F.count("*").alias("changes"), F.max(days).alias("days")).withColumn("window_end", F.unix_micros("window_end"))


def match_audit(spark: SparkSession, d: str) -> DataFrame:
    """For each claim that opens or repeats an item, the claim before it in the thread with the best agreement of titles, and the decision at 0.6."""
    c = ledgerq._claims(spark, d).filter("act is not null and thread_id is not null").select("id", "user_id", "thread_id", "at", "words", "act")
    a, b = c.alias("a"), c.alias("b")
    met = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.thread_id") == F.col("b.thread_id")) & (F.col("a.act") == F.col("b.act"))).filter("b.at < a.at or (b.at = a.at and b.id < a.id)")
    both = F.size(F.array_intersect("a.words", "b.words"))
    score = F.when(both == 0, F.lit(0.0)).otherwise(both / F.size(F.array_union("a.words", "b.words")))
    best = met.groupBy(F.col("a.id").alias("id")).agg(F.max_by(F.struct(F.col("b.id").alias("candidate"), F.round(score, 6).alias("score")), F.struct(F.round(score, 6), F.col("b.id"))).alias("r")).select("id", "r.*")
    return best.withColumn("decision", F.when(F.col("score") >= 0.6, "matched_existing").otherwise("created_new")).withColumn("threshold", F.lit(0.6))


def role_priors(spark: SparkSession, d: str) -> DataFrame:
    """Items weighted by their owner's role before any feedback: decisions weigh 0.5 for finance roles, promises 0.3 and requests 0.2 for all."""
    u = load(spark, d, "users").select(F.col("id").alias("user_id"), "role_profile")
    f = ledgerq._items(spark, d).join(u, "user_id").select("item_id", "role_profile", F.col("act").alias("feature"))
    roles = load(spark, d, "users").select("role_profile").distinct()
    weights = roles.select("role_profile", F.explode(F.create_map(F.lit("commitment"), F.lit(0.3), F.lit("request"), F.lit(0.2), F.lit("decision"), F.when(F.col("role_profile").contains("finance"), F.lit(0.5)).otherwise(F.lit(0.1)))).alias("feature", "prior_weight"))
    return control.with_priors(f, weights, "item_id", "role_profile")


def feedback_rates(spark: SparkSession, d: str) -> DataFrame:
    """Events as feedback: a view is an impression, a click opens, a purchase replies; by day."""
    kind = F.when(F.col("event_type") == "view", "impression").when(F.col("event_type") == "click", "open").when(F.col("event_type") == "purchase", "reply").otherwise("other")
    return control.click_rates(load(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), kind.alias("event_type")), ["day"])


def backfill_pages(spark: SparkSession, d: str) -> DataFrame:
    m = unique_emails(load(spark, d, "emails")).select("account_id", "id", instant(F.col("provider_ts")).alias("at"))
    return control.backfill_plan(m, "account_id", "at", "id", 50).select("account_id", "page_no", _us("newest"), _us("oldest"), "messages")


def dead_letter_queue(spark: SparkSession, d: str) -> DataFrame:
    """Events as attempts of stages: an error fails its user's stage of the hour, a purchase finishes it."""
    e = load(spark, d, "events").filter("event_type in ('error', 'purchase')")
    f = e.select(F.concat(F.lit("stage-"), F.hour("ts").cast("string")).alias("stage"), F.col("user_id").cast("string").alias("entity_id"), (F.col("event_type") == "error").alias("failed"), F.col("ts").alias("at"), F.when(F.col("value") > 50, "timeout").otherwise("refused").alias("error_class"))
    return control.dead_letters(f, 2).select("stage", "entity_id", "attempts", F.date_format("first_failed_at", "yyyy-MM-dd HH:mm:ss").alias("first_failed_at"), F.date_format("last_failed_at", "yyyy-MM-dd HH:mm:ss").alias("last_failed_at"), "error_class")


def processing_resume(spark: SparkSession, d: str) -> DataFrame:
    """Mails that the extraction stage still has to see: a mail with a claim is done at version 1."""
    work = load(spark, d, "emails").select(F.col("id").alias("entity_id"), "user_id")
    state = load(spark, d, "evidence").select(F.col("source_email_id").alias("entity_id"), F.lit("extract").alias("stage"), F.lit("1").alias("stage_version"), F.lit("done").alias("status"))
    return control.still_to_do(work, state, "extract", "1")


def evaluation_by_slice(spark: SparkSession, d: str) -> DataFrame:
    """The stored direction of mails against the direction that the sender's address shows, by folder."""
    e = load(spark, d, "emails")
    sender = load(spark, d, "email_participants").filter("part_role = 'from'").groupBy(F.col("email_id").alias("entity_id")).agg(F.bool_or("is_user").alias("own"))
    labels = e.select(F.col("id").alias("entity_id"), "folder", F.col("direction").alias("expected"))
    results = e.select(F.col("id").alias("entity_id"), "folder").join(sender, "entity_id").select("entity_id", "folder", F.when(F.col("own"), "outbound").otherwise("inbound").alias("actual"))
    return control.evaluate(labels, results, ["folder"])


def field_level_changes(spark: SparkSession, d: str) -> DataFrame:
    """Work items as of the middle of 2026 against all: status, due date and title, field by field."""
    c = ledgerq._claims(spark, d)
    fields = ["status", "due", "title"]
    shape = lambda x: ledger.exact_items(x).select("item_id", *fields)
    return control.field_changes(shape(c.filter(F.col("at") < F.lit("2026-06-01").cast("timestamp"))), shape(c), "item_id", fields)


def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """(user, address): the first name that arrives for a key stays; later ones are ignored."""
    i = load(spark, d, "person_identities").filter("observed_name is not null")
    dom = F.substring_index("address", "@", -1)
    return i.groupBy("user_id", dom.alias("domain")).agg(F.min_by("observed_name", "id").alias("name"), F.min("id").alias("first_id"))


def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The last row that arrived of each message key."""
    e = load(spark, d, "emails").filter("account_id is not null and provider_message_id is not null")
    key = F.lower(F.regexp_replace("provider_message_id", r"^\s+|\s+$", ""))
    return e.groupBy("account_id", key.alias("message")).agg(F.max_by("id", F.struct("ingested_at", "id")).alias("id"), F.max_by("folder", F.struct("ingested_at", "id")).alias("folder"))


def global_rate_limit(spark: SparkSession, d: str, hourly: int = 2, daily: int = 250) -> DataFrame:
    """Requests accepted under a cap per user and hour, then under a cap for all users per day; only requests that the first cap accepts count for the second."""
    e = load(spark, d, "events").select("event_id", "user_id", "ts")
    own = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id", F.date_trunc("hour", "ts")).orderBy("ts", "event_id"))).filter(F.col("n") <= hourly)
    day = F.date_format("ts", "yyyy-MM-dd")
    all_ = own.withColumn("m", F.row_number().over(Window.partitionBy(day).orderBy("ts", "event_id"))).filter(F.col("m") <= daily)
    return e.join(all_.select("event_id", F.lit(True).alias("ok")), "event_id", "left").groupBy(day.alias("day")).agg(F.count("*").alias("requests"), F.count("ok").alias("accepted"))


_SINCE = f"epoch_us(TIMESTAMPTZ '{AS_OF}+00')"
_DAY = "86400000000"
_PENDING = ledgerq.CLAIMS + f""",
met AS (SELECT p.id, min(r.ts) AS resolved FROM claims p JOIN claims r ON r.thread_id = p.thread_id AND r.owner_id IS NOT NULL AND r.ts > p.ts AND r.ts <= p.ts + 14 * {_DAY} WHERE p.owner_id IS NULL GROUP BY 1),
pend AS (SELECT c.id AS claim_id, user_id, CASE WHEN resolved <= {_SINCE} THEN 'superseded' WHEN ts + 14 * {_DAY} <= {_SINCE} THEN 'promoted_unconfirmed' ELSE 'waiting' END AS outcome FROM claims c LEFT JOIN met ON met.id = c.id WHERE owner_id IS NULL AND thread_id IS NOT NULL)
"""
_KEPT = r"WITH kept AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY account_id, lower(trim(provider_message_id, E' \t\n\r')) ORDER BY ingested_at NULLS LAST, id) AS n FROM emails) WHERE n = 1)"


def _before_sql() -> str:
    """Items of the claims before the middle of 2026, beside all items."""
    chain = ledgerq.ITEMS.split("opening AS (", 1)[1]
    for name in ("claims", "opening", "opened", "ends", "items"):
        chain = chain.replace(f" {name} ", f" b_{name} ").replace(f" {name}\n", f" b_{name}\n")
    chain = chain.replace("\nopened AS", "\nb_opened AS").replace("\nends AS", "\nb_ends AS").replace("\nitems AS", "\nb_items AS")
    chain = chain.replace("count(*) AS b_claims ", "count(*) AS claims ")
    return ledgerq.ITEMS + ", b_claims AS (SELECT * FROM claims WHERE ts < epoch_us(TIMESTAMPTZ '2026-06-01 00:00:00+00')), b_opening AS (" + chain


_FIELDS = " UNION ALL ".join(f"SELECT coalesce(a.item_id, b.item_id) AS item_id, '{f}' AS field, CAST(b.{f} AS VARCHAR) AS prior_value, CAST(a.{f} AS VARCHAR) AS new_value, CASE WHEN b.item_id IS NULL THEN 'created' WHEN a.item_id IS NULL THEN 'removed' ELSE 'updated' END AS change_type FROM items a FULL JOIN b_items b ON a.item_id = b.item_id" for f in ("status", "due", "title"))

QUERIES = {
    "ingestion_cursor": (
        ingestion_cursor,
        "WITH q AS (SELECT e.account_id, batch_id, id, ingested_at < l - INTERVAL 30 DAY AS done FROM emails e JOIN (SELECT account_id, max(ingested_at) AS l FROM emails GROUP BY 1) m ON m.account_id = e.account_id), o AS (SELECT account_id, min({'b': batch_id, 'i': id}) FILTER (NOT done) AS f, count(*) FILTER (NOT done) AS waiting FROM q GROUP BY 1) SELECT o.account_id, max(CASE WHEN o.f IS NULL OR {'b': q.batch_id, 'i': q.id} < o.f THEN q.batch_id END)::BIGINT AS cursor, any_value(waiting) AS waiting FROM o JOIN q ON q.account_id = o.account_id GROUP BY 1",
    ),
    "pending_claims": (pending_claims, _PENDING + "SELECT claim_id, user_id, outcome FROM pend"),
    "sweeper_counts": (sweeper_counts, _PENDING + "SELECT count(*) AS scanned, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ("superseded", "promoted_unconfirmed", "waiting")) + " FROM pend"),
    "suppression_anti": (suppression_anti, ledgerq.ITEMS + f"SELECT item_id, i.user_id, title FROM items i WHERE status = 'OPEN' AND NOT EXISTS (SELECT 1 FROM emails m WHERE m.id = i.source_email_id AND (m.folder = 'TRASH' OR (m.folder = 'ARCHIVE' AND i.last_at + 90 * {_DAY} > {_SINCE})))"),
    "digest_sections": (
        digest_sections,
        ledgerq.CHANGES + ", kept AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY account_id, lower(trim(provider_message_id, E' \\t\\n\\r')) ORDER BY ingested_at NULLS LAST, id) AS n FROM emails) WHERE n = 1)" + f""",
runs AS (SELECT DISTINCT user_id, epoch_us(CAST(provider_ts AS TIMESTAMPTZ)) // {_DAY} * {_DAY} AS run_day FROM kept WHERE direction = 'outbound'),
win AS (SELECT user_id, lag(run_day) OVER (PARTITION BY user_id ORDER BY run_day) AS ws, run_day AS we FROM runs),
pl AS (SELECT c.user_id, c.change_type, (SELECT min(we) FROM win w WHERE w.user_id = c.user_id AND w.we >= c.changed_at) AS we FROM changes c)
SELECT pl.user_id, pl.we AS window_end, CASE WHEN change_type = 'opened' THEN 'owed_or_awaited' WHEN change_type IN ('resolved', 'cancelled') THEN 'closed' ELSE 'changed' END AS section, count(*) AS changes, CAST(max((win.we - ws) // {_DAY}) AS INTEGER) AS days FROM pl JOIN win ON win.user_id = pl.user_id AND win.we = pl.we GROUP BY 1, 2, 3""",
    ),
    "match_audit": (
        match_audit,
        ledgerq.CLAIMS + """, c AS (SELECT *, string_split(k, ' ') AS ws FROM opening WHERE thread_id IS NOT NULL),
s AS (SELECT a.id, b.id AS candidate, CASE WHEN a.k = '' OR b.k = '' THEN 0.0 ELSE round(len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))), 6) END AS score FROM c a JOIN c b ON a.user_id = b.user_id AND a.thread_id = b.thread_id AND a.act = b.act AND (b.ts < a.ts OR (b.ts = a.ts AND b.id < a.id)))
SELECT id, candidate, score, CASE WHEN score >= 0.6 THEN 'matched_existing' ELSE 'created_new' END AS decision, 0.6::DOUBLE AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, candidate DESC) AS n FROM s) WHERE n = 1""",
    ),
    "role_priors": (role_priors, ledgerq.ITEMS + "SELECT item_id, (CASE act WHEN 'commitment' THEN 0.3 WHEN 'request' THEN 0.2 WHEN 'decision' THEN CASE WHEN contains(role_profile, 'finance') THEN 0.5 ELSE 0.1 END ELSE 0.0 END)::DOUBLE AS prior FROM items JOIN users u ON u.id = user_id"),
    "feedback_rates": (feedback_rates, "SELECT *, CASE WHEN impressions = 0 THEN NULL ELSE round(actions / impressions, 6) END AS rate FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'view') AS impressions, count(*) FILTER (event_type IN ('click', 'purchase')) AS actions FROM events GROUP BY 1)"),
    "backfill_pages": (backfill_pages, _KEPT + ", m AS (SELECT account_id, epoch_us(CAST(provider_ts AS TIMESTAMPTZ)) AS us, (row_number() OVER (PARTITION BY account_id ORDER BY epoch_us(CAST(provider_ts AS TIMESTAMPTZ)) DESC, id) - 1) // 50 AS page_no FROM kept) SELECT account_id, page_no, max(us) AS newest, min(us) AS oldest, count(*) AS messages FROM m GROUP BY 1, 2"),
    "dead_letter_queue": (
        dead_letter_queue,
        "WITH f AS (SELECT 'stage-' || extract(hour FROM ts) AS stage, CAST(user_id AS VARCHAR) AS entity_id, event_type = 'error' AS failed, ts, CASE WHEN value > 50 THEN 'timeout' ELSE 'refused' END AS ec FROM events WHERE event_type IN ('error', 'purchase')) SELECT stage, entity_id, count(*) FILTER (failed) AS attempts, strftime(min(ts) FILTER (failed), '%Y-%m-%d %H:%M:%S') AS first_failed_at, strftime(max(ts) FILTER (failed), '%Y-%m-%d %H:%M:%S') AS last_failed_at, arg_max(ec, {'t': ts, 'e': ec}) FILTER (failed) AS error_class FROM f GROUP BY 1, 2 HAVING count(*) FILTER (failed) >= 2 AND NOT bool_or(NOT failed)",
    ),
    "processing_resume": (processing_resume, "SELECT id AS entity_id, user_id FROM emails WHERE id NOT IN (SELECT source_email_id FROM evidence WHERE source_email_id IS NOT NULL)"),
    "evaluation_by_slice": (
        evaluation_by_slice,
        """WITH s AS (SELECT email_id, bool_or(is_user) AS own FROM email_participants WHERE part_role = 'from' GROUP BY 1), j AS (SELECT folder, direction AS e, CASE WHEN own THEN 'outbound' WHEN s.email_id IS NOT NULL THEN 'inbound' END AS a FROM emails LEFT JOIN s ON s.email_id = id),
c AS (SELECT folder, count(*) FILTER (e = a) AS matches, count(*) FILTER (e <> a) AS mismatches, count(*) FILTER (a IS NULL) AS misses, count(*) FILTER (e IS NULL AND a IS NOT NULL) AS spurious FROM j GROUP BY 1), p AS (SELECT *, matches / nullif(matches + mismatches + spurious, 0) AS p, matches / nullif(matches + mismatches + misses, 0) AS r FROM c)
SELECT folder, matches, mismatches, misses, spurious, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM p""",
    ),
    "field_level_changes": (field_level_changes, _before_sql() + f"SELECT * FROM ({_FIELDS}) WHERE prior_value IS DISTINCT FROM new_value"),
    "insert_if_absent": (insert_if_absent, "SELECT user_id, regexp_replace(address, '^.*@', '') AS domain, arg_min(observed_name, id) AS name, min(id) AS first_id FROM person_identities WHERE observed_name IS NOT NULL GROUP BY 1, 2"),
    "upsert_last_wins": (upsert_last_wins, r"SELECT account_id, lower(trim(provider_message_id, E' \t\n\r')) AS message, arg_max(id, {'t': ingested_at, 'i': id}) AS id, arg_max(folder, {'t': ingested_at, 'i': id}) AS folder FROM emails WHERE account_id IS NOT NULL AND provider_message_id IS NOT NULL GROUP BY 1, 2"),
    "global_rate_limit": (
        global_rate_limit,
        "WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events), a AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS m FROM o WHERE n <= 2) SELECT strftime(e.ts, '%Y-%m-%d') AS day, count(*) AS requests, count(a.event_id) AS accepted FROM events e LEFT JOIN a ON a.event_id = e.event_id AND a.m <= 250 GROUP BY 1",
    ),
}
