"""The evidence gate, the claim ledger's work items and changes, and the six questions, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillfold.functions.text import TITLE_STOP
from quillfold.functions.timefns import BEFORE_WEEKDAY, END_OF_DAY, END_OF_WEEK, WEEKDAYS
from quillfold.operators import ledger
from quillfold.operators.changefeed import clean_key, instant, op_kind
from quillfold.operators.threads import latest
from quillfold.session import cut, load

AS_OF = "2026-08-15 00:00:00"
WINDOW_DAYS = 180


def _found(spark: SparkSession, d: str) -> DataFrame:
    return ledger.claims(load(spark, d, "evidence"), load(spark, d, "emails"), load(spark, d, "email_participants"))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """The claims, found once: items, changes and quotes all read them."""
    return cut(_found(spark, d), "claims")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return ledger.exact_items(_claims(spark, d))


def _us(c: str) -> F.Column:
    return F.unix_micros(c).alias(c)


def _as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp")


# --- SQL twins: one chain of common table expressions ---------------------------

_STOP = ", ".join(f"'{w}'" for w in TITLE_STOP)
_SQUEEZED = "strpos(regexp_replace({0}, '\\s+', ' ', 'g'), regexp_replace(q0, '\\s+', ' ', 'g')) > 0"
_FOUND = "length(q0) >= 8 AND (" + " OR ".join(f"coalesce({x}, false)" for c in ("novel", "body", "subject") for x in (f"strpos({c}, q0) > 0", _SQUEEZED.format(c))) + ")"


def _place(pattern: str) -> str:
    """Where a pattern first occurs in q, from 1; null if it doesn't."""
    return f"CASE WHEN regexp_matches(q, '{pattern}') THEN 1 + length(regexp_extract(q, '(?s)^(.*?){pattern}', 1)) END"


_WEEKDAY = rf"\b(?:(?:{BEFORE_WEEKDAY})\s+)?(?:{'|'.join(WEEKDAYS)})\b"
_WEEKDAY_WORD = rf"\b(?:(?:{BEFORE_WEEKDAY})\s+)?({'|'.join(WEEKDAYS)})\b"
_NUMBER = "CASE " + " ".join(f"WHEN w = '{w}' THEN {i}" for i, w in enumerate(WEEKDAYS, 1)) + " END"
GATED = rf"""
WITH firsts AS (
  SELECT id, arg_min({{'op': op, 'user_id': user_id, 'email': source_email_id, 'thread_id': thread_id, 'attribute': attribute, 'claim': claim, 'quote': evidence_quote, 'seen': observed_at, 'arrived': arrived_at}}, ingest_seq) AS r
  FROM evidence WHERE id IS NOT NULL AND user_id IS NOT NULL GROUP BY id),
flat AS (
  SELECT f.id, r.user_id AS user_id, r.thread_id AS thread_id, r.email AS source_email_id, lower(trim(r.attribute, E' \t\n\r')) AS attribute, trim(json_extract_string(r.claim, '$.summary')) AS title, r.seen AS observed_at, r.arrived AS arrived_at,
         r.quote AS evidence_quote, regexp_replace(coalesce(r.quote, ''), '^\s+|\s+$', '', 'g') AS q0, lower(coalesce(r.quote, '')) AS q, lower(trim(r.op)) AS op, e.provider_ts AS sent, e.body_text_novel AS novel, e.body_text_full AS body, e.subject AS subject
  FROM firsts f LEFT JOIN emails e ON e.id = f.r.email),
gated AS (
  SELECT *, CASE WHEN attribute IS NULL OR attribute NOT IN ({", ".join(f"'{a}'" for a in ledger.VOCABULARY)}) THEN 'bad_attribute' WHEN sent IS NULL THEN 'call_failed' WHEN NOT ({_FOUND}) THEN 'quote_not_found' END AS reason
  FROM flat WHERE op NOT IN ('delete', 'del', 'd', 'remove'))
"""
CLAIMS = (
    GATED
    + rf""",
roles AS (
  SELECT email_id, arg_min({{'p': person_id, 'u': is_user}}, {{'n': part_no, 'a': raw_address}}) FILTER (part_role = 'from') AS sender, arg_min({{'p': person_id, 'u': is_user}}, {{'n': part_no, 'a': raw_address}}) FILTER (part_role = 'to') AS receiver
  FROM email_participants GROUP BY email_id),
dayed AS (SELECT g.*, epoch_us(CAST(sent AS TIMESTAMPTZ)) AS ts, CAST(substr(trim(sent), 1, 10) AS DATE) AS day, regexp_extract(q, '{_WEEKDAY_WORD}', 1) AS w, CASE WHEN attribute = 'request.action' THEN receiver ELSE sender END AS owner, CASE WHEN attribute = 'request.action' THEN sender ELSE receiver END AS other FROM gated g LEFT JOIN roles ON roles.email_id = g.source_email_id WHERE reason IS NULL),
placed AS (
  SELECT *, {_place(r"\b(?:today|tonight)\b")} AS p1, {_place(r"\btomorrow\b")} AS p2, {_place(r"\byesterday\b")} AS p3, {_place(_WEEKDAY)} AS p4, TRY_CAST(regexp_extract(q, '\b(\d{{4}}-\d{{2}}-\d{{2}})\b', 1) AS DATE) AS iso, {_place(r"\b\d{4}-\d{2}-\d{2}\b")} AS p5_ FROM dayed),
dued AS (
  SELECT *, CASE WHEN iso IS NOT NULL THEN p5_ END AS p5, least(p1, p2, p3, p4, CASE WHEN iso IS NOT NULL THEN p5_ END) AS p,
    CASE WHEN regexp_matches(q, '{END_OF_DAY}') THEN day WHEN regexp_matches(q, '{END_OF_WEEK}') THEN day + CAST(((5 - isodow(day)) % 7 + 7) % 7 AS INTEGER) END AS soft
  FROM placed),
claims AS (
  SELECT id, user_id, thread_id, source_email_id, attribute, title, ts, evidence_quote, observed_at,
    CASE WHEN p = p1 THEN day WHEN p = p2 THEN day + 1 WHEN p = p3 THEN day - 1 WHEN p = p4 THEN day + CAST(({_NUMBER} - isodow(day) + 6) % 7 + 1 AS INTEGER) WHEN p = p5 THEN iso ELSE soft END AS due,
    (CASE WHEN p IS NOT NULL AND p = p5 THEN 0.9 WHEN p IS NOT NULL THEN 0.7 WHEN soft IS NOT NULL THEN 0.5 ELSE 0.0 END)::DOUBLE AS conf,
    CASE attribute WHEN 'request.action' THEN 'request' WHEN 'commitment.action' THEN 'commitment' WHEN 'commitment.attachment' THEN 'commitment' WHEN 'decision.value' THEN 'decision' END AS act,
    CASE attribute WHEN 'completion.action' THEN 'RESOLVED' WHEN 'delivery.attachment' THEN 'RESOLVED' WHEN 'cancellation' THEN 'CANCELLED' END AS closes,
    array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda x: x NOT IN ({_STOP}))))[1:8], ' ') AS k,
    owner.p AS owner_id, other.p AS requester_id, CASE WHEN owner.p IS NOT NULL THEN coalesce(owner.u, false) END AS self
  FROM dued WHERE title IS NOT NULL AND title <> '' AND ts IS NOT NULL),
opening AS (SELECT *, act || '|' || coalesce(owner_id, 'unassigned') || '|' || k AS mk FROM claims WHERE act IS NOT NULL)
"""
)
ITEMS = (
    CLAIMS
    + """,
opened AS (
  SELECT user_id, mk, arg_min(id, {'t': ts, 'i': id}) AS item_id, arg_min(act, {'t': ts, 'i': id}) AS act, arg_min(title, {'t': ts, 'i': id}) AS title, arg_min(k, {'t': ts, 'i': id}) AS k, min(ts) AS opened_at, max(ts) AS last_at, count(*) AS claims, count(DISTINCT thread_id) AS threads,
         arg_max(due, {'c': conf, 't': ts, 'i': id}) FILTER (due IS NOT NULL) AS due, arg_min({'v': owner_id}, {'t': ts, 'i': id}).v AS owner_id, arg_min({'v': requester_id}, {'t': ts, 'i': id}).v AS requester_id, arg_min({'v': self}, {'t': ts, 'i': id}).v AS owner_is_self,
         arg_min({'v': source_email_id}, {'t': ts, 'i': id}).v AS source_email_id, arg_min({'v': thread_id}, {'t': ts, 'i': id}).v AS thread_id
  FROM opening GROUP BY user_id, mk),
ends AS (
  SELECT o.user_id, o.mk, arg_min(c.closes, {'t': c.ts, 'i': c.id}) AS closes, min(c.ts) AS closed_at
  FROM opened o JOIN claims c ON c.user_id = o.user_id AND c.k = o.k AND c.closes IS NOT NULL AND c.ts >= o.opened_at GROUP BY ALL),
items AS (SELECT o.*, coalesce(e.closes, 'OPEN') AS status, e.closed_at FROM opened o LEFT JOIN ends e ON e.user_id = o.user_id AND e.mk = o.mk)
"""
)
CHANGES = (
    ITEMS
    + """,
ranked AS (SELECT *, row_number() OVER w AS place, coalesce(max(CASE WHEN due IS NOT NULL THEN conf END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS surest FROM opening WINDOW w AS (PARTITION BY user_id, mk ORDER BY ts, id)),
setting AS (SELECT *, place = 1 OR (due IS NOT NULL AND conf >= surest) AS sets FROM ranked),
held AS (SELECT *, last_value(CASE WHEN sets THEN {'due': due} END IGNORE NULLS) OVER (PARTITION BY user_id, mk ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING).due AS held FROM setting),
changes AS (
  SELECT user_id, mk, 'opened' AS change_type, NULL AS old_value, CAST(json_object('title', title) AS VARCHAR) AS new_value, id AS evidence_id, ts AS changed_at FROM held WHERE place = 1
  UNION ALL SELECT user_id, mk, 'due_moved', CAST(json_object('due_at', CAST(held AS VARCHAR)) AS VARCHAR), CAST(json_object('due_at', CAST(due AS VARCHAR)) AS VARCHAR), id, ts FROM held WHERE place > 1 AND sets AND due IS DISTINCT FROM held
  UNION ALL SELECT user_id, mk, 'value_superseded', NULL, CAST(json_object('evidence_id', id) AS VARCHAR), id, ts FROM held WHERE place > 1 AND attribute = 'decision.value'
  UNION ALL SELECT o.user_id, o.mk, CASE WHEN c.closes = 'RESOLVED' THEN 'resolved' ELSE 'cancelled' END, NULL, CAST(json_object('status', c.closes) AS VARCHAR), c.id, c.ts FROM opened o JOIN claims c ON c.user_id = o.user_id AND c.k = o.k AND c.closes IS NOT NULL AND c.ts >= o.opened_at)
"""
)
_LATE = f"epoch_us(TIMESTAMPTZ '{AS_OF}+00')"
SCORED = (
    ITEMS
    + f""",
t AS (SELECT *, date_diff('day', due, DATE '{AS_OF[:10]}') AS late, floor(({_LATE} // 1000000 - last_at // 1000000) / 86400.0) AS quiet FROM items WHERE status = 'OPEN'),
s AS (SELECT *,
  round(CASE WHEN due IS NULL THEN 0.25 WHEN late > 0 THEN 1.0 ELSE greatest(0.0, 1.0 + late / 14.0) END::DOUBLE, 3) AS urgency, round(least(1.0, 0.3 + 0.2 * claims + 0.2 * (greatest(threads, 1) - 1))::DOUBLE, 3) AS importance, round(least(1.0, greatest(0.0, quiet / 21.0))::DOUBLE, 3) AS staleness,
  (CASE WHEN coalesce(owner_is_self, false) AND act = 'commitment' THEN 1.0 WHEN coalesce(owner_is_self, false) THEN 0.6 ELSE 0.2 END)::DOUBLE AS commitment,
  CASE WHEN coalesce(owner_is_self, false) AND act = 'commitment' THEN 'unfulfilled_commitment' WHEN late > 0 THEN 'overdue' WHEN late >= -3 THEN 'due_soon' WHEN quiet >= 14 THEN 'stale' ELSE 'unanswered_request' END AS reason
  FROM t),
scored AS (SELECT *, round(0.40 * urgency + 0.25 * importance + 0.20 * staleness + 0.15 * commitment, 4) AS score FROM s)
"""
)
_QUOTES = """,
names AS (SELECT id, min(canonical_name) AS name FROM people WHERE id IS NOT NULL GROUP BY 1),
proof AS (SELECT user_id, mk, arg_min({'q': evidence_quote}, {'t': epoch_us(CAST(observed_at AS TIMESTAMPTZ)), 'i': id}).q AS evidence_quote FROM opening GROUP BY 1, 2)
"""
_BASE = """i.item_id AS work_item_id, i.user_id, i.title, i.act AS speech_act, i.status, i.due AS due_at, i.owner_is_self, i.owner_id IS NOT NULL AS owner_resolved, i.last_at AS last_activity_at, i.opened_at, o.name AS owner_name, r.name AS requester_name,
  th.id AS thread_id, m.provider_message_id AS anchor_message_id, m.subject, q.evidence_quote"""
_JOINS = "LEFT JOIN names o ON o.id = i.owner_id LEFT JOIN names r ON r.id = i.requester_id LEFT JOIN threads th ON th.id = i.thread_id JOIN emails m ON m.id = i.source_email_id LEFT JOIN proof q ON q.user_id = i.user_id AND q.mk = i.mk"


def _asked(head: str, source: str, where: str, order: str, more: str = "") -> str:
    """A question: the first 25 of each mailbox, with the common columns."""
    return head + _QUOTES + f"SELECT * FROM (SELECT {_BASE}{more}, row_number() OVER (PARTITION BY i.user_id ORDER BY {order}, i.item_id) AS rank FROM (SELECT *, round(({_LATE} - last_at) / 86400000000.0, 4) AS quiet FROM {source}) i {_JOINS} WHERE {where}) WHERE rank <= 25"


# --- queries -------------------------------------------------------------------


def evidence_gate_split(spark: SparkSession, d: str) -> DataFrame:
    """Claims kept and quarantined, by attribute and reason."""
    g = ledger.gate(load(spark, d, "evidence"), load(spark, d, "emails"))
    return g.groupBy("attribute", F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("claims"))


def quarantine_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Claims by month of arrival and reason of their rejection, with the share of the month: the alarm for made-up quotes."""
    g = ledger.gate(load(spark, d, "evidence"), load(spark, d, "emails")).groupBy(F.date_format("arrived_at", "yyyy-MM").alias("month"), F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("claims"))
    return g.withColumn("share", F.round(F.col("claims") / F.sum("claims").over(Window.partitionBy("month")), 6))


def ledger_claims(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("id", "user_id", "attribute", "act", "closes", "title", F.array_join("words", " ").alias("title_key"), F.unix_micros("at").alias("at"), "due", "due_confidence", "owner_person_id", "requester_person_id", "owner_is_self")


def ledger_items(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("item_id", "user_id", "act", "match_key", "title", _us("opened_at"), _us("last_at"), "claims", "threads", "due", "owner_person_id", "owner_is_self", "status", _us("closed_at"))


def ledger_changes(spark: SparkSession, d: str) -> DataFrame:
    return ledger.exact_changes(_claims(spark, d)).withColumn("changed_at", F.unix_micros("changed_at"))


def ledger_full_fold(spark: SparkSession, d: str) -> DataFrame:
    return ledger.full_fold(_claims(spark, d))


def ledger_value_superseded(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of a thread that a later one of the same thread replaces."""
    c = _claims(spark, d).filter("attribute = 'decision.value' and thread_id is not null")
    w = Window.partitionBy("user_id", "thread_id").orderBy("at", "id")
    return c.withColumn("superseded_by", F.lead("id").over(w)).filter("superseded_by is not null").select("id", "superseded_by")


def ledger_due_moved(spark: SparkSession, d: str) -> DataFrame:
    """Claims that name another day than the claim before them in the same mailbox and thread."""
    c = _claims(spark, d).filter("act is not null and due is not null and thread_id is not null")
    w = Window.partitionBy("user_id", "thread_id").orderBy("at", "id")
    return c.withColumn("old_due", F.lag("due").over(w)).filter("old_due is not null and old_due != due").select("id", "old_due", F.col("due").alias("new_due"))


def latest_fact_per_key(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "evidence").select("user_id", "thread_id", clean_key(F.col("attribute")).alias("attribute"), "id", instant(F.col("observed_at")).alias("at"), op_kind(F.col("op")).alias("kind")).filter("kind != 'D'")
    return latest(e.select("user_id", "thread_id", "attribute", "id", "at"), ["user_id", "thread_id", "attribute"], [F.col("at"), F.col("id")]).select("user_id", "thread_id", "attribute", "id", _us("at"))


def attention_scores(spark: SparkSession, d: str) -> DataFrame:
    return ledger.attention(_items(spark, d), _as_of()).select("item_id", "user_id", "reason", "urgency", "importance", "staleness", "commitment", "score")


def ask(spark: SparkSession, d: str, question: str, limit: int = 25, user_id: str | None = None, claim: DataFrame | None = None) -> DataFrame:
    """One of the six questions: the first ``limit`` answers of each mailbox (of one, with ``user_id``), in rank order, with the common columns.

    For several questions give ``claim``, the claims found once.
    """
    if question not in QUESTIONS:
        raise ValueError(f"unknown question {question}; there are {', '.join(QUESTIONS)}")
    claim = _claims(spark, d) if claim is None else claim
    items = ledger.exact_items(claim)
    quiet = F.round((F.unix_micros(_as_of()) - F.unix_micros("last_activity_at")) / F.lit(86_400_000_000.0), 4)
    more: tuple[str, ...] = ()
    if question == "q5_what_changed":
        rows = ledger.exact_changes(claim).filter((F.col("change_type") != "opened") & ((F.unix_micros(_as_of()) - F.unix_micros("changed_at")) / F.lit(86_400_000_000.0) <= WINDOW_DAYS))
        quotes = claim.select(F.col("id").alias("evidence_id"), F.col("evidence_quote").alias("quote"))
        base = ledger.answer_base(items, claim, load(spark, d, "emails"), load(spark, d, "people"), load(spark, d, "threads"))
        keyed = items.select(F.col("item_id").alias("work_item_id"), "match_key")
        rows = rows.join(base.join(keyed, "work_item_id"), ["user_id", "match_key"]).join(quotes, "evidence_id", "left").withColumn("evidence_quote", F.col("quote"))
        order, more = [F.col("changed_at").desc(), F.col("evidence_id"), F.col("change_type")], ("change_type", "old_value", "new_value", "changed_at", "evidence_id")
    else:
        if question == "q1_needs_attention":
            items, more = ledger.attention(items, _as_of()), ("reason", "score")
        base = ledger.answer_base(items.filter("status = 'OPEN'"), claim, load(spark, d, "emails"), load(spark, d, "people"), load(spark, d, "threads")).withColumn("quiet", quiet)
        if more:
            base = base.join(items.select(F.col("item_id").alias("work_item_id"), *more), "work_item_id")
        mine = F.coalesce("owner_is_self", F.lit(False))
        today = F.lit(AS_OF[:10]).cast("date")
        where, order = {
            "q1_needs_attention": (F.lit(True), [F.col("score").desc()] if more else []),
            "q2_forgetting": ((F.col("speech_act") == "commitment") & mine & (F.col("quiet") >= 3), [F.col("quiet").desc()]),
            "q3_waiting_on_me": (mine, [F.col("due_at").asc_nulls_last(), F.col("last_activity_at").desc()]),
            "q4_waiting_on_others": (~mine, [F.col("due_at").asc_nulls_last(), F.col("quiet").desc()]),
            "q6_slipping": ((F.col("quiet") >= 7) | F.coalesce(F.col("due_at") < today, F.lit(False)) | ~F.col("owner_resolved"), [F.col("quiet").desc()]),
        }[question]
        rows = base.filter(where)
    if user_id is not None:
        rows = rows.filter(F.col("user_id") == user_id)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*order, "work_item_id"))).filter(F.col("rank") <= limit)
    shown = rows.select(*ANSWER, *more, "rank")
    return shown.withColumns({c: F.unix_micros(c) for c, t in shown.dtypes if t == "timestamp"})


#: The columns that all questions show.
ANSWER = ("work_item_id", "user_id", "title", "speech_act", "status", "due_at", "owner_is_self", "owner_resolved", "last_activity_at", "opened_at", "owner_name", "requester_name", "thread_id", "anchor_message_id", "subject", "evidence_quote")
#: The six questions: what each one asks.
QUESTIONS = {
    "q1_needs_attention": "What needs my attention?", "q2_forgetting": "What am I forgetting?", "q3_waiting_on_me": "What is waiting on me?", "q4_waiting_on_others": "What am I waiting on?",
    "q5_what_changed": "What changed?", "q6_slipping": "What's slipping through the cracks?",
}


def ledger_invariants(spark: SparkSession, d: str) -> DataFrame:
    """How often each rule of the ledger is broken."""
    claim = _claims(spark, d)
    i, c = ledger.exact_items(claim), ledger.exact_changes(claim)
    one = i.agg(
        F.count_if((F.col("status") == "OPEN") & F.col("closed_at").isNotNull()).alias("open_but_closed"), F.count_if((F.col("status") != "OPEN") & (F.col("closed_at") < F.col("opened_at"))).alias("closed_before_opened"),
        F.count_if(F.col("last_at") < F.col("opened_at")).alias("last_before_opened"), (F.count("*") - F.count_distinct("item_id")).alias("repeated_ids"), F.count("*").alias("items"),
    )
    mail = load(spark, d, "emails").select(F.col("id").alias("source_email_id"), F.col("user_id").alias("of"))
    other = i.join(mail, "source_email_id").agg(F.count_if(F.col("of") != F.col("user_id")).alias("other_mailbox"))
    orphan = c.join(i.select("user_id", "match_key"), ["user_id", "match_key"], "left_anti").agg(F.count("*").alias("orphan_changes"))
    closes = c.filter("change_type in ('resolved', 'cancelled')").select("user_id", "match_key").distinct().join(i.filter("status = 'OPEN'"), ["user_id", "match_key"]).agg(F.count("*").alias("closed_but_open"))
    selves = load(spark, d, "people").groupBy("user_id").agg(F.count_if("is_self").alias("n")).agg(F.count_if(F.col("n") != 1).alias("mailboxes_without_one_self"))
    rules = [one.unpivot([], one.columns, "rule", "n"), *[x.unpivot([], x.columns, "rule", "n") for x in (other, orphan, closes, selves)]]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def _question(name: str):
    return lambda spark, d: ask(spark, d, name)


_INVARIANTS = CHANGES + """,
n AS (SELECT (SELECT count(*) FROM items WHERE status = 'OPEN' AND closed_at IS NOT NULL) AS open_but_closed, (SELECT count(*) FROM items WHERE status <> 'OPEN' AND closed_at < opened_at) AS closed_before_opened, (SELECT count(*) FROM items WHERE last_at < opened_at) AS last_before_opened,
  (SELECT count(*) - count(DISTINCT item_id) FROM items) AS repeated_ids, (SELECT count(*) FROM items) AS items, (SELECT count(*) FROM items i JOIN emails m ON m.id = i.source_email_id WHERE m.user_id <> i.user_id) AS other_mailbox,
  (SELECT count(*) FROM changes c WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.user_id = c.user_id AND i.mk = c.mk)) AS orphan_changes,
  (SELECT count(*) FROM items i WHERE status = 'OPEN' AND EXISTS (SELECT 1 FROM changes c WHERE c.user_id = i.user_id AND c.mk = i.mk AND change_type IN ('resolved', 'cancelled'))) AS closed_but_open,
  (SELECT count(*) FROM (SELECT user_id FROM people GROUP BY 1 HAVING count(*) FILTER (is_self) <> 1)) AS mailboxes_without_one_self)
SELECT rule, n FROM (UNPIVOT n ON COLUMNS(*) INTO NAME rule VALUE n)"""
_MINE = "coalesce(i.owner_is_self, false)"

QUERIES = {
    "evidence_gate_split": (evidence_gate_split, GATED + "SELECT attribute, coalesce(reason, 'kept') AS outcome, count(*) AS claims FROM gated GROUP BY 1, 2"),
    "quarantine_by_month": (quarantine_by_month, GATED + "SELECT *, round(claims / sum(claims) OVER (PARTITION BY month), 6) AS share FROM (SELECT strftime(arrived_at AT TIME ZONE 'UTC', '%Y-%m') AS month, coalesce(reason, 'kept') AS outcome, count(*) AS claims FROM gated GROUP BY 1, 2)"),
    "ledger_claims": (ledger_claims, CLAIMS + "SELECT id, user_id, attribute, act, closes, title, k AS title_key, ts AS at, due, conf AS due_confidence, owner_id AS owner_person_id, requester_id AS requester_person_id, self AS owner_is_self FROM claims"),
    "ledger_items": (ledger_items, ITEMS + "SELECT item_id, user_id, act, mk AS match_key, title, opened_at, last_at, claims, threads, due, owner_id AS owner_person_id, owner_is_self, status, closed_at FROM items"),
    "ledger_changes": (ledger_changes, CHANGES + "SELECT user_id, mk AS match_key, change_type, old_value, new_value, evidence_id, changed_at FROM changes"),
    "ledger_full_fold": (ledger_full_fold, None),
    "ledger_value_superseded": (ledger_value_superseded, CLAIMS + "SELECT * FROM (SELECT id, lead(id) OVER (PARTITION BY user_id, thread_id ORDER BY ts, id) AS superseded_by FROM claims WHERE attribute = 'decision.value' AND thread_id IS NOT NULL) WHERE superseded_by IS NOT NULL"),
    "ledger_due_moved": (ledger_due_moved, CLAIMS + "SELECT id, old_due, due AS new_due FROM (SELECT *, lag(due) OVER (PARTITION BY user_id, thread_id ORDER BY ts, id) AS old_due FROM claims WHERE act IS NOT NULL AND due IS NOT NULL AND thread_id IS NOT NULL) WHERE old_due <> due"),
    "latest_fact_per_key": (latest_fact_per_key, "SELECT user_id, thread_id, lower(trim(attribute)) AS attribute, arg_max(id, {'t': epoch_us(CAST(observed_at AS TIMESTAMPTZ)), 'i': id}) AS id, max(epoch_us(CAST(observed_at AS TIMESTAMPTZ))) AS at FROM evidence WHERE lower(trim(op)) NOT IN ('delete','del','d','remove') GROUP BY 1, 2, 3"),
    "attention_scores": (attention_scores, SCORED + "SELECT item_id, user_id, reason, urgency, importance, staleness, commitment, score FROM scored"),
    "q1_needs_attention": (_question("q1_needs_attention"), _asked(SCORED, "scored", "true", "i.score DESC", ", i.reason, i.score")),
    "q2_forgetting": (_question("q2_forgetting"), _asked(ITEMS, "items", f"i.status = 'OPEN' AND i.act = 'commitment' AND {_MINE} AND i.quiet >= 3", "i.quiet DESC")),
    "q3_waiting_on_me": (_question("q3_waiting_on_me"), _asked(ITEMS, "items", f"i.status = 'OPEN' AND {_MINE}", "i.due ASC NULLS LAST, i.last_at DESC")),
    "q4_waiting_on_others": (_question("q4_waiting_on_others"), _asked(ITEMS, "items", f"i.status = 'OPEN' AND NOT {_MINE}", "i.due ASC NULLS LAST, i.quiet DESC")),
    "q5_what_changed": (
        _question("q5_what_changed"),
        CHANGES + _QUOTES + f"""SELECT * FROM (SELECT {_BASE.replace("q.evidence_quote", "p.evidence_quote AS evidence_quote")}, c.change_type, c.old_value, c.new_value, c.changed_at, c.evidence_id, row_number() OVER (PARTITION BY i.user_id ORDER BY c.changed_at DESC, c.evidence_id, c.change_type, i.item_id) AS rank
  FROM changes c JOIN items i ON i.user_id = c.user_id AND i.mk = c.mk {_JOINS} LEFT JOIN claims p ON p.id = c.evidence_id WHERE c.change_type <> 'opened' AND ({_LATE} - c.changed_at) / 86400000000.0 <= {WINDOW_DAYS}) WHERE rank <= 25""",
    ),
    "q6_slipping": (_question("q6_slipping"), _asked(ITEMS, "items", f"i.status = 'OPEN' AND (i.quiet >= 7 OR coalesce(i.due < DATE '{AS_OF[:10]}', false) OR i.owner_id IS NULL)", "i.quiet DESC")),
    "ledger_invariants": (ledger_invariants, _INVARIANTS),
}
