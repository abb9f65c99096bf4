"""The evidence gate, folding claims into work items (natively by exact key, and in full as an ordered stream), attention.

The full fold is sequential within a mailbox by definition (the first near title
wins). It runs over partitions sorted by (mailbox, instant, id), holds one
mailbox's items at a time, never its claims, and finds near titles through an
index of words, so a claim meets only items that share a word with it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfold.functions.text import find_quote, match_key, title_tokens
from quillfold.functions.timefns import local_date, resolve_due
from quillfold.operators.changefeed import clean_key, instant, op_kind

# Which claims open an item and which close one.
OPENS = {"request.action": "request", "commitment.action": "commitment", "commitment.attachment": "commitment", "decision.value": "decision"}
CLOSES = {"completion.action": "RESOLVED", "delivery.attachment": "RESOLVED", "cancellation": "CANCELLED"}
#: The vocabulary of attributes, by the act each one shows.
VOCABULARY = OPENS | dict.fromkeys(CLOSES, "closing")


def mapped(c: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def first_deliveries(evidence: DataFrame) -> DataFrame:
    """One row per change id: the first to arrive. Rows without id or user are left out."""
    cols = ("op", "user_id", "source_email_id", "thread_id", "attribute", "claim", "evidence_quote", "observed_at", "confidence", "arrived_at")
    return evidence.filter("id is not null and user_id is not null").groupBy("id").agg(F.min_by(F.struct(*cols), "ingest_seq").alias("r")).select("id", "r.*")


def gate(evidence: DataFrame, emails: DataFrame) -> DataFrame:
    """Claims with ``reason``: why one is quarantined, null where it is kept.

    A claim's attribute must be in the vocabulary (else ``bad_attribute``), its
    mail must be known (``call_failed``), and its quote must stand in the mail,
    but for line ends (``quote_not_found``). Deletes carry no claim and are left out.
    """
    mail = emails.select(F.col("id").alias("source_email_id"), "subject", "body_text_novel", "body_text_full", "provider_ts", "direction")
    rows = first_deliveries(evidence).filter(op_kind(F.col("op")) != "D").withColumn("attribute", clean_key(F.col("attribute")))
    found = find_quote(F.col("evidence_quote"), F.col("body_text_novel"), F.col("body_text_full"), F.col("subject"))
    reason = (
        F.when(~F.coalesce(F.col("attribute").isin(*VOCABULARY), F.lit(False)), "bad_attribute")
        .when(F.col("provider_ts").isNull(), "call_failed")
        .when(~found["found"], "quote_not_found")
    )
    return rows.join(mail, "source_email_id", "left").withColumn("reason", reason).withColumn("quote_at", found["at"]).drop("subject", "body_text_novel", "body_text_full")


def parties_of(participants: DataFrame) -> DataFrame:
    """(source_email_id, sender, receiver): struct(person_id, is_user) of the sender and of the first person addressed."""
    who = F.struct("person_id", "is_user")
    first = lambda role: F.min_by(who, F.when(F.col("part_role") == role, F.struct("part_no", "raw_address")))
    return participants.filter("part_role in ('from', 'to')").groupBy(F.col("email_id").alias("source_email_id")).agg(first("from").alias("sender"), first("to").alias("receiver"))


def claims(evidence: DataFrame, emails: DataFrame, participants: DataFrame, verified_only: bool = True) -> DataFrame:
    """One row per claim (repeated deliveries once) that the gate keeps: mailbox, act or closing status, title words, due date, owner, requester.

    ``at`` is the instant of the message, which is the order of the fold. The
    owner of a promise or a decision is its sender, that of a request the first
    person addressed; the other one asked for it. Claims without summary and
    messages without a readable time are left out.
    """
    rows = gate(evidence, emails)
    rows = rows.filter("reason is null") if verified_only else rows.filter("reason is null or reason = 'quote_not_found'")
    act = mapped(F.col("attribute"), OPENS)
    due = resolve_due(F.col("evidence_quote"), local_date(F.col("provider_ts")))
    title = F.trim(F.get_json_object("claim", "$.summary"))
    asked = F.col("attribute") == "request.action"
    owner, other = F.when(asked, F.col("receiver")).otherwise(F.col("sender")), F.when(asked, F.col("sender")).otherwise(F.col("receiver"))
    out = rows.join(parties_of(participants), "source_email_id", "left").select(
        "id", "user_id", "thread_id", "source_email_id", "attribute", act.alias("act"), mapped(F.col("attribute"), CLOSES).alias("closes"), title.alias("title"), title_tokens(title).alias("words"),
        instant(F.col("provider_ts")).alias("at"), due["due"].alias("due"), due["confidence"].alias("due_confidence"), owner["person_id"].alias("owner_person_id"), other["person_id"].alias("requester_person_id"),
        F.when(owner["person_id"].isNotNull(), F.coalesce(owner["is_user"], F.lit(False))).alias("owner_is_self"), "evidence_quote", "observed_at",
    )
    return out.filter("title is not null and title != '' and at is not null and (act is not null or closes is not null)")


def _key() -> Column:
    return match_key(F.col("act"), F.col("owner_person_id"), F.col("title"))


def exact_items(claim: DataFrame) -> DataFrame:
    """Work items by exact key (mailbox, act, owner, title words): one aggregation and one join with the closings.

    An item is closed by the first closing claim of its mailbox and title words
    at or after its opening.
    """
    order = F.struct("at", "id")
    first = lambda c: F.min_by(c, order).alias(c)
    opened = (
        claim.filter("act is not null")
        .groupBy("user_id", _key().alias("match_key"))
        .agg(
            F.min_by("id", order).alias("item_id"), first("act"), first("title"), F.min_by(F.array_join("words", " "), order).alias("title_key"), F.min("at").alias("opened_at"), F.max("at").alias("last_at"), F.count("*").alias("claims"), F.count_distinct("thread_id").alias("threads"),
            F.max_by("due", F.when(F.col("due").isNotNull(), F.struct("due_confidence", "at", "id"))).alias("due"), first("owner_person_id"), first("requester_person_id"), first("owner_is_self"), first("source_email_id"), first("thread_id"),
        )
    )
    closing = claim.filter("closes is not null").select("user_id", F.array_join("words", " ").alias("title_key"), F.col("at").alias("closed_at"), F.col("id").alias("closing_id"), "closes")
    ends = opened.select("user_id", "match_key", "title_key", "opened_at").join(closing, ["user_id", "title_key"]).filter("closed_at >= opened_at").groupBy("user_id", "match_key").agg(F.min_by(F.struct("closes", "closed_at"), F.struct("closed_at", "closing_id")).alias("end"))
    return opened.join(ends, ["user_id", "match_key"], "left").select(
        "item_id", "user_id", "act", "match_key", "title", "opened_at", "last_at", "claims", "threads", "due", "owner_person_id", "requester_person_id", "owner_is_self", F.col("owner_person_id").isNotNull().alias("owner_resolved"), "source_email_id", "thread_id",
        F.coalesce("end.closes", F.lit("OPEN")).alias("status"), F.col("end.closed_at").alias("closed_at"),
    )


def exact_changes(claim: DataFrame) -> DataFrame:
    """(user_id, match_key, change_type, old_value, new_value, evidence_id, changed_at): what each claim changed in its item, by exact key.

    ``opened``; ``due_moved`` when a claim's due date differs from the one in
    force and is at least as sure (so the dates in force are those that are as
    sure as any before); ``value_superseded`` for each later decision;
    ``resolved`` and ``cancelled`` for closing claims at or after the opening.
    Values are JSON. Two windows over one partitioning, and one join.
    """
    keyed = claim.filter("act is not null").withColumn("match_key", _key())
    w = Window.partitionBy("user_id", "match_key").orderBy("at", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = keyed.withColumns({"place": F.row_number().over(w), "surest": F.coalesce(F.max(F.when(F.col("due").isNotNull(), F.col("due_confidence"))).over(before), F.lit(0.0))})
    # The opening sets the date in force even where it has none; later claims without a date set nothing.
    rows = rows.withColumn("sets", (F.col("place") == 1) | (F.col("due").isNotNull() & (F.col("due_confidence") >= F.col("surest"))))
    held = F.last(F.when(F.col("sets"), F.struct("due")), ignorenulls=True).over(before)["due"]
    rows = rows.withColumn("held", held)
    quoted = lambda name, c: F.to_json(F.struct(c.alias(name)), {"ignoreNullFields": "false"})
    none = F.lit(None).cast("string")
    parts = F.array_compact(
        F.array(
            F.when(F.col("place") == 1, F.struct(F.lit("opened").alias("change_type"), none.alias("old_value"), quoted("title", F.col("title")).alias("new_value"))),
            F.when((F.col("place") > 1) & F.col("sets") & ~F.col("due").eqNullSafe(F.col("held")), F.struct(F.lit("due_moved").alias("change_type"), quoted("due_at", F.col("held")).alias("old_value"), quoted("due_at", F.col("due")).alias("new_value"))),
            F.when((F.col("place") > 1) & (F.col("attribute") == "decision.value"), F.struct(F.lit("value_superseded").alias("change_type"), none.alias("old_value"), quoted("evidence_id", F.col("id")).alias("new_value"))),
        )
    )
    moved = rows.select("user_id", "match_key", F.explode(parts).alias("p"), F.col("id").alias("evidence_id"), F.col("at").alias("changed_at")).select("user_id", "match_key", "p.*", "evidence_id", "changed_at")
    opened = rows.filter("place = 1").select("user_id", "match_key", F.array_join("words", " ").alias("title_key"), F.col("at").alias("opened_at"))
    closing = claim.filter("closes is not null").select("user_id", F.array_join("words", " ").alias("title_key"), "closes", F.col("id").alias("evidence_id"), F.col("at").alias("changed_at"))
    closed = opened.join(closing, ["user_id", "title_key"]).filter("changed_at >= opened_at")
    kind = F.when(F.col("closes") == "RESOLVED", "resolved").otherwise("cancelled")
    return moved.unionByName(closed.select("user_id", "match_key", kind.alias("change_type"), none.alias("old_value"), quoted("status", F.col("closes")).alias("new_value"), "evidence_id", "changed_at"))


# --- answers -------------------------------------------------------------------


def answer_base(items: DataFrame, claim: DataFrame, emails: DataFrame, people: DataFrame, threads: DataFrame) -> DataFrame:
    """The columns that every question shows: the item, its owner and requester, its thread, its first mail and the quote that proves it.

    An item whose first mail is unknown is left out. The quote is that of the
    item's first verified claim by ``observed_at``, then id.
    """
    person = people.filter("id is not null").groupBy("id").agg(F.min("canonical_name").alias("name"))
    mail = emails.filter("id is not null").groupBy("id").agg(F.min(F.struct("provider_message_id", "subject")).alias("m"))
    quote = claim.filter("act is not null").groupBy("user_id", _key().alias("match_key")).agg(F.min_by("evidence_quote", F.struct(instant(F.col("observed_at")), "id")).alias("evidence_quote"))
    known = threads.select(F.col("id").alias("origin")).distinct()
    return (
        items.join(person.select(F.col("id").alias("owner_person_id"), F.col("name").alias("owner_name")), "owner_person_id", "left")
        .join(person.select(F.col("id").alias("requester_person_id"), F.col("name").alias("requester_name")), "requester_person_id", "left")
        .join(known, F.col("thread_id") == F.col("origin"), "left")
        .join(mail.select(F.col("id").alias("source_email_id"), "m"), "source_email_id")
        .join(quote, ["user_id", "match_key"], "left")
        .select(
            F.col("item_id").alias("work_item_id"), "user_id", "title", F.col("act").alias("speech_act"), "status", F.col("due").alias("due_at"), "owner_is_self", "owner_resolved", F.col("last_at").alias("last_activity_at"), "opened_at", "owner_name", "requester_name",
            F.col("origin").alias("thread_id"), F.col("m.provider_message_id").alias("anchor_message_id"), F.col("m.subject").alias("subject"), "evidence_quote",
        )
    )


# --- the full fold -------------------------------------------------------------


class Mailbox:
    """The items of one mailbox while its claims are replayed."""

    def __init__(self):
        self.items: list[dict] = []
        self.of_key: dict[tuple, int] = {}
        self.of_thread: dict[str | None, list[int]] = {}
        self.of_word: dict[tuple, list[int]] = {}

    def similar(self, act: str, owner: str | None, words: frozenset[str]) -> int | None:
        """The oldest item of the act and owner whose words agree to 0.6; only items that share a word can."""
        met = {i for w in words for i in self.of_word.get((act, owner, w), ())}
        return min((i for i in met if agreement(self.items[i]["words"], words) >= 0.6), default=None)

    def take(self, c: dict) -> list[tuple[int, str, object, object]]:
        """Apply one claim; returns the changes as (item, kind, old, new)."""
        words = frozenset(c["words"] or ())
        return self._close(c, words) if c["closes"] else self._open(c, words)

    def _open(self, c: dict, words: frozenset[str]) -> list[tuple[int, str, object, object]]:
        act, owner = c["act"], c["owner_person_id"]
        i = self.of_key.get((act, owner, words))
        i = self.similar(act, owner, words) if i is None else i
        if i is not None:
            return self._repeat(i, c)
        i = len(self.items)
        self.items.append(
            {"item_id": c["id"], "act": act, "title": c["title"], "words": words, "status": "OPEN", "opened_at": c["at"], "closed_at": None, "last_at": c["at"], "due": c["due"], "sure": c["due_confidence"] or 0.0, "claims": 1, "threads": set(), "owner": owner, "self": c["owner_is_self"], "decided": act == "decision"}
        )
        self.of_key[act, owner, words] = i
        for w in words:
            self.of_word.setdefault((act, owner, w), []).append(i)
        self._join(i, c["thread_id"])
        return [(i, "opened", None, {"title": c["title"], "due_at": c["due"]})]

    def _repeat(self, i: int, c: dict) -> list[tuple[int, str, object, object]]:
        it, out = self.items[i], []
        if c["due"] and c["due"] != it["due"] and c["due_confidence"] >= it["sure"]:
            out.append((i, "due_moved", {"due_at": it["due"]}, {"due_at": c["due"]}))
            it["due"], it["sure"] = c["due"], c["due_confidence"]
        if c["attribute"] == "decision.value":
            if it["decided"]:
                out.append((i, "value_superseded", None, {"evidence_id": c["id"]}))
            it["decided"] = True
        if c["owner_person_id"] and not it["owner"]:
            out.append((i, "owner_changed", {"owner_person_id": None}, {"owner_person_id": c["owner_person_id"]}))
            it["owner"], it["self"] = c["owner_person_id"], c["owner_is_self"]
        it["claims"] += 1
        it["last_at"] = max(it["last_at"], c["at"])
        self._join(i, c["thread_id"])
        return out

    def _join(self, i: int, thread: str | None) -> None:
        if thread not in self.items[i]["threads"]:
            self.items[i]["threads"].add(thread)
            self.of_thread.setdefault(thread, []).append(i)

    def _close(self, c: dict, words: frozenset[str]) -> list[tuple[int, str, object, object]]:
        i = self._answered(c, words)
        if i is None:
            return []
        it = self.items[i]
        it["claims"] += 1
        if it["status"] == "OPEN":
            it["status"], it["closed_at"], it["last_at"] = c["closes"], c["at"], c["at"]
        return [(i, "resolved" if c["closes"] == "RESOLVED" else "cancelled", None, {"status": c["closes"]})]

    def _answered(self, c: dict, words: frozenset[str]) -> int | None:
        """What a closing claim is about: the open item of its thread that agrees best, to 0.25 at least, else the thread's newest, else a near request or promise of its owner anywhere."""
        here = [i for i in self.of_thread.get(c["thread_id"], ()) if self.items[i]["status"] == "OPEN"]
        if here:
            newest = max(here, key=lambda i: (self.items[i]["opened_at"], -i))
            best = max(here, key=lambda i: (agreement(self.items[i]["words"], words), self.items[i]["opened_at"], -i))
            return best if agreement(self.items[best]["words"], words) >= 0.25 else newest
        found = (self.similar(act, c["owner_person_id"], words) for act in ("request", "commitment"))
        return next((i for i in found if i is not None), None)


def agreement(a: frozenset[str], b: frozenset[str]) -> float:
    """Jaccard similarity; 0 if either is empty."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if both else 0.0


FOLD_SCHEMA = (
    "row_kind string, user_id string, item_id string, kind string, title string, status string, at timestamp, last_at timestamp, closed_at timestamp, due date, claims int, threads int, owner_person_id string, owner_is_self boolean, is_unconfirmed boolean, claim_id string, old_value string, new_value string"
)
FOLD_COLUMNS = [x.split()[0] for x in FOLD_SCHEMA.split(", ")]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    user, box, out = None, Mailbox(), []
    text = lambda v: None if v is None else json.dumps(v, default=str, separators=(",", ":"), ensure_ascii=False)

    def items() -> Iterator[tuple]:
        for it in box.items:
            yield ("item", user, it["item_id"], it["act"], it["title"], it["status"], it["opened_at"], it["last_at"], it["closed_at"], it["due"], it["claims"], len(it["threads"]), it["owner"], it["self"], it["owner"] is None, None, None, None)

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * len(FOLD_COLUMNS)
        out.clear()
        ts = pa.timestamp("us", tz="UTC")
        kinds = [*[pa.string()] * 6, ts, ts, ts, pa.date32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), *[pa.string()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=FOLD_COLUMNS)

    for batch in batches:
        for c in batch.to_pylist():
            if c["user_id"] != user:
                out.extend(items())
                user, box = c["user_id"], Mailbox()
            for i, kind, old, new in box.take(c):
                out.append(("change", user, box.items[i]["item_id"], kind, None, None, c["at"], None, None, None, None, None, None, None, None, c["id"], text(old), text(new)))
            if len(out) > 10_000:
                yield flush()
    out.extend(items())
    yield flush()


def full_fold(claim: DataFrame) -> DataFrame:
    """Items (row_kind ``item``) and the change log (``change``) of the full replay in (instant, id) order."""
    cols = ["user_id", "at", "id", "thread_id", "attribute", "act", "closes", "title", "words", "due", "due_confidence", "owner_person_id", "owner_is_self"]
    return claim.select(*cols).repartition("user_id").sortWithinPartitions("user_id", "at", "id").mapInArrow(_fold, FOLD_SCHEMA)


def attention(items: DataFrame, as_of: Column) -> DataFrame:
    """Scores of open items: urgency, importance, staleness and commitment, rounded to three places, and the reason."""
    days = F.datediff(as_of.cast("date"), F.col("due"))  # positive: past
    quiet = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("last_at")) / 86400)
    urgency = F.when(F.col("due").isNull(), 0.25).when(days > 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 + days / 14.0))
    importance = F.least(F.lit(1.0), 0.3 + 0.2 * F.greatest("claims", F.lit(1)) + 0.2 * (F.greatest("threads", F.lit(1)) - 1))
    staleness = F.least(F.lit(1.0), F.greatest(F.lit(0.0), quiet / 21.0))
    own = F.coalesce("owner_is_self", F.lit(False))
    commitment = F.when(own & (F.col("act") == "commitment"), 1.0).when(own, 0.6).otherwise(0.2)
    basis = F.when(F.col("due").isNotNull() & (days > 0), "overdue").when(F.col("due").isNotNull() & (days >= -3), "due_soon").when(quiet >= 14, "stale").otherwise("unanswered_request")
    reason = F.when(own & (F.col("act") == "commitment"), "unfulfilled_commitment").otherwise(basis)
    r = lambda c: F.round(c, 3)
    score = 0.40 * r(urgency) + 0.25 * r(importance) + 0.20 * r(staleness) + 0.15 * r(commitment)
    return items.filter("status = 'OPEN'").select("*", reason.alias("reason"), r(urgency).alias("urgency"), r(importance).alias("importance"), r(staleness).alias("staleness"), commitment.alias("commitment"), F.round(score, 4).alias("score"))
