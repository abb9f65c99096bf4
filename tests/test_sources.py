import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillfold.functions import message
from quillfold.functions.message import api_messages
from quillfold.sources import export, mailbox

GOOD = {"id": "0123456789abcdef", "thread_id": "0123456789abcdef", "profile_id": "p", "message_id_header": "<a@b>", "thread_position": 1, "thread_length": 1, "from": {"name": "A", "email": "Me@x.io"}, "to": [{"name": None, "email": "b@x.io"}, {"name": "C", "email": " "}], "cc": [], "subject": "Hi", "body_text": "New\n> old", "date": "2026-01-01T00:00:00Z", "internal_date_ms": 1, "folder": "INBOX", "category": "CATEGORY_PERSONAL", "is_unread": True, "user_labels": ["x"], "extra_headers": {"List-ID": "l"}}


@pytest.fixture
def messages(spark, tmp_path):
    bad = GOOD | {"id": "short", "in_reply_to": "<z>", "folder": "SENT"}
    (tmp_path / "m.jsonl").write_text("\n".join([json.dumps(GOOD), "", "not json", json.dumps(bad)]))
    return mailbox.read_messages(spark, str(tmp_path / "m.jsonl"))


def test_read_flatten_and_roles(spark, messages):
    good, rejects = messages
    assert good.count() == 2 and [r.text for r in rejects.collect()] == ["not json"]
    flat = {r.id: r for r in mailbox.flatten(good, spark.createDataFrame([("p", "me@x.io")], "profile_id string, address string")).collect()}
    assert flat["0123456789abcdef"].direction == "outbound" and flat["0123456789abcdef"].body_text_novel == "New"
    roles = {(r.part_role, r.part_no, r.address) for r in mailbox.explode_roles(good).filter("email_id != 'short'").collect()}
    assert roles == {("from", 0, "me@x.io"), ("to", 0, "b@x.io")}


def test_shape_and_rules(messages):
    good, _ = messages
    m = {r.id: r for r in api_messages(good).collect()}["0123456789abcdef"]
    assert m.labelIds == ["INBOX", "UNREAD", "CATEGORY_PERSONAL", "x"] and [(p.part_id, p.mime_type, p.data) for p in m.payload.parts] == [("", "text/plain", "TmV3Cj4gb2xk")]
    assert [h.name for h in m.payload.headers] == ["MIME-Version", "Date", "Message-ID", "Subject", "From", "To", "List-ID", "Content-Type"]
    assert {r.rule for r in mailbox.violations(good).filter("id = 'short'").collect()} >= {"root_has_parent", "parent_not_referenced", "sent_with_category", "sent_unread", "bad_id"}
    assert {r.rule for r in mailbox.violations(good).filter("id != 'short'").collect()} == {"clock_drift"}


def full(**more):
    base = {"id": "00000000000000aa", "thread_id": "00000000000000aa", "profile_id": "p", "history_id": "1", "message_id_header": "<a@x>", "thread_position": 1, "thread_length": 2, "from": {"name": "A", "email": "a@x.io"}, "to": [{"name": "B", "email": "b@x.io"}], "cc": [], "bcc": [], "subject": "Plan", "snippet": "", "body_text": "The plan.", "date": "2026-07-01T09:30:00+02:00", "internal_date_ms": 1782891000000, "folder": "INBOX", "category": "CATEGORY_PERSONAL", "is_unread": True, "user_labels": [], "extra_headers": {}}
    return base | more


EVENT = {"uid": "u1", "method": "REQUEST", "sequence": 0, "summary": "Talk", "description": "a\nb", "location": "Hall", "organizer": {"name": None, "email": "o@x.io"}, "attendees": [{"email": "b@x.io", "name": "B", "role": "REQ-PARTICIPANT", "partstat": "ACCEPTED", "rsvp": True}], "dtstart": "2026-07-02T10:00:00", "dtend": "2026-07-02T11:00:00", "timezone": "Europe/Berlin", "rrule": None, "status": "CONFIRMED"}
FILE = {"attachment_id": "x1", "filename": "a.pdf", "mime_type": "application/pdf", "size_bytes": 900, "is_inline": False}


def load(spark, tmp_path, rows):
    (tmp_path / "full.jsonl").write_text("\n".join(map(json.dumps, rows)))
    return mailbox.read_messages(spark, str(tmp_path / "full.jsonl"))[0]


@pytest.mark.parametrize(
    "more,parts",
    [
        ({}, [("", "text/plain")]), ({"attachments": [FILE]}, [("", "multipart/mixed"), ("0", "text/plain"), ("1", "application/pdf")]), ({"body_html": "<p>x</p>"}, [("", "multipart/alternative"), ("0.0", "text/plain"), ("0.1", "text/html")]),
        ({"body_html": "<p>x</p>", "calendar_event": EVENT}, [("", "multipart/alternative"), ("0.0", "text/plain"), ("0.1", "text/html"), ("0.2", "text/calendar")]),
        ({"calendar_event": EVENT, "attachments": [FILE]}, [("", "multipart/mixed"), ("0", "multipart/alternative"), ("0.0", "text/plain"), ("0.1", "text/calendar"), ("1", "application/pdf")]),
    ],
)
def test_mime_tree(spark, tmp_path, more, parts):
    m = api_messages(load(spark, tmp_path, [full(**more)])).first()
    assert [(p.part_id, p.mime_type) for p in m.payload.parts] == parts
    headers = "".join(f"{h.name}: {h.value}" for h in m.payload.headers)
    size = len(b"The plan.") + len(more.get("body_html", "")) + len(headers) + sum(int(a["size_bytes"] * 4 / 3) for a in more.get("attachments", [])) + 512
    assert m.sizeEstimate == size and ("Date: Wed, 01 Jul 2026 09:30:00 +0200" in headers)


def test_calendar_text(spark, tmp_path):
    text = load(spark, tmp_path, [full(calendar_event=EVENT)]).select(message.ics(F.col("calendar_event")).alias("t")).first().t.split("\r\n")
    assert text[0] == "BEGIN:VCALENDAR" and text[-1] == "END:VCALENDAR" and "DTSTART;TZID=Europe/Berlin:20260702T100000" in text and "DESCRIPTION:a\\nb" in text and not any(x.startswith("RRULE") for x in text)
    assert "ORGANIZER;CN=o@x.io:mailto:o@x.io" in text and "ATTENDEE;CUTYPE=INDIVIDUAL;ROLE=REQ-PARTICIPANT;PARTSTAT=ACCEPTED;RSVP=TRUE;CN=B;X-NUM-GUESTS=0:mailto:b@x.io" in text
    assert load(spark, tmp_path, [full()]).select(message.ics(F.col("calendar_event")).alias("t")).first().t is None


def test_render_and_attachment_ids(spark, tmp_path):
    m = load(spark, tmp_path, [full(attachments=[FILE | {"size_bytes": 12345}], meta={"tricky_tags": ["long_thread"]})])
    got = m.select(message.render(20).alias("t"), message.attachment_id(F.col("id"), F.lit("a.pdf")).alias("a")).first()
    assert got.t.split("\n") == ["From:    A <a@x.io>", "To:      B <b@x.io>", "Date:    Wed, 01 Jul 2026 09:30 +0200", "Subject: Plan", "Folder:  INBOX / CATEGORY_PERSONAL / UNREAD", "Attach:  a.pdf (12,345B)", "Tricky:  long_thread", "-" * 20, "The plan.", ""]
    want = base64.urlsafe_b64encode(hashlib.sha256(b"00000000000000aa:a.pdf").digest()).decode().rstrip("=")[:56]
    assert got.a == "ANGjdJ_" + want


def test_threads_replies_and_statistics(spark, tmp_path):
    reply = full(id="00000000000000ab", message_id_header="<b@x>", in_reply_to="<a@x>", references=["<a@x>"], thread_position=2, date="2026-07-02T09:30:00+02:00", internal_date_ms=1782977400000, meta={"tricky_tags": ["long_thread"], "is_actionable_for_user": True})
    odd = full(id="00000000000000ac", thread_id="00000000000000ff", message_id_header="<c@x>", in_reply_to="<z@x>", thread_position=2, thread_length=3, profile_id="q", date="2026-06-01T00:00:00Z")
    late = reply | {"id": "00000000000000ad", "message_id_header": "<d@x>", "thread_position": 3, "in_reply_to": "<b@x>", "references": [], "date": "2026-07-01T09:30:00+02:00"}
    m = load(spark, tmp_path, [full(), reply, odd])
    assert {tuple(r) for r in mailbox.thread_violations(m).collect()} == {("00000000000000ff", "wrong_length"), ("00000000000000ff", "position_gap"), ("00000000000000ff", "no_root")}
    assert {tuple(r) for r in mailbox.reply_violations(m).collect()} == {("00000000000000ac", "parent_unknown")}
    assert {r.rule for r in mailbox.reply_violations(load(spark, tmp_path, [full(), reply, late])).collect()} == {"not_after_parent", "wrong_references"}
    m = load(spark, tmp_path, [full(), reply, odd])
    s = {r.profile_id: r for r in mailbox.corpus_statistics(m, "2026-07-01").collect()}
    assert (s["p"].messages, s["p"].threads, s["p"].recent_pct, s["p"].median_words, s["p"].folders, s["p"].tags) == (2, 1, 100.0, 2, {"INBOX": 2}, {"long_thread": 1}) and s["q"].tags is None
    t = {r.id: r for r in message.api_threads(message.resequenced(m)).collect()}["00000000000000aa"]
    assert t.historyId == "1000014" and [x.id for x in t.messages] == ["00000000000000aa", "00000000000000ab"]
    assert mailbox.read_mailboxes(spark, str(tmp_path / "full.jsonl"), ["p"], tag="long_thread").count() == 1


def test_batches(spark, tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    (d / "a.json").write_text(json.dumps([full(), full(id="00000000000000ab")]))
    (d / "b.json").write_text(json.dumps([full()]))
    (d / "c.json").write_text("{not json")
    good, problems = mailbox.read_batches(spark, str(d), expected=2)
    assert good.count() == 3 and {(r.file.rsplit("/", 1)[-1], r.rule) for r in problems.collect()} == {("b.json", "record_count"), ("c.json", "unreadable")}


def test_gold_files(spark, tmp_path):
    item = {"item_id": "p-q1-01", "tier": "must_include", "anchor_message_id": "m1", "message_ids": ["m1", "m2"], "tricky_tags": ["t"], "due_basis": "none", "due_date": None}
    bad = item | {"item_id": "p-q2-01", "anchor_message_id": "m9", "due_date": "2026-01-01"}
    doc = {"profile_id": "p", "as_of": "x", "answers": {"q1_needs": {"question": "?", "ranked": ["p-q1-01", "p-q1-01", "zz"], "items": [item, bad], "must_not_include": [{"message_id": "m2", "subject": "s", "trap": "x"}]}}}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    gold, ids, tags = export.read_gold(spark, str(tmp_path / "g.json"))
    assert {(r.gold_id, r.tier) for r in gold.collect()} == {("p-q1-01", "must_include"), ("p-q2-01", "must_include"), ("p-q1_needs-trap-0", "must_not_include")}
    assert {(r.gold_id, r.message_id) for r in ids.collect()} >= {("p-q2-01", "m9"), ("p-q1_needs-trap-0", "m2")} and tags.count() == 2
    rules = {(r.item_id, r.rule) for r in export.gold_violations(spark, str(tmp_path / "g.json")).collect()}
    assert rules == {("p-q1-01", "evidence_is_trap"), ("p-q2-01", "evidence_is_trap"), ("p-q2-01", "wrong_prefix"), ("p-q2-01", "anchor_not_cited"), ("p-q2-01", "due_without_basis"), ("p-q2-01", "not_ranked"), (None, "ranked_twice"), (None, "ranked_unknown")}


def test_exports_runs_and_reports(spark, tmp_path):
    m = load(spark, tmp_path, [full(), full(id="00000000000000ab", internal_date_ms=1)])
    export.emit_corpus(m, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out" / "canonical"))
    assert [r.history_id for r in back.orderBy("internal_date_ms").collect()] == ["1000007", "1000014"] and list((tmp_path / "out" / "canonical").glob("*.json.gz"))
    assert export.export_tables({"t": spark.createDataFrame([("u", 1), ("v", 2)], "user_id string, n int")}, str(tmp_path / "db")) == {"t": 2}
    assert export.markdown(spark.createDataFrame([("a|b", None)], "x string, y int"), "R").split("\n")[2:5] == ["| x | y |", "|---|---|", "| a\\|b |  |"]
    with pytest.raises(ValueError):
        export.markdown(spark.range(300), "big")
    runs = export.Runs(spark, str(tmp_path / "runs"))
    done = []
    runs.run({"load": lambda s: (done.append("load"), s.update(items_out=3)), "fold": lambda s: done.append("fold")})
    with pytest.raises(RuntimeError):
        runs.run({"load": lambda s: (_ for _ in ()).throw(RuntimeError("no")), "fold": lambda s: done.append("never")})
    assert done == ["load", "fold"] and {(r.stage, r.status) for r in runs.last().collect()} == {("load", "failed"), ("fold", "ok")}
    with pytest.raises(ValueError):
        runs.run({"load": print}, ["what"])
    b = export.Budget(1.0)
    for _ in range(9):
        if b.over:
            break
        b.add("call", 0.4)
    assert b.calls == {"call": 3} and b.over


def test_guard(spark):
    df, n = mailbox.guarded_sql(spark, "select id from range(200);", 50)
    assert n() == 200 and df.count() == 50
    assert mailbox.guarded_sql(spark, "with t as (select 'Insert; coin' as c) select 'a;b' as x, c from t")[0].first() == ("a;b", "Insert; coin")
    for bad in ("drop table x", "select 1; select 2", "insert into t values (1)", "with a as (select 1 as x) insert into t select * from a", "create table z as select 1", "", None, "set x=1"):
        with pytest.raises(ValueError):
            mailbox.guarded_sql(spark, bad)


def test_router(spark, small):
    from quillfold.plans import toolq

    trace = []
    rows, hint = toolq.call_tool(spark, small, "get_schema", trace)
    assert rows.count() > 50 and hint == ""
    assert toolq.call_tool(spark, small, "mail_from_person", trace, needle="zzzzzz")[1].startswith("try")
    assert toolq.call_tool(spark, small, "run_sql", trace, statement="drop table emails")[0] is None
    assert toolq.call_tool(spark, small, "run_sql", trace, statement="select count(*) as n from emails")[0].first().n > 0
    assert toolq.call_tool(spark, small, "what", trace)[0] is None and toolq.call_tool(spark, small, "read_thread", trace, nonsense=1)[0] is None
    assert [t["ok"] for t in trace] == [True, True, False, True, False, False] and len(toolq.tools()) == 12
