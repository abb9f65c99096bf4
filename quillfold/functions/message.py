"""Canonical messages in the shape of a mail API: headers, MIME parts, calendar text, sizes, attachment ids, and as plain text.

All are Column expressions over the columns of ``sources.mailbox.MESSAGE``, so a
projection of a mailbox stays one stage without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.functions.text import address, urlsafe_b64

PLAIN = 'text/plain; charset="UTF-8"'
# The lines that every calendar text begins with.
CALENDAR = ("BEGIN:VCALENDAR", "PRODID:-//Google Inc//Google Calendar 70.9054//EN", "VERSION:2.0", "CALSCALE:GREGORIAN")


def _people(c: str) -> Column:
    """An address list as one header value; null if there is none."""
    return F.nullif(F.array_join(F.transform(F.coalesce(F.col(c), F.array()), lambda p: address(p["name"], p["email"])), ", "), F.lit(""))


def _one(c: str) -> Column:
    return F.when(F.col(f"`{c}`.email").isNotNull(), address(F.col(f"`{c}`.name"), F.col(f"`{c}`.email")))


def rfc_date(c: Column) -> Column:
    """An ISO date text with offset as a mail header shows it."""
    local = F.to_timestamp_ntz(F.substring(F.replace(c, F.lit("T"), F.lit(" ")), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    zone = F.regexp_replace(F.regexp_extract(c, r"(Z|[+-]\d{2}:?\d{2})$", 1), ":", "")
    return F.concat(F.date_format(local, "EEE, dd MMM yyyy HH:mm:ss "), F.when(zone.isin("", "Z"), "+0000").otherwise(zone))


def _boundary() -> Column:
    return F.concat(F.lit('; boundary="000000000000'), F.substring("id", 1, 12), F.lit('"'))


def content_type() -> Column:
    mixed = (F.size("attachments") > 0) | F.col("calendar_event").isNotNull()
    return F.when(mixed, F.concat(F.lit("multipart/mixed"), _boundary())).when(F.coalesce(F.col("body_html"), F.lit("")) != "", F.concat(F.lit("multipart/alternative"), _boundary())).otherwise(PLAIN)


def headers() -> Column:
    """array<struct<name,value>> in the usual order; headers without a value are left out, extra ones come before the content type."""
    some = lambda n, v: F.when(v.isNotNull() & (v != ""), F.struct(F.lit(n).alias("name"), v.alias("value")))
    first = F.array(
        some("Delivered-To", F.col("delivered_to")), some("MIME-Version", F.lit("1.0")), some("Date", rfc_date(F.col("date"))), some("Message-ID", F.col("message_id_header")), some("In-Reply-To", F.col("in_reply_to")), some("References", F.array_join(F.coalesce("references", F.array().cast("array<string>")), " ")),
        some("Subject", F.col("subject")), some("From", _one("from")), some("Sender", _one("sender")), some("Reply-To", _one("reply_to")), some("To", _people("to")), some("Cc", _people("cc")), some("Bcc", _people("bcc")),
    )
    extra = F.transform(F.map_entries(F.coalesce("extra_headers", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    return F.concat(F.array_compact(first), extra, F.array(F.struct(F.lit("Content-Type").alias("name"), content_type().alias("value"))))


def ics(ev: Column) -> Column:
    """A calendar event as iCalendar text, lines ended by CR LF; null for no event."""
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss")
    name = lambda p: F.coalesce(F.nullif(p["name"], F.lit("")), p["email"])
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    some = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    text = F.array_compact(
        F.array(
            *[F.lit(x) for x in CALENDAR], line("METHOD:", ev["method"]), F.lit("BEGIN:VEVENT"), line("UID:", ev["uid"]), line("DTSTAMP:", stamp(ev["dtstart"]), "Z"),
            line("DTSTART;TZID=", ev["timezone"], ":", stamp(ev["dtstart"])), line("DTEND;TZID=", ev["timezone"], ":", stamp(ev["dtend"])), line("SEQUENCE:", ev["sequence"].cast("string")), line("STATUS:", ev["status"]), line("SUMMARY:", ev["summary"]), F.lit("TRANSP:OPAQUE"),
            some("RRULE:", ev["rrule"]), some("LOCATION:", ev["location"]), some("DESCRIPTION:", F.replace(ev["description"], F.lit("\n"), F.lit("\\n"))), line("ORGANIZER;CN=", name(ev["organizer"]), ":mailto:", ev["organizer"]["email"]),
        )
    )
    guests = F.transform(
        F.coalesce(ev["attendees"], F.array()),
        lambda a: F.concat(F.lit("ATTENDEE;CUTYPE=INDIVIDUAL;ROLE="), a["role"], F.lit(";PARTSTAT="), a["partstat"], F.lit(";RSVP="), F.when(a["rsvp"], "TRUE").otherwise("FALSE"), F.lit(";CN="), name(a), F.lit(";X-NUM-GUESTS=0:mailto:"), a["email"]),
    )
    return F.when(ev.isNotNull(), F.array_join(F.concat(text, guests, F.array(F.lit("END:VEVENT"), F.lit("END:VCALENDAR"))), "\r\n"))


def mime_parts() -> Column:
    """The tree of parts as an array in document order: part id, type, file name, size, data or attachment id.

    Part ids are places in the tree: a single text is the root itself (""); text
    with HTML or a calendar are the children of ``multipart/alternative``, which
    is the root, or part 0 below ``multipart/mixed`` beside attachments.
    """
    html, event = F.coalesce(F.col("body_html"), F.lit("")) != "", F.col("calendar_event").isNotNull()
    attached = F.coalesce(F.size("attachments"), F.lit(0)) > 0
    several = html | event
    data = lambda c: F.struct(F.octet_length(c).cast("long").alias("size"), urlsafe_b64(c).alias("data"))
    nothing = F.lit(None).cast("string")

    def part(where: Column, kind: Column, body: Column) -> Column:
        return F.struct(where.alias("part_id"), kind.alias("mime_type"), F.lit("").alias("filename"), body["size"].alias("size"), body["data"].alias("data"), nothing.alias("attachment_id"))

    holder = lambda where, kind: F.struct(where.alias("part_id"), F.lit(kind).alias("mime_type"), F.lit("").alias("filename"), F.lit(0).cast("long").alias("size"), nothing.alias("data"), nothing.alias("attachment_id"))
    below = F.lit("0.")
    text = part(F.when(several, F.lit("0.0")).when(attached, F.lit("0")).otherwise(F.lit("")), F.lit("text/plain"), data(F.coalesce("body_text", F.lit(""))))
    alt = F.when(several, holder(F.when(attached, F.lit("0")).otherwise(F.lit("")), "multipart/alternative"))
    root = F.when(attached, holder(F.lit(""), "multipart/mixed"))
    page = F.when(html, part(F.concat(below, F.lit("1")), F.lit("text/html"), data(F.col("body_html"))))
    invite = F.when(event, part(F.concat(below, F.when(html, "2").otherwise("1")), F.lit("text/calendar"), data(ics(F.col("calendar_event")))))
    files = F.transform(
        F.coalesce(F.col("attachments"), F.array()),
        lambda a, i: F.struct((i + 1).cast("string").alias("part_id"), a["mime_type"].alias("mime_type"), a["filename"].alias("filename"), a["size_bytes"].alias("size"), nothing.alias("data"), a["attachment_id"].alias("attachment_id")),
    )
    return F.concat(F.array_compact(F.array(root, alt, text, page, invite)), files)


def size_estimate() -> Column:
    """Bytes of the bodies, characters of the headers, attachments in base64, and 512."""
    lines = F.aggregate(headers(), F.lit(0).cast("long"), lambda n, h: n + F.length(h["name"]) + 2 + F.length(h["value"]))
    files = F.aggregate(F.coalesce(F.col("attachments"), F.array()), F.lit(0).cast("long"), lambda n, a: n + F.floor(a["size_bytes"] * 4 / 3))
    return F.octet_length(F.coalesce("body_text", F.lit(""))) + F.octet_length(F.coalesce("body_html", F.lit(""))) + lines + files + 512


def attachment_id(email: Column, filename: Column) -> Column:
    """A stable id of an attachment: a prefix and the hash of the message's id and the file name."""
    return F.concat(F.lit("ANGjdJ_"), F.substring(F.rtrim(F.translate(F.base64(F.unhex(F.sha2(F.concat_ws(":", email, filename), 256))), "+/", "-_"), F.lit("=")), 1, 56))


def render(width: int = 88) -> Column:
    """A message as a reader would show it; lines without content are left out."""
    some = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    where = F.concat(F.col("folder"), F.when(F.col("category").isNotNull(), F.concat(F.lit(" / "), "category")).otherwise(""), F.when(F.col("is_unread"), " / UNREAD").otherwise(""))
    files = F.array_join(F.transform(F.coalesce(F.col("attachments"), F.array()), lambda a: F.concat(a["filename"], F.lit(" ("), F.format_number(a["size_bytes"], 0), F.lit("B)"))), ", ")
    day = F.regexp_replace(rfc_date(F.col("date")), r":\d{2} ([+-])", " $1")
    head = F.array_compact(
        F.array(
            F.concat(F.lit("From:    "), F.coalesce(_one("from"), F.lit(""))), F.concat(F.lit("To:      "), F.coalesce(_people("to"), F.lit("(none)"))), some("Cc:      ", _people("cc")), some("Bcc:     ", _people("bcc")), F.concat(F.lit("Date:    "), day),
            F.concat(F.lit("Subject: "), F.coalesce("subject", F.lit(""))), F.concat(F.lit("Folder:  "), where), some("Attach:  ", files), some("Tricky:  ", F.array_join(F.coalesce("meta.tricky_tags", F.array().cast("array<string>")), ", ")),
        )
    )
    return F.concat(F.array_join(head, "\n"), F.lit("\n" + "-" * width + "\n"), F.coalesce("body_text", F.lit("")), F.lit("\n"))


def labels() -> Column:
    """Label list of a message; an archived one has no folder label."""
    own = F.array_compact(F.array(F.when(F.col("folder") != "ARCHIVE", F.col("folder")), F.when(F.col("is_unread"), "UNREAD"), F.when(F.col("is_starred"), "STARRED"), F.when(F.col("is_important"), "IMPORTANT"), F.col("category")))
    return F.concat(own, F.coalesce("user_labels", F.array().cast("array<string>")))


def api_messages(messages: DataFrame) -> DataFrame:
    """Messages in the shape of a mail API."""
    size = F.when(F.coalesce("size_estimate", F.lit(0)) > 0, F.col("size_estimate")).otherwise(size_estimate())
    return messages.select(
        "id", F.col("thread_id").alias("threadId"), labels().alias("labelIds"), "snippet", F.col("history_id").alias("historyId"), F.col("internal_date_ms").cast("string").alias("internalDate"), F.struct(headers().alias("headers"), mime_parts().alias("parts")).alias("payload"), size.alias("sizeEstimate"), "thread_position"
    )


def api_threads(messages: DataFrame) -> DataFrame:
    """(id, historyId, messages): threads with their messages by position; the history id is the largest text."""
    rows = api_messages(messages)
    each = F.struct("thread_position", *[c for c in rows.columns if c != "thread_position"])
    return rows.groupBy(F.col("threadId").alias("id")).agg(F.max("historyId").alias("historyId"), F.transform(F.array_sort(F.collect_list(each)), lambda m: m.dropFields("thread_position")).alias("messages"))


def resequenced(messages: DataFrame, start: int = 1_000_000, step: int = 7) -> DataFrame:
    """Messages with ``history_id`` numbered anew within each profile by time, and sizes filled in."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("profile_id").orderBy("internal_date_ms", "id"))
    size = F.when(F.coalesce("size_estimate", F.lit(0)) > 0, F.col("size_estimate")).otherwise(size_estimate())
    return messages.withColumns({"history_id": (F.lit(start) + place * step).cast("string"), "size_estimate": size})
