"""Instants, local dates, and dates mentioned in texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The words of the forms in which dates are mentioned.
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
BEFORE_WEEKDAY = "next|this|by|on|before"
END_OF_DAY = r"\b(eod|cob|asap|end of (the )?day)\b"
END_OF_WEEK = r"\b(eow|end of (the )?week)\b"

MENTION = "array<struct<at:int,text:string,kind:string,resolved:date>>"


def instant(c: Column) -> Column:
    """ISO-8601 text of any offset as an instant; null where it is none."""
    return F.try_to_timestamp(F.trim(c))


def local_date(c: Column) -> Column:
    """The writer's own date: the text's first ten characters; null where they are none."""
    return F.try_to_date(F.substring(F.trim(c), 1, 10))


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days between two instants."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)


#: Forms of a due phrase that name a day, as regular expressions on lower-case text.
DAY_FORMS = {
    "today": r"\b(today|tonight)\b",
    "tomorrow": r"\btomorrow\b",
    "yesterday": r"\byesterday\b",
    "weekday": rf"\b(?:(?:{BEFORE_WEEKDAY})\s+)?({'|'.join(WEEKDAYS)})\b",
    "iso": r"\b(\d{4}-\d{2}-\d{2})\b",
}


def resolve_due(text: Column, day: Column) -> Column:
    """struct(due, confidence) of a due phrase, by the writer's date.

    The first mention of a day decides, wherever it stands in the phrase: an ISO
    date is sure (0.9); today, tomorrow, yesterday and weekdays (the next one
    strictly after the day) less so (0.7). Without one, the end of the day (the
    same day) or of the week (its Friday) count 0.5; else null and 0. Null
    phrases and days that are no dates give null.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    weekday = F.substring(F.regexp_extract(t, DAY_FORMS["weekday"], 1), 1, 3)
    when = {
        "today": day,
        "tomorrow": F.date_add(day, 1),
        "yesterday": F.date_sub(day, 1),
        "weekday": F.call_function("next_day", day, F.nullif(weekday, F.lit(""))),
        "iso": F.try_to_date(F.nullif(F.regexp_extract(t, DAY_FORMS["iso"], 1), F.lit(""))),
    }
    found = [F.struct(F.regexp_instr(t, F.lit(p)).alias("at"), when[k].alias("due"), F.lit(0.9 if k == "iso" else 0.7).alias("confidence")) for k, p in DAY_FORMS.items()]
    first = F.array_min(F.filter(F.array(*found), lambda x: (x["at"] > 0) & x["due"].isNotNull()))
    friday = F.date_add(day, F.pmod(F.lit(4) - F.weekday(day), F.lit(7)).cast("int"))
    soft = F.when(t.rlike(END_OF_DAY), day).when(t.rlike(END_OF_WEEK), friday)
    return F.struct(F.coalesce(first["due"], soft).alias("due"), F.when(first.isNotNull(), first["confidence"]).when(soft.isNotNull(), 0.5).otherwise(0.0).alias("confidence"))


#: One scan for all forms: what comes first in the alternation wins at its place.
_MENTIONS = re.compile(
    rf"\b(?:(?P<today>today|tonight)|(?P<tomorrow>tomorrow)|(?P<yesterday>yesterday)|(?:(?:{BEFORE_WEEKDAY})\s+)?(?P<weekday>{'|'.join(WEEKDAYS)})"
    r"|(?P<fuzzy>eod|eow|cob|asap|end of (?:the )?(?:day|week|month|quarter))|(?P<iso>\d{4}-\d{2}-\d{2})"
    rf"|(?P<monthday>(?:{'|'.join(MONTHS)})[a-z]*\.?\s+\d{{1,2}}(?:st|nd|rd|th)?))\b",
    re.I,
)


def _iso(text: str) -> date | None:
    try:
        return date.fromisoformat(text)
    except ValueError:
        return None


_RESOLVE = {
    "today": lambda m, day: day,
    "tomorrow": lambda m, day: day + timedelta(days=1),
    "yesterday": lambda m, day: day - timedelta(days=1),
    "weekday": lambda m, day: day + timedelta(days=(WEEKDAYS.index(m["weekday"].lower()) - day.weekday() + 6) % 7 + 1),
    "iso": lambda m, day: _iso(m["iso"]),
}


def mentions(text: str | None, day: date | None, most: int = 20) -> list[dict]:
    """Dates mentioned in a text, by offset, at most ``most``; fuzzy forms and month with day stay unresolved. Nothing without text or day."""
    out: list[dict] = []
    for m in _MENTIONS.finditer(text or "") if day else ():
        kind = m.lastgroup
        out.append({"at": m.start(), "text": m.group(), "kind": kind, "resolved": _RESOLVE[kind](m, day) if kind in _RESOLVE else None})
        if len(out) == most:
            break
    return out


def with_mentions(rows: DataFrame, text: str, day: str, out: str = "mentions") -> DataFrame:
    """Adds the dates mentioned in a text: one Arrow stage, since built-in functions give no offsets of all matches."""
    kind = pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string()), ("kind", pa.string()), ("resolved", pa.date32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [mentions(t, d) for t, d in zip(b.column(text).to_pylist(), b.column(day).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, kind)], names=[*b.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T._parse_datatype_string(MENTION))]))
