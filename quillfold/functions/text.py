"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about what an obligation is about (grammar, and the verbs of asking and doing).
TITLE_STOP = (
    "the a an to for of on in and or is be please can could would you we i me my your this that it will with at by from as so "
    "send sends sending sent get gets getting got provide provides provided share shared sharing return returned returning confirm confirmed confirming "
    "review reviewed reviewing complete completed completing finish finished deliver delivered delivering submit submitted submitting approve approved approving"
).split()
# Words left out of a search.
SEARCH_STOP = "the a an any anything some from for of to in on do did does have has had is are was were me my i we you your about with and or what who when where which there this that get got".split()
# Forms of reply prefixes, quote headers and asking.
SUBJECT_PREFIX = r"(?i)^\s*((re|fw|fwd|aw|sv)\s*(\[\d+\])?\s*:\s*)+"
QUOTE_HEADER = r"(?im)^\s*(On [^\n]{0,120}\bwrote:\s*$|-{2,}\s*Original Message\s*-{2,}|_{5,}|From:\s*[^\n]+\bSent:\s*)"
TRANSACTIONAL = r"(?i)\b(renew(s|al|ing)?|expir(es?|ing|ation)|past due|overdue|invoice|receipt|payment (method|failed|declined)|update your (payment|card|billing)|action required|final notice|suspend(ed|ing)?|cancel(led|lation) )\b"
ASKS = r"(?i)\?|\b(could you|can you|would you|please (?:send|confirm|review|approve)|let me know|any update|when can|do you)\b"


def squeeze(c: Column) -> Column:
    """Runs of blanks as one space, none outside."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_subject(c: Column) -> Column:
    """Subject without reply prefixes, in lower case; null gives ''."""
    return F.lower(squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), SUBJECT_PREFIX, "")))


def split_novel(c: Column) -> Column:
    """The text before the first quote header, without '>' lines; null gives ''."""
    body = F.coalesce(c, F.lit(""))
    head = F.element_at(F.split(body, QUOTE_HEADER, 2), 1)
    lines = F.filter(F.split(head, "\n"), lambda x: ~F.ltrim(x).startswith(">"))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def title_tokens(c: Column) -> Column:
    """Up to eight distinct content words of a title, sorted."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.slice(F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(*TITLE_STOP)))), 1, 8)


def title_key(c: Column) -> Column:
    return F.array_join(title_tokens(c), " ")


def match_key(act: Column, owner: Column, title: Column) -> Column:
    """The key under which claims about one obligation meet."""
    return F.concat_ws("|", act, F.coalesce(owner, F.lit("unassigned")), title_key(title))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two word arrays; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / F.size(F.array_union(a, b)))


def find_quote(quote: Column, *texts: Column) -> Column:
    """struct(found, at): offset in the first text that holds the quote; found without offset if only the blanks differ.

    Quotes of fewer than eight characters, and null ones, aren't looked for.
    """
    q = F.regexp_replace(F.coalesce(quote, F.lit("")), r"^\s+|\s+$", "")
    exact = F.coalesce(*[F.nullif(F.instr(t, q), F.lit(0)) - 1 for t in texts])
    flat = F.regexp_replace(q, r"\s+", " ")
    loose = F.lit(False)
    for t in texts:
        loose = loose | F.coalesce(F.contains(F.regexp_replace(t, r"\s+", " "), flat), F.lit(False))
    long = F.length(q) >= 8
    return F.struct((long & (exact.isNotNull() | loose)).alias("found"), F.when(long, exact).alias("at"))


def search_terms(query: str) -> list[str]:
    """The words of a query that are looked for."""
    import re

    return [t for t in re.sub(r"[^\w@.\- ]+", " ", (query or "").lower()).split() if len(t) > 1 and t not in SEARCH_STOP]


def word_count(c: Column) -> Column:
    """Words between blanks; 0 for null and blank texts."""
    t = squeeze(F.coalesce(c, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def urlsafe_b64(c: Column) -> Column:
    """Unpadded URL-safe base64 of the UTF-8 bytes."""
    return F.rtrim(F.translate(F.base64(F.encode(c, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def contains_question(subject: Column, body: Column) -> Column:
    return F.concat_ws("\n", subject, body).rlike(ASKS)


def address(name: Column, mail: Column) -> Column:
    """``Name <mail>``, or the mail alone."""
    return F.when(name.isNull() | (F.trim(name) == ""), mail).otherwise(F.concat(name, F.lit(" <"), mail, F.lit(">")))


def excerpt(c: Column, most: int = 260) -> Column:
    """The first characters of a text; null stays null."""
    return F.substring(c, 1, most)


def highlight(text: Column, quote: Column) -> Column:
    """struct(before, hit, after) around the first place of a quote; hit is null where the text lacks it."""
    at = F.instr(text, quote)
    found = (F.length(quote) > 0) & (at > 0)
    return F.struct(
        F.when(found, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("before"), F.when(found, quote).alias("hit"), F.when(found, F.substring(text, at + F.length(quote), F.length(text))).alias("after")
    )


def snippet_matches(snippet: Column, body: Column) -> Column:
    """Whether the snippet's first 20 characters occur in the first 80 of the body, blanks evened out; true for no snippet."""
    start = F.trim(F.substring(snippet, 1, 20))
    return F.coalesce(snippet == "", F.lit(True)) | F.contains(F.substring(squeeze(F.coalesce(body, F.lit(""))), 1, 80), start)
