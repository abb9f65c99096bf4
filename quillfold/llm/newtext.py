"""The lines of an email that its sender newly wrote.

1. One Arrow stage explodes every body into its non-blank lines: a hash of the
   normalised line (quote marks, case and blanks evened out), hashes of its runs
   of eight words, which don't depend on where lines end, and a proposal what the
   line may be from its looks (quote header, sign-off, banner).
2. SQL windows rank the messages of a thread by date. Of a line that several
   messages of a thread hold, and of a run of words, only the message that is
   first keeps it: the others repeat it. Short lines between repeated ones go
   with them.
3. Closing lines that a sender repeats in several threads are removed from the
   end of what is left, backwards.
4. Lines without an earlier message to compare with (the first copy of a quote
   whose original isn't in the table, header lines, a sign-off used once, banners)
   are left out by the proposals. ``proposals=False`` shows the windows alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfold.operators.changefeed import instant
from quillfold.operators.delivery import message_key
from quillfold.session import cut

NEW, QUOTE, SIGN, BOILER, BLANK = range(5)

_DATE = r"(?:\d{1,4}[./-]\d{1,2}[./-]\d{1,4}|\b\d{1,2}:\d{2}\b|\b(?:19|20)\d\d\b)"
_MARKED = re.compile(r"\s{0,3}(?:>|\|(?!\S*\|)|[A-Z]{1,4}>)")
_MARKS = re.compile(r"^(?:\s*(?:>|\||[A-Z]{1,4}>))+")
_WROTE = re.compile(r"\b(?:wrote|writes|schrieb|a écrit|escribió|said)\b[^:]{0,80}:\s*$", re.I)
_INTRO_START = re.compile(rf"\s*(?:(?:On|Am|Le|El)\b.*{_DATE}|.*\bschrieb\b|{_DATE}.*<|{_DATE}.*,)", re.I)
_DATED_FROM = re.compile(r"\s*\d{1,4}[./-]\d{1,2}[./-]\d{1,4},? \d{1,2}:\d{2}(?: ?[AP]M)?,? [^:]*(?:<[^>]*>)?:\s*$")
_REPLY_TO = re.compile(rf"\s*(?:In reply to the message of|In response to|Als Antwort auf|In Antwort auf)\b", re.I)
_SAID = re.compile(r"\s*-{2,}\s*.{1,60}\b(?:said|wrote|schrieb)\s*-{2,}\s*$", re.I)
_DIVIDER = re.compile(r"\s*(?:-{3,}\s*(?:Original|Forwarded|Urspr|Weitergeleitete|Message|Mensaje|Begin)[^-]{0,50}-{2,}\s*$|Begin forwarded message:|Anfang der weitergeleiteten Nachricht:|-{2,}\s*Forwarded by\b)", re.I)
_HEAD = re.compile(r"\s*\*?(From|Sent|Date|To|Cc|Subject|Reply-To|Von|Gesendet|Datum|An|Kopie|Betreff|De|Envoyé|À|Objet|Asunto|Enviado|Para)\s*:\s*\*?(?:\s|$)", re.I)
_HEAD_LINE = re.compile(r"\s*\*?(?:From|Von|De)\s*:.*[<@].*\b(?:Sent|Gesendet|Date|Datum|Envoyé|Enviado)\s*:", re.I)
_CARD = re.compile(r"\s*[^|]{3,60}\|[^|]{2,60}\|.*(?:\d{4}|@)")
_HEAD_FIRST = re.compile(r"\s*\*?(?:From|Von|De)\s*:", re.I)
_RULE = re.compile(r"\s*[_=-]{3,}\s*$")
_DASHES = re.compile(r"\s*--\s*$")
_CLOSING = re.compile(
    r"\s*(?:(?:(?:kind|best|warm|kindest|warmest|many)\s+)?(?:regards|thanks|wishes)|cheers|best|br|kr|rgds|thx|ta|lg|vg|mfg|thank you(?: very much| so much)?|thanks(?: a lot| again| in advance)|with thanks|all the best|warmly|cordially|respectfully|greetings|ciao|speak soon|talk soon|see you(?: soon)?|take care|sincerely|yours(?: sincerely| truly| faithfully)?|"
    r"(?:mit )?(?:(?:freundlichen?|besten?|herzlichen?|vielen?|viele|liebe|schöne|beste|herzliche|freundliche)\s+)(?:grüßen|grüße|gruß|gruss|grüssen|dank)|gruß|grüße|danke(?: und gruß)?|bis bald|hochachtungsvoll|"
    r"cordialement|bien à vous|merci|saludos|un saludo|atentamente|gracias)(?!\w)\s*[,.!–-]*\s*(?P<name>(?-i:(?:[A-ZÀ-Þ][\w.'’-]*\s*){0,4}))[.,!]?\s*$",
    re.I,
)
_PS = re.compile(r"\s*(?:P\.?\s?P?\.?\s?S\.?|N\.?B\.?|Postscript|Nachtrag)\s*[:.\s–-]", re.I)
_BOILER = re.compile(
    r"\s*\W{0,3}(?:(?:this|the contents of this|the information in this)\s+(?:e-?mail|message|communication)\b.*(?:confidential|privileged|intended|outside)|this message and any|the views in this|confidentiality notice|confidential(?:ity)?\s*:|disclaimer\b|privileged\b|"
    r"diese (?:e-?mail|nachricht)\b.*|der inhalt dieser|please consider the (?:trees|environment)|bitte (?:denken|prüfen) sie|think before you print|caution\b\s*:|warning\s*:|achtung\s*:|vorsicht\s*:|\[extern(?:al)?\]|extern(?:al)? (?:e-?mail|sender|message)\b|"
    r"you don'?t often get e?-?mail|sie erhalten nicht oft|.{0,60}\bis an equal opportunity employer|calls may be recorded|if you (?:have )?received (?:it|this)|virus|scanned by|this e-?mail (?:has been|was) (?:scanned|checked)|.{0,60}registered office\b)",
    re.I,
)
_DEVICE = re.compile(r"\s*(?:sent from (?:my|a)\b|sent via\b|sent using\b|von (?:unterwegs|meinem)\b.*gesendet|gesendet (?:von|mit)\b|get (?:the|outlook)\b.*\b(?:app|for)\b|envoyé (?:de|depuis)\b|enviado desde\b|diese nachricht wurde von)", re.I)
_CONTACT = re.compile(r"\s*(?:(?:tel|mob|mobile|phone|fax|mail|e-?mail|web|m|t|w|p|e|f)\b\.?\s*[:+(\d@.\w]|\+?[\d(][\d ()./+x-]{6,}$|[\w.+-]+@[\w.-]+$|\*[^*]+\*$|(?:www\.|https?://)\S+$)", re.I)
_GREET = re.compile(r"\s*(?:hi|hello|hey|dear|good (?:morning|afternoon|evening|day)|hallo|guten (?:tag|morgen|abend)|liebe[r/]*|sehr geehrte|moin|team|all|everyone|bonjour|hola|estimad)\b.{0,60}$", re.I)
_NAME_LINE = re.compile(r"\s*(?:[^\W\d_][\w'’.-]*)(?:\s+[^\W\d_][\w'’.-]*){0,3}\s*$")


def _bare_name(line: str) -> bool:
    """One to three capitalised words and nothing else."""
    s = line.strip()
    return bool(_NAME_LINE.match(s)) and len(s.split()) <= 3 and s[:1].isupper() and s[-1:] not in ".,!?" and not _GREET.match(s)


def _short(line: str) -> bool:
    return len(line) <= 72 and len(line.split()) <= 9


def _quoted(lines: list[str], state: list[int]) -> None:
    """Mark quoted and forwarded lines with their header lines."""
    n = len(lines)
    i = 0
    indented = False  # quoted text is shown by its indent
    while i < n:
        x = lines[i]
        if state[i] == BLANK:
            i += 1
            continue
        if _MARKED.match(x) or (indented and (x[:4] == "    " or x[:1] == "\t")):
            state[i] = QUOTE
            i += 1
            continue
        # The rest of a quoted line that was wrapped after it was marked.
        if i and state[i - 1] == QUOTE and not _GREET.match(x):
            before = _MARKS.sub("", lines[i - 1]).rstrip()
            if before and _MARKED.match(lines[i - 1]) and before[-1] not in ".!?:,;" and (x[:1].islower() or len(before) >= 50):
                state[i] = QUOTE
                i += 1
                while i < n and state[i] == NEW and not _MARKED.match(lines[i]):  # to the end of the wrapped paragraph
                    state[i] = QUOTE
                    i += 1
                continue
        # A divider or a block of header lines: all that follows is old.
        if _DIVIDER.match(x) or (_HEAD_FIRST.match(x) and sum(bool(_HEAD.match(y)) for y in lines[i : i + 7]) >= 2) or _HEAD_LINE.match(x):
            j = i - 1
            while j >= 0 and state[j] == BLANK:
                j -= 1
            if j >= 0 and _RULE.match(lines[j]):
                state[j] = QUOTE
            marked = _next(lines, state, i, lambda y: not _HEAD.match(y) and not _DIVIDER.match(y))
            if marked is not None and _MARKED.match(lines[marked]):
                for k in range(i, marked):
                    if state[k] != BLANK:
                        state[k] = QUOTE
                i = marked
                continue
            for k in range(i, n):
                if state[k] != BLANK:
                    state[k] = QUOTE
            return
        # An introduction of quoted text, on up to three lines.
        span = 0
        if _SAID.match(x) or _DATED_FROM.match(x) or (_WROTE.search(x) and re.search(_DATE, x)):
            span = 1
        elif _REPLY_TO.match(x):
            span = 1
            if not re.search(_DATE, x) and i + 1 < n and state[i + 1] != BLANK and not _MARKED.match(lines[i + 1]):
                span = 2
        else:
            for k in (2, 3):
                if i + k <= n and BLANK not in state[i : i + k] and _INTRO_START.match(x) and not any(map(_MARKED.match, lines[i + 1 : i + k])):
                    joined = " ".join(lines[i : i + k])
                    if len(joined) < 260 and (_WROTE.search(joined) or _DATED_FROM.match(joined)) and re.search(_DATE, joined):
                        span = k
                        break
        if span:
            for k in range(i, i + span):
                state[k] = QUOTE
            j = _next(lines, state, i + span, lambda y: True)
            if j is None:
                return
            if _MARKED.match(lines[j]):
                i = j
                continue
            if lines[j][:2] in ("  ", "\t") or lines[j][:1] == "\t":
                indented = True
                k = j
                while k < n and (state[k] == BLANK or lines[k][:2] == "  " or lines[k][:1] == "\t"):
                    if state[k] != BLANK:
                        state[k] = QUOTE
                    k += 1
                i = k
                continue
            for k in range(j, n):
                if state[k] != BLANK:
                    state[k] = QUOTE
            return
        i += 1


def _next(lines: list[str], state: list[int], i: int, want) -> int | None:
    for k in range(i, len(lines)):
        if state[k] != BLANK and want(lines[k]):
            return k
    return None


def _boiler(lines: list[str], state: list[int]) -> None:
    """Banners and disclaimers, each to the end of its paragraph."""
    n = len(lines)
    i = 0
    while i < n:
        if state[i] == NEW and _BOILER.match(lines[i]):
            # A wrapped notice goes on to the end of its paragraph.
            while i < n and state[i] == NEW:
                state[i] = BOILER
                i += 1
        else:
            i += 1


def _signed(lines: list[str], state: list[int]) -> None:
    """Sign-offs: in each run of lines that aren't quoted, from the closing formula on, but for postscripts."""
    n = len(lines)
    i = 0
    while i < n:
        if state[i] == QUOTE:
            i += 1
            continue
        j = i
        while j < n and state[j] != QUOTE:
            j += 1
        _sign_run(lines, state, [k for k in range(i, j) if state[k] == NEW], i, j)
        i = j


def _sign_run(lines: list[str], state: list[int], own: list[int], begin: int, end: int) -> None:
    start = None
    for p, k in enumerate(own):
        x = lines[k]
        rest = own[p + 1 :]
        if _DASHES.match(x) or (_RULE.match(x) and rest and len(rest) <= 8 and all(_short(lines[r]) for r in rest)):
            start = p
            break
        if _CARD.match(x):
            start = p
            break
        m = _CLOSING.match(x)
        if m:
            if p == 0 and not m.group("name").strip() and (len(rest) > 12 or (not rest and x.rstrip()[-1:] in "!.")):
                continue  # thanks, as an opening or as all there is to say
            start = p
            break
        if p and _DEVICE.match(x) and len(x) < 60:
            start = p - 1 if _bare_name(lines[own[p - 1]]) else p
            break
        if p and rest and x.rstrip()[-1:] == "," and len(x.split()) <= 3 and not _GREET.match(x):
            tail = _without_ps(lines, state, rest)
            if len(tail) <= 8 and _NAME_LINE.match(lines[rest[0]]) and lines[rest[0]].strip()[:1].isupper() and all(_short(lines[r]) for r in tail):
                start = p
                break
    if start is None:
        # No formula: a device footer, contact lines or a bare name at the end.
        p = len(own)
        while p > 0 and (_DEVICE.match(lines[own[p - 1]]) or _CONTACT.match(lines[own[p - 1]])) and not _PS.match(lines[own[p - 1]]):
            p -= 1
        if p > 1 and _bare_name(lines[own[p - 1]]):
            above = own[p - 1] - 1
            if p < len(own) or (above >= begin and state[above] == BLANK):
                p -= 1
        start = p if p < len(own) else None
    if start is None:
        return
    ps = False
    for p in range(start, len(own)):
        k = own[p]
        if _PS.match(lines[k]):
            ps = True
        elif ps and (k != own[p - 1] + 1):  # a blank line ends the postscript
            ps = False
        if ps and not _DEVICE.match(lines[k]):
            continue
        state[k] = SIGN


def _without_ps(lines: list[str], state: list[int], rows: list[int]) -> list[int]:
    out, ps = [], False
    for p, k in enumerate(rows):
        if _PS.match(lines[k]):
            ps = True
        elif ps and p and k != rows[p - 1] + 1:
            ps = False
        if not ps:
            out.append(k)
    return out


def line_states(body: str | None) -> list[int]:
    """State of each line of a body (split at newlines; carriage returns are blank)."""
    if not body:
        return []
    lines = [x.rstrip("\r") for x in body.split("\n")]
    state = [NEW if x.strip() else BLANK for x in lines]
    _quoted(lines, state)
    _boiler(lines, state)
    _signed(lines, state)
    for i, x in enumerate(lines):
        if state[i] == NEW and _DEVICE.match(x) and len(x) < 60:
            state[i] = SIGN
    return state


_STRIP = re.compile(r"^[\s>|]+|\s+$")


def normalised(line: str) -> str:
    """A line without quote marks and outer blanks, case and inner blanks evened out."""
    return " ".join(_STRIP.sub("", line).lower().split())


GRAM = 8
LONG, CLOSING = 1, 2  # bits of a line's kind


def grams(lines: list[str], use: list[bool]) -> dict[int, list[int]]:
    """Hashes of all runs of eight words of the used lines, each with the lines it counts for.

    The runs go on across line ends, so text that was wrapped anew keeps them;
    one that covers several lines counts for each.
    """
    words, where = [], []
    for i, x in enumerate(lines):
        if use[i]:
            own = normalised(x).split()
            words += own
            where += [i] * len(own)
    out: dict[int, list[int]] = {}
    for j in range(len(words) - GRAM + 1):
        h = xxhash.xxh3_64_intdigest(" ".join(words[j : j + GRAM]).encode("utf-8", "surrogatepass")) - (1 << 63)
        on = out.setdefault(h, [])
        for i in (where[j], where[j + GRAM // 2], where[j + GRAM - 1]):
            if i not in on:
                on.append(i)
    return out


def _lines(proposals: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, no, text, kind, open_, marks, covers, runs = [], [], [], [], [], [], [], []
            for r, body in enumerate(batch.column("body").to_pylist()):
                if not body:
                    continue
                lines = body.split("\n")
                states = line_states(body) if proposals else [NEW if x.strip() else BLANK for x in lines]
                # Each run travels once, with its first line; two line numbers are packed into one value.
                prints: dict[int, tuple[list[int], list[int]]] = {}
                count: dict[int, int] = {}
                for h, on in grams(lines, [s == NEW for s in states]).items():
                    for i in on:
                        count[i] = count.get(i, 0) + 1
                    own = prints.setdefault(on[0], ([], []))
                    for k in range(0, len(on), 2):
                        own[0].append(h)
                        own[1].append((on[k] + 1) << 31 | (on[k + 1] + 1 if k + 1 < len(on) else 0))
                for i, s in enumerate(states):
                    norm = normalised(lines[i])
                    if not norm:  # blank, or nothing but quote marks
                        continue
                    row.append(r)
                    no.append(i + 1)
                    text.append(xxhash.xxh3_64_intdigest(norm.encode("utf-8", "surrogatepass")) - (1 << 63))
                    words = norm.count(" ") + 1
                    kind.append(LONG * (len(norm) >= 30 and words >= 5) + CLOSING * (words <= 9 and norm[-1:] not in ".,!?:;" and not _GREET.match(norm)))
                    open_.append(s == NEW)
                    own = prints.get(i, ([], []))
                    marks.append(own[0])
                    covers.append(own[1])
                    runs.append(count.get(i, 0))
            cols = [batch.column(c).take(pa.array(row, pa.int32())) for c in ("id", "thread", "message", "at")]
            cols += [pa.array(no, pa.int32()), pa.array(text, pa.int64()), pa.array(kind, pa.int8()), pa.array(open_, pa.bool_()), pa.array(marks, pa.list_(pa.int64())), pa.array(covers, pa.list_(pa.int64())), pa.array(runs, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "thread", "message", "at", "line_no", "line", "kind", "open", "grams", "covers", "runs"])

    return run


def _message() -> Column:
    """Deliveries of one message share an identity: its RFC id, else account and provider id, else the row."""
    return F.coalesce(F.lower(F.trim("rfc_message_id")), F.concat_ws("|", "account_id", message_key(F.col("provider_message_id"))), F.col("id"))


def exploded_lines(emails: DataFrame, proposals: bool = True) -> DataFrame:
    """One row per non-blank line; ``open`` unless its own message shows it to be old. Bodies aren't shuffled."""
    mails = emails.select(
        "id", F.xxhash64(F.coalesce("thread_id", "id")).alias("thread"), F.xxhash64(_message()).alias("message"), F.coalesce(F.unix_micros(instant(F.col("provider_ts"))), F.lit(0)).alias("at"), F.col("body_text_full").alias("body")
    )
    return mails.mapInArrow(_lines(proposals), "id string, thread long, message long, at long, line_no int, line long, kind byte, open boolean, grams array<long>, covers array<long>, runs int")


def marked_lines(emails: DataFrame, proposals: bool = True) -> DataFrame:
    """One row per non-blank line with ``repeats`` (an earlier message of the thread has it), ``fresh`` and ``left`` (fresh lines from here to the end).

    ``mail`` is a hash of the id, which is half as long: a line is shuffled twice.
    """
    lines = cut(exploded_lines(emails, proposals), "lines")  # read twice: lines are found once
    # First authored, whatever the line ends: of all messages of a thread with a run of words the earliest keeps it.
    runs = lines.select("thread", F.explode(F.arrays_zip("grams", "covers")).alias("run"), "message", "at", F.xxhash64("id").alias("mail"))
    runs = runs.select(F.xxhash64("thread", "run.grams").alias("gram"), "run.covers", "message", "at", "mail")
    first = F.min(F.struct("at", "message")).over(Window.partitionBy("gram"))["message"]
    again = runs.select("mail", "covers", (first != F.col("message")).alias("old")).filter("old")
    again = again.select("mail", F.explode(F.array(F.shiftright("covers", 31).cast("int"), F.col("covers").bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))).alias("line_no")).filter("line_no > 0")
    # The same for whole lines.
    first = F.min(F.struct("at", "message")).over(Window.partitionBy("thread", "line"))["message"]
    lines = lines.select(F.xxhash64("id").alias("mail"), "line_no", "message", "at", "thread", "line", "kind", "open", "runs")
    lines = lines.select("mail", "line_no", "thread", "line", "kind", "open", "runs", (first != F.col("message")).alias("seen"))
    # Both meet by mail: the rows of repeated runs are counted for their line, then only the line's row goes on.
    both = lines.unionByName(again, allowMissingColumns=True).repartition("mail")
    own = Window.partitionBy("mail", "line_no")
    both = both.withColumn("old", F.count_if(F.col("line").isNull()).over(own)).withColumn("copy", F.row_number().over(own.orderBy(F.col("line").isNull()))).filter("copy = 1 and line is not null")
    by = Window.partitionBy("mail").orderBy("line_no")
    long = F.col("kind").bitwiseAND(F.lit(LONG).cast("byte")) == LONG
    both = both.withColumn("sure", F.when(long | (F.col("runs") > 0), (long & F.col("seen")) | ((F.col("runs") > 0) & (F.col("old") * 2 >= F.col("runs")))))
    above = F.last("sure", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    below = F.first("sure", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing))
    both = both.withColumn("repeats", F.coalesce("sure", F.col("seen") & F.coalesce(above, F.lit(False)) & F.coalesce(below, F.lit(False)))).withColumn("fresh", F.col("open") & ~F.col("repeats"))
    return both.select("mail", "line_no", "thread", "line", "kind", "open", "repeats", "fresh", F.count_if("fresh").over(by.rowsBetween(0, Window.unboundedFollowing)).alias("left"))


def new_lines(emails: DataFrame, participants: DataFrame, closing_threads: int = 3, closing_zone: int = 6, proposals: bool = True, salts: int = 16) -> DataFrame:
    """(email_id, line_no) of the lines newly written by the sender, for every id of emails.

    Null and empty bodies have none; a mail without thread or readable time is
    judged by itself and as the oldest; repeated rows of one id count once.
    Repeated deliveries of a message get the same lines. A closing line is one
    that stands among the last ``closing_zone`` fresh lines in at least
    ``closing_threads`` threads of its sender.
    """
    lines = cut(marked_lines(emails, proposals).filter("fresh").select("mail", "line_no", "thread", "line", "kind", "left"), "fresh")
    senders = participants.filter("part_role = 'from' and email_id is not null").groupBy(F.xxhash64("email_id").alias("mail")).agg(F.min(F.lower(F.trim("raw_address"))).alias("sender"))
    tails = lines.filter((F.col("kind").bitwiseAND(F.lit(CLOSING).cast("byte")) == CLOSING) & (F.col("left") <= closing_zone))
    tails = cut(tails.join(senders, "mail", "left").select("mail", "left", "thread", F.xxhash64(F.coalesce("sender", F.col("mail").cast("string")), "line").alias("closing")), "tails")
    often = tails.groupBy("closing").agg(F.count_distinct("thread").alias("threads")).filter(F.col("threads") >= closing_threads)
    # A line that one sender repeats in a third of all mails is spread over several tasks.
    spread = often.select("closing", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    closing = tails.withColumn("salt", F.pmod(F.col("mail"), F.lit(salts)).cast("int")).join(spread, ["closing", "salt"])
    # How many lines from the end on are closings without a gap: the trailing ones of a bit mask of places.
    mask = F.bit_or(F.expr("shiftleft(1L, left - 1)" if closing_zone < 63 else "0L"))
    ends = closing.withColumn("left", F.col("left").cast("int")).groupBy("mail").agg(mask.alias("mask")).select("mail", (F.bit_count(F.col("mask").bitwiseXOR(F.col("mask") + 1)) - 1).alias("closings"))
    new = lines.join(ends, "mail", "left").filter(F.col("left") > F.coalesce("closings", F.lit(0))).select("mail", "line_no")
    return new.join(emails.select(F.xxhash64("id").alias("mail"), F.col("id").alias("email_id")).distinct(), "mail").select("email_id", "line_no")
