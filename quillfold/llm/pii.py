"""Personal information in free text: find it, and replace it with typed placeholders.

Detection runs on a normalised copy. Small transducers rewrite disguises:
compatibility and look-alike characters become ASCII, invisible characters go,
runs of spelled digits become digits, at and dot in words or brackets become @
and a full stop. Every output character remembers the source offset it came
from, so each span found in the copy is mapped back to the exact characters of
the source.

Names have no shape of their own. A census over the whole corpus counts how each
word is used: in which case, after a given name, after another capitalised word,
alone in a salutation. Family names are words that stand capitalised after given
names and hardly ever elsewhere; given names beyond a list of common ones are
words that stand in salutations and inside sentences with a capital. The census
has a fixed number of buckets, whatever the corpus.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.session import cut

KINDS = ("email", "phone", "id_number", "address", "name")

# Common given names of several languages with short forms, letters without accents.
GIVEN = """
aaron adam adrian ahmed alan albert alex alexander ali alice amanda amelia amy ana andrea andreas andrew angela anita anna anne anthony antonio arthur barbara ben benjamin bernd bill bob brian bruno carl carlos carmen caroline catherine charles charlotte chen chris christian
christina christine christopher claire claudia daniel david deborah dennis diana diego dirk edward elena eleanor elizabeth emily emma eric erik eva fatima felix francis frank franz fred frederick gabriel george gerald giulia grace greg gregory guido hans harry heike heinrich helen
henri henry hugo ian ines ingrid isabel jack jacob james jan jane janet jean jennifer jessica jim joan joe john jonathan jorge jose joseph juan juergen julia julie jurgen karen karl kate katherine kathy kenneth kevin klaus laura leon linda lisa louis lucas lucy luis lukas manuel marc marcus
margaret maria marie mark markus marta martin mary matthew max mei mia michael michelle miguel mohammed monika nadia nancy natalie nicholas nick nicole nina olga oliver olivia omar oscar oskar pablo patricia patrick paul pedro peter petra philip pierre rachel ralf rebecca
richard rita robert roberto roger samuel sandra sara sarah sebastian sergio simon sofia sophie stefan stephen steve steven susan sven theodore theresa thomas tim timothy tom tony ursula uwe victor victoria walter wei werner william wolfgang yuki zoe
""".split()
# Words of an organisation's name that show its kind.
FIRM = "ag associates bank co company corp corporation foundation gmbh group holding inc institute kg limited llc llp ltd partners sa society team university".split()
# Words of two languages that may follow a given name with a capital, or stand alone in a line as one.
NOT_NAMES = frozenset(
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar marz mai juni juli oktober dezember "
    "and the that this with from for not but our your their please thanks thank regards cheers best dear hello hi hey hallo liebe lieber sehr geehrte guten morgen tag good morning afternoon evening all team everyone und der die das mit von bitte danke gruss grusse yes no ok".split()
)

_FOLD = {}
for _c in range(0xA1, 0x250):
    _d = unicodedata.normalize("NFKD", chr(_c))[0]
    if _d.isascii() and _d.isalpha():
        _FOLD[_c] = _d
_FOLD |= {ord(a): b for a, b in zip("øØłŁđĐıæÆœŒ", "oOlLdDiaAoO")}
# Cyrillic and Greek letters that look like Latin ones.
_FOLD |= {ord(a): b for a, b in zip("аеорсухіјѕԁАВЕКМНОРСТУХІЈЅοανικρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdABEKMHOPCTYXIJSoavikpuABEZHIKMNOPTYX")}
_FOLD |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_FOLD |= {c: str(unicodedata.digit(chr(c))) for c in range(0x80, 0x1FFFF) if unicodedata.category(chr(c)) == "Nd"}
_FOLD |= {c: " " for c in (0xA0, 0x2007, 0x202F, 0x3000, 0x2009, 0x200A, 0x2002, 0x2003)}
_FOLD |= {c: "-" for c in (0x2010, 0x2011, 0x2012, 0x2212)}
_FOLD |= {0x2019: "'", 0x2018: "'", 0x3002: ".", 0x2024: "."}
_FOLDED = {chr(k): v for k, v in _FOLD.items()}
_HIGH = re.compile(r"[^\x00-\x7f]")


def fold_letters(text: str) -> str:
    """Each look-alike or accented character as its plain one: one for one, so offsets stay. Texts have few of them."""
    return text if text.isascii() else _HIGH.sub(lambda m: _FOLDED.get(m.group(), m.group()), text)


_HIDDEN = re.compile("[­​-‏⁠-⁤﻿]+")
_DIGITS = {w: str(i) for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "oh ein zwo drei vier fuenf sechs sieben acht neun", "null eins zwei drei vier funf sechs sieben acht neun") for i, w in enumerate(words.split())} | {"ein": "1", "zwo": "2"}
_SPELLED = re.compile(r"\b(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + r")(?:[ ,-]+(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + r"|\d)){4,}\b", re.I)
_ONE = re.compile(r"[^\W\d_]+|\d", re.I)
_AT_DOT = re.compile(r"\s*[\[({<]\s*(?P<at>at|@|ät|klammeraffe)\s*[\])}>]\s*|(?P<AT>(?<=\w) (?-i:AT|\(AT\)) (?=\w))|(?P<low>(?<=[\w.]) at (?=[\w-]+(?: dot |\s*[\[({]\s*(?:dot|punkt)\s*[\])}]\s*)))|\s*[\[({]\s*(?:dot|punkt|\.)\s*[\])}]\s*|(?<=\w) (?:dot|DOT|punkt) (?=\w)", re.I)
# Gates: a text without these, and without a bare AT or dot, has no disguise in brackets and no spelled digits.
_BRACKETS = re.compile(r"[\[({<]\s*(?:at|@|dot|\.|ät|punkt|klammeraffe)\s*[\])}>]")
_TWO_SPELLED = re.compile(r"(?:{0})[ ,-]+(?:{1}|\d)[ ,-]+(?:{1}|\d)\b".format("|".join(sorted({w[-3:] for w in _DIGITS})), "|".join(sorted(_DIGITS, key=len, reverse=True))))


class Normalised:
    """A normalised text, and for each of its characters the source offset (None: the same)."""

    __slots__ = ("text", "origin")

    def __init__(self, source: str):
        text, origin = source, None
        if not text.isascii():
            text = fold_letters(text)
            text, origin = _rewrite(text, origin, _HIDDEN, lambda m: "")
        low = text.lower()
        if " AT " in text or " dot " in low or " punkt " in low or _BRACKETS.search(low):
            text, origin = _rewrite(text, origin, _AT_DOT, lambda m: "@" if m.lastgroup else ".")
        if _TWO_SPELLED.search(low):
            text, origin = _rewrite(text, origin, _SPELLED, lambda m: "".join(_DIGITS.get(w.lower(), w) for w in _ONE.findall(m.group())))
        self.text, self.origin = text, origin

    def source(self, start: int, end: int) -> tuple[int, int]:
        if self.origin is None:
            return start, end
        return self.origin[start], self.origin[end - 1] + 1


def _rewrite(text: str, origin, pattern: re.Pattern, to) -> tuple[str, list[int] | None]:
    """One transducer: rewrite the matches, keep for each output character its source offset.

    Of a rewritten match the first output character has the offset of the
    match's first character that is no blank, the last one that of its last.
    """
    found = [m for m in pattern.finditer(text)]
    if not found:
        return text, origin
    at = range(len(text)) if origin is None else origin
    out, where, last = [], [], 0
    for m in found:
        out.append(text[last : m.start()])
        where.extend(at[last : m.start()])
        new = to(m)
        out.append(new)
        span = at[m.start() : m.end()]
        where.extend(span[min(i * len(span) // max(1, len(new)), len(span) - 1)] if i + 1 < len(new) or len(new) == 1 else span[-1] for i in range(len(new)))
        last = m.end()
    out.append(text[last:])
    where.extend(at[last:])
    return "".join(out), where


_EMAIL = re.compile(r"[\w][\w.+%'-]*@[^\W_][\w-]*(?:\.[\w-]+)*\.[^\W\d_]{2,}\b")
_NOT_BEFORE = r"(?<![\w.,/#+$€£-])"
_PHONE = re.compile(
    rf"(?<![\w/#+$€£.,-])(?:"
    r"\+\d{1,3}(?:[ ./-]?\(\d{1,4}\))?(?:[ ./-]?\d{1,5}){2,6}\b|"
    r"\(?\+\d{1,3}\)?(?:[ ./-]?\d{1,5}){2,6}\b|"
    r"00\d{2}(?:[ ./-]\(?\d{1,4}\)?)?(?:[ ./-]\d{2,8}){1,5}\b|"
    r"(?:1[ .-])?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}\b|"
    r"(?:1[ .-])?\d{3}([ .-])\d{3}\1\d{4}\b|"
    r"\(0\d{2,4}\)[ /-]?\d{3,8}(?:[ -]\d{1,5})*\b|"
    r"0\d(?:[ .-]\d{2}){4}\b|"
    r"0\d{9,11}\b|"
    r"0\d{2,4} \d{3,4} \d{3,4}\b|"
    r"0\d{2,4}[ /-]{1,3}\d{4,8}(?:[ -]\d{1,5})?\b"
    r")(?![\w-]*[A-Za-z]\d)(?!,\d)"
)
_NOT_PHONE = re.compile(r"(?:\b(?:order|invoice|po|ticket|case|ref|tracking|part|serial|code|line|number is|company|budget|release|amount|vat|iban|account)\b[^\n\d]{0,12}|#|SN-?)$", re.I)
_PERSONAL = re.compile(
    r"\b(?:SSN|social security(?: (?:number|no\.?))?|T\.?I\.?N\.?|tax(?:payer)? (?:id|identification|number|no\.?|ref(?:erence)?)(?: (?:number|no\.?))?|steuer(?:nummer|-?id(?:entifikationsnummer)?|-?nr\.?)|national insurance(?: (?:number|no\.?))?|NINO?|(?:health |social )?insurance (?:number|no\.?|id)|"
    r"passport(?: (?:number|no\.?))?|reisepass(?:nummer|-?nr\.?)?|pass(?:nummer|-?nr\.?)|driv(?:ing|er'?s?) licen[cs]e(?: (?:number|no\.?))?|licen[cs]e (?:number|no\.?)|führerschein(?:nummer)?|fuhrerschein(?:nummer)?|(?:personal)?ausweis(?:nummer|-?nr\.?)?|(?:sozial|renten|kranken)?versicherung(?:snummer|s-?nr\.?)|"
    r"(?:national |personal )?(?:id|identity)(?: card)?(?: (?:number|no\.?))|permis(?: de conduire)?|passeport|numero de securite sociale|numero fiscal|pasaporte|NIF|NIE|DNI)\b\.?"
    r"(?:\s*(?:is|was|lautet|ist|:|=|,|it's|its|number|no\.?|nr\.?|#|est|es|le|the|meine|my)){0,5}\s*(?P<v>(?=[A-Za-z]{0,7} ?[\d])[A-Za-z0-9]{1,18}(?:[ ./-](?:\d[A-Za-z0-9]{0,11}|[A-Za-z]\d{1,11}|[A-Za-z])(?![A-Za-z'@]))*)",
    re.I,
)
_ID_SHAPE = re.compile(r"(?<![\w#./+-])(?:\d{3}-\d{2}-\d{4}|[A-CEGHJ-PQR-TW-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{5}\d{6}[A-Z]{1,2}\d{1,3}(?:[A-Z]{2})?)(?![\w-])")
_NAME_WORD = r"[A-ZÄÖÜ][\w'.]*"
_STREET_EN = r"(?:road|street|lane|way|close|grove|row|drive|terrace|avenue|court|yard|square|place|crescent|hill|gardens|boulevard|rd|st|ave|dr|ln|blvd|ct|ter|sq|pl|cl|gr)"
_EN = re.compile(rf"(?<![\w./#,-])\d{{1,4}}[a-d]?,? (?:{_NAME_WORD}\s){{1,3}}{_STREET_EN}\b(?:(?<=rd|st|dr|ln|ct|sq|pl|cl|gr)\.|(?<=ave|ter)\.|(?<=blvd)\.)?(?:,\s(?:(?:suite|apt|floor|flat|unit|room)\.? \w+))?(?:,\s[A-Z][\w'-]+(?: \d{{4,5}})?)?", re.I)
_DE = re.compile(
    r"(?<![\w-])(?:(?:[A-ZÄÖÜ][\w-]*(?:straße|strasse|stra[sß]e|str\.|weg|gasse|platz|allee|ufer|ring|damm|markt|steig|hof|chaussee)|(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Unter den) (?:[A-ZÄÖÜ]\w+ ){0,2}?(?:[A-ZÄÖÜ]\w+))) \d{1,4} ?[a-h]?\b(?:,\s\d{5} [A-ZÄÖÜ][\w-]+)?"
    r"|(?<![\w-])\w+(?:straße|strasse|gasse|allee|weg|platz) \d{1,4}[a-h]?\b(?:,\s\d{5} [\w-]+)?",
)
_FR = re.compile(r"(?<![\w./#-])(?:\d{1,4}(?: ?(?:bis|ter))?,?\s)?(?:rue|avenue|av\.|boulevard|bd|chemin|place|allee|quai|impasse|cours|route)\s(?:de la|de l'|du|des|de|d'|la|le|les|[A-Z])\s?[\w'-]+(?: [A-Z][\w'-]+)*(?:,?\s\d{1,4}\b)?(?:,\s\d{5} [\w'-]+)?", re.I)
_ES = re.compile(r"(?<![\w./#-])(?:calle|c/|avenida|avda\.?|plaza|paseo)\s(?:de la |del |de los |de )?[A-Z][\w'-]+(?: [A-Z][\w'-]+)*,?\s(?:n\.?º?\s?)?\d{1,4}\b(?:,\s\d{5} [\w'-]+)?", re.I)
_FR_NO = re.compile(r"\d")

_SEP = r"(?:[ \t]+|[ \t]*\r?\n[ \t>|]*)"
_FIRMS = "|".join(FIRM)
_AFTER = re.compile(rf"{_SEP}(?:[A-Z]\.?{_SEP}(?:[A-Z]\.{_SEP})?)?(?P<f>(?:(?:von|van|de|da|di|le|la|del|dos)\s)?[A-Z][\w'-]{{2,}})(?![\w@])(?![ \t]+(?:{_FIRMS})\b)", re.I)
_AFTER_INITIAL = re.compile(rf"(?:\.{_SEP}?|{_SEP})(?:[A-Z]\.?{_SEP}?)?(?P<f>[A-Z][\w'-]{{3,}})(?![\w@])(?![ \t]+(?:(?i:{_FIRMS}))\b)")
_BETWEEN = re.compile(rf",?{_SEP}")
_TOKEN = re.compile(r"[^\W\d_]+")
# Words without which a pattern can't match.
_PERSONAL_WORDS = frozenset("ssn social tin t tax taxpayer steuernummer steuer steuerid steueridentifikationsnummer steuernr nino nin ni insurance passport reisepass reisepassnummer reisepassnr passnummer passnr licence license fuhrerschein fuhrerscheinnummer ausweis ausweisnummer personalausweis personalausweisnummer sozialversicherungsnummer rentenversicherungsnummer krankenversicherungsnummer versicherungsnummer sozialversicherung id identity permis passeport numero pasaporte nif nie dni".split())
_FR_WORDS = frozenset("rue avenue av boulevard bd chemin place allee quai impasse cours route".split())
_ES_WORDS = frozenset("calle c avenida avda plaza paseo".split())
_EN_WORDS = frozenset("road street lane way close grove row drive terrace avenue court yard square place crescent hill gardens boulevard rd st ave dr ln blvd ct ter sq pl cl gr".split())
_DE_ENDS = ("straße", "strasse", "strase", "str", "weg", "gasse", "platz", "allee", "ufer", "ring", "damm", "markt", "steig", "hof", "chaussee")
_DE_STARTS = re.compile(r"\b(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Unter den) [A-ZÄÖÜ]")
_PLACE_BEFORE = re.compile(r"\b(?:in|to|at|from|near|reached|nach|aus|über|zu|à|en|au)\s+$", re.I)


# --- the census of words ---------------------------------------------------------

_PIECES = re.compile(r"[A-Za-z]+|[^A-Za-z ]")  # of folded texts; a word, a mark or a line end
_WORD = re.compile(r"[A-Za-z]+")
_INSIDE = re.compile(r"[a-z] ([A-Z][A-Za-z]+)")
_SIDE_BY_SIDE = re.compile(r"([A-Z][A-Za-z]+) (?=([A-Z][A-Za-z]+))")
_ADDRESS = re.compile(r"[^\s<>()]*@[^\s<>()]*")
_ALONE = re.compile(r"^[ \t>|]*(?:(?:[Hh]i|[Hh]ello|[Hh]ey|[Dd]ear|[Hh]allo|[Ll]ieber?),? )?([A-Za-z]{2,20}),?[ \t]*\r?$", re.M)
_CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTERS = frozenset(x.lower() for x in _CAPITALS)
_GIVEN_SET = frozenset(GIVEN)
_FIRM_SET = frozenset(FIRM)
BUCKETS = 1 << 20
#: What is counted of a word: in lower case, capitalised, capitalised after a lower-case word, alone in a line; after a
#: given name capitalised as it is, in lower case after a capitalised one, both in lower case; after an initial, before a
#: given name, after another capitalised word.
LOW, CAP, MID, ALONE, AFTER, VERB, ALIKE, INITIAL, BEFORE, PAIR = KINDS_OF_USE = range(10)


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def _folded(text: str) -> str:
    t = fold_letters(text)
    return _ADDRESS.sub(" ", t) if "@" in t else t  # parts of addresses are no words


def _table(seen: dict[int, Counter[str]]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for kind, words in seen.items():
        for w, n in words.items():
            if w[0].isalpha():
                out.setdefault(w.lower(), [0] * len(KINDS_OF_USE))[CAP if kind == LOW and w[0].isupper() else kind] += n
    return out


def count_usage(texts: Iterable[str | None]) -> dict[str, list[int]]:
    """How each word (folded, in lower case) is written: its case, inside sentences, alone in a line."""
    seen = {k: Counter() for k in (LOW, MID, ALONE)}
    for text in texts:
        if text:
            t = _folded(text)
            seen[LOW].update(_WORD.findall(t))
            seen[MID].update(_INSIDE.findall(t))
            seen[ALONE].update(_ALONE.findall(t))
    return _table(seen)


def count_context(texts: Iterable[str | None], census: Census) -> dict[str, list[int]]:
    """What each word follows: a given name, with or without an initial between, or another capitalised word."""
    seen = {k: Counter() for k in (AFTER, VERB, ALIKE, INITIAL, BEFORE, PAIR)}
    for text in texts:
        if not text:
            continue
        t = _folded(text)
        p = _PIECES.findall(t)
        given = {w for w in set(p) if len(w) > 2 and census.word(w.lower())[0]}
        hot = given | _CAPITALS
        for i in [i for i, a in enumerate(p) if a in hot]:
            a = p[i]
            if len(a) > 1:
                upper, rest = a[0].isupper(), p[i + 1 : i + 4]
                if len(rest) == 3 and rest[1] == "." and len(rest[0]) == 1 and rest[2][0].isupper():
                    seen[AFTER][rest[2]] += 1
                elif rest and rest[0][0].isalpha() and (upper or rest[0][0].islower()):
                    seen[(AFTER if rest[0][0].isupper() else VERB) if upper else ALIKE][rest[0]] += 1
                comma = i > 1 and p[i - 1] == ","
                j = i - 2 if comma else i - 1
                # Without a comma a capital at the start of a sentence says nothing.
                if upper and j >= 0 and p[j][0].isupper() and p[j] not in given and (comma or (j and p[j - 1].islower())):
                    seen[BEFORE][p[j]] += 1
            elif i + 1 < len(p):
                b = p[i + 2] if p[i + 1] == "." and i + 2 < len(p) else p[i + 1]
                if b[0].isupper() and len(b) > 3:
                    seen[INITIAL][b] += 1
        seen[PAIR].update([b for a, b in _SIDE_BY_SIDE.findall(t) if a not in given])
    return _table(seen)


class Census:
    """How the words of a corpus are used: the buckets in use, sorted, and a row of numbers for each; without any it knows common given names only."""

    def __init__(self, used: np.ndarray | None = None, rows: np.ndarray | None = None):
        self.used, self.rows = used, rows
        self.known: dict[str, tuple[bool, bool, bool, bool, bool]] = {}
        self.seen: set[str] = set()
        self.given: set[str] = set()
        self.street: set[str] = set()

    @classmethod
    def of(cls, texts: Iterable[str | None]) -> Census:
        """A census of a few texts in memory."""
        texts = list(texts)
        usage = cls._summed(count_usage(texts))
        return usage.plus(cls._summed(count_context(texts, usage)))

    @classmethod
    def _summed(cls, table: dict[str, list[int]]) -> Census:
        used, place = np.unique(np.array([bucket(w) for w in table], np.int64), return_inverse=True)
        rows = np.zeros((len(used), len(KINDS_OF_USE)), np.int64)
        np.add.at(rows, place, np.array(list(table.values()), np.int64).reshape(len(place), -1))
        return cls(used, rows)

    def plus(self, other: Census) -> Census:
        used, place = np.unique(np.concatenate([self.used, other.used]), return_inverse=True)
        rows = np.zeros((len(used), len(KINDS_OF_USE)), np.int64)
        np.add.at(rows, place, np.concatenate([self.rows, other.rows]))
        return Census(used, rows)

    def counts(self, w: str) -> list[int]:
        b = bucket(w)
        k = int(np.searchsorted(self.used, b))
        return self.rows[k].tolist() if k < len(self.used) and self.used[k] == b else [0] * len(KINDS_OF_USE)

    def sort_out(self, words: set[str]) -> tuple[set[str], bool]:
        """Which of a text's words are given names, and whether one ends like a street."""
        if len(self.seen) > 400_000:
            self.seen, self.given, self.street = set(), set(), set()
        new = words - self.seen
        if new:
            self.seen |= new
            self.given |= {w for w in new if self.word(w)[0]}
            self.street |= {w for w in new if w.endswith(_DE_ENDS)}
        return words & self.given, not words.isdisjoint(self.street)

    def word(self, w: str) -> tuple[bool, bool, bool, bool, bool]:
        """(given, surely a family name, possibly one, mostly capitalised, a family name in lower case) for a word in lower case."""
        got = self.known.get(w)
        if got is None:
            if len(self.known) > 400_000:
                self.known.clear()
            got = self.known[w] = self._judge(w)
        return got

    def _judge(self, w: str) -> tuple[bool, bool, bool, bool, bool]:
        listed = w in _GIVEN_SET
        if w in NOT_NAMES:
            return False, False, False, False, False
        if self.used is None:
            return listed, False, len(w) >= 4 and not listed and w not in _FIRM_SET, False, False
        low, cap, mid, alone, after, verb, alike, initial, before, pair = self.counts(w)
        # A word that stands alone in salutations and capitalised inside sentences, but not after given names.
        given = listed or (len(w) >= 3 and alone >= 2 and mid >= 2 and mid >= 0.1 * cap and low <= 0.25 * cap and after <= 0.2 * (mid + pair))
        shape = len(w) >= 4 and not given and w not in _FIRM_SET
        # A good part of its capitalised places are those of a family name, and hardly any that of a verb.
        named = after + initial + before
        sure = shape and named >= 1 and named >= 0.3 * cap and named >= 3 * verb and low <= 0.5 * cap + alike
        maybe = shape and low <= 0.2 * cap + alike and verb <= 0.1 * cap and not (pair > 5 and named < 0.05 * pair) and not (mid > 5 and named < 0.05 * mid)
        plain = shape and alike >= 1 and alike >= 0.5 * low and verb == 0
        return given, sure, sure or maybe, cap >= low, sure or plain


_NO_CENSUS = Census()


# --- detection --------------------------------------------------------------------


def spans(source: str | None, census: Census = _NO_CENSUS) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points of the source, sorted, without overlaps."""
    if not source:
        return []
    norm = Normalised(source)
    t = norm.text
    found: list[tuple[int, int, int, str]] = []  # rank, start, end, kind
    if "@" in t:
        for m in _EMAIL.finditer(t):
            start = m.start() + (len("mailto") + 1 if m.group().lower().startswith("mailto:") else 0)
            found.append((0, start, m.end(), "email"))
    low = t.lower()
    words = _TOKEN.findall(low)
    known = set(words)
    givens, streets = census.sort_out(known)
    if not known.isdisjoint(_PERSONAL_WORDS):
        for m in _PERSONAL.finditer(t):
            if sum(c.isdigit() for c in m.group("v")) >= 5:
                found.append((1, m.start("v"), m.end("v"), "id_number"))
    for m in _ID_SHAPE.finditer(t):
        if not _NOT_PHONE.search(t[max(0, m.start() - 30) : m.start()]):
            found.append((2, m.start(), m.end(), "id_number"))
    for m in _PHONE.finditer(t):
        digits = sum(c.isdigit() for c in m.group())
        if 8 <= digits <= 15 and not _NOT_PHONE.search(t[max(0, m.start() - 30) : m.start()]):
            found.append((3, m.start(), m.end(), "phone"))
    if not known.isdisjoint(_EN_WORDS):
        found += [(4, m.start(), m.end(), "address") for m in _EN.finditer(t) if _street(m.group(), census)]
    if streets or _DE_STARTS.search(t):
        found += [(4, m.start(), m.end(), "address") for m in _DE.finditer(t)]
    if not known.isdisjoint(_FR_WORDS):
        found += [(4, m.start(), m.end(), "address") for m in _FR.finditer(t) if _FR_NO.search(m.group())]
    if not known.isdisjoint(_ES_WORDS):
        found += [(4, m.start(), m.end(), "address") for m in _ES.finditer(t)]
    hot = givens | _LETTERS
    near = [i for i, w in enumerate(words) if w in hot]
    if near:
        places = [m.span() for m in _TOKEN.finditer(low)]
        for i in near:
            if len(words[i]) > 1:
                found += _named(t, places, words, i, census)
            elif t[places[i][0]].isupper():
                found += _initial(t, places, words, i, census)
    found.sort(key=lambda x: (x[0], x[1], -x[2]))
    starts: list[int] = []  # of what is taken, sorted; a new span may touch its neighbours only
    ends: list[int] = []
    out = []
    for _, a, b, kind in found:
        k = bisect_left(starts, a)
        if (k and ends[k - 1] > a) or (k < len(starts) and starts[k] < b):
            continue
        starts.insert(k, a)
        ends.insert(k, b)
        out.append((kind, *norm.source(a, b)))
    return sorted(out, key=lambda x: x[1])


def _named(t: str, places: list[tuple[int, int]], words: list[str], i: int, census: Census) -> list[tuple[int, int, int, str]]:
    """Names around the given name that is word ``i``."""
    a, b = places[i]
    if (a and (t[a - 1] in "@.'-_" or t[a - 1].isdigit())) or (b < len(t) and (t[b] in "@'_" or t[b].isdigit())):
        return []
    m = _AFTER.match(t, b)
    if m:
        f = m.group("f").split()[-1]
        _, sure, maybe, _, plain = census.word(f.lower())
        if sure or (maybe and t[a].isupper() and f[0].isupper() and "\n" not in m.group()) or (plain and t[a].islower() and f[0].islower()):
            return [(5, a, m.end(), "name")]
    if not i or (b < len(t) and t[b] in ".-" and b + 1 < len(t) and t[b + 1].isalnum()):
        return []
    x, y = places[i - 1]
    if not census.word(words[i - 1])[1] or y - x < 5 or t[x].islower() != t[a].islower() or not _BETWEEN.fullmatch(t, y, a):
        return []
    if (x and t[x - 1] in "@.'-_") or _PLACE_BEFORE.search(t[max(0, x - 12) : x]):
        return []
    return [(7, x, b, "name")]


def _initial(t: str, places: list[tuple[int, int]], words: list[str], i: int, census: Census) -> list[tuple[int, int, int, str]]:
    """Names around the initial that is word ``i``."""
    a, b = places[i]
    if a and t[a - 1] in "@.'/-_&":
        return []
    m = _AFTER_INITIAL.match(t, b)
    if m and census.word(m.group("f").lower())[1]:
        return [(6, a, m.end(), "name")]
    if i and t[b : b + 1] == "." and not t[b + 1 : b + 2].isalnum():
        x, y = places[i - 1]
        if t[x].isupper() and y - x >= 5 and census.word(words[i - 1])[1] and _BETWEEN.fullmatch(t, y, a) and not _PLACE_BEFORE.search(t[max(0, x - 12) : x]):
            return [(8, x, b, "name")]
    return []


_SHORT_STREET = re.compile(r"(?:rd|st|ave|dr|ln|blvd|ct|ter|sq|pl|cl|gr)\.?$", re.I)


def _street(text: str, census: Census) -> bool:
    """The words before the kind of street are capitalised like a name, or all is in lower case and they are mostly capitalised elsewhere."""
    words = re.findall(r"[A-Za-z][\w']*", text)
    kind = next((i for i, w in enumerate(words) if i and re.fullmatch(_STREET_EN, w, re.I)), None)
    if kind is None:
        return False
    name = words[1:kind] if re.match(r"\d+[a-d]\b", text) else words[:kind]
    if not name:
        return False
    if all(w[0].isupper() for w in name):
        return words[kind][0].isupper()
    if not all(w[0].islower() for w in name) or len(name) > 2:
        return False
    return all(census.word(w.split("'")[0])[3] for w in name) or (not _SHORT_STREET.fullmatch(words[kind]) and words[kind].lower() not in ("way", "place", "close", "row", "drive", "court"))


def redact(source: str | None, census: Census = _NO_CENSUS) -> str | None:
    """The text with each occurrence replaced by ``[KIND]``; null stays null."""
    if not source:
        return source
    out, last = [], 0
    for kind, a, b in spans(source, census):
        out.append(source[last:a])
        out.append(f"[{kind.upper()}]")
        last = b
    out.append(source[last:])
    return "".join(out)


# --- over tables ------------------------------------------------------------------

_COUNTS = "b int, " + ", ".join(f"n{k} long" for k in KINDS_OF_USE)


def _count(shared):
    """Arrow stage: the counts of some batches at a time, one row a bucket: usage, or, with a census, context."""

    def flush(texts: list[str | None], census: Census | None) -> pa.RecordBatch:
        rows: dict[int, list[int]] = {}
        for w, row in (count_context(texts, census) if census else count_usage(texts)).items():
            b = bucket(w)
            rows[b] = [x + y for x, y in zip(rows[b], row)] if b in rows else row
        cols = list(zip(*rows.values())) or [()] * len(KINDS_OF_USE)
        return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), *(pa.array(c, pa.int64()) for c in cols)], names=["b", *(f"n{k}" for k in KINDS_OF_USE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        census = _opened(shared) if shared else None
        held, size = [], 0
        for batch in batches:
            for text in batch.column("_text").to_pylist():
                held.append(text)
                size += len(text or "")
                if size > 20_000_000:
                    yield flush(held, census)
                    held, size = [], 0
        yield flush(held, census)

    return run


def census_of(texts: DataFrame, text: str) -> Census:
    """The census of a column of texts, in two passes: usage, then context by the given names that usage shows.

    Words are counted where they lie and summed by bucket; at most ``BUCKETS``
    rows come to the driver, whatever the corpus.
    """
    rows = texts.select(F.col(text).alias("_text")).filter("_text is not null")

    def counted(shared) -> Census:
        got = rows.mapInArrow(_count(shared), _COUNTS).groupBy("b").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in KINDS_OF_USE]).orderBy("b").toArrow()
        return Census(got.column("b").to_numpy().astype(np.int64), np.stack([got.column(f"n{k}").to_numpy() for k in KINDS_OF_USE], axis=1) if got.num_rows else np.zeros((0, len(KINDS_OF_USE)), np.int64))

    usage = counted(None)
    return usage.plus(counted(_shared(usage, texts)))


def _shared(census: Census, df: DataFrame):
    """A census for the stages of a frame: at most a row for each of the fixed number of buckets."""
    return df.sparkSession.sparkContext.broadcast((census.used, census.rows))


def _opened(shared) -> Census:
    return Census(*shared.value)


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        census = _opened(shared)
        for batch in batches:
            row, kind, start, end = [], [], [], []
            for r, text in enumerate(batch.column("_text").to_pylist()):
                for k, a, b in spans(text, census):
                    row.append(r)
                    kind.append(k)
                    start.append(a)
                    end.append(b)
            yield pa.RecordBatch.from_arrays([batch.column("row_id").take(pa.array(row, pa.int32())), pa.array(kind, pa.string()), pa.array(np.array(start, np.int32)), pa.array(np.array(end, np.int32))], names=["row_id", "kind", "start_at", "end_at"])

    return run


def find_personal(rows: DataFrame, key: str, text: str, census: Census) -> DataFrame:
    """(row_id, kind, start_at, end_at) of each occurrence; nothing is shuffled. Null and empty texts have none."""
    return rows.select(F.col(key).alias("row_id"), F.col(text).alias("_text")).filter("_text is not null").mapInArrow(_find(_shared(census, rows)), f"row_id {rows.schema[key].dataType.simpleString()}, kind string, start_at int, end_at int")


def redact_texts(rows: DataFrame, columns: list[str], census: Census) -> DataFrame:
    """``rows`` with the personal information in ``columns`` replaced by placeholders."""
    shared = _shared(census, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _opened(shared)
        for batch in batches:
            cols = [pa.array([redact(x, own) for x in batch.column(c).to_pylist()], pa.string()) if c in columns else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def evidence_quotes(evidence: DataFrame) -> DataFrame:
    """(id, quote), repeated deliveries once: the first to arrive that has a quote."""
    return evidence.filter("evidence_quote is not null and id is not null").groupBy("id").agg(F.min_by("evidence_quote", F.col("ingest_seq")).alias("quote"))


def both_texts(emails: DataFrame, evidence: DataFrame) -> DataFrame:
    """(source_table, row_id, text) of mails and quotes; mails without text keep their row."""
    mails = emails.select(F.lit("emails").alias("source_table"), F.col("id").alias("row_id"), F.col("body_text_novel").alias("text"))
    return mails.unionByName(evidence_quotes(evidence).select(F.lit("evidence").alias("source_table"), F.col("id").alias("row_id"), F.col("quote").alias("text")))


def personal_information(emails: DataFrame, evidence: DataFrame) -> DataFrame:
    """(source_table, row_id, kind, start_at) over both texts."""
    quotes = cut(evidence_quotes(evidence), "quotes")  # read for the census and for the search
    census = census_of(emails.select(F.col("body_text_novel").alias("text")).unionByName(quotes.select(F.col("quote").alias("text"))), "text")
    mails = find_personal(emails, "id", "body_text_novel", census).select(F.lit("emails").alias("source_table"), "row_id", "kind", "start_at")
    return mails.unionByName(find_personal(quotes, "id", "quote", census).select(F.lit("evidence").alias("source_table"), "row_id", "kind", "start_at"))


def redacted_texts(emails: DataFrame, evidence: DataFrame) -> DataFrame:
    """(source_table, row_id, text): both texts with placeholders."""
    both = both_texts(emails, evidence)
    return redact_texts(both, ["text"], census_of(both, "text"))
