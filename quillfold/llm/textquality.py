"""Per-document text statistics, their quantile sketches, and the form of a text.

1. One Arrow stage turns each text into statistics: words, symbols, frequent
   words, repeated three-word runs, and the shares of its characters on lines
   that look like list entries, short lines, rows of fields or noise. Whole
   texts, no shuffle.
2. Per language each statistic goes into a mergeable KLL quantile sketch; the
   sketches' medians and quartiles are a table of a few rows.
3. Values become robust z-scores: the distance from the median in units of the
   spread on the other side of it, which the tail in question doesn't reach. (A
   quarter of a language's texts may be lists and tables; the spread on their own
   side would grow with them.)
4. Distribution tails are flagged. Each form has its tail: far too large a share
   of its lines; for short lines and odd words only together with a tail of the
   words (too few frequent ones, strange symbols). Of several tails the form with
   the greater part of the text wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.session import cut

STATS = ("mean_word_len", "symbol_ratio", "line_end_ratio", "common_ratio", "repeat_ratio", "odd_ratio")
SHARES = ("list_share", "short_share", "table_share", "junk_share", "noise_share")
#: Least spread of each statistic: a flat distribution has no smaller unit.
LEAST_SPREAD = {"mean_word_len": 0.2, "symbol_ratio": 0.005, "line_end_ratio": 0.05, "common_ratio": 0.02, "repeat_ratio": 0.1, "odd_ratio": 0.005} | dict.fromkeys(SHARES, 0.05)

_HIGH_SYMBOL = re.compile(r"[^\x00-\x7f\w\s]")
_NO_SYMBOL = bytes(i for i in range(256) if i >= 128 or chr(i).isalnum() or i <= 32)
_ODD = re.compile(r"[^\x00-\x7f\w\s–—’‘“”„…€£•·«»°§×\u200b]|[ÃÂÐâï\ufffd]")
_STRANGE = re.compile(r"[ÃÂÐâï\ufffd¢¤¦¬½¿©\x00-\x08\x0e-\x1f\x7f-\x9f\ue000-\uf8ff]")
_MARK = re.compile(r"\s*(?:[-*•–—+·o◦▪‣→>]|\(?\d{1,4}[.):]|\[[ xX✓]?\]|\(?[a-zA-Z][.)]|[☐☑✓✔])\s+\S")
_GAP = re.compile(r"\S(?: {2,}|\t)(?=\S)")
_RULE = re.compile(r"[-=+|:_ ]{5,}")
_TAG = re.compile(r"</?[a-zA-Z!][^>]*>|&#?\w+;")
_CSS = re.compile(r"[\w.#-]+\s*\{[^{}]*\}")
_CODED = re.compile(r"[A-Za-z0-9+/=_-]{20,}|(?:\b[0-9a-fA-F]{2}\b[ :]?){6,}|(?:%[0-9A-F]{2}){3,}|(?:=[0-9A-F]{2}){3,}|(?:\\\\[xu][0-9a-fA-F]{2,4}){2,}")
_HEADER = re.compile(r"X-[\w-]+: *\S+$")
_MASH = re.compile(r"[^\W\d_][;\[\]{}|\\=<>]+[^\W\d_]|[;\[\]'{}][;\[\]'{}]|(?<!\S)[;\]'][^\W\d_]|[^\W\d_]\[(?=\s|$)")


def _symbols(text: str) -> int:
    """Characters that are neither letters, digits nor blanks; ASCII ones by a byte table."""
    n = len(text.encode("utf-8", "surrogatepass").translate(None, _NO_SYMBOL))
    return n if text.isascii() else n + len(_HIGH_SYMBOL.findall(text))


def _alike(rows: list[str], sep: str, space: bool) -> bool:
    """Most rows hold the same number of separators."""
    counts = [r.count(sep) for r in rows]
    top = max(set(counts), key=counts.count)
    return top > 0 and counts.count(top) >= 0.8 * len(counts) and (space or sum(r.count(sep + " ") for r in rows) <= 0.2 * sum(counts))


def _packed(row: str, sep: str) -> bool:
    """Fields with no blank after the separator, and no sentence between them."""
    k = row.count(sep + " ") + row.endswith(sep)
    fields = row.count(sep) + 1
    return fields - 1 > k and len(row.split()) <= 4 * fields


def _separator(text: str, lines: list[str]) -> str | None:
    """The separator of a text whose lines are rows of fields."""
    if len(lines) < 2:
        return None
    for sep, space in (("|", True), ("\t", True), (";", False), (",", False)):
        if text.count(sep) < len(lines) // 3:
            continue
        body = [x for x in lines if not _RULE.fullmatch(x)]
        rows = [x for x in body if sep in x and (space or _packed(x, sep))]
        if len(rows) >= 2 and len(rows) >= 0.3 * len(body) and _alike(rows, sep, space):
            return sep
    return None


def measure(text: str, frequent: frozenset[str]) -> dict[str, float] | None:
    """Statistics of one text; None for null, empty and blank ones."""
    if not text or text.isspace():
        return None
    lines = [x for x in text.splitlines() if x and not x.isspace()]
    if not lines:
        return None
    total = sum(map(len, lines))
    words = text.lower().split()
    n = len(words)
    visible = sum(map(len, words))
    distinct = len(set(words))
    repeat = 1 - distinct / n
    if n >= 8 and repeat > 0.5:  # words recur in any long text; runs of three don't
        repeat = 1 - len(set(zip(words, words[1:], words[2:]))) / (n - 2)
    else:
        repeat = 0.0
    plain_ascii = text.isascii()
    odd = 0 if plain_ascii else len(_ODD.findall(text))
    symbols = _symbols(text)
    out = {
        "n_words": n,
        "n_lines": len(lines),
        "mean_word_len": visible / n,
        "symbol_ratio": symbols / visible,
        "line_end_ratio": sum(x.rstrip()[-1] in ".!?:;…\"”" for x in lines) / len(lines),
        "common_ratio": sum(map(frequent.__contains__, words)) / n,
        "repeat_ratio": repeat,
        "odd_ratio": odd / visible,
    }
    listed = bare = table = junk = mash = 0
    sep = _separator(text, lines)
    tags = "<" in text or "{" in text or "&" in text
    codes = max(map(len, words)) >= 20 or visible < 3.2 * n or text.count("%") > 2 or text.count("=") > 2 or "\\" in text
    strange = odd > 0.1 * visible or not (plain_ascii or text.isprintable())
    noisy = symbols > 0.08 * visible
    gaps = "  " in text or "\t" in text
    for x in lines:
        size = len(x)
        s = x.strip()
        if tags or codes or strange:
            coded = sum(map(len, _CODED.findall(x))) if codes else 0
            marked = sum(map(len, _TAG.findall(x))) + sum(map(len, _CSS.findall(x))) if tags else 0
            if marked > 0.4 * size or (coded and (_HEADER.match(s) or (coded > 0.5 * size and not (sep and sep in x) and not _RULE.fullmatch(s)))) or (strange and len(_STRANGE.findall(s)) > 0.3 * len(s)):
                junk += size
                continue
        if sep and sep in x and (sep in "|\t" or _packed(x, sep)):
            table += size
            continue
        if gaps and s[:1] in "-=+|_" and _RULE.fullmatch(s) and len(set(s)) <= 3:
            table += size
            continue
        if gaps and ("  " in s or "\t" in s):
            k = len(_GAP.findall(s))
            if (k >= 2 and len(s.split()) <= 4 * (k + 1)) or (k == 1 and "   " in s and len(s.split()) <= 6 and not _MARK.match(x)):
                table += size
                continue
        if _MARK.match(x):
            listed += size
        elif noisy and _symbols(s) > 0.5 * len(s):
            junk += size
        elif noisy and len(_MASH.findall(s)) >= max(1, size / 45):
            mash += size
        elif size <= 64 and len(s.split()) <= 8 and s[-1] not in "!?" and not (s[-1] == "." and len(s.split()) > 5):
            bare += size
    return out | {"list_share": listed / total, "short_share": (listed + bare) / total, "table_share": table / total, "junk_share": junk / total, "noise_share": (junk + mash) / total}


def _stage(frequent: dict[str, frozenset[str]], keys: list[str]):
    union = frozenset().union(*frequent.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "n_lines", *STATS, *SHARES]
        for batch in batches:
            got = [measure(x, union) for x in batch.column("_text").to_pylist()]
            keep = pa.array([i for i, g in enumerate(got) if g], pa.int32())
            got = [g for g in got if g]
            cols = [batch.column(k).take(keep) for k in keys]
            cols += [pa.array([g[k] for g in got], pa.int64() if k[:2] == "n_" else pa.float64()) for k in names]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, *names])

    return run


def frequent_words(table: DataFrame, most: int = 20_000) -> dict[str, frozenset[str]]:
    """The fixed word lists by language; an unexpectedly large table is an error, not a broadcast."""
    rows = table.select("lang", "word").filter("word is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} frequent words")
    out: dict[str, set[str]] = {}
    for lang, word in rows:
        out.setdefault(lang, set()).add(word.lower())
    return {k: frozenset(v) for k, v in out.items()}


def text_statistics(docs: DataFrame, frequent: dict[str, frozenset[str]], key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per non-blank text: key, lang (two letters, ``other`` where none of the known), counts, ratios, shares of line kinds.

    Null, empty and blank texts are left out; repeated rows give repeated rows.
    """
    code = F.lower(F.substring(F.trim(F.col(lang)), 1, 2))
    known = sorted(x for x in frequent if x)
    rows = docs.select(F.col(key), (F.when(code.isin(*known), code).otherwise("other") if known else F.lit("other")).alias("lang"), F.col(text).alias("_text"))
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, lang string, n_words long, n_lines long, " + ", ".join(f"{k} double" for k in (*STATS, *SHARES))
    return rows.mapInArrow(_stage(frequent, [key, "lang"]), schema)


def sketches(stats: DataFrame) -> DataFrame:
    """One row per language: KLL sketches of each statistic, mergeable with those of other batches."""
    return stats.groupBy("lang").agg(*[F.kll_sketch_agg_double(k).alias(k) for k in LEAST_SPREAD])


def merge_sketches(parts: DataFrame) -> DataFrame:
    """Sketches of several batches as one per language."""
    return parts.groupBy("lang").agg(*[F.kll_merge_agg_double(k).alias(k) for k in LEAST_SPREAD])


def robust_scores(stats: DataFrame, quantiles: DataFrame | None = None) -> DataFrame:
    """Adds ``z_<statistic>``: distance from the language's median over the spread on the other side (quartile distance / 0.6745, at least a small unit).

    ``quantiles`` are sketches as of :func:`sketches`; without them those of
    ``stats`` are made. There is one row for each known language, so the join
    is a broadcast of a few rows.
    """
    sk = sketches(stats) if quantiles is None else quantiles
    q = sk.select("lang", *[F.kll_sketch_get_quantile_double(k, F.lit(p)).alias(f"_{k}_{n}") for k in LEAST_SPREAD for n, p in (("lo", 0.25), ("mid", 0.5), ("hi", 0.75))])

    def z(k: str):
        x, mid = F.col(k), F.col(f"_{k}_mid")
        spread = F.when(x < mid, F.col(f"_{k}_hi") - mid).otherwise(mid - F.col(f"_{k}_lo")) / F.lit(0.6745)
        return ((x - mid) / F.greatest(spread, F.lit(LEAST_SPREAD[k]))).alias(f"z_{k}")

    return stats.join(F.broadcast(q), "lang").select(*stats.columns, *[z(k) for k in LEAST_SPREAD])


def forms(scored: DataFrame, key: str = "doc_id", tail: float = 4.5, far: float = 10.0) -> DataFrame:
    """(key, form): ``list``, ``table`` or ``junk`` for texts in a tail; natural prose is left out.

    ``tail`` bounds the scores of words and symbols, ``far`` those of line
    shares, whose unit is a twentieth of the text.
    """
    z = lambda k: F.col(f"z_{k}")
    c = F.col
    few_frequent = z("common_ratio") < -tail
    strange = few_frequent | (z("symbol_ratio") > tail) | (z("odd_ratio") > tail) | (z("mean_word_len") > tail)
    noise = (z("junk_share") > far) | (strange & (z("noise_share") > far))
    table = z("table_share") > far
    listed = (z("list_share") > far) | ((z("short_share") > far) & (few_frequent | ((z("short_share") > 1.6 * far) & (c("n_lines") >= 4))))
    repeats = (z("repeat_ratio") > 0.7 * far) & ~table & ~(z("list_share") > far)
    of = lambda flag, share: F.when(flag, share).otherwise(0.0)
    junk_part = F.when(repeats, 1.0).otherwise(of(noise, c("noise_share")))
    list_part, table_part = of(listed, c("short_share")), of(table, c("table_share"))
    form = F.when(repeats | (noise & (junk_part >= table_part) & (junk_part >= list_part)), "junk").when(table & (table_part >= list_part), "table").when(listed, "list")
    return scored.select(key, form.alias("form")).filter("form is not null")


def document_forms(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, form) of the documents that aren't natural prose."""
    stats = cut(text_statistics(docs, frequent_words(words)), "textstats")  # read twice: for the sketches and for the scores
    return forms(robust_scores(stats))
