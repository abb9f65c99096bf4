"""Claims out of messages: candidates by native patterns, and any extractor as a table function with retries and a gate."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentences that ask, promise and report, as (attribute, pattern with the summary in group 1).
PATTERNS = (
    ("request.action", r"(?:Could you|Can you|Please) ([^.?!\n]{8,120})"),
    ("commitment.action", r"I'll ([^.?!\n]{8,120})"),
    ("completion.action", r"I moved ([^.?!\n]{8,120})"),
    ("cancellation", r"([^.?!\n]{4,60}) cancelled "),
)
CLAIM_SCHEMA = "email_id string, place int, attribute string, summary string, evidence_quote string, confidence double, error string, attempts int"


def claim_candidates(messages: DataFrame, text: str = "body_text_novel") -> DataFrame:
    """(email_id, place, attribute, summary, evidence_quote): what patterns find in new text, natively; null texts have none. The quote is the sentence's own words."""

    def quotes(attribute: str, pattern: str):
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
        return F.transform(found, lambda q: F.struct(F.lit(attribute).alias("attribute"), F.regexp_extract(q, pattern, 1).alias("summary"), q.alias("evidence_quote")))

    found = [quotes(a, p) for a, p in PATTERNS]
    return messages.select(F.col("id").alias("email_id"), F.posexplode(F.concat(*found)).alias("place", "c")).select("email_id", "place", "c.*")


class Retry(Exception):
    """Raised by an extractor when the call may be tried again."""


def backoff(attempt: int, base: float = 0.5, most: float = 20.0, rnd: random.Random | None = None) -> float:
    """Seconds to wait before the next attempt: doubled each time, at most ``most``, with up to a quarter of jitter."""
    return min(most, base * 2**attempt) * (1 + 0.25 * (rnd or random).random())


def extract_claims(messages: DataFrame, extractor: Callable[[dict], list[dict]], columns: list[str], tries: int = 5, fallback: Callable[[dict], list[dict]] | None = None, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Claims of each message, one row each; a message that stays without an answer gives one row with ``error``.

    ``extractor`` takes a message (``columns`` as a dict) and returns claims
    with attribute, summary, evidence_quote and confidence. It is called once a
    message; ``Retry`` is tried again with growing pauses, another error goes to
    ``fallback`` at once. A message without claims gives one row without
    attribute, so an attempt is on record and isn't paid for twice. The stage
    streams; nothing is shuffled.
    """

    def ask(call: Callable[[dict], list[dict]], row: dict) -> tuple[list[dict] | None, str | None, int]:
        for attempt in range(tries):
            try:
                return call(row), None, attempt + 1
            except Retry as e:
                error = f"retry: {e}"
                if attempt + 1 < tries:
                    wait(backoff(attempt))
            except Exception as e:  # noqa: BLE001 - whatever an extractor raises is its answer
                return None, f"{type(e).__name__}: {e}"[:300], attempt + 1
        return None, error, tries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CLAIM_SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int32(), *[pa.string()] * 3, pa.float64(), pa.string(), pa.int32()]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                claims, error, n = ask(extractor, row)
                if claims is None and fallback is not None:
                    claims, error, more = ask(fallback, row)
                    n += more
                for place, c in enumerate(claims or [{}]):
                    out.append((row["id"], place, c.get("attribute"), c.get("summary"), c.get("evidence_quote"), float(c.get("confidence") or 0.5) if c else None, error, n))
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return messages.select("id", *[c for c in columns if c != "id"]).mapInArrow(run, CLAIM_SCHEMA)


def readable_claims(text: str | None) -> list[dict]:
    """The claims of a model's JSON answer, ``{"claims": [...]}``; anything else is a retry."""
    try:
        claims = json.loads(text or "")["claims"]
        assert isinstance(claims, list) and all(isinstance(c, dict) for c in claims)
    except (ValueError, KeyError, TypeError, AssertionError) as e:
        raise Retry(f"no readable answer: {e}") from None
    return claims


def strip_foreign_keys(ddl: str) -> str:
    """A CREATE TABLE statement without references to other tables, for stores that load tables in any order."""
    import re

    ddl = re.sub(r",?\s*(?:CONSTRAINT\s+\w+\s+)?FOREIGN\s+KEY\s*\([^)]*\)\s*REFERENCES\s+\w+\s*(?:\([^)]*\))?(?:\s+ON\s+(?:DELETE|UPDATE)\s+(?:CASCADE|RESTRICT|SET\s+NULL|NO\s+ACTION))*", "", ddl, flags=re.I)
    return re.sub(r"\s+REFERENCES\s+\w+\s*(?:\([^)]*\))?(?:\s+ON\s+(?:DELETE|UPDATE)\s+(?:CASCADE|RESTRICT|SET\s+NULL|NO\s+ACTION))*", "", ddl, flags=re.I)
