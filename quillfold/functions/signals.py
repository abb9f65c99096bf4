"""Signals of a message that need no model: was it sent by a machine, and is there anything in it to follow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillfold.functions.text import TRANSACTIONAL

# Local parts of addresses that nobody reads, header values of bulk mail.
NO_REPLY = r"(?i)^(no[-_.]?reply|do[-_.]?not[-_.]?reply|notifications?|mailer|bounce|postmaster|automated|auto|alerts?|system)\b"
BULK = ("bulk", "list", "junk")
PROMOTIONS, SOCIAL, UPDATES = "CATEGORY_PROMOTIONS", "CATEGORY_SOCIAL", "CATEGORY_UPDATES"


def header(headers: Column, name: str) -> Column:
    """One header's value; null where the map is null, lacks it or holds an empty value."""
    return F.nullif(headers[name], F.lit(""))


def first_reason(rules: dict[str, Column]) -> Column:
    """The name of the first rule that holds; null if none does."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules.items()):
        out = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def automation(headers: Column, sender: Column) -> Column:
    """Why a message counts as sent by a machine, null if it doesn't."""
    return first_reason(
        {
            "auto_submitted": header(headers, "Auto-Submitted").isNotNull(),
            "list_unsubscribe": header(headers, "List-Unsubscribe").isNotNull(),
            "precedence_bulk": F.lower(header(headers, "Precedence")).isin(*BULK),
            "esp_return_path": header(headers, "Feedback-ID").isNotNull(),
            "noreply_local": F.substring_index(F.coalesce(sender, F.lit("")), "@", 1).rlike(NO_REPLY),
        }
    )


def transactional(subject: Column) -> Column:
    return F.coalesce(subject, F.lit("")).rlike(TRANSACTIONAL)


def noise(headers: Column, category: Column, automated: Column, subject: Column) -> Column:
    """Why a message is kept from the extractor, null if it isn't. A transactional subject beats all else."""
    reason = first_reason(
        {
            "": transactional(subject),
            "list_archive": header(headers, "List-ID").isNotNull(),
            "promotion": (category == PROMOTIONS) & automated,
            "advert": (category == SOCIAL) & automated,
        }
    )
    return F.nullif(reason, F.lit(""))


def gate_variants(headers: Column, category: Column, automated: Column, subject: Column) -> dict[str, Column]:
    """The candidate gates of the noise study: true where the message would be dropped."""
    false = F.lit(False)
    listed = header(headers, "List-ID").isNotNull() | header(headers, "List-Unsubscribe").isNotNull()
    bulk = F.coalesce(F.lower(header(headers, "Precedence")).isin(*BULK), false) | header(headers, "X-Campaign-ID").isNotNull() | header(headers, "X-Mailer-Type").isNotNull()
    promo = F.coalesce(category.isin(PROMOTIONS, SOCIAL), false) & automated
    return {
        "category_or_bulk": F.coalesce(category.isin(PROMOTIONS, SOCIAL, UPDATES), false) | bulk | listed,
        "list_or_promo": listed | promo,
        "override_second": listed | (~transactional(subject) & promo),
        "override_first": ~transactional(subject) & (listed | promo),
        "list_only": listed,
        "none": false,
    }
