"""Queries of the subpackage, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillfold.llm import encode, mixing, names, neardup, newtext, pii, textquality
from quillfold.session import load


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_mails(load(spark, d, "emails"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.mail_classes(load(spark, d, "emails"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_parties(load(spark, d, "people"), load(spark, d, "person_identities"), load(spark, d, "email_participants"))


def p3_parties(spark: SparkSession, d: str) -> DataFrame:
    return names.party_members(load(spark, d, "people"), load(spark, d, "person_identities"), load(spark, d, "email_participants"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_information(load(spark, d, "emails"), load(spark, d, "evidence"))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted_texts(load(spark, d, "emails"), load(spark, d, "evidence"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return newtext.new_lines(load(spark, d, "emails"), load(spark, d, "email_participants"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(load(spark, d, "documents"), ["doc_id"])


def p7_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Ids with the byte offset of each token."""
    return encode.encode_offsets(load(spark, d, "documents"), ["doc_id"])


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mixture(load(spark, d, "documents"), load(spark, d, "mix_targets")).documents


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mixture(load(spark, d, "documents"), load(spark, d, "mix_targets")).report()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return textquality.document_forms(load(spark, d, "documents"), load(spark, d, "common_words"))


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    words = textquality.frequent_words(load(spark, d, "common_words"))
    return textquality.robust_scores(textquality.text_statistics(load(spark, d, "documents"), words))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n[0] == "p" and n[1:2].isdigit()}


P2_SQL = r"""
WITH kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id, lower(trim(provider_message_id, E' \t\n\r')) ORDER BY ingested_at NULLS LAST, id) AS n FROM emails) WHERE n = 1),
w AS (SELECT id, coalesce(thread_id, id) AS thread, list_distinct(regexp_extract_all(lower(concat_ws(' ', subject, body_text_full)), '[\p{L}\p{N}_]+')) AS words FROM kept),
s AS (SELECT id, thread, len(words) AS n, words FROM w WHERE len(words) >= 40), t AS (SELECT id, thread, n, unnest(words) AS word FROM s)
SELECT a.id AS email_a, b.id AS email_b FROM t a JOIN t b ON a.word = b.word AND a.id < b.id AND a.thread <> b.thread AND least(a.n, b.n) >= 0.7 * greatest(a.n, b.n)
GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.7 * (a.n + b.n - count(*)) - 1e-9
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL}
