"""Queries over the mailbox tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillfold.operators.changefeed import current_claims
from quillfold.operators.delivery import surplus_deliveries
from quillfold.session import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return current_claims(load(spark, d, "evidence"))


P1_SQL = """
WITH c AS (
  SELECT DISTINCT lower(trim(work_item_id, E' \\t\\n\\r')) AS work_item_id, lower(trim(attribute, E' \\t\\n\\r')) AS attribute, id,
         CAST(observed_at AS TIMESTAMPTZ) AS ts, coalesce(step_no, 0) AS step,
         CASE WHEN lower(trim(op)) IN ('insert','ins','i','create','c') THEN 'I'
              WHEN lower(trim(op)) IN ('update','upd','u') THEN 'U' ELSE 'D' END AS kind
  FROM evidence WHERE work_item_id IS NOT NULL),
r AS (
  SELECT *, row_number() OVER (PARTITION BY work_item_id, attribute ORDER BY ts DESC, step DESC, id DESC) AS latest,
         max(CASE WHEN kind <> 'U' THEN strftime(ts AT TIME ZONE 'UTC', '%Y%m%d%H%M%S%f') || lpad(step::VARCHAR, 9, '0') || id || kind END)
           OVER (PARTITION BY work_item_id, attribute) AS edge
  FROM c)
SELECT work_item_id, attribute, id AS evidence_id FROM r WHERE latest = 1 AND right(edge, 1) = 'I'
"""


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return surplus_deliveries(load(spark, d, "emails"))


P6_SQL = """
SELECT id AS email_id FROM (
  SELECT id, row_number() OVER (PARTITION BY account_id, lower(trim(provider_message_id, E' \\t\\n\\r')) ORDER BY ingested_at NULLS LAST, id) AS n
  FROM emails WHERE account_id IS NOT NULL AND provider_message_id IS NOT NULL)
WHERE n > 1
"""

QUERIES = {"p1_found": (p1_found, P1_SQL), "p6_found": (p6_found, P6_SQL)}
