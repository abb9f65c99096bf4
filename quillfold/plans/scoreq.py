"""Scoring of the questions against a gold set, each with its SQL twin.

The curated gold files aren't part of the test tables. The gold set here is read
off the ledger by a fixed rule: a thread whose claims come from at least two
mails is a gold item; digits of its hash give the question it belongs to and its
tier, its claims' attributes are its tags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.operators import ledger, scoring
from quillfold.operators.changefeed import clean_key
from quillfold.plans import ledgerq
from quillfold.session import cut, load

#: Questions scored, by the second digit of a gold item's hash modulo 3.
ASKED = ("q1_needs_attention", "q3_waiting_on_me", "q4_waiting_on_others")


def gold_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gold, gold_messages, tags)."""
    e = ledger.first_deliveries(load(spark, d, "evidence").filter("thread_id is not null and source_email_id is not null"))
    rows = e.select("user_id", F.col("thread_id").alias("gold_id"), F.col("source_email_id").alias("message_id"), clean_key(F.col("attribute")).alias("tag"))
    digit = lambda n: F.conv(F.substring(F.md5("gold_id"), n, 1), 16, 10).cast("int")
    question = F.element_at(F.array(*[F.lit(q) for q in ASKED]), (digit(2) % 3) + 1)
    tier = F.when(digit(1) < 11, "must_include").when(digit(1) < 14, "acceptable").otherwise("must_not_include")
    gold = rows.groupBy("user_id", "gold_id").agg(F.count_distinct("message_id").alias("mails")).filter("mails >= 2").select("user_id", question.alias("question"), "gold_id", tier.alias("tier"), "mails")
    messages = rows.select("user_id", "gold_id", "message_id").distinct().join(gold.select("user_id", "gold_id", "question"), ["user_id", "gold_id"])
    return gold, messages, rows.filter("tag is not null").select("gold_id", "tag").distinct()


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    claim = ledgerq._claims(spark, d)
    parts = [ledgerq.ask(spark, d, q, claim=claim).select("user_id", F.lit(q).alias("question"), "work_item_id", "rank") for q in ASKED]
    answers = parts[0].unionByName(parts[1]).unionByName(parts[2])
    items = ledger.exact_items(claim)
    of_claims = claim.filter("act is not null").withColumn("match_key", ledger._key()).join(items.select("user_id", "match_key", "item_id"), ["user_id", "match_key"]).select(F.col("item_id").alias("work_item_id"), F.col("source_email_id").alias("message_id"))
    return cut(answers, "answers"), scoring.message_sets(of_claims, items.select(F.col("item_id").alias("work_item_id"), F.col("source_email_id").alias("message_id")))


def gold_scores(spark: SparkSession, d: str) -> DataFrame:
    gold, messages, _ = gold_sets(spark, d)
    return scoring.score(*_answers(spark, d), gold, messages)


def gold_totals(spark: SparkSession, d: str) -> DataFrame:
    return scoring.totals(gold_scores(spark, d))


def gold_misses(spark: SparkSession, d: str) -> DataFrame:
    gold, messages, tags = gold_sets(spark, d)
    return scoring.misses_by_tag(gold, scoring.hits(*_answers(spark, d), messages), tags)


def gold_recall_at(spark: SparkSession, d: str) -> DataFrame:
    gold, messages, _ = gold_sets(spark, d)
    return scoring.recall_at(*_answers(spark, d), gold, messages)


def gold_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Gold items by question, a column for each tier."""
    gold, _, _ = gold_sets(spark, d)
    return gold.groupBy("question").pivot("tier", ["must_include", "acceptable", "must_not_include"]).agg(F.count("gold_id")).na.fill(0)


def gold_checks(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules of the gold set against the mailboxes: unknown messages, messages of other mailboxes, evidence that is also a trap, too few or too many items, too few traps."""
    gold, messages, _ = gold_sets(spark, d)
    mail = load(spark, d, "emails").select(F.col("id").alias("message_id"), F.col("user_id").alias("of"))
    known = messages.join(mail, "message_id", "left")
    tiered = messages.join(gold.select("user_id", "gold_id", "tier"), ["user_id", "gold_id"])
    trap = F.col("tier") == "must_not_include"
    clash = tiered.groupBy("user_id", "question", "message_id").agg(F.bool_or(trap).alias("t"), F.bool_or(~trap).alias("e")).filter("t and e")
    size = gold.groupBy("user_id", "question").agg(F.count_if(~trap).alias("items"), F.count_if(trap).alias("traps"))
    rules = {"message_unknown": known.filter("of is null"), "message_of_other_mailbox": known.filter("of != user_id"), "evidence_is_trap": clash, "fewer_than_3_items": size.filter("items < 3"), "more_than_20_items": size.filter("items > 20"), "fewer_than_4_traps": size.filter("traps < 4")}
    out = None
    for name, df in rules.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_GOLD = """,
fe AS (SELECT id, arg_min({'u': user_id, 'm': source_email_id, 'a': attribute, 't': thread_id}, ingest_seq) AS r FROM evidence WHERE id IS NOT NULL AND thread_id IS NOT NULL AND source_email_id IS NOT NULL AND user_id IS NOT NULL GROUP BY id),
gr AS (SELECT fe.r.u AS user_id, fe.r.t AS gold_id, fe.r.m AS message_id, lower(trim(fe.r.a, E' \\t\\n\\r')) AS tag FROM fe),
gd AS (SELECT user_id, gold_id, count(DISTINCT message_id) AS mails, strpos('0123456789abcdef', substr(md5(gold_id), 1, 1)) - 1 AS d1, strpos('0123456789abcdef', substr(md5(gold_id), 2, 1)) - 1 AS d2 FROM gr GROUP BY 1, 2 HAVING count(DISTINCT message_id) >= 2),
gold AS (SELECT user_id, gold_id, ['q1_needs_attention', 'q3_waiting_on_me', 'q4_waiting_on_others'][d2 % 3 + 1] AS question, CASE WHEN d1 < 11 THEN 'must_include' WHEN d1 < 14 THEN 'acceptable' ELSE 'must_not_include' END AS tier FROM gd),
gm AS (SELECT DISTINCT gr.user_id, gr.gold_id, gr.message_id, gold.question FROM gr JOIN gold ON gold.user_id = gr.user_id AND gold.gold_id = gr.gold_id)
"""
_ANSWERS = (
    ledgerq.SCORED
    + _GOLD
    + f""",
an AS (
  SELECT user_id, 'q1_needs_attention' AS question, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM scored JOIN (SELECT id AS eid FROM emails) ON eid = source_email_id
  UNION ALL SELECT user_id, 'q3_waiting_on_me', item_id, row_number() OVER (PARTITION BY user_id ORDER BY due ASC NULLS LAST, last_at DESC, item_id) FROM items JOIN (SELECT id AS eid FROM emails) ON eid = source_email_id WHERE status = 'OPEN' AND coalesce(owner_is_self, false)
  UNION ALL SELECT user_id, 'q4_waiting_on_others', item_id, row_number() OVER (PARTITION BY user_id ORDER BY due ASC NULLS LAST, round(({ledgerq._LATE} - last_at) / 86400000000.0, 4) DESC, item_id) FROM items JOIN (SELECT id AS eid FROM emails) ON eid = source_email_id WHERE status = 'OPEN' AND NOT coalesce(owner_is_self, false)),
top AS (SELECT * FROM an WHERE rank <= 25),
im AS (SELECT DISTINCT i.item_id, o.source_email_id AS message_id FROM items i JOIN opening o ON o.user_id = i.user_id AND o.mk = i.mk),
hit AS (SELECT g.user_id, g.question, g.gold_id, arg_min(t.item_id, {{'r': t.rank, 'i': t.item_id}}) AS item_id, min(t.rank) AS rank FROM gm g JOIN im ON im.message_id = g.message_id JOIN top t ON t.user_id = g.user_id AND t.question = g.question AND t.item_id = im.item_id GROUP BY 1, 2, 3),
tg AS (SELECT g.*, h.item_id, h.rank AS hit_rank FROM gold g LEFT JOIN hit h ON h.user_id = g.user_id AND h.question = g.question AND h.gold_id = g.gold_id),
sc AS (SELECT user_id, question, count(*) FILTER (tier = 'must_include') AS gold_items, count(*) FILTER (tier = 'must_include' AND item_id IS NOT NULL) AS covered, count(DISTINCT CASE WHEN tier = 'must_include' THEN item_id END) AS matched, count(*) FILTER (tier = 'must_not_include' AND item_id IS NOT NULL) AS leaked FROM tg GROUP BY 1, 2),
full_ AS (SELECT s.*, coalesce(n, 0) AS answers FROM sc s LEFT JOIN (SELECT user_id, question, count(*) AS n FROM top GROUP BY 1, 2) a ON a.user_id = s.user_id AND a.question = s.question)
"""
)
_RATIO = "CASE WHEN {1} = 0 THEN NULL ELSE round({0} / {1}, 6) END"
QUERIES = {
    "gold_scores": (gold_scores, _ANSWERS + f"SELECT user_id, question, gold_items, answers, covered, matched, leaked, {_RATIO.format('covered', 'gold_items')} AS recall, {_RATIO.format('matched', 'answers')} AS precision FROM full_"),
    "gold_totals": (gold_totals, _ANSWERS + f"SELECT *, {_RATIO.format('covered', 'gold_items')} AS recall FROM (SELECT coalesce(question, 'all') AS question, CAST(sum(gold_items) AS BIGINT) AS gold_items, CAST(sum(answers) AS BIGINT) AS answers, CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(leaked) AS BIGINT) AS leaked FROM full_ GROUP BY ROLLUP (question))"),
    "gold_misses": (gold_misses, _ANSWERS + "SELECT tag, n, row_number() OVER (ORDER BY n DESC, tag) AS rank FROM (SELECT tag, count(*) AS n FROM tg JOIN (SELECT DISTINCT gold_id AS g, tag FROM gr WHERE tag IS NOT NULL) ON g = tg.gold_id WHERE tier = 'must_include' AND item_id IS NULL GROUP BY tag)"),
    "gold_recall_at": (gold_recall_at, _ANSWERS + f"SELECT *, {_RATIO.format('covered', 'gold_items')} AS recall FROM (SELECT question, k, count(*) FILTER (hit_rank <= k) AS covered, count(*) AS gold_items FROM tg CROSS JOIN (SELECT unnest([1, 5, 10, 25]) AS k) WHERE tier = 'must_include' GROUP BY 1, 2)"),
    "gold_histogram": (gold_histogram, "WITH x AS (SELECT 1)" + _GOLD + "SELECT question, " + ", ".join(f"count(*) FILTER (tier = '{t}') AS {t}" for t in ("must_include", "acceptable", "must_not_include")) + " FROM gold GROUP BY 1"),
    "gold_checks": (
        gold_checks,
        "WITH x AS (SELECT 1)" + _GOLD + """, kn AS (SELECT gm.*, e.user_id AS own FROM gm LEFT JOIN emails e ON e.id = gm.message_id), td AS (SELECT gm.*, tier FROM gm JOIN gold g ON g.user_id = gm.user_id AND g.gold_id = gm.gold_id), sz AS (SELECT user_id, question, count(*) FILTER (tier <> 'must_not_include') AS items, count(*) FILTER (tier = 'must_not_include') AS traps FROM gold GROUP BY 1, 2)
SELECT 'message_unknown' AS rule, count(*) AS n FROM kn WHERE own IS NULL UNION ALL SELECT 'message_of_other_mailbox', count(*) FROM kn WHERE own <> user_id
UNION ALL SELECT 'evidence_is_trap', count(*) FROM (SELECT 1 FROM td GROUP BY user_id, question, message_id HAVING bool_or(tier = 'must_not_include') AND bool_or(tier <> 'must_not_include'))
UNION ALL SELECT 'fewer_than_3_items', count(*) FROM sz WHERE items < 3 UNION ALL SELECT 'more_than_20_items', count(*) FROM sz WHERE items > 20 UNION ALL SELECT 'fewer_than_4_traps', count(*) FROM sz WHERE traps < 4""",
    ),
}
