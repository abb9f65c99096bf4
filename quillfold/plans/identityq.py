"""People, identities, conflicts and accounts of the mailboxes, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.functions.identity import TWO_PART_SUFFIXES
from quillfold.operators import resolution
from quillfold.session import load


def _observed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return resolution.observed_addresses(load(spark, d, "emails"), load(spark, d, "email_participants")), resolution.owner_addresses(load(spark, d, "users"), load(spark, d, "accounts"))


def identities(spark: SparkSession, d: str) -> DataFrame:
    """One row per address of a mailbox: who it stands for, and how that was found."""
    return resolution.resolve(*_observed(spark, d)).select("user_id", "address", "name", "messages", "is_self", "method", "confidence", "anchor", "person_id")


def resolved_people(spark: SparkSession, d: str) -> DataFrame:
    return resolution.people(resolution.resolve(*_observed(spark, d))).select("person_id", "user_id", "canonical_name", "is_self", "addresses", "messages")


def identity_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Suspected impersonation: names on look-alike domains, and domains that imitate an established one, strongest first."""
    seen, own = _observed(spark, d)
    names = resolution.name_conflicts(resolution.resolve(seen, own))
    return resolution.by_severity(names.unionByName(resolution.domain_conflicts(seen, own, names)))


def account_list(spark: SparkSession, d: str) -> DataFrame:
    """Accounts with their owners and the mails of each mailbox."""
    mails = load(spark, d, "emails").groupBy("user_id").agg(F.count("*").alias("mail_count"))
    u = load(spark, d, "users").select(F.col("id").alias("user_id"), F.col("display_name").alias("name"), F.col("role_profile").alias("role"), "tz_name")
    a = load(spark, d, "accounts").select(F.col("id").alias("account_id"), F.col("email_address").alias("address"), "user_id")
    return a.join(u, "user_id").join(mails, "user_id", "left").select("account_id", "address", "user_id", "name", "role", "tz_name", F.coalesce("mail_count", F.lit(0)).alias("mail_count"))


def participants_resolved(spark: SparkSession, d: str) -> DataFrame:
    """How many participants of each mailbox resolve to a person, by role."""
    r = resolution.resolve(*_observed(spark, d)).select("user_id", "address", "person_id", "is_self")
    p = load(spark, d, "email_participants").join(load(spark, d, "emails").select(F.col("id").alias("email_id"), "user_id"), "email_id").select("user_id", "part_role", F.lower(F.trim("raw_address")).alias("address"))
    return p.join(r, ["user_id", "address"], "left").groupBy("user_id", "part_role").agg(F.count("*").alias("rows"), F.count("person_id").alias("resolved"), F.count_if(F.coalesce("is_self", F.lit(False))).alias("own"), F.count_distinct("person_id").alias("people"))


_TWO = ", ".join(f"'{s}'" for s in TWO_PART_SUFFIXES)


def _reg(c: str) -> str:
    p = f"string_split({c}, '.')"
    return f"array_to_string({p}[CASE WHEN array_to_string({p}[-2:], '.') IN ({_TWO}) THEN -3 ELSE -2 END:], '.')"


def _relation(a: str, b: str, ra: str, rb: str) -> str:
    longer, shorter = f"CASE WHEN length({a}) >= length({b}) THEN {a} ELSE {b} END", f"CASE WHEN length({a}) >= length({b}) THEN {b} ELSE {a} END"
    return f"CASE WHEN {ra} = {rb} THEN 'same' WHEN {a} = {b} THEN 'sibling_tld' WHEN least(length({a}), length({b})) >= 4 AND list_contains(regexp_split_to_array({longer}, '[-_.]+'), {shorter}) THEN 'embedded_brand' WHEN least(length({a}), length({b})) >= 6 AND levenshtein({a}, {b}) <= 2 THEN 'typosquat' ELSE 'unrelated' END"


RESOLVED = f"""
WITH seen AS (SELECT e.user_id, lower(trim(raw_address)) AS address, p.email_id, p.part_role, p.part_no, CASE WHEN trim(raw_name) <> '' THEN raw_name END AS nm, epoch_us(CAST(e.provider_ts AS TIMESTAMPTZ)) AS us FROM email_participants p JOIN emails e ON e.id = p.email_id WHERE lower(trim(raw_address)) <> ''),
obs AS (SELECT user_id, address, arg_min(nm, {{'a': us, 'b': email_id, 'c': part_role, 'd': part_no}}) FILTER (nm IS NOT NULL) AS name, count(*) AS messages, min(us) AS first_at FROM seen GROUP BY 1, 2),
own AS (SELECT DISTINCT user_id, lower(trim(address)) AS address FROM (SELECT id AS user_id, address FROM users UNION ALL SELECT user_id, email_address FROM accounts) WHERE address IS NOT NULL),
keyed AS (SELECT o.*, w.address IS NOT NULL AS is_self, CASE WHEN w.address IS NULL AND trim(o.name) <> '' THEN lower(trim(o.name)) END AS nk FROM obs o LEFT JOIN own w ON w.user_id = o.user_id AND w.address = o.address),
anch AS (SELECT user_id, nk, arg_min({{'a': address, 'm': messages}}, {{'m': -messages, 'a': address}}) AS a FROM keyed WHERE nk IS NOT NULL GROUP BY 1, 2),
pair AS (SELECT k.*, a.a.a AS anchor, a.a.m AS anchor_messages, lower(trim(regexp_replace(k.address, '^.*@', ''))) AS da, lower(trim(regexp_replace(a.a.a, '^.*@', ''))) AS db FROM keyed k LEFT JOIN anch a ON a.user_id = k.user_id AND a.nk = k.nk),
regs AS (SELECT *, {_reg('da')} AS ra, {_reg('db')} AS rb FROM pair),
rels AS (SELECT *, {_relation("split_part(rb, '.', 1)", "split_part(ra, '.', 1)", 'rb', 'ra')} AS relation FROM regs),
meth AS (SELECT *, CASE WHEN is_self OR nk IS NULL OR address = anchor THEN 'exact' WHEN relation NOT IN ('embedded_brand', 'typosquat', 'sibling_tld') THEN 'name_match' ELSE 'lookalike_split' END AS method FROM rels),
res AS (SELECT *, substr(sha256(user_id || '|' || CASE WHEN is_self THEN 'self' WHEN nk IS NULL OR method = 'lookalike_split' THEN 'address|' || address ELSE 'name|' || nk END), 1, 16) AS person_id, (CASE WHEN method = 'name_match' THEN 0.85 ELSE 1.0 END)::DOUBLE AS confidence FROM meth)
"""
_CONFLICTS = RESOLVED + f""",
nc AS (SELECT user_id, name AS observed_name, anchor AS address_a, address AS address_b, relation, anchor_messages AS messages_a, messages AS messages_b FROM res WHERE method = 'lookalike_split'),
dom AS (SELECT user_id, lower(trim(regexp_replace(address, '^.*@', ''))) AS domain, sum(messages) AS n, arg_min(address, {{'f': first_at, 'a': address}}) AS shown, arg_min({{'n': name}}, {{'f': first_at, 'a': address}}).n AS name FROM obs WHERE address LIKE '%@%' GROUP BY 1, 2),
od AS (SELECT DISTINCT user_id, lower(trim(regexp_replace(address, '^.*@', ''))) AS domain FROM own),
est AS (SELECT d.*, {_reg('d.domain')} AS reg, n >= 3 OR od.domain IS NOT NULL AS old FROM dom d LEFT JOIN od ON od.user_id = d.user_id AND od.domain = d.domain),
met AS (SELECT a.user_id, a.domain AS da, a.name, b.shown AS sb, a.shown AS sa, b.n AS nb, a.n AS na, b.domain AS db, {_relation("split_part(a.reg, '.', 1)", "split_part(b.reg, '.', 1)", 'a.reg', 'b.reg')} AS relation FROM est a JOIN est b ON a.user_id = b.user_id AND NOT a.old AND b.old),
lik AS (SELECT *, CASE relation WHEN 'embedded_brand' THEN 0 WHEN 'typosquat' THEN 1 ELSE 2 END AS sev FROM met WHERE relation IN ('embedded_brand', 'typosquat', 'sibling_tld')),
dc AS (SELECT user_id, name AS observed_name, sb AS address_a, sa AS address_b, relation, nb AS messages_a, na AS messages_b FROM (SELECT *, row_number() OVER (PARTITION BY user_id, da ORDER BY sev, nb DESC, db) AS k FROM lik) l WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM nc WHERE nc.user_id = l.user_id AND nc.address_b = l.sa)),
u AS (SELECT * FROM nc UNION ALL SELECT * FROM dc)
SELECT user_id, observed_name, address_a, address_b, relation, CAST(messages_a AS BIGINT) AS messages_a, CAST(messages_b AS BIGINT) AS messages_b, row_number() OVER (PARTITION BY user_id ORDER BY CASE relation WHEN 'embedded_brand' THEN 0 WHEN 'typosquat' THEN 1 ELSE 2 END, messages_a DESC, address_b) AS rank FROM u
"""

QUERIES = {
    "identities": (identities, RESOLVED + "SELECT user_id, address, name, messages, is_self, method, confidence, anchor, person_id FROM res"),
    "resolved_people": (resolved_people, RESOLVED + "SELECT person_id, user_id, arg_min({'n': name}, {'m': -messages, 'a': address}).n AS canonical_name, bool_or(is_self) AS is_self, count(*) AS addresses, CAST(sum(messages) AS BIGINT) AS messages FROM res GROUP BY 1, 2"),
    "identity_conflicts": (identity_conflicts, _CONFLICTS),
    "account_list": (account_list, "SELECT a.id AS account_id, a.email_address AS address, u.id AS user_id, u.display_name AS name, u.role_profile AS role, u.tz_name, (SELECT count(*) FROM emails e WHERE e.user_id = u.id) AS mail_count FROM accounts a JOIN users u ON u.id = a.user_id"),
    "participants_resolved": (
        participants_resolved,
        RESOLVED + "SELECT s.user_id, s.part_role, count(*) AS rows, count(r.person_id) AS resolved, count(*) FILTER (coalesce(r.is_self, false)) AS own, count(DISTINCT r.person_id) AS people FROM (SELECT e.user_id, p.part_role, lower(trim(raw_address)) AS address FROM email_participants p JOIN emails e ON e.id = p.email_id) s LEFT JOIN res r ON r.user_id = s.user_id AND r.address = s.address GROUP BY 1, 2",
    ),
}
