"""Text, identity and time functions against tables of cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from quillfold.functions import identity as ident
from quillfold.functions import jsonfns, signals, text, timefns


def one(spark, c, **row):
    df = spark.range(1).select(*[F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in row.items()])
    return df.select(c.alias("r")).first()[0]


@pytest.mark.parametrize("domain,want", [("m.shop.acme.io", "acme.io"), ("x.y.acme.co.uk", "acme.co.uk"), ("acme.co.uk", "acme.co.uk"), ("localhost", "localhost"), (None, None)])
def test_registrable(spark, domain, want):
    assert one(spark, ident.registrable(F.col("d")), d=domain) == want


@pytest.mark.parametrize(
    "a,b,want",
    [("mail.acme.io", "acme.io", "same"), ("acme-pay.io", "acme.io", "embedded_brand"), ("northfeild.com", "northfield.com", "typosquat"), ("acme.io", "acme.net", "sibling_tld"), ("acmeworks.com", "acme.io", "unrelated"), (None, "acme.io", None)],
)
def test_domain_relation(spark, a, b, want):
    rows = spark.createDataFrame([(a, b)], "a string, b string")
    assert ident.with_relation(rows, F.col("a"), F.col("b")).first().relation == want
    assert ident.with_relation(rows, F.col("b"), F.col("a")).first().relation == want


@pytest.mark.parametrize("b,allowed", [("y@acme.net", False), ("y@acme-pay.io", False), ("y@mail.acme.io", True), ("y@other.org", True), (None, True)])
def test_may_merge(spark, b, allowed):
    rows = ident.with_relation(spark.createDataFrame([("x@acme.io", b)], "a string, b string"), ident.domain_of(F.col("a")), ident.domain_of(F.col("b")))
    assert rows.select(ident.may_merge(F.col("relation"))).first()[0] is allowed


@pytest.mark.parametrize("s,want", [("RE: Fwd: re[2]: Plan  A ", "plan a"), (None, ""), ("Report", "report")])
def test_subject(spark, s, want):
    assert one(spark, text.normalize_subject(F.col("s")), s=s) == want


@pytest.mark.parametrize("s,want", [("Ok.\n> old\nYes", "Ok.\nYes"), ("New\nOn Monday, A wrote:\nold", "New"), (None, ""), ("", "")])
def test_split_novel(spark, s, want):
    assert one(spark, text.split_novel(F.col("s")), s=s) == want


@pytest.mark.parametrize("s,want", [("Please send the pricing sheet", "pricing sheet"), ("pricing sheet sent", "pricing sheet"), (None, ""), ("j i h g f e d c b", "b c d e f g h j")])
def test_title(spark, s, want):
    assert one(spark, text.title_key(F.col("s")), s=s) == want


def test_match_key_and_jaccard(spark):
    assert one(spark, text.match_key(F.lit("request"), F.lit(None).cast("string"), F.col("s")), s="the plan") == "request|unassigned|plan"
    words = lambda s: F.split(F.lit(s), " ")
    assert spark.range(1).select(text.jaccard(words("a b c"), words("b c d")), text.jaccard(F.array().cast("array<string>"), words("a"))).first() == (0.5, 0.0)


@pytest.mark.parametrize("q,t,found,at", [("too few", "xx too few", False, None), ("see the plan", "we see the\nplan", True, None), ("see the plan", "we see the plan", True, 3), ("call 1234567", "call 1234568", False, None), (None, "x", False, None), ("see the plan", None, False, None)])
def test_find_quote(spark, q, t, found, at):
    r = one(spark, text.find_quote(F.col("q"), F.col("t")), q=q, t=t)
    assert (r.found, r["at"]) == (found, at)


@pytest.mark.parametrize(
    "s,due,conf",
    [("by friday, or monday", date(2026, 6, 26), 0.7), ("today, not 2026-09-01", date(2026, 6, 19), 0.7), ("I sent it yesterday", date(2026, 6, 18), 0.7), ("9999-99-99 or monday", date(2026, 6, 22), 0.7), ("2026-07-01, or today", date(2026, 7, 1), 0.9), ("eod or EOW", date(2026, 6, 19), 0.5), ("by Friday", date(2026, 6, 26), 0.7), ("end of week", date(2026, 6, 19), 0.5), ("EOD", date(2026, 6, 19), 0.5), ("2026-07-01", date(2026, 7, 1), 0.9), ("Jul 1", None, 0.0), (None, None, 0.0), ("9999-99-99", None, 0.0)],
)
def test_resolve_due(spark, s, due, conf):
    r = one(spark, timefns.resolve_due(F.col("s"), F.lit("2026-06-19").cast("date")), s=s)
    assert (r.due, float(r.confidence)) == (due, conf)


def test_mentions():
    got = timefns.mentions("next Monday or 2026-07-01, Jul 3, eod", date(2026, 6, 19))
    assert [(m["kind"], m["resolved"]) for m in got] == [("weekday", date(2026, 6, 22)), ("iso", date(2026, 7, 1)), ("monthday", None), ("fuzzy", None)]
    assert timefns.mentions(None, date(2026, 1, 1)) == [] and timefns.mentions("today", None) == []
    assert len(timefns.mentions("today " * 50, date(2026, 1, 1))) == 20


def test_small_ones(spark):
    assert one(spark, text.word_count(F.col("s")), s="  a  b\n") == 2 and one(spark, text.word_count(F.col("s")), s=None) == 0
    assert one(spark, text.urlsafe_b64(F.col("s")), s="a?>") == "YT8-"
    assert one(spark, text.address(F.lit(None).cast("string"), F.col("s")), s="a@b.c") == "a@b.c"
    assert text.search_terms("The spare, Budget & me") == ["spare", "budget"]


@pytest.mark.parametrize("s,want", [("Please send it", True), ("please note", False), ("Any update", True), ("are you able", False), ("Why?", True), (None, False)])
def test_asking(spark, s, want):
    assert one(spark, text.contains_question(F.lit(None).cast("string"), F.col("s")), s=s) is want


def test_highlight_and_snippet(spark):
    assert tuple(one(spark, text.highlight(F.col("t"), F.col("q")), t="see the plan now", q="plan")) == ("see the ", "plan", " now")
    assert tuple(one(spark, text.highlight(F.col("t"), F.col("q")), t="see", q="plan")) == ("see", None, None)
    assert one(spark, text.snippet_matches(F.col("a"), F.col("b")), a="Hi all, the plan for", b="Hi all,\n the  plan for it") and not one(spark, text.snippet_matches(F.col("a"), F.col("b")), a="Other", b="Hi")


def headers(**kv):
    return F.map_from_arrays(F.array(*[F.lit(k.replace("_", "-")) for k in kv]), F.array(*[F.lit(v) for v in kv.values()])) if kv else F.create_map().cast("map<string,string>")


@pytest.mark.parametrize(
    "kv,sender,want",
    [({"Precedence": "Bulk"}, "a@x.io", "precedence_bulk"), ({}, "alerts@x.io", "noreply_local"), ({}, "do-not-reply@x.io", "noreply_local"), ({"Auto_Submitted": ""}, "a@x.io", None), ({"Auto_Submitted": "auto-replied", "List_Unsubscribe": "x"}, "a@x.io", "auto_submitted"), ({"Feedback_ID": "1"}, None, "esp_return_path"), ({}, "systematic@x.io", None)],
)
def test_automation(spark, kv, sender, want):
    assert one(spark, signals.automation(headers(**kv), F.col("s")), s=sender) == want


@pytest.mark.parametrize(
    "kv,category,auto,subject,want",
    [({"List_ID": "l"}, None, False, "Invoice 12 overdue", None), ({"List_ID": "l"}, None, False, "News", "list_archive"), ({}, "CATEGORY_PROMOTIONS", False, "News", None), ({}, "CATEGORY_PROMOTIONS", True, "News", "promotion"), ({}, "CATEGORY_SOCIAL", True, None, "advert"), ({}, "CATEGORY_PROMOTIONS", True, "Your plan renews", None)],
)
def test_noise(spark, kv, category, auto, subject, want):
    assert one(spark, signals.noise(headers(**kv), F.col("cat"), F.lit(auto), F.col("s")), cat=category, s=subject) == want


def test_json(spark):
    got = one(spark, jsonfns.canonical_json({"b": F.col("s"), "a": F.lit(1), "c": F.lit(None).cast("string")}), s='x "y"')
    assert got == '{"a":1,"b":"x \\"y\\"","c":null}' and len(one(spark, jsonfns.hash16(F.col("s")), s=got)) == 16
    assert one(spark, jsonfns.parse_or(F.col("s"), "value string, n int"), s='{"n": 3}').n == 3
    assert one(spark, jsonfns.parse_or(F.col("s"), "value string, n int"), s="not json").value == "not json"
