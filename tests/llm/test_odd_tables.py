"""Nulls in every column, empty and very long texts, repeated rows, empty tables and clashing extra columns: nothing crashes, and results are defined."""

from datetime import datetime

import pytest

from quillfold.llm import mixing, names, neardup, newtext, pii, textquality

T = datetime(2026, 1, 1)
MAIL = "id string, account_id string, user_id string, thread_id string, provider_message_id string, rfc_message_id string, subject string, body_text_novel string, body_text_full string, provider_ts string, ingested_at timestamp, words string, mail string, h string, rep string, cell int, text string"
WORDS = " ".join(f"word{i}" for i in range(60))
LONG = WORDS + " " + " ".join(f"w{i}" for i in range(120_000))
CLASH = ("x", "x", "x", "x", 1, "x")


def mails(spark):
    full = lambda i, t, body: (i, "a", "u", t, i, None, "s", body, body, "2026-01-01T00:00:00Z", T, *CLASH)
    rows = [full("m1", "t1", WORDS), full("m1", "t1", WORDS), full("m2", "t2", WORDS), full("m3", None, LONG), full("m4", "t4", LONG), full("m5", "t5", ""), full("m6", "t6", None)]
    rows += [tuple([None] * 11) + CLASH, tuple([None] * 11) + CLASH]
    return spark.createDataFrame(rows, MAIL)


def parts(spark):
    rows = [("m1", "from", 0, "a@x.example", None, "p"), (None, None, None, None, None, None), ("m1", "from", 0, "a@x.example", None, "p")]
    return spark.createDataFrame(rows, "email_id string, part_role string, part_no int, raw_address string, raw_name string, person_id string")


def test_similar_mails(spark):
    got = sorted(tuple(r) for r in neardup.similar_mails(mails(spark)).collect())
    assert got == [("m1", "m2"), ("m3", "m4")]
    assert neardup.similar_mails(mails(spark).limit(0)).count() == 0
    assert {r.id: r.copies for r in neardup.mail_classes(mails(spark)).collect()} == {"m1": 2, "m2": 2, "m3": 2, "m4": 2}


def test_new_lines(spark):
    got = sorted(tuple(r) for r in newtext.new_lines(mails(spark), parts(spark)).collect())
    assert got == [("m1", 1), ("m2", 1), ("m3", 1), ("m4", 1)]
    assert newtext.new_lines(mails(spark).limit(0), parts(spark).limit(0)).count() == 0


def test_personal_information(spark):
    quotes = spark.createDataFrame([("e1", None, None), (None, None, None), ("e2", "mail a@b.example", 1), ("e2", "mail a@b.example", 1)], "id string, evidence_quote string, ingest_seq long")
    assert {tuple(r) for r in pii.personal_information(mails(spark), quotes).collect()} == {("evidence", "e2", "email", 5)}
    assert pii.redacted_texts(mails(spark), quotes).count() == mails(spark).count() + 1


def test_parties(spark):
    people = spark.createDataFrame([("p", "u", None), ("p", "u", None), (None, None, None), ("q", None, "A B"), ("r", "u", "Z" * 3000 + " " + "Y" * 3000)], "id string, user_id string, canonical_name string")
    ids = spark.createDataFrame([("p", None, None, None), (None, None, None, None), ("r", "@", "  ", None)], "person_id string, address string, observed_name string, message_count int")
    assert names.same_parties(people, ids, parts(spark)).count() == 0
    assert sorted(r.person_id for r in names.party_members(people, ids, parts(spark)).collect()) == ["p", "r"]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)] * 3, [(1, "", "", ""), (2, "x" * 200_000, "en", "s"), (2, "x" * 200_000, "en", "s")]])
def test_documents(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, lang string, source string, n_tokens int, post int")
    words = spark.createDataFrame([("en", "the"), (None, None)], "lang string, word string")
    assert textquality.document_forms(docs, words).count() in (0, 2)
    targets = spark.createDataFrame([("s", 0.5, 2), ("s", 0.5, None), (None, None, None)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(docs, targets)
    assert m.documents.count() in (0, 2) and m.report().count() == 1
