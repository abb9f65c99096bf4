"""Extractors, control-plane operators, resolution and scoring on small tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillfold.operators import control, extract, resolution, scoring
from quillfold.streaming import feeds

T0 = datetime(2026, 1, 1)


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_cursor_stops_at_a_gap(spark):
    q = spark.createDataFrame([("a", 1, "x", True), ("a", 2, "x", False), ("a", 3, "x", True), ("b", 1, "x", True), ("c", 1, "x", False)], "acc string, n int, id string, done boolean")
    assert rows(control.advance_cursor(q, "acc", ["n", "id"], "done")) == {("a", 1, 1), ("b", 1, 0), ("c", None, 1)}
    assert control.advance_cursor(q.limit(0), "acc", ["n", "id"], "done").count() == 0


def test_suppressions_end(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    sup = spark.createDataFrame([("a", None), ("b", T0), ("c", T0 + timedelta(9)), ("c", T0)], "id string, suppressed_until timestamp")
    assert rows(control.not_suppressed(items, sup, "id", F.lit(T0 + timedelta(1)))) == {("b",), ("d",)}


def test_a_missed_run_widens_the_window(spark):
    runs = spark.createDataFrame([("u", T0), ("u", T0 + timedelta(1)), ("u", T0 + timedelta(5)), ("u", T0)], "u string, at timestamp")
    w = control.digest_windows(runs, "u", "at")
    assert rows(w) == {("u", None, T0), ("u", T0, T0 + timedelta(1)), ("u", T0 + timedelta(1), T0 + timedelta(5))}
    c = spark.createDataFrame([("u", T0 + timedelta(hours=h), h) for h in (0, 24, 30, 200)] + [("v", T0, 1)], "u string, t timestamp, n int")
    assert {(r.n, r.window_end) for r in control.in_windows(c, w, "u", "t").collect()} == {(0, T0), (24, T0 + timedelta(1)), (30, T0 + timedelta(5))}


def test_field_changes_are_null_safe(spark):
    a = spark.createDataFrame([("k", 1, None), ("m", 2, "x"), ("gone", 1, "y")], "id string, n int, s string")
    b = spark.createDataFrame([("k", 1, "z"), ("m", 2, "x"), ("new", 3, None)], "id string, n int, s string")
    assert rows(control.field_changes(a, b, "id", ["n", "s"])) == {("k", "s", None, "z", "updated"), ("gone", "n", "1", None, "removed"), ("gone", "s", "y", None, "removed"), ("new", "n", None, "3", "created")}


def test_dead_letters_and_resume(spark):
    f = spark.createDataFrame([("s", "a", True, T0, "e1"), ("s", "a", True, T0 + timedelta(1), "e2"), ("s", "b", True, T0, "e"), ("s", "c", True, T0, "e"), ("s", "c", True, T0, "e"), ("s", "c", False, T0, None)], "stage string, entity_id string, failed boolean, at timestamp, error_class string")
    assert [(r.entity_id, r.attempts, r.error_class) for r in control.dead_letters(f, 2).collect()] == [("a", 2, "e2")]
    work, state = spark.createDataFrame([("a",), ("b",)], "entity_id string"), spark.createDataFrame([("a", "x", "1", "done"), ("b", "x", "0", "done"), ("b", "x", "1", "failed")], "entity_id string, stage string, stage_version string, status string")
    assert rows(control.still_to_do(work, state, "x", "1")) == {("b",)}


def test_evaluation(spark):
    labels = spark.createDataFrame([("a", "s", "x"), ("b", "s", "x"), ("c", "s", "y")], "entity_id string, slice string, expected string")
    results = spark.createDataFrame([("a", "s", "x"), ("b", "s", "y"), ("d", "s", "x")], "entity_id string, slice string, actual string")
    r = control.evaluate(labels, results, ["slice"]).first()
    assert (r.matches, r.mismatches, r.misses, r.spurious, r.precision, r.recall) == (1, 1, 1, 1, 0.333333, 0.333333)


def test_scores_of_nothing_are_null(spark):
    ans = spark.createDataFrame([("u", "q", "w1", 1), ("u", "q", "w2", 2)], "user_id string, question string, work_item_id string, rank int")
    im = spark.createDataFrame([("w1", "m1"), ("w2", "m9"), ("w2", "m1")], "work_item_id string, message_id string")
    gold = spark.createDataFrame([("u", "q", "g1", "must_include"), ("u", "q", "g2", "must_include"), ("u", "q", "t", "must_not_include"), ("u", "r", "g3", "acceptable")], "user_id string, question string, gold_id string, tier string")
    gm = spark.createDataFrame([("u", "q", "g1", "m1"), ("u", "q", "g2", "m7"), ("u", "q", "t", "m9")], "user_id string, question string, gold_id string, message_id string")
    assert rows(scoring.hits(ans, im, gm)) == {("u", "q", "g1", "w1"), ("u", "q", "t", "w2")}
    s = {r.question: r for r in scoring.score(ans, im, gold, gm).collect()}
    assert (s["q"].recall, s["q"].precision, s["q"].leaked) == (0.5, 0.5, 1) and (s["r"].recall, s["r"].precision) == (None, None)
    assert {(r.question, r.covered) for r in scoring.totals(scoring.score(ans, im, gold, gm)).collect()} == {("q", 1), ("r", 0), ("all", 1)}
    assert {(r.k, r.covered) for r in scoring.recall_at(ans, im, gold, gm, (1, 2)).collect()} == {(1, 1), (2, 1)}


def test_resolution(spark):
    seen = [("me@acme.io", "Me", 9), ("a@acme.io", "Ann Lee", 5), ("ann@gmail.example", "ann lee ", 2), ("a@acme-pay.io", "Ann Lee", 1), ("x@bcme.io", None, 1), ("info@northfield.com", "N", 4), ("pay@northfeild.com", "Other", 1)]
    addresses = spark.createDataFrame([("u", a, n, k, T0, T0) for a, n, k in seen], "user_id string, address string, name string, messages long, first_at timestamp, last_at timestamp")
    owners = spark.createDataFrame([("u", "me@acme.io")], "user_id string, address string")
    r = {x.address: x for x in resolution.resolve(addresses, owners).collect()}
    assert r["me@acme.io"].is_self and r["a@acme.io"].person_id == r["ann@gmail.example"].person_id != r["a@acme-pay.io"].person_id
    assert [r[a].method for a in ("a@acme.io", "ann@gmail.example", "a@acme-pay.io", "x@bcme.io")] == ["exact", "name_match", "lookalike_split", "exact"]
    names = resolution.name_conflicts(resolution.resolve(addresses, owners))
    both = resolution.by_severity(names.unionByName(resolution.domain_conflicts(addresses, owners, names)))
    assert [(x.address_a, x.address_b, x.relation) for x in both.orderBy("rank").collect()] == [("a@acme.io", "a@acme-pay.io", "embedded_brand"), ("info@northfield.com", "pay@northfeild.com", "typosquat")]
    assert resolution.people(resolution.resolve(addresses, owners)).count() == 6 and resolution.resolve(addresses.limit(0), owners).count() == 0


def test_extractor_retries_and_falls_back(spark):
    df = spark.createDataFrame([("a", "ok"), ("b", "busy"), ("c", "broken"), ("d", "none"), ("e", None)], "id string, text string")

    def first(row):
        if row["text"] == "busy":
            raise extract.Retry("429")
        if row["text"] == "broken":
            raise ValueError("no")
        return extract.readable_claims('{"claims": []}') if row["text"] == "none" else [{"attribute": "request.action", "summary": row["text"], "confidence": 0.9}]

    got = {r.email_id: r for r in extract.extract_claims(df, first, ["text"], tries=3, fallback=lambda row: [{"attribute": "cancellation"}] if row["text"] == "broken" else 1 / 0, wait=lambda s: None).collect()}
    assert (got["a"].attribute, got["a"].attempts, got["a"].error) == ("request.action", 1, None) and (got["c"].attribute, got["c"].attempts) == ("cancellation", 2)
    assert got["b"].attribute is None and got["b"].attempts == 4 and "ZeroDivisionError" in got["b"].error and got["d"].attribute is None and got["d"].error is None
    with pytest.raises(extract.Retry):
        extract.readable_claims("not json")
    assert 0.5 <= extract.backoff(0) <= 0.625 and extract.backoff(50) <= 25


def test_candidates_and_ddl(spark):
    df = spark.createDataFrame([("a", "Could you send the plan to Ann? I'll bring the audit."), ("b", None)], "id string, body_text_novel string")
    assert {(r.attribute, r.summary) for r in extract.claim_candidates(df).collect()} == {("request.action", "send the plan to Ann"), ("commitment.action", "bring the audit")}
    assert extract.strip_foreign_keys("CREATE TABLE t (a TEXT REFERENCES u(id) ON DELETE CASCADE, b INT, FOREIGN KEY (b) REFERENCES v(x))") == "CREATE TABLE t (a TEXT, b INT)"


def test_pending_claims_expire_in_a_stream(spark, tmp_path):
    def put(i, data):
        spark.createDataFrame(data, "k string, claim_id string, owner string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))

    put(0, [("t1", "c1", None, T0), ("t2", "c2", None, T0)])
    put(1, [("t1", "c3", "p", T0 + timedelta(1))])
    put(2, [("t9", "c9", "p", T0 + timedelta(40))])
    put(3, [("t9", "c10", "p", T0 + timedelta(41))])
    like = spark.read.parquet(str(tmp_path / "in" / "b0"))
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    assert rows(feeds.drain(feeds.expire_pending(stream, "k", "ts", "14 days", "0 seconds"), "pending")) == {("t1", "c1", "superseded"), ("t2", "c2", "promoted_unconfirmed")}


def test_streamed_fold_equals_the_batch_fold(spark, small):
    from quillfold.operators.ledger import full_fold
    from quillfold.plans import ledgerq, streamq

    whole = full_fold(ledgerq._claims(spark, small)).filter("row_kind = 'item'").groupBy("user_id", "status").agg(F.count("*").alias("items"), F.sum("claims").alias("claims"))
    assert rows(streamq.stream_keyed_fold(spark, small)) == rows(whole)
