"""The change log against a replay in order."""

import random

import pytest
from pyspark.sql import functions as F

from quillfold.operators.changefeed import ChangeLog, current_claims, evidence_changes

SCHEMA = "ingest_seq long, id string, op string, attribute string, work_item_id string, observed_at string, step_no int, arrived_at timestamp, extra string"


def replay(rows):
    """Brute force: each change once, in order."""
    seen, state = {}, {}
    for r in rows:
        seen.setdefault(r[1], r)
    clean = lambda x: x.strip().lower()
    for r in sorted(seen.values(), key=lambda r: (r[8], r[6] or 0, r[1])):
        key, kind = (clean(r[4]), clean(r[3])), clean(r[2])[0]
        if kind in "ic":
            state[key] = r[1]
        elif kind == "u" and key in state:
            state[key] = r[1]
        elif kind == "d":
            state.pop(key, None)
    return {(*k, v) for k, v in state.items()}


def feed(seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        t = rnd.randint(0, 59)
        off, h = rnd.choice([("+00:00", 12), ("Z", 12), ("+05:30", 17), ("-07:00", 5)])
        m = (t + 30) % 60 if off == "+05:30" else t
        h += (t + 30) // 60 if off == "+05:30" else 0
        at = f"2026-03-01{rnd.choice('T ')}{h:02d}:{m:02d}:00{off}"
        rows.append((i, f"c{i:04d}", rnd.choice(["insert", "I", "create", "update", "U", "upd", "UPDATE", "delete", "D", "del"]), rnd.choice(["a", " A", "b "]), rnd.choice(["w1", "W1 ", "w2\t", "w3"]), at, rnd.randint(0, 2), None, t))
    rows += rnd.sample(rows, n // 4)
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_current_claims_equal_replay(spark, seed):
    rows = feed(seed)
    df = spark.createDataFrame([(*r[:8], "x") for r in rows], SCHEMA)
    assert {tuple(r) for r in current_claims(df).collect()} == replay(rows)


ARGS = (["work_item_id", "attribute"], ["at", "step", "evidence_id"], "kind", "evidence_id")


def test_runs_merge_in_any_order_and_compaction_keeps_tombstones(spark):
    rows = feed(7)
    df = spark.createDataFrame([(*r[:8], "x") for r in rows], SCHEMA)
    log = ChangeLog(spark, *ARGS, fan=100)
    parts = df.withColumn("k", F.pmod(F.xxhash64("ingest_seq"), F.lit(3)))
    for k in (2, 0):
        log.append(evidence_changes(parts.filter(F.col("k") == k)).drop("run"))
    log.compact()
    log.append(evidence_changes(parts.filter("k = 1")).drop("run"))
    log.append(evidence_changes(parts.filter("k = 1")).drop("run"))  # delivered again
    assert len(log.runs) == 3 and {tuple(r) for r in log.read().collect()} == replay(rows)
    with pytest.raises(ValueError):
        log.compact(log.runs[:1], drop_tombstones=True)
    log.compact(drop_tombstones=True)
    assert len(log.runs) == 1 and {tuple(r) for r in log.read().collect()} == replay(rows)
    assert log.vacuum() == 5 and {tuple(r) for r in log.read().collect()} == replay(rows)


def test_merge_on_read_has_no_exchange_and_logs_open_again(spark):
    rows = feed(8)
    df = spark.createDataFrame([(*r[:8], "x") for r in rows], SCHEMA)
    log = ChangeLog(spark, *ARGS, fan=3)
    for k in range(7):
        log.append(evidence_changes(df.filter(F.pmod("ingest_seq", F.lit(7)) == k)).drop("run"), batch=k)
    assert len(log.runs) <= 3  # compacted on the way
    assert "Exchange" not in log.read()._jdf.queryExecution().executedPlan().toString()
    assert log.append(evidence_changes(df.filter("ingest_seq % 7 = 6")).drop("run"), batch=6) == []  # a replayed batch
    spark.sql(f"DROP TABLE `{log.table}`")
    again = ChangeLog(spark, *ARGS, path=log.path, fan=3)
    assert again.runs == log.runs and {tuple(r) for r in again.read().collect()} == replay(rows)
    other = ChangeLog(spark, *ARGS, path=log.path, fan=3)
    again.append(evidence_changes(df.limit(1)).drop("run"))
    with pytest.raises(RuntimeError):  # the other writer lost: its version was taken
        other.append(evidence_changes(df.limit(1)).drop("run"))
    assert {tuple(r) for r in ChangeLog(spark, *ARGS, path=log.path).read().collect()} == replay(rows)


def test_months_become_runs_and_are_compacted(spark):
    import datetime

    rows = feed(9)
    df = spark.createDataFrame([(*r[:7], datetime.datetime(2026, 1 + r[0] % 9, 3), "x") for r in rows], SCHEMA)
    assert {tuple(r) for r in current_claims(df).collect()} == replay(rows)


def test_nulls_unreadable_and_empty(spark):
    rows = [(1, "a", "insert", "x", None, "2026-01-01T00:00:00Z", 0, None, None), (2, "b", "insert", "x", "w", None, 0, None, None), (3, "c", "insert", "x", "w", "soon", 0, None, None), (4, "d", None, "x", "w", "2026-01-01T00:00:00Z", 0, None, None), (5, "e", "what", "x", "w", "2026-01-01T00:00:00Z", 0, None, None), (6, None, "insert", "x", "w", "2026-01-01T00:00:00Z", 0, None, None), (7, "f", "insert", None, "w", "2026-01-01T00:00:00Z", 0, None, None), (8, "g", "insert", "y", "w", "2026-01-01T00:00:00Z", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in current_claims(df).collect()] == [("w", "y", "g")]
    assert current_claims(df.limit(0)).collect() == []
