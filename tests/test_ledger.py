"""The full fold on small sequences of claims."""

from datetime import datetime, timedelta, timezone

import pytest

from quillfold.operators.components import connected_components
from quillfold.operators.ledger import FOLD_COLUMNS, full_fold
from quillfold.operators.threads import thread_rollup, upper_median

T0 = datetime(2026, 3, 1, tzinfo=timezone.utc)
SCHEMA = "user_id string, at timestamp, id string, thread_id string, attribute string, act string, closes string, title string, words array<string>, due date, due_confidence double, owner_person_id string, owner_is_self boolean"


def claim(i, what, title, thread="t1", user="u", due=None, conf=0.0, owner=None):
    act = {"request": "request", "promise": "commitment", "value": "decision"}.get(what)
    closes = {"done": "RESOLVED", "cancel": "CANCELLED"}.get(what)
    return (user, T0 + timedelta(hours=i), f"c{i}", thread, "decision.value" if what == "value" else what, act, closes, title, sorted(set(title.split())), due, conf, owner, None)


def run(spark, rows):
    got = [r.asDict() for r in full_fold(spark.createDataFrame(rows, SCHEMA)).collect()]
    return [(r["item_id"], r["status"]) for r in got if r["row_kind"] == "item"], [(r["item_id"], r["kind"]) for r in got if r["row_kind"] == "change"]


@pytest.mark.parametrize(
    "rows,items,changes",
    [
        ([claim(0, "request", "a b"), claim(1, "done", "a b")], [("c0", "RESOLVED")], ["opened", "resolved"]),
        ([claim(0, "request", "a b"), claim(1, "cancel", "a b")], [("c0", "CANCELLED")], ["opened", "cancelled"]),
        ([claim(0, "request", "a b", due=T0.date(), conf=0.7), claim(1, "request", "a b", due=T0.date() + timedelta(1), conf=0.7)], [("c0", "OPEN")], ["opened", "due_moved"]),
        ([claim(0, "request", "a b", due=T0.date(), conf=0.9), claim(1, "request", "a b", due=T0.date() + timedelta(1), conf=0.7)], [("c0", "OPEN")], ["opened"]),
        ([claim(0, "value", "a b"), claim(1, "value", "a b"), claim(2, "value", "a b")], [("c0", "OPEN")], ["opened", "value_superseded", "value_superseded"]),
        ([claim(0, "request", "a b c"), claim(1, "done", "a b c", thread="t2")], [("c0", "RESOLVED")], ["opened", "resolved"]),
        ([claim(0, "request", "a b"), claim(1, "request", "x y"), claim(2, "done", "p q")], [("c0", "OPEN"), ("c1", "RESOLVED")], ["opened", "opened", "resolved"]),
        ([claim(0, "request", "a b"), claim(1, "done", "a b"), claim(2, "request", "a b")], [("c0", "RESOLVED")], ["opened", "resolved"]),
        ([claim(0, "done", "a b")], [], []),
        ([claim(0, "request", "a b"), claim(1, "promise", "a b")], [("c0", "OPEN"), ("c1", "OPEN")], ["opened", "opened"]),
        ([claim(0, "request", "a b c d"), claim(1, "request", "a b c e")], [("c0", "OPEN")], ["opened"]),
        ([claim(0, "request", "a b", owner="p"), claim(1, "request", "a b", owner="q")], [("c0", "OPEN"), ("c1", "OPEN")], ["opened", "opened"]),
        ([claim(0, "request", "a b c", owner="p"), claim(1, "done", "a b c", thread="t2", owner="q")], [("c0", "OPEN")], ["opened"]),
        ([claim(0, "request", "a b c d e f"), claim(1, "request", "a b c d g h i")], [("c0", "OPEN"), ("c1", "OPEN")], ["opened", "opened"]),
        ([claim(0, "request", "a b"), claim(1, "request", "a b", user="v")], [("c0", "OPEN"), ("c1", "OPEN")], ["opened", "opened"]),
    ],
)
def test_fold(spark, rows, items, changes):
    for order in (rows, rows[::-1]):  # the order of delivery doesn't matter
        got, log = run(spark, order)
        assert sorted(got) == items
        assert sorted(k for _, k in log) == sorted(changes)


def test_fold_of_nothing(spark):
    assert run(spark, [])== ([], []) and len(FOLD_COLUMNS) == 18


def test_rollup_and_upper_median(spark):
    df = spark.createDataFrame([("t", T0 + timedelta(seconds=s), str(s)) for s in (0, 1, 3, 6, 10)] + [("u", T0, "x")], "thread_id string, at timestamp, id string")
    got = {r.thread_id: r for r in thread_rollup(df, ["thread_id"], "at", "id").collect()}
    assert got["t"].median_gap_s == 3 and got["t"].root == "0" and got["u"].median_gap_s is None
    assert spark.createDataFrame([(None,)], "x int").agg(upper_median("x")).first()[0] is None


def test_components(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("z2", "z1"), ("z1", "z2"), ("q", "q"), (None, "q")]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"n{i:03d}"] for i in range(41)} == {"n000"} and got["z2"] == "z1" and got["q"] == "q"
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def brute(rows):
    """The rules of the fold, read afresh: every claim looks at every item of its mailbox in order."""
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    items, changes = [], []
    for user, at, cid, thread, attribute, act, closes, title, words, due, conf, owner, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        mine = [x for x in items if x["user"] == user]
        if closes:
            here = sorted((x for x in mine if thread in x["threads"] and x["status"] == "OPEN"), key=lambda x: -x["opened"].timestamp())
            target, best = None, 0.0
            for x in here:
                if jac(x["words"], words) > best:
                    target, best = x, jac(x["words"], words)
            if not (target and best >= 0.25):
                target = here[0] if here else None
            if target is None:
                near = [x for a in ("request", "commitment") for x in mine if x["act"] == a and x["owner"] == owner and jac(x["words"], words) >= 0.6]
                target = near[0] if near else None
            if target is not None:
                if target["status"] == "OPEN":
                    target["status"] = closes
                changes.append((target["id"], "resolved" if closes == "RESOLVED" else "cancelled", cid))
            continue
        same = [x for x in mine if x["act"] == act and x["owner"] == owner and x["words"] == words] or [x for x in mine if x["act"] == act and x["owner"] == owner and jac(x["words"], words) >= 0.6]
        if not same:
            items.append({"user": user, "id": cid, "act": act, "owner": owner, "words": words, "threads": {thread}, "status": "OPEN", "opened": at, "due": due, "conf": conf, "decided": act == "decision"})
            changes.append((cid, "opened", cid))
            continue
        x = same[0]
        if due and due != x["due"] and conf >= x["conf"]:
            changes.append((x["id"], "due_moved", cid))
            x["due"], x["conf"] = due, conf
        if attribute == "decision.value" and x["decided"]:
            changes.append((x["id"], "value_superseded", cid))
        x["threads"].add(thread)
    return sorted((x["id"], x["status"], str(x["due"])) for x in items), sorted(changes)


@pytest.mark.parametrize("seed", range(4))
def test_fold_equals_a_plain_replay(spark, seed):
    import random

    rnd = random.Random(seed)
    rows = []
    for i in range(250):
        what = rnd.choice(["request", "promise", "value", "done", "cancel"])
        due = T0.date() + timedelta(rnd.randint(0, 5)) if rnd.random() < 0.5 else None
        title = " ".join(rnd.sample("budget plan audit lease survey rota".split(), rnd.randint(1, 4)))
        rows.append(claim(i, what, title, thread=f"t{rnd.randint(0, 5)}", user=rnd.choice("uv"), due=due, conf=rnd.choice([0.5, 0.7, 0.9]) if due else 0.0, owner=rnd.choice([None, "p", "q"])))
    got = [r.asDict() for r in full_fold(spark.createDataFrame(rnd.sample(rows, len(rows)), SCHEMA).repartition(3)).collect()]
    items = sorted((r["item_id"], r["status"], str(r["due"])) for r in got if r["row_kind"] == "item")
    changes = sorted((r["item_id"], r["kind"], r["claim_id"]) for r in got if r["row_kind"] == "change")
    assert (items, changes) == brute(rows)
