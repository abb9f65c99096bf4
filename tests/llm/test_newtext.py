import pytest

from quillfold.llm import newtext


def new(body):
    lines = body.split("\n")
    return [lines[i] for i, s in enumerate(newtext.line_states(body)) if s == newtext.NEW]


@pytest.mark.parametrize(
    "body,want",
    [
        ("Hi Mei,\n\nThe plan is fine.\n\nKind regards\nHugo Ponsin\nTel 030 23125789", ["Hi Mei,", "The plan is fine."]),
        ("Yes.\n\nOn Mon, Jan 5, 2026 at 1:59 PM Tariq H\n<t@x.example> wrote:\n> old\n> older", ["Yes."]),
        ("> old\n\nNew below.\n> more old\nAnd here.", ["New below.", "And here."]),
        ("FYI\n\n-----Original Message-----\nFrom: a@x.example\nSent: 2026-01-01\n\nOld text.", ["FYI"]),
        ("Danke!\n\nVon: Kwame <k@x.example>\nGesendet: 28.04.2026 19:09\nAn: Amara\n\nAlter Text.", ["Danke!"]),
        ("[EXTERNAL] This message came from outside.\n\nHello all,\nNew.\n-- \nMei\nEngineer", ["Hello all,", "New."]),
        ("New.\n\nBest,\nMei\n\nPS: one more thing.\nIt matters.\n\nThis message and any attachment are confidential and\nmeant for you.", ["New.", "PS: one more thing.", "It matters."]),
        ("--- Priya said ---\n    Old.\n\nNew.\n    Old again.", ["New."]),
        ("> a line that was cut\nin two by the mailer.\n>\nNew.", ["New."]),
        ("Done.\r\n\r\nSent from my phone\r\n", ["Done.\r"]),
        ("", []), ("\n \n", []),
    ],
)
def test_lines(body, want):
    assert new(body) == want


SCHEMA = "id string, account_id string, provider_message_id string, rfc_message_id string, thread_id string, provider_ts string, body_text_full string, line string"


def run(spark, rows, senders):
    mails = spark.createDataFrame([(i, "a", m, None, t, ts, b, "clash") for i, m, t, ts, b in rows], SCHEMA)
    parts = spark.createDataFrame([(i, "from", 0, s) for i, s in senders.items()], "email_id string, part_role string, part_no int, raw_address string")
    return {tuple(r) for r in newtext.new_lines(mails, parts).collect()}


def test_first_author_keeps_a_line(spark):
    text = "this is a long line that was first written by somebody"
    rows = [("m1", "1", "t", "2026-01-01T10:00:00Z", text), ("m2", "2", "t", "2026-01-01T12:00:00+05:00", text), ("m3", "2", "t", "2026-01-01T07:00:00Z", text), ("m4", "9", None, None, text), ("m5", "8", None, None, None)]
    assert run(spark, rows, {}) == {("m2", 1), ("m3", 1), ("m4", 1)}  # 07:00 is first, both deliveries of it count


def test_recurrent_closing_lines(spark):
    rows = [(f"m{i}", str(i), f"t{i}", "2026-01-01T10:00:00Z", f"something quite new number {i} here.\nThe blue pirate crew") for i in range(4)]
    assert run(spark, rows, {f"m{i}": "Mei@x.example" for i in range(4)}) == {(f"m{i}", 1) for i in range(4)}
    assert ("m0", 2) in run(spark, rows[:2], {})


def test_rewrapped_passages_are_old_on_all_their_runs(spark):
    rows = []
    for k in range(12):
        words = [f"w{k}x{i}" for i in range(10)]
        own = [f"v{k}x{i}" for i in range(20)]
        rows.append((f"a{k}", f"a{k}", f"t{k}", "2026-01-01T10:00:00Z", " ".join(words)))
        rows.append((f"b{k}", f"b{k}", f"t{k}", "2026-01-02T10:00:00Z", " ".join(words[:5]) + "\n" + " ".join(words[5:])))
        # Three of thirteen runs are shared: less than half, so the line is new.
        rows.append((f"c{k}", f"c{k}", f"t{k}", "2026-01-03T10:00:00Z", " ".join(words + own[:10])))
    assert run(spark, rows, {}) == {(f"{x}{k}", 1) for k in range(12) for x in "ac"}


def test_a_run_on_many_lines_counts_for_each():
    lines = ["one two three four five six seven eight"] * 3
    got = newtext.grams(lines, [True] * 3)
    assert len(got) == 8 and sorted(max(got.values(), key=len)) == [0, 1, 2]


def test_empty(spark):
    assert run(spark, [("m", "1", "t", None, None)], {}) == set()


def test_windows_alone_find_quotes_and_closings(spark):
    """Without proposals from looks, repeated lines, short lines between them and recurrent closings still go."""
    said = ["the first long line that somebody wrote about the plan", "yes", "the second long line that somebody wrote about the plan"]
    rows = [(f"a{k}", f"a{k}", f"t{k}", "2026-01-01T10:00:00Z", "\n".join(f"{x} {k}" if i != 1 else x for i, x in enumerate(said)) + "\nthe old crew") for k in range(4)]
    rows += [(f"b{k}", f"b{k}", f"t{k}", "2026-01-02T10:00:00Z", f"my own answer is rather short number {k}\nyes\nand one more remark of my own, number {k}\n" + "\n".join(f"> {x} {k}" if i != 1 else "> yes" for i, x in enumerate(said))) for k in range(4)]
    mails = spark.createDataFrame([(i, "a", m, None, t, ts, b, "clash") for i, m, t, ts, b in rows], SCHEMA)
    parts = spark.createDataFrame([(f"{x}{k}", "from", 0, f"{x}@x.example") for x in "ab" for k in range(4)], "email_id string, part_role string, part_no int, raw_address string")
    got = {tuple(r) for r in newtext.new_lines(mails, parts, proposals=False).collect()}
    assert got == {(f"a{k}", n) for k in range(4) for n in (1, 2, 3)} | {(f"b{k}", n) for k in range(4) for n in (1, 2, 3)}
    assert {tuple(r) for r in newtext.new_lines(mails.union(mails), parts.union(parts), proposals=False).collect()} == got  # repeated rows count once
