import random
import zlib

import numpy as np
import pytest

from quillfold.llm import names

SEEN = names.Givens(np.array([zlib.crc32(t) & ((1 << 22) - 1) for t in (b"ravi",)]))


@pytest.mark.parametrize(
    "raw,want",
    [
        ("Katherine Corbawell", ("katherine", "k", "corbawell")), ("Kate Corbwell", ("katherine", "k", "corbwell")), ("Corbawell, Katherine", ("katherine", "k", "corbawell")), ("Dr. Thomas H. Dornilley", ("thomas", "t", "dornilley")),
        ("J. Birkondstein", (None, "j", "birkondstein")), ("Birkondstein J", (None, "j", "birkondstein")), ("  nicholas  zeldenrath ", ("nicholas", "n", "zeldenrath")), ("Jessiac Pellonard", ("jessica", "j", "pellonard")),
        ("Søren Purlairsk", ("soren", "s", "purlairsk")), ("ravikirronnard", ("ravi", "r", "kirronnard")), ("mkelmaircroft", (None, "m", "kelmaircroft")), ("Rebecca Jorvondby (via mail)", ("rebecca", "r", "jorvondby")), (None, None), ("", None), ("!!", None),
    ],
)
def test_parse_name(raw, want):
    assert names.parse_name(raw, SEEN) == want


def test_given_names_of_the_corpus(spark):
    typed = [f"Ravi {f}" for f in "Abel Besk Corb Dorn Esk Fenn".split()] + ["Raavi Garr", "Garr, Ravi", "Lund Ravi", "Kirr", "Health Partners", None]
    df = spark.createDataFrame([(f"p{i}", n) for i, n in enumerate(typed)], "id string, name string")
    got = {r.token: r.canonical for r in names.given_names(df).collect()}
    assert got["ravi"] == "ravi" and got["raavi"] == "ravi" and got["lund"] is None and "partners" not in got
    assert names.given_names(df.limit(0)).count() == 0


def test_local_parts():
    assert names.parse_local("wickandley.t") == (None, "t", "wickandley") and names.parse_local("thomas_dornilley") == ("thomas", "t", "dornilley")
    assert names.parse_local("mei87") is None and names.parse_local("hasko.onboarding") is None


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_slips():
    assert names._given_like("jessca") == "jessica" and names._given_like("jessiac") == "jessica" and names._given_like("jessicaa") == "jessica" and names._given_like("xyzw") is None


def spellings(seed=2, n=60):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdeorn") for _ in range(rnd.randint(3, 9))) for _ in range(n)]
    words = set(base)
    for w in base:
        for _ in range(3):
            i = rnd.randrange(len(w))
            words.add(w[:i] + rnd.choice(["", rnd.choice("abcdeorn")]) + w[i + 1 :])
    return sorted(w for w in words if w)


def test_radius_join_equals_brute_force(spark):
    ws = spellings()
    df = spark.createDataFrame([("g", w) for w in ws] + [("h", "soloist"), ("h", "solaist"), ("h", "solaist"), (None, "x"), ("h", None), ("h", "")], "grp string, word string")
    got = [(r.grp, r.x, r.y, r.d) for r in names.radius_pairs(df, 2).collect()]
    want = {("g", a, b, d) for i, a in enumerate(ws) for b in ws[i + 1 :] if (d := distance(a, b)) <= (2 if min(len(a), len(b)) >= 6 else 1)} | {("h", "solaist", "soloist", 1)}
    assert len(got) == len(set(got)) and set(got) == want
    assert names.radius_pairs(df.limit(0)).count() == 0


def test_names_are_partitioned_by_pivots(spark):
    ws = spellings(3, 200)
    df = spark.createDataFrame([("g", w) for w in ws], "grp string, word string")
    cells = names.name_cells(df, ws[::60], 2).collect()
    assert len({r.cell for r in cells}) > 5  # several cells, each name at home in exactly one
    assert sorted(r.word for r in cells if r.home) == ws
    assert max(sum(r.cell == c for r in cells) for c in {r.cell for r in cells}) < len(ws)


PEOPLE = [
    ("p1", "Deborah Ponsarrath", "deborah.ponsarrath@isterinpress.example"), ("p2", "deborahponsarrath", "ponsarrath.d@isterinpress.example"), ("p3", "Mr Deborah Ponsarath", "deborah19@mailhaven.example"), ("p4", "Jessica Ponsarrath", "jponsarrath@isterinpress.example"),
    ("o1", "Isterin Press", "orders@isterinpress.example"), ("o2", "The Isterin Press", "info@notify.isterinpress.example"), ("f1", "Isterin Press", "billing@isterinpress-pay.example"), ("f2", "Deborah Ponsarrath", "deborah@isterinpres.example"), ("n1", None, None), ("n2", "  ", "x9@mailhaven.example"),
]


def tables(spark, rows, user="u"):
    people = spark.createDataFrame([(i, user, n, "clash") for i, n, _ in rows], "id string, user_id string, canonical_name string, address string")
    ids = spark.createDataFrame([(i, user, a, n, 3) for i, n, a in rows if a], "person_id string, user_id string, address string, observed_name string, message_count int")
    parts = spark.createDataFrame([(i, n, a) for i, n, a in rows], "person_id string, raw_name string, raw_address string")
    return people, ids, parts


def test_parties(spark):
    got = {tuple(r) for r in names.same_parties(*tables(spark, PEOPLE)).collect()}
    assert got == {("p1", "p2"), ("p1", "p3"), ("p2", "p3"), ("o1", "o2")}
    parties = names.party_members(*tables(spark, PEOPLE)).collect()
    assert len(parties) == len(PEOPLE)
    star = {tuple(r) for r in names.same_parties(*tables(spark, PEOPLE), expand=2).collect()}
    assert star == {("p1", "p2"), ("p1", "p3"), ("o1", "o2")}


def test_a_busy_look_alike_domain_imitates(spark):
    given = ["Deborah", "Jessica", "Thomas", "Hugo"]
    rows = [(f"r{i}", f"{g} Ponsarrath", f"{g.lower()}.ponsarrath@isterinpress.example") for i, g in enumerate(given)]
    rows += [(f"f{i}", f"{g} Ponsarrath", f"{g.lower()}.ponsarrath@isterinpres.example") for i, g in enumerate(given[:3])]
    assert names.same_parties(*tables(spark, rows)).count() == 0


def test_all_pairs_of_a_large_party(spark):
    rows = [(f"p{i:03d}", "Deborah Ponsarrath", f"deborah.ponsarrath@host{i}.example") for i in range(201)]
    assert names.same_parties(*tables(spark, rows)).count() == 201 * 200 // 2


def test_mailboxes_are_apart_and_empty(spark):
    a, b = tables(spark, PEOPLE[:1], "u"), tables(spark, [("q1", *PEOPLE[0][1:])], "v")
    both = [x.union(y) for x, y in zip(a, b)]
    assert names.same_parties(*both).count() == 0
    assert names.same_parties(*[x.limit(0) for x in both]).count() == 0
