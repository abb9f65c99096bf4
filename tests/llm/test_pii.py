import random

import pytest

from quillfold.llm import pii


#: A small corpus that shows how its names are used.
CORPUS = [
    "Hi all,\n\nI met Hugo Ponsingrath and Susan Birkingsk there. P. Crofondnard wrote to Mei R. Oakronby, and I told Frau Quillockrath, Oskar about it. Hugo agrees, Susan asked.",
    "Tariq,\n\nplease tell Tariq that Tariq Sindelham calls. I saw Noor and told Noor Zeldelcroft.\n\nNoor,\nfor the plan of the pilot ask Kelmand or the Kelmand office; we met in Kelmand and in Kelmand again.",
] * 4
CENSUS = pii.Census.of(CORPUS)


def found(text):
    return [(k, text[a:b]) for k, a, b in pii.spans(text, CENSUS)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Mail mei.ulmon@labs.example now", [("email", "mei.ulmon@labs.example")]),
        ("to hana_r [at] mailhaven [dot] example today", [("email", "hana_r [at] mailhaven [dot] example")]),
        ("leila AT postbox [dot] example", [("email", "leila AT postbox [dot] example")]),
        ("piers (at) gosto dot example if", [("email", "piers (at) gosto dot example")]),
        ("Call +44 (0)20 7946 0811 or (212) 555-0175.", [("phone", "+44 (0)20 7946 0811"), ("phone", "(212) 555-0175")]),
        ("on 030/23125-481, 01.99.00.65.71 and +17375550195", [("phone", "030/23125-481"), ("phone", "01.99.00.65.71"), ("phone", "+17375550195")]),
        ("PO 4500-489-3447, invoice 398-3615, ticket #1964555, order no. 906/9967", []),
        ("Her SSN is 666-15-6950, please", [("id_number", "666-15-6950")]),
        ("lists passport no. QQ 18 40 28 C and the", [("id_number", "QQ 18 40 28 C")]),
        ("Steuernummer lautet 00 863 586 593, bitte", [("id_number", "00 863 586 593")]),
        ("the interim licence don't match 12 things", []),
        ("We move to 157 Elm Grove, Apt 17, Ulmon by May", [("address", "157 Elm Grove, Apt 17, Ulmon")]),
        ("an Am Alten Markt 210, 07363 Kelmith schicken", [("address", "Am Alten Markt 210, 07363 Kelmith")]),
        ("to 179 bis avenue du Vieux Port, 00901 Birkerby and", [("address", "179 bis avenue du Vieux Port, 00901 Birkerby")]),
        ("Mr. HUGO PONSINGRATH lives", [("name", "HUGO PONSINGRATH")]),
        ("ask for susan birkingsk.", [("name", "susan birkingsk")]),
        ("cc'ing P. Crofondnard and Mei R. Oakronby here", [("name", "P. Crofondnard"), ("name", "Mei R. Oakronby")]),
        ("Frau Quillockrath, Oskar kommt", [("name", "Quillockrath, Oskar")]),
        ("Hi Anna, Oskar and Mei from Jorvar Energy", []),
        ("ask for tariq sindelham or NOOR ZELDELCROFT", [("name", "tariq sindelham"), ("name", "NOOR ZELDELCROFT")]),
        ("In Kelmand, Hugo agrees; Susan asked Hugo Monday", []),
        (None, []), ("", []),
    ],
)
def test_spans(text, want):
    assert found(text) == want


def test_disguises_map_back():
    t = "ring zero two zero seven nine four six zero three two zero now, ｍｅｉ＠labs．example, j​oe@x.example"
    got = found(t)
    assert got[0] == ("phone", "zero two zero seven nine four six zero three two zero")
    assert got[1] == ("email", "ｍｅｉ＠labs．example") and got[2] == ("email", "j​oe@x.example")


@pytest.mark.parametrize("address", ["jane(@)host.example", "jane[@]host.example", "jane@host[.]example", "jane@host(.)example", "jane ( at ) host.example", "jane[ \t at ]host( dot )example"])
def test_a_disguise_alone_is_found(address):
    assert found(f"to {address} today") == [("email", address)]


def test_a_disguise_leaves_other_words_alone():
    assert found("Hugo Ponsingrath at the office, jane(@)host.example") == [("name", "Hugo Ponsingrath"), ("email", "jane(@)host.example")]


@pytest.mark.parametrize("digits", ["null drei null fünf fünf sechs eins neun zwei", "fünf null fünf null fünf null fünf null fünf", "zwo fuenf zwo fuenf zwo fuenf zwo fuenf"])
def test_german_digits_are_read(digits):
    got = pii.Normalised(f"Ruf {digits} an").text.split()[1]
    assert got.isdigit() and len(got) == len(digits.split())


def test_redact():
    assert pii.redact("Hugo Ponsingrath, (212) 555-0175, a@b.example", CENSUS) == "[NAME], [PHONE], [EMAIL]"
    assert pii.redact(None) is None and pii.redact("") == ""
    long = "word " * 200_000 + "a@b.example"
    assert pii.redact(long).endswith("[EMAIL]")


def test_tables(spark):
    mails = spark.createDataFrame([("m1", "mail a@b.example", "k"), ("m2", None, "k"), ("m3", "", "k")], "id string, body_text_novel string, kind string")
    quotes = spark.createDataFrame([("e1", "or (212) 555-0175", 1), ("e1", "or (212) 555-0175", 2), ("e2", None, 3), (None, "x", 4)], "id string, evidence_quote string, ingest_seq long")
    assert {tuple(r) for r in pii.personal_information(mails, quotes).collect()} == {("emails", "m1", "email", 5), ("evidence", "e1", "phone", 3)}
    assert pii.personal_information(mails.limit(0), quotes.limit(0)).count() == 0
    assert {r.body_text_novel for r in pii.redact_texts(mails, ["body_text_novel"], CENSUS).collect()} == {"mail [EMAIL]", None, ""}


def test_both_texts_are_redacted(spark):
    from quillfold.llm import queries

    tables = {
        "emails": spark.createDataFrame([("m1", "mail a@b.example"), ("m2", None)], "id string, body_text_novel string"),
        "evidence": spark.createDataFrame([("e1", "or (212) 555-0175", 2), ("e1", "or (212) 555-0175", 1), ("e2", None, 3)], "id string, evidence_quote string, ingest_seq long"),
    }
    with pytest.MonkeyPatch.context() as m:
        m.setattr(queries, "load", lambda s, d, table: tables[table])
        got = {tuple(r) for r in queries.p4_redacted(spark, "").collect()}
    assert got == {("emails", "m1", "mail [EMAIL]"), ("emails", "m2", None), ("evidence", "e1", "or [PHONE]")}


def strangers(seed=5, n=120):
    """People whose names stand in no list of the code: given names and families made of syllables, each person with one full name."""
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(k)).title()
    given = [word(2) + rnd.choice("nrlk") for _ in range(15)]
    return [(rnd.choice(given), word(3) + rnd.choice(["", "x", "q", "mb"])) for _ in range(n)], given


def test_names_of_another_stock_are_found():
    people, given = strangers()
    assert not {g.lower() for g in given} & set(pii.GIVEN)
    rnd = random.Random(9)
    places = ["Zabulon", "Mirkoti", "Ferundi"]
    texts, want = [], []
    for i in range(900):
        g, f = rnd.choice(people)
        how = rnd.randrange(8)
        name = [f"{g} {f}", f"{g} {f}", f"{g} {f}", f"{g[0]}. {f}", f"{f}, {g}", f"{g} {f}".lower(), f"{g} {f}".upper(), f"{g} {rnd.choice('ABCDE')}. {f}"][how]
        start = f"{rnd.choice(given)},\n\nthe plan for {rnd.choice(places)} is ready, and {rnd.choice(given)} agrees. Please ask for "
        texts.append(f"{start}{name} today. We also met in {rnd.choice(places)}, and {rnd.choice(given)} asked about the budget.")
        want.append((len(start), len(start) + len(name)))
    census = pii.Census.of(texts)
    got = [[(a, b) for k, a, b in pii.spans(t, census) if k == "name"] for t in texts]
    hit = sum(w in g for w, g in zip(want, got))
    assert hit / len(want) >= 0.95 and hit / sum(map(len, got)) >= 0.97


def test_census_over_tables(spark):
    df = spark.createDataFrame([(t,) for t in CORPUS] + [(None,), ("",)], "t string").repartition(3)
    c = pii.census_of(df, "t")
    assert all(c.counts(w) == CENSUS.counts(w) for w in ("hugo", "ponsingrath", "tariq", "kelmand", "agrees", "nobody"))
    assert pii.census_of(df.limit(0), "t").word("hugo")[0]


def test_many_spans_in_one_text():
    text = "\n".join(f"call +44 20 7946 {i:04d} or a{i}@b.example" for i in range(3000))
    assert len(pii.spans(text)) == 6000
