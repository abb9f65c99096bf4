import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfold.llm import mixing, textquality

WORDS = frozenset("the a of and to in for is on that with it".split())


def docs(spark):
    base = spark.range(1200).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 900, "big").when(F.col("id") < 1150, "mid").otherwise("small").alias("source"))
    return base.withColumn("text", F.concat(F.col("source"), F.lit(" words "), F.repeat(F.concat(F.lit("x"), F.col("doc_id").cast("string"), F.lit(" ")), (F.col("doc_id") % 20).cast("int"))))


def test_shares_and_caps(spark):
    d = docs(spark).union(spark.createDataFrame([(5000, None, "no source"), (5001, "mid", None), (5002, "mid", ""), (5003, "untargeted", "text")], "doc_id long, source string, text string"))
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 3), ("absent", 0.1, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(d, t)
    got = {r.source: r for r in m.report().collect()}
    for s in ("big", "mid", "small"):
        assert abs(got[s].reached_share - got[s].reachable_share) < 0.002 and got[s].most_copies <= got[s].max_repeats
    assert got["absent"].reached_share == 0 and abs(got["big"].reachable_share - 0.5 / 0.9) < 1e-9
    assert {r.source for r in m.documents.select("source").distinct().collect()} == {"big", "mid", "small"}


def test_descent_never_rises_and_meets_both_totals():
    rng = np.random.default_rng(1)
    hard = np.repeat(np.arange(3), 40)
    tokens = rng.uniform(0.5, 2.0, 120)
    post = rng.dirichlet(np.ones(3) * 0.4, 120) * 0.5
    post[np.arange(120), hard] += 0.5
    tokens /= (tokens * 0.3).sum()
    goal, caps = np.array([0.5, 0.3, 0.2]), np.array([1.0, 2.0, 3.0])
    start = goal / np.bincount(hard, tokens)
    rates, objectives = mixing.fit_rates(tokens, post * tokens[:, None], hard, caps, goal, start)
    assert all(b <= a + 1e-15 for a, b in zip(objectives, objectives[1:])) and objectives[-1] < 1e-8 < objectives[0]
    assert (rates >= 0).all() and (rates <= caps[hard]).all()
    assert np.allclose(np.bincount(hard, tokens * rates), goal, atol=1e-9) and np.allclose(rates @ (post * tokens[:, None]), goal, atol=2e-4)


def test_nothing_to_mix(spark):
    t = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.Mixture(docs(spark).limit(0), t).documents.count() == 0
    assert mixing.Mixture(docs(spark).limit(0), t).report().first().reached_share == 0
    assert mixing.Mixture(docs(spark), t.limit(0)).documents.count() == 0


PROSE = "The plan for the audit is on the table, and it is clear that nobody has read it with care. " * 3


@pytest.mark.parametrize(
    "text,share",
    [
        ("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", "table_share"), ("x,y,z\n1,2,3\n4,5,6\n7,8,9", "table_share"), ("name        due          n\n----------------------\nalpha       2026-01-01   3\nbeta        2026-01-02   4", "table_share"), ("a\tb\n1\t2\n3\t4", "table_share"),
        ("- one thing\n- another thing\n- a third", "list_share"), ("1. one\n2. two\n3. three", "list_share"), ("send the plan\ncheck the budget\nopen the door", "short_share"),
        ("jZfVf9yMAHV92rPrHJ6arW5IbqTy3XmKRISpVynabA\nuTzJy+hpcd+sX6AFlXGIbgfPYuzHPlAQJq9z+rUgik", "junk_share"), ("<td style='x'></td><br/>&nbsp;<span></span>", "junk_share"), ("====== ##### ~~~~~ ***** -----", "junk_share"), ("00000000  71 84 a7 dd d4 2f 1a 86 76 c9 5b 1a\n00000010  a9 c1 e4 47 aa ac 8e 25 88 69 97 a0", "junk_share"),
        ("g['[gg;hkqp otr;fa;r'urghd kjfe'qdlhqeosf", "noise_share"),
    ],
)
def test_line_kinds(text, share):
    m = textquality.measure(text, WORDS)
    assert m[share] > 0.5, m


def test_statistics():
    m = textquality.measure(PROSE, WORDS)
    assert m["n_words"] == 60 and m["common_ratio"] > 0.4 and max(m[k] for k in textquality.SHARES) < 0.3
    assert textquality.measure("click here " * 20, WORDS)["repeat_ratio"] > 0.8
    assert all(textquality.measure(x, WORDS) is None for x in (None, "", " \n\t", " "))
    assert textquality.measure("a " * 400_000, WORDS)["n_words"] == 400_000


def test_forms_and_sketches(spark):
    once = PROSE[: len(PROSE) // 3] + "There is more of that to come for the rest of it, with a few words on what to do in time."
    rows = [(i, once + f" Number {i} is of that kind.", "en" if i % 3 else None, "clash") for i in range(60)] + [(100, "- one\n- two\n- three", "EN", ""), (101, "a;b;c\n1;2;3\n4;5;6", "xx", ""), (102, "unsubscribe " * 30, "en", ""), (103, None, "en", ""), (104, " ", "en", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string")
    words = spark.createDataFrame([("en", w) for w in WORDS] + [("de", None)], "lang string, word string")
    assert {tuple(r) for r in textquality.document_forms(df, words).collect()} == {(100, "list"), (101, "table"), (102, "junk")}
    assert textquality.document_forms(df.limit(0), words).count() == 0
    stats = textquality.text_statistics(df, textquality.frequent_words(words)).cache()
    parts = textquality.sketches(stats.filter("doc_id % 2 = 0")).unionByName(textquality.sketches(stats.filter("doc_id % 2 = 1")))
    # The scores decide: without them nothing is flagged.
    zeroed = textquality.robust_scores(stats).withColumns({f"z_{k}": F.lit(0.0) for k in textquality.LEAST_SPREAD})
    assert textquality.forms(zeroed).count() == 0
    merged = textquality.robust_scores(stats, textquality.merge_sketches(parts))
    whole = textquality.robust_scores(stats)
    a, b = ({r.doc_id: r.z_symbol_ratio for r in x.collect()} for x in (merged, whole))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 0.5 for k in a)
    with pytest.raises(ValueError):
        textquality.frequent_words(words, most=3)
