import base64
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from quillfold.llm import bpe, encode  # noqa: E402

FILE = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def peer():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(texts, peer):
    enc = bpe.Encoder(FILE)
    for a, b in bpe.groups(texts, 5000):
        flat, ends = enc.encode(texts[a:b])
        for i, t in enumerate(texts[a:b]):
            ids = flat[ends[i] : ends[i + 1]].tolist()
            assert ids == peer.encode_ordinary(t), repr(t)
            assert enc.decode(ids) == t
        assert (enc.encode(texts[a:b], counts_only=True)[1] == ends).all()


def test_equals_the_public_tokenizer(peer):
    rnd = random.Random(5)
    letters = list("abstmdrevl'' \n\t 19!?.é٣中​👍\r  ")
    check(["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(4000)], peer)


def test_long_and_odd_texts(peer):
    check(["", " ", "\n\n", "'", "'s", " 's", "\n's", "it's'll", "ab" * 20_000, "x" * 30_000, " " * 5000, "é" * 3000, "<|endoftext|>"], peer)


def test_column_form(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "y"), (3, "", "z"), (1, "Hello world", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode.encode_texts(df, ["doc_id"]).collect())
    assert got == [(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert encode.encode_texts(df.limit(0), ["doc_id"]).collect() == []
    assert sorted((r.doc_id, r.n_tokens) for r in encode.count_tokens(df, ["doc_id"]).collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]


def test_cache_is_bounded():
    enc = bpe.Encoder(FILE, cache=10)
    for i in range(20):
        enc.encode([f"w{i} x{i}"])
        assert len(enc.index) <= 16


def test_offsets_cut_the_text_into_its_tokens(spark):
    rows = [(1, "Grüße, 東京! \U0001f600 and so on  \n\n x"), (2, None), (3, ""), (4, "a" * 5000)]
    enc = bpe.Encoder(FILE)
    for r in encode.encode_offsets(spark.createDataFrame(rows, "k int, text string"), ["k"], tokenizers=FILE.rsplit("/", 1)[0]).collect():
        data = (rows[r.k - 1][1] or "").encode()
        assert len(r.ids) == len(r.starts) and [enc.ranks[data[a:b]] for a, b in zip(r.starts, [*r.starts[1:], len(data)])] == r.ids
