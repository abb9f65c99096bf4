"""Linking variant spellings of people and organisations within a user's mailbox.

1. Every distinct spelling of a people row is parsed into a name form (given
   name or initial, family name); forms are counted per row on the map side, and
   the most frequent one decides, together with the row's address.
2. Family names and brands within the edit radius are found by metric-space
   partitioning, always: each name goes to its nearest pivot and, by the triangle
   inequality, to the cell of each pivot that is at most twice its radius
   farther; the number of pivots follows the number of names. Inside a cell the
   distances to the pivots and the sets of letters leave out what can't be near,
   and the built-in Levenshtein distance decides exactly.
3. Forms whose given names agree are linked; components are the parties.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.functions.identity import registrable, sld
from quillfold.llm.neardup import pairs_across
from quillfold.llm.pii import FIRM, GIVEN, fold_letters
from quillfold.operators.components import connected_components
from quillfold.operators.lookalike import without_one
from quillfold.session import cut

RADIUS = 2

# Short forms of given names.
SHORT = {
    "alex": "alexander", "sandy": "alexander", "ben": "benjamin", "chris": "christopher", "kit": "christopher", "dan": "daniel", "danny": "daniel", "debbie": "deborah", "deb": "deborah", "ed": "edward", "eddie": "edward",
    "ned": "edward", "ted": "theodore", "theo": "theodore", "liz": "elizabeth", "beth": "elizabeth", "lizzie": "elizabeth", "betty": "elizabeth", "fred": "frederick", "freddie": "frederick", "greg": "gregory", "jen": "jennifer", "jenny": "jennifer",
    "jess": "jessica", "jessie": "jessica", "joe": "joseph", "joey": "joseph", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "meg": "margaret", "maggie": "margaret", "peggy": "margaret", "mike": "michael", "mick": "michael", "nick": "nicholas", "nicky": "nicholas",
    "pat": "patricia", "patty": "patricia", "trish": "patricia", "becky": "rebecca", "becca": "rebecca", "bob": "robert", "rob": "robert", "bobby": "robert", "sam": "samuel", "sammy": "samuel", "steve": "stephen", "steven": "stephen", "sue": "susan", "susie": "susan", "tom": "thomas", "tommy": "thomas",
    "tim": "timothy", "vicky": "victoria", "tori": "victoria", "will": "william", "bill": "william", "billy": "william", "tony": "anthony", "juergen": "jurgen", "soeren": "soren", "zoee": "zoe", "gosia": "malgorzata",
}
_FULL = frozenset(GIVEN) | frozenset(SHORT)
# Titles, and parts of organisations' names that don't tell them apart.
TITLES = frozenset("mr mrs ms miss dr prof professor herr frau mme m sir madam ing dipl mba phd".split())
ROLES = frozenset(
    "info orders order accounts account billing notices notice noreply no-reply donotreply support sales contact office team hello admin invoices finance help helpdesk service mail news newsletter alerts notifications notify all-staff allstaff staff press jobs hr marketing reception desk customercare".split()
)
_FIRMS = frozenset(FIRM)
_PAREN = re.compile(r"\([^)]*\)|\[[^\]]*\]")


def fold(s: str) -> str:
    return fold_letters(s).lower()


class Givens:
    """Given names seen in the corpus, as the buckets of their hashes: a fixed number, whatever the corpus."""

    def __init__(self, buckets: np.ndarray | None = None):
        self.bits = np.zeros(1 << 22, bool)
        if buckets is not None:
            self.bits[buckets] = True

    def __contains__(self, token: str) -> bool:
        return len(token) >= 3 and bool(self.bits[zlib.crc32(token.encode()) & ((1 << 22) - 1)])


def _given(token: str, more: Givens | tuple = ()) -> str | None:
    """The full given name a token stands for."""
    if token in _FULL or token in more:
        return SHORT.get(token, token)
    return None


def _deletions(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


_NEAR_GIVEN: dict[str, set[str]] = {}
for _name in _FULL:
    for _v in {_name} | _deletions(_name):
        _NEAR_GIVEN.setdefault(_v, set()).add(_name)


def _given_like(token: str, more: Givens | tuple = ()) -> str | None:
    """The one given name of four letters or more that a token spells with at most one slip (an edit or a swap)."""
    g = _given(token, more)
    if g or len(token) < 4:
        return g
    # Two words with a slip between them have a variant in common after at most one deletion each.
    found = {x for v in {token} | _deletions(token) for x in _NEAR_GIVEN.get(v, ())}
    near = {SHORT.get(x, x) for x in found if len(x) >= 4 and _slip(x, token)}
    return near.pop() if len(near) == 1 else None


def _slip(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1 or _swapped(a, b)
    return abs(len(a) - len(b)) == 1 and min(a, b, key=len) in _deletions(max(a, b, key=len))


def _swapped(a: str, b: str) -> bool:
    d = [i for i in range(len(a)) if a[i] != b[i]]
    return len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]


def parse_name(raw: str | None, more: Givens | tuple = ()) -> tuple[str | None, str | None, str] | None:
    """(full given name, initial, family name) of a typed name, or None."""
    if not raw:
        return None
    s = _PAREN.sub(" ", fold(raw)).strip(" \"'")
    comma = re.match(r"\s*([a-z'-]+)\s*,\s*(.+)$", s)
    tokens = [t for t in re.findall(r"[a-z][a-z'-]*", s) if t.strip("'-") not in TITLES or len(t) == 1]
    if not tokens:
        return None
    if len(tokens) == 1:
        return _joined(tokens[0], more)
    if comma and len(comma.group(1)) > 1:
        family, rest = comma.group(1), [t for t in tokens if t != comma.group(1)] or tokens[1:]
        first = next((t for t in rest if len(t) > 1), rest[0] if rest else "")
        if _given(family, more) and not _given(first, more):
            family, first = first, family
        return (None, first[:1] or None, family) if len(first) <= 1 else (_given_like(first, more) or first, first[0], family)
    long = [t for t in tokens if len(t) > 1]
    single = [t for t in tokens if len(t) == 1]
    if not long:
        return None
    if len(long) == 1:
        return (None, single[0], long[0]) if single else None
    a, b = long[0], long[-1]
    for x, y in ((a, b), (b, a)):
        if _given(x, more) and not _given(y, more):
            g = _given(x, more)
            return g, g[0], y
    for x, y in ((a, b), (b, a)):
        if (g := _given_like(x, more)) and not _given_like(y, more):
            return g, g[0], y
    g = _given(a, more) or a
    return g, g[0], b


def _joined(token: str, more: Givens | tuple = ()) -> tuple[str | None, str | None, str] | None:
    """A name written as one word: given and family, or initial and family."""
    for k in range(min(len(token) - 4, 12), 1, -1):
        if g := _given(token[:k], more):
            if len(token) - k >= 4 and k >= 3:
                return g, g[0], token[k:]
    return (None, token[0], token[1:]) if len(token) >= 6 else None


def parse_local(local: str, more: Givens | tuple = ()) -> tuple[str | None, str | None, str] | None:
    """A name from the local part of an address; None where it shows none."""
    s = re.sub(r"\+.*$", "", fold(local))
    parts = [re.sub(r"\d+", "", p) for p in re.split(r"[._-]+", s)]
    parts = [p for p in parts if p]
    if re.search(r"\d", s) and len(parts) == 1:
        return None  # a first name or initials with a number
    if len(parts) == 1:
        return _joined(parts[0], more)
    if len(parts) == 2:
        a, b = parts
        if len(a) == 1 and len(b) > 3:
            return None, a, b
        if len(b) == 1 and len(a) > 3:
            return None, b, a
        if _given(a, more) and len(b) > 3:
            return _given(a, more), _given(a, more)[0], b
        if _given(b, more) and len(a) > 3:
            return _given(b, more), _given(b, more)[0], a
    return None


def _firm_words(raw: str | None, local: str) -> tuple[bool, str]:
    """Whether a role address or the name's last word shows an organisation, and the name as one word."""
    if fold(local).split("+")[0] in ROLES:
        return True, ""
    tokens = re.findall(r"[a-z]+", _PAREN.sub(" ", fold(raw or "")))
    firm = len(tokens) >= 2 and tokens[-1] in _FIRMS and not _given(tokens[0])
    return firm, "".join(t for t in tokens if t not in ("the", "limited", "gmbh", "ltd", "group", "team"))


_FORM = "id string, address string, brand string, k long, firm boolean, word string, given string, initial string, family string, own_given string, own_initial string, own_family string"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow stage: the two long words of a name, and whether each stands where a given name does."""
    for batch in batches:
        row, token, first = [], [], []
        for r, raw in enumerate(batch.column("name").to_pylist()):
            s = _PAREN.sub(" ", fold(raw or ""))
            long = [t for t in re.findall(r"[a-z][a-z'-]+", s) if t.strip("'-") not in TITLES]
            if len(long) == 2 and long[1] not in _FIRMS:
                row += [r, r]
                token += long
                first += [False, True] if "," in s else [True, False]
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row, pa.int32())), pa.array(token, pa.string()), pa.array(first, pa.bool_())], names=["id", "token", "first"])


def given_names(names: DataFrame, least: int = 3) -> DataFrame:
    """(token, canonical): words that stand as given names, with the name each one is or misspells; null where it is neither.

    A name stands as one for at least ``least`` people rows, and three times as
    often as not. A word with a slip of one such name that is five times as
    frequent is that name misspelt. The pairs meet by what is left of them after
    a deletion.
    """
    seen = names.mapInArrow(_tokens, "id string, token string, first boolean").distinct().groupBy("token").agg(F.count_if("first").alias("n"), F.count_if(~F.col("first")).alias("m"))
    seen = cut(seen.filter("n > 0").withColumn("often", (F.col("n") >= least) & (F.col("n") >= 3 * F.col("m"))), "tokens")
    keyed = seen.filter("length(token) >= 4 or often").select("token", "n", "often", F.explode(F.array_union(F.array("token"), without_one(F.array("token")))).alias("left"))
    letters = lambda c: F.array_sort(F.split(c, ""))
    a, b = keyed.alias("a"), keyed.filter("often").alias("b")
    slip = (F.levenshtein("a.token", "b.token") == 1) | (letters(F.col("a.token")) == letters(F.col("b.token")))
    meant = a.join(b, "left").filter("a.token != b.token and b.n >= 5 * a.n").filter(slip).groupBy("a.token").agg(F.min("b.token").alias("x"), F.max("b.token").alias("y"))
    known = seen.join(meant, "token", "left")
    return known.select("token", F.when(F.col("x") == F.col("y"), F.col("x")).when(F.col("x").isNull() & F.col("often"), F.col("token")).alias("canonical"))


def _parse(shared):
    """Arrow stage: the forms that a spelling and an address show."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _parsed(batches, Givens(shared.value))

    return run


def _parsed(batches: Iterator[pa.RecordBatch], more: Givens) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for raw, address in zip(batch.column("name").to_pylist(), batch.column("address").to_pylist()):
            local = (address or "").strip().lower().partition("@")[0]
            form = parse_name(raw, more)
            out.append((*_firm_words(raw, local), *(form if form and form[2] not in _FIRMS else (None,) * 3), *(parse_local(local, more) or (None,) * 3)))
        cols = list(zip(*out)) or [()] * 8
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "address", "brand", "k")), pa.array(cols[0], pa.bool_()), *(pa.array(c, pa.string()) for c in cols[1:])], names=[x.split()[0] for x in _FORM.split(", ")])


def described_people(people: DataFrame, identities: DataFrame, participants: DataFrame) -> DataFrame:
    """One row per people row: user, registrable domain, message count, kind (``org``, ``person``, ``unknown``) and name form.

    The names of a row are its canonical name, the names of its identity and
    those of its messages, each distinct spelling once with its count. All of
    them count: votes are summed per row and parsed form on the map side, so a
    list address with any number of spellings never meets in one task. The
    family name with most votes wins (ties: the first in the alphabet), then the
    given name among forms near that family name. An address counts with the
    names that agree with it, or by itself where there is none.
    """
    clean = lambda c: F.when(F.trim(c) != "", c)
    seen = participants.filter("person_id is not null and raw_name is not null").groupBy(F.col("person_id").alias("id"), F.col("raw_name").alias("name")).agg(F.count("*").alias("k"))
    typed = people.select("id", F.col("canonical_name").alias("name"), F.lit(2).cast("long").alias("k"))
    told = identities.select(F.col("person_id").alias("id"), F.col("observed_name").alias("name"), F.lit(1).cast("long").alias("k"))
    names = seen.unionByName(typed).unionByName(told).select("id", clean(F.col("name")).alias("name"), "k").filter("name is not null and id is not null").groupBy("id", "name").agg(F.sum("k").alias("k"))
    where = identities.filter("address is not null").groupBy(F.col("person_id").alias("id")).agg(F.max_by("address", F.struct("message_count", "address")).alias("address"), F.sum("message_count").alias("n"))
    rows = cut(people.filter("id is not null and user_id is not null").select("id", "user_id").distinct().join(where, "id", "left").withColumn("domain", registrable(F.substring_index("address", "@", -1))), "rows")
    names = cut(names, "names")
    known = cut(given_names(names).filter("canonical is not null"), "givens")
    # At most one number for each of the 2^22 buckets.
    buckets = known.filter("token = canonical").select(F.crc32("token").bitwiseAND(F.lit((1 << 22) - 1)).cast("int").alias("b")).distinct().toArrow().column("b").to_numpy()
    spelled = rows.select("id", "address", F.regexp_replace(sld(F.col("domain")), "-", "").alias("brand")).distinct().join(names, "id", "left").select("id", "address", "brand", "name", F.coalesce("k", F.lit(0)).cast("long").alias("k"))
    # A spelling is parsed once; the parsed forms are read for the votes and for the rows.
    parsed = cut(spelled.mapInArrow(_parse(rows.sparkSession.sparkContext.broadcast(buckets)), _FORM), "spellings")
    near = F.col("family").isNotNull() & (F.levenshtein("family", "own_family", RADIUS) >= 0) & (F.col("initial").isNull() | (F.col("initial") == F.col("own_initial")))
    firm = F.col("firm") | ((F.length("brand") >= 6) & F.col("own_family").isNull() & (F.length("word") > 0) & (F.levenshtein("word", "brand", 2) >= 0))
    own = parsed.groupBy("id").agg(
        F.coalesce(F.bool_or(firm), F.lit(False)).alias("org"), F.first("own_given").alias("given"), F.first("own_initial").alias("initial"), F.first("own_family").alias("family"),
        F.sum(F.when(near, F.col("k"))).alias("near"), F.count("family").alias("forms"),
    )
    own = cut(own, "addresses")
    of_address = own.filter("family is not null and (near is not null or forms = 0)").select("id", "given", "initial", "family", (2 + F.coalesce("near", F.lit(0))).alias("k"))
    votes = parsed.filter("family is not null").groupBy("id", "given", "initial", "family").agg(F.sum("k").alias("k")).unionByName(of_address)
    votes = cut(votes, "votes")
    best = votes.groupBy("id", "family").agg(F.sum("k").alias("k")).groupBy("id").agg(F.min_by("family", F.struct(-F.col("k"), "family")).alias("best"))
    close = votes.join(best, "id").filter(F.levenshtein("family", "best", RADIUS) >= 0)
    listed = F.coalesce(F.col("given").isin(*sorted(_FULL)), F.lit(False))
    close = close.join(known.withColumnRenamed("token", "given"), "given", "left").withColumns({"known": listed | F.col("canonical").isNotNull(), "given": F.when(listed, F.col("given")).otherwise(F.coalesce("canonical", "given"))})
    weight = F.when(F.col("known"), 3).otherwise(1)
    each = close.select("id", "best", F.explode(F.array(F.struct(F.lit("g").alias("what"), F.struct("given", "known").alias("value"), (F.col("k") * weight).alias("k")), F.struct(F.lit("i").alias("what"), F.struct(F.col("initial").alias("given"), F.lit(False).alias("known")).alias("value"), F.col("k").alias("k")))).alias("v")).select("id", "best", "v.*")
    top = each.groupBy("id", "best", "what", "value").agg(F.sum("k").alias("k"))
    top = top.groupBy("id").agg(F.first("best").alias("family"), *[F.min_by("value", F.when((F.col("what") == w) & F.col("value.given").isNotNull(), F.struct(-F.col("k"), "value"))).alias(n) for w, n in (("g", "given"), ("i", "first"))])
    found = rows.join(own.select("id", "org"), "id", "left").join(top, "id", "left")
    kind = F.when(F.coalesce("org", F.lit(False)), "org").when(F.col("family").isNotNull(), "person").otherwise("unknown")
    person = kind == "person"
    return found.select(
        "id", "user_id", "domain", F.coalesce("n", F.lit(0)).cast("long").alias("n"), kind.alias("kind"),
        F.when(person, F.col("given.given")).alias("given"), F.when(person, F.coalesce(F.substring("given.given", 1, 1), F.col("first.given"))).alias("initial"), F.when(person, F.col("family")).alias("family"), (person & F.coalesce("given.known", F.lit(False))).alias("known"),
    )


# --- metric-space partitioning -------------------------------------------------


def _masks(words: list[str]) -> np.ndarray:
    """Letters of each word as bits: each edit changes at most two of them."""
    out = np.zeros(len(words), np.uint64)
    for i, w in enumerate(words):
        m = 0
        for c in w:
            m |= 1 << (ord(c) & 63)
        out[i] = m
    return out


def _near(cell: np.ndarray, words: list[str], home: np.ndarray, far: np.ndarray, r: int, chunk: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x, y) within the cells of a batch that may be within the radius, x the smaller word and at home there.

    ``far`` has the distances to the pivots: of two words within r, no two
    differ by more than r (triangle inequality). A word meets only those of its
    cell whose length fits, some ``chunk`` pairs at a time.
    """
    size = np.array([len(w) for w in words], np.int64)
    order = np.lexsort((size, cell))
    cell, size, home, far, mask = cell[order], size[order], home[order], far[order], _masks([words[i] for i in order])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=lambda i: words[order[i]])] = np.arange(len(words))
    key = (cell << 32) + size
    n = np.searchsorted(key, key + r, "right") - np.arange(len(words)) - 1
    begin = 0
    total = np.concatenate([[0], np.cumsum(n)])
    while begin < len(words):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + chunk, "right")) - 1)
        i = np.repeat(np.arange(begin, end), n[begin:end])
        j = i + 1 + np.arange(len(i)) - np.repeat(total[begin:end] - total[begin], n[begin:end])
        begin = end
        ok = np.flatnonzero(np.bitwise_count(mask[i] ^ mask[j]) <= 2 * r)
        i, j = i[ok], j[ok]
        ok = np.flatnonzero((np.abs(far[i] - far[j]) <= r).all(axis=1))
        i, j = i[ok], j[ok]
        first = rank[i] < rank[j]
        x, y = np.where(first, i, j), np.where(first, j, i)
        use = home[x]
        yield order[x[use]], order[y[use]]


def _join_cells(r: int, hold: int = 50_000):
    """Arrow stage over records sorted by cell: candidate pairs of the cells, many small ones or one large one at a time."""

    def pairs(part: pa.Table) -> pa.RecordBatch:
        words = part.column("word").to_pylist()
        grp, at = part.column("grp").combine_chunks(), part.column("cell").to_numpy()
        new = np.ones(len(words), bool)
        new[1:] = (at[1:] != at[:-1]) | pc.not_equal(grp.slice(1), grp.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)
        far = part.column("far").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(words), -1)
        found = list(_near(np.cumsum(new), words, part.column("home").to_numpy(), far, r))
        x, y = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        word = part.column("word").combine_chunks()
        return pa.RecordBatch.from_arrays([grp.take(pa.array(x)), word.take(pa.array(x)), word.take(pa.array(y))], names=["grp", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) < hold:
                continue
            part = pa.Table.from_batches(kept)
            grp, at = part.column("grp"), part.column("cell")
            last = pc.and_(pc.equal(grp, grp[-1]), pc.equal(at, at[-1]))  # the last cell may go on
            whole = part.num_rows - pc.sum(last).as_py()
            if whole:
                yield pairs(part.slice(0, whole))
            kept = part.slice(whole).combine_chunks().to_batches()
        if kept:
            yield pairs(pa.Table.from_batches(kept))

    return run


def name_cells(words: DataFrame, pivots: list[str], r: int) -> DataFrame:
    """(grp, word, cell, home, far): each name in its nearest pivot's cell, and in each cell where a partner may be at home.

    A name of fewer than six letters has radius 1. A partner within its radius q
    is at home with a pivot that is at most 2 q farther than the name's own.
    """
    far = F.array(*[F.levenshtein("word", F.lit(p)).cast("short") for p in pivots])
    reach = F.when(F.length("word") >= 6, 2 * r).otherwise(2 * min(r, 1))
    placed = words.withColumn("far", far).withColumn("least", F.array_min("far"))
    at = F.filter(F.sequence(F.lit(0), F.lit(len(pivots) - 1)), lambda i: F.get(F.col("far"), i) <= F.col("least") + reach)
    return placed.select("grp", "word", F.explode(at).alias("cell"), (F.array_position("far", F.col("least")) - 1).alias("own"), "far").select("grp", "word", "cell", (F.col("cell") == F.col("own")).alias("home"), "far")


def radius_pairs(names: DataFrame, r: int = RADIUS, most_pivots: int = 64) -> DataFrame:
    """(grp, x, y, d): distinct names x < y of one group at Levenshtein distance ``r`` or less, 1 where one has fewer than six letters.

    ``names`` has (grp, word). The number of pivots is the root of the largest
    group's number of names, at least 4 and at most ``most_pivots`` (short strings,
    drawn by hash). A pair comes out of one cell only: that of its smaller name.
    """
    words = cut(names.filter("grp is not null and word is not null and word != ''").distinct(), "words")
    number = words.groupBy("grp").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    drawn = [x.word for x in words.select(F.substring("word", 1, 32).alias("word")).distinct().orderBy(F.xxhash64("word"), "word").limit(max(4, min(most_pivots, math.isqrt(number)))).collect()] or [""]
    cells = name_cells(words, drawn, r).repartition("grp", "cell").sortWithinPartitions("grp", "cell")
    found = cells.mapInArrow(_join_cells(r), "grp string, x string, y string").withColumn("d", F.levenshtein("x", "y", r))
    return found.filter((F.col("d") >= 0) & ((F.least(F.length("x"), F.length("y")) >= 6) | (F.col("d") <= 1)))


# --- domains -------------------------------------------------------------------


def imitating_domains(rows: DataFrame, near: DataFrame) -> DataFrame:
    """(user_id, domain) of domains that only imitate another domain of the same mailbox.

    Two registrable domains are alike if the shorter brand (4 letters or more)
    is a whole token of the longer one, if their brands (6 or more) are within
    two edits, or if they differ only in the suffix. The longer one imitates in
    the first case; else the one with fewer people, then fewer messages.
    ``near`` has (user_id, x, y): brands within two edits, both ways.
    """
    per = rows.filter("domain is not null").groupBy("user_id", "domain").agg(F.count("*").alias("people"), F.sum("n").alias("n")).withColumn("brand", sld(F.col("domain")))
    per = cut(per, "domains")
    token = per.select("user_id", "domain", "brand", F.explode(F.array_distinct(F.split("brand", "[-_.]+"))).alias("token")).filter("token != brand and length(token) >= 4")
    embedded = token.alias("l").join(per.alias("s"), (F.col("l.user_id") == F.col("s.user_id")) & (F.col("l.token") == F.col("s.brand"))).select("l.user_id", "l.domain")
    weaker = F.struct(F.col("a.people"), F.col("a.n")) < F.struct(F.col("b.people"), F.col("b.n"))
    a = per.select("user_id", F.col("brand").alias("x"), F.struct("domain", "people", "n").alias("a"))
    b = per.select("user_id", F.col("brand").alias("y"), F.struct("domain", "people", "n").alias("b"))
    alike = near.filter("length(x) >= 6 and length(y) >= 6").select("user_id", "x", "y").unionByName(per.select("user_id", F.col("brand").alias("x"), F.col("brand").alias("y")).distinct())
    other = alike.join(a, ["user_id", "x"]).join(b, ["user_id", "y"]).filter("a.domain != b.domain").filter(weaker).select("user_id", F.col("a.domain").alias("domain"))
    return embedded.unionByName(other).distinct()


# --- parties -------------------------------------------------------------------


def parties(rows: DataFrame) -> DataFrame:
    """(id, user_id, party) for rows as of :func:`described_people`."""
    rows = cut(rows, "described")
    # Family names and brands go through the pivots together; a prefix keeps them apart.
    tagged = rows.select(F.concat(F.lit("f"), "user_id").alias("grp"), F.col("family").alias("word")).unionByName(rows.filter("length(domain) >= 6").select(F.concat(F.lit("b"), "user_id").alias("grp"), sld(F.col("domain")).alias("word")))
    near = cut(radius_pairs(tagged), "radius")
    near = near.select(F.substring("grp", 1, 1).alias("what"), F.expr("substring(grp, 2)").alias("user_id"), F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p")).select("what", "user_id", "p.*")
    fake = imitating_domains(rows, near.filter("what = 'b'").drop("what")).withColumn("fake", F.lit(True))
    rows = cut(rows.join(fake, ["user_id", "domain"], "left").withColumn("fake", F.coalesce("fake", F.lit(False))), "people")
    org = rows.filter("kind = 'org' or (fake and kind != 'person')").select("id", "user_id", F.concat_ws("|", F.lit("org"), "user_id", F.coalesce("domain", "id")).alias("party"))
    alone = rows.filter("kind = 'unknown' and not fake").select("id", "user_id", F.concat_ws("|", F.lit("row"), "id").alias("party"))
    person = rows.filter("kind = 'person'")
    # People at imitating domains are parties of their own: their domain is part of the mailbox they are compared in.
    person = person.withColumn("grp", F.when(F.col("fake"), F.concat_ws("|", "user_id", "domain")).otherwise(F.col("user_id")))
    forms = cut(person.groupBy("grp", "user_id", "given", "initial", "family").agg(F.min("id").alias("form"), F.bool_or("known").alias("known")), "forms")
    near = near.filter("what = 'f'").drop("what").unionByName(forms.select("user_id", F.col("family").alias("x"), F.col("family").alias("y")).distinct())
    # Family names of two forms of one group that are near each other, each way.
    left = forms.select("grp", "user_id", F.col("family").alias("x"), F.struct("form", "given", "initial", "known").alias("p"))
    right = forms.select("grp", F.col("family").alias("y"), F.struct("form", "given", "initial", "known").alias("q"))
    met = cut(left.join(near, ["user_id", "x"]).select("grp", "y", "p").join(right, ["grp", "y"]).filter("p.form != q.form").select("p", "q"), "met")
    # Initials: resolved to the one full given name that a near family name has, that of the own domain first. One name
    # is one whose smallest and largest are equal, so no list of names is kept.
    fits = met.filter("p.given is null and q.given is not null and (p.initial = q.initial or p.initial is null)").select("p.form", F.col("q.form").alias("other"), "q.given")
    at = person.join(forms, [person[k].eqNullSafe(forms[k]) for k in ("grp", "given", "initial", "family")]).select("form", "domain").filter("domain is not null").distinct()
    homely = fits.join(at, "form").join(at.select(F.col("form").alias("other"), "domain"), ["other", "domain"]).select("form", "given", F.lit(True).alias("home"))
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    named = fits.select("form", "given", F.lit(False).alias("home")).unionByName(homely).groupBy("form").agg(one(F.col("given")).alias("all"), one(F.when(F.col("home"), F.col("given"))).alias("near"))
    settled = named.select("form", F.coalesce("all", "near", F.lit("?")).alias("resolved"))
    met = met.filter("p.form < q.form").select(F.col("p.form").alias("a"), F.col("p.given").alias("g1"), F.col("p.initial").alias("i1"), F.col("p.known").alias("k1"), F.col("q.form").alias("b"), F.col("q.given").alias("g2"), F.col("q.initial").alias("i2"), F.col("q.known").alias("k2"))
    settled = cut(settled, "settled")
    for side in ("1", "2"):
        key = "a" if side == "1" else "b"
        met = met.join(settled.select(F.col("form").alias(key), F.col("resolved").alias("r" + side)), key, "left").withColumn("g" + side, F.coalesce("g" + side, "r" + side))
    # Two names that both stand on their own aren't slips of each other.
    slip = ~(F.col("k1") & F.col("k2")) & (F.levenshtein("g1", "g2", 2) >= 0) & (F.least(F.length("g1"), F.length("g2")) >= 4)
    agree = F.when(F.col("g1").isNotNull() & F.col("g2").isNotNull(), (F.col("g1") != "?") & ((F.col("g1") == F.col("g2")) | slip)).when(F.col("g1").isNull() & F.col("g2").isNull(), F.col("i1") == F.col("i2")).otherwise(F.lit(False))
    roots = connected_components(met.filter(agree).select("a", "b"))
    of = forms.join(roots, F.col("form") == F.col("node"), "left").select("grp", "given", "initial", "family", F.coalesce("root", "form").alias("root"))
    on = [person[k].eqNullSafe(of[k]) for k in ("grp", "given", "initial", "family")]
    people = person.join(of, on).select(person["id"], person["user_id"], F.concat_ws("|", F.lit("person"), person["user_id"], "root").alias("party"))
    return org.unionByName(alone).unionByName(people)


def same_parties(people: DataFrame, identities: DataFrame, participants: DataFrame, expand: int = (1 << 63) - 1) -> DataFrame:
    """(person_a, person_b): all pairs of people rows of one party, smaller first.

    With ``expand``, parties of more rows are given as pairs with their smallest
    row only; :func:`party_members` is the form that doesn't grow with the square. Rows without name and
    telling address are parties of their own.
    """
    found = cut(parties(described_people(people, identities, participants)).distinct(), "parties")
    size = found.groupBy("party").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1")
    members = found.join(size, "party").select("id", "rep", "copies", F.col("id").alias("own"))
    none = members.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(0).alias("shared"), F.lit(0).alias("all")).limit(0)
    return pairs_across(members, none, "id", "own", expand).select(F.col("a").alias("person_a"), F.col("b").alias("person_b"))


def party_members(people: DataFrame, identities: DataFrame, participants: DataFrame) -> DataFrame:
    """(person_id, user_id, party): one row per people row."""
    return parties(described_people(people, identities, participants)).select(F.col("id").alias("person_id"), "user_id", "party").distinct()
