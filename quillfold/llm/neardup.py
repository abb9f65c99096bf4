"""Similarity self-join of texts by shared words, exact for any threshold.

1. Each text becomes its set of distinct words, as sorted 64-bit hashes. Texts
   of equal sets form one class with one representative.
2. A histogram of word hashes over a fixed number of buckets gives a global
   order, rare first. Two sets of similarity t share a word among the first
   n - ceil(t n) + 1 of each, so a representative goes to the cell of each of
   those words that some other text may have. The histogram has a fixed size
   whatever the corpus, so it may be sent to all executors.
3. A cell of more than ``block`` texts is split into stripes; each pair of
   stripes is a cell of its own, so no word is too frequent for one task.
4. Each cell is a signature tree, joined with itself by dual traversal.
5. Surviving pairs are verified on the whole sets.

No bucket is capped and no pair dropped: steps 2-4 only leave out pairs that
cannot reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.llm import sigtree
from quillfold.operators.delivery import surplus_deliveries
from quillfold.session import cut

WORDS64 = 4  # 64-bit words of a bitmap
#: What a cell keeps of a text besides its number and size, packed into one value.
RECORD = np.dtype([("room", "<i4"), ("lost", "<i4"), ("side", "i1"), ("bits", "<u8", (WORDS64,))])
#: Words taken and records given at once by a Python worker; they bound its memory, the result is the same for any.
WORDS_AT_ONCE, RECORDS_AT_ONCE = 200_000, 50_000


def word_sets(texts: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """(key, *keep, words): sorted distinct word hashes of each text.

    A word is a run of letters, digits and underscores, case ignored. Null
    texts have no words.
    """
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    words = F.transform(F.array_distinct(found), lambda w: F.xxhash64(w))
    return texts.select(key, *keep, F.sort_array(words).alias("words"))


def word_order(sets: DataFrame, buckets: int) -> np.ndarray:
    """Texts per bucket of word hashes: an array of ``buckets`` counts, the same size for any corpus."""
    rows = sets.select(F.explode("words").alias("w")).groupBy(F.pmod("w", F.lit(buckets)).cast("int").alias("b")).agg(F.count("*").alias("n")).toArrow()
    out = np.zeros(buckets, np.int32)
    out[rows.column("b").to_numpy()] = rows.column("n").to_numpy()
    return out


def _pieces(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of neighbours that weigh at most ``most`` together; what weighs more is a run of its own."""
    total = np.cumsum(weights)
    i = 0
    while i < len(total):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def _postings(order, t: float, block: int):
    """Arrow stage: one record for each cell of each representative.

    Batches are taken in pieces of some WORDS_AT_ONCE and given in pieces of some
    RECORDS_AT_ONCE, so memory depends neither on the rows of a batch nor on the
    number of stripes, which grows with the corpus.
    """

    def records(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = order.value
        col = batch.column("words")
        flat = col.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(col.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        df = counts[np.mod(flat, len(counts))]
        at = np.lexsort((flat, df, row))
        w, df = flat[at], df[at]
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        n = sizes[row]
        prefix = n - np.ceil(t * n - 1e-9).astype(np.int64) + 1
        use = np.flatnonzero((place < prefix) & (df > 1))
        bits = np.zeros((len(sizes), WORDS64), np.uint64)
        bit = (w.view(np.uint64) >> np.uint64(7)) % np.uint64(64 * WORDS64)
        for k in range(WORDS64):
            sel = np.flatnonzero(bit // np.uint64(64) == k)
            np.bitwise_or.at(bits[:, k], row[sel], np.uint64(1) << (bit[sel] % np.uint64(64)))
        lost = (sizes - np.bitwise_count(bits).sum(axis=1)).astype(np.int32)
        # the stripe comes from the set itself, so that it is the same in a recomputed task
        own = np.bitwise_xor.reduceat(flat.view(np.uint64), np.cumsum(sizes) - sizes)
        in_all = -(-df[use] // block)
        for begin, end in _pieces(in_all, RECORDS_AT_ONCE):
            part, stripes = use[begin:end], in_all[begin:end]
            r, word, room = row[part], w[part], (n - place)[part].astype(np.int32)
            one = np.flatnonzero(stripes == 1)
            cells, rows, rooms, sides = [word[one]], [r[one]], [room[one]], [np.full(len(one), 2, np.int8)]
            many = np.flatnonzero(stripes > 1)
            if len(many):
                s = stripes[many]
                mine = (own[r[many]] % s.astype(np.uint64)).astype(np.int64)
                k = np.repeat(np.arange(len(many)), s)
                other = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
                i, j = np.minimum(mine[k], other), np.maximum(mine[k], other)
                cells.append(_mix(word[many][k], i, j))
                rows.append(r[many][k])
                rooms.append(room[many][k])
                sides.append(np.where(i == j, 2, np.where(mine[k] == i, 0, 1)).astype(np.int8))
            r = np.concatenate(rows)
            record = np.empty(len(r), RECORD)
            record["lost"], record["room"], record["side"], record["bits"] = lost[r], np.concatenate(rooms), np.concatenate(sides), bits[r]
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(RECORD.itemsize), len(r), [None, pa.py_buffer(record.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(sizes[r].astype(np.int32)), batch.column("h").take(pa.array(r)), packed], names=["cell", "size", "h", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in _pieces(np.diff(batch.column("words").offsets.to_numpy()), WORDS_AT_ONCE):
                yield from records(batch.slice(begin, end - begin))

    return run


def _mix(w: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A cell number for a word and a pair of stripes."""
    x = w.view(np.uint64) ^ (i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (j.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _unpacked(column: pa.BinaryArray) -> np.ndarray:
    """The records of a column, without a Python object for each."""
    begin = column.offset * RECORD.itemsize + (column.buffers()[1] and int(np.frombuffer(column.buffers()[1], np.int32, 1)[0]) or 0)
    return np.frombuffer(column.buffers()[2], RECORD, len(column), begin) if len(column) else np.empty(0, RECORD)


def _traverse(t: float, hold: int):
    """Arrow stage over records sorted by (cell, size): pairs from the cells' trees."""

    def pairs(part: pa.Table) -> Iterator[pa.RecordBatch]:
        cell = part.column("cell").to_numpy()
        record = np.concatenate([_unpacked(c) for c in part.column("packed").chunks])
        size = part.column("size").to_numpy()
        room, lost, side = (record[k] for k in ("room", "lost", "side"))
        bits = np.ascontiguousarray(record["bits"])
        rep = part.column("h").combine_chunks()
        tree = sigtree.Tree(cell, None if (side == 2).all() else side, size, room, bits, lost)
        for a, b in sigtree.similar(tree, t):
            yield pa.RecordBatch.from_arrays([rep.take(pa.array(a)), rep.take(pa.array(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            if rows < hold:
                continue
            part = pa.Table.from_batches(kept)
            cell = part.column("cell").to_numpy()
            whole = int(np.searchsorted(cell, cell[-1], "left"))  # the last cell may go on
            if whole:
                yield from pairs(part.slice(0, whole))
            rest = part.slice(whole).combine_chunks()
            kept, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield from pairs(pa.Table.from_batches(kept))

    return run


def similar_sets(sets: DataFrame, t: float, buckets: int = 1 << 20, block: int = 20_000, hold: int = 60_000, task_records: int = 250_000) -> DataFrame:
    """(a, b, shared, all): pairs of representatives, a < b, of Jaccard similarity ``t`` or more. ``sets`` has (rep, words), one row per distinct set.

    Records are spread over as many partitions as keep some ``task_records`` in each, however large the corpus.
    """
    spark = sets.sparkSession
    counts = word_order(sets, buckets)
    order = spark.sparkContext.broadcast(counts)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A text has a record for about 1 - t of its words, with more where a cell has several stripes.
    records_in_all = int(((1 - t) * counts * -(-counts.astype(np.int64) // block)).sum())
    parts = max(least, records_in_all // task_records + 1)
    # Records name a text by a hash of its key: should two keys share one, the verification tells them apart.
    sets = sets.withColumn("h", F.xxhash64("rep"))
    records = sets.select("h", "words").mapInArrow(_postings(order, t, block), "cell long, size int, h long, packed binary")
    found = (
        records.repartition(parts, F.col("cell"))
        .sortWithinPartitions("cell", "size")
        .mapInArrow(_traverse(t, hold), "a long, b long")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    found = cut(found, "pairs")
    # Both joins read one and the same exchange of the sets; only sets of pairs travel on.
    left = found.join(sets, found["a"] == sets["h"]).select("a", "b", F.col("rep").alias("ra"), F.col("words").alias("wa"))
    both = left.join(sets, left["b"] == sets["h"]).filter((F.col("a") != F.col("b")) | (F.col("ra") < F.col("rep")))
    both = both.select(F.least("ra", "rep").alias("a"), F.greatest("ra", "rep").alias("b"), (F.size("wa") + F.size("words")).alias("sum"), F.array_intersect("wa", F.col("words")).alias("both"))
    # The intersection is found once a pair: the filter needs its size only.
    shared = both.select("a", "b", "sum", F.size("both").alias("shared"))
    return shared.filter(F.col("shared") * F.lit(1 + t) >= F.lit(t) * F.col("sum") - F.lit(1e-9)).select("a", "b", "shared", (F.col("sum") - F.col("shared")).alias("all"))


def near_duplicates(texts: DataFrame, key: str, text: str, group: str, t: float, least: int, left_out: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the texts.

    members: (key, group, rep, copies), one row per text with enough words,
    repeated rows once; ``rep`` is the smallest key with the same set of words.
    links: (a, b, shared, all) between representatives. ``left_out`` names keys
    that don't count, in its only column.
    """
    # Texts are tokenised once, where they lie. All that decides who represents whom is done on keys and short set ids;
    # words travel for the verification only.
    sets = word_sets(texts, key, text, group).withColumn("set_id", F.concat_ws("-", F.xxhash64("words"), F.hash("words"), F.size("words")))
    sets = cut(sets, "sets").filter(F.size("words") >= least)
    rows = sets.select(key, group, "set_id")
    if left_out is not None:
        rows = rows.join(left_out.toDF(key), key, "left_anti")
    rows = rows.groupBy(key).agg(F.min(group).alias(group), F.min("set_id").alias("set_id"), F.count("*").alias("rows"))
    rows = cut(rows, "keys")
    several = rows.groupBy("set_id").agg(F.min(key).alias("rep"), F.count("*").alias("copies")).filter("copies > 1")
    members = rows.join(several, "set_id", "left").select(key, group, "rows", F.coalesce("rep", F.col(key)).alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    members = cut(members, "members")
    reps = members.filter(F.col("rep") == F.col(key))
    surplus = sets.select(key).join(reps.filter("rows = 1").select(key), key, "left_anti").distinct()
    single = sets.join(cut(surplus, "surplus"), key, "left_anti").select(F.col(key).alias("rep"), "words")
    repeated = sets.join(cut(reps.filter("rows > 1").select(key), "repeated"), key, "left_semi").groupBy(key).agg(F.first("words").alias("words")).select(F.col(key).alias("rep"), "words")
    return members.drop("rows"), similar_sets(cut(single.unionByName(repeated), "unique"), t)


def pairs_across(members: DataFrame, links: DataFrame, key: str, group: str, expand: int = 200) -> DataFrame:
    """(a, b): pairs of keys, smaller first, of different groups.

    Classes of at most ``expand`` copies are expanded to all their pairs. A
    larger class is given as membership: each of its rows is paired with the
    class's anchor (its smallest key, or, for rows of the anchor's own group,
    the smallest key of another group), and links of the class are given for
    its anchors. No link between different texts is lost.
    """
    big = members.filter(F.col("copies") > expand)
    first = big.filter(F.col(key) == F.col("rep")).select("rep", F.col(group).alias("g1"))
    second = big.join(first, "rep").filter(F.col(group) != F.col("g1")).groupBy("rep").agg(F.min_by(F.struct(F.col(key).alias("k2"), F.col(group).alias("g2")), F.col(key)).alias("s"))
    anchors = first.join(second, "rep", "left").select("rep", "g1", "s.k2", "s.g2")
    stars = big.join(anchors, "rep").select(
        F.col(key).alias("x"), F.when(F.col(group) != F.col("g1"), F.col("rep")).otherwise(F.col("k2")).alias("y")
    ).filter("y is not null")
    stars = stars.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    small = members.filter((F.col("copies") <= expand)).select("rep", F.col(key).alias("k"), F.col(group).alias("g"), "copies")
    ends = small.drop("copies").unionByName(anchors.select("rep", F.col("rep").alias("k"), F.col("g1").alias("g"))).unionByName(anchors.filter("k2 is not null").select("rep", F.col("k2").alias("k"), F.col("g2").alias("g")))
    inner = small.filter("copies > 1").drop("copies")
    within = inner.alias("x").join(inner.alias("y"), "rep").filter("x.k < y.k and x.g != y.g").select(F.col("x.k").alias("a"), F.col("y.k").alias("b"))
    ea = ends.select(F.col("rep").alias("a"), F.col("k").alias("ka"), F.col("g").alias("ga"))
    eb = ends.select(F.col("rep").alias("b"), F.col("k").alias("kb"), F.col("g").alias("gb"))
    across = links.select("a", "b").join(ea, "a").join(eb, "b").filter("ga != gb").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    return stars.unionByName(within).unionByName(across)


def classes(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(key, class_id, copies, links): one row per text, with the number of other texts its class is linked to."""
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(degree, "rep", "left").select(key, F.col("rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def _mails(emails: DataFrame, t: float, least: int) -> tuple[DataFrame, DataFrame]:
    """Members and links of the kept row of each message; a mail without thread is a thread of its own."""
    texts = emails.select("id", F.concat_ws(" ", "subject", "body_text_full").alias("text"), F.coalesce("thread_id", "id").alias("thread"))
    return near_duplicates(texts, "id", "text", "thread", t, least, surplus_deliveries(emails))


def similar_mails(emails: DataFrame, t: float = 0.7, least: int = 40) -> DataFrame:
    """(email_a, email_b): mails of different threads whose words agree to at least ``t``.

    Mails with fewer than ``least`` distinct words, null and empty ones
    included, are left out; of repeated deliveries only the kept row counts.
    """
    members, links = _mails(emails, t, least)
    return pairs_across(members, links, "id", "thread").select(F.col("a").alias("email_a"), F.col("b").alias("email_b"))


def mail_classes(emails: DataFrame, t: float = 0.7, least: int = 40) -> DataFrame:
    """(id, class_id, copies, links) for each mail with enough words."""
    members, links = _mails(emails, t, least)
    return classes(members, links, "id")
