"""Mixing sources to target shares of the total size in tokens.

1. One Arrow stage counts each document's tokens and hashes its distinct words
   into a fixed number of features.
2. A naive Bayes classifier is counted over all documents of the labelled table
   (label: source; classes: the sources with a target, and one for the rest) and
   gives each document a posterior over the sources that can be used.
3. Documents of one recorded source and of like posterior (same likeliest class,
   same eighth of its probability) share a rate. Per such cell one distributed
   aggregation gives the tokens and the expected tokens per class, which is all
   that the least-squares problem depends on; the number of cells is bounded by
   the number of classes, whatever the corpus.
4. Projected gradient descent on ``1/2 |E r - g|^2``, the distance of the
   expected totals by posterior from the targets, over the rates between 0 and
   ``max_repeats`` whose totals by recorded source are the targets exactly. The
   projection is one shift per source; steps are one over the largest
   eigenvalue, with momentum that is dropped whenever the objective would rise.
   Where both kinds of totals can't be met, the recorded ones are, and the report
   shows what is left of the others.
5. Rates become whole numbers of copies by diffusing the rounding error from
   large to small documents within buckets of a source, so that the shares reached
   are off by about the smallest document of a bucket.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.llm import bpe
from quillfold.llm.encode import BYTE_BPE, TOKENIZERS
from quillfold.session import cut

FEATURES = 4096
REST = "(rest)"
LEVELS = 8  # classes of a posterior's largest probability


def _measure(rank_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(rank_file)
        known: dict[str, int] = {}
        for batch in batches:
            texts = [x or "" for x in batch.column("_text").to_pylist()]
            for a, b in bpe.groups(texts):
                _, ends = enc.encode(texts[a:b], counts_only=True)
                rows = []
                for t in texts[a:b]:
                    words = set(t.lower().split())
                    if len(known) > 500_000:
                        known.clear()
                    got = set()
                    for w in words:
                        k = known.get(w)
                        if k is None:
                            k = known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % FEATURES
                        got.add(k)
                    rows.append(np.fromiter(got, np.int16, len(got)))
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                flat = np.concatenate(rows) if rows else np.zeros(0, np.int16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("source").slice(a, b - a), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "source", "n_tokens", "features"]
                )

    return run


def _posteriors(classes: list[str], usable: np.ndarray, prior: np.ndarray, weight: np.ndarray, temper: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {c: i for i, c in enumerate(classes)}
        k = int(usable.sum())
        for batch in batches:
            if not batch.num_rows:
                continue
            col = batch.column("features")
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.diff(col.offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), n)
            score = np.zeros((len(n), k))
            for j, c in enumerate(np.flatnonzero(usable)):
                score[:, j] = np.bincount(row, weight[c][flat], len(n))
            # Words of a text depend on each other: evidence grows with the root of their number.
            score = prior[usable] + score * (temper / np.sqrt(np.maximum(n, 1)))[:, None]
            score = np.exp(score - score.max(axis=1, keepdims=True))
            score /= score.sum(axis=1, keepdims=True)
            hard = np.array([at.get(s, len(classes) - 1) for s in batch.column("source").to_pylist()])
            place = np.cumsum(usable) - 1
            best = score.argmax(axis=1)
            cell = (np.where(usable[hard], place[hard], k) * k + best) * LEVELS + np.minimum((score.max(axis=1) * LEVELS).astype(int), LEVELS - 1)
            post = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * k + 1, k, dtype=np.int32)), pa.array(score.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("n_tokens"), pa.array(cell, pa.int32()), post], names=["doc_id", "source", "n_tokens", "cell", "post"])

    return run


def _cell_sums(k: int):
    """Arrow stage: per task and cell the tokens and the expected tokens by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("n_tokens").to_numpy().astype(float)
            post = batch.column("post").flatten().to_numpy(zero_copy_only=False).reshape(-1, k).astype(float)
            cell, inverse = np.unique(batch.column("cell").to_numpy(), return_inverse=True)
            sums = np.zeros((len(cell), k + 1))
            np.add.at(sums, inverse, np.hstack([size[:, None], post * size[:, None]]))
            for c, v in zip(cell.tolist(), sums):
                total[c] = total[c] + v if c in total else v
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, k + 1), pa.int32()), pa.array(np.tile(np.arange(k + 1), len(keys)), pa.int32()), pa.array(np.concatenate([total[c] for c in keys]) if keys else [], pa.float64())], names=["cell", "j", "v"])

    return run


def _project(x: np.ndarray, tokens: np.ndarray, hard: np.ndarray, cap: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """The nearest rates between 0 and ``cap`` with ``sum(tokens * rate) = goal`` for each source, in the metric that weighs by tokens."""
    k = len(goal)
    low, high = np.full(k, -float(cap.max(initial=0)) - np.abs(x).max(initial=0)), np.full(k, float(cap.max(initial=0)) + np.abs(x).max(initial=0))
    for _ in range(50):
        shift = (low + high) / 2
        short = np.bincount(hard, tokens * np.clip(x + shift[hard], 0, cap), k) < goal
        low, high = np.where(short, shift, low), np.where(short, high, shift)
    return np.clip(x + high[hard], 0, cap)


def fit_rates(tokens: np.ndarray, expected: np.ndarray, hard: np.ndarray, caps: np.ndarray, goal: np.ndarray, start: np.ndarray, steps: int = 2000, small: float = 1e-7) -> tuple[np.ndarray, list[float]]:
    """(rates, objectives) of cells: ``tokens`` (c,), ``expected`` (c, k) tokens by class, ``hard`` (c,) recorded class, ``goal`` (k,) shares of 1.

    All totals are in units of the mixture's size. The metric of the descent
    weighs each cell's rate with its tokens, so that the step doesn't depend on
    how documents fall into cells.
    """
    used = tokens > 0
    inverse = np.where(used, 1 / np.where(used, tokens, 1), 0.0)[:, None]
    share = expected * inverse  # mean posterior of a cell
    step = 1 / max(float(np.linalg.eigvalsh(expected.T @ share).max(initial=0.0)), 1e-300)
    cap = caps[hard]
    value = lambda x: 0.5 * float(np.sum((x @ expected - goal) ** 2))
    down = lambda x: _project(x - step * (share @ (x @ expected - goal)), tokens, hard, cap, goal)
    r = _project(np.clip(start[hard], 0, cap), tokens, hard, cap, goal)
    ahead, t, out = r, 1.0, [value(r)]
    for _ in range(steps):
        new = down(ahead)
        if value(new) > out[-1]:  # momentum went too far: a plain step can't rise
            new, t = down(r), 1.0
        moved = float(np.max(np.abs(new - r), initial=0.0))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, r, t = new + (t - 1) / s * (new - r), new, s
        out.append(value(r))
        if moved < small:
            break
    return r, out


def _diffuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow stage over rows sorted by (source, bucket, size falling): whole copies whose tokens follow the rates'."""
    key, error = None, 0.0
    for batch in batches:
        copies = []
        for s, b, n, r in zip(*(batch.column(c).to_pylist() for c in ("source", "bucket", "n_tokens", "rate"))):
            if (s, b) != key:
                key, error = (s, b), 0.0
            low = int(r + 1e-9)
            take = low + (error + (r - low) * n >= n / 2 and r - low > 1e-9)
            error += (r - take) * n
            copies.append(take)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "n_tokens", "rate", "post")), pa.array(copies, pa.int32())], names=["doc_id", "source", "n_tokens", "rate", "post", "copies"])


class Mixture:
    """Documents with rates and copies, and the report per source."""

    def __init__(self, docs: DataFrame, targets: DataFrame, temper: float = 2.0, bucket: int = 1000, most_sources: int = 64, tokenizers: str = TOKENIZERS, rank_file: str = BYTE_BPE):
        """``targets`` has (source, target_share, max_repeats); more than ``most_sources`` of them are an error.

        The total is the largest that every source with documents and a target
        can bear; the share of targets without documents is divided among the
        others in proportion. Documents without source or target aren't used.
        """
        rows = targets.filter("source is not null and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).orderBy("source").limit(most_sources + 1).collect()
        if len(rows) > most_sources:
            raise ValueError(f"more than {most_sources} sources")
        self.targets = {r.source: (float(r.share), int(r.cap or 0)) for r in rows}
        classes = [*self.targets, REST]
        kind = docs.schema["doc_id"].dataType.simpleString()
        read = docs.select("doc_id", "source", F.col("text").alias("_text"))
        sized = cut(read.mapInArrow(_measure(os.path.join(tokenizers, rank_file)), f"doc_id {kind}, source string, n_tokens long, features array<smallint>"), "sized")
        label = F.when(F.col("source").isin(*self.targets), F.col("source")).otherwise(REST) if self.targets else F.lit(REST)
        counts = sized.select(label.alias("label"), F.explode("features").alias("f")).groupBy("label", "f").agg(F.count("*").alias("n")).toArrow()
        sizes = {r.label: (r.docs, r.tokens) for r in sized.groupBy(label.alias("label")).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).collect()}
        seen = np.full((len(classes), FEATURES), 0.5)
        np.add.at(seen, (np.array([classes.index(x) for x in counts.column("label").to_pylist()], int), counts.column("f").to_numpy().astype(int)), counts.column("n").to_numpy())
        number = np.array([sizes.get(c, (0, 0))[0] for c in classes], float)
        prior = np.log(np.maximum(number, 0.5) / max(1.0, number.sum()))
        weight = np.log(seen / (number[:, None] + 1.0))

        tokens = {c: float(sizes.get(c, (0, 0))[1] or 0) for c in self.targets}
        self.usable = [c for c in self.targets if tokens[c] > 0 and self.targets[c][1] > 0]
        whole = sum(self.targets[c][0] for c in self.usable) or 1.0
        self.reachable = {c: (self.targets[c][0] / whole if c in self.usable else 0.0) for c in self.targets}
        self.total = min((tokens[c] * self.targets[c][1] / self.reachable[c] for c in self.usable), default=0.0)
        self.sizes = {c: sizes.get(c, (0, 0)) for c in self.targets}
        k = len(self.usable)
        if not k:
            self.objectives, self.documents = [0.0], sized.limit(0).select("doc_id", "source", "n_tokens", F.lit(0.0).alias("rate"), F.lit(0).alias("copies"))
            self.posts = self.documents.withColumn("post", F.array().cast("array<float>"))
            return
        usable = np.array([c in self.usable for c in classes])
        posts = cut(sized.mapInArrow(_posteriors(classes, usable, prior, weight, temper), f"doc_id {kind}, source string, n_tokens long, cell int, post array<float>").filter(F.col("source").isin(*self.usable) & (F.col("n_tokens") > 0)), "posteriors")
        sums = posts.mapInArrow(_cell_sums(k), "cell int, j int, v double").groupBy("cell", "j").agg(F.sum("v").alias("v")).toArrow()
        cell, place = np.unique(sums.column("cell").to_numpy(), return_inverse=True)
        table = np.zeros((len(cell), k + 1))
        table[place, sums.column("j").to_numpy()] = sums.column("v").to_numpy() / self.total
        goal = np.array([self.reachable[c] for c in self.usable])
        caps = np.array([float(self.targets[c][1]) for c in self.usable])
        start = np.array([self.reachable[c] * self.total / tokens[c] for c in self.usable])
        rates, self.objectives = fit_rates(table[:, 0], table[:, 1:], cell // (k * LEVELS), caps, goal, start)
        rate = sized.sparkSession.createDataFrame(list(zip(cell.tolist(), rates.tolist())), "cell int, rate double")
        # At most (classes x classes x 8) rows.
        rated = posts.join(F.broadcast(rate), "cell").filter("rate > 1e-9")
        size = F.lit(1)
        for c in self.usable:
            size = F.when(F.col("source") == c, F.lit(max(1, int(self.sizes[c][0]) // bucket))).otherwise(size)
        placed = rated.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), size.cast("long"))).repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.col("n_tokens").desc(), "doc_id")
        out = placed.select("doc_id", "source", "bucket", "n_tokens", "rate", "post").mapInArrow(_diffuse, f"doc_id {kind}, source string, n_tokens long, rate double, post array<float>, copies int")
        self.posts = out.filter("copies > 0")
        self.documents = self.posts.drop("post")

    def report(self) -> DataFrame:
        """One row per target: shares wanted, reachable and reached by recorded source, the share expected by posterior, how often the source was used, and the fit.

        ``first_objective`` and ``objective`` are half the sum of squared misses of
        the expected shares before and after the descent; the latter is 0 where
        both kinds of totals can be met together.
        """
        spark = self.documents.sparkSession
        weight = F.col("n_tokens") * F.col("copies")
        expected = [F.sum(F.get("post", F.lit(j)) * weight).alias(f"e{j}") for j in range(len(self.usable))]
        got = cut(self.posts.groupBy("source").agg(F.sum(weight).alias("mixed_tokens"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), *expected), "mixed")  # one row a source
        whole = got.agg(F.sum("mixed_tokens").alias("whole"), *[F.sum(f"e{j}").alias(f"e{j}") for j in range(len(self.usable))]).first()
        soft = {c: (whole[f"e{j}"] or 0.0) / (whole["whole"] or 1) for j, c in enumerate(self.usable)}
        rows = [(c, s, m, float(self.reachable[c]), float(soft.get(c, 0.0)), int(self.sizes[c][0] or 0), int(self.sizes[c][1] or 0), len(self.objectives) - 1, float(self.objectives[0]), float(self.objectives[-1])) for c, (s, m) in self.targets.items()]
        plan = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, reachable_share double, expected_share double, documents long, tokens long, steps int, first_objective double, objective double")
        mixed = F.coalesce("mixed_tokens", F.lit(0))
        return plan.join(got, "source", "left").select(
            "source", "target_share", "reachable_share", F.coalesce(F.try_divide(mixed, F.lit(float(whole["whole"] or 0))), F.lit(0.0)).alias("reached_share"), "expected_share", "max_repeats", F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            F.coalesce(F.try_divide(mixed, F.col("tokens")), F.lit(0.0)).alias("repeats"), "documents", "tokens", mixed.alias("mixed_tokens"), "steps", "first_objective", "objective",
        )
