"""Streams over the event table, drained, with the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.session import load, shared_path
from quillfold.streaming import feeds


def _events(spark: SparkSession, d: str, twice: bool = False) -> DataFrame:
    """The event table as a stream of six files in six micro-batches, every thirteenth row one file late (twice: the first file delivered again)."""
    t = load(spark, d, "events")
    late = F.when(F.pmod("event_id", F.lit(13)) == 0, 1).otherwise(0)
    piece = F.least(F.lit(5), F.floor((F.dayofmonth("ts") - 1) / 5) + late)
    return feeds.source(spark, _staged(t, piece, 6, twice), t)


def _staged(t: DataFrame, piece: F.Column, pieces: int, again: bool = False) -> str:
    """A folder with one file for each of the pieces 0, 1, ..., written in this order."""
    path = shared_path(t.sparkSession, "feed")
    rows = t.withColumn("_piece", piece)
    for i in [*range(pieces), *([0] if again else [])]:
        rows.filter(F.col("_piece") == i).drop("_piece").coalesce(1).write.mode("append").parquet(path)
    return path


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    return feeds.drain(feeds.deduplicated(_events(spark, d, twice=True), "event_id", "ts", "60 days"), "dedup").select("event_id", "event_type")


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = feeds.drain(feeds.tumbling(_events(spark, d), "ts", "1 day", ["event_type"], "1 hour"), "tumbling", "complete")
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "n")


def stream_session(spark: SparkSession, d: str) -> DataFrame:
    out = feeds.drain(feeds.sessions(_events(spark, d), "user_id", "ts", "6 hours", "1 hour"), "session", "complete")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def stream_changes(spark: SparkSession, d: str, files: int = 20) -> DataFrame:
    """The change feed followed as a stream of files in order of arrival, so each has late and repeated changes of earlier ones; the result is that of p1_found."""
    t = load(spark, d, "evidence")
    last = t.agg(F.max("ingest_seq")).first()[0] or 0
    path = shared_path(spark, "feed")
    # One job writes all files: ranges of the order of arrival.
    t.repartitionByRange(files, "ingest_seq").write.parquet(path) if last else t.write.parquet(path)
    return feeds.follow_changes(spark, path, t, files_per_trigger=2).read()


def stream_keyed_fold(spark: SparkSession, d: str) -> DataFrame:
    """The full fold kept up to date over a stream of claims in eight files that aren't in order of time; its items are those of the batch fold."""
    from quillfold.plans.ledgerq import _claims

    claim = _claims(spark, d).drop("evidence_quote", "observed_at")
    path = shared_path(spark, "claims")
    claim.repartition(8, "id").write.parquet(path)
    out = feeds.follow_fold(spark, path, spark.read.parquet(path), files_per_trigger=2)
    return out.filter("row_kind = 'item'").groupBy("user_id", "status").agg(F.count("*").alias("items"), F.sum("claims").alias("claims"))


from quillfold.plans.mailops import P1_SQL  # noqa: E402

QUERIES = {
    "stream_dedup": (stream_dedup, "SELECT event_id, event_type FROM events"),
    "stream_tumbling": (stream_tumbling, "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "stream_session": (stream_session, "WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS cut FROM events), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1"),
    "stream_changes": (stream_changes, P1_SQL),
    "stream_keyed_fold": (stream_keyed_fold, None),
}
