"""Structured Streaming: deduplication, windows, rate limits, and the change feed as keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.operators.changefeed import ChangeLog, evidence_changes
from quillfold.session import shared_path


def source(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into Parquet below the shared folder (append) or by whole results (complete)."""
    spark = stream.sparkSession
    out, mark = shared_path(spark, f"{name}-out"), shared_path(spark, f"{name}-mark")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    else:
        stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", mark).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def deduplicated(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """The first delivery of each key within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, ts: str, width: str, keys: list[str], delay: str) -> DataFrame:
    """Counts per window and key."""
    s = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return s.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Sessions of a key that a pause of ``gap`` ends."""
    s = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return s.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def follow_changes(spark: SparkSession, path: str, like: DataFrame, log_path: str | None = None, files_per_trigger: int = 1, fan: int = 4) -> ChangeLog:
    """Append each micro-batch of an evidence feed as a run of a change log, which compacts itself by tiers.

    With ``log_path`` the log and the stream's checkpoint lie together below
    that folder, so a stopped stream goes on where it was. A batch that is
    replayed after a failure is known by its number and left alone.
    """
    home = log_path or shared_path(spark, "follow")
    log = ChangeLog(spark, ["work_item_id", "attribute"], ["at", "step", "evidence_id"], "kind", "evidence_id", path=f"{home}/log-{home.rsplit('/', 1)[-1]}", fan=fan)

    def take(df: DataFrame, number: int) -> None:
        log.append(evidence_changes(df).drop("run"), batch=number)

    source(spark, path, like, files_per_trigger).writeStream.foreachBatch(take).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return log


def follow_fold(spark: SparkSession, path: str, like: DataFrame, home: str | None = None, buckets: int | None = None, files_per_trigger: int = 1) -> DataFrame:
    """Work items and changes of a stream of claims (as of ``ledger.claims``), kept up to date: late claims are folded in their place.

    The fold goes by the time of the message, not of arrival. Each micro-batch
    is added to a ledger by mailbox bucket; then only the buckets it touches are
    folded again from their ledger, and replace their part of the result. A
    claim that arrives twice counts once, a replayed batch changes nothing.
    """
    from quillfold.operators.ledger import full_fold

    home = home or shared_path(spark, "fold")
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.hash("user_id"), F.lit(n)).alias("bucket")

    def take(df: DataFrame, number: int) -> None:
        rows = df.select("*", bucket)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{home}/ledger/batch={number}")
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most the number of buckets
        ledger = spark.read.schema(rows.schema).option("basePath", f"{home}/ledger").parquet(f"{home}/ledger/batch=*").filter(F.col("bucket").isin(*touched))
        once = ledger.select(*df.columns).dropDuplicates(["user_id", "id"])
        folded = full_fold(once).select("*", bucket)
        folded.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{home}/result")

    source(spark, path, like, files_per_trigger).writeStream.foreachBatch(take).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{home}/result").drop("bucket")


def expire_pending(stream: DataFrame, key: str, ts: str, ttl: str, delay: str) -> DataFrame:
    """(key, claim_id, outcome): claims without an owner wait for another claim of their key that has one (``superseded``); when event time passes the limit they are ``promoted_unconfirmed``.

    ``stream`` has (key, claim_id, owner, ts). State is one list of waiting
    claims for each key; it goes when its last claim is decided.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    limit = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def step(k: tuple, frames, state: GroupState):
        waiting = list(state.get[0]) if state.exists else []
        out = []
        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs()
            out = [(k[0], c.split("|")[0], "promoted_unconfirmed") for c in waiting if int(c.split("|")[1]) + limit <= now]
            waiting = [c for c in waiting if int(c.split("|")[1]) + limit > now]
        else:
            rows = pd.concat(list(frames)).sort_values([ts, "claim_id"])
            for cid, owner, at in zip(rows["claim_id"], rows["owner"], rows[ts]):
                at = int(at.timestamp() * 1000)
                if owner is None or pd.isna(owner):
                    waiting.append(f"{cid}|{at}")
                    continue
                met = [c for c in waiting if int(c.split("|")[1]) < at <= int(c.split("|")[1]) + limit]
                out += [(k[0], c.split("|")[0], "superseded") for c in met]
                waiting = [c for c in waiting if c not in met]
        if waiting:
            state.update((waiting,))
            state.setTimeoutTimestamp(max(min(int(c.split("|")[1]) for c in waiting) + limit, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "claim_id", "outcome"])

    s = stream.withWatermark(ts, delay)
    return s.groupBy(key).applyInPandasWithState(step, f"{key} string, claim_id string, outcome string", "waiting array<string>", "append", GroupStateTimeout.EventTimeTimeout)
