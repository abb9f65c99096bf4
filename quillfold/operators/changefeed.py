"""Applying a feed of inserts, updates and deletes: a log-structured merge.

Changes are appended as sorted runs. A run holds at most two rows per key, the
states that any later merge needs:

* ``edge``  - the last insert or delete of the key in the run (a delete is the
  tombstone),
* ``tail``  - the last change of any kind.

Both are maxima over a total order (instant, step, id), so runs merge
associatively: a repeated change is a no-op, a late one falls into its place,
and a hot key shrinks to two rows before it is shuffled. After merging, a key
is live iff its edge is an insert; its value is then that of its tail, since
after the last insert only updates can follow. Updates that come before any
insert, or after a delete, never win.

Runs are partitions of one table that is bucketed and sorted by key. A merge
reads, for each bucket, the sorted files of all runs in one task: no shuffle,
only a merge of sorted pieces. Size-tiered compaction replaces the oldest runs
by one when there are too many. A manifest, one numbered file for each version,
says which runs count; a new version is committed by creating its file, so a
failed append or compaction leaves the old version as it was. Tombstones stay
through compaction unless the caller says that no older change can arrive any
more (``drop_tombstones=True``).
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfold.session import shared_path

#: Spellings of the three operations.
INSERT_OPS = ("insert", "ins", "i", "create", "c")
UPDATE_OPS = ("update", "upd", "u")
DELETE_OPS = ("delete", "del", "d", "remove")


def op_kind(op: Column) -> Column:
    """'I', 'U' or 'D' for any spelling; null for anything else."""
    o = F.lower(F.trim(op))
    return F.when(o.isin(*INSERT_OPS), "I").when(o.isin(*UPDATE_OPS), "U").when(o.isin(*DELETE_OPS), "D")


def clean_key(c: Column) -> Column:
    """Lower case without outer blanks."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def instant(c: Column) -> Column:
    """ISO-8601 text with any offset as an instant; null where it is no time."""
    return F.try_to_timestamp(F.regexp_replace(c, r"^\s+|\s+$", ""))


def change_states(feed: DataFrame, keys: list[str], order: list[str], kind: str, value: str) -> DataFrame:
    """Per key the ``edge`` and ``tail`` of a feed (one hash aggregation, partial on the map side)."""
    pos = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(kind).alias("kind"), F.col(value).alias("value"))
    return feed.groupBy(*keys).agg(F.max(F.when(F.col(kind) != "U", pos)).alias("edge"), F.max(pos).alias("tail"))


def merge_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """Merge the states of any number of runs."""
    return states.groupBy(*keys).agg(F.max("edge").alias("edge"), F.max("tail").alias("tail"))


def live(states: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The keys that hold a value, and the value."""
    return states.filter(F.col("edge.kind") == "I").select(*keys, F.col("tail.value").alias(value))


class _Manifest:
    """Numbered versions of a list of runs, below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.folder = self.jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
        self.fs = self.folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def last(self) -> tuple[int, dict | None]:
        """The newest version's number and content; 0 and None before the first."""
        if not self.fs.exists(self.folder):
            return 0, None
        names = [x.getPath().getName() for x in self.fs.listStatus(self.folder)]
        number = max((int(n[1:7]) for n in names if re.fullmatch(r"v\d{6}", n)), default=0)
        if not number:
            return 0, None
        file = self.fs.open(self.jvm.org.apache.hadoop.fs.Path(self.folder, f"v{number:06d}"))
        try:
            return number, json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def commit(self, number: int, content: dict) -> None:
        """Create version ``number``; an error if another writer was first."""
        part = self.jvm.org.apache.hadoop.fs.Path(self.folder, f"part-{uuid.uuid4().hex}")
        out = self.fs.create(part, False)
        out.write(json.dumps(content).encode())
        out.close()
        if self.fs.exists(self.jvm.org.apache.hadoop.fs.Path(self.folder, f"v{number:06d}")) or not self.fs.rename(part, self.jvm.org.apache.hadoop.fs.Path(self.folder, f"v{number:06d}")):
            self.fs.delete(part, False)
            raise RuntimeError(f"version {number} was committed by another writer")

    def drop(self, path: str) -> None:
        self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(path), True)


class ChangeLog:
    """Sorted runs below one folder, merged on read and compacted by tiers.

    ``buckets`` is fixed when the log is made: the session's number of shuffle
    partitions unless given. A log is opened again by its path.
    """

    def __init__(self, spark: SparkSession, keys: list[str], order: list[str], kind: str, value: str, path: str | None = None, buckets: int | None = None, fan: int = 4):
        self.spark, self.keys, self.order, self.kind, self.value, self.fan = spark, keys, order, kind, value, fan
        self.path = path or shared_path(spark, "changelog")
        self.table = "changelog_" + re.sub(r"\W", "_", self.path.rsplit("/", 1)[-1])
        self.manifest = _Manifest(spark, self.path)
        self.version, content = self.manifest.last()
        content = content or {"runs": [], "batches": [], "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "schema": None}
        self.runs: list[str] = content["runs"]
        self.batches: list[int] = content["batches"]
        self.buckets: int = content["buckets"]
        self.schema = T.StructType.fromJson(content["schema"]) if content["schema"] else None
        if self.schema is not None and not spark.catalog.tableExists(self.table):
            keys_sql = ", ".join(f"`{k}`" for k in keys)
            spark.sql(f"CREATE TABLE `{self.table}` ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in self.schema)}, `_run` STRING) USING parquet OPTIONS (path '{self.path}/runs') PARTITIONED BY (`_run`) CLUSTERED BY ({keys_sql}) SORTED BY ({keys_sql}) INTO {self.buckets} BUCKETS")
            spark.catalog.recoverPartitions(self.table)

    def _commit(self, runs: list[str], batch: int | None = None) -> None:
        batches = [*self.batches, *([] if batch is None else [batch])]
        self.manifest.commit(self.version + 1, {"runs": runs, "batches": batches, "buckets": self.buckets, "schema": self.schema.jsonValue()})
        self.version, self.runs, self.batches = self.version + 1, runs, batches

    def _write(self, states: DataFrame) -> None:
        """Add runs; ``states`` is spread by key over as many partitions as there are buckets, so a run has one sorted file a bucket."""
        states.write.mode("append").format("parquet").option("path", f"{self.path}/runs").partitionBy("_run").bucketBy(self.buckets, *self.keys).sortBy(*self.keys).saveAsTable(self.table)

    def append(self, feed: DataFrame, run: str | None = None, batch: int | None = None) -> list[str]:
        """Write one run, or, with a column ``run``, one run for each of its values, in a single job.

        ``batch`` numbers a micro-batch: one that was committed before is left
        alone, so a replayed batch costs nothing.
        """
        if batch is not None and batch in self.batches:
            return []
        tag = uuid.uuid4().hex[:8]
        name = F.concat(F.lit(f"r{tag}-"), F.col(run).cast("string")) if run else F.lit(f"r{tag}")
        states = change_states(feed.withColumn("_run", name), ["_run", *self.keys], self.order, self.kind, self.value).select(*self.keys, "edge", "tail", "_run")
        self.schema = states.drop("_run").schema
        self._write(states.repartition(self.buckets, *self.keys))
        found = [r._run for r in self.spark.table(self.table).filter(F.col("_run").startswith(f"r{tag}")).select("_run").distinct().orderBy("_run").collect()]
        self._commit([*self.runs, *found], batch)
        while len(self.runs) > self.fan:
            self.compact(self.runs[: self.fan])
        return found

    def _merged(self, runs: list[str]) -> DataFrame:
        rows = self.spark.table(self.table).filter(F.col("_run").isin(*runs)).select(*self.keys, "edge", "tail")
        return merge_states(rows, self.keys)

    def states(self) -> DataFrame:
        """All runs merged: one row per key, tombstones included. Read by bucket, without a shuffle."""
        if self.schema is None:
            raise ValueError("no run was appended")
        return self._merged(self.runs)

    def read(self) -> DataFrame:
        """The live keys with the value's column."""
        return live(self.states(), self.keys, self.value)

    def compact(self, runs: list[str] | None = None, drop_tombstones: bool = False) -> str:
        """Replace ``runs`` (the oldest ones; all if none are named) by one. Their files stay for running readers until :meth:`vacuum`."""
        old = runs or self.runs
        if drop_tombstones and len(old) < len(self.runs):
            raise ValueError("tombstones can only be dropped when all runs are merged")
        merged = self._merged(old)
        if drop_tombstones:
            merged = merged.filter(F.col("edge.kind") == "I")
        target = f"c{uuid.uuid4().hex[:8]}"
        self._write(merged.withColumn("_run", F.lit(target)))
        # With nothing left to keep the new run has no files, which reads as an empty one.
        self._commit([target, *[r for r in self.runs if r not in old]])
        return target

    def vacuum(self) -> int:
        """Drop the files of runs that no longer count; only when no reader of an older version is left."""
        gone = [r._run for r in self.spark.table(self.table).filter(~F.col("_run").isin(*self.runs)).select("_run").distinct().collect()]
        for r in gone:
            self.spark.sql(f"ALTER TABLE `{self.table}` DROP IF EXISTS PARTITION (`_run`='{r}')")
            self.manifest.drop(f"{self.path}/runs/_run={r}")
        return len(gone)


def evidence_changes(evidence: DataFrame) -> DataFrame:
    """Typed changes of the claim ledger.

    Rows without a work item are left out, as are rows without attribute,
    change id or a readable instant, and rows whose ``op`` is none of the three
    operations. A null ``step_no`` counts as 0. Extra columns are ignored.
    """
    return (
        evidence.select(
            clean_key(F.col("work_item_id")).alias("work_item_id"),
            clean_key(F.col("attribute")).alias("attribute"),
            instant(F.col("observed_at")).alias("at"),
            F.coalesce(F.col("step_no"), F.lit(0)).alias("step"),
            F.col("id").alias("evidence_id"),
            op_kind(F.col("op")).alias("kind"),
            F.date_format(F.coalesce("arrived_at", F.lit("1970-01-01").cast("timestamp")), "yyyy-MM").alias("run"),
        )
        .filter("work_item_id is not null and attribute is not null and at is not null and evidence_id is not null and kind is not null")
    )


def current_claims(evidence: DataFrame) -> DataFrame:
    """(work_item_id, attribute, evidence_id): the claims live after all changes.

    The feed is appended as one run per month of arrival, compacted by tiers and
    merged on read, bucket by bucket. Equal instants and steps of different changes order by id. An empty feed
    gives an empty table.
    """
    log = ChangeLog(evidence.sparkSession, ["work_item_id", "attribute"], ["at", "step", "evidence_id"], "kind", "evidence_id")
    log.append(evidence_changes(evidence), run="run")
    return log.read()
