"""What leaves the engine: tables, corpora, reports, the catalogue of questions; and the record of runs."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.functions.message import api_messages, api_threads, resequenced

RUN = "run_id string, stage string, status string, started_at double, ended_at double, items_in long, items_out long, notes string"


def export_tables(tables: dict[str, DataFrame], path: str, partition_by: str = "user_id", compression: str = "zstd") -> dict[str, int]:
    """Write each table below ``path``, by mailbox where it has one; returns the rows of each."""
    out = {}
    for name, df in tables.items():
        w = df.write.mode("overwrite").option("compression", compression)
        (w.partitionBy(partition_by) if partition_by in df.columns else w).parquet(f"{path}/{name}")
        out[name] = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}").count()
    return out


def emit_corpus(messages: DataFrame, path: str) -> None:
    """The corpus as compressed JSON lines: canonical messages by profile and time, API messages, API threads, and what is known for evaluation."""
    numbered = resequenced(messages)
    order = ["profile_id", "internal_date_ms", "id"]
    gz = lambda df, name: df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")
    gz(numbered.repartitionByRange(*order).sortWithinPartitions(*order), "canonical")
    gz(api_messages(numbered).drop("thread_position"), "api_messages")
    gz(api_threads(numbered), "api_threads")
    gz(numbered.select("id", "profile_id", "thread_id", "message_id_header", "meta.*"), "ground_truth")


def read_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gold, gold_messages, tags) of gold files, as the scoring operators take them.

    Each file is one mailbox: ``answers`` maps a question to its items and its
    ``must_not_include`` list. An item's messages are those it names and its anchor.
    """
    item = "struct<item_id:string,tier:string,claim:string,thread_id:string,anchor_message_id:string,message_ids:array<string>,evidence_quote:string,tricky_tags:array<string>,due_date:string,due_basis:string>"
    schema = f"profile_id string, as_of string, answers map<string,struct<question:string,ranked:array<string>,items:array<{item}>,must_not_include:array<struct<message_id:string,subject:string,trap:string>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("profile_id").alias("user_id"), F.explode("answers").alias("question", "a"))
    items = rows.select("user_id", "question", F.explode("a.items").alias("i"))
    ids = F.array_distinct(F.concat(F.coalesce("i.message_ids", F.array().cast("array<string>")), F.array_compact(F.array("i.anchor_message_id"))))
    traps = rows.select("user_id", "question", F.posexplode("a.must_not_include").alias("n", "t")).withColumn("gold_id", F.concat_ws("-", "user_id", "question", F.lit("trap"), "n"))
    gold = items.select("user_id", "question", F.col("i.item_id").alias("gold_id"), F.coalesce("i.tier", F.lit("must_include")).alias("tier")).unionByName(traps.select("user_id", "question", "gold_id", F.lit("must_not_include").alias("tier")))
    messages = items.select("user_id", "question", F.col("i.item_id").alias("gold_id"), F.explode(ids).alias("message_id")).unionByName(traps.select("user_id", "question", "gold_id", F.col("t.message_id").alias("message_id")))
    tags = items.select(F.col("i.item_id").alias("gold_id"), F.explode("i.tricky_tags").alias("tag"))
    return gold, messages, tags


def gold_violations(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, question, item_id, rule): broken rules of gold files: ids, tiers, due dates, ranking, evidence that is also a trap."""
    item = "struct<item_id:string,tier:string,anchor_message_id:string,message_ids:array<string>,due_date:string,due_basis:string>"
    schema = f"profile_id string, answers map<string,struct<ranked:array<string>,items:array<{item}>,must_not_include:array<struct<message_id:string>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("profile_id").alias("user_id"), F.explode("answers").alias("question", "a"))
    traps = F.transform("a.must_not_include", lambda t: t["message_id"])
    i = rows.select("user_id", "question", F.col("a.ranked").alias("ranked"), traps.alias("traps"), F.explode("a.items").alias("i")).select("*", "i.*")
    c = F.col
    prefix = F.concat("user_id", F.lit("-"), F.substring_index("question", "_", 1), F.lit("-"))
    ranked = F.array_contains("ranked", c("item_id"))
    rules = {
        "bad_item_id": ~c("item_id").rlike(r"^[a-z_]+-q[1-6]-\d{2}$"), "wrong_prefix": ~c("item_id").startswith(prefix), "unknown_tier": ~c("tier").isin("must_include", "acceptable", "borderline"), "anchor_not_cited": ~F.array_contains("message_ids", c("anchor_message_id")),
        "due_without_basis": c("due_date").isNotNull() & (c("due_basis") == "none"), "basis_without_due": c("due_basis").isin("explicit", "implicit") & c("due_date").isNull(), "borderline_ranked": (c("tier") == "borderline") & ranked, "not_ranked": (c("tier") != "borderline") & ~ranked,
        "evidence_is_trap": F.arrays_overlap("message_ids", "traps"),
    }
    one = i.select("user_id", "question", "item_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in rules.items()]))).alias("rule"))
    ids = F.transform("a.items", lambda x: x["item_id"])
    lists = rows.select("user_id", "question", F.explode(F.array_compact(F.array(
        F.when(F.size(F.array_distinct("a.ranked")) < F.size("a.ranked"), F.lit("ranked_twice")), F.when(F.size(F.array_except("a.ranked", ids)) > 0, F.lit("ranked_unknown")), F.when(F.size(F.array_distinct(ids)) < F.size(ids), F.lit("item_twice")),
    ))).alias("rule"))
    return one.unionByName(lists.select("user_id", "question", F.lit(None).cast("string").alias("item_id"), "rule"))


def markdown(df: DataFrame, title: str, rows: int = 200) -> str:
    """A small report table as Markdown; meant for aggregated frames, a larger one is an error."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"a report of more than {rows} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([f"# {title}", "", *head, *["| " + " | ".join(cell(v) for v in r) + " |" for r in got], ""])


def catalogue(questions: dict[str, str], queries: dict[str, Callable]) -> list[dict[str, str]]:
    """The questions with what they ask and the name of the query behind them; the scorer runs the same registry."""
    return [{"key": k, "label": v, "query": queries[k].__name__} for k, v in questions.items() if k in queries]


class Runs:
    """The record of stage runs, one row each, appended below the shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @contextmanager
    def record(self, stage: str) -> Iterator[dict]:
        """Counters of a stage; ``ok`` or ``failed`` is written when it ends, and an error is raised on."""
        stats: dict = {"items_in": 0, "items_out": 0, "notes": ""}
        began, status = time.time(), "ok"
        try:
            yield stats
        except BaseException as e:
            status, stats["notes"] = "failed", f"{type(e).__name__}: {e}"[:500]
            raise
        finally:
            row = (uuid.uuid4().hex, stage, status, began, time.time(), int(stats["items_in"]), int(stats["items_out"]), str(stats["notes"]))
            self.spark.createDataFrame([row], RUN).coalesce(1).write.mode("append").parquet(self.path)

    def last(self) -> DataFrame:
        """The latest run of each stage."""
        rows = self.spark.read.schema(RUN).parquet(self.path)
        return rows.groupBy("stage").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "stage"]), F.struct("started_at", "run_id")).alias("r")).select("stage", "r.*")

    def run(self, stages: dict[str, Callable[[dict], object]], only: list[str] | None = None) -> None:
        """Run stages in their order, all or some, each recorded; the first error stops the rest."""
        for name in only or stages:
            if name not in stages:
                raise ValueError(f"unknown stage {name}; there are {', '.join(stages)}")
        for name, stage in stages.items():
            if only is None or name in only:
                with self.record(name) as stats:
                    stage(stats)


class Budget:
    """A running total against a cap: work is taken in order until the cap is reached, and what was done is kept."""

    def __init__(self, cap: float):
        self.cap, self.spent, self.calls = cap, 0.0, {}

    def add(self, kind: str, cost: float) -> None:
        self.spent += cost
        self.calls[kind] = self.calls.get(kind, 0) + 1

    @property
    def over(self) -> bool:
        return self.spent >= self.cap
