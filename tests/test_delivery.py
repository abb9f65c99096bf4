from pyspark.sql import functions as F

from quillfold.operators.delivery import kept_deliveries, surplus_deliveries, unique_emails

SCHEMA = "id string, account_id string, provider_message_id string, ingested_at timestamp, batch_id int, message string, account string"


def test_one_copy_stays(spark):
    rows = [
        ("b", "acc", "M1", "2026-01-02", 1), ("a", "acc", "m1 ", "2026-01-01", 2), ("c", "acc", "\tm1", "2026-01-01", 3),  # tie: a before c
        ("d", "other", "m1", "2026-01-03", 1), ("e", None, "m1", "2026-01-01", 1), ("f", None, "m1", "2026-01-01", 1), ("g", "acc", None, None, 1),
        ("h", "acc", "m2", None, 1), ("i", "acc", "m2", "2026-05-01", 1),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "id string, account_id string, provider_message_id string, t string, batch_id int, message string, account string").withColumn("ingested_at", F.col("t").cast("timestamp"))
    assert {r[0] for r in surplus_deliveries(df).collect()} == {"b", "c", "h"}
    assert {r[0] for r in kept_deliveries(df).collect()} == {"a", "d", "e", "f", "g", "i"}
    assert unique_emails(df).count() == 6 and "account" in unique_emails(df).columns


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert surplus_deliveries(df).count() == 0 and kept_deliveries(df).count() == 0


def test_hot_message(spark):
    df = spark.range(20_000).select(F.format_string("%06d", "id").alias("id"), F.lit("a").alias("account_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("provider_message_id"), F.lit(None).cast("timestamp").alias("ingested_at"))
    assert surplus_deliveries(df).count() == 6666
