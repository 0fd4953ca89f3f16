"""Splits by time and by hash."""

from pyspark.sql import functions as F

from tabwise.operators import splits as ops
from tabwise.plans.specs import DatasetSpec, SplitSpec
from tabwise.queries.registry import register, table

SHARES = (0.70, 0.15, 0.15)  # train, evaluation, validate


def split_sql(source: str, key: str, order: str, names=("train", "validate", "evaluation")) -> str:
    a, b, c = names
    return f"""SELECT *, CASE WHEN i <= floor(n * 0.7::DOUBLE) THEN '{a}'
                          WHEN i <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN '{b}' ELSE '{c}' END AS split
        FROM (SELECT *, row_number() OVER (ORDER BY {order}substr(md5({key} || '|#42'), 1, 15)) AS i,
                     count(*) OVER () AS n FROM {source})"""


@register("split_chronological", f"SELECT o_orderkey, o_orderdate, split FROM ({split_sql('orders', 'o_orderkey', 'o_orderdate, ')})")
def split_chronological(spark, folder):
    """Many orders share a date; ties break by the hash of the order key."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return ops.assign_split(orders, "o_orderkey", "o_orderdate", SHARES)


@register("split_random", f"SELECT o_orderkey, split FROM ({split_sql('orders', 'o_orderkey', '')})")
def split_random(spark, folder):
    return ops.assign_split(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", None, SHARES)


@register("split_summary", f"""
    WITH s AS ({split_sql('events', 'event_id', 'ts, ')})
    SELECT split, count(*) AS row_count, round(count(*) / any_value(n), 4) AS pct FROM s GROUP BY 1""")
def split_summary(spark, folder):
    spec = DatasetSpec("events", "Events", "user_id", "ts", split=SplitSpec())
    return ops.split_summary(ops.split_dataset(table(spark, folder, "events"), spec, ties=["event_id"]))


@register("split_periods", f"""
    WITH s AS ({split_sql('events', 'event_id', 'ts, ', ('train', 'validation', 'test'))})
    SELECT split, min(ts) AS period_start, max(ts) AS period_end FROM s GROUP BY 1""")
def split_periods(spark, folder):
    divided = ops.chronological_split(table(spark, folder, "events"), "user_id", "ts", SplitSpec(), ties=["event_id"])
    return ops.split_periods(divided, "ts")


@register("split_carve_validation", f"""
    WITH s AS ({split_sql('events', 'event_id', 'ts, ')}),
    t AS (SELECT event_id, row_number() OVER (ORDER BY ts, substr(md5(event_id || '|#42'), 1, 15)) AS j,
                 count(*) OVER () AS m FROM s WHERE split = 'train')
    SELECT CASE WHEN j <= floor(m * (0.7::DOUBLE / (0.7::DOUBLE + 0.15::DOUBLE))) THEN 'train' ELSE 'validation' END
           AS split, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM t GROUP BY 1""")
def split_carve_validation(spark, folder):
    """Validation carved out of the train partition, shares renormalised."""
    divided = ops.assign_split(table(spark, folder, "events"), "user_id", "ts", SHARES, ties=["event_id"])
    train = divided.where(F.col("split") == "train").drop("split")
    carved = ops.carve_validation(train, "user_id", "ts", SplitSpec(), ties=["event_id"])
    return carved.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
