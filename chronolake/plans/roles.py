"""The driver's tables in the roles of a medical-record data set, for queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations: one per user, time zero at the midnight before the first event."""
    per = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("person_id")).agg(F.min("ts").alias("_first"))
    start = F.col("_first").cast("date").cast("timestamp_ntz")
    return per.select(F.col("person_id").alias("obs_id"), "person_id", start.alias("start_date"), (start + F.expr("INTERVAL '30' DAY")).alias("end_date"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point events; every seventh value is missing and values are small integers."""
    value = F.when(F.col("event_id") % 7 == 0, None).otherwise(F.floor("value").cast("double") % 5)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("person_id"), F.col("event_type").alias("concept"), F.col("ts").cast("timestamp_ntz").alias("at"),
        value.alias("value"), F.col("ts").alias("exact"), "event_id",
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span events; some ends are missing and some lie before the start."""
    hours = (F.col("event_id") * 7 % 120 - 20).cast("int")
    until = F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("at") + F.make_dt_interval(hours=hours))
    return measurements(spark, sf_dir).withColumn("until", until)


#: The same roles in SQL.
SQL_ROLES = """
users AS (SELECT user_id AS obs_id, user_id AS person_id, CAST(CAST(min(ts) AS DATE) AS TIMESTAMP) AS start_date FROM events GROUP BY user_id),
measurements AS (
  SELECT user_id AS person_id, event_type AS concept, ts, event_id,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(value) AS DOUBLE) % 5 END AS value
  FROM events),
spans AS (
  SELECT *, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts + to_hours(CAST(event_id * 7 % 120 - 20 AS INTEGER)) END AS until
  FROM measurements),
concepts AS (SELECT DISTINCT concept FROM measurements)"""


def sql_bins(count: int, step: str) -> str:
    """SQL of all bins of all users."""
    return f"""bins AS (
  SELECT u.obs_id, u.person_id, c.concept, CAST(s.i AS INTEGER) AS interval_step,
         u.start_date + s.i * INTERVAL '{step}' AS a, u.start_date + (s.i + 1) * INTERVAL '{step}' AS b
  FROM users u, concepts c, (SELECT unnest(range({count})) AS i) s)"""
