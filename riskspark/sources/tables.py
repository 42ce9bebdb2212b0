"""The driver's test tables, and the accident-style table derived from ``events``.

The reference reads an accident CSV that is not shipped.  ``accident_frame``
derives a table of the same shape from ``events`` with deterministic missing
values and outliers, written once as Spark expressions and once as SQL text
(``ACCIDENT_SQL``) so the Spark side and the SQL oracle see the same rows.
Every row of ``events`` is kept; the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.roles import Roles
from riskspark.sources.readers import read_parquet

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed values of the derived accident table: the label is missing on every
# 23rd event, the measure on every 17th, and every 97th measure is an
# outlier (20 times its value).
LABEL_NULL_EVERY = 23
VALUE_NULL_EVERY = 17
OUTLIER_EVERY = 97
OUTLIER_FACTOR = 20

ACCIDENT_ROLES = Roles(id="id", label="sev", date="day", time="time")


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", columns)


def planted_accident_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accident table with a severity that follows the hour: minor before 8, major before 16,
    fatal after that (missing as often as before), so that a model's numbers are known."""
    hour = F.substring("time", 1, 2).cast("int")
    level = F.when(hour < 8, "minor").when(hour < 16, "major").otherwise("fatal")
    return accident_frame(spark, sf_dir).withColumn("sev", F.when(F.col("id") % LABEL_NULL_EVERY != 0, level))


def severe_accident_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accident table with a severity that is major before 16 (most rows), minor before 20, fatal after that, and
    missing for some of the major rows only: filled labels are what they were."""
    hour = F.substring("time", 1, 2).cast("int")
    level = F.when(hour < 16, F.when(F.col("id") % LABEL_NULL_EVERY != 0, "major")).when(hour < 20, "minor").otherwise("fatal")
    return accident_frame(spark, sf_dir).withColumn("sev", level)


def accident_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id bigint, sev string, day string, time string, user_id bigint, v double."""
    ev = table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    eid = F.col("event_id")
    return ev.select(
        eid.alias("id"),
        F.when(eid % LABEL_NULL_EVERY != 0, F.col("event_type")).alias("sev"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.date_format("ts", "HH:mm:ss").alias("time"),
        F.col("user_id"),
        F.when(eid % VALUE_NULL_EVERY == 0, F.lit(None).cast("double"))
         .when(eid % OUTLIER_EVERY == 0, F.col("value") * OUTLIER_FACTOR)
         .otherwise(F.col("value")).alias("v"),
    )


ACCIDENT_SQL = f"""
accident AS (
  SELECT event_id AS id,
         CASE WHEN event_id % {LABEL_NULL_EVERY} <> 0 THEN event_type END AS sev,
         strftime(ts, '%Y-%m-%d') AS day,
         strftime(ts, '%H:%M:%S') AS time,
         user_id,
         CASE WHEN event_id % {VALUE_NULL_EVERY} = 0 THEN NULL
              WHEN event_id % {OUTLIER_EVERY} = 0 THEN value * {OUTLIER_FACTOR}
              ELSE value END AS v
  FROM events
)"""

PLANTED_ACCIDENT_SQL = f"""{ACCIDENT_SQL},
planted AS (
  SELECT * REPLACE (CASE WHEN id % {LABEL_NULL_EVERY} <> 0
                         THEN CASE WHEN CAST(substr(time, 1, 2) AS INTEGER) < 8 THEN 'minor'
                                   WHEN CAST(substr(time, 1, 2) AS INTEGER) < 16 THEN 'major' ELSE 'fatal' END END AS sev)
  FROM accident)"""

SEVERE_ACCIDENT_SQL = f"""{ACCIDENT_SQL},
severe AS (
  SELECT * REPLACE (CASE WHEN CAST(substr(time, 1, 2) AS INTEGER) < 16 THEN CASE WHEN id % {LABEL_NULL_EVERY} <> 0 THEN 'major' END
                         WHEN CAST(substr(time, 1, 2) AS INTEGER) < 20 THEN 'minor' ELSE 'fatal' END AS sev)
  FROM accident)"""
