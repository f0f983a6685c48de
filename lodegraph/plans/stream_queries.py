"""The streaming operators run as batch over the events, so that they can be compared with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.session import table
from lodegraph.streaming import windows as W


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return W.tumbling_counts(_events(spark, d)).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("value", 3).alias("value"))


def event_sliding(spark: SparkSession, d: str) -> DataFrame:
    return W.sliding_budget(_events(spark, d), "1 hour", "30 minutes").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", F.round("spent", 3).alias("spent"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return W.sessions(_events(spark, d)).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "user_id", "n")


QUERIES = {f.__name__: f for f in (event_windows, event_sliding, event_sessions)}

ORACLES = {
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 3) AS value FROM events GROUP BY 1, 2",
    "event_sliding": "SELECT strftime(to_timestamp(s * 1800) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS start, user_id, round(sum(value), 3) AS spent FROM (SELECT user_id, value, unnest([floor(epoch(ts) / 1800)::BIGINT - 1, floor(epoch(ts) / 1800)::BIGINT]) AS s FROM events) GROUP BY 1, 2",
    "event_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS g FROM a)
 SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, user_id, count(*) AS n FROM b GROUP BY user_id, g""",
}
