"""Event-time queries; the same functions run on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import roles
from ..streaming import limits, windows
from .base import query


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2 over tumbling windows."""
    found = windows.rates(_events(spark, sf_dir), ["event_type"], length="1 hour")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT user_id, ts, unnest(range(0, 6)) AS k FROM events), w AS (SELECT user_id, time_bucket(INTERVAL '10 minutes', ts) - to_minutes(10 * k) AS start FROM e)
SELECT start, user_id, COUNT(*) AS n FROM w GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def rate_limit_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 over sliding windows."""
    found = windows.over_limit(_events(spark, sf_dir), ["user_id"], 1, length="60 minutes", step="10 minutes")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.timed(roles.table(spark, sf_dir, "events"))


#: Twelve hours in microseconds, as requests of a user are hours apart.
LENGTH = 12 * 3_600_000_000


@query(f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, CASE WHEN user_id % 7 <> 0 THEN user_id % 4 END AS allowed, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts IS NOT NULL AND event_id IS NOT NULL),
run(user_id, n, event_id, recent, admitted) AS (
 SELECT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]), false FROM (SELECT DISTINCT user_id FROM e) UNION ALL
 SELECT user_id, n, event_id, CASE WHEN good THEN list_append(kept, t) ELSE kept END, good FROM (
  SELECT e.user_id, e.n, e.event_id, e.t, list_filter(recent, lambda x: x > e.t - {LENGTH}) AS kept, COALESCE(allowed, 0) = 0 OR len(list_filter(recent, lambda x: x > e.t - {LENGTH})) < allowed AS good FROM run JOIN e ON e.user_id IS NOT DISTINCT FROM run.user_id AND e.n = run.n + 1))
SELECT user_id, event_id, admitted FROM run WHERE n > 0""")
def request_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: which events are admitted, by a limit for each user; some have none."""
    allowed = F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 4).alias("allowed")
    events = roles.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", allowed)
    return limits.limited(events, ["user_id"], id="event_id", length=LENGTH).select("user_id", "event_id", "admitted")
