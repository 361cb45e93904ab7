"""Pacing, adaptation and retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import limits as L
from . import tables as t


def pace_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of 1 to 5 items, paced for each event type."""
    calls = t.table(spark, sf_dir, "events").select("event_id", "event_type", (t.micros(F.col("ts")) / 1e6).alias("arrival"), (F.col("event_id") % 5 + 1).alias("n"))
    paced = L.pace(calls, 0.02, by=("event_type",), order=("arrival", "event_id"))
    return paced.select("event_id", F.round("emit", 3).alias("emit"))


def adaptive_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch size after each call of a user, an error being a limited call."""
    calls = t.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("hit"))
    states = L.adapt(calls, by=("user_id",), order=("ts", "event_id"))
    return states.select("event_id", *[F.col(c).cast("long").alias(c) for c in ("batch", "failures", "successes")])


def retry_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 7).alias("attempt"), F.round(F.col("value"), 2).alias("least"))
    return rows.select("event_id", L.backoff(F.col("attempt"), F.coalesce("least", F.lit(0.0)), jitter=F.lit(1.0)).alias("delay"))


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 90).cast("string")).when(F.col("event_id") % 4 == 1, "Wed, 21 Oct 2015 07:28:00 GMT").when(F.col("event_id") % 4 == 2, "soon").otherwise("1.5")
    return t.table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("Content-Type"), F.lit("json"), F.lit("Retry-After"), value, F.lit("X-RateLimit-Left"), F.lit("0"), F.lit("X-Goog-Id"), F.col("event_id").cast("string")).alias("h"))


def retry_after_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At 07:27:30 of the day in the header."""
    return _headers(spark, sf_dir).select("event_id", L.retry_after(F.col("h"), F.lit(1445412450)).alias("seconds"))


def headers_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_sort(F.map_keys(L.limit_headers(F.col("h"))))
    return _headers(spark, sf_dir).select("event_id", F.array_join(names, ",").alias("names"))


def classify_429(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat(F.lit("call "), F.col("event_id").cast("string"), F.when(F.col("event_type") == "error", " RESOURCE_EXHAUSTED").otherwise(""))
    rows = t.table(spark, sf_dir, "events").select("event_id", message.alias("m"), "props")
    return rows.select("event_id", L.retryable(F.col("m")).alias("retryable"), L.short_error(F.concat("m", F.lit(" "), F.repeat("m", F.lit(40))), 300).alias("error"))


def ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and errors of a run in which error events are failed files."""
    rows = t.table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    return rows.groupBy("user_id").agg(F.sum((~failed).cast("long")).alias("chunks"), F.sum(failed.cast("long")).alias("errors"), F.count_if(~failed).alias("done"))


QUERIES = {f.__name__: f for f in (pace_schedule, adaptive_batch, retry_delay, retry_after_parse, headers_filter, classify_429, ingest_totals)}
SQL = {
    "pace_schedule": """
WITH RECURSIVE c AS (SELECT event_id, event_type, epoch_us(ts) / 1e6 AS arrival, (event_id % 5 + 1) * 60.0 / CAST(0.02 AS DOUBLE) AS cost,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT event_type, i, event_id, greatest(arrival, cost) AS emit FROM c WHERE i = 1
  UNION ALL SELECT c.event_type, c.i, c.event_id, greatest(c.arrival, r.emit + c.cost) FROM r JOIN c ON c.event_type = r.event_type AND c.i = r.i + 1)
SELECT event_id, round(emit, 3) AS emit FROM r""",
    "adaptive_batch": """
WITH RECURSIVE c AS (SELECT user_id, event_id, event_type = 'error' AS hit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(100 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS failures, CAST(0 AS BIGINT) AS successes FROM c WHERE i = 1
  UNION ALL SELECT c.user_id, c.i, c.event_id,
    CASE WHEN hit THEN greatest(10, r.batch // 2) WHEN r.successes + 1 >= 5 THEN 100 ELSE r.batch END,
    CASE WHEN hit THEN r.failures + 1 WHEN r.successes + 1 >= 5 THEN 0 ELSE r.failures END,
    CASE WHEN hit OR r.successes + 1 >= 5 THEN 0 ELSE r.successes + 1 END
  FROM r JOIN c ON c.user_id = r.user_id AND c.i = r.i + 1)
SELECT event_id, batch, failures, successes FROM r WHERE event_id IS NOT NULL""",
    "retry_delay": "SELECT event_id, greatest(least(CAST(5 AS DOUBLE) * power(2.0, event_id % 7), 120.0), coalesce(round(value, 2), 0.0)) AS delay FROM events",
    "retry_after_parse": """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id % 90 AS DOUBLE) WHEN 1 THEN CAST(30 AS DOUBLE) WHEN 2 THEN NULL ELSE CAST(1.5 AS DOUBLE) END AS seconds FROM events""",
    "headers_filter": "SELECT event_id, 'Retry-After,X-Goog-Id,X-RateLimit-Left' AS names FROM events",
    "classify_429": """
WITH m AS (SELECT event_id, event_type, 'call ' || event_id || CASE WHEN event_type = 'error' THEN ' RESOURCE_EXHAUSTED' ELSE '' END AS m FROM events)
SELECT event_id, event_type = 'error' OR contains(CAST(event_id AS VARCHAR), '429') AS retryable, left(m || ' ' || repeat(m, 40), 300) AS error FROM m""",
    "ingest_totals": """
SELECT user_id, count(*) FILTER (event_type <> 'error') AS chunks, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type <> 'error') AS done FROM events GROUP BY user_id""",
}
