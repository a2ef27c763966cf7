"""Registered queries of stateful streams: the events table as a stream in disturbed order, with the SQL of the whole table.

Events arrive up to two hours after their time, file by file; a marker far ahead lets the watermark pass the last of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.registry import query
from skein.plans.runtime import new_path, table
from skein.streaming import events as streams
from skein.streaming import stateful

FILES, JITTER, LATE = 6, 7200, "3 hours"


def arriving(spark: SparkSession, d: str) -> DataFrame:
    """The events in order of arrival, as a stream of FILES micro-batches and a marker of user -1."""
    path = new_path(stateful.with_store(spark), "arriving")
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withColumn("_at", F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(JITTER * 1_000_000)))
    low, high = events.agg(F.min("_at"), F.max("_at")).first()
    part = F.when(F.lit(low is None), F.lit(0)).otherwise(F.least(F.lit(FILES - 1), F.floor((F.col("_at") - F.lit(low or 0)) * FILES / F.lit(max(1, (high or 0) - (low or 0))))))
    kept = events.withColumn("_part", part.cast("int"))
    for k in range(FILES):  # a stream reads files by the time they were written
        kept.where(F.col("_part") == k).drop("_at", "_part").coalesce(1).write.mode("append").parquet(path)
    marker = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.timestamp_seconds(F.lit((high or 0) / 1e6 + 400 * 86400)).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props"))
    marker.coalesce(1).write.mode("append").parquet(path)
    return streams.read_events(spark, path, 1)


def _run(out: DataFrame) -> DataFrame:
    return streams.run_to_table(out, new_path(out.sparkSession, "live"))


def _steps(key: str, first: str, then: str, columns: str, end: str) -> str:
    """SQL that goes through each key's events in order: first and then are the state's columns after the first event and the next ones (r: the state so far, e: the event)."""
    return f"""WITH RECURSIVE e AS (SELECT *, epoch_us(ts) AS at, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS no FROM events),
r AS (SELECT {', '.join('e.' + k.strip() for k in key.split(','))}, e.event_id, no, {first} FROM e WHERE no = 1
  UNION ALL SELECT {', '.join('e.' + k.strip() for k in key.split(','))}, e.event_id, e.no, {then} FROM r JOIN e ON e.no = r.no + 1 AND {' AND '.join(f'e.{k.strip()} IS NOT DISTINCT FROM r.{k.strip()}' for k in key.split(','))})
SELECT {columns} FROM r {end}"""


_SPAN = 10 * 86400 * 1_000_000


def _limit_sql(limit: int) -> str:
    kept = f"list_filter(r.{{k}}, lambda x: x > e.at - {_SPAN})"
    ok = f"len({kept}) < {limit}"
    a, b = ok.replace("{k}", "calls"), ok.replace("{k}", "all_calls")
    return _steps(
        "event_type, user_id", "list_value(e.at) AS calls, list_value(e.at) AS all_calls, true AS allowed, true AS allowed_of_all",
        f"CASE WHEN {a} THEN list_append({kept.replace('{k}', 'calls')}, e.at) ELSE {kept.replace('{k}', 'calls')} END, list_append({kept.replace('{k}', 'all_calls')}, e.at), {a}, {b}",
        "event_type AS path, user_id AS client, event_id, allowed, allowed_of_all", "",
    )


@query(_limit_sql(3))
def stream_limited(spark, d):
    """STR1, STR2: three calls of a path and client in ten days, with rejected calls left out and counted."""
    calls = arriving(spark, d).select(F.col("event_type").alias("path"), F.col("user_id").alias("client"), "event_id", "ts")
    return _run(stateful.limited_both(calls, 3, 10 * 86400, LATE))


_TTL = 20 * 3600 * 1_000_000
_KIND = "CASE e.event_type WHEN 'view' THEN 'begin' WHEN 'click' THEN 'beat' WHEN 'error' THEN 'end' ELSE '' END"
_OVER = f"(r.renewed IS NOT NULL AND e.at - r.renewed > {_TTL})"
_HELD = f"(r.renewed IS NOT NULL AND NOT {_OVER})"


@query(
    _steps(
        "user_id", f"CASE WHEN {_KIND} = 'begin' THEN e.at END AS began, CASE WHEN {_KIND} = 'begin' THEN e.at END AS renewed, CAST(NULL AS BIGINT) AS out_began, CAST(NULL AS BIGINT) AS out_ended, '' AS status",
        f"""CASE WHEN {_KIND} = 'end' THEN NULL WHEN {_HELD} THEN r.began WHEN {_KIND} = 'begin' THEN e.at END,
  CASE WHEN {_KIND} = 'end' THEN NULL WHEN {_KIND} = 'begin' OR {_KIND} = 'beat' AND {_HELD} THEN e.at WHEN {_HELD} THEN r.renewed END,
  CASE WHEN {_OVER} OR {_KIND} = 'end' AND {_HELD} THEN r.began END, CASE WHEN {_OVER} THEN r.renewed + {_TTL} WHEN {_KIND} = 'end' AND {_HELD} THEN e.at END,
  CASE WHEN {_OVER} THEN 'orphaned' WHEN {_KIND} = 'end' AND {_HELD} THEN 'done' ELSE '' END""",
        "user_id AS key, out_began AS began_us, out_ended AS ended_us, status",
        f"WHERE status <> '' UNION ALL SELECT user_id, began, renewed + {_TTL}, 'orphaned' FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY no DESC) = 1) WHERE renewed IS NOT NULL",
    )
)
def stream_leases(spark, d):
    """STR4, STR9: a view claims, clicks renew within twenty hours, an error closes; what is not renewed is lost, by a timer."""
    kind = F.when(F.col("event_type") == "view", "begin").when(F.col("event_type") == "click", "beat").when(F.col("event_type") == "error", "end").otherwise("")
    events = arriving(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", kind.alias("kind"))
    return _run(stateful.leases(events, 20 * 3600, late=LATE))


@query("SELECT user_id AS key, event_id, CAST(count(*) OVER w AS INT) AS held, max(value) OVER w AS highest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)")
def stream_recent(spark, d):
    """STR12: a ring of each user's last fifteen events."""
    return _run(stateful.recent(arriving(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", "value"), 15, LATE))


_AGE = 12 * 3600 * 1_000_000


@query(
    _steps(
        "props", "e.at AS stored, e.event_id AS source_id, false AS hit",
        f"CASE WHEN e.at - r.stored < {_AGE} THEN r.stored ELSE e.at END, CASE WHEN e.at - r.stored < {_AGE} THEN r.source_id ELSE e.event_id END, e.at - r.stored < {_AGE}",
        "props AS key, event_id, hit, source_id", "",
    )
)
def stream_cached(spark, d):
    """STR3: requests by their properties, each answer kept for twelve hours."""
    return _run(stateful.cached(arriving(spark, d).select(F.col("props").alias("key"), F.col("event_id").alias("id"), "ts"), 12 * 3600, LATE))
