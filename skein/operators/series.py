"""Event series: sliding limits, drift, distributions, moving averages, runs of failures, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators.quantiles import with_percentiles


def sliding_limit(events: DataFrame, key: str, seconds: int = 60, limit: int = 5, stretch: int = 20) -> DataFrame:
    """STR1/STR2: events of the key in the window that ends with each event, itself included, and whether that is within the limit.

    A key's events are dealt over stretches of so many windows, so a key with very many events is no single task; the last
    window of a stretch is copied to the next one, to be counted there.
    """
    span = seconds * 1_000_000
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    own = F.floor(t / (span * stretch))
    last = t >= (own + 1) * (span * stretch) - span
    rows = events.withColumn("_t", t).withColumn("_s", F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("_own", F.col("_s") == own)
    w = W.partitionBy(key, "_s").orderBy("_t").rangeBetween(-span, 0)
    counted = rows.withColumn("in_window", F.count("*").over(w)).where("_own").drop("_t", "_s", "_own")
    return counted.withColumn("allowed", F.col("in_window") <= limit)


def daily(events: DataFrame, by: str) -> DataFrame:
    """AGG14: events, distinct users, total and 95th percentile of value by day and kind."""
    dated = events.withColumn("day", F.date_trunc("day", "ts").cast("date").cast("string"))
    out = dated.groupBy("day", by).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"))
    return with_percentiles(out, dated, ["day", by], "value", {"p95": 0.95}).withColumn("p95", F.round("p95", 4))


def drift(points: DataFrame, days: int = 7, threshold: float = 0.1) -> DataFrame:
    """AGG11/WIN13: each point (metric, day as a number, value) against the mean of the days before it; drifted if it falls by more than the threshold."""
    w = W.partitionBy("metric").orderBy("day").rangeBetween(-days, -1)
    out = points.withColumn("baseline", F.round(F.avg("value").over(w), 6))
    return out.withColumn("delta", F.round(F.col("value") - F.col("baseline"), 6)).withColumn("drifted", F.coalesce(F.col("delta") < -threshold, F.lit(False)))


def distribution(events: DataFrame, by: str, last: int = 10_000) -> DataFrame:
    """AGG13: mean, smallest, largest and percentiles picked by index of the last values of each kind."""
    w = W.partitionBy(by).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    kept = events.where("value is not null").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    a = F.col("v")
    out = kept.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.sort_array(F.collect_list("value")).alias("v"))
    pick = lambda q: F.round(F.element_at(a, F.least(F.floor(F.size(a) * q), F.size(a) - 1).cast("int") + 1), 4)
    return out.select(by, "n", "mean", F.round(F.element_at(a, 1), 4).alias("min"), F.round(F.element_at(a, -1), 4).alias("max"), pick(F.lit(0.5)).alias("p50"), pick(F.lit(0.95)).alias("p95"), pick(F.lit(0.99)).alias("p99"))


def _stretch(seconds: int):
    """The number of the stretch of time that an event is in: keys are dealt over (key, stretch), so a key with a third of all events is no single task."""
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000))


def moving_average(events: DataFrame, key: str, alpha: float = 0.3, stretch: int = 86_400) -> DataFrame:
    """AGG17/WIN14: the exponential moving average of value after each key's last event.

    A stretch of events is an affine map of the average before it: n events scale it by (1 - alpha)^n and add their own
    weighted values. The maps of a key's stretches are combined by a window of one row a stretch. The first value of all
    counts whole, so it is added once more with the weight that is missing.
    """
    keep = 1 - alpha
    rows = events.where("value is not null").select(key, "value", "ts", "event_id", _stretch(stretch).alias("_s"))
    back = W.partitionBy(key, "_s").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    own = rows.withColumn("_r", F.row_number().over(back)).groupBy(key, "_s").agg(
        F.count("*").alias("n"), F.sum(alpha * F.pow(F.lit(keep), F.col("_r") - 1) * F.col("value")).alias("added"), F.min_by("value", F.struct("ts", "event_id")).alias("first")
    )
    later = W.partitionBy(key).orderBy(F.col("_s").desc()).rowsBetween(W.unboundedPreceding, -1)
    maps = own.withColumn("after", F.coalesce(F.sum("n").over(later), F.lit(0)))
    whole = maps.groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.pow(F.lit(keep), F.col("after")) * F.col("added")).alias("sum"), F.min_by("first", "_s").alias("first"))
    return whole.select(key, "n", F.round(F.col("sum") + F.pow(F.lit(keep), F.col("n")) * F.col("first"), 6).alias("ema"))


def failure_runs(events: DataFrame, key: str, failed, stretch: int = 86_400) -> DataFrame:
    """WIN15: runs of failures in a row; cooldown 10 * 2^(n - 1) seconds, at most 60.

    Runs are found by gaps and islands inside stretches of time. Those that touch an end of their stretch are joined to the
    ones of the key's next stretch by a window of two rows a stretch at most: a run goes on where one stretch ends with
    failures and the next begins with them.
    """
    rows = events.select(key, "ts", "event_id", failed.alias("_f"), _stretch(stretch).alias("_s"))
    inside = W.partitionBy(key, "_s").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    marked = rows.withColumn("_i", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(inside))
    islands = marked.groupBy(key, "_s", "_i").agg(F.count_if("_f").alias("length"), F.min(F.when(F.col("_f"), F.col("event_id"))).alias("first_event"))
    last = F.max("_i").over(W.partitionBy(key, "_s"))
    ends = islands.withColumn("opens", F.col("_i") == 0).withColumn("closes", F.col("_i") == last)
    # a stretch without failures at an end leaves a row of length 0 there, which parts the runs beside it
    whole = ends.where("length > 0 and not opens and not closes").select(key, "first_event", "length")
    edge = ends.where("opens or closes")
    by = W.partitionBy(key).orderBy("_s", "_i")
    before = lambda c: F.lag(c).over(by)
    goes_on = F.col("opens") & (F.col("length") > 0) & (before("_s") != F.col("_s")) & before("closes") & (before("length") > 0)
    runs = edge.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    joined = runs.where("length > 0").groupBy(key, "_run").agg(F.sum("length").alias("length"), F.min("first_event").alias("first_event"))
    out = whole.unionByName(joined.select(key, "first_event", "length"))
    return out.select(key, "first_event", "length", F.least(F.lit(60.0), 10 * F.pow(F.lit(2.0), F.least(F.col("length"), F.lit(10)) - 1)).alias("cooldown"))


def progress(events: DataFrame, key: str, last: int = 15) -> DataFrame:
    """AGG30/STR12: totals of a key, its newest event, and the ids of its last events, oldest first; tasks send on so many events a key."""
    totals = events.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))
    newest = events.select(key, "ts", "event_id").withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.col("ts").desc(), F.col("event_id").desc()))).where(F.col("_r") <= last)
    recent = newest.groupBy(F.col(key).alias("_k")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id"))), lambda s: s["event_id"].cast("string")), ",").alias("recent"))
    return totals.join(recent, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")


def sessions(events: DataFrame, key: str, gap_seconds: int = 1800) -> DataFrame:
    """STR10: sessions of a key that end when no event comes for the gap; start, end and number of events."""
    return events.groupBy(key, F.session_window("ts", f"{gap_seconds} seconds").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("w")


def health(calls: DataFrame, key: str) -> DataFrame:
    """AGG17: 0.6 success rate + 0.2 / (1 + latency) + 0.2 recency - 0.3 failures in a row, at least 0. calls: key, ok, latency, recency, failures."""
    score = 0.6 * F.col("ok") + 0.2 / (1 + F.col("latency")) + 0.2 * F.col("recency") - 0.3 * F.col("failures")
    return calls.select(key, F.round(F.greatest(F.lit(0.0), score), 6).alias("health"))


def concurrency(stages: DataFrame) -> DataFrame:
    """AGG18: by stage throughput and the concurrency that Little's law asks for. stages: stage, seconds (of an item), finished_at."""
    out = stages.groupBy("stage").agg(F.count("*").alias("n"), F.avg("seconds").alias("mean_s"), (F.max("finished_at") - F.min("finished_at")).alias("span"))
    out = with_percentiles(out, stages, ["stage"], "seconds", {"p95_s": 0.95})
    rate = F.when(F.col("span") > 0, F.col("n") / F.col("span"))
    return out.select("stage", "n", F.round("mean_s", 6).alias("mean_s"), F.round("p95_s", 6).alias("p95_s"), F.round(rate, 6).alias("per_second"), F.ceil(rate * F.col("mean_s")).alias("concurrency"))
