"""Crawl frontier, coverage of a build, and the graph of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.plans.runtime import stage

# States of an address.
DISCOVERED, FETCHING, PROCESSED, FAILED, SKIPPED, GONE = "DISCOVERED", "FETCHING", "PROCESSED", "FAILED", "SKIPPED", "GONE"


def pending(frontier: DataFrame, source: str, n: int) -> DataFrame:
    """SRC4: the next n addresses of a source, shallow ones first, then old ones."""
    return frontier.where((F.col("source_name") == source) & (F.col("state") == DISCOVERED)).orderBy("depth", "created_at", "url").limit(n)


def sitemap_order() -> list[Column]:
    """SRC3: dated entries first, newest first, then undated ones."""
    return [F.col("lastmod").desc_nulls_last(), F.col("loc")]


def stale(stored: DataFrame, frontier: DataFrame, key: str = "url") -> DataFrame:
    """JN5: stored addresses that the frontier no longer has."""
    return stored.select(key).distinct().join(frontier.select(key), key, "left_anti")


def reactivate(frontier: DataFrame, indexed: DataFrame, key: str = "url") -> DataFrame:
    """JN6: processed addresses without anything in the index go back to DISCOVERED."""
    done = indexed.select(key).distinct().withColumn("_in", F.lit(True))
    return frontier.join(done, key, "left").withColumn("state", F.when((F.col("state") == PROCESSED) & F.col("_in").isNull(), DISCOVERED).otherwise(F.col("state"))).drop("_in")


def reset_stale_claims(frontier: DataFrame, now: float, seconds: float = 1800) -> DataFrame:
    """STR9: addresses claimed too long ago go back to DISCOVERED."""
    old = (F.col("state") == FETCHING) & (F.col("updated_at") < now - seconds)
    return frontier.withColumn("state", F.when(old, DISCOVERED).otherwise(F.col("state")))


def _unsupported(text: Column) -> Column:
    return text.contains("not supported") | text.contains("modelerror") | text.contains("does not exist") | text.contains("unknown model") | (text.contains("model") & text.contains("not found"))


def provider_error(status: Column, body: Column, message: Column) -> Column:
    """FN22: the category of a provider's failure, by its status and body if there is a status, else by the message."""
    low_body, low = F.lower(F.coalesce(body, F.lit(""))), F.lower(F.coalesce(message, F.lit("")))
    of_status = (
        F.when(_unsupported(low_body) & status.isin(401, 403), "invalid_request").when(status == 429, "rate_limited").when(status.isin(401, 403), "authentication_error")
        .when(status.isin(400, 422), "invalid_request").when(status >= 500, "temporary_unavailable").otherwise("permanent_error")
    )
    denied = low.contains("401") | low.contains("unauthorized")
    of_message = (
        F.when(low.contains("rate limit") | low.contains("429") | low.contains("too many requests"), "rate_limited").when(low.contains("quota") | low.contains("exceeded"), "quota_exceeded")
        .when(_unsupported(low) & denied, "invalid_request").when(denied | low.contains("authentication"), "authentication_error")
        .when(low.contains("timed out") | low.contains("timeout") | low.contains("could not reach") | low.contains("connection"), "retryable").otherwise("permanent_error")
    )
    return F.when(status.isNotNull(), of_status).otherwise(of_message)


def retry_after(header: Column, default: float = 60.0) -> Column:
    """FN23: seconds from a Retry-After header; the default where it is missing or no number."""
    return F.coalesce(header.try_cast("double"), F.lit(default))


def cooldown(category: Column, wait: Column, by_category: dict[str, float], default: float) -> Column:
    """FN23: how long a provider rests after a failure: what it asked for (not below 0), else its category's time."""
    table = F.lit(None).cast("double")
    for name, seconds in by_category.items():
        table = F.when(category == name, F.lit(seconds)).otherwise(table)
    return F.when(wait.isNotNull(), F.greatest(F.lit(0.0), wait)).otherwise(F.coalesce(table, F.lit(default)))


def normal_url(url: Column | str) -> Column:
    """FN25: without white space around it and slashes at its end."""
    return F.regexp_replace(T.strip(url), "/+$", "")


def error_category(message: Column) -> Column:
    """FN22 for frontier rows: a broad kind of failure by its message."""
    m = F.lower(message)
    return (
        F.when(m.isNull() | (m == ""), "none").when(m.rlike("timeout|timed out"), "timeout").when(m.rlike("429|rate limit|too many requests"), "rate_limit")
        .when(m.rlike("401|403|unauthor|forbidden"), "auth").when(m.rlike("404|410|not found"), "not_found").when(m.rlike(r"\b5\d\d\b|server error"), "server").otherwise("other")
    )


def frontier_stats(frontier: DataFrame) -> DataFrame:
    """AGG16: addresses and attempts by source and state."""
    return frontier.groupBy("source_name", "state").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


def top_errors(frontier: DataFrame, n: int = 5) -> DataFrame:
    """AGG16: the most frequent errors of failed addresses."""
    return frontier.where(F.col("state") == FAILED).groupBy(F.col("last_error").alias("error")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(n)


def coverage(manifest: DataFrame, chunk_counts: DataFrame, replaced: DataFrame, key: str = "relative_path") -> DataFrame:
    """JN7: what a build made of each file: replaced, indexed, zero_chunks or missing_output."""
    out = manifest.join(chunk_counts.select(key, "chunk_count"), key, "left").join(replaced.select(key).distinct().withColumn("_r", F.lit(True)), key, "left")
    status = F.when(F.col("_r"), "replaced").when(F.col("chunk_count") > 0, "indexed").when(F.col("chunk_count") == 0, "zero_chunks").otherwise("missing_output")
    return out.select(manifest["*"], F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), status.alias("status"))


def neighbours(edges: DataFrame, nodes: DataFrame, name: str | None = None) -> DataFrame:
    """JN1: source, relation and target names of edges, one step deep; of one node if a name is given."""
    s, t = nodes.select(F.col("id").alias("source_id"), F.col("name").alias("source")), nodes.select(F.col("id").alias("target_id"), F.col("name").alias("target"))
    out = edges.join(s, "source_id").join(t, "target_id").select("source", "relation_type", "target")
    return out.where((F.col("source") == name.lower()) | (F.col("target") == name.lower())) if name else out


def parent_edges(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """JN15: parents whose children aren't processed yet, with the number of them."""
    open_ = frontier.where(F.col("state") != PROCESSED).select(F.col("url_hash").alias("child_hash"))
    return edges.join(open_, "child_hash").groupBy("parent_hash").agg(F.count("*").alias("open_children"))


def url_hash(url: Column | str) -> Column:
    return F.sha2(url, 256)


def reachable(seeds: DataFrame, links: DataFrame, most_depth: int, label: str = "frontier") -> DataFrame:
    """SRC1: url, depth of every address reached from the seeds over links (url, target) in at most most_depth steps, the fewest for each.

    A breadth-first crawl as rounds of one join and one anti-join; each round is a table in the shared folder, and ends
    the crawl when it finds nothing new.
    """
    found = stage(seeds.select("url").distinct().withColumn("depth", F.lit(0)), label)
    last = found
    for depth in range(1, most_depth + 1):
        new = last.join(links, "url").select(F.col("target").alias("url")).distinct().join(found, "url", "left_anti")
        last = stage(new.withColumn("depth", F.lit(depth)), label)
        if last.isEmpty():
            break
        found = found.unionByName(last)
    return found


def crawl_limit(pages: int, multiplier: int = 3, least: int = 50) -> int:
    """SRC1: how many addresses a crawl attempts for so many pages."""
    return max(pages * multiplier, least)


def orphans(tasks: DataFrame, heartbeats: DataFrame, now: float, lease: float = 60.0, dispatched: float = 300.0) -> DataFrame:
    """STR4: task_id, status of each task: alive with a heartbeat within the lease, waiting if dispatched lately without one yet, else orphaned.

    tasks: task_id, dispatched_at; heartbeats: task_id, at (seconds).
    """
    last = heartbeats.groupBy("task_id").agg(F.max("at").alias("last"))
    alive = F.coalesce(F.col("last") > now - lease, F.lit(False))
    waiting = F.col("last").isNull() & (F.col("dispatched_at") > now - dispatched)
    return tasks.join(last, "task_id", "left").select("task_id", F.when(alive, "alive").when(waiting, "waiting").otherwise("orphaned").alias("status"))
