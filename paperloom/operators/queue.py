"""The work queue as append-only tables: reads, appends, claims and comments.

States are rows of an event log, and an item's state is its latest; a claim older than a timeout
lapses, so a crashed worker's item returns to the queue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NO_ISSUES = "No issues found"


def unpublished(conferences: DataFrame) -> DataFrame:
    return conferences.where("is_published = 0").select("id", "code").orderBy(F.desc("id"))


def cached_contributions(cache: DataFrame, event_id) -> DataFrame:
    return cache.where(F.col("event_id") == event_id).select("contribution_id")


def recently_queued(queue: DataFrame, event_id, now, hours: int = 24) -> DataFrame:
    """Distinct contributions asked for within ``hours`` before ``now``; the bound reaches the scan."""
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")
    return queue.where((F.col("event_id") == event_id) & (F.col("requested") >= since)).select("contribution_id").distinct()


def head(queue: DataFrame) -> DataFrame:
    """The oldest item neither claimed nor done; ties go to the smaller id."""
    return queue.where("scanned IS NULL AND scan_start IS NULL").orderBy("requested", "id").limit(1)


def latest_state(items: DataFrame, log: DataFrame, now, timeout_minutes: int = 60) -> DataFrame:
    """``items`` (id, ...) with status waiting, claimed or done from log (id, at, state, failure_reason)."""
    last = log.groupBy("id").agg(F.max_by(F.struct("state", "at", "failure_reason"), "at").alias("s"))
    lapsed = F.col("s.at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(timeout_minutes)} MINUTES")
    status = F.when(F.col("s.state") == "done", "done").when((F.col("s.state") == "claimed") & ~lapsed, "claimed").otherwise("waiting")
    return items.join(last, "id", "left").select(*[items[c] for c in items.columns], status.alias("status"), F.col("s.failure_reason").alias("failure_reason"))


def claim(waiting: DataFrame, now) -> DataFrame:
    """Log rows that claim items."""
    return waiting.select("id", F.lit(now).cast("timestamp").alias("at"), F.lit("claimed").alias("state"), F.lit(None).cast("string").alias("failure_reason"))


def complete(results: DataFrame, now) -> DataFrame:
    """Log rows that end items (id, error); errors are kept as JSON."""
    reason = F.when(F.col("error").isNotNull(), F.to_json(F.struct("error")))
    return results.select("id", F.lit(now).cast("timestamp").alias("at"), F.lit("done").alias("state"), reason.alias("failure_reason"))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def queue_rows(valid: DataFrame, now) -> DataFrame:
    return valid.select("event_id", "contribution_id", F.coalesce("revision_id", F.lit(-1)).alias("revision_id"), F.lit(now).cast("timestamp").alias("requested"))


def content_key(report: Column) -> Column:
    """The name of a stored report: the SHA-1 of its JSON."""
    return F.concat(F.sha1(report), F.lit(".json"))


def word_comment(key: Column, site: str) -> Column:
    """A comment that links a Word report, its key without ``.json``."""
    return F.format_string("This paper has been checked. See the [report](%s%s).", F.lit(site), F.left(key, F.greatest(F.char_length(key) - 5, F.lit(0))))


def latex_comment(body: Column, site: str) -> Column:
    """A comment around a LaTeX report; none where there is nothing to say."""
    return F.when(body != NO_ISSUES, F.concat(F.lit("The references have been checked:\n\n"), body, F.lit(f"\n\n[How references are checked]({site})")))


def comments(results: DataFrame, site: str) -> DataFrame:
    """(event_id, contribution_id, revision_id, text): what to post about checked papers (kind, key, body); none for a LaTeX paper without issues."""
    text = F.when(F.col("kind") == "word", word_comment(F.col("key"), site)).when(F.col("kind") == "latex", latex_comment(F.col("body"), site))
    return results.select("event_id", "contribution_id", "revision_id", text.alias("text")).where("text is not null")


def expired(objects: DataFrame, now, minutes: int = 5) -> DataFrame:
    """Objects (path, modificationTime) older than ``minutes`` at ``now``."""
    return objects.where(F.col("modificationTime") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
