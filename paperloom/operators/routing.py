"""Which submissions to check: revisions, paper types, comments, notifications, discovery."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, functions as F

from paperloom.functions.text import event_number
from paperloom.operators import bloom

#: File types of sources and of bibliographies.
SOURCE_TYPES, BIB_TYPES = (180, 31, 352), (182, 354)


def latest_revision(revisions: Column) -> Column:
    """The revision of the largest id; ids below zero don't count, ties keep the first."""
    good = F.filter(revisions, lambda r: r["id"] > -1)
    top = F.array_max(F.transform(good, lambda r: r["id"]))
    return F.try_element_at(F.filter(good, lambda r: r["id"] == top), F.lit(1))


def pick_revision(revisions: Column, wanted: Column) -> Column:
    """The latest revision for -1, else the first whose id reads the same."""
    same = F.filter(revisions, lambda r: r["id"].cast("string") == wanted.cast("string"))
    return F.when(wanted.cast("string") == "-1", latest_revision(revisions)).otherwise(F.try_element_at(same, F.lit(1)))


def _has(files: Column, suffix: str, types: tuple[int, ...] | None = None) -> Column:
    fits = lambda f: F.endswith(F.lower(f["filename"]), F.lit(suffix)) & (f["file_type"].isin(*types) if types else F.lit(True))
    return F.coalesce(F.exists(files, fits), F.lit(False))


def paper_type(files: Column, mode: str = "finder") -> Column:
    """word, bibtex, latex or unknown.  ``worker`` asks types of Word files and bibliographies too."""
    strict = mode == "worker"
    word = _has(files, ".docx", SOURCE_TYPES if strict else None)
    tex, bib = _has(files, ".tex", SOURCE_TYPES), _has(files, ".bib", BIB_TYPES if strict else None)
    return F.when(word, "word").when(tex & bib, "bibtex").when(tex, "latex").otherwise("unknown")


def paper_file(files: Column, mode: str = "finder") -> Column:
    """The file that ``paper_type`` goes by: the first Word file, else the first LaTeX source, else null."""

    def first(suffix: str, types: tuple[int, ...] | None) -> Column:
        fits = lambda f: F.endswith(F.lower(f["filename"]), F.lit(suffix)) & (f["file_type"].isin(*types) if types else F.lit(True))
        return F.try_element_at(F.filter(files, fits), F.lit(1))

    return F.coalesce(first(".docx", SOURCE_TYPES if mode == "worker" else None), first(".tex", SOURCE_TYPES))


def first_docx(files: Column) -> Column:
    """The first file whose name ends in ``.docx``, in small letters."""
    return F.try_element_at(F.filter(files, lambda f: F.endswith(f["filename"], F.lit(".docx"))), F.lit(1))


def commented_by(comments: Column, user_id) -> Column:
    """Whether a comment's user has this id; comments without a user are passed over."""
    return F.coalesce(F.exists(comments, lambda c: F.coalesce(c["user"]["id"].cast("string") == str(user_id), F.lit(False))), F.lit(False))


def reject_reason(n: DataFrame) -> Column:
    """Why a notification (action, contrib_id, editable_type, event, revision_id) isn't queued, or null."""
    fields = ("action", "contrib_id", "editable_type", "event", "revision_id")
    return (
        F.when(F.greatest(*(F.col(c).isNotNull() for c in fields)) == F.lit(False), "payload missing")
        .when(F.col("event").isNull(), "event missing")
        .when(F.col("contrib_id").isNull(), "contrib_id missing")
        .when(F.col("action").isNull(), "action missing")
        .when(F.col("editable_type").isNull(), "editable_type missing")
        .when(~F.col("action").isin("create", "update"), "action not handled")
        .when(F.col("editable_type") != "paper", "editable_type not handled")
    )


def validate(notifications: DataFrame) -> DataFrame:
    """``notifications`` with reason, logged and queued, event_id and revision_id (-1: the latest).

    What lacks a field is neither logged nor queued; what isn't handled is logged only.
    """
    reason = reject_reason(notifications)
    out = notifications.withColumn("reason", reason)
    out = out.withColumn("logged", F.coalesce(F.endswith("reason", F.lit("not handled")), F.lit(True))).withColumn("queued", F.col("reason").isNull())
    return out.withColumn("event_id", event_number(F.col("event"))).withColumn("revision_id", F.coalesce("revision_id", F.lit(-1)))


def discover(contributions: DataFrame, queued: DataFrame, cached: DataFrame, bot_id, mode: str = "finder") -> DataFrame:
    """Contributions neither queued lately nor cached, with revision_id, type and route (queue, cache or none).

    Those without a revision and those already commented have the route none.  What is known leaves by
    an anti-join behind a Bloom filter; what is asked of the revisions comes first, so they aren't shuffled.
    """
    keys = ["event_id", "contribution_id"]
    known = queued.select(keys).unionByName(cached.select(keys))
    picked = contributions.withColumn("revision", latest_revision(F.col("revisions")))
    kind = paper_type(F.col("revision.files"), mode)
    slim = picked.select(*keys, F.col("revision.id").alias("revision_id"), kind.alias("type"), commented_by(F.col("revision.comments"), bot_id).alias("commented"))
    told = bloom.anti_join(slim, known, keys)
    route = F.when(F.col("revision_id").isNull(), "none").when(~F.col("type").isin("latex", "word"), "cache").when(F.col("commented"), "none").otherwise("queue")
    return told.withColumn("route", route)


def cache_rows(discovered: DataFrame, now) -> DataFrame:
    """Rows of the paper-type cache for what ``discover`` routes there, so that it isn't fetched again."""
    found = discovered.where("route = 'cache'")
    return found.select("event_id", "contribution_id", F.lit("unknown").alias("paper_type"), F.lit(now).cast("timestamp").alias("checked"))


def discovery_counts(discovered: DataFrame) -> DataFrame:
    """(event_id, queue_items, cached_items, passed_over): how a discovery run went, per event."""
    n = lambda route: F.count_if(F.col("route") == route)
    return discovered.groupBy("event_id").agg(n("queue").alias("queue_items"), n("cache").alias("cached_items"), n("none").alias("passed_over"))


def write_discovered(discovered: DataFrame, path: str) -> dict:
    """Append what ``discover`` found to the table ``path`` and tell how the run went: counts of each route, and seconds.

    The counts are observed on the rows as they are written, so nothing runs a second time for them.
    """
    watch, began = Observation(), time.monotonic()
    n = lambda route: F.count_if(F.col("route") == route)
    discovered.observe(watch, n("queue").alias("queue_items"), n("cache").alias("cached_items"), n("none").alias("passed_over")).write.mode("append").parquet(path)
    return watch.get | {"duration": time.monotonic() - began}


def dispatch(kind: Column, editor_revision: Column) -> Column:
    """Which check a queued item goes to, or why none."""
    return F.when(F.coalesce(editor_revision, F.lit(False)), "editor revision").when(kind == "word", "word").when(kind == "latex", "latex").otherwise("Unknown file type")
