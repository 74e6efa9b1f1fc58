"""Batch forms of the task log: latest state, running progress, first of equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "canceled")


def latest_states(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each task: its last event, by map-side aggregation."""
    rest = [c for c in events.columns if c not in (key, *order)]
    newest = events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_e"))
    return newest.select(key, *(F.col(f"_e.{c}").alias(c) for c in (*order, *rest)))


def running_percent(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each event with the highest percent so far, within 0 and 1."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("percent", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.max("percent").over(upto))))


def first_of_equals(rows: DataFrame, fingerprint: str, order: list[str]) -> DataFrame:
    """Each row with whether it is the first with its fingerprint and which row that is; blank fingerprints are all different."""
    known = F.trim(F.coalesce(F.col(fingerprint), F.lit(""))) != ""
    # reduced on every partition before the shuffle, so a fingerprint of many rows costs no more than others
    firsts = rows.filter(known).groupBy(fingerprint).agg(F.min_by("id", F.struct(*order)).alias("first_id"))
    joined = rows.join(firsts, fingerprint, "left").select(*rows.columns, F.coalesce("first_id", "id").alias("first_id"))
    return joined.withColumn("is_first", F.col("first_id") == F.col("id"))


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """What a subscriber that knows ``before`` is told: ``updated`` with the new row, where it is new or other, and ``removed``."""
    rest = [c for c in after.columns if c != key]
    old = before.select(F.col(key), F.struct(*rest).alias("_old"))
    new = after.select(F.col(key), F.struct(*rest).alias("_new"))
    both = old.join(new, key, "full").withColumn("kind", F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull() | ~F.col("_old").eqNullSafe(F.col("_new")), "updated"))
    return both.filter("kind IS NOT NULL").select(key, "kind", "_new.*")


def checked_commands(commands: DataFrame, media: DataFrame) -> DataFrame:
    """Commands to open a media (``media_id``, ``time``), static or a stream, with ``problem``: ``unknown media``, ``bad time`` (not a number, or not within the ``duration``, where it is known), or null."""
    known = media.select("media_id", F.coalesce("duration", F.lit(float("inf"))).alias("_duration"), F.lit(True).alias("_known"))
    time = F.col("time").cast("double")
    bad = time.isNull() | F.isnan(time) | (F.abs(time) == float("inf")) | (time < 0) | (time > F.col("_duration"))
    joined = commands.join(known, "media_id", "left")
    return joined.withColumn("problem", F.when(F.col("_known").isNull(), "unknown media").when(bad, "bad time")).drop("_duration", "_known")


def recovered(tasks: DataFrame) -> DataFrame:
    """Tasks found running or waiting when a service starts again have failed."""
    return tasks.withColumn("state", F.when(F.col("state").isin("queued", "running"), "failed").otherwise(F.col("state")))


def without_terminal(tasks: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Tasks that stay when finished ones (all, or those of ``ids``) are removed."""
    gone = tasks.filter(F.col("state").isin(*TERMINAL))
    if ids is not None:
        gone = gone.join(ids, "id", "left_semi")
    return tasks.join(gone.select("id"), "id", "left_anti")


def outcomes(asked: DataFrame, tasks: DataFrame) -> DataFrame:
    """What happens to each task asked to stop: stopped, already finished, or not found."""
    joined = asked.select("id").distinct().join(tasks.select("id", "state"), "id", "left")
    return joined.withColumn("outcome", F.when(F.col("state").isNull(), "missing").when(F.col("state").isin(*TERMINAL), "finished").otherwise("stopped")).select("id", "outcome")
