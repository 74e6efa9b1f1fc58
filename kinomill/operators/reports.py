"""Summaries and small choices over frames, ranges, vectors and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinomill.functions.text import trimmed
from kinomill.operators.faces import DETECTION, evenly_spread, ingestion_state

SAME = 0.995


def extraction_summary(frames: DataFrame, key: str) -> DataFrame:
    """For each ``key`` and ``method`` the frames that were extracted, and how many failed (``error`` is not blank) over all methods.

    A key all of whose frames failed has one row without a method.
    """
    failed = trimmed(F.coalesce("error", F.lit(""))) != ""
    counts = frames.groupBy(key, F.when(~failed, F.col("method")).alias("method")).agg(F.count("*").alias("frames"), F.count_if(failed).alias("failures"))
    # two rows of a key and a method at most are left: those extracted and those that failed
    whole = counts.groupBy(key).agg(F.sum("failures").alias("failures"), F.sum(F.col("frames") - F.col("failures")).alias("extracted"))
    kept = counts.filter(F.col("frames") > F.col("failures")).select(key, "method", (F.col("frames") - F.col("failures")).alias("frames"))
    return whole.join(kept, key, "left").select(key, "method", F.coalesce("frames", F.lit(0)).alias("frames"), "failures")


def index_summary(keyframes: DataFrame, key: str) -> DataFrame:
    """For each ``key`` the number of key frames (``number``, ``offset``, ``size``), where the first begins and where the last ends."""
    return keyframes.groupBy(key).agg(F.count("*").alias("keyframes"), F.min_by("offset", "number").alias("first_offset"), F.max_by(F.col("offset") + F.col("size"), "number").alias("last_end"))


def range_stats(requests: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """For each ``key`` of ``sizes`` (``size``) its requests, their ``bytes``, their different blocks, and the share of the size that was loaded (0 of an empty file)."""
    sums = requests.groupBy(key).agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"), F.count_distinct("block").alias("blocks"))
    rows = sizes.join(sums, key, "left")
    zero = F.lit(0).cast("bigint")
    filled = rows.select(key, "size", *(F.coalesce(c, zero).alias(c) for c in ("requests", "bytes", "blocks")))
    return filled.select(key, "requests", "bytes", "blocks", F.when(F.col("size") > 0, F.col("bytes") / F.col("size")).otherwise(0.0).alias("download_ratio"))


def drift_report(pairs: DataFrame, original: str, other: str, threshold: float = SAME) -> DataFrame:
    """How far vectors of one profile are from those of another: count, mean, least and greatest cosine, drifts, and which profile to use. One row; without pairs nothing is recommended."""

    def product(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)

    a, b = F.col(original), F.col(other)
    norm = F.sqrt(product(a, a)) * F.sqrt(product(b, b))
    cosines = pairs.select(F.when((F.size(a) == F.size(b)) & (norm > 0), product(a, b) / norm).otherwise(0.0).alias("s"))
    found = cosines.agg(F.count("*").alias("samples"), F.avg("s").alias("mean"), F.min("s").alias("least"), F.max("s").alias("most"))
    choice = F.when(F.col("least") >= threshold, "compressed").when(F.col("least").isNotNull(), "original")
    parts = {"cosine_mean": F.col("mean"), "cosine_min": F.col("least"), "cosine_max": F.col("most"), "drift_mean": 1 - F.col("mean"), "drift_max": 1 - F.col("least")}
    return found.select("samples", *(F.round(c, 8).alias(n) for n, c in parts.items()), choice.alias("recommendation"))


def first_distinct(rows: DataFrame, column: str, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` different values of ``column`` that are not blank, in the order of where they first stand."""
    firsts = rows.filter(trimmed(F.col(column)) != "").groupBy(trimmed(F.col(column)).alias(column)).agg(F.min(F.struct(*order)).alias("_at"))
    return firsts.orderBy("_at", column).limit(n).select(column)


def preferred(rows: DataFrame, key: str, kind: str, preference: Sequence[str], order: str, usable: Column) -> DataFrame:
    """Of each key the usable row whose ``kind`` stands first in ``preference``, else the first usable one by ``order``."""
    at = F.array_position(F.array(*map(F.lit, preference)), F.col(kind))
    rank = F.when(at > 0, at).otherwise(len(preference) + 1)
    rest = [c for c in rows.columns if c != key]
    best = rows.filter(usable).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(rank, order)).alias("_b"))
    return best.select(key, "_b.*")


def with_flag(rows: DataFrame, holders: DataFrame, column: str, name: str) -> DataFrame:
    """Adds whether ``column`` is among those of ``holders``."""
    held = holders.select(column).filter(F.col(column).isNotNull()).distinct().withColumn(name, F.lit(True))
    return rows.join(held, column, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def without_remote_paths(images: DataFrame, path: str = "local_path", source: str = "source_url") -> tuple[DataFrame, DataFrame]:
    """Images that have an address lose their local path; and how many did. Blank values count as none."""
    stale = (trimmed(F.coalesce(path, F.lit(""))) != "") & (trimmed(F.coalesce(source, F.lit(""))) != "")
    cleared = images.withColumn(path, F.when(stale, "").otherwise(F.col(path)))
    return cleared, images.agg(F.count_if(stale).alias("cleared"))


def all_previews(scenes: DataFrame, media: DataFrame, key: str = "media_id") -> DataFrame:
    """Whether a media has scenes and all of them have a preview."""
    state = scenes.groupBy(key).agg(F.min(trimmed(F.coalesce("preview", F.lit(""))) != "").alias("complete"))
    return media.select(key).distinct().join(state, key, "left").withColumn("complete", F.coalesce("complete", F.lit(False)))


def ingested(images: DataFrame, vectors: DataFrame, faces: DataFrame, failures: DataFrame, least: float = DETECTION) -> tuple[DataFrame, DataFrame]:
    """The state of each image, and the vectors after that.

    ``faces`` has a row for each face found (``image_id``, ``score``, ``vector``) and
    ``failures`` the images that could not be looked at.  An image that has a vector is
    ``skipped``; one that failed is ``failed``; one with exactly one face, certain enough,
    is ``ready`` and its vector is added; any other is ``rejected``.
    """
    found = faces.groupBy("image_id").agg(F.count("*").alias("faces"), F.max("score").alias("score"), F.max_by("vector", "score").alias("vector"))
    state = with_flag(with_flag(images.select("image_id").distinct(), vectors, "image_id", "skipped"), failures, "image_id", "failed").join(found, "image_id", "left")
    one = F.when(F.col("faces") == 1, F.array("score")).otherwise(F.array().cast("array<float>"))
    decided = F.when(F.col("skipped"), "skipped").when(F.col("failed"), "failed").otherwise(ingestion_state(one, least))
    state = state.withColumn("status", decided)
    added = state.filter("status = 'ready'").select("image_id", "vector")
    gone = state.filter("status = 'rejected'").select("image_id")
    return state.select("image_id", "status"), vectors.join(gone, "image_id", "left_anti").select("image_id", "vector").unionByName(added)


def wanted_references(cast: DataFrame, vectors: DataFrame, images: DataFrame, listed: DataFrame, most: int) -> DataFrame:
    """Images to load for people of the cast who have no vector and none of whose images are listed yet: at most ``most`` for each, spread evenly over their places."""
    people = cast.select("person_id").distinct().join(vectors.select("person_id"), "person_id", "left_anti").join(listed.select("person_id"), "person_id", "left_anti")
    return evenly_spread(images.join(people, "person_id", "left_semi"), "person_id", ["place", "image_id"], most)


def media_problems(media: DataFrame, scenes: DataFrame) -> DataFrame:
    """``media_id`` and ``errors``, what is wrong with a media and its scenes in a fixed order, none for a sound one.

    Scenes are reduced to a few marks for each media before they meet it, however many
    a media has.
    """
    marks = scenes.groupBy("media_id").agg(
        F.count("*").alias("_n"),
        F.max(F.coalesce((F.col("start") < 0) | (F.col("start") >= F.col("end")), F.lit(False))).alias("_interval"),
        F.max(F.coalesce(~F.when(F.coalesce("quality_score", F.lit(0.0)) == 0, 1.0).otherwise(F.col("quality_score")).between(0, 1), F.lit(False))).alias("_quality"),
    )
    wrong = {
        "title": F.coalesce(trimmed(F.col("title")), F.lit("")) == "", "scenes": F.coalesce("_n", F.lit(0)) == 0, "year": ~F.col("year").between(1888, 3000),
        "duration": F.col("duration") < 0, "interval": F.col("_interval"), "quality": F.col("_quality"),
    }
    errors = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in wrong.items())))
    return media.join(marks, "media_id", "left").select("media_id", errors.alias("errors"))
