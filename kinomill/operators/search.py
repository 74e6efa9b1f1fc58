"""Filtered exact search over scene vectors, by scene or grouped by media.

The query vector enters the plan as a literal, so scoring is a projection above the
scan with the filters below it; nothing is joined with the query.  The order is by
score (single precision, unrounded), then by id.  A scene ranking is one
take-ordered; a media ranking keeps the best scenes of each media before anything is
shuffled, and looks up only the media that are returned.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinomill.functions.numbers import rounded_score
from kinomill.functions.text import preview_frame_index, preview_reference
from kinomill.functions.vectors import cosine_to
from kinomill.lineage import cut

DEFAULT_LIMIT, MOST, SCENES_OF_A_MEDIA, DEFAULT_SCORE = 16, 100, 5, 0.3


@dataclass(frozen=True)
class SearchRequest:
    vector: Sequence[float]
    model: str = ""
    media_id: str = ""
    media_type: str = ""
    year: int | None = None
    language: str = ""
    person_id: str = ""
    person_ids: Sequence[str] = ()
    limit: int = 0
    min_score: float | None = None
    mode: str = "media"

    def settled(self) -> SearchRequest:
        """With defaults; a limit out of range counts as none given. Raises ValueError for a score or mode out of range."""
        score = DEFAULT_SCORE if self.min_score is None else self.min_score
        if not 0 <= score <= 1:
            raise ValueError("min_score must be between 0 and 1")
        if self.mode not in ("", "media", "scene"):
            raise ValueError("mode must be media or scene")
        persons = tuple(dict.fromkeys(p.strip() for p in self.person_ids if p.strip()))
        return replace(self, limit=self.limit if 0 < self.limit <= MOST else DEFAULT_LIMIT, min_score=score, mode=self.mode or "media", person_ids=persons)


def catalog_limit(limit: int) -> int:
    """20 for none; clamped to 100."""
    return 20 if limit <= 0 else min(limit, MOST)


def media_filter(request: SearchRequest) -> list[Column]:
    """Conditions on media; an empty field sets none, a null year never matches."""
    conditions = []
    if request.media_id:
        conditions.append(F.col("media_id") == request.media_id)
    if request.media_type:
        conditions.append(F.col("type") == request.media_type)
    if request.year is not None:
        conditions.append(F.col("year") == request.year)
    if request.language:
        conditions.append(F.array_contains("language", request.language))
    return conditions


def scene_filter(request: SearchRequest) -> list[Column]:
    """Conditions on scenes: one person, and any of several."""
    conditions = []
    if request.person_id:
        conditions.append(F.array_contains("person_ids", request.person_id))
    if request.person_ids:
        conditions.append(F.arrays_overlap("person_ids", F.array(*map(F.lit, request.person_ids))))
    return conditions


def scene_documents(scenes: DataFrame, media: DataFrame, request: SearchRequest) -> DataFrame:
    """Scenes with their media's columns, filtered; scenes without media drop out. The planner broadcasts the media side while it is small."""
    for condition in scene_filter(request):
        scenes = scenes.filter(condition)
    for condition in media_filter(request):
        media = media.filter(condition)
    return scenes.join(media, "media_id")


def listing(documents: DataFrame, by: Sequence[str] = ("media_id", "start", "scene_id")) -> DataFrame:
    """All rows in the order of ``by``, with ``place`` from 1. Ranges are sorted apart; a place is the row's place in its range and the rows of the ranges before."""
    ordered = cut(documents.repartitionByRange(*by).sortWithinPartitions(*by))
    at = F.spark_partition_id()
    counts = {r["at"]: r["count"] for r in ordered.groupBy(at.alias("at")).count().collect()}  # one row for each range
    before = list(itertools.accumulate((counts.get(i, 0) for i in range(ordered.rdd.getNumPartitions())), initial=0))
    in_range = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("place", F.get(F.array(*map(F.lit, before)).cast("array<bigint>"), at) + in_range + 1)


def comparable(model: str, dimensions: int) -> Column:
    """Scenes whose vector can be compared: not of another known model, and of the query's length."""
    other = (F.col("embedding_model") != "") & F.lit(model != "") & (F.col("embedding_model") != model)
    return ~F.coalesce(other, F.lit(False)) & (F.lit(dimensions == 0) | (F.size("embedding") == dimensions))


def scored(documents: DataFrame, request: SearchRequest) -> DataFrame:
    """Adds ``score`` to scenes that can be compared and keeps scores above the threshold, compared in single precision. Documents without ``embedding_model`` are of no known model."""
    known = documents if "embedding_model" in documents.columns else documents.withColumn("embedding_model", F.lit(""))
    rows = known.filter(comparable(request.model, len(request.vector))).select(*documents.columns).withColumn("score", cosine_to(F.col("embedding"), request.vector))
    return rows.filter(F.col("score") > F.lit(request.min_score).cast("float"))


def search_scenes(documents: DataFrame, request: SearchRequest) -> DataFrame:
    request = request.settled()
    return scored(documents, request).orderBy(F.desc("score"), "scene_id").limit(request.limit)


def best_scenes_of_media(rows: DataFrame, n: int = SCENES_OF_A_MEDIA) -> DataFrame:
    """``rank`` 1 to ``n`` within each media."""
    order = Window.partitionBy("media_id").orderBy(F.desc("score"), "scene_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def search_media(documents: DataFrame, request: SearchRequest) -> DataFrame:
    """The best scenes of the best media: ``place`` of the media, ``rank`` of the scene in it."""
    request = request.settled()
    ranked = best_scenes_of_media(scored(documents, request))
    winners = ranked.filter(F.col("rank") == 1).orderBy(F.desc("score"), "media_id").limit(request.limit)
    place = F.row_number().over(Window.orderBy(F.desc("best"), "media_id"))  # over at most ``limit`` rows
    winners = winners.select("media_id", F.col("score").alias("best")).withColumn("place", place)
    return ranked.join(F.broadcast(winners), "media_id")


def nested_results(ranked: DataFrame) -> DataFrame:
    """One row for each media with its scenes in order, at most :data:`SCENES_OF_A_MEDIA`."""
    scene = F.struct("rank", "scene_id", "start", "end", rounded_score(F.col("score")).alias("score"), "preview")
    return ranked.groupBy("place", "media_id").agg(F.sort_array(F.collect_list(scene)).alias("matched_scenes"), F.max("score").alias("score"))


def sampled_times(media: DataFrame) -> DataFrame:
    """``media_id``, ``index``, ``time``: when the frame of a scene was taken, from the media's metadata."""
    sources = F.from_json(F.get_json_object("metadata", "$.frame_extraction_sources"), "array<struct<scene_index:double,sample_timestamp:double>>")
    rows = media.select("media_id", F.inline(sources)).filter("scene_index IS NOT NULL AND sample_timestamp > 0")
    return rows.groupBy("media_id", F.col("scene_index").cast("long").alias("index")).agg(F.max("sample_timestamp").alias("time"))


def with_preview_times(results: DataFrame, media: DataFrame) -> DataFrame:
    """Fills ``preview_time`` where it is 0 and the preview is a numbered frame; only for media among the results."""
    times = sampled_times(media.join(results.select("media_id").distinct(), "media_id", "left_semi"))
    index = preview_frame_index(preview_reference(F.col("preview_path"), F.col("preview")))
    filled = results.withColumn("index", F.when(F.coalesce("preview_time", F.lit(0.0)) == 0, index)).join(times, ["media_id", "index"], "left")
    return filled.withColumn("preview_time", F.coalesce("time", "preview_time")).drop("index", "time")


def by_fingerprint(media: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each ``fingerprint`` (and ``local_path``) the first media with it: by content keys, else by path among media that have none."""
    keys = [F.lower(F.trim(F.get_json_object("metadata", f"$.{k}"))) for k in ("content_sha256", "content_fingerprint", "remote_fingerprint")]
    prints = media.select("media_id", F.explode(F.array_distinct(F.array(*keys))).alias("print")).filter("print <> ''").groupBy("print").agg(F.min("media_id").alias("by_print"))
    bare = media.filter(F.coalesce(*keys).isNull()).select(F.trim(F.get_json_object("metadata", "$.local_path")).alias("path"), "media_id")
    paths = bare.filter("path <> ''").groupBy("path").agg(F.min("media_id").alias("by_path"))
    wanted = wanted.withColumn("print", F.lower(F.trim("fingerprint"))).withColumn("path", F.trim("local_path"))
    return wanted.join(prints, "print", "left").join(paths, "path", "left").withColumn("media_id", F.coalesce("by_print", "by_path")).drop("print", "path", "by_print", "by_path")
