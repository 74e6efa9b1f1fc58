"""Searches over the given vectors and scenes."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from kinomill.functions import vectors
from kinomill.operators import reports, search
from kinomill.operators.search import SearchRequest
from kinomill.plans.registry import Registry
from kinomill.tables import table

plan = Registry()
QUERIES, ORACLES = plan.queries, plan.oracles

MEDIA = "(SELECT * FROM media QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY updated_at DESC) = 1)"
#: The vectors with their cosine to the first, products in single precision.
SCORED = """(SELECT e.vec_id, e.label, CAST(greatest(-1, least(1, list_sum(list_transform(range(1, 65), lambda i: CAST(CAST(e.embedding[i] AS FLOAT) * CAST(q.embedding[i] AS FLOAT) AS DOUBLE)))
    / sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(CAST(x AS FLOAT) * CAST(x AS FLOAT) AS DOUBLE))) * list_sum(list_transform(q.embedding, lambda x: CAST(CAST(x AS FLOAT) * CAST(x AS FLOAT) AS DOUBLE)))))) AS FLOAT) AS score
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("scene_id"), F.col("label").alias("media_id"), "embedding", F.concat(F.lit("model-"), (F.col("label") % 2).cast("string")).alias("embedding_model")
    )


def _first(spark, folder):
    return table(spark, folder, "embeddings").filter("vec_id = 0").first()["embedding"]


def newest_media(spark, folder):
    """One row for each media, named as the search names its columns."""
    fields = F.struct("updated_at", "media_type", "title", "original_title", "release_year", "duration_sec", "languages", "description", "tags", "metadata")
    rows = table(spark, folder, "media").groupBy("media_id").agg(F.max_by(fields, "updated_at").alias("m")).select("media_id", "m.*")
    return rows.withColumnsRenamed({"media_type": "type", "release_year": "year", "languages": "language", "duration_sec": "duration"})


@plan(f"SELECT vec_id, label, round(CAST(score AS DOUBLE), 6) AS score FROM {SCORED} WHERE score > CAST(0.1 AS FLOAT) ORDER BY score DESC, vec_id LIMIT 16")
def search_scene_j08_ag02_p09_sl01_sl02(spark, folder):
    found = search.search_scenes(_vectors(spark, folder), SearchRequest(_first(spark, folder), min_score=0.1, mode="scene"))
    return found.select(F.col("scene_id").alias("vec_id"), F.col("media_id").alias("label"), F.round(F.col("score").cast("double"), 6).alias("score"))


@plan(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM {SCORED} WHERE score > CAST(0.05 AS FLOAT)),
        w AS (SELECT label, row_number() OVER (ORDER BY score DESC, label) AS place FROM r WHERE rank = 1 ORDER BY score DESC, label LIMIT 4)
        SELECT place::INT AS place, label, rank::INT AS rank, vec_id, round(CAST(score AS DOUBLE), 6) AS score FROM r JOIN w USING (label) WHERE rank <= 5"""
)
def search_media_ag01_wf01_wf02_sl03(spark, folder):
    found = search.search_media(_vectors(spark, folder), SearchRequest(_first(spark, folder), min_score=0.05, limit=4))
    return found.select("place", F.col("media_id").alias("label"), "rank", F.col("scene_id").alias("vec_id"), F.round(F.col("score").cast("double"), 6).alias("score"))


@plan(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM {SCORED} WHERE score > CAST(0.05 AS FLOAT))
        SELECT label, count(*)::INT AS scenes, string_agg(vec_id, ',' ORDER BY rank) AS ids FROM r WHERE rank <= 5 GROUP BY label"""
)
def search_media_nested_j02(spark, folder):
    rows = _vectors(spark, folder).withColumns({"start": F.lit(0.0), "end": F.lit(1.0), "preview": F.lit("")})
    nested = search.nested_results(search.search_media(rows, SearchRequest(_first(spark, folder), min_score=0.05, limit=100)))
    ids = F.array_join(F.transform("matched_scenes", lambda s: s["scene_id"].cast("string")), ",")
    return nested.select(F.col("media_id").alias("label"), F.size("matched_scenes").alias("scenes"), ids.alias("ids"))


@plan(
    f"""SELECT DISTINCT s.search_id, s.media_id, s.scene_id, s.start_sec FROM scene_results s JOIN {MEDIA} m USING (media_id)
        WHERE m.media_type = 'movie' AND m.release_year = 1999 AND list_contains(m.languages, 'en')"""
)
def search_filtered_p01_p02_p03_j01(spark, folder):
    request = SearchRequest((), media_type="movie", year=1999, language="en")
    found = search.scene_documents(table(spark, folder, "scene_results"), newest_media(spark, folder), request)
    return found.select("search_id", "media_id", "scene_id", "start_sec").distinct()


@plan(
    """WITH p AS (SELECT scene_id, list(DISTINCT person_id) AS persons FROM scene_people GROUP BY scene_id), top AS (SELECT person_id FROM scene_people GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)
       SELECT scene_id, len(persons)::INT AS persons FROM p WHERE list_has_any(persons, (SELECT list(person_id) FROM top))"""
)
def search_persons_p04_p05(spark, folder):
    people = table(spark, folder, "scene_people")
    top = [r["person_id"] for r in people.groupBy("person_id").count().orderBy(F.desc("count"), "person_id").limit(3).collect()]
    scenes = people.groupBy("scene_id").agg(F.collect_set("person_id").alias("person_ids"))
    for condition in search.scene_filter(SearchRequest((), person_ids=top)):
        scenes = scenes.filter(condition)
    return scenes.select("scene_id", F.size("person_ids").alias("persons"))


_TWO_LENGTHS = f"""(SELECT vec_id, label, score FROM {SCORED} WHERE label % 2 = 1 AND vec_id % 3 <> 0 AND score > CAST(0.05 AS FLOAT))"""


def _mixed(spark, folder):
    """Scenes of two models, of which every third has a vector of half the length."""
    rows = _vectors(spark, folder)
    return rows.withColumn("embedding", F.when(F.col("scene_id") % 3 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))


@plan(f"SELECT 'scene' AS mode, vec_id, label, round(CAST(score AS DOUBLE), 6) AS score FROM (SELECT * FROM {_TWO_LENGTHS} ORDER BY score DESC, vec_id LIMIT 100) UNION ALL SELECT 'media', vec_id, label, round(CAST(score AS DOUBLE), 6) FROM {_TWO_LENGTHS} QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 5")
def model_dim_guard_p07_p08(spark, folder):
    """Both searches compare only scenes of the query's model and length."""
    request = SearchRequest(_first(spark, folder), model="model-1", min_score=0.05, limit=100)
    found = [("scene", search.search_scenes(_mixed(spark, folder), request)), ("media", search.search_media(_mixed(spark, folder), request))]
    parts = [rows.select(F.lit(mode).alias("mode"), F.col("scene_id").alias("vec_id"), F.col("media_id").alias("label"), F.round(F.col("score").cast("double"), 6).alias("score")) for mode, rows in found]
    return parts[0].unionAll(parts[1])


@plan(f"SELECT asked::INT AS asked, least(CASE WHEN asked BETWEEN 1 AND 100 THEN asked ELSE 16 END, (SELECT count(*) FROM {SCORED} WHERE score > CAST(0.01 AS FLOAT)))::BIGINT AS results FROM (VALUES (-1), (0), (7), (100), (101)) AS v(asked)")
def search_limits_sl04(spark, folder):
    """How many scenes a search gives for limits within and beyond the bounds."""
    counts = []
    for asked in (-1, 0, 7, 100, 101):
        found = search.search_scenes(_vectors(spark, folder), SearchRequest(_first(spark, folder), min_score=0.01, limit=asked))
        counts.append(found.agg(F.count("*").alias("results")).select(F.lit(asked).alias("asked"), "results"))
    return functools.reduce(lambda a, b: a.unionAll(b), counts)


@plan("WITH p AS (SELECT scene_id, list(DISTINCT person_id) AS persons FROM scene_people GROUP BY scene_id) SELECT scene_id, len(persons)::INT AS persons FROM p WHERE list_contains(persons, (SELECT min(person_id) FROM scene_people WHERE person_id <> ''))")
def search_person_p04(spark, folder):
    """Scenes of one person."""
    people = table(spark, folder, "scene_people")
    one = people.filter("person_id <> ''").agg(F.min("person_id")).first()[0]
    scenes = people.groupBy("scene_id").agg(F.collect_set("person_id").alias("person_ids"))
    for condition in search.scene_filter(SearchRequest((), person_id=one or "")):
        scenes = scenes.filter(condition)
    return scenes.select("scene_id", F.size("person_ids").alias("persons"))


@plan("SELECT vec_id, label, row_number() OVER (ORDER BY label, vec_id)::INT AS place FROM embeddings")
def scan_sorted_p06_sl15(spark, folder):
    """The whole listing by media and scene."""
    scenes = _vectors(spark, folder).select("scene_id", "media_id")
    found = search.scene_documents(scenes, scenes.select("media_id").distinct(), SearchRequest(()))
    return search.listing(found, ["media_id", "scene_id"]).select(F.col("scene_id").alias("vec_id"), F.col("media_id").alias("label"), F.col("place").cast("int").alias("place"))


@plan(
    """SELECT media_id, n AS scene, CASE WHEN n % 3 = 0 THEN 0.0 ELSE n * 10.5 END AS preview_time FROM (SELECT DISTINCT media_id, i AS n FROM videos, range(0, 4) AS r(i))"""
)
def preview_backfill_j21(spark, folder):
    base = table(spark, folder, "videos").select("media_id").distinct()
    sources = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.struct(i.alias("scene_index"), (i * 10.5).alias("sample_timestamp")))
    media = base.withColumn("metadata", F.to_json(F.struct(sources.alias("frame_extraction_sources"))))
    scenes = base.withColumn("scene", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        "media_id", F.col("scene").cast("long").alias("scene"), F.lit("").alias("preview_path"), F.format_string("/frames/frame-%06d.jpg", F.col("scene") + 1).alias("preview"), F.lit(0.0).alias("preview_time")
    )
    return search.with_preview_times(scenes, media).select("media_id", "scene", "preview_time")


@plan(
    """WITH m AS (SELECT DISTINCT media_id, lower(trim(CASE WHEN media_id > '8' THEN fingerprint END)) AS print, '/v/' || video_name AS path FROM videos),
       w AS (SELECT DISTINCT request_id, lower(trim(source_fingerprint)) AS print, '/v/' || source_name AS path FROM requests)
       SELECT w.request_id, coalesce((SELECT min(media_id) FROM m WHERE m.print = w.print AND m.print <> ''), (SELECT min(media_id) FROM m WHERE m.print IS NULL AND m.path = w.path)) AS media_id FROM w"""
)
def fingerprint_lookup_j20(spark, folder):
    videos = table(spark, folder, "videos").select("media_id", "fingerprint", "video_name").distinct()
    keyed = F.when(F.col("media_id") > "8", F.col("fingerprint"))
    media = videos.select("media_id", F.to_json(F.struct(keyed.alias("content_fingerprint"), F.concat(F.lit("/v/"), "video_name").alias("local_path"))).alias("metadata"))
    wanted = table(spark, folder, "requests").select("request_id", F.col("source_fingerprint").alias("fingerprint"), F.concat(F.lit("/v/"), "source_name").alias("local_path")).distinct()
    return search.by_fingerprint(media, wanted).select("request_id", "media_id")


@plan("SELECT (SELECT count(DISTINCT media_id) FROM media) AS media, (SELECT count(DISTINCT scene_id) FROM scene_results) AS scenes, (SELECT count(DISTINCT vector_id) FROM face_vectors) AS vectors")
def stats_p34_ag03(spark, folder):
    counted = (("media", "media_id", "media"), ("scene_results", "scene_id", "scenes"), ("face_vectors", "vector_id", "vectors"))
    counts = [table(spark, folder, name).agg(F.countDistinct(column).alias("n")).select(F.lit(label).alias("what"), "n") for name, column, label in counted]
    return counts[0].unionAll(counts[1]).unionAll(counts[2]).agg(*(F.max(F.when(F.col("what") == label, F.col("n"))).alias(label) for _, _, label in counted))


_COARSE = "(SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 1)) AS b FROM embeddings)"


@plan(
    f"""WITH s AS (SELECT list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] * b[i])) / (sqrt(list_sum(list_transform(a, lambda x: x * x))) * sqrt(list_sum(list_transform(b, lambda x: x * x)))) AS s FROM {_COARSE})
        SELECT count(*) AS samples, round(avg(s), 6) AS cosine_mean, round(min(s), 6) AS cosine_min, round(max(s), 6) AS cosine_max, round(1 - avg(s), 6) AS drift_mean, round(1 - min(s), 6) AS drift_max, CASE WHEN min(s) >= 0.995 THEN 'compressed' ELSE 'original' END AS recommendation FROM s"""
)
def vector_drift_ag15(spark, folder):
    """Each vector beside its coarse form, which is what another profile would give."""
    original = table(spark, folder, "embeddings").select("vec_id", "embedding")
    coarse = original.select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 1)).alias("coarse"))
    report = reports.drift_report(original.join(coarse, "vec_id"), "embedding", "coarse")
    return report.select(*(F.round(c, 6).alias(c) if c.startswith(("cosine", "drift")) else c for c in report.columns))


@plan()
def hash_search_u01_u08(spark, folder):
    """Documents searched by a text, both embedded by the same hash."""
    query = spark.range(1).select(vectors.hashed_texts(F.lit("the winter garden")).alias("v")).first()["v"]
    rows = table(spark, folder, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("scene_id"), vectors.hashed_texts(F.col("text")).alias("embedding"))
    return search.search_scenes(rows, SearchRequest(query, min_score=0.1)).select(F.col("scene_id").alias("doc_id"), F.round(F.col("score").cast("double"), 5).alias("score"))
