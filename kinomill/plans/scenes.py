"""Queries over faces, timelines and byte intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinomill.functions import timeline as tl
from kinomill.functions import vectors
from kinomill.operators import faces, intervals, reports, timeline
from kinomill.plans.registry import Registry
from kinomill.tables import table

plan = Registry()
QUERIES, ORACLES = plan.queries, plan.oracles

FACES = """(SELECT vector_id, any_value(person_id) AS person_id, any_value(image_id) AS image_id, any_value(scene_id) AS scene_id, any_value(quality) AS quality, any_value(vector) AS vector FROM face_vectors
    WHERE model = 'face-a' AND len(vector) = 128 AND list_sum(list_transform(vector, lambda x: CASE WHEN x IS NULL OR isnan(x) THEN 1 ELSE 0 END)) = 0 AND list_sum(list_transform(vector, lambda x: abs(x))) > 0 GROUP BY vector_id)"""
COS = """CAST(greatest(-1, least(1, list_sum(list_transform(range(1, 129), lambda i: CAST(CAST({0}[i] * {1}[i] AS FLOAT) AS DOUBLE)))
    / sqrt(list_sum(list_transform({0}, lambda x: CAST(CAST(x * x AS FLOAT) AS DOUBLE))) * list_sum(list_transform({1}, lambda x: CAST(CAST(x * x AS FLOAT) AS DOUBLE)))))) AS FLOAT)"""


def _faces(spark, folder):
    rows = table(spark, folder, "face_vectors").filter("model = 'face-a' AND size(vector) = 128")
    rows = rows.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("vector", lambda x: x != 0))
    return rows.dropDuplicates(["vector_id"])


def _scene_faces(spark, folder):
    """Faces cut from scenes, with the media of the scene."""
    where = table(spark, folder, "scene_people").select("scene_id", "media_id").distinct()
    cut = _faces(spark, folder).filter("scene_id IS NOT NULL").join(where, "scene_id")
    return cut.select(F.col("vector_id").alias("face_id"), "scene_id", "media_id", F.col("vector").alias("embedding"), F.col("quality").alias("det_score"))


def _references(spark, folder):
    return _faces(spark, folder).filter("person_id <> '' AND image_id IS NOT NULL").select("vector_id", "person_id", "quality", "vector")


def _cast(spark, folder):
    return table(spark, folder, "scene_people").select("media_id", "person_id").distinct()


def _faces_and_references(spark, folder):
    """Eligible faces of scenes, and the references of the casts of their media."""
    found = faces.eligible_faces(_scene_faces(spark, folder))
    cast = _cast(spark, folder).join(found.select("media_id").distinct(), "media_id", "left_semi")
    return found, faces.first_references(_references(spark, folder)).join(cast, "person_id")


REFS = f"(SELECT * FROM {FACES} WHERE person_id <> '' AND image_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY quality DESC, vector_id) <= 10)"
SCORES = f"""(SELECT face_id, scene_id, person_id, CAST(list_sum(s) / len(s) AS FLOAT) AS score FROM (SELECT face_id, scene_id, person_id, list(CAST(s AS DOUBLE) ORDER BY s DESC)[1:3] AS s FROM (
    SELECT f.vector_id AS face_id, f.scene_id, r.person_id, {COS.format('f.vector', 'r.vector')} AS s FROM (SELECT vector_id, scene_id, vector, quality FROM {FACES}) f JOIN (SELECT DISTINCT scene_id, media_id FROM scene_people) w USING (scene_id)
    JOIN (SELECT DISTINCT media_id, person_id FROM scene_people) c USING (media_id) JOIN {REFS} r USING (person_id) WHERE f.quality >= CAST(0.6 AS FLOAT)) GROUP BY ALL))"""


@plan("SELECT person_id, vector_id FROM " + REFS)
def first_n_per_person_wf04_j14(spark, folder):
    return faces.first_references(_references(spark, folder)).select("person_id", "vector_id")


@plan(f"SELECT vector_id FROM {FACES} WHERE quality >= CAST(0.6 AS FLOAT)")
def eligible_faces_p17(spark, folder):
    rows = _faces(spark, folder).select("vector_id", F.col("vector").alias("embedding"), F.col("quality").alias("det_score"))
    return faces.eligible_faces(rows).select("vector_id")


@plan(f"SELECT face_id, scene_id, person_id, round(CAST(score AS DOUBLE), 4) AS score FROM {SCORES}")
def top3_mean_ag05_ag06_j13(spark, folder):
    scores = faces.person_scores(*_faces_and_references(spark, folder), "media_id")
    return scores.select("face_id", "scene_id", "person_id", F.round(F.col("score").cast("double"), 4).alias("score"))


@plan(
    f"""WITH r AS (SELECT *, row_number() OVER w AS n, coalesce(lead(score) OVER w, -1) AS second FROM {SCORES} WINDOW w AS (PARTITION BY face_id ORDER BY score DESC, person_id))
        SELECT scene_id, person_id, count(*) AS match_count, round(CAST(max(score) AS DOUBLE), 4) AS best_score FROM r WHERE n = 1 AND score >= CAST(0.3 AS FLOAT) AND score - second >= CAST(0.05 AS FLOAT) GROUP BY ALL"""
)
def face_match_wf03_p18_ag07_u13(spark, folder):
    scores = faces.person_scores(*_faces_and_references(spark, folder), "media_id", 2)
    people = faces.scene_people(faces.decided(scores, match=0.3))
    return people.select("scene_id", "person_id", "match_count", F.round(F.col("best_score").cast("double"), 4).alias("best_score"))


@plan(
    """WITH t AS (SELECT DISTINCT title_id, aka_no FROM title_akas), n AS (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY aka_no) - 1 AS i, count(*) OVER (PARTITION BY title_id) AS n FROM t)
       SELECT title_id, aka_no FROM n WHERE n <= 3 OR i IN ((0 * (n - 1)) // 2, (1 * (n - 1)) // 2, (2 * (n - 1)) // 2)"""
)
def even_spread_wf09_u11(spark, folder):
    rows = table(spark, folder, "title_akas").select("title_id", "aka_no").distinct()
    return faces.evenly_spread(rows, "title_id", ["aka_no"], 3)


@plan(
    """SELECT DISTINCT image_id FROM face_vectors f WHERE image_id IS NOT NULL AND model <> 'face-b' AND image_id NOT IN (SELECT image_id FROM face_vectors WHERE model = 'face-b' AND image_id IS NOT NULL)"""
)
def reference_candidates_p20_so03(spark, folder):
    images = table(spark, folder, "face_vectors").filter("image_id IS NOT NULL AND model <> 'face-b'").select("image_id", F.lit("/p").alias("source_url"), F.lit("").alias("local_path"), F.lit("pending").alias("status"))
    taken = table(spark, folder, "face_vectors").filter("model = 'face-b' AND image_id IS NOT NULL")
    return faces.reference_candidates(images, taken).select("image_id").distinct()


#: Detections of each portrait: as many faces as the last digit of its quality modulo three, the first of them with that quality.
_DETECTED = """(SELECT image_id, max(quality) AS q, count(*) % 3 + 1 AS faces, length(image_id) % 5 = 0 AS failed FROM face_vectors WHERE image_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1)"""


@plan(
    f"""WITH v AS (SELECT DISTINCT image_id FROM face_vectors WHERE model = 'face-b' AND image_id IS NOT NULL), s AS (SELECT d.image_id, CASE WHEN v.image_id IS NOT NULL THEN 'skipped' WHEN failed THEN 'failed' WHEN faces = 1 AND q >= CAST(0.6 AS FLOAT) THEN 'ready' ELSE 'rejected' END AS status
        FROM {_DETECTED} d LEFT JOIN v USING (image_id)) SELECT image_id, status, status IN ('skipped', 'ready') AS has_vector FROM s"""
)
def ingestion_state_u10(spark, folder):
    """Portraits after ingestion, and whether each has a vector then."""
    rows = table(spark, folder, "face_vectors").filter("image_id IS NOT NULL")
    images = rows.filter("quality IS NOT NULL").groupBy("image_id").agg(F.max("quality").alias("q"), (F.count("*") % 3 + 1).cast("int").alias("n"))
    found = images.select("image_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"), "q").select("image_id", F.when(F.col("i") == 1, F.col("q")).otherwise(0.7).cast("float").alias("score"), F.array(F.lit(1.0).cast("float")).alias("vector"))
    failed = images.filter(F.length("image_id") % 5 == 0)
    old = rows.filter("model = 'face-b'").groupBy("image_id").agg(F.first("vector").alias("vector"))
    state, vectors_after = reports.ingested(images, old, found, failed, 0.6)
    return reports.with_flag(state, vectors_after, "image_id", "has_vector").select("image_id", "status", "has_vector")


@plan(
    f"""WITH c AS (SELECT DISTINCT person_id FROM scene_people WHERE person_id <> ''), v AS (SELECT DISTINCT person_id FROM face_vectors WHERE model = 'face-b'), l AS (SELECT DISTINCT person_id FROM face_vectors WHERE quality > 0.9),
        i AS (SELECT DISTINCT person_id, image_id FROM face_vectors WHERE image_id IS NOT NULL), p AS (SELECT person_id FROM c ANTI JOIN v USING (person_id) ANTI JOIN l USING (person_id)),
        n AS (SELECT person_id, image_id, row_number() OVER (PARTITION BY person_id ORDER BY image_id) - 1 AS i, count(*) OVER (PARTITION BY person_id) AS n FROM i SEMI JOIN p USING (person_id))
        SELECT person_id, image_id FROM n WHERE n <= 2 OR i IN (0, n - 1)"""
)
def wanted_references_u11(spark, folder):
    """Two portraits at most of people of the cast without a vector and without listed portraits."""
    rows = table(spark, folder, "face_vectors")
    cast = table(spark, folder, "scene_people").filter("person_id <> ''")
    images = rows.filter("image_id IS NOT NULL").select("person_id", "image_id").distinct().withColumn("place", F.lit(0))
    return reports.wanted_references(cast, rows.filter("model = 'face-b'"), images, rows.filter("quality > 0.9"), 2).select("person_id", "image_id")


@plan("SELECT DISTINCT vector_id, image_id IN (SELECT image_id FROM face_vectors WHERE person_id <> '' AND image_id IS NOT NULL) AS has_vector FROM face_vectors WHERE image_id IS NOT NULL")
def has_vector_flag_j19(spark, folder):
    rows = table(spark, folder, "face_vectors").filter("image_id IS NOT NULL")
    return reports.with_flag(rows, rows.filter("person_id <> ''"), "image_id", "has_vector").select("vector_id", "has_vector").distinct()


#: Microseconds since 1970 of a time without a zone.
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"

BOUNDS = "(SELECT user_id, list_sort(list(value)) AS v FROM events WHERE value > 0.25 AND value < 49.95 GROUP BY user_id)"


def _boundaries(spark, folder):
    """A timeline of 50 seconds for each user, with the values of the user's events as boundaries."""
    return table(spark, folder, "events").groupBy("user_id").agg(F.collect_list("value").alias("times"))


@plan(
    f"""WITH RECURSIVE b AS (SELECT user_id, unnest(v) AS t FROM {BOUNDS}), g AS (SELECT user_id, min(t) AS t FROM b GROUP BY user_id
        UNION ALL SELECT g.user_id, (SELECT min(b.t) FROM b WHERE b.user_id = g.user_id AND b.t - g.t >= 0.5) FROM g WHERE g.t IS NOT NULL)
        SELECT user_id, t FROM g WHERE t IS NOT NULL"""
)
def greedy_gap_wf07_p24(spark, folder):
    kept = tl.spaced_boundaries(F.col("times"), F.lit(50.0))
    return _boundaries(spark, folder).select("user_id", F.explode(kept).alias("t"))


@plan(
    """WITH RECURSIVE b AS (SELECT user_id, value AS t FROM events WHERE value < 49.95), g AS (SELECT DISTINCT user_id, 0.0::DOUBLE AS t FROM events
       UNION ALL SELECT g.user_id, (SELECT min(b.t) FROM b WHERE b.user_id = g.user_id AND b.t > g.t + 0.5) FROM g WHERE g.t IS NOT NULL)
       SELECT user_id, t AS start, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), 50.0) AS "end" FROM g WHERE t IS NOT NULL"""
)
def scene_intervals_wf08(spark, folder):
    scenes = tl.scene_intervals(F.array_sort("times"), F.lit(50.0))
    return _boundaries(spark, folder).select("user_id", F.inline(scenes))


@plan(f"SELECT user_id, least(len(v), 31)::INT AS kept, v[least(len(v), 31)] AS last FROM {BOUNDS}")
def scene_cap_sl17(spark, folder):
    inside = F.array_sort(F.filter("times", lambda t: tl.is_boundary(t, F.lit(50.0))))
    first = tl.first_scenes(inside, 32)
    return _boundaries(spark, folder).filter(F.size(inside) > 0).select("user_id", F.size(first).alias("kept"), F.element_at(first, -1).alias("last"))


@plan(
    """WITH s AS (SELECT user_id, greatest(0, t - 10) AS a, least(432, t + 1) AS b FROM (SELECT user_id, (epoch_us(ts) / 1000000.0 - 1704067200) / 6000 AS t FROM events) WHERE t > 0.25 AND t < 431.95),
       m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s),
       n AS (SELECT *, sum(CASE WHEN p IS NULL OR a > p + 0.25 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b) AS g FROM m)
       SELECT user_id, round(min(a), 3) AS start, round(max(b), 3) AS "end" FROM n GROUP BY user_id, g"""
)
def gap_merge_wf06(spark, folder):
    t = ((F.expr(MICROS) / 1e6 - 1704067200) / 6000).alias("t")
    spans = timeline.refinement_windows(table(spark, folder, "events").select("user_id", t, F.lit(432.0).alias("duration")), "user_id")
    return spans.select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@plan(
    """SELECT p.event_id, coalesce((SELECT max_by(s.value, s.ts) FROM events s WHERE s.user_id = p.user_id AND s.event_type = 'view' AND s.ts <= p.ts),
       (SELECT min_by(s.value, s.ts) FROM events s WHERE s.user_id = p.user_id AND s.event_type = 'view')) AS keyframe FROM events p WHERE p.event_type = 'purchase'"""
)
def asof_keyframe_j09(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "user_id", F.expr(MICROS).alias("t"), "event_type", F.col("value").alias("keyframe"))
    found = timeline.as_of(rows.filter("event_type = 'purchase'").select("event_id", "user_id", "t"), rows.filter("event_type = 'view'"), "user_id", "t", "keyframe")
    return found.select("event_id", "keyframe")


@plan(
    """SELECT event_id, floor((epoch_us(ts) / 1000000.0 - 1704067200) / 324000)::INT AS "index" FROM events WHERE epoch_us(ts) / 1000000.0 - 1704067200 BETWEEN 0 AND 2591999.999"""
)
def range_join_j10_p25(spark, folder):
    t = F.expr(MICROS) / 1e6 - 1704067200
    points = table(spark, folder, "events").select("event_id", "user_id", t.alias("t"))
    parts = points.select("user_id").distinct().select("user_id", F.inline(tl.segments(F.lit(2592000.0), F.lit(8), F.lit(5.0))))
    return timeline.in_ranges(points, parts, "user_id", 324000.0).select("event_id", "index")


@plan(
    """SELECT o_orderkey, coalesce(sum(n) OVER w, 0)::BIGINT AS first, round(coalesce(sum(n * d) OVER w, 0) / 1000.0, 6) AS base FROM (SELECT o_orderkey, o_custkey, o_orderkey % 5 + 1 AS n, floor(o_totalprice)::BIGINT AS d FROM orders)
       WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def decode_times_wf10(spark, folder):
    runs = table(spark, folder, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 5 + 1).alias("count"), F.floor("o_totalprice").alias("delta"))
    return timeline.decode_times(runs, "o_custkey", "o_orderkey", F.lit(1000.0)).select("o_orderkey", "first", F.round("base", 6).alias("base"))


BLOCKS = "(SELECT user_id, event_id * 7 % 5000 AS s, event_id * 7 % 5000 + 40 + event_id % 60 AS e FROM events)"


def _blocks(spark, folder):
    start = F.col("event_id") * 7 % 5000
    return table(spark, folder, "events").select("user_id", start.alias("start"), (start + 40 + F.col("event_id") % 60).alias("end"))


def _requests(spark, folder):
    users = table(spark, folder, "events").select("user_id").distinct()
    return users.select("user_id", F.lit(1).alias("request"), F.lit(500).cast("bigint").alias("start"), F.lit(3000).cast("bigint").alias("end"))


_GAPS = f"""(WITH c AS (SELECT user_id, greatest(s, 500) AS s, least(e, 3000) AS e FROM {BLOCKS} WHERE e > 500 AND s < 3000 UNION ALL SELECT DISTINCT user_id, 3000, 3000 FROM events),
    r AS (SELECT *, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 500) AS p FROM c) SELECT user_id, p AS a, s AS b FROM r WHERE p < s)"""


@plan(f'SELECT user_id, a AS start, b AS "end" FROM {_GAPS}')
def interval_subtract_ar08_j26(spark, folder):
    return intervals.missing(_requests(spark, folder), _blocks(spark, folder), "user_id").select("user_id", "start", "end")


@plan(f"SELECT u.user_id, 2500 - coalesce(sum(b - a), 0)::BIGINT AS bytes, coalesce(sum(b - a), 0) = 0 AS complete FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN {_GAPS} g USING (user_id) GROUP BY u.user_id")
def coverage_ar08(spark, folder):
    return intervals.covered(_requests(spark, folder), _blocks(spark, folder), "user_id").drop("request")


@plan(f"SELECT user_id, count(*) AS blocks, sum(n)::BIGINT AS bytes FROM (SELECT user_id, e - s AS n FROM {BLOCKS} UNION ALL SELECT user_id, b - a FROM {_GAPS}) GROUP BY user_id")
def insert_clipped_ar08(spark, folder):
    rows = intervals.insert_clipped(_blocks(spark, folder), _requests(spark, folder), "user_id")
    return rows.groupBy("user_id").agg(F.count("*").alias("blocks"), F.sum(F.col("end") - F.col("start")).alias("bytes"))


@plan(
    """SELECT user_id, event_id FROM (SELECT user_id, event_id, sum(b) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n
       FROM (SELECT user_id, event_id, floor(value * 100)::BIGINT + 1 AS b FROM events)) WHERE t <= 20000 OR n = 1"""
)
def lru_evict_ar08_st13(spark, folder):
    blocks = table(spark, folder, "events").select("user_id", "event_id", F.col("event_id").alias("used"), F.col("event_id").alias("start"), (F.floor(F.col("value") * 100) + 1).alias("bytes"))
    return intervals.kept_by_recency(blocks, "user_id", 20000).select("user_id", "event_id")


_RENDITIONS = "(SELECT DISTINCT media_id, request_id AS place, list_extract(['UHD', 'FHD', 'HD', 'SD'], 1 + request_id::INT % 4) AS kind, CASE WHEN request_id % 3 = 0 THEN ' Finished' ELSE 'running' END AS state, drive_id FROM requests)"


@plan(f"SELECT drive_id, arg_min(place, (coalesce(nullif(list_position(['FHD', 'HD'], kind), 0), 3), place)) AS place FROM {_RENDITIONS} WHERE lower(trim(state)) = 'finished' AND drive_id IS NOT NULL GROUP BY drive_id")
def preferred_rendition_j27(spark, folder):
    """Of each drive the finished rendition that is preferred, else the first finished one."""
    n = F.col("request_id")
    rows = table(spark, folder, "requests").filter("drive_id IS NOT NULL").select(
        "drive_id", n.alias("place"), F.get(F.array(*map(F.lit, ("UHD", "FHD", "HD", "SD"))), (n % 4).cast("int")).alias("kind"), F.when(n % 3 == 0, " Finished").otherwise("running").alias("state")
    )
    return reports.preferred(rows, "drive_id", "kind", ["FHD", "HD"], "place", F.lower(F.trim("state")) == "finished").select("drive_id", "place")


_FRAMES = "(SELECT media_id, start_sec, CASE WHEN floor(start_sec)::BIGINT % 3 = 0 THEN 'keyframe' ELSE 'seek' END AS method, preview IS NULL AS failed FROM scene_results)"


@plan(
    f"""WITH k AS (SELECT media_id, method, count(*) AS frames FROM {_FRAMES} WHERE NOT failed GROUP BY ALL), f AS (SELECT media_id, count(*) FILTER (failed) AS failures FROM {_FRAMES} GROUP BY 1)
        SELECT media_id, method, coalesce(frames, 0) AS frames, failures FROM f LEFT JOIN k USING (media_id)"""
)
def extraction_summary_ag12(spark, folder):
    """Frames of scenes by the method they were taken with; a frame without preview has failed."""
    method = F.when(F.floor("start_sec") % 3 == 0, "keyframe").otherwise("seek")
    frames = table(spark, folder, "scene_results").select("media_id", method.alias("method"), F.when(F.col("preview").isNull(), "no preview").alias("error"))
    return reports.extraction_summary(frames, "media_id")


@plan("SELECT user_id, count(*) AS keyframes, arg_min(event_id * 100, event_id) AS first_offset, arg_max(event_id * 100 + event_id % 50, event_id) AS last_end FROM events GROUP BY user_id")
def index_summary_ag13(spark, folder):
    """Events of a user as key frames of a file."""
    rows = table(spark, folder, "events").select("user_id", F.col("event_id").alias("number"), (F.col("event_id") * 100).alias("offset"), (F.col("event_id") % 50).alias("size"))
    return reports.index_summary(rows, "user_id")


@plan(
    """WITH f AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_custkey * 50 END AS size FROM customer), r AS (SELECT user_id, count(*) AS requests, sum(event_id % 7 * 100)::BIGINT AS bytes, count(DISTINCT event_id % 8) AS blocks FROM events GROUP BY 1)
       SELECT f.user_id, coalesce(requests, 0) AS requests, coalesce(bytes, 0) AS bytes, coalesce(blocks, 0) AS blocks, round(CASE WHEN size > 0 THEN coalesce(bytes, 0) / size ELSE 0 END, 9) AS download_ratio FROM f LEFT JOIN r USING (user_id)"""
)
def range_stats_ag14(spark, folder):
    """Events of a user as range requests for a file of that user; some files are empty, some were never asked."""
    n = F.col("c_custkey")
    sizes = table(spark, folder, "customer").select(n.alias("user_id"), F.when(n % 10 == 0, 0).otherwise(n * 50).alias("size"))
    asked = table(spark, folder, "events").select("user_id", (F.col("event_id") % 7 * 100).alias("bytes"), (F.col("event_id") % 8).alias("block"))
    return reports.range_stats(asked, sizes, "user_id").withColumn("download_ratio", F.round("download_ratio", 9))


@plan("SELECT preview FROM (SELECT trim(preview) AS preview, min((search_id, media_id, scene_id)) AS place FROM scene_results WHERE trim(preview) <> '' GROUP BY 1) ORDER BY place, preview LIMIT 32")
def first_distinct_x16(spark, folder):
    """The first 32 different previews in the order of the index, as a comparison of profiles samples them."""
    return reports.first_distinct(table(spark, folder, "scene_results"), "preview", ["search_id", "media_id", "scene_id"], 32)


@plan(
    """SELECT vec_id, round(list_sum(list_transform(range(1, 64), lambda i: embedding[i] * embedding[i + 1])), 6) AS product FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings)"""
)
def inner_product_ag02(spark, folder):
    """The inner product of each vector with itself shifted by one, in double precision."""
    a, b = F.slice("embedding", 1, 63), F.slice("embedding", 2, 63)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    return table(spark, folder, "embeddings").select("vec_id", F.round(total, 6).alias("product"))
