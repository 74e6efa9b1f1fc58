"""Queries over containers, file listings, captured credits, and resolution tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinomill.functions import byteranges
from kinomill.operators import credits, resolve
from kinomill.plans import blobs
from kinomill.plans.catalog import TITLES, _alternates, _titles
from kinomill.plans.registry import Registry
from kinomill.sources import containers, files
from kinomill.tables import table

plan = Registry()
QUERIES, ORACLES = plan.queries, plan.oracles


#: What counts as a video by its extension, in SQL.
_VIDEO = "('.mp4', '.mkv', '.mov', '.avi', '.webm', '.m4v', '.ts', '.flv', '.wmv', '.mpeg', '.mpg', '.3gp', '.rmvb')"
#: Endings that file names are given in turn, so that every extension comes up, also in capitals and in the middle.
_ENDINGS = ("", ".3gp", ".RMVB", ".txt", ".mp4.part", ".", ".webm", ".Mpeg")


@plan(
    f"""WITH v AS (SELECT DISTINCT media_id, video_name || list_extract({list(_ENDINGS)}, 1 + length(video_name) % 8) AS name, CASE WHEN length(video_name) % 7 = 0 THEN ' Video ' END AS category,
          CASE WHEN length(video_name) % 5 = 0 THEN ' VIDEO/x' ELSE 'text/plain' END AS mime, CASE WHEN length(video_name) % 6 = 0 THEN ' .rmvb' WHEN length(video_name) % 6 = 1 THEN '.txt' ELSE ' ' END AS ext FROM videos)
        SELECT media_id, name, lower(regexp_extract(name, '(\\.[^./]*)$', 1)) IN {_VIDEO} AS by_name,
          coalesce(lower(trim(category)) = 'video', false) OR starts_with(lower(trim(mime)), 'video/') OR CASE WHEN trim(ext) <> '' THEN lower(trim(ext)) ELSE lower(regexp_extract(name, '(\\.[^./]*)$', 1)) END IN {_VIDEO} AS video FROM v"""
)
def video_names_io15_p27(spark, folder):
    n = F.length("video_name")
    rows = table(spark, folder, "videos").select("media_id", "video_name").distinct().select(
        "media_id",
        F.concat("video_name", F.get(F.array(*map(F.lit, _ENDINGS)), n % 8)).alias("name"),
        F.when(n % 7 == 0, " Video ").alias("category"),
        F.when(n % 5 == 0, " VIDEO/x").otherwise("text/plain").alias("mime"),
        F.when(n % 6 == 0, " .rmvb").when(n % 6 == 1, ".txt").otherwise(" ").alias("ext"),
    )
    video = files.is_video(F.col("name"), F.col("category"), F.col("mime"), F.col("ext"))
    return rows.select("media_id", "name", files.is_video(F.col("name")).alias("by_name"), video.alias("video"))


@plan(
    f"""SELECT problem, count(*) AS files FROM (SELECT CASE WHEN size_bytes IS NULL THEN 'missing' WHEN size_bytes <= 0 THEN 'empty' WHEN lower(regexp_extract(coalesce(video_name, ''), '(\\.[^./]*)$', 1)) NOT IN {_VIDEO} THEN 'not a video' END AS problem
        FROM (SELECT DISTINCT media_id, video_name, CASE WHEN length(video_name) % 9 = 0 THEN 0 WHEN length(video_name) % 9 = 1 THEN NULL ELSE size_bytes END AS size_bytes FROM videos)) GROUP BY problem"""
)
def inspected_io16(spark, folder):
    n = F.length("video_name")
    size = F.when(n % 9 == 0, 0).when(n % 9 == 1, None).otherwise(F.col("size_bytes"))
    rows = table(spark, folder, "videos").select("media_id", "video_name", size.alias("size_bytes")).distinct()
    return files.readable(rows, "video_name", "size_bytes").groupBy("problem").agg(F.count("*").alias("files"))


@plan(
    """SELECT DISTINCT request_id::VARCHAR AS file_id, 3 AS depth FROM requests WHERE drive_id IS NOT NULL UNION ALL SELECT DISTINCT request_id::VARCHAR, 2 FROM requests WHERE drive_id IS NULL AND batch_no IS NOT NULL"""
)
def tree_walk_io18(spark, folder):
    """Requests as files below their drive below their batch; a folder that holds its own ancestor is entered once."""
    rows = table(spark, folder, "requests").select("request_id", "batch_no", "drive_id").distinct()
    batch, drive = F.concat(F.lit("b"), F.col("batch_no").cast("string")), F.concat_ws("/", F.col("batch_no").cast("string"), "drive_id")
    batches = rows.filter("batch_no IS NOT NULL").select(batch.alias("file_id"), F.lit("root").alias("parent_file_id"), F.lit(True).alias("is_folder"))
    drives = rows.filter("drive_id IS NOT NULL").select(drive.alias("file_id"), batch.alias("parent_file_id"), F.lit(True).alias("is_folder"))
    cycle = rows.filter("drive_id IS NOT NULL").select(batch.alias("file_id"), drive.alias("parent_file_id"), F.lit(True).alias("is_folder"))
    leaves = rows.select(F.col("request_id").cast("string").alias("file_id"), F.when(F.col("drive_id").isNull(), batch).otherwise(drive).alias("parent_file_id"), F.lit(False).alias("is_folder"))
    listing = batches.unionAll(drives).unionAll(cycle).unionAll(leaves).distinct()
    return files.tree_of(listing, "root").select("file_id", "depth")


@plan("SELECT media_id, CASE WHEN size_bytes % 3 = 0 THEN 'mp4' WHEN size_bytes % 3 = 1 THEN 'matroska' END AS kind FROM (SELECT DISTINCT media_id, size_bytes FROM videos WHERE size_bytes IS NOT NULL)")
def sniffed_io27(spark, folder):
    rows = table(spark, folder, "videos").filter("size_bytes IS NOT NULL").select("media_id", "size_bytes").distinct()
    header = F.unhex(F.get(F.array(F.lit("000000186674797069736F6D"), F.lit("1A45DFA3A3428681"), F.lit("52494646")), (F.col("size_bytes") % 3).cast("int")))
    return rows.select("media_id", byteranges.container_kind(header).alias("kind"))


@plan("SELECT DISTINCT media_id, round(duration_sec, 3) AS duration, 'h264' AS codec FROM media WHERE duration_sec IS NOT NULL")
def probe_io22(spark, folder):
    rows = table(spark, folder, "media").filter("duration_sec IS NOT NULL").select("media_id", "duration_sec").distinct()
    streams = F.array(F.struct(F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name")), F.struct(F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name")))
    probe = F.to_json(F.struct(F.struct(F.round("duration_sec", 3).cast("string").alias("duration")).alias("format"), streams.alias("streams")))
    return rows.select("media_id", containers.probed(probe).alias("p")).select("media_id", "p.duration", "p.codec")


def _contents(spark, folder):
    """Five files, of which a video has one by the length of its name; the last is none."""
    rows = table(spark, folder, "videos").select("media_id", (F.length("video_name") % 5).alias("n")).distinct()
    kinds = [blobs.mp4((1, 4)), blobs.mp4(None), blobs.matroska(False), blobs.matroska(True), b"no container"]
    return rows.withColumn("content", F.get(F.array(*(F.lit(bytearray(k)) for k in kinds)), F.col("n")))


_VIDEOS = "(SELECT DISTINCT media_id, length(video_name) % 5 AS n FROM videos)"


@plan(
    f"""SELECT media_id, number::INT AS number, seconds::DOUBLE AS seconds, byte::BIGINT AS "offset", size::BIGINT AS size FROM {_VIDEOS} JOIN (VALUES (0, 1, 0.0, 600, 40), (0, 2, 4.5, 9000, 10),
          (1, 1, 0.0, 600, 40), (1, 2, 1.5, 640, 30), (1, 3, 3.0, 670, 20), (1, 4, 4.5, 9000, 10), (2, 1, 0.0, 139, 5), (2, 2, 5.0, 169, 7), (3, 1, 0.0, 165, 5), (3, 2, 5.0, 195, 7)) AS e(n, number, seconds, byte, size) USING (n)"""
)
def entry_pictures_io23_io26_x06(spark, folder):
    """Where the entry pictures of MP4 and Matroska files lie, laced blocks, groups and cues without a place among them."""
    rows = _contents(spark, folder).select("media_id", F.posexplode(containers.entry_pictures(F.col("content"))).alias("i", "k"))
    return rows.select("media_id", (F.col("i") + 1).alias("number"), "k.seconds", "k.offset", "k.size")


@plan(
    f"""SELECT media_id, (CASE WHEN n IN (2, 3) THEN 2 ELSE 0 END)::INT AS tracks, CASE WHEN n IN (2, 3) THEN 'V_TEST 640x360' END AS video, (CASE WHEN n IN (2, 3) THEN 7.5 ELSE 0 END)::DOUBLE AS seconds, (CASE WHEN n IN (2, 3) THEN 2 ELSE 0 END)::INT AS cues FROM {_VIDEOS}"""
)
def matroska_index_io25_f46(spark, folder):
    """Tracks, cues and the duration, a floating point number, of Matroska files; other files have none."""
    rows = _contents(spark, folder)
    tracks = containers.tracks(F.col("content"))
    video = F.get(F.filter(tracks, lambda t: t["kind"] == 1), F.lit(0))
    name = F.when(video.isNotNull(), F.concat(video["codec"], F.lit(" "), video["width"].cast("string"), F.lit("x"), video["height"].cast("string")))
    return rows.select("media_id", F.size(tracks).alias("tracks"), name.alias("video"), containers.seconds(F.col("content")).alias("seconds"), F.size(containers.cue_points(F.col("content"))).alias("cues"))


@plan("SELECT media_id, scenes, first_start FROM (SELECT media_id, count(*) AS scenes, min(start_sec) AS first_start, bool_and(start_sec * 100 + 10 <= 100000) AS ok FROM (SELECT DISTINCT media_id, start_sec FROM scene_results) GROUP BY media_id) WHERE ok")
def sound_index_io28(spark, folder):
    starts = table(spark, folder, "scene_results").select("media_id", "start_sec").distinct()
    picture = F.struct((F.col("start_sec") * 100).alias("offset"), F.lit(10).alias("size"), F.col("start_sec"))
    index = starts.groupBy("media_id").agg(F.collect_list(picture).alias("keyframes")).withColumn("file_size", F.lit(100000))
    sound = containers.sound_index(index, "file_size")
    return sound.select("media_id", F.size("keyframes").cast("bigint").alias("scenes"), F.array_min(F.transform("keyframes", lambda k: k["start_sec"])).alias("first_start"))


@plan(
    """SELECT media_id AS title_id, person, billing_order::INT AS billing_order FROM (SELECT media_id, person_id AS person, row_number() OVER (PARTITION BY media_id ORDER BY person_id) - 1 AS billing_order FROM (SELECT DISTINCT media_id, person_id FROM scene_people))
       WHERE billing_order < 40"""
)
def credits_p11_p12(spark, folder):
    rows = table(spark, folder, "scene_people").select("media_id", "person_id").distinct()
    member = F.struct(F.lit(7).alias("id"), F.col("person_id").alias("name"))
    captured = rows.groupBy(F.col("media_id").alias("title_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("person_id"), member.alias("m")))).alias("c"))
    captured = captured.select("title_id", F.to_json(F.struct(F.transform("c", lambda x: x["m"]).alias("cast"))).alias("json"))
    cast = credits.cast_rows(captured, most=40)
    return cast.select("title_id", F.col("name").alias("person"), "billing_order")


@plan(
    """SELECT label AS person, vec_id, 'https://images.example/w500/' || vec_id || '.jpg' AS source_url, 'person-image:tmdb:' || label || ':' || substr(sha256(label || ':/' || vec_id || '.jpg'), 1, 16) AS image_id FROM embeddings"""
)
def portraits_p13(spark, folder):
    rows = table(spark, folder, "embeddings").select(F.col("label").alias("person"), "vec_id", F.concat(F.lit("/"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("path"))
    captured = rows.groupBy("person").agg(F.to_json(F.struct(F.concat(F.collect_list(F.struct(F.col("path").alias("file_path"))), F.array(F.struct(F.lit(" ").alias("file_path")))).alias("profiles"))).alias("json"))
    found = credits.portraits(captured, "https://images.example/")
    return found.select("person", F.regexp_extract("source_url", r"/([0-9]+)\.jpg$", 1).cast("bigint").alias("vec_id"), "source_url", "image_id")


def _media(spark, folder):
    rows = table(spark, folder, "media").groupBy("media_id").agg(F.max_by(F.struct("movie_id", "title", "original_title", "release_year"), "updated_at").alias("m")).select("media_id", "m.*")
    return rows.select("media_id", "movie_id", "title", "original_title", F.lit("").alias("remote_name"), F.col("release_year").alias("year"))


@plan()
def media_resolution_j15_f23(spark, folder):
    return resolve.resolve(_media(spark, folder), _titles(spark, folder), _alternates(spark, folder))


@plan()
def processed_titles_j22(spark, folder):
    return resolve.processed_titles(_media(spark, folder), table(spark, folder, "scene_results"), _titles(spark, folder), _alternates(spark, folder))


@plan(
    f"""SELECT t.title_id, coalesce(nullif(a.title, ''), t.primary_title) AS title, coalesce(t.start_year, 0) AS year FROM {TITLES} t LEFT JOIN (SELECT title_id, min_by(title, aka_no) AS title FROM title_akas WHERE lang = 'fr' AND title IS NOT NULL GROUP BY 1) a ON a.title_id = t.title_id"""
)
def overriding_merge_m04_m05(spark, folder):
    """French names over the catalogue's where they are given; the catalogue keeps ids and years."""
    from kinomill.operators.catalog import merge_rows

    existing = _titles(spark, folder).select("title_id", "title", F.coalesce("year", F.lit(0)).alias("year"))
    french = table(spark, folder, "title_akas").filter("lang = 'fr' AND title IS NOT NULL").groupBy("title_id").agg(F.min_by("title", "aka_no").alias("title"))
    incoming = french.join(existing.select("title_id"), "title_id", "left_semi").withColumn("year", F.lit(None).cast("int"))
    return merge_rows(existing, incoming, "title_id", {"title": "text", "year": "given"})
