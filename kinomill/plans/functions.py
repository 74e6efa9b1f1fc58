"""Queries that apply the function library to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinomill.functions import byteranges, numbers, text, timeline, vectors
from kinomill.plans.registry import SPACE, Registry, sql_normalized, sql_trim
from kinomill.tables import table

plan = Registry()
QUERIES, ORACLES = plan.queries, plan.oracles


def _loose(x: str) -> str:
    x = f"translate({x}, '{text.MARKED}', '{text.UNMARKED}')"
    for a, b in text.DOUBLE.items():
        x = f"replace({x}, '{a}', '{b}')"
    return sql_normalized(x)


def _clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '[^\\p{{L}}\\p{{Nd}}{SPACE}]', ' ', 'g'), '[{SPACE}]+', ' ', 'g'))"


def _titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "titles").dropDuplicates(["title_id"])


TITLES = "(SELECT DISTINCT * FROM titles)"
MEDIA = "(SELECT * FROM media QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY updated_at DESC) = 1)"
YEAR_SQL = text.YEAR_IN_NAME.replace("\\-", "-").replace("[ ._-\\[\\(]", "[ ._\\[\\(-]").replace("[ ._-\\]\\)]", "[ ._\\]\\)-]")


@plan(f"SELECT doc_id, {sql_normalized('text')} AS value FROM documents")
def normalize_f01(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.normalized(F.col("text")).alias("value"))


@plan(f"SELECT title_id, aka_no, {_loose('title')} AS value FROM (SELECT DISTINCT title_id, aka_no, title FROM title_akas)")
def normalize_loose_f02(spark, folder):
    akas = table(spark, folder, "title_akas").select("title_id", "aka_no", "title").distinct()
    return akas.select("title_id", "aka_no", text.loosely_normalized(F.col("title")).alias("value"))


@plan(f"SELECT media_id, {sql_trim('fingerprint')} AS value, coalesce({sql_trim('fingerprint')}, '') = '' AS blank FROM (SELECT DISTINCT media_id, fingerprint FROM videos)")
def trim_f03(spark, folder):
    rows = table(spark, folder, "videos").select("media_id", "fingerprint").distinct()
    value = text.trimmed(F.col("fingerprint"))
    return rows.select("media_id", value.alias("value"), (F.coalesce(value, F.lit("")) == "").alias("blank"))


@plan(r"SELECT line_no, CASE WHEN f[7] = '\N' THEN '' ELSE f[7] END AS value FROM (SELECT line_no, string_split(line, chr(9)) AS f FROM raw_title_basics) WHERE len(f) >= 9")
def missing_mark_f04(spark, folder):
    rows = table(spark, folder, "raw_title_basics").select("line_no", F.split("line", "\t", -1).alias("f")).filter(F.size("f") >= 9)
    return rows.select("line_no", text.present(F.get("f", F.lit(6))).alias("value"))


@plan(
    r"""SELECT line_no, CASE WHEN g IN ('\N', '') THEN 0 ELSE len(string_split(g, ',')) END::INT AS members,
        CASE WHEN g IN ('\N', '') THEN '' ELSE array_to_string(list_transform(string_split(g, ','), lambda x: trim(x)), '|') END AS value
        FROM (SELECT line_no, regexp_replace(f[9], '\r$', '') AS g FROM (SELECT line_no, string_split(line, chr(9)) AS f FROM raw_title_basics) WHERE len(f) = 9)"""
)
def comma_list_f05(spark, folder):
    rows = table(spark, folder, "raw_title_basics").select("line_no", F.split("line", "\t", -1).alias("f")).filter(F.size("f") == 9)
    members = text.comma_list(F.regexp_replace(F.get("f", F.lit(8)), "\r$", ""))
    return rows.select("line_no", F.size(members).alias("members"), F.array_join(members, "|").alias("value"))


@plan(
    f"""SELECT resolution_id, {_clean(f"regexp_replace(stem, '(?s)^(.*?){YEAR_SQL}.*$', '" + chr(92) + "1')")} AS title,
        TRY_CAST(regexp_extract(stem, '{YEAR_SQL}', 1) AS INT) AS year
        FROM (SELECT DISTINCT resolution_id, {sql_trim("regexp_replace(regexp_extract(file_name, '([^/]*)/*$', 1), '(?s)" + chr(92) + ".[^.]*$', '')")} AS stem FROM resolutions)"""
)
def filename_resolve_f06(spark, folder):
    rows = table(spark, folder, "resolutions").select("resolution_id", "file_name").distinct()
    return rows.select("resolution_id", text.resolved_name(F.col("file_name")).alias("r")).select("resolution_id", "r.title", "r.year")


@plan(f"SELECT media_id, {_clean('title')} AS value FROM {MEDIA}")
def clean_title_f07(spark, folder):
    return table(spark, folder, "media").groupBy("media_id").agg(F.max_by("title", "updated_at").alias("title")).select("media_id", text.clean_title(F.col("title")).alias("value"))


@plan(
    f"""SELECT title_id, 'movie:external:' || lower(title_id) AS external,
        'movie:local:' || substr(sha256('movie:' || lower({sql_trim('primary_title')}) || coalesce(':' || start_year, '')), 1, 16) AS local FROM {TITLES}"""
)
def entity_id_f08(spark, folder):
    none = F.lit(0)
    external = text.entity_id(F.lit("movie"), none, F.col("title_id"), F.col("primary_title"), F.col("start_year"))
    local = text.entity_id(F.lit("movie"), none, F.lit(""), F.col("primary_title"), F.col("start_year"))
    return _titles(spark, folder).select("title_id", external.alias("external"), local.alias("local"))


@plan("SELECT vec_id, 'person-image:tmdb:' || label || ':' || substr(sha256(label || ':/p/' || vec_id || '.jpg'), 1, 16) AS image_id FROM embeddings")
def profile_image_id_f09(spark, folder):
    path = F.concat(F.lit("/p/"), F.col("vec_id").cast("string"), F.lit(".jpg"))
    return table(spark, folder, "embeddings").select("vec_id", text.profile_image_id(F.col("label"), path).alias("image_id"))


@plan(
    """SELECT DISTINCT media_id, scene_id AS own_id, substr(sha256(media_id || ':' || printf('%.6f', start_sec) || ':' || printf('%.6f', end_sec) || ':' || coalesce(preview, '')), 1, 32) AS stable_id
       FROM scene_results WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL"""
)
def scene_id_f10(spark, folder):
    rows = table(spark, folder, "scene_results").filter("start_sec IS NOT NULL AND end_sec IS NOT NULL")
    stable = text.scene_id(F.col("media_id"), F.col("start_sec"), F.col("end_sec"), F.coalesce("preview", F.lit("")))
    return rows.select("media_id", F.col("scene_id").alias("own_id"), stable.alias("stable_id")).distinct()


@plan(
    f"""SELECT media_id, array_to_string(list_filter([title, original_title, description, array_to_string(tags, ' ')], lambda x: {sql_trim('x')} <> ''), ' ') AS value FROM {MEDIA}"""
)
def scene_text_f11(spark, folder):
    newest = table(spark, folder, "media").groupBy("media_id").agg(F.max_by(F.struct("title", "original_title", "description", "tags"), "updated_at").alias("m")).select("media_id", "m.*")
    parts = (F.col("title"), F.col("original_title"), F.col("description"), F.array_join("tags", " "))
    return newest.select("media_id", text.scene_text(*parts).alias("value"))


@plan(
    r"""SELECT doc_id, len(t)::INT AS tokens, md5(array_to_string(t, ' ')) AS digest FROM (
        SELECT doc_id, regexp_extract_all(x, '[a-z0-9]+') || s || list_transform(range(1, len(s)), lambda i: s[i] || s[i + 1]) || list_transform(range(1, len(s) - 1), lambda i: s[i] || s[i + 1] || s[i + 2]) AS t
        FROM (SELECT doc_id, lower(text) AS x, regexp_extract_all(lower(text), '[\x{4e00}-\x{9fff}]') AS s FROM documents WHERE text IS NOT NULL))"""
)
def tokens_f12(spark, folder):
    rows = table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", text.search_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@plan(
    """SELECT DISTINCT media_id, printf('%02d:%02d:%02d', floor(duration_sec / 3600)::BIGINT, floor(duration_sec / 60)::BIGINT % 60, floor(duration_sec)::BIGINT % 60) AS clock FROM media WHERE duration_sec IS NOT NULL"""
)
def timestamps_f13(spark, folder):
    return table(spark, folder, "media").filter("duration_sec IS NOT NULL").select("media_id", text.clock(F.col("duration_sec")).alias("clock")).distinct()


@plan(
    r"""SELECT preview, CASE WHEN n > 0 THEN n - 1 ELSE -1 END AS frame, uses FROM (
        SELECT preview, TRY_CAST(regexp_extract(regexp_extract(preview, '([^/\\]*)$', 1), '^frame-([+-]?[0-9]+)(?:\.|$)', 1) AS BIGINT) AS n, count(*) AS uses FROM scene_results GROUP BY preview)"""
)
def frame_index_f14(spark, folder):
    used = table(spark, folder, "scene_results").groupBy("preview").agg(F.count("*").alias("uses"))
    return used.select("preview", text.preview_frame_index(F.col("preview")).alias("frame"), "uses")


@plan("SELECT request_id, CASE WHEN coalesce(local_path, '') <> '' THEN local_path ELSE source_name END AS reference FROM (SELECT DISTINCT request_id, local_path, source_name FROM requests)")
def preview_reference_f15(spark, folder):
    rows = table(spark, folder, "requests").select("request_id", "local_path", "source_name").distinct()
    return rows.select("request_id", text.preview_reference(F.col("local_path"), F.col("source_name")).alias("reference"))


@plan(
    f"""SELECT request_id, CASE WHEN {sql_trim('p')} = '' THEN '' ELSE '/mnt/e' || replace(substr(p, 3), chr(92), '/') END AS mounted, p2 AS plain FROM (
        SELECT DISTINCT request_id, 'E:' || replace(local_path, '/', chr(92)) AS p, local_path AS p2 FROM requests WHERE local_path <> '')"""
)
def local_path_f16(spark, folder):
    rows = table(spark, folder, "requests").filter("local_path <> ''").select("request_id", "local_path").distinct()
    drive = F.concat(F.lit("E:"), F.replace("local_path", F.lit("/"), F.lit("\\")))
    doubled = F.concat(F.lit("/."), F.col("local_path"))
    return rows.select("request_id", text.normalized_path(drive).alias("mounted"), text.normalized_path(doubled).alias("plain"))


@plan("SELECT DISTINCT media_id, preview AS frame, '' AS remote FROM scene_results WHERE preview <> ''")
def frame_name_f17(spark, folder):
    rows = table(spark, folder, "scene_results").filter("preview <> ''").select("media_id", "preview").distinct()
    frame = F.concat(F.lit("/v1/frames/"), F.col("media_id"), F.lit("/"), F.replace("preview", F.lit("-"), F.lit("%2D")), F.lit("?size=small"))
    return rows.select("media_id", text.frame_file_name(frame).alias("frame"), text.frame_file_name(F.concat(F.lit("https://host/"), "preview")).alias("remote"))


@plan(f"SELECT media_id, CASE WHEN coalesce({sql_trim('original_title')}, '') <> '' THEN original_title WHEN coalesce({sql_trim('title')}, '') <> '' THEN title ELSE '' END AS value FROM (SELECT DISTINCT media_id, original_title, title FROM media)")
def first_present_f18(spark, folder):
    rows = table(spark, folder, "media").select("media_id", "original_title", "title").distinct()
    return rows.select("media_id", text.first_present(F.col("original_title"), F.col("title")).alias("value"))


@plan(
    f"""SELECT resolution_id, CASE WHEN v = '' THEN 'reference' ELSE v END AS value FROM (
        SELECT DISTINCT resolution_id, regexp_replace(regexp_replace({sql_trim('file_name')}, '[^\\p{{L}}\\p{{Nd}}_.-]', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS v FROM resolutions)"""
)
def safe_filename_f19(spark, folder):
    rows = table(spark, folder, "resolutions").select("resolution_id", "file_name").distinct()
    return rows.select("resolution_id", text.safe_file_name(F.col("file_name")).alias("value"))


@plan(f"SELECT title_id, CASE WHEN t = 'return to' THEN 0 WHEN starts_with(t, 'return to') THEN 1 ELSE 2 END AS rank FROM (SELECT title_id, {sql_normalized('primary_title')} AS t FROM {TITLES})")
def match_rank_f20(spark, folder):
    return _titles(spark, folder).select("title_id", text.match_rank(text.normalized(F.col("primary_title")), F.lit("return to")).alias("rank"))


_TOKENS = ("return", "river", "letters", "from")


@plan(
    f"""SELECT title_id, (CASE WHEN start_year = 1999 THEN 1000 ELSE 0 END
        + list_sum(list_transform([p, o], lambda v: CASE WHEN v = '' THEN 0 ELSE CASE WHEN v = 'return' THEN 500 ELSE 0 END + CASE WHEN starts_with(v, 'return') THEN 10 ELSE 0 END + CASE WHEN contains(v, 'return') THEN 6 ELSE 0 END END))
        + list_sum(list_transform(['return', 'river', 'letters'], lambda t: CASE WHEN contains(np, t) OR contains(n_o, t) THEN 100 + len(t) ELSE 0 END)))::INT AS score
        FROM (SELECT title_id, start_year, {_loose("coalesce(primary_title, '')")} AS p, {_loose("coalesce(original_title, '')")} AS o, {sql_normalized("coalesce(primary_title, '')")} AS np,
              {sql_normalized("coalesce(original_title, '')")} AS n_o FROM {TITLES})"""
)
def hint_score_f21(spark, folder):
    tokens = F.array(*map(F.lit, _TOKENS))
    same = F.coalesce(F.col("start_year") == 1999, F.lit(False))
    return _titles(spark, folder).select("title_id", text.hint_score(F.col("primary_title"), F.col("original_title"), F.lit("Return"), tokens, same).alias("score"))


@plan(f"SELECT title_id, {_loose('primary_title')} = {_loose('original_title')} AS same FROM {TITLES}")
def canonical_title_f22(spark, folder):
    return _titles(spark, folder).select("title_id", (text.loosely_normalized(F.col("primary_title")) == text.loosely_normalized(F.col("original_title"))).alias("same"))


@plan(
    f"""SELECT title_id, array_to_string(list_distinct_ordered, '|') AS variants FROM (
        SELECT title_id, CASE WHEN x = lower(x) AND x = c THEN [x] WHEN x = lower(x) THEN [x, c] WHEN x = c OR c = lower(x) THEN [x, lower(x)] ELSE [x, lower(x), c] END AS list_distinct_ordered
        FROM (SELECT title_id, {sql_trim('primary_title')} AS x, upper(lower({sql_trim('primary_title')})[1]) || substr(lower({sql_trim('primary_title')}), 2) AS c FROM {TITLES}))"""
)
def exact_variants_f24(spark, folder):
    return _titles(spark, folder).select("title_id", F.array_join(text.exact_variants(F.col("primary_title")), "|").alias("variants"))


@plan(
    """SELECT media_id, CASE codec WHEN 'hevc' THEN 'hevc' WHEN 'h264' THEN 'h264' WHEN 'av1' THEN 'av1' ELSE '' END AS matroska, coalesce(CASE codec WHEN 'hevc' THEN 'hevc' WHEN 'h264' THEN 'h264' WHEN 'av1' THEN 'av1' ELSE codec END, '') AS mp4
       FROM (SELECT DISTINCT media_id, CASE WHEN json_valid(metadata) THEN metadata ->> '$.codec' END AS codec FROM videos)"""
)
def codec_name_f25(spark, folder):
    rows = table(spark, folder, "videos").select("media_id", F.get_json_object("metadata", "$.codec").alias("codec")).distinct()
    stored = text.lookup(F.col("codec"), {"hevc": "V_MPEGH/ISO/HEVC", "h264": "v_mpeg4/iso/avc", "av1": " V_AV1"}, F.lit(""))
    boxed = text.lookup(F.col("codec"), {"hevc": "hvc1", "h264": "avc1", "av1": "av01"}, F.coalesce("codec", F.lit("")))
    return rows.select("media_id", text.matroska_codec(stored).alias("matroska"), text.mp4_codec(boxed).alias("mp4"))


@plan(
    """SELECT media_id, CASE WHEN lower(trim(f)) IN ('yuv420p10le', 'p010le', 'yuv422p10le', 'yuv444p10le') THEN 'p010le' ELSE 'nv12' END AS format
       FROM (SELECT DISTINCT media_id, CASE WHEN json_valid(metadata) THEN metadata ->> '$.pix_fmt' END AS f FROM videos)"""
)
def download_format_f26(spark, folder):
    rows = table(spark, folder, "videos").select("media_id", F.get_json_object("metadata", "$.pix_fmt").alias("f")).distinct()
    return rows.select("media_id", text.download_format(F.col("f")).alias("format"))


@plan(f"SELECT doc_id, regexp_matches(lower(text), '{'|'.join(text.CORRUPTION_MARKS)}') AS corrupt FROM documents")
def corruption_f27(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.is_corruption(F.col("text")).alias("corrupt"))


@plan("SELECT DISTINCT media_id, 'https://films.example/v1/frames/' || preview AS url FROM scene_results WHERE preview <> ''")
def absolute_url_f28(spark, folder):
    rows = table(spark, folder, "scene_results").filter("preview <> ''").select("media_id", F.concat(F.lit("/v1/frames/"), "preview").alias("p")).distinct()
    return rows.select("media_id", text.absolute_url(F.col("p"), F.lit("inner:8000"), F.lit("http"), F.lit("films.example"), F.lit("https")).alias("url"))


@plan("SELECT vec_id, CASE WHEN label = 0 THEN '' ELSE 'https://images.example/w500/' || vec_id || '.jpg' END AS url FROM embeddings")
def image_url_f30(spark, folder):
    path = F.when(F.col("label") == 0, " ").otherwise(F.concat(F.lit("/"), F.col("vec_id").cast("string"), F.lit(".jpg")))
    return table(spark, folder, "embeddings").select("vec_id", text.image_url("https://images.example/", path).alias("url"))


@plan(
    r"""SELECT line_no, CASE WHEN regexp_full_match(y, '[+-]?[0-9]+') AND TRY_CAST(y AS INT) > 0 THEN TRY_CAST(y AS INT) END AS year,
        greatest(coalesce(CASE WHEN regexp_full_match(r, '[+-]?[0-9]+') THEN TRY_CAST(r AS INT) END, 0), 0) AS minutes
        FROM (SELECT line_no, f[6] AS y, f[8] AS r FROM (SELECT line_no, string_split(line, chr(9)) AS f FROM raw_title_basics) WHERE len(f) = 9)"""
)
def parse_num_f31_f32(spark, folder):
    rows = table(spark, folder, "raw_title_basics").select("line_no", F.split("line", "\t", -1).alias("f")).filter(F.size("f") == 9)
    return rows.select("line_no", numbers.positive_year(F.get("f", F.lit(5))).alias("year"), numbers.count_or_zero(F.get("f", F.lit(7))).alias("minutes"))


@plan("SELECT o_orderkey, year(o_orderdate)::INT AS year FROM orders")
def year_of_date_f33(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", numbers.year_of_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year"))


@plan("SELECT DISTINCT search_id, media_id, scene_id, round(round(score::DOUBLE, 6)::FLOAT::DOUBLE, 5) AS score FROM scene_results WHERE score IS NOT NULL AND NOT isnan(score)")
def round_score_f34(spark, folder):
    rows = table(spark, folder, "scene_results").filter("score IS NOT NULL AND NOT isnan(score)")
    return rows.select("search_id", "media_id", "scene_id", F.round(numbers.rounded_score(F.col("score")).cast("double"), 5).alias("score")).distinct()


@plan("SELECT o_orderkey, round(least(greatest((o_orderkey % 100) / 100.0 * 0.3, 0.08), 0.2), 6)::DOUBLE AS threshold FROM orders")
def candidate_threshold_f35(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", F.round(timeline.candidate_threshold((F.col("o_orderkey") % 100) / 100.0), 6).alias("threshold"))


@plan("SELECT DISTINCT request_id, CASE WHEN sample_interval > 0 THEN sample_interval ELSE 30 END::DOUBLE AS interval, 32 AS fast_limit FROM requests")
def sample_interval_f36(spark, folder):
    rows = table(spark, folder, "requests")
    limit = timeline.scene_limit(F.lit(0), timeline.FAST_SCENES)
    return rows.select("request_id", timeline.sample_interval(F.col("sample_interval")).cast("double").alias("interval"), limit.alias("fast_limit")).distinct()


@plan(
    """SELECT media_id, i::INT AS number, duration_sec / n * i AS boundary FROM (
         SELECT DISTINCT media_id, duration_sec, least(greatest(ceil(duration_sec / 30.0), 1), 32)::INT AS n FROM media WHERE duration_sec > 0), generate_series(1, n - 1) AS g(i)"""
)
def fast_bounds_f37(spark, folder):
    rows = table(spark, folder, "media").filter("duration_sec > 0").select("media_id", "duration_sec").distinct()
    bounds = timeline.even_boundaries(F.col("duration_sec"), F.lit(0.0), F.lit(32))
    return rows.select("media_id", F.posexplode(bounds).alias("number", "boundary")).select("media_id", (F.col("number") + 1).alias("number"), "boundary")


@plan(
    """SELECT media_id, i::INT AS "index", round(d * i / 4, 6) AS start, round(d * (i + 1) / 4, 6) AS "end", round(CASE WHEN i > 0 THEN greatest(0, d * i / 4 - 1.5) ELSE d * i / 4 END, 6) AS decode_start,
       round(CASE WHEN i < 3 THEN least(d, d * (i + 1) / 4 + 1.5) ELSE d * (i + 1) / 4 END, 6) AS decode_end
       FROM (SELECT DISTINCT media_id, duration_sec AS d FROM media WHERE duration_sec > 0), generate_series(0, 3) AS g(i)"""
)
def segments_f38(spark, folder):
    rows = table(spark, folder, "media").filter("duration_sec > 0").select("media_id", "duration_sec").distinct()
    parts = rows.select("media_id", F.inline(timeline.segments(F.col("duration_sec"), F.lit(4), F.lit(1.5))))
    return parts.select("media_id", "index", *(F.round(c, 6).alias(c) for c in ("start", "end", "decode_start", "decode_end")))


@plan("SELECT DISTINCT media_id, scene_id, round((start_sec + end_sec) / 2, 6) AS middle FROM scene_results")
def midpoint_f39(spark, folder):
    return table(spark, folder, "scene_results").select("media_id", "scene_id", F.round(timeline.midpoint(F.col("start_sec"), F.col("end_sec")), 6).alias("middle")).distinct()


@plan(
    f"""SELECT media_id, CASE WHEN s >= 1 THEN w ELSE greatest(1, round(w * s)) END::INT AS width, CASE WHEN s >= 1 THEN h ELSE greatest(1, round(h * s)) END::INT AS height FROM (
        SELECT media_id, w, h, least(CASE WHEN 320 < w THEN 320.0::DOUBLE / w ELSE 1 END, CASE WHEN 240 < h THEN 240.0::DOUBLE / h ELSE 1 END) AS s FROM (
        SELECT media_id, TRY_CAST(metadata ->> '$.width' AS INT) AS w, TRY_CAST(metadata ->> '$.height' AS INT) AS h FROM {MEDIA} WHERE json_valid(metadata))) WHERE w > 0 AND h > 0"""
)
def fitted_size_f40(spark, folder):
    newest = table(spark, folder, "media").groupBy("media_id").agg(F.max_by("metadata", "updated_at").alias("metadata"))
    sized = newest.select("media_id", numbers.json_integer(F.col("metadata"), "$.width").alias("w"), numbers.json_integer(F.col("metadata"), "$.height").alias("h")).filter("w > 0 AND h > 0")
    return sized.select("media_id", numbers.fitted_size(F.col("w"), F.col("h"), F.lit(320), F.lit(240)).alias("s")).select("media_id", "s.width", "s.height")


@plan(
    """SELECT vec_id, round(greatest(0, least(1, (0.5 + label / 20.0) * least(1, sqrt(greatest(0.0, vec_id % 300) * greatest(0.0, vec_id % 200) / greatest(1, 1920 * 1080.0)) / 0.25))), 6)::DOUBLE AS quality FROM embeddings"""
)
def face_quality_f42(spark, folder):
    zero = F.lit(0.0)
    quality = numbers.face_quality(0.5 + F.col("label") / 20.0, zero, zero, (F.col("vec_id") % 300).cast("double"), (F.col("vec_id") % 200).cast("double"), F.lit(1920.0 * 1080.0))
    return table(spark, folder, "embeddings").select("vec_id", F.round(quality, 6).alias("quality"))


_HEADERS = ("", "bytes=0-", "bytes=100-199", "bytes=-500", "bytes=5-2", "bytes=1-2,4-5", "items=0-1", "Bytes=9999999999-", "bytes=abc")


@plan(
    """WITH r AS (SELECT DISTINCT media_id, size_bytes AS s, ['', 'bytes=0-', 'bytes=100-199', 'bytes=-500', 'bytes=5-2', 'bytes=1-2,4-5', 'items=0-1', 'Bytes=9999999999-', 'bytes=abc'][1 + (size_bytes % 9)::INT] AS h FROM videos WHERE size_bytes IS NOT NULL)
       SELECT media_id, h AS header,
         CASE WHEN h IN ('', 'items=0-1', 'bytes=0-') THEN 0 WHEN h = 'bytes=100-199' THEN 100 WHEN h = 'bytes=-500' THEN s - least(500, s) WHEN h LIKE 'Bytes%' AND s > 9999999999 THEN 9999999999 END AS start,
         CASE WHEN h IN ('', 'items=0-1', 'bytes=0-', 'bytes=-500') THEN s - 1 WHEN h = 'bytes=100-199' THEN least(199, s - 1) WHEN h LIKE 'Bytes%' AND s > 9999999999 THEN s - 1 END AS "end",
         CASE WHEN h IN ('', 'items=0-1') THEN 200 WHEN h IN ('bytes=0-', 'bytes=100-199', 'bytes=-500') OR (h LIKE 'Bytes%' AND s > 9999999999) THEN 206 ELSE 416 END AS status FROM r"""
)
def http_range_f43(spark, folder):
    rows = table(spark, folder, "videos").filter("size_bytes IS NOT NULL").select("media_id", "size_bytes").distinct()
    header = F.get(F.array(*map(F.lit, _HEADERS)), (F.col("size_bytes") % len(_HEADERS)).cast("int"))
    return rows.select("media_id", header.alias("header"), byteranges.http_range(header, F.col("size_bytes")).alias("r")).select("media_id", "header", "r.*")


@plan(
    """SELECT DISTINCT media_id, CASE WHEN keep THEN a ELSE lo END AS start, CASE WHEN keep THEN b ELSE hi END AS "end" FROM (
         SELECT *, (b - a + 1) * 2 < 1048576 AND size_bytes % 2 = 0 OR hi < b AS keep FROM (
         SELECT media_id, size_bytes, a, b, a // 1048576 * 1048576 AS lo, CASE WHEN b // 1048576 * 1048576 + 1048575 >= size_bytes THEN size_bytes - 1 ELSE b // 1048576 * 1048576 + 1048575 END AS hi
         FROM (SELECT media_id, size_bytes, size_bytes // 3 AS a, size_bytes // 3 + size_bytes % 3000000 AS b FROM videos WHERE size_bytes > 0)))"""
)
def aligned_span_f44(spark, folder):
    rows = table(spark, folder, "videos").filter("size_bytes > 0").select("media_id", "size_bytes").distinct()
    a = F.floor(F.col("size_bytes") / 3)
    b = a + F.col("size_bytes") % 3_000_000
    return rows.select("media_id", byteranges.aligned_span(a, b, 1 << 20, F.col("size_bytes"), F.col("size_bytes") % 2 != 0).alias("s")).select("media_id", "s.start", "s.end")


@plan("SELECT DISTINCT media_id, size_bytes // 1048576 AS last_block, least(1048576, size_bytes - size_bytes // 1048576 * 1048576) AS length FROM videos WHERE size_bytes IS NOT NULL")
def block_length_f45(spark, folder):
    rows = table(spark, folder, "videos").filter("size_bytes IS NOT NULL")
    last = F.floor(F.col("size_bytes") / (1 << 20))
    return rows.select("media_id", last.alias("last_block"), byteranges.block_length(last, F.col("size_bytes"), 1 << 20).alias("length")).distinct()


@plan("SELECT doc_id, substr(sha256(text), 1, 16) AS digest, sha256(text) AS whole FROM documents")
def digest_f48_f49(spark, folder):
    rows = table(spark, folder, "documents")
    return rows.select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("digest"), F.sha2("text", 256).alias("whole"))


@plan("SELECT count(*) AS ids, count(*) AS distinct_ids, 32 AS length FROM documents")
def random_id_f50(spark, folder):
    ids = table(spark, folder, "documents").select(F.replace(F.uuid(), F.lit("-"), F.lit("")).alias("id"))
    return ids.agg(F.count("*").alias("ids"), F.countDistinct("id").alias("distinct_ids"), F.max(F.length("id")).alias("length"))


@plan(f"SELECT media_id, list_contains(languages, 'en') AS has_en, list_has_any(languages, ['de', 'fr']) AS has_any FROM {MEDIA}")
def contains_ar01(spark, folder):
    newest = table(spark, folder, "media").groupBy("media_id").agg(F.max_by("languages", "updated_at").alias("languages"))
    return newest.select("media_id", F.array_contains("languages", "en").alias("has_en"), F.arrays_overlap("languages", F.array(F.lit("de"), F.lit("fr"))).alias("has_any"))


@plan(f"SELECT media_id, array_to_string(list_concat(t, list_filter(u, lambda x: NOT list_contains(t, x))), '|') AS tags FROM (SELECT media_id, coalesce(tags, []) AS t, coalesce(languages, []) AS u FROM {MEDIA})")
def unique_strings_ar02_so05_so06(spark, folder):
    newest = table(spark, folder, "media").groupBy("media_id").agg(F.max_by(F.struct("tags", "languages"), "updated_at").alias("m")).select("media_id", "m.*")
    none = F.array().cast("array<string>")
    padded = F.transform(F.concat(F.coalesce("tags", none), F.coalesce("languages", none)), lambda x: F.concat(F.lit(" "), x, F.lit(" ")))
    return newest.select("media_id", F.array_join(text.cleaned_ids(F.concat(padded, F.array(F.lit(" "), F.lit("")))), "|").alias("tags"))


@plan(
    f"""SELECT media_id, coalesce(CASE WHEN json_valid(metadata) THEN TRY_CAST(metadata ->> '$.width' AS INT) END, 0) AS width, coalesce(CASE WHEN json_valid(metadata) THEN TRY_CAST(metadata ->> '$.height' AS INT) END, 0) AS height,
        coalesce({sql_trim("CASE WHEN json_valid(metadata) THEN metadata ->> '$.local_path' END")}, '') AS local_path, false AS remote FROM {MEDIA}"""
)
def json_metadata_p33_ar04_ar09_ar10(spark, folder):
    newest = table(spark, folder, "media").groupBy("media_id").agg(F.max_by("metadata", "updated_at").alias("metadata"))
    size = (numbers.json_integer(F.col("metadata"), f"$.{name}").alias(name) for name in ("width", "height"))
    path = F.coalesce(text.trimmed(F.try_variant_get(F.try_parse_json("metadata"), "$.local_path", "string")), F.lit(""))
    return newest.select("media_id", *size, path.alias("local_path"), numbers.json_flag(F.col("metadata"), "remote").alias("remote"))


@plan("SELECT media_id, to_json(list_sort(languages)) AS encoded, len(languages)::INT AS members FROM (SELECT DISTINCT media_id, languages FROM media WHERE languages IS NOT NULL)")
def string_list_json_ar06(spark, folder):
    rows = table(spark, folder, "media").filter("languages IS NOT NULL").select("media_id", F.to_json(F.sort_array("languages")).alias("encoded")).distinct()
    return rows.select("media_id", "encoded", F.size(F.from_json("encoded", "array<string>")).alias("members"))


@plan("SELECT vec_id, 4 * len(embedding) AS bytes, true AS same FROM embeddings")
def vector_codec_ar07(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", vectors.to_bytes(F.col("embedding")).alias("b"))
    return rows.select("vec_id", F.octet_length("b").alias("bytes"), (vectors.from_bytes(F.col("b")) == F.col("embedding").cast("array<float>")).alias("same"))


@plan(
    """SELECT q AS query, list_extract(regexp_extract_all(url, '[?&]q=([^&]*)', 1), 1) AS text, regexp_extract(url, '[?&]year=([0-9]+)', 1)::INT AS year,
       array_to_string(list_distinct_ordered, '|') AS persons FROM (
       SELECT o_orderkey AS q, '/v1/search?q=film' || o_orderkey || '&year=' || (1990 + o_orderkey % 30) || '&person_ids=a,b&person_ids=c' AS url, ['a', 'b', 'c'] AS list_distinct_ordered FROM orders)"""
)
def query_string_ar14(spark, folder):
    url = F.concat(F.lit("http://h/v1/search?q=film"), F.col("o_orderkey").cast("string"), F.lit("&year="), (1990 + F.col("o_orderkey") % 30).cast("string"), F.lit("&person_ids=a,b&person_ids=c"))
    persons = F.flatten(F.transform(F.regexp_extract_all(url, F.lit("[?&]person_ids=([^&]*)"), 1), lambda p: F.split(p, ",")))
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("query"), F.parse_url(url, F.lit("QUERY"), F.lit("q")).alias("text"), F.parse_url(url, F.lit("QUERY"), F.lit("year")).cast("int").alias("year"), F.array_join(text.cleaned_ids(persons), "|").alias("persons")
    )


@plan("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, 1.0::DOUBLE AS unit_norm FROM embeddings")
def vector_norm_ag16(spark, folder):
    rows = table(spark, folder, "embeddings")
    return rows.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(vectors.norm(vectors.unit(F.col("embedding"))), 5).alias("unit_norm"))


@plan()
def hash_embed_u01(spark, folder):
    rows = table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", vectors.hashed_texts(F.col("text")).alias("v"))
    return rows.select("doc_id", F.size("v").alias("dimensions"), F.round(vectors.norm(F.col("v")), 5).alias("norm"))


@plan()
def hash_face_u03(spark, folder):
    rows = table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", vectors.hashed_bytes(F.encode("text", "UTF-8")).alias("v"))
    return rows.select("doc_id", F.size("v").alias("dimensions"), F.round(vectors.norm(F.col("v")), 5).alias("norm"))


@plan(
    """SELECT o_orderkey, (CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 3 END)::INT AS listed, array_to_string(CASE WHEN o_orderkey % 5 = 0 THEN range(1, 5) ELSE list_sort(list_filter([o_orderkey % 7, 3, 1], lambda x: x BETWEEN 1 AND 4)) END, ',') AS samples FROM orders"""
)
def sync_samples_ar05(spark, folder):
    entries = F.when(F.col("o_orderkey") % 5 != 0, F.array(F.col("o_orderkey").cast("int") % 7, F.lit(3), F.lit(1)))
    return table(spark, folder, "orders").select(
        "o_orderkey", F.when(entries.isNotNull(), F.size(entries)).alias("listed"), F.array_join(timeline.sync_samples(entries, F.lit(4)), ",").alias("samples")
    )


@plan("SELECT request_id, CASE WHEN reference <> '' AND NOT starts_with(reference, '/v1/') AND NOT regexp_matches(lower(reference), '^https?://') THEN reference END AS preview FROM (SELECT DISTINCT request_id, CASE WHEN coalesce(local_path, '') <> '' THEN local_path WHEN fast_mode THEN '/v1/' || source_name ELSE source_name END AS reference FROM requests)")
def local_preview_p19(spark, folder):
    rows = table(spark, folder, "requests").select("request_id", "local_path", "source_name", "fast_mode").distinct()
    url = F.when(F.col("fast_mode"), F.concat(F.lit("/v1/"), "source_name")).otherwise(F.col("source_name"))
    return rows.select("request_id", text.local_preview(F.col("local_path"), url).alias("preview"))


@plan(
    f"""SELECT title_id, array_to_string(CASE WHEN list_contains(w, h) OR h = '' THEN w ELSE w || [h] END, '|') AS queries FROM (
        SELECT title_id, h, list_transform(list_sort(list_distinct(list_transform(list_filter(string_split(h, ' '), lambda t: len(t) >= 4 AND regexp_full_match(t, '[A-Za-z]+')
          AND t NOT IN ('about', 'after', 'before', 'from', 'into', 'movie', 'the', 'this', 'with')), lambda t: {{'n': -len(t), 't': t}}))), lambda x: x.t) AS w
        FROM (SELECT title_id, {_loose("coalesce(primary_title, '')")} AS h FROM {TITLES}))"""
)
def search_order_sl18_p26(spark, folder):
    hints = F.array(F.coalesce("primary_title", F.lit("")))
    return _titles(spark, folder).select("title_id", F.array_join(text.search_order(hints), "|").alias("queries"))


@plan("SELECT media_id, sha256(media_id || '|' || coalesce(size_bytes, 0)) AS cache_key FROM (SELECT DISTINCT media_id, size_bytes FROM videos)")
def index_cache_key_w19(spark, folder):
    rows = table(spark, folder, "videos").select("media_id", "size_bytes").distinct()
    return rows.select("media_id", F.sha2(F.concat_ws("|", "media_id", F.coalesce("size_bytes", F.lit(0)).cast("string")), 256).alias("cache_key"))
