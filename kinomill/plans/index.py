"""Queries that keep the index and the task log."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinomill.operators import index, reports, tasks
from kinomill.plans.registry import Registry, sql_trim
from kinomill.streaming import tasks as stream
from kinomill.tables import table

plan = Registry()
QUERIES, ORACLES = plan.queries, plan.oracles

MEDIA = "(SELECT * FROM media QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY updated_at DESC) = 1)"
SCENES = "(SELECT DISTINCT media_id, scene_id, start_sec, end_sec FROM scene_results)"


def _media(spark, folder):
    return index.latest(table(spark, folder, "media"), "media_id", ["updated_at"])


def _scenes(spark, folder):
    return table(spark, folder, "scene_results").select("media_id", "scene_id", "start_sec", "end_sec").distinct()


@plan(
    f"""SELECT media_id, scene_id, false AS fresh FROM (SELECT DISTINCT media_id, scene_id FROM scene_results) WHERE media_id NOT IN (SELECT media_id FROM {MEDIA} WHERE release_year >= 2000)
          AND scene_id NOT IN (SELECT scene_id FROM scene_people WHERE media_id IN (SELECT media_id FROM {MEDIA} WHERE release_year >= 2000))
        UNION ALL SELECT DISTINCT media_id, scene_id, true FROM scene_people WHERE media_id IN (SELECT media_id FROM {MEDIA} WHERE release_year >= 2000)"""
)
def upsert_media_w01(spark, folder):
    media = _media(spark, folder).select("media_id")
    new = _media(spark, folder).filter("release_year >= 2000").select("media_id")
    scenes = _scenes(spark, folder).select("media_id", "scene_id").distinct().withColumn("fresh", F.lit(False))
    fresh = table(spark, folder, "scene_people").join(new, "media_id", "left_semi").select("media_id", "scene_id").distinct().withColumn("fresh", F.lit(True))
    return index.upsert_media(media, scenes, new, fresh)[1]


@plan(
    f"""WITH ids AS (SELECT DISTINCT {sql_trim('media_id')} AS media_id FROM (SELECT media_id FROM requests UNION ALL SELECT ' ' || media_id || ' ' FROM videos WHERE fingerprint IS NULL) WHERE {sql_trim('media_id')} <> '')
        SELECT 'media' AS what, count(*) AS n FROM {MEDIA} WHERE media_id NOT IN (SELECT media_id FROM ids) UNION ALL SELECT 'scenes', count(*) FROM {SCENES} WHERE media_id NOT IN (SELECT media_id FROM ids)
        UNION ALL SELECT 'deleted', count(*) FROM ids WHERE media_id IN (SELECT media_id FROM media) UNION ALL SELECT 'unknown', count(*) FROM ids WHERE media_id NOT IN (SELECT media_id FROM media)"""
)
def delete_media_w02_w22_j28(spark, folder):
    ids = table(spark, folder, "requests").select("media_id").unionAll(table(spark, folder, "videos").filter("fingerprint IS NULL").select(F.concat(F.lit(" "), "media_id", F.lit(" "))))
    media, scenes, outcome = index.delete_media(_media(spark, folder), _scenes(spark, folder), ids)
    parts = (("media", media), ("scenes", scenes), ("deleted", outcome.filter("deleted")), ("unknown", outcome.filter("NOT deleted")))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in parts]
    return counts[0].unionAll(counts[1]).unionAll(counts[2]).unionAll(counts[3])


@plan(f"SELECT media_id, scene_id, start_sec, end_sec FROM {SCENES} s WHERE NOT EXISTS (SELECT 1 FROM scene_people p WHERE p.media_id = s.media_id AND p.scene_id = s.scene_id)")
def delete_scene_w03(spark, folder):
    return index.delete_scenes(_scenes(spark, folder), table(spark, folder, "scene_people"))


@plan(
    """WITH u AS (SELECT media_id, scene_id, max_by(person_id, person_id) AS p FROM scene_people GROUP BY ALL), s AS (SELECT DISTINCT media_id, scene_id FROM scene_results)
       SELECT s.media_id, s.scene_id, coalesce(p, 'none') AS people FROM s LEFT JOIN u ON u.media_id = s.media_id AND u.scene_id = s.scene_id"""
)
def scene_people_update_w04_x05(spark, folder):
    scenes = _scenes(spark, folder).select("media_id", "scene_id").distinct().withColumn("person_ids", F.array(F.lit("none")))
    padded = F.array(F.concat(F.lit(" "), "person_id"), F.col("person_id"), F.lit(""))
    updates = table(spark, folder, "scene_people").select("media_id", "scene_id", padded.alias("person_ids"), F.col("person_id").alias("n"))
    return index.update_people(scenes, updates).select("media_id", "scene_id", F.array_join("person_ids", "|").alias("people"))


@plan(f"SELECT media_id, coalesce(nullif(CASE WHEN json_valid(metadata) THEN metadata ->> '$.local_path' END, ''), '/old/' || media_id) AS local_path FROM {MEDIA}")
def sticky_path_w10(spark, folder):
    rows = _media(spark, folder).select("media_id", F.get_json_object("metadata", "$.local_path").alias("new"))
    return rows.select("media_id", index.sticky(F.concat(F.lit("/old/"), "media_id"), F.col("new")).alias("local_path"))


@plan(
    """WITH old AS (SELECT DISTINCT vector_id, coalesce(image_id, vector_id) AS image_id, model FROM face_vectors WHERE model = 'face-a'), new AS (SELECT DISTINCT vector_id, coalesce(image_id, vector_id) AS image_id, model FROM face_vectors WHERE model = 'face-b')
       SELECT * FROM old WHERE vector_id NOT IN (SELECT vector_id FROM new) AND image_id NOT IN (SELECT image_id FROM new) UNION ALL SELECT * FROM new"""
)
def overwrite_vectors_w11(spark, folder):
    rows = table(spark, folder, "face_vectors").select("vector_id", F.coalesce("image_id", "vector_id").alias("image_id"), "model").distinct()
    return index.overwrite_by_keys(rows.filter("model = 'face-a'"), rows.filter("model = 'face-b'"), ["vector_id", "image_id"])


@plan(
    """WITH r AS (SELECT DISTINCT request_id, local_path, CASE WHEN request_id % 4 = 0 THEN ' ' WHEN request_id % 4 = 1 THEN NULL ELSE 'http://' || source END AS source_url FROM requests), s AS (SELECT *, trim(coalesce(local_path, '')) <> '' AND trim(coalesce(source_url, '')) <> '' AS stale FROM r)
       SELECT request_id, CASE WHEN stale THEN '' ELSE local_path END AS local_path, (SELECT count(*) FROM s WHERE stale) AS cleared FROM s"""
)
def clear_paths_w17(spark, folder):
    """Local paths of what has an address, and how many were cleared."""
    n = F.col("request_id")
    address = F.when(n % 4 == 0, " ").when(n % 4 > 1, F.concat(F.lit("http://"), "source"))
    kept, count = reports.without_remote_paths(table(spark, folder, "requests").select("request_id", "local_path", address.alias("source_url")).distinct())
    return kept.select("request_id", "local_path", F.lit(count.first()["cleared"]).alias("cleared"))


@plan(
    f"""SELECT media_id, count(scene_id)::INT AS scenes, coalesce(min(start_sec), -1) AS first_start FROM {MEDIA} m LEFT JOIN {SCENES} s USING (media_id) GROUP BY media_id"""
)
def media_nested_j02(spark, folder):
    rows = _scenes(spark, folder).withColumnRenamed("start_sec", "start")
    nested = index.nest_scenes(_media(spark, folder).select("media_id"), rows)
    return nested.select("media_id", F.coalesce(F.size("scenes"), F.lit(0)).alias("scenes"), F.coalesce(F.get("scenes", F.lit(0))["start"], F.lit(-1.0)).alias("first_start"))


@plan(
    f"""SELECT media_id, array_to_string(list_filter([CASE WHEN coalesce({sql_trim('title')}, '') = '' THEN 'title' END, CASE WHEN n = 0 THEN 'scenes' END, CASE WHEN release_year NOT BETWEEN 1888 AND 3000 THEN 'year' END,
          CASE WHEN duration_sec < 0 THEN 'duration' END, CASE WHEN bad > 0 THEN 'interval' END], lambda x: x IS NOT NULL), ',') AS errors
        FROM (SELECT m.media_id, any_value(title) AS title, any_value(release_year) AS release_year, any_value(duration_sec) AS duration_sec, count(scene_id) AS n, count(CASE WHEN start_sec < 0 OR start_sec >= end_sec THEN 1 END) AS bad
              FROM {MEDIA} m LEFT JOIN {SCENES} s USING (media_id) GROUP BY m.media_id)"""
)
def validate_media_p10(spark, folder):
    scenes = _scenes(spark, folder).select("media_id", F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), F.lit(0.0).cast("float").alias("quality_score"))
    media = _media(spark, folder).select("media_id", F.col("media_type").alias("type"), "title", F.col("release_year").alias("year"), F.col("duration_sec").alias("duration"))
    return reports.media_problems(media, scenes).select("media_id", F.array_join("errors", ",").alias("errors"))


@plan("SELECT DISTINCT media_id, scene_id, CASE WHEN preview <> '' THEN '/v1/frames/' || preview ELSE '' END AS preview FROM scene_results")
def public_scenes_p31(spark, folder):
    """Scenes as shown outside, nested by scene so that no media is one row."""
    rows = table(spark, folder, "scene_results").select("media_id", "scene_id", F.array(F.struct("preview", F.lit("/private").alias("preview_path"))).alias("scenes"))
    return rows.select("media_id", "scene_id", F.inline(index.public_scenes(F.col("scenes"), "/v1/frames/"))).distinct()


@plan("SELECT media_id, coalesce(bool_and(trim(coalesce(preview, '')) <> '') FILTER (s.media_id IS NOT NULL), false) AS complete FROM (SELECT DISTINCT media_id FROM media) m LEFT JOIN scene_results s USING (media_id) GROUP BY media_id".replace("FILTER (s.media_id IS NOT NULL)", "FILTER (scene_id IS NOT NULL)"))
def all_previews_ar13(spark, folder):
    return reports.all_previews(table(spark, folder, "scene_results"), table(spark, folder, "media"))


@plan("SELECT count(*) AS rows, count(DISTINCT media_id) AS media FROM (SELECT DISTINCT media_id, scene_id FROM scene_results)")
def replace_table_w05_io10(spark, folder):
    from kinomill.lineage import scratch_path

    path = scratch_path(spark, "index")
    index.replace_table(_scenes(spark, folder).select("media_id", "scene_id").distinct(), path)
    index.replace_table(spark.read.parquet(path), path)
    return spark.read.parquet(path).agg(F.count("*").alias("rows"), F.countDistinct("media_id").alias("media"))


@plan(f"SELECT media_id, title, year FROM (SELECT media_id, title, release_year AS year FROM {MEDIA})")
def json_lines_io01_w20(spark, folder):
    from kinomill.lineage import scratch_path
    from kinomill.sources.snapshots import media_lines

    path = scratch_path(spark, "media-lines")
    _media(spark, folder).select("media_id", "title", F.col("release_year").alias("year"), F.col("media_type").alias("type")).write.json(path)
    return media_lines(spark, path).select("media_id", "title", "year")


# The task log: events of a user are the log of a task.


def _events(spark, folder):
    return table(spark, folder, "events").select("user_id", "event_id", "event_type", (F.col("value") / 100).alias("percent"))


@plan("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type, round(max_by(value, event_id) / 100, 6) AS percent FROM events GROUP BY user_id")
def task_latest_st08(spark, folder):
    return tasks.latest_states(_events(spark, folder), "user_id", ["event_id"]).withColumn("percent", F.round("percent", 6))


@plan("SELECT event_id, round(least(1, greatest(0, max(value / 100) OVER (PARTITION BY user_id ORDER BY event_id))), 6) AS percent FROM events")
def task_percent_ag17(spark, folder):
    return tasks.running_percent(_events(spark, folder), "user_id", ["event_id"]).select("event_id", F.round("percent", 6).alias("percent"))


@plan(
    """WITH r AS (SELECT request_id AS id, min(source_fingerprint) AS f FROM requests GROUP BY 1) SELECT id, CASE WHEN trim(coalesce(f, '')) <> '' THEN min(id) OVER (PARTITION BY f) ELSE id END AS first_id FROM r"""
)
def task_dedup_wf11_st03_st05(spark, folder):
    rows = table(spark, folder, "requests").groupBy(F.col("request_id").alias("id")).agg(F.min("source_fingerprint").alias("f"))
    return tasks.first_of_equals(rows, "f", ["id"]).select("id", "first_id")


STATE = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'canceled' END"


def _tasks(spark, folder):
    state = F.expr(STATE).alias("state")
    return tasks.latest_states(table(spark, folder, "events").select(F.col("user_id").alias("id"), "event_id", state), "id", ["event_id"]).drop("event_id")


@plan(f"SELECT id, CASE WHEN state IN ('queued', 'running') THEN 'failed' ELSE state END AS state FROM (SELECT user_id AS id, max_by({STATE}, event_id) AS state FROM events GROUP BY 1)")
def task_recovery_io14_st15(spark, folder):
    return tasks.recovered(_tasks(spark, folder))


@plan(f"SELECT id, state FROM (SELECT user_id AS id, max_by({STATE}, event_id) AS state FROM events GROUP BY 1) WHERE state NOT IN ('completed', 'failed', 'canceled')")
def task_clear_st07(spark, folder):
    return tasks.without_terminal(_tasks(spark, folder))


@plan(
    f"""WITH t AS (SELECT user_id AS id, max_by({STATE}, event_id) AS state FROM events GROUP BY 1), a AS (SELECT DISTINCT c_custkey AS id FROM customer)
        SELECT a.id, CASE WHEN state IS NULL THEN 'missing' WHEN state IN ('completed', 'failed', 'canceled') THEN 'finished' ELSE 'stopped' END AS outcome FROM a LEFT JOIN t ON t.id = a.id"""
)
def task_outcomes_j28_st11(spark, folder):
    return tasks.outcomes(table(spark, folder, "customer").select(F.col("c_custkey").alias("id")), _tasks(spark, folder))


@plan("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stream_task_events_st01(spark, folder):
    events = stream.file_stream(spark, folder, "events").select("user_id", "event_id", "event_type")
    return stream.latest_of_stream(events, "user_id", ["event_id"])


@plan(
    """WITH e AS (SELECT *, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS stop FROM events)
       SELECT user_id, round(least(1, max(value) / 100), 6) AS percent, max(CASE WHEN event_type = 'error' THEN 'error' ELSE '' END) AS ended, count(*) AS seen FROM e WHERE stop IS NULL OR event_id <= stop GROUP BY user_id"""
)
def stream_task_state_st02_ag17(spark, folder):
    events = stream.file_stream(spark, folder, "events").select("user_id", "event_id", "event_type", (F.col("value") / 100).alias("percent"))
    found = stream.progress_of_stream(events, "user_id", "event_id", "percent", "event_type", ("error",))
    return found.withColumn("percent", F.round("percent", 6))


@plan("SELECT DISTINCT user_id || '|' || event_type AS kind FROM events")
def stream_first_seen_st03(spark, folder):
    """Each kind of event once, as it comes first."""
    rows = stream.file_stream(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("|", "user_id", "event_type").alias("kind"))
    return stream.first_seen_of_stream(rows, "kind", "ts", "400 days").select("kind")


@plan("SELECT user_id, event_id, event_type FROM (SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id)")
def stream_snapshot_w18(spark, folder):
    """The snapshot that a stream of task events keeps in a table, replaced after each batch."""
    from kinomill.lineage import scratch_path

    path = scratch_path(spark, "tasks")
    stream.kept_snapshot(stream.file_stream(spark, folder, "events").select("user_id", "event_id", "event_type"), path, "user_id", ["event_id"])
    return spark.read.parquet(path)


@plan(
    f"""WITH a AS (SELECT user_id AS id, max_by({STATE}, event_id) AS state FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id AS id, max_by({STATE}, event_id) AS state FROM events WHERE user_id % 9 <> 0 GROUP BY 1)
        SELECT id, CASE WHEN b.id IS NULL THEN 'removed' ELSE 'updated' END AS kind, b.state FROM a FULL JOIN b USING (id) WHERE a.id IS NULL OR b.id IS NULL OR a.state IS DISTINCT FROM b.state"""
)
def task_changes_st01(spark, folder):
    """What a subscriber is told between two states of the task log: new and changed tasks, and removed ones."""
    events = table(spark, folder, "events").select(F.col("user_id").alias("id"), "event_id", F.expr(STATE).alias("state"))
    states = [tasks.latest_states(rows, "id", ["event_id"]).drop("event_id") for rows in (events.filter("event_id % 2 = 0"), events.filter("id % 9 <> 0"))]
    return tasks.changes(*states, "id").select("id", "kind", "state")


@plan(
    """WITH c AS (SELECT event_id, user_id AS media_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value * 100 - 500 END AS time FROM events), m AS (SELECT c_custkey AS media_id, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS duration FROM customer WHERE c_custkey % 5 <> 0)
       SELECT event_id, CASE WHEN m.media_id IS NULL THEN 'unknown media' WHEN time IS NULL OR time < 0 OR time > duration THEN 'bad time' END AS problem FROM c LEFT JOIN m USING (media_id)"""
)
def stream_commands_st10(spark, folder):
    """Commands that come as a stream, checked against the table of media."""
    commands = stream.file_stream(spark, folder, "events").select("event_id", F.col("user_id").alias("media_id"), F.when(F.col("event_id") % 11 != 0, F.col("value") * 100 - 500).alias("time"))
    key = F.col("c_custkey")
    media = table(spark, folder, "customer").filter(key % 5 != 0).select(key.alias("media_id"), F.when(key % 4 != 0, F.col("c_acctbal")).alias("duration"))
    return stream.checked_stream(commands, media).select("event_id", "problem")
